"""Assignment of newly arriving vectors to existing clusters: an extension, the reference has no streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from weftline.operators.knn import nearest_centroid


def assign_stream(stream: DataFrame, centroids: DataFrame, path: str, checkpoint: str, id_col: str = "vec_id", vec_col: str = "embedding", cluster: str = "cluster") -> StreamingQuery:
    """Write (id, cluster, sim, batch) of every arriving row as Parquet, once for each batch."""

    def sink(batch: DataFrame, number: int) -> None:
        out = nearest_centroid(batch, id_col, vec_col, centroids, cluster)
        out.write.mode("overwrite").parquet(f"{path}/batch={number}")  # a repeated batch replaces itself

    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
