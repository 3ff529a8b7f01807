from pyspark.sql import functions as F

from weftline.operators.knn import centroids
from weftline.streaming.assign import assign_stream


def test_new_vectors_join_their_cluster(spark, tmp_path):
    df = spark.createDataFrame([(i, [1.0, 0.1 * i] if i < 5 else [0.0, 1.0], int(i >= 5)) for i in range(10)], "vec_id long, embedding array<float>, cluster int")
    df.write.parquet(str(tmp_path / "in"))
    cents = centroids(df, "cluster", "embedding").cache()
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")).drop("cluster")
    assign_stream(stream, cents, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
    got = spark.read.parquet(str(tmp_path / "out")).join(df.withColumnRenamed("cluster", "want"), F.col("id") == F.col("vec_id"))
    assert got.count() == 10 and got.where("cluster <> want").count() == 0
