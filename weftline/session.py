"""Session helpers shared by queries, tests and the benchmark."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "weftline", cpus: int | str = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a scale directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared checkpoint folder; a local session, as in tests, gets a temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None:
            if not re.fullmatch(r"local(\[.*\])?", sc.master):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            shared = os.path.join(tempfile.gettempdir(), "weftline-checkpoints")
        sc.setCheckpointDir(shared)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and drop its lineage.

    The files survive the loss of executors, unlike a local checkpoint.  The planner's size estimate is dropped too: a
    checkpoint would keep that of the plan that made it, which tells little about the rows (and less about what is
    exploded from them), so a table that grows with the data could be broadcast unmeasured.  Without an estimate only
    the adaptive planner broadcasts, by the measured size of a shuffle.
    """
    ensure_checkpoint_dir(df.sparkSession)
    spark, out = df.sparkSession, df.checkpoint(eager=True)
    plain = spark._jsparkSession.internalCreateDataFrame(out._jdf.queryExecution().toRdd(), out._jdf.schema(), False)
    return DataFrame(plain, spark)


def spill_cache(df: DataFrame) -> DataFrame:
    """Keep ``df`` for several uses, on disk so that memory stays free."""
    return df.persist(StorageLevel.DISK_ONLY)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as there are cores, for work that costs far more than a shuffle.

    Only an input of fewer splits than cores, hence a small one, is shuffled.
    """
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df
