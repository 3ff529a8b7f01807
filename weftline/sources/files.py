"""Readers and writers of the engine's file formats."""

from __future__ import annotations

import io
import json
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines with a stated schema; blank lines are no rows, broken lines fail."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def tagged_scan(spark: SparkSession, paths: list[str], tags: dict[str, str], column: str) -> DataFrame:
    """Parquet files with a column that tells the source from the file's name; the first tag that occurs counts."""
    tag: Column = F.lit(None).cast("string")
    for part, name in reversed(list(tags.items())):
        tag = F.when(F.col("_metadata.file_path").contains(part), name).otherwise(tag)
    return spark.read.parquet(*paths).withColumn(column, tag)


def read_arrays(spark: SparkSession, path: str) -> DataFrame:
    """(file, name, row_no, values): rows of the arrays in ``.npy`` and ``.npz`` files."""

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for file, content in zip(pdf.path, pdf.content, strict=True):
                loaded = np.load(io.BytesIO(content), allow_pickle=False)
                for name, a in loaded.items() if hasattr(loaded, "items") else [("", loaded)]:
                    a = np.asarray(a, np.float64)
                    a = a.reshape(len(a), -1) if a.ndim else a.reshape(1, 1)
                    yield pd.DataFrame({"file": file, "name": name, "row_no": np.arange(len(a)), "values": list(a)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(rows, "file string, name string, row_no long, values array<double>")


def read_safetensors(spark: SparkSession, path: str) -> DataFrame:
    """(file, name, shape, values) of the float32 tensors of safetensors files: an 8-byte header length, a JSON header
    with offsets, raw little-endian data."""

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for file, content in zip(pdf.path, pdf.content, strict=True):
                (n,) = struct.unpack("<Q", content[:8])
                out = []
                for name, t in json.loads(content[8 : 8 + n]).items():
                    if name != "__metadata__" and t["dtype"] == "F32":
                        a, b = t["data_offsets"]
                        out.append((file, name, list(t["shape"]), np.frombuffer(content[8 + n + a : 8 + n + b], "<f4").astype(float)))
                yield pd.DataFrame(out, columns=["file", "name", "shape", "values"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(rows, "file string, name string, shape array<long>, values array<double>")


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """(paper_id, title, cat, primary_cat) of the entries of Atom feed files."""
    t = spark.read.format("xml").option("rowTag", "entry").schema("id string, title string, category array<struct<_term:string>>, primary_category struct<_term:string>").load(path)
    return t.select(
        F.substring_index("id", "/", -1).alias("paper_id"),
        F.trim(F.regexp_replace("title", r"\s+", " ")).alias("title"),
        F.get("category", F.lit(0))["_term"].alias("cat"),
        F.col("primary_category._term").alias("primary_cat"),
    )


def pick(df: DataFrame, **choices: list[str]) -> DataFrame:
    """Columns that take the first non-null of those of the listed ones that exist, null where none does."""
    have = set(df.columns)
    out = []
    for name, cols in choices.items():
        found = [F.col(c).cast("string") for c in cols if c in have]
        out.append((F.coalesce(*found) if found else F.lit(None).cast("string")).alias(name))
    return df.select(*out)


def write_sharded(df: DataFrame, path: str, rows_per_file: int = 10_000) -> None:
    df.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(path)


def append_missing(df: DataFrame, path: str, key: str, spark: SparkSession, known: bool) -> None:
    """Append the rows whose key is not stored yet; ``known`` tells whether the path holds a table."""
    new = df.join(spark.read.parquet(path).select(key).distinct(), key, "left_anti") if known else df
    new.write.mode("append").parquet(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines in place of what was there."""
    df.write.mode("overwrite").json(path)


def write_arrays(df: DataFrame, path: str) -> None:
    """Array columns, in place of what was there, as Parquet: the engine's form of array files."""
    df.write.mode("overwrite").parquet(path)


def fetch_missing(keys: DataFrame, key: str, fetch: Callable[[str], str], path: str, stored: bool, workers: int = 6, tries: int = 3) -> None:
    """Append (key, body, error) of the keys that are not stored yet with a body, fetched by at most ``workers`` tasks.

    A failing key is tried ``tries`` times; then its error is stored and a later call tries it again.  Nulls are left out.
    """
    todo = keys.select(F.col(key).cast("string").alias(key)).where(F.col(key).isNotNull()).distinct()
    if stored:
        todo = todo.join(keys.sparkSession.read.parquet(path).where("body is not null").select(key), key, "left_anti")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for k in pdf[key]:
                body = error = None
                for _ in range(tries):
                    try:
                        body, error = fetch(k), None
                        break
                    except Exception as e:  # noqa: BLE001 - whatever the fetcher raises is stored
                        error = f"{type(e).__name__}: {e}"
                out.append((k, body, error))
            yield pd.DataFrame(out, columns=[key, "body", "error"])

    todo.repartition(workers).mapInPandas(run, f"{key} string, body string, error string").write.mode("append").parquet(path)
