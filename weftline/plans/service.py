"""Facades around the engine: pipelines and embedders by name, a request, and taps on intermediate stages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.plans import pipelines
from weftline.session import cut

#: A pipeline takes (frame, group, id, text column, ...) and returns (group, id, cluster).
Pipeline = Callable[..., DataFrame]
#: An embedder takes (frame, keys, text column) and returns (keys..., v).
Embedder = Callable[[DataFrame, list[str], str], DataFrame]

PIPELINES: dict[str, Pipeline] = {}
EMBEDDERS: dict[str, Embedder] = {}


def register(table: dict, name: str) -> Callable:
    """Add a function to a registry; a name is given once.  Only code that the caller has imported can be added."""

    def add(f: Callable) -> Callable:
        if name in table:
            raise ValueError(f"{name} is registered already")
        table[name] = f
        return f

    return add


for _name, _f in (("baseline", pipelines.baseline), ("leader", pipelines.leader), ("fallback", pipelines.fallback)):
    register(PIPELINES, _name)(_f)
register(EMBEDDERS, "tfidf_svd")(pipelines.dense_features)


class BadRequest(ValueError):
    """A request that a service answers with status 400."""

    status = 400


def health(spark: SparkSession) -> dict[str, str]:
    return {"status": "ok" if spark.range(1).count() == 1 else "failed"}


def cluster_request(spark: SparkSession, texts: list[str | None], pipeline: str = "baseline", most: int = 100_000) -> list[int]:
    """One label per text, in order.  An empty request, or one above ``most`` texts, is a :class:`BadRequest`; the
    labels of this one bounded request are all that reaches the driver."""
    if not texts:
        raise BadRequest("no texts")
    if len(texts) > most:
        raise BadRequest(f"{len(texts)} texts; at most {most}")
    df = spark.createDataFrame([(0, i, t) for i, t in enumerate(texts)], "grp long, pos long, text string")
    labels = {r.pos: r.cluster for r in PIPELINES[pipeline](df, "grp", "pos", "text").select("pos", "cluster").collect()}
    return [labels.get(i, -1) for i in range(len(texts))]


class Taps:
    """Named intermediate tables of a run: ``tap`` keeps a stage and hands on a materialised copy."""

    def __init__(self) -> None:
        self.stages: dict[str, DataFrame] = {}

    def __call__(self, name: str, df: DataFrame) -> DataFrame:
        self.stages[name] = cut(df)
        return self.stages[name]

    def sizes(self) -> dict[str, int]:
        return {n: t.agg(F.count(F.lit(1))).first()[0] for n, t in self.stages.items()}
