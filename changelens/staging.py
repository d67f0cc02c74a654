"""Written intermediate tables, and joins that no single key can slow down."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import scratch_path


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it back.

    Cuts the lineage the way checkpoint() does, but computes the rows once and
    keeps columns prunable.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def join_per_key(rows: DataFrame, per_key: DataFrame, key: str | list[str], count: str, most: int = 1000) -> DataFrame:
    """``rows`` joined to ``per_key`` by ``key``, one column or several (null equals null); ``per_key`` has one row per key and the number
    of rows of each in ``count``.

    Keys with more than 1/most of all rows are at most ``most``: those go by a broadcast, so no task meets all rows of one
    key.  The other keys are joined by a shuffle.
    """
    keys = [key] if isinstance(key, str) else key
    per_key = written(per_key, "per-key").withColumnsRenamed({k: f"__k_{k}" for k in keys})
    limit = (per_key.agg(F.sum(count)).first()[0] or 0) // most
    hot = F.broadcast(per_key.where(F.col(count) > limit))
    cold = per_key.where(F.col(count) <= limit)
    names = [f"__k_{k}" for k in keys]
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys])
    by_hot = rows.join(hot, same).drop(*names)
    if cold.isEmpty():
        return by_hot
    rest = rows.join(hot.select(*names), same, "left_anti")
    return by_hot.unionByName(rest.join(cold, same).drop(*names))
