"""Helpers shared by the operators: words, shingle hashes, written tables, distributed prefix sums."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ship_package as ship  # noqa: F401
from ..staging import join_per_key, written  # noqa: F401

#: A word is a run of characters other than space and \t \n \v \f \r (what bytes.split() finds).
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = r"[\x20\x09-\x0D]+"
SHINGLE_WORDS = 5
NEAR = 0.8

_MULT = np.uint64(0x9E3779B97F4A7C15)
_FINAL = np.uint64(0xBF58476D1CE4E5B9)


def word_array(text: Column) -> Column:
    """Words of a text as an array (null text: none)."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def shingle_hashes(text: str | None, k: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles of a whole text.

    A text of fewer than k words has one shingle of all its words; a text
    without words has none.
    """
    words = (text or "").encode("utf-8", "replace").split()
    if not words:
        return np.empty(0, np.uint64)
    h = word_hashes(words)
    k = min(k, len(h))
    n = len(h) - k + 1
    acc = np.full(n, k, np.uint64)
    for j in range(k):
        acc = (acc + h[j:j + n]) * _MULT
        acc ^= acc >> np.uint64(29)
    acc *= _FINAL
    acc ^= acc >> np.uint64(32)
    return np.unique(acc)


def ordered_totals(df: DataFrame, order: list[str], sums: dict[str, str], name: str) -> DataFrame:
    """For each ``value: out`` of ``sums`` add ``out``: the sum of ``value`` over all rows before this one by ``order``.

    ``order`` must be unique over the rows.  The rows are range-partitioned and
    written once; each partition sums its own rows, and the partitions' totals
    (one row per partition) give the offsets.
    """
    parts = written(df.repartitionByRange(*[F.col(c) for c in order])
                    .withColumn("__part", F.spark_partition_id()), name)
    totals = parts.groupBy("__part").agg(*[F.sum(v).alias(f"__total_{v}") for v in sums])
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition, so a single task and a broadcast are bounded by the partition count
    offsets = totals.select("__part", *[F.coalesce(F.sum(f"__total_{v}").over(before), F.lit(0)).alias(f"__base_{v}") for v in sums])
    inside = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = parts.withColumns({f"__local_{v}": F.coalesce(F.sum(v).over(inside), F.lit(0)) for v in sums})
    return (local.join(F.broadcast(offsets), "__part")
            .withColumns({out: F.col(f"__base_{v}") + F.col(f"__local_{v}") for v, out in sums.items()})
            .drop("__part", *[f"__{k}_{v}" for v in sums for k in ("base", "local")]))


def components(edges: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """Connected components of an edge list: (node, root), root the least node.

    Each round every node takes the least root among its own and its
    neighbours', hooks its old root to it, and follows pointers twice; rounds
    end when no root changes (logarithmic in the longest path).  Each round is
    written to the shared folder.
    """
    e = written(edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
                .unionByName(edges.select(F.col(b).alias("u"), F.col(a).alias("v"))).distinct(), f"{name}-edges")
    state = written(e.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("root"))
                    .select(F.col("u").alias("node"), "root"), f"{name}-0")
    rnd = 0
    while True:
        rnd += 1
        near = (e.join(state.select(F.col("node").alias("v"), F.col("root").alias("r")), "v")
                .groupBy("u").agg(F.min("r").alias("r")))
        stepped = (state.join(near, state.node == near.u, "left")
                   .select("node", "root", F.least("root", F.coalesce("r", "root")).alias("low")))
        # hook: the old root learns the least root any of its nodes has seen
        hooks = stepped.groupBy("root").agg(F.min("low").alias("hook"))
        hooked = written(stepped.join(hooks, "root").select("node", F.least("low", "hook").alias("next"),
                                                            F.col("root").alias("was")), f"{name}-h{rnd}")
        jump = hooked.select(F.col("node").alias("next"), F.col("next").alias("far"))
        state = written(hooked.join(jump, "next", "left")
                        .select("node", F.least("next", F.coalesce("far", "next")).alias("root"),
                                "was"), f"{name}-{rnd}")
        if state.filter(F.col("root") != F.col("was")).isEmpty():
            return state.select("node", "root")
        state = state.select("node", "root")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")
