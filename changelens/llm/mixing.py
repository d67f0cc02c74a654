"""Mixing sources to target weights by capped water-filling, with seeded whole and fractional repetitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import BLANKS, WORD, ordered_totals, written

SEED = "mix"
SHARE = 1.5
MOST_EPOCHS = 2.0


def size_of(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, share: float = SHARE, most: float = MOST_EPOCHS, weights: DataFrame | None = None) -> DataFrame:
    """(src, source_size, weight, target) per source, from (src, size) rows.

    Budget: ``share`` times all sizes.  Every free source gets its weight's part
    of what is left; those above ``most`` times their own size are clamped there
    and the excess is dealt anew by weight, until none is above.  Each round is
    one grouped sum over the table of sources and clamps at least one of them.
    ``weights``: (src, weight), one row per source (a source without one weighs 0), else 3, 1, 2, repeating over the sources by code
    point, null last.  Sources of size 0 get target 0.
    """
    per = sizes.groupBy("src").agg(F.sum("size").alias("source_size"))
    if weights is None:
        per = per.withColumn("__null", F.col("src").isNull().cast("int")).withColumn("__name", F.coalesce("src", F.lit("")))
        per = ordered_totals(per.withColumn("__one", F.lit(1)), ["__null", "__name"], {"__one": "__rank"}, "mix-sources")
        nth = F.pmod(F.col("__rank"), F.lit(3))
        per = per.withColumn("weight", F.when(nth == 0, 3.0).when(nth == 1, 1.0).otherwise(2.0)).drop("__one", "__rank", "__null", "__name")
    else:
        given = weights.select(F.col("src").alias("__s"), F.col("weight").cast("double").alias("__w"))
        per = (per.join(given, F.col("src").eqNullSafe(F.col("__s")), "left")
               .withColumn("weight", F.coalesce("__w", F.lit(0.0))).drop("__s", "__w"))
    per = written(per.withColumn("limit", F.col("source_size") * F.lit(float(most))), "mix-weights")
    budget = share * (per.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0  # words per unit of weight; a source is clamped once level * weight passes its limit
    clamped = F.lit(False)
    while True:
        row = per.agg(F.sum(F.when(clamped, F.col("limit"))).alias("full"), F.sum(F.when(~clamped, F.col("weight"))).alias("free"),
                      F.count_if(clamped).alias("n")).first()
        if not row.free:
            break
        level = max(0.0, budget - (row.full or 0.0)) / row.free
        above = clamped | (F.lit(level) * F.col("weight") >= F.col("limit"))
        if per.agg(F.count_if(above).alias("n")).first().n == row.n:
            break
        clamped = above
    target = F.least(F.col("limit"), F.lit(level) * F.col("weight"))
    return per.select("src", "source_size", "weight", F.when(clamped, F.col("limit")).otherwise(target).alias("target"))


def plan_mix(docs: DataFrame, seed: str = SEED, share: float = SHARE, most: float = MOST_EPOCHS,
             weights: DataFrame | None = None) -> DataFrame:
    """(__d, __h, doc_id, src, size, source_size, target, taken), one row for every row of ``docs``.

    A document is taken whole as often as its source's target holds the source
    in full.  The rest, a fraction of an epoch, goes to documents in the seeded
    order of their hashes until it is used up; at most one document per source
    is taken in part (its leading words).  The order depends on the seed, doc_id
    and text alone, so reruns agree; rows equal in both are copies that follow
    each other in any order.  Null source: a source of its own; null or empty
    text: size 0, taken 0.
    """
    text = F.coalesce("text", F.lit(""))
    rows = written(docs.select("doc_id", F.col("source").alias("src"), size_of(F.col("text")).alias("size"),
                               F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2 ** 63))).alias("__d"), F.xxhash64(text).alias("__h")),
                   "mix-sizes")
    rows = rows.withColumn("__draw", F.md5(F.concat(F.lit(f"{seed}:"), F.col("__d").cast("string"))))
    same = ["__d", "__h", "src"]
    rows = written(rows.join(source_targets(rows.select("src", "size"), share, most, weights)
                             .withColumnRenamed("src", "__s"), F.col("src").eqNullSafe(F.col("__s"))).drop("__s", "weight"), "mix-targets")
    # one entry per distinct (doc_id, text, source); its copies follow each other
    entry = (rows.groupBy(*same, "__draw", "doc_id", "size", "source_size", "target").agg(F.count("*").alias("copies"))
             .withColumn("__words", F.col("size") * F.col("copies")).withColumn("__null", F.col("src").isNull().cast("int"))
             .withColumn("__name", F.coalesce("src", F.lit(""))))
    entry = ordered_totals(entry, ["__null", "__name", "__draw", "__d", "__h"], {"__words": "__all"}, "mix-order")
    first = entry.groupBy("__null", "__name").agg(F.min("__all").alias("__from"))
    entry = entry.join(first, ["__null", "__name"]).withColumn("__before", F.col("__all") - F.col("__from"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    part = F.round(F.col("target") - whole * F.col("source_size")).cast("long")
    entry = entry.withColumn("__copy", F.explode(F.expr("sequence(1L, copies)")))
    extra = F.least(F.col("size"), F.greatest(F.lit(0), part - F.col("__before") - (F.col("__copy") - 1) * F.col("size")))
    return entry.select("doc_id", "__d", "__h", "src", "size", "source_size", "target", F.col("__copy").alias("copy"),
                        (whole * F.col("size") + extra).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row for every whole repetition, and one cut to its leading
    words where a document is taken in part.  Documents without words are in no repetition."""
    plan = plan_mix(docs, **how).filter("taken > 0")
    plan = plan.select("__d", "__h", F.col("src").alias("__s"), F.explode(
        F.expr("transform(sequence(1L, ceil(taken / size)), k -> least(size, taken - (k - 1) * size))")).alias("__take"), F.col("size").alias("__size"))
    row = docs.select(F.struct("*").alias("__row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2 ** 63))).alias("__d"),
                      F.xxhash64(F.coalesce("text", F.lit(""))).alias("__h"), F.col("source").alias("__src")).dropDuplicates(["__d", "__h", "__src"])
    row = row.join(plan.withColumnRenamed("__d", "__pd").withColumnRenamed("__h", "__ph"),
                   (F.col("__d") == F.col("__pd")) & (F.col("__h") == F.col("__ph")) & F.col("__src").eqNullSafe(F.col("__s")))
    pieces = F.regexp_extract_all("__row.text", F.lit(BLANKS.replace("+", "*") + WORD), 0)  # each word with the blanks before it
    lead = F.array_join(F.slice(pieces, 1, F.col("__take").cast("int")), "")
    text = F.when(F.col("__take") == F.col("__size"), F.col("__row.text")).otherwise(lead)
    return row.select(*[text.alias(c) if c == "text" else F.col(f"__row.`{c}`") for c in docs.columns])
