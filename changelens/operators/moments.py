"""Statistics that merge: counts, moments and co-moments per batch, so a new batch updates a summary without the old rows."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PART = "batch"


def moments(df: DataFrame, cols: list[str], by: list[str] | None = None) -> DataFrame:
    """(by..., a, b, n, mean_a, mean_b, m2_a, m2_b, c_ab, low, high): one row for every column (a = b) and every pair of columns (a < b in the
    given order), over the rows in which both are numbers; ``m2`` are sums of squared deviations, ``c_ab`` of products, ``low`` and ``high`` the range of a.

    One pass over the rows; nulls and NaN don't count.
    """
    by = by or []
    aggs, names = [], []
    for i, (a, b) in enumerate([(c, c) for c in cols] + list(combinations(cols, 2))):
        x, y = F.col(a).cast("double"), F.col(b).cast("double")
        both = x.isNotNull() & y.isNotNull() & ~F.isnan(x) & ~F.isnan(y)
        x, y = F.when(both, x), F.when(both, y)
        n = F.count(x)
        aggs.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), n.alias("n"), F.avg(x).alias("mean_a"), F.avg(y).alias("mean_b"),
                             (F.var_pop(x) * n).alias("m2_a"), (F.var_pop(y) * n).alias("m2_b"), (F.covar_pop(x, y) * n).alias("c_ab"),
                             F.min(x).alias("low"), F.max(x).alias("high")).alias(f"__{i}"))
        names.append(f"__{i}")
    return df.groupBy(*by).agg(*aggs).select(*by, F.inline(F.array(*names)))


def merged(parts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rows of ``moments`` over several batches put together: the rows that ``moments`` has over all their rows."""
    key = [*(by or []), "a", "b"]
    full = parts.where("n > 0")
    mean = full.groupBy(*key).agg(F.sum("n").alias("__n"), *[(F.sum(F.col("n") * F.col(f"mean_{s}")) / F.sum("n")).alias(f"__{s}") for s in "ab"])
    same = [F.col(f"p.{k}").eqNullSafe(F.col(f"m.{k}")) for k in key]
    da, db, n = F.col("mean_a") - F.col("__a"), F.col("mean_b") - F.col("__b"), F.col("n")
    out = full.alias("p").join(mean.alias("m"), same).groupBy(*[F.col(f"p.{k}").alias(k) for k in key]).agg(
        F.sum(n).alias("n"), F.first("__a").alias("mean_a"), F.first("__b").alias("mean_b"), F.sum(F.col("m2_a") + n * da * da).alias("m2_a"),
        F.sum(F.col("m2_b") + n * db * db).alias("m2_b"), F.sum(F.col("c_ab") + n * da * db).alias("c_ab"), F.min("low").alias("low"), F.max("high").alias("high"))
    none = parts.groupBy(*key).agg(F.sum("n").alias("n")).where("n = 0")
    return out.unionByName(none, allowMissingColumns=True)


def summary(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """A11 from moments: (by..., name, n, mean, std, low, high), the sample standard deviation null under two values."""
    return rows.where("a = b").select(*(by or []), F.col("a").alias("name"), "n", F.col("mean_a").alias("mean"),
                                      F.when(F.col("n") > 1, F.sqrt(F.col("m2_a") / (F.col("n") - 1))).alias("std"), "low", "high")


def correlations(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """A9 from moments: (by..., a, b, n, corr) of every pair, null where a column doesn't vary."""
    return rows.where("a <> b").select(*(by or []), "a", "b", "n", F.try_divide(F.col("c_ab"), F.sqrt(F.col("m2_a") * F.col("m2_b"))).alias("corr"))


def record_batch(df: DataFrame, path: str, batch: str, cols: list[str], by: list[str] | None = None) -> None:
    """Write the moments of one batch under ``path``; a batch recorded again replaces its own, so a rerun counts nothing twice."""
    moments(df, cols, by).coalesce(1).write.mode("overwrite").parquet(f"{path}/{PART}={batch}")


def recorded(spark: SparkSession, path: str, by: list[str] | None = None) -> DataFrame:
    """The merged moments of all batches under ``path``; reads a few rows a batch and none of the batches' own."""
    return merged(spark.read.parquet(path).drop(PART), by)
