"""Descriptive statistics, frequency tables and reshapes (all single-pass aggregates)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def row_count(df: DataFrame, out: str = "n_rows") -> DataFrame:
    """A1."""
    return df.agg(F.count(F.lit(1)).alias(out))


def distinct_count(df: DataFrame, cols: list[str], approx: bool = False) -> DataFrame:
    """A2: distinct non-null values per column (exact by default)."""
    fn = (lambda c: F.approx_count_distinct(c)) if approx else (lambda c: F.count_distinct(c))
    return df.agg(*[fn(c).alias(f"distinct_{c}") for c in cols])


def avg_group_size(df: DataFrame, key: str, out: str = "avg_group_size") -> DataFrame:
    """A3: mean rows per key (null keys excluded); two-level aggregate, partial on both levels."""
    per = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return per.agg(F.avg("_n").alias(out))


def value_counts(df: DataFrame, col: str | Column, name: str = "value", out: str = "count") -> DataFrame:
    """Frequency table, nulls dropped, ordered by count desc then value."""
    c = F.col(col) if isinstance(col, str) else col
    return (df.select(c.alias(name)).where(F.col(name).isNotNull())
              .groupBy(name).agg(F.count(F.lit(1)).alias(out))
              .orderBy(F.desc(out), F.asc(name)))


def status_by_category(df: DataFrame, status: str = "discrepancy", category: str = "file_type",
                       keep=("Yes", "No"), out: str = "n") -> DataFrame:
    """A13 (+P30): one grouped count over (status, category), rows of the kept statuses."""
    return (df.where(F.col(status).isin(list(keep)))
              .groupBy(status, category).agg(F.count(F.lit(1)).alias(out)))


def exact_median(df: DataFrame, group_cols: list[str], value: str, out: str = "median",
                 num_partitions: int | None = None) -> DataFrame:
    """Exact, interpolated median per group without holding any group in one task.

    Equal values are counted first (partial before the shuffle), so a hot value
    is one row per map task.  The distinct (group, value) rows are
    range-partitioned, sorted and checkpointed; they are unique, so a range can
    always be split.  Running counts inside a partition plus the counts of the
    partitions before it (one row per partition and group) give each value its
    span of ranks; the one or two middle ranks are averaged.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    g = list(group_cols)
    vals = df.select(*g, F.col(value).cast("double").alias("__v")).where(F.col("__v").isNotNull())
    counts = vals.groupBy(*g, "__v").agg(F.count(F.lit(1)).alias("__c"))
    runs = counts.repartitionByRange(n, *g, "__v").withColumn("__pid", F.spark_partition_id()).checkpoint(eager=True)
    parts = runs.groupBy("__pid", *g).agg(F.sum("__c").alias("__cnt"))
    w = Window.partitionBy(*g).orderBy("__pid")
    same = reduce(lambda a, b: a & b, [F.col(f"__g{i}").eqNullSafe(F.col(c)) for i, c in enumerate(g)], F.col("__p") == F.col("__pid"))
    parts = parts.select(F.col("__pid").alias("__p"), *[F.col(c).alias(f"__g{i}") for i, c in enumerate(g)],
                         (F.sum("__cnt").over(w) - F.col("__cnt")).alias("__off"), F.sum("__cnt").over(Window.partitionBy(*g)).alias("__n"))
    inside = Window.partitionBy("__pid", *g).orderBy("__v")
    spans = (runs.withColumn("__end", F.sum("__c").over(inside)).join(parts, same)
             .withColumn("__end", F.col("__off") + F.col("__end")))
    lo, hi = F.floor((F.col("__n") - 1) / 2), F.ceil((F.col("__n") - 1) / 2)

    def at(rank):  # the value whose span of ranks holds this one
        return F.max(F.when((F.col("__end") - F.col("__c") <= rank) & (rank < F.col("__end")), F.col("__v")))

    return spans.groupBy(*g).agg(((at(lo) + at(hi)) / 2).alias(out))


def summary(df: DataFrame, metrics: list[str], round_to: int | None = 6) -> DataFrame:
    """A11 (A5-A8 at once): unpivot to (metric, value), then one grouped aggregate and the exact median."""
    long = df.unpivot([], [F.col(m).cast("double").alias(m) for m in metrics], "metric", "value")
    r = (lambda c: F.round(c, round_to)) if round_to is not None else (lambda c: c)
    res = long.groupBy("metric").agg(
        F.count("value").alias("n"), r(F.avg("value")).alias("mean"), r(F.stddev_samp("value")).alias("std"),
        r(F.min("value")).alias("min"), r(F.max("value")).alias("max"), r(F.max("value") - F.min("value")).alias("range"))
    med = exact_median(long, ["metric"], "value")
    return res.join(med.select("metric", r(F.col("median")).alias("median")), "metric", "left").select(
        "metric", "n", "mean", "median", "std", "min", "max", "range")


def corr_matrix(df: DataFrame, cols: list[str], round_to: int = 6) -> DataFrame:
    """Pearson correlation of every two columns over the rows where both are present, in long form (col_a, col_b, r).

    Null where it isn't defined: a constant column (its diagonal too) or fewer
    than two rows.  One aggregate computes each pair once.
    """
    at = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]

    def r(a, b):
        x, y = (F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.col(c).cast("double")) for c in (a, b))
        spread = F.stddev_samp(x) * F.stddev_samp(y)
        return F.round(F.try_divide(F.covar_samp(x, y), F.nullif(spread, F.lit(0.0))), round_to)

    wide = df.agg(*[r(cols[i], cols[j]).alias(f"r{i}_{j}") for i, j in at])
    cells = [F.struct(F.lit(cols[i]).alias("col_a"), F.lit(cols[j]).alias("col_b"), F.col(f"r{min(i, j)}_{max(i, j)}").alias("r"))
             for i in range(len(cols)) for j in range(len(cols))]
    return wide.select(F.inline(F.array(*cells)))


def max_length(df: DataFrame, cols: list[str]) -> DataFrame:
    """A10: longest cell (characters) per column."""
    return df.agg(*[F.max(F.length(c)).alias(f"max_len_{c}") for c in cols])


def score_matrix(df: DataFrame, row: str, col: str, value: str, col_values: list) -> DataFrame:
    """Row x col table; the pivot values are given, so the plan is a single pass."""
    return df.groupBy(row).pivot(col, col_values).agg(F.first(value))


def transpose(wide: DataFrame, row: str, new_row: str, row_values: list) -> DataFrame:
    """R2: swap axes of a pivoted table (unpivot, then pivot); ``row_values``: the values of ``row``, which become columns."""
    cols = [c for c in wide.columns if c != row]
    long = wide.unpivot([row], cols, new_row, "_v")
    return long.groupBy(new_row).pivot(row, row_values).agg(F.first("_v"))


def melt(df: DataFrame, ids: list[str], values: list[str], var: str = "metric", val: str = "value") -> DataFrame:
    """Wide -> long."""
    return df.unpivot(ids, values, var, val)
