"""Early stop, pruned resume and stateful ingest."""

import datetime as dt
import os
import re
import tempfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changelens.operators import rows as R
from changelens.sources import buckets as B
from changelens.streaming.stateful import stateful_ingest


def counting(fails, seen):
    """A measure that fails where ``fails`` holds, and notes how many rows it was given."""
    def measure(df):
        seen.append(df.count())
        return df.withColumns({"m": F.col("v") * 2, "error": F.when(F.expr(fails), "bad")})
    return measure


@pytest.mark.parametrize("fails, n", [("false", 10), ("k % 3 = 0", 10), ("k < 500", 7), ("true", 5), ("k % 2 = 0", 5000), ("false", 0)])
def test_only_as_many_rows_are_measured_as_needed(spark, fails, n):
    df = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") * 7).alias("v"))
    seen = []
    got = {r.k: r for r in R.first_n_measured(df, counting(fails, seen), n, ["k"], metric_cols=["m"]).collect()}
    good = [r.k for r in df.where(f"NOT ({fails})").orderBy("k").limit(n).collect()]
    assert len(got) == 1000 and sorted(k for k, r in got.items() if r.processed) == good
    assert all(r.m == (2 * r.v if r.processed else None) for r in got.values())
    needed = good[-1] + 1 if len(good) == n and n else 1000
    assert sum(seen) <= max(2 * n, 6 * needed)


def test_early_stop_with_ties_nulls_and_two_columns(spark):
    rows = [(None if i % 10 == 0 else i % 4, None if i % 7 == 0 else i % 3, i) for i in range(120)]
    df = spark.createDataFrame(rows, "a int, b int, v int")
    seen = []
    out = R.first_n_measured(df.withColumn("i", F.col("v")), counting("v % 2 = 0", seen), 9, ["a", "b", "i"], metric_cols=["m"])
    key = lambda r: tuple((x is not None, x) for x in (r[0], r[1], r[2]))
    want = [r[2] for r in sorted(rows, key=key) if r[2] % 2][:9]
    assert sorted(r.v for r in out.where("processed").collect()) == sorted(want) and sum(seen) < 120


def test_the_bounds_of_a_batch_reach_the_scan(spark):
    path = os.path.join(tempfile.mkdtemp(dir="/tmp"), "t")
    spark.range(1000).withColumnRenamed("id", "k").write.parquet(path)
    plans = []

    def measure(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df.withColumns({"m": F.lit(1), "error": F.when(F.col("k") < 50, "bad")})

    R.first_n_measured(spark.read.parquet(path), measure, 3, ["k"], metric_cols=["m"])
    assert len(plans) == 3 and all("LessThanOrEqual(k," in p for p in plans) and "GreaterThan(k," in plans[1]


def test_rerun_reads_only_the_buckets_its_keys_may_be_in(spark):
    out = os.path.join(tempfile.mkdtemp(dir="/tmp"), "out")
    df = spark.range(2000).select((F.col("id") % 1000).alias("k"), F.col("id").alias("v"))
    assert B.pruned_append(df.where("k < 400"), out, ["k"], 8) == []
    bucket = df.withColumn("b", B.batch_id(["k"], 8).cast("int"))
    one = bucket.where("b = 3").drop("b")
    assert B.pruned_append(one, out, ["k"], 8) == [3]
    files = B.done_keys(spark, out, ["k"], [3])
    plan = files._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ = 3", plan) and "ReadSchema: struct<k:bigint>" in plan
    assert {re.search(r"bucket=(\d+)", r.f)[1] for r in files.select(F.input_file_name().alias("f")).distinct().collect()} == {"3"}
    new = spark.range(5000, 5100).select(F.col("id").alias("k"), F.col("id").alias("v"))
    assert len(B.pruned_append(new, out, ["k"], 8)) <= 1  # a false positive at most
    assert len(B.pruned_append(df.unionByName(new), out, ["k"], 8)) == 8
    assert sorted(tuple(r) for r in B.read_buckets(spark, out).collect()) == sorted(tuple(r) for r in df.unionByName(new).collect())


def test_compaction_keeps_the_rows_and_reads_few_buckets(spark):
    out = os.path.join(tempfile.mkdtemp(dir="/tmp"), "out")
    for i in range(4):
        B.pruned_append(spark.range(100 * i, 100 * i + 100).withColumnRenamed("id", "k").where(f"k % 2 = 0 OR {i} = 0"), out, ["k"], 4)
    before = sorted(r.k for r in B.read_buckets(spark, out).collect())
    assert B.compact_buckets(spark, out, 3) == [0, 1, 2, 3] and B.compact_buckets(spark, out, 3) == []
    assert sorted(r.k for r in B.read_buckets(spark, out).collect()) == before
    assert B.pruned_append(spark.createDataFrame([(0,), (2,), (None,)], "k long"), out, ["k"], 4)
    assert B.read_buckets(spark, out).count() == len(before) + 1 and spark.read.parquet(f"{out}/seen").where("bucket >= 0").count() <= 4 + 3


SCHEMA = T.StructType([T.StructField("k", T.LongType()), T.StructField("ts", T.TimestampType()), T.StructField("v", T.StringType())])


def test_repeated_late_and_replayed_rows(spark):
    base = tempfile.mkdtemp(dir="/tmp")
    source, out, late, ck = (os.path.join(base, x) for x in ("in", "out", "late", "ck"))
    day = lambda d, h=0: dt.datetime(2024, 1, d, h)

    def land(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)

    def run():
        stateful_ingest(spark, source, SCHEMA, out, late, ck, ["k"], "ts", "2 days")
        return sorted(r.k for r in spark.read.parquet(out).collect()), sorted(r.v for r in spark.read.parquet(late).collect())

    with pytest.raises(Exception):
        run()
    land([(1, day(1), "a"), (1, day(1, 5), "repeat"), (2, day(3), "b"), (9, None, "no time")])
    assert run() == ([1, 2], ["no time"])
    land([(2, day(3, 1), "repeat"), (3, day(2), "in time"), (4, day(20), "ahead")])
    assert run() == ([1, 2, 3, 4], ["no time"])
    assert run() == ([1, 2, 3, 4], ["no time"])
    land([(1, day(1), "replayed"), (5, day(17), "late"), (4, day(20), "repeat"), (6, day(18, 1), "in time"), (2, day(21), "key again, later")])
    assert run() == ([1, 2, 2, 3, 4, 6], ["late", "no time", "replayed"])
