"""Resumable output laid out by key bucket, with a Bloom summary per bucket.

A run asks the summaries which of its keys may have been written; only the
buckets of those are read, and only their key columns.  The layout under the
output path: ``rows/bucket=K/`` the rows, ``seen/`` the summaries, one row per
bucket and run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .resume import batch_id, committed

HASHES = 4


def _positions(keys: list[str], bits: int) -> Column:
    """Places of a row's key in a summary of ``bits`` bits."""
    return F.array(*[F.pmod(F.xxhash64(F.lit(i), *[F.col(k) for k in keys]), F.lit(bits)) for i in range(HASHES)])


def _summaries(keyed: DataFrame, keys: list[str], bits: int) -> DataFrame:
    """(bucket, words): the bits of all keys of each bucket, 64 a word."""
    at = keyed.select("bucket", F.explode(_positions(keys, bits)).alias("at"))
    mask = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 64).cast("int")))
    set_ = at.groupBy("bucket", F.floor(F.col("at") / 64).cast("int").alias("no")).agg(mask.alias("word"))
    blank = keyed.select("bucket").distinct().select("bucket", F.explode(F.sequence(F.lit(0), F.lit(bits // 64 - 1))).alias("no"), F.lit(0).cast("long").alias("word"))
    return _by_bucket(set_.unionByName(blank))


def _by_bucket(words: DataFrame) -> DataFrame:
    """(bucket, words) from (bucket, no, word) with every number there at least once."""
    one = words.groupBy("bucket", "no").agg(F.bit_or("word").alias("word"))
    return one.groupBy("bucket").agg(F.array_sort(F.collect_list(F.struct("no", "word")))["word"].alias("words"))


def seen_before(spark: SparkSession, path: str) -> DataFrame | None:
    """(bucket, words) over all runs; None if nothing was written yet."""
    seen = committed(spark, f"{path}/seen", ["bucket", "words"], "parquet")
    return None if seen is None else _by_bucket(seen.select("bucket", F.posexplode("words").alias("no", "word")))


def done_keys(spark: SparkSession, path: str, keys: list[str], buckets: list[int]) -> DataFrame | None:
    """(bucket, keys...) of the rows written to ``buckets``; no other bucket is read."""
    done = committed(spark, f"{path}/rows", ["bucket", *keys], "parquet") if buckets else None
    return None if done is None else done.where(F.col("bucket").isin(buckets))


def pending_rows(new: DataFrame, path: str, keys: list[str], n_buckets: int = 64, bits: int = 1 << 16) -> tuple[DataFrame, DataFrame, list[int]]:
    """(pending, all, read): the rows of ``new`` whose keys aren't in the output, all rows, both with their ``bucket`` and staged, and the
    buckets that were looked into."""
    spark = new.sparkSession
    staged = scratch_path(spark, "pruned-new")
    keyed = new.withColumn("bucket", batch_id(keys, n_buckets).cast("int"))
    seen = seen_before(spark, path)
    if seen is None:
        keyed = keyed.withColumn("__maybe", F.lit(False))
    else:
        word = lambda p: F.get("words", F.floor(p / 64).cast("int"))
        hit = F.forall(_positions(keys, bits), lambda p: word(p).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), (p % 64).cast("int"))) != 0)
        keyed = (keyed.join(F.broadcast(seen), "bucket", "left")
                 .withColumn("__maybe", F.coalesce(F.col("words").isNotNull() & hit, F.lit(False))).drop("words"))
    keyed.write.parquet(staged)
    keyed = spark.read.schema(keyed.schema).parquet(staged)
    touched = sorted(r.bucket for r in keyed.where("__maybe").select("bucket").distinct().collect())
    done = done_keys(spark, path, keys, touched)
    maybe = keyed.where("__maybe")
    pending = keyed.where("NOT __maybe").unionByName(maybe if done is None else maybe.join(done, ["bucket", *keys], "left_anti"))
    return pending.drop("__maybe"), keyed.drop("__maybe"), touched


def write_pending(pending: DataFrame, keyed: DataFrame, path: str, keys: list[str], n_buckets: int = 64, bits: int = 1 << 16) -> None:
    """Add ``pending`` to the output; the summaries, of the keys in ``keyed``, are written first, so that they never lack a written key."""
    _summaries(keyed.select("bucket", *keys), keys, bits).coalesce(1).write.mode("append").parquet(f"{path}/seen")
    pending.repartition(n_buckets, "bucket").write.mode("append").partitionBy("bucket").parquet(f"{path}/rows")


def pruned_append(new: DataFrame, path: str, keys: list[str], n_buckets: int = 64, bits: int = 1 << 16) -> list[int]:
    """Append the rows whose keys aren't in the output at ``path``; returns the buckets that were read for it.

    ``bits`` a bucket (a multiple of 64) keep false positives rare up to about bits / 10 keys; beyond that more buckets are read than need be,
    never fewer.  The summaries, ``n_buckets * bits / 8`` bytes, are broadcast.  A run that
    fails between summaries and rows leaves keys that may seem written, and the next run
    looks them up.  ``n_buckets``, ``bits`` and ``keys`` must stay the same from run to run.  Null keys are never found,
    as in a join.
    """
    pending, keyed, touched = pending_rows(new, path, keys, n_buckets, bits)
    write_pending(pending, keyed, path, keys, n_buckets, bits)
    return touched


def read_buckets(spark: SparkSession, path: str) -> DataFrame:
    """All rows of an output of ``pruned_append``."""
    return spark.read.parquet(f"{path}/rows").drop("bucket")


def compact_buckets(spark: SparkSession, path: str, most_files: int = 8) -> list[int]:
    """Rewrite the buckets of more than ``most_files`` files as one file each, and the summaries as one row a bucket; other
    buckets are not read.  Returns the buckets.

    The rows are staged first, so a failure while a bucket is replaced loses none: the staged copy stays under the checkpoint folder.
    """
    rows = spark.read.parquet(f"{path}/rows")
    files = rows.select("bucket", F.col("_metadata.file_path").alias("f")).distinct().groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    many = sorted(r.bucket for r in files.where(F.col("n") > most_files).collect())
    if many:
        staged = scratch_path(spark, "compact")
        rows.where(F.col("bucket").isin(many)).write.parquet(staged)
        again = spark.read.schema(rows.schema).parquet(staged).repartition(len(many), "bucket")
        again.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{path}/rows")
        merged = scratch_path(spark, "compact-seen")
        seen_before(spark, path).write.parquet(merged)
        spark.read.parquet(merged).coalesce(1).write.mode("overwrite").parquet(f"{path}/seen")
    return many
