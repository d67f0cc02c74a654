"""Vectors of texts kept from run to run: a table keyed by text digest, of which only what is missing is embedded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import text_digest, whitespace_tokens
from ..functions.vectors import cosine
from ..sources import buckets as B
from ..staging import join_per_key, written

KEY = ["digest"]


def extend_store(df: DataFrame, cols: list[str], path: str, embed, n_buckets: int = 64) -> int:
    """M2: embed the distinct texts of ``cols`` that the store at ``path`` lacks; returns how many there were.

    ``embed(df, text_col, out_col)`` is any embedding transform.  A null text counts
    as empty.  Which texts are missing is told by the buckets' summaries and the digests of the buckets that may hold them, so a run
    over old texts embeds none and reads no vector.
    """
    sides = F.array(*[F.struct(text_digest(c).alias("digest"), F.coalesce(F.col(c), F.lit("")).alias("text")) for c in cols])
    texts = df.select(F.inline(sides)).dropDuplicates(KEY)
    pending, keyed, _ = B.pending_rows(texts, path, KEY, n_buckets)
    vectors = written(embed(pending, "text", "vec").select("bucket", "digest", "vec"), "vectors-new")
    B.write_pending(vectors, keyed, path, KEY, n_buckets)
    return vectors.count()


def stored_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(digest, vec) of all texts in the store."""
    return B.read_buckets(spark, path)


def scores_from_store(df: DataFrame, key: list[str], pairs: dict[str, tuple[str, str]], path: str) -> DataFrame:
    """M4/M5: (key, one cosine per pair) of every row, ``pairs`` naming two text columns each, by one join to the store.

    The rows become one long table (row, column, digest); it meets the vectors once, and one aggregate per row gathers its
    columns.  A text that many rows share goes by a broadcast.  A text that isn't in the store scores 0, as a zero vector.
    """
    cols = sorted({c for p in pairs.values() for c in p})
    rows = written(df.select(*key, *[text_digest(c).alias(f"__id_{c}") for c in cols]).withColumn("__row", F.monotonically_increasing_id()), "scored-rows")
    long = rows.select("__row", F.inline(F.array(*[F.struct(F.lit(c).alias("col"), F.col(f"__id_{c}").alias("digest")) for c in cols])))
    counted = long.groupBy("digest").agg(F.count(F.lit(1)).alias("__n"))
    found = join_per_key(long, counted.join(stored_vectors(df.sparkSession, path), "digest", "left"), "digest", "__n")
    wide = found.groupBy("__row").agg(*[F.first(F.when(F.col("col") == c, F.col("vec")), ignorenulls=True).alias(f"__v_{c}") for c in cols])
    scored = wide.select("__row", *[cosine(f"__v_{a}", f"__v_{b}").alias(out) for out, (a, b) in pairs.items()])
    return rows.select("__row", *key).join(scored, "__row").drop("__row")


def sparse_bag(text_col: str, dim: int = 64):
    """Bag of whitespace tokens as a sorted array of (bucket, count), the md5 buckets of the dense stand-in embedder, read in one pass.

    The sorted buckets are folded once: an entry is opened at each new bucket and counted up while it lasts.
    """
    at = F.array_sort(F.transform(whitespace_tokens(F.coalesce(F.col(text_col), F.lit(""))), lambda tk: (F.conv(F.substring(F.md5(tk), 1, 8), 16, 10).cast("bigint") % dim).cast("int")))
    kind = "struct<done:array<struct<bucket:int,n:int>>,bucket:int,n:int>"
    start = F.struct(F.array().cast("array<struct<bucket:int,n:int>>").alias("done"), F.lit(None).cast("int").alias("bucket"), F.lit(0).alias("n")).cast(kind)

    def closed(s):
        return F.when(s["bucket"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(F.struct(s["bucket"].alias("bucket"), s["n"].alias("n")))))

    def step(s, b):
        same = s["bucket"].eqNullSafe(b)
        return F.struct(F.when(same, s["done"]).otherwise(closed(s)).alias("done"), b.alias("bucket"), F.when(same, s["n"] + 1).otherwise(1).alias("n")).cast(kind)

    return F.aggregate(at, start, step, closed)
