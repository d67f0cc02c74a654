"""Repeated line runs over a whole corpus, by a suffix array of line IDs (prefix doubling), and their deletion.

Lines are the ``\\n``-split pieces of a text.  Suffixes (document, line) are ranked by
their first 1, 2, 4, ... lines; a rank is the number of suffixes that sort
before, so each table of ranks is the suffix array up to that depth.  Suffixes
whose block occurs once leave, as no repeated run starts with them.  Two
suffixes lie in one LCP interval of depth n iff they agree on n lines, which two
overlapping ranked blocks decide.  Every run of at least ``min_words`` words is a
union of windows that are minimal from their start or from their end, so the
intervals at those depths reveal all maximal repeated runs.

Result: a line goes iff it lies in a run of lines with at least ``min_words``
words in all that also starts earlier (by doc_id, then line).  The first copy
of every run stays.  Runs may overlap themselves.  Rows equal in doc_id and text
are one document and get the same answer; a null doc_id sorts first.  Null text
stays null, an empty text has one line without words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import join_per_key, ordered_totals, word_array, written

MIN_WORDS = 50
KEY = ["__d", "__h"]


def _key(doc_id: str, text: str) -> list:
    return [F.coalesce(F.col(doc_id).cast("long"), F.lit(-(2 ** 63))).alias("__d"),
            F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("__h")]


def line_table(docs: DataFrame) -> DataFrame:
    """(__d, __h, pos, id, nw): one row per line; id is a 128-bit digest of the line."""
    lines = docs.select(*_key("doc_id", "text"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.select(*KEY, "pos", F.unhex(F.md5("line")).alias("id"), F.size(word_array(F.col("line"))).alias("nw"))


def rank_levels(repeated: DataFrame, deepest: int) -> DataFrame:
    """(__d, __h, pos, r, q): ranks by the first 2^q lines, of suffixes whose block of 2^q lines repeats.

    ``repeated`` holds the level q = 0.  Doubling ends when no block repeats or
    2^q passes ``deepest``.
    """
    level, q, out = repeated, 0, repeated.withColumn("q", F.lit(0))
    while 2 ** (q + 1) <= deepest:
        after = level.select(*KEY, (F.col("pos") - 2 ** q).alias("pos"), F.col("r").alias("r2"))
        pairs = written(level.join(after, [*KEY, "pos"]), f"lines-pairs{q}")
        groups = pairs.groupBy("r", "r2").agg(F.count("*").alias("n")).filter("n > 1")
        ranked = ordered_totals(groups, ["r", "r2"], {"n": "rank"}, f"lines-groups{q}")
        level = written(join_per_key(pairs, ranked, ["r", "r2"], "n").select(*KEY, "pos", F.col("rank").alias("r")), f"lines-level{q + 1}")
        q += 1
        if level.isEmpty():
            break
        out = out.unionByName(level.withColumn("q", F.lit(q)))
    return out


def _windows(lines: DataFrame, min_words: int) -> DataFrame:
    """(__d, __h, a, n): windows of n repeated lines from line a with min_words words, minimal from one side.

    ``lines`` has only repeated lines; a window lies inside a stretch of
    consecutive ones.  A stretch is at most one document.
    """
    doc = Window.partitionBy(*KEY).orderBy("pos")
    stretch = [*KEY, "seg"]
    rows = lines.withColumn("seg", F.col("pos") - F.row_number().over(doc))
    upto = F.sum("nw").over(Window.partitionBy(*stretch).orderBy("pos"))
    rows = rows.withColumn("c1", upto).withColumn("c0", F.col("c1") - F.col("nw"))
    # last start whose words up to this line's end reach min_words; first end that reaches it from this line's start
    starts = rows.select(*stretch, "pos", F.col("c0").alias("c"), F.lit(0).alias("side"))
    ends = rows.select(*stretch, "pos", F.col("c1").alias("c"), F.lit(1).alias("side"))
    both = starts.unionByName(ends)
    below = Window.partitionBy(*stretch).orderBy("c").rangeBetween(Window.unboundedPreceding, -min_words)
    above = Window.partitionBy(*stretch).orderBy(F.col("c").desc()).rangeBetween(Window.unboundedPreceding, -min_words)
    both = (both.withColumn("s", F.max(F.when(F.col("side") == 0, F.col("pos"))).over(below))
            .withColumn("e", F.min(F.when(F.col("side") == 1, F.col("pos"))).over(above)))
    from_end = both.filter("side = 1 AND s IS NOT NULL").select(*KEY, F.col("s").alias("a"), (F.col("pos") - F.col("s") + 1).alias("n"))
    from_start = both.filter("side = 0 AND e IS NOT NULL").select(*KEY, F.col("pos").alias("a"), (F.col("e") - F.col("pos") + 1).alias("n"))
    return from_end.unionByName(from_start).filter("n > 0").distinct()


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(__d, __h, runs): for each document with later copies, the line ranges [start, stop) to delete, in order."""
    lines = written(line_table(docs), "lines")
    ids = lines.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1")
    ids = ordered_totals(ids, ["id"], {"n": "r"}, "lines-ids").select("id", "n", "r")
    repeated = written(join_per_key(lines, ids, "id", "n").select(*KEY, "pos", "r", "nw").distinct(), "lines-level0")
    windows = written(_windows(repeated.drop("r"), min_words), "lines-windows")
    deepest = windows.agg(F.max("n")).first()[0] or 1
    levels = rank_levels(repeated.drop("nw"), deepest)
    asked = windows.withColumn("q", F.floor(F.log2(F.col("n") + 0.5)).cast("int"))
    asked = asked.withColumn("b", F.col("a") + F.col("n") - F.expr("shiftleft(1, q)"))
    first = levels.select(*KEY, F.col("pos").alias("a"), "q", F.col("r").alias("ra"))
    second = levels.select(*KEY, F.col("pos").alias("b"), "q", F.col("r").alias("rb"))
    found = written(asked.join(first, [*KEY, "a", "q"]).join(second, [*KEY, "b", "q"])
                    .select(*KEY, "a", "n", "ra", "rb"), "lines-intervals")
    least = found.groupBy("n", "ra", "rb").agg(F.min(F.struct(*KEY, "a")).alias("first"), F.count("*").alias("copies"))
    later = join_per_key(found, least, ["n", "ra", "rb"], "copies").filter(F.struct(*KEY, "a") != F.col("first"))
    doc = Window.partitionBy(*KEY).orderBy("a", "n")
    reach = F.max(F.col("a") + F.col("n")).over(doc.rowsBetween(Window.unboundedPreceding, -1))
    cut = later.withColumn("new", F.coalesce(F.col("a") > reach, F.lit(True)).cast("int"))
    islands = (cut.withColumn("island", F.sum("new").over(doc)).groupBy(*KEY, "island")
               .agg(F.min("a").alias("start"), F.max(F.col("a") + F.col("n")).alias("stop")))
    # bounded by the lines of one document
    return islands.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("runs"))


def drop_repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS, report: bool = False) -> DataFrame:
    """``docs`` with later copies of repeated runs deleted from ``text``.

    ``report``: instead (doc_id, n_lines, n_removed, runs, text).
    """
    runs = repeated_runs(docs.select("doc_id", "text"), min_words)
    row = docs.select(F.struct("*").alias("__row"), *_key("doc_id", "text")).join(runs, KEY, "left")
    lines = F.split("__row.text", "\n")
    kept = F.filter(lines, lambda x, i: ~F.exists("runs", lambda r: (i >= r["start"]) & (i < r["stop"])))
    text = F.when(F.col("runs").isNull(), F.col("__row.text")).otherwise(F.array_join(kept, "\n"))
    if report:
        gone = F.coalesce(F.aggregate("runs", F.lit(0), lambda n, r: n + r["stop"] - r["start"]), F.lit(0))
        return row.select("__row.doc_id", F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"),
                          gone.cast("long").alias("n_removed"), "runs", text.alias("text"))
    return row.select(*[text.alias(c) if c == "text" else F.col(f"__row.`{c}`") for c in docs.columns])
