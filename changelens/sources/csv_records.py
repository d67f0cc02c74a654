"""Multi-line CSV records of files of any size, read by many tasks.

Files are split at any line.  Whether a line lies inside a quoted cell follows
from the parity of the quotes before it: the splits' counts give each split its
parity, and a running count inside the split does the rest.  A record starts at
a line outside quotes; lines that continue a record of an earlier split are
brought to it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..staging import written


def csv_records(spark: SparkSession, path: str, header: bool) -> DataFrame:
    """(file, split, rec, record): every record as written, without its line end; the header record of each file is left out.

    Records end with \\n or \\r\\n; a quote inside a quoted cell is doubled.  Blank lines between records are skipped.  A
    cell that never closes takes in the rest of its file, as with any CSV reader.  A task holds one split
    (``spark.sql.files.maxPartitionBytes``) and the records that begin in it.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("n"), F.col("value").alias("line"))
    lines = lines.withColumn("quotes", F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit(""))))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    # one row per split
    parity = written(lines.groupBy("file", "split").agg(F.sum("quotes").alias("q")).select(
        "file", "split", (F.coalesce(F.sum("q").over(before), F.lit(0)) % 2).alias("odd")), "csv-parity")
    inside = Window.partitionBy("file", "split").orderBy("n")
    earlier = F.coalesce(F.sum("quotes").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = lines.join(F.broadcast(parity), ["file", "split"]).withColumn("outside", (F.col("odd") + earlier) % 2 == 0)
    placed = placed.where(~(F.col("outside") & F.col("line").isin("", "\r")))
    placed = placed.withColumn("rec", F.sum(F.col("outside").cast("int")).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    parts = written(placed.groupBy("file", "split", "rec").agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("n", "line")))["line"], "\n").alias("text")), "csv-parts")
    # rec 0 continues a record: the last one of the nearest split before in which one starts
    tops = parts.groupBy("file", "split").agg(F.max("rec").alias("top"))
    to = F.last(F.when(F.col("top") > 0, F.struct(F.col("split").alias("s"), F.col("top").alias("r"))), True).over(before)
    tails = parts.where("rec = 0").join(tops.select("file", "split", to.alias("to")), ["file", "split"])
    tails = tails.groupBy("file", F.col("to.s").alias("split"), F.col("to.r").alias("rec")).agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("split", "text")))["text"], "\n").alias("tail"))
    whole = parts.where("rec > 0").join(tails, ["file", "split", "rec"], "left")
    first = (F.col("split") == 0) & (F.col("rec") == 1)
    if header:
        whole = whole.where(~first)
    text = F.concat("text", F.coalesce(F.concat(F.lit("\n"), "tail"), F.lit("")))
    text = F.when(first, F.regexp_replace(text, "^﻿", "")).otherwise(text)
    return whole.select("file", "split", "rec", F.regexp_replace(text, "\r$", "").alias("record"))
