"""S12 with bounded state: each key once within a delay of event time, late rows set aside.

Two streams in a row.  The first splits every micro-batch by the watermark that
the batches before it set: rows older than that go to the late side output, the
others are staged.  The second removes repeated keys from the staged rows
with state that the watermark ends.  So a run's cost follows the new rows and
the keys of the last ``delay``, not the whole history.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.resume import committed


def stateful_ingest(spark: SparkSession, source_path: str, schema: T.StructType, out_path: str, late_path: str, checkpoint_path: str,
                    keys: list[str], event_time: str, delay: str, fmt: str = "parquet", max_files_per_trigger: int | None = None) -> None:
    """Take in every file not yet seen under ``source_path``: a key's first row to ``out_path``, rows too late to judge to ``late_path``.

    A row is late if its event time is null or more than ``delay`` (an interval such as '2 days') before the latest of all earlier
    micro-batches; the keys that it might repeat are forgotten by then.  Of the rows of a key that are not late and within ``delay`` of the first of them one is
    kept; replayed files add nothing.  Each file's rows end up in exactly one of: kept, a repeat of a kept row, late.  Blocks until the
    available data is done; a run that failed is taken up by the next.
    """
    found = spark.read.schema(schema).format(fmt).load(source_path)
    if not found.inputFiles():
        raise ValueError(f"no files to ingest under {source_path}")
    staged, marks = f"{checkpoint_path}/staged", f"{checkpoint_path}/marks"

    def split(batch: DataFrame, batch_id: int) -> None:
        # every write replaces the folder of its batch, so a replayed batch leaves the same rows
        before = committed(spark, marks, ["batch", "latest"], "parquet")
        latest = None if before is None else before.where(F.col("batch") < batch_id).agg(F.max("latest")).first()[0]
        late = F.col(event_time).isNull()
        if latest is not None:
            late = late | (F.col(event_time) < F.lit(latest) - F.expr(f"interval {delay}"))
        late = F.coalesce(late, F.lit(True))
        batch.where(late).write.mode("overwrite").parquet(f"{late_path}/batch={batch_id}")
        batch.where(~late).write.mode("overwrite").parquet(f"{staged}/batch={batch_id}")
        batch.agg(F.max(event_time).alias("latest")).write.mode("overwrite").parquet(f"{marks}/batch={batch_id}")

    reader = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    (reader.load(source_path).writeStream.foreachBatch(split).option("checkpointLocation", f"{checkpoint_path}/split")
     .trigger(availableNow=True).start().awaitTermination())
    # all that the first stream staged is one micro-batch here, so the watermark never overtakes a staged row
    once = (spark.readStream.schema(schema).parquet(staged).select(*schema.names).withWatermark(event_time, delay)
            .dropDuplicatesWithinWatermark(keys))
    (once.writeStream.format("parquet").option("path", out_path).option("checkpointLocation", f"{checkpoint_path}/once")
     .outputMode("append").trigger(availableNow=True).start().awaitTermination())
