"""Fault-tolerant, resumable runs: dead letters, resume-by-anti-join, batch checkpoints, counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


def split_dead_letters(df: DataFrame, error_col: str, key_cols: list[str], stage: str,
                       path: str) -> tuple[DataFrame, DataFrame]:
    """(good, dead) from one result with an ``error`` column.

    The result is written once under ``path`` (partitioned by failed or not), so
    both sides are read from there and the stage isn't computed again.
    """
    df.withColumn("_failed", F.col(error_col).isNotNull()).write.mode("overwrite").partitionBy("_failed").parquet(path)
    both = df.sparkSession.read.schema(df.withColumn("_failed", F.lit(True)).schema).parquet(path)
    good = both.where("NOT _failed").drop("_failed")
    dead = both.where("_failed").select(*key_cols, F.lit(stage).alias("stage"), F.col(error_col).alias("error"))
    return good, dead


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def committed(spark: SparkSession, path: str, columns: list[str], fmt: str) -> DataFrame | None:
    """The named columns of an earlier output; None if there is none or nothing was committed to it yet.

    Any other fault, such as a missing column, is raised.
    """
    if not _exists(spark, path):
        return None
    try:
        old = spark.read.format(fmt).load(path)
    except AnalysisException as e:
        if e.getCondition() == "UNABLE_TO_INFER_SCHEMA":  # an empty folder
            return None
        raise
    return old.select(*columns)


def resume_append(new: DataFrame, out_path: str, keys: list[str], fmt: str = "parquet") -> None:
    """Append the rows whose keys are not in the existing output.

    The anti-join against the committed output feeds the append itself, one job
    whose commit is all-or-nothing; a second run appends nothing.
    """
    done = committed(new.sparkSession, out_path, keys, fmt)
    pending = new if done is None else new.join(done, keys, "left_anti")
    pending.write.mode("append").format(fmt).save(out_path)


def batch_id(keys: list[str], n_batches: int):
    """Stable batch of a row: pmod(xxhash64(keys), n)."""
    return F.pmod(F.xxhash64(*[F.col(k) for k in keys]), F.lit(n_batches))


def batch_checkpoint(df: DataFrame, out_path: str, keys: list[str], n_batches: int,
                     fmt: str = "parquet") -> DataFrame:
    """Write results partitioned by batch id; a rerun adds the rows that aren't there yet.

    A batch's rows are found by (batch, keys), so late rows of a written batch
    are added to it, and a rerun after a failure writes what is missing.
    """
    spark = df.sparkSession
    b = df.withColumn("batch_id", batch_id(keys, n_batches).cast("int"))
    done = committed(spark, out_path, ["batch_id", *keys], fmt)
    if done is not None:
        b = b.join(done, ["batch_id", *keys], "left_anti")
    b.write.mode("append").partitionBy("batch_id").format(fmt).save(out_path)
    return spark.read.schema(b.schema).format(fmt).load(out_path)


def run_counters(df: DataFrame, name: str, **conditions) -> tuple[DataFrame, Observation]:
    """Counters gathered in the same pass as the job (``DataFrame.observe``).

    ``conditions`` maps counter name -> boolean Column; ``rows`` is always counted.
    """
    obs = Observation(name)
    aggs = [F.count(F.lit(1)).alias("rows")] + [F.count_if(c).alias(k) for k, c in conditions.items()]
    return df.observe(obs, *aggs), obs


def counters_table(df: DataFrame, **conditions) -> DataFrame:
    """S11 as a one-row aggregate (same counters, for reporting as a table)."""
    return df.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(c).alias(k) for k, c in conditions.items()])
