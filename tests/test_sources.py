import os
import tempfile

import pytest
from pyspark.errors import AnalysisException
from changelens.streaming.incremental import incremental_ingest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changelens.operators import rows as R
from changelens.sources import csv_io as CSV
from changelens.sources import resume as RS

SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in ("Hash", "Message", "Filename")])


def test_csv_lenient_scan(spark):
    d = tempfile.mkdtemp(dir="/tmp")
    path = os.path.join(d, "in.csv")
    with open(path, "w") as f:
        f.write('Hash,Message,Filename\nh1,"multi\nline, ""q""",f1\nh2,m2\nh3,m3,f3,extra\nh4,,f4\nh5,m5,f5,\nh6,m,f,x,y\n')
    good, bad = CSV.csv_lenient_scan(spark, path, SCHEMA)
    g = {r.Hash: r for r in good.collect()}
    assert sorted(g) == ["h1", "h2", "h4"]
    assert g["h1"].Message == 'multi\nline, "q"' and g["h2"].Filename is None and g["h4"].Message is None
    assert sorted(r.Hash for r in bad.collect()) == ["h3", "h5", "h6"]


def test_resume_twice_is_once(spark):
    out = os.path.join(tempfile.mkdtemp(dir="/tmp"), "out")
    df = spark.range(100).select((F.col("id") % 50).alias("k"), F.col("id").alias("v"))
    os.makedirs(out)  # an empty folder is an output without commits
    RS.resume_append(df.where("k < 20"), out, ["k"])
    RS.resume_append(df, out, ["k"])
    RS.resume_append(df, out, ["k"])
    assert spark.read.parquet(out).count() == 100
    with pytest.raises(AnalysisException):  # an output with other columns is no empty output
        RS.resume_append(df.withColumnRenamed("k", "other"), out, ["other"])


def test_late_rows_of_a_batch_are_written(spark):
    out = os.path.join(tempfile.mkdtemp(dir="/tmp"), "out")
    RS.batch_checkpoint(spark.range(100).toDF("k"), out, ["k"], 4)
    assert RS.batch_checkpoint(spark.range(200).toDF("k"), out, ["k"], 4).count() == 200


def test_quarantine_keeps_the_whole_record(spark):
    path = os.path.join(tempfile.mkdtemp(dir="/tmp"), "x.csv")
    with open(path, "w") as f:
        f.write('1,x,2.5\n2,x,3,,z\n3,"a,b",4,"q""r"\n4,x\nfive,x,1\n5,"",\n,y,2\n')
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("s", T.StringType()), T.StructField("v", T.DoubleType())])
    good, bad = CSV.csv_lenient_scan(spark, path, schema, header=False)
    assert sorted((r.k or 0, r.v) for r in good.collect() if r.v) == [(0, 2.0), (1, 2.5)] and good.count() == 4
    got = {r.raw.strip(): list(r.extra) for r in bad.collect()}
    assert got == {"2,x,3,,z": ["", "z"], '3,"a,b",4,"q""r"': ['"q""r"'], "five,x,1": []}
    with pytest.raises(Exception, match="malformed row"):
        CSV.csv_strict_scan(spark, path, schema, header=False).collect()


def test_ingest_does_not_depend_on_the_layout(spark):
    rows = [(1, "a"), (1, "b"), (2, "c")]
    for parts in (1, 3):
        top = tempfile.mkdtemp(dir="/tmp")
        df = spark.createDataFrame(rows, "k int, v string").repartition(parts)
        df.write.parquet(f"{top}/in")
        for _ in range(2):
            incremental_ingest(spark, f"{top}/in", df.schema, f"{top}/out", f"{top}/ck", ["k"], max_files_per_trigger=1)
        assert sorted(r.k for r in spark.read.parquet(f"{top}/out").collect()) == [1, 2]
    with pytest.raises(ValueError):
        incremental_ingest(spark, f"{top}/in", df.schema, f"{top}/o2", f"{top}/c2", ["k"], file_glob="*.none")


def test_dead_letters_conserve_rows(spark):
    df = spark.range(10).withColumn("error", F.when(F.col("id") % 3 == 0, F.lit("bad")))
    good, dead = RS.split_dead_letters(df, "error", ["id"], "stage", os.path.join(tempfile.mkdtemp(dir="/tmp"), "split"))
    assert good.count() + dead.count() == 10 and dead.count() == 4


def test_row_index_is_dense_and_ordered(spark):
    df = spark.range(0, 1000, 7).select((F.col("id") * -1).alias("k"))
    idx = R.with_row_index(df, ["k"], num_partitions=5)
    rows = sorted((r.row_id, r.k) for r in idx.collect())
    assert [r[0] for r in rows] == list(range(len(rows)))
    assert [r[1] for r in rows] == sorted(r[1] for r in rows)


def test_run_counters_observe(spark):
    df = spark.range(10)
    obs_df, obs = RS.run_counters(df, "c", even=F.col("id") % 2 == 0)
    obs_df.write.format("noop").mode("overwrite").save()
    assert obs.get == {"rows": 10, "even": 5}


def test_batch_checkpoint_skips_finished(spark):
    out = os.path.join(tempfile.mkdtemp(dir="/tmp"), "b")
    df = spark.range(200).select(F.col("id").alias("k"))
    r1 = RS.batch_checkpoint(df, out, ["k"], 4)
    r2 = RS.batch_checkpoint(df, out, ["k"], 4)
    assert r1.count() == 200 and r2.count() == 200


def test_flagged_rows_with_a_cell_of_a_megabyte(spark):
    path = os.path.join(tempfile.mkdtemp(dir="/tmp"), "big.csv")
    cell = 'def f():\n    return ""x"", 1\n' * 40_000
    with open(path, "w") as f:
        f.write(f'Hash,Message,Filename\nh1,"{cell}",f1\nh2,"{cell}",f2,"{cell}"\n')
    good, bad = CSV.csv_lenient_scan(spark, path, SCHEMA)
    assert [r.Hash for r in good.collect()] == ["h1"]
    assert [(r.Hash, len(r.extra[0])) for r in bad.collect()] == [("h2", len(cell) + 2)]
    with pytest.raises(Exception, match="malformed row"):
        CSV.csv_strict_scan(spark, path, SCHEMA).collect()
