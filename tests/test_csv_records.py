"""Splittable multi-line CSV: the same records whatever the splits."""

import csv
import io
import os
import random
import tempfile

import pytest
from pyspark.sql import types as T

from changelens.sources import csv_io as CSV
from changelens.sources.csv_records import csv_records

SCHEMA = T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.LongType()), T.StructField("c", T.StringType())])


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def folder(texts):
    d = tempfile.mkdtemp(dir="/tmp")
    for i, text in enumerate(texts):
        with open(os.path.join(d, f"f{i}.csv"), "w", newline="") as f:
            f.write(text)
    return d


def cell(rng):
    return "".join(rng.choice(["x", "yy ", '"', ",", "\n", "", "é"]) for _ in range(rng.randrange(12))) if rng.random() < 0.7 else "long cell\n" * rng.randrange(60)


def test_records_of_many_splits(spark, small_splits):
    rng = random.Random(3)
    rows = [[[cell(rng), str(i), cell(rng)] for i in range(60)] for _ in range(3)]
    texts = []
    for file in rows:
        out = io.StringIO()
        csv.writer(out, lineterminator="\n").writerows([["a", "b", "c"], *file])
        texts.append(out.getvalue())
    path = folder(texts)
    records = csv_records(spark, path, True)
    parsed = [next(csv.reader(io.StringIO(r.record, newline=""))) for r in records.collect()]
    assert sorted(parsed) == sorted(r for file in rows for r in file)
    assert records.select("file", "split").distinct().count() > 30
    good, bad = CSV.csv_lenient_scan(spark, path, SCHEMA)
    assert sorted((r.a or "", r.b, r.c or "") for r in good.collect()) == sorted((a, int(b), c) for file in rows for a, b, c in file) and bad.count() == 0
    named = CSV.csv_named_scan(spark, path, ["c", "b"])
    assert sorted((r.c or "", r.b) for r in named.collect()) == sorted((c, b) for file in rows for _, b, c in file)


def test_good_bad_and_raw_rows_do_not_depend_on_the_splits(spark, small_splits):
    rng = random.Random(8)
    out = ["a,b,c"]
    for i in range(200):
        kind = rng.randrange(6)
        quoted = '"' + cell(rng).replace('"', '""') + '"'
        out.append([f"{quoted},{i},z", f"{quoted},{i}", f"{quoted},{i},z,extra,\"m\nn\"", f"{quoted},no number,z", "", f"x,{i},{quoted}"][kind])
    path = folder(["\n".join(out)])
    sides = []
    for size in ("300", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        good, bad = CSV.csv_lenient_scan(spark, path, SCHEMA)
        sides.append((sorted(map(str, good.collect())), sorted(map(str, bad.collect()))))
    assert sides[0] == sides[1] and sides[0][0] and sides[0][1]
    whole = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').schema(SCHEMA).csv(path)
    assert set(sides[0][0]) <= set(map(str, whole.collect()))
    with pytest.raises(Exception, match="malformed row"):
        CSV.csv_strict_scan(spark, path, SCHEMA).collect()


def test_line_ends_blank_lines_and_empty_files(spark, small_splits):
    path = folder(["﻿a,b,c\r\n\r\nx,1,\"m\r\nn\"\r\n\r\n\n  y,2,z", "a,b,c\n", "", "a,b,c\nlast,3,no line end\n"])
    got = sorted((r.a, r.b, r.c) for r in CSV.csv_lenient_scan(spark, path, SCHEMA)[0].collect())
    assert got == [("  y", 2, "z"), ("last", 3, "no line end"), ("x", 1, "m\r\nn")]
    assert CSV.csv_lenient_scan(spark, folder(["1,2,3\n4,5,6"]), SCHEMA, header=False)[0].count() == 2
