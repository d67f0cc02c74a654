"""Complexity per block with values counted by hand, and statistics that merge."""

import math
import random
import statistics

from pyspark.sql import functions as F

from changelens.operators import codeblocks as CB
from changelens.operators import moments as MO

SOURCE = '''import os
if os: x = 1  # outside any block

class Shape(Base):
    """if for while, in a string"""
    sides = 4 if os else 3

    def area(self,
             scale=1):
        if self.sides and scale:
            for i in range(3):
                pass
        return "if"

    async def wait(self):
        def later(n):
\t\twhile n: n -= 1
        try:
            later(1)
        except ValueError:
            pass
        total = (1 +
  2 if os else 3)
        return total

def top(a): return a or 1
with os: pass
if os:
    def inner():
        y = 1 \\
if_not_a_decision
        elif_ = 2
'''


def blocks(spark, source):
    df = spark.createDataFrame([(1, source)], "k int, s string")
    return [(r.block_no, r["name"], r.kind, r.parent_no, r.depth, r.complexity) for r in CB.code_blocks(df, ["k"], "s").orderBy("block_no").collect()]


def test_one_complexity_per_block(spark):
    assert blocks(spark, SOURCE) == [
        (0, "Shape", "class", None, 0, 2), (1, "area", "method", 0, 1, 4), (2, "wait", "method", 0, 1, 3), (3, "later", "function", 2, 2, 2),
        (4, "top", "function", None, 0, 2), (5, "inner", "function", None, 0, 1)]
    df = spark.createDataFrame([(1, SOURCE), (2, "x = 1"), (3, None), (4, "def f():\r\n    pass")], "k int, s string")
    got = {r.k: tuple(r)[1:] for r in CB.block_complexity(df, ["k"], "s").collect()}
    assert got == {1: (6, 14 / 6, 4), 4: (1, 1.0, 1)}


def test_lines_after_a_block_are_not_its_own(spark):
    source = "def f():\n    x = 1\nwith open(p) as g:\n    if x:\n        while y: pass\nclass A: pass\nif x: pass\n"
    assert blocks(spark, source) == [(0, "f", "function", None, 0, 1), (1, "A", "class", None, 0, 1)]


def test_merged_batches_equal_the_whole(spark, tmp_path):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), rng.gauss(1e6, 1) if rng.random() < 0.9 else None, rng.random() if rng.random() < 0.95 else float("nan"), i % 7) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, x double, y double, z int")
    for i in range(5):
        MO.record_batch(df.where(f"z % 5 = {i}"), str(tmp_path), f"b{i}", ["x", "y"], ["g"])
    MO.record_batch(df.where("z % 5 = 3"), str(tmp_path), "b3", ["x", "y"], ["g"])  # again
    MO.record_batch(df.limit(0), str(tmp_path), "none", ["x", "y"], ["g"])
    whole = {(r.g, r.a, r.b): r for r in MO.moments(df, ["x", "y"], ["g"]).collect()}
    got = {(r.g, r.a, r.b): r for r in MO.recorded(spark, str(tmp_path), ["g"]).collect()}
    assert set(got) == set(whole)
    for k, r in got.items():
        assert r.n == whole[k].n and (r.low, r.high) == (whole[k].low, whole[k].high)
        assert all(math.isclose(r[c], whole[k][c], rel_tol=1e-9, abs_tol=1e-6) for c in ("mean_a", "mean_b", "m2_a", "m2_b", "c_ab"))
    for r in MO.summary(MO.recorded(spark, str(tmp_path), ["g"]), ["g"]).collect():
        values = [row[1 if r["name"] == "x" else 2] for row in rows if row[0] == r.g]
        values = [v for v in values if v is not None and not math.isnan(v)]
        assert r.n == len(values) and math.isclose(r["std"], statistics.stdev(values), rel_tol=1e-6)
    for r in MO.correlations(MO.recorded(spark, str(tmp_path), ["g"]), ["g"]).collect():
        pair = [(x, y) for g, x, y, _ in rows if g == r.g and x is not None and not math.isnan(y)]
        assert math.isclose(r["corr"], statistics.correlation(*zip(*pair)), abs_tol=1e-6)


def test_moments_of_nothing_and_of_one_value(spark):
    df = spark.createDataFrame([(None, 1.0)], "x double, y double")
    got = {(r.a, r.b): r for r in MO.merged(MO.moments(df, ["x", "y"])).collect()}
    assert [got[k].n for k in (("x", "x"), ("x", "y"), ("y", "y"))] == [0, 0, 1] and got["y", "y"].m2_a == 0
    one = {r["name"]: r for r in MO.summary(MO.merged(MO.moments(df, ["x", "y"]))).collect()}
    assert one["y"]["std"] is None and one["y"]["mean"] == 1.0 and one["x"].n == 0
    assert MO.correlations(MO.moments(df.unionAll(df), ["x", "y"])).first()["corr"] is None


def test_a_text_is_read_once_by_blocks(spark):
    plan = CB.code_blocks(spark.createDataFrame([(1, SOURCE)], "k int, s string"), ["k"], "s")._jdf.queryExecution().executedPlan().toString()
    assert "aggregate(" not in plan and plan.count("ArrowEvalPython") == 1


def test_blocks_of_odd_texts(spark):
    assert blocks(spark, "") == blocks(spark, "\n\t\n") == blocks(spark, "x = (\n") == []
    # a comment or string is no head, other line ends count, a tab is eight, a bracket left open keeps the block
    source = "# def a():\r\n'''def b():\n  if'''\u2028class D:\x0b\tdef é(self):\r            if x or (\ndef no(): pass\n): pass\r\n        \\ \n  and q\n        while y: pass"
    assert blocks(spark, source) == [(0, "D", "class", None, 0, 3), (1, "é", "method", 0, 1, 3)]
    assert blocks(spark, "def 'x'():\n  pass\ndef (y): pass\nasync  def for(): pass\nasync deff x") == [(0, "_s", "function", None, 0, 1), (1, "for", "function", None, 0, 2)]
