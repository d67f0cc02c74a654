import json

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from changelens.functions import diffs as D
from changelens.operators import changes as C
from changelens.operators import lines as L


def test_hunk_split(spark):
    d = "hdr\n@@ -1,2 +1,2 @@\n-a\n+b\n@@ -9 +9 @@ def f():\n-c"
    df = spark.createDataFrame([(1, d)], "k int, diff string")
    r = C.hunk_split(df, ["k"], "diff").orderBy("hunk_no").collect()
    assert [x.hunk for x in r] == ["hdr", "-a\n+b\n@@ -9 +9 @@ def f():\n-c"]


def test_diff_line_split(spark):
    df = spark.createDataFrame([("+a\n++b\n-c\n+++ f\n+ d ",)], "diff string")
    r = L.diff_line_split(df, "diff").first()
    assert r.added == ["a", "d"] and r.deleted == ["c"]


def _hist(added, deleted):
    return json.dumps({"added": [{"n": i, "line": x} for i, x in enumerate(added)],
                       "deleted": [{"n": i, "line": x} for i, x in enumerate(deleted)]})


def test_discrepancy_yes_no_error(spark):
    rows = [("+a\n+b\n+a\n-c", _hist(["b", "a"], ["c"])),
            ("+a\n-c", _hist(["a"], ["d"])),
            ("+a", "{not json")]
    df = spark.createDataFrame(rows, "diff string, diff_hist string")
    got = [r.discrepancy for r in L.discrepancy(df).collect()]
    assert got == ["Yes", "No", "Error"]


def test_discrepancy_compat_whitespace(spark):
    df = spark.createDataFrame([("+x = 1", _hist(["x = 1"], []))], "diff string, diff_hist string")
    assert L.discrepancy(df, normalize="compat").first().discrepancy == "No"
    assert L.discrepancy(df, normalize="both").first().discrepancy == "Yes"


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet="ab +-", min_size=0, max_size=6), min_size=0, max_size=5),
       st.lists(st.text(alphabet="ab +-", min_size=0, max_size=6), min_size=0, max_size=5))
def test_discrepancy_of_itself_is_yes(spark, added, deleted):
    # a line whose text starts with a sign once spaces are squeezed reads as a header line
    added = [a for a in added if not a.replace(" ", "").startswith(("+", "-"))]
    deleted = [d for d in deleted if not d.replace(" ", "").startswith(("+", "-"))]
    diff = "\n".join(["-" + d for d in deleted] + ["+" + a for a in added])
    df = spark.createDataFrame([(diff, _hist(added, deleted))], "diff string, diff_hist string")
    assert L.discrepancy(df, normalize="both").first().discrepancy == "Yes"


def test_ordered_join_text(spark):
    df = spark.createDataFrame([(1, 2, "b"), (1, 1, "a")], "k int, pos int, t string")
    assert C.ordered_join_text(df, ["k"], "pos", "t").first().joined == "a; b"


def test_change_message_join_null_keys(spark):
    left = spark.createDataFrame([("a", 1), (None, 2)], "k string, v int")
    right = spark.createDataFrame([("a", 3), (None, 4)], "k string, w int")
    assert C.change_message_join(left, right, ["k"], ["w"], null_safe=True).count() == 2
    assert C.change_message_join(left, right, ["k"], ["w"]).count() == 1


def test_change_message_join_duplicates_multiply(spark):
    left = spark.createDataFrame([("a", 1), ("a", 2)], "k string, v int")
    right = spark.createDataFrame([("a", 3), ("a", 4)], "k string, w int")
    assert C.change_message_join(left, right, ["k"], ["w"]).count() == 4


def test_before_after_join_inner_vs_outer(spark):
    versions = spark.createDataFrame([("r", 0, "v0"), ("r", 1, "v1"), ("r", 2, "v2")], "repo string, c int, content string")
    changes = spark.createDataFrame([("r", 0, -1), ("r", 2, 1)], "repo string, c int, p int")
    inner = C.before_after_join(changes, versions, ["repo"], "c", "p", how="inner").collect()
    assert [(r.c, r.before, r.after) for r in inner] == [(2, "v1", "v2")]
    outer = sorted(C.before_after_join(changes, versions, ["repo"], "c", "p", how="outer").collect(), key=lambda r: r.c)
    assert [(r.c, r.before, r.after) for r in outer] == [(0, "", "v0"), (2, "v1", "v2")]


def test_line_delta_multiset(spark):
    df = spark.createDataFrame([(1, "a\nb\nb", "b\nc\nc")], "k int, before string, after string")
    got = sorted((r.side, r.line) for r in L.line_delta(df, ["k"]).collect())
    assert got == [("added", "c"), ("added", "c"), ("deleted", "a"), ("deleted", "b")]


def test_null_safe_join_matches_nulls(spark):
    left = spark.createDataFrame([(1, "a"), (1, None)], "k int, p string")
    right = spark.createDataFrame([(1, "a", "x"), (1, None, "y")], "k int, p string, m string")
    assert [r.m for r in C.change_message_join(left, right, ["k", "p"], ["m"]).collect()] == ["x"]
    assert sorted(r.m for r in C.change_message_join(left, right, ["k", "p"], ["m"], null_safe=True).collect()) == ["x", "y"]


def test_trailing_json_text_is_an_error(spark):
    df = spark.createDataFrame([('{"added":[],"deleted":[]}',), ('{"added":[],"deleted":[]} junk',), ('{"a":1},{"b":2}',), ("[]",), (None,)], "h string")
    got = [r.discrepancy for r in L.discrepancy(df.withColumn("diff", F.lit("")), "diff", "h").collect()]
    assert got == ["Yes", "Error", "Error", "Error", "Error"]


def test_changed_files(spark):
    old = spark.createDataFrame([(1, "a", "x"), (1, "b", "y"), (1, "c", "z")], "k int, path string, content string")
    new = spark.createDataFrame([(1, "a", "x"), (1, "b", "Y"), (1, "d", "w")], "k int, path string, content string")
    got = {(r.path, r.change) for r in L.changed_files(old, new, ["k"]).collect()}
    assert got == {("b", "Modified"), ("c", "Deleted"), ("d", "Added")}
