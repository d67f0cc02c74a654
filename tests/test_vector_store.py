"""Vectors kept from run to run: only new texts are embedded, scores equal those made afresh."""

import math
import os
import tempfile


from changelens.functions.vectors import cosine
from changelens.operators import models as MD
from changelens.operators import vector_store as VS


def test_a_second_run_embeds_only_new_texts(spark):
    path, seen = os.path.join(tempfile.mkdtemp(dir="/tmp"), "store"), []

    def embed(df, text, out):
        seen.append(sorted(r[0] for r in df.select(text).collect()))
        return MD.embed_text(df, text, out)

    first = spark.createDataFrame([(1, "fix bug", "add file"), (2, "fix bug", None), (3, "", "add file")], "k int, a string, b string")
    assert VS.extend_store(first, ["a", "b"], path, embed, 4) == 3 and seen == [["", "add file", "fix bug"]]
    assert VS.extend_store(first, ["a", "b"], path, embed, 4) == 0 and seen[1] == []
    more = first.unionByName(spark.createDataFrame([(4, "add test", "fix bug"), (1, "add test", "add test")], "k int, a string, b string"))
    assert VS.extend_store(more, ["a", "b"], path, embed, 4) == 1 and seen[2] == ["add test"]
    assert VS.extend_store(more.limit(0), ["a", "b"], path, embed, 4) == 0
    got = VS.scores_from_store(more, ["k", "a"], {"s": ("a", "b"), "same": ("a", "a")}, path).collect()
    fresh = MD.embed_text(MD.embed_text(more.fillna(""), "a", "va"), "b", "vb").select("k", "a", cosine("va", "vb").alias("s")).collect()
    key = lambda r: (r.k, r.a, round(r.s, 9))
    assert sorted(map(key, got)) == sorted(map(key, fresh))
    assert all(math.isclose(r.same, 1.0 if r.a else 0.0) for r in got)
    unknown = spark.createDataFrame([(9, "not there", "fix bug")], "k int, a string, b string")
    assert VS.scores_from_store(unknown, ["k"], {"s": ("a", "b")}, path).first().s == 0.0


def test_sparse_bag_equals_the_dense_vector(spark):
    df = spark.createDataFrame([("a b a c a b",), ("",), (None,), (" ".join(f"w{i % 50}" for i in range(400)),), ("one",)], "t string")
    for r in df.select(MD.hashed_embedding("t").alias("v"), VS.sparse_bag("t").alias("s")).collect():
        assert [(i, int(x)) for i, x in enumerate(r.v) if x] == [(e.bucket, e.n) for e in r.s]


def test_the_view_is_read_once_per_use_not_once_per_role(spark):
    from changelens.operators import similarity as SIM

    path = os.path.join(tempfile.mkdtemp(dir="/tmp"), "t")
    spark.createDataFrame([(1, "a b", "b c", "c d", "d e")], "k int, w string, x string, y string, z string").write.parquet(path)
    out = SIM.message_scores(spark.read.parquet(path), ["k"], "w", {"x": "x", "y": "y", "z": "z"}, MD.embed_text)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count(path.rsplit("/", 2)[1]) == 1  # one scan of the rows, the others of the staged vectors
