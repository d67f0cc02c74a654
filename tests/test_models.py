from changelens.operators import models as MD


def _upper_but_fails_on_boom():
    def run(texts):
        if any("boom" in t for t in texts):
            raise RuntimeError("model failed")
        return [t.upper() for t in texts]
    return run


def test_batch_model_apply_isolates_failing_rows(spark):
    df = spark.createDataFrame([(1, "fix a"), (2, "boom"), (3, "fix a"), (4, None)], "k int, t string")
    r = {x.k: x for x in MD.batch_model_apply(df, "t", "out", _upper_but_fails_on_boom).collect()}
    assert r[1].out == "FIX A" and r[3].out == "FIX A" and r[1].error is None
    assert r[2].out is None and "model failed" in r[2].error
    assert r[4].out == ""


def test_hashed_embedding_blank_is_zero(spark):
    df = spark.createDataFrame([("",), ("a b a",)], "t string")
    v = [r.v for r in MD.embed_text(df, "t", "v").collect()]
    assert sum(v[0]) == 0 and sum(v[1]) == 3 and len(v[1]) == 64


def _forgets_short_texts():
    return lambda texts: [t for t in texts if len(t) > 1]


def test_short_results_fail_only_their_rows(spark):
    df = spark.createDataFrame([(1, "ab"), (2, "c"), (3, "de")], "k int, t string")
    got = {r.k: (r.out, r.error is None) for r in MD.batch_model_apply(df, "t", "out", _forgets_short_texts).collect()}
    assert got == {1: ("ab", True), 2: (None, False), 3: ("de", True)}
