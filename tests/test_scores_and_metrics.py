import math
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from changelens.functions.bleu import tokenize_13a
from changelens.functions.vectors import cosine
from changelens.operators import classify as K
from changelens.operators import codemetrics as G
from changelens.operators import models as MD
from changelens.operators import similarity as SIM
from changelens.operators import stats as ST

CODE1 = "def add(a, b):\n    return a + b"
CODE2 = "def sum_numbers(x, y):\n    return x + y"


def test_13a_tokens(spark):
    df = spark.createDataFrame([(CODE1, CODE2)], "a string, b string")
    r = df.select(tokenize_13a("a").alias("a"), tokenize_13a("b").alias("b")).first()
    assert len(r.a) == 12 and len(r.b) == 14
    assert r.b[:4] == ["def", "sum", "_", "numbers"]


def test_bleu_reference_pair(spark):
    df = spark.createDataFrame([(1, CODE2, CODE1)], "k int, cand string, ref string")
    got = SIM.bleu(df, ["k"], "cand", "ref").first().bleu
    assert got == pytest.approx(0.130651, abs=1e-6)


def test_bleu_identity_and_short(spark):
    df = spark.createDataFrame([(1, "a b c d e", "a b c d e"), (2, "a b c", "a b c"), (3, "x y z w", "p q r s")],
                               "k int, cand string, ref string")
    got = {r.k: r.bleu for r in SIM.bleu(df, ["k"], "cand", "ref").collect()}
    assert got[1] == pytest.approx(1.0) and got[2] == 0.0 and got[3] == 0.0


def test_cosine_zero_vector_and_symmetry(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0]), ([1.0, 2.0], [3.0, -1.0])], "a array<double>, b array<double>")
    r = df.select(cosine("a", "b").alias("ab"), cosine("b", "a").alias("ba")).collect()
    assert r[0].ab == 0.0
    assert r[1].ab == pytest.approx(r[1].ba) and -1 <= r[1].ab <= 1


@settings(max_examples=8, deadline=None)
@given(st.lists(st.floats(-100, 100), min_size=3, max_size=3), st.lists(st.floats(-100, 100), min_size=3, max_size=3))
def test_cosine_bounded(spark, a, b):
    df = spark.createDataFrame([(a, b)], "a array<double>, b array<double>")
    v = df.select(cosine("a", "b")).first()[0]
    assert -1 - 1e-9 <= v <= 1 + 1e-9


def test_code_metrics_reference_pair(spark):
    df = spark.createDataFrame([(CODE1, CODE2)], "before string, after string")
    m = G.code_metrics(G.code_metrics(df, "before", "b_"), "after", "a_").first()
    assert (m.b_loc, m.a_loc) == (2, 2)
    assert (m.b_cc, m.a_cc) == (1.0, 1.0)
    # volume 3*log2(3), 1 block, 2 logical lines, no comments
    expected = (171 - 5.2 * math.log(3 * math.log2(3)) - 0.23 - 16.2 * math.log(2)) * 100 / 171
    assert m.b_mi == pytest.approx(expected)


def test_code_change_metrics_blank_side_fails(spark):
    df = spark.createDataFrame([(1, "", CODE1), (2, CODE1, CODE2)], "k int, before string, after string")
    r = {x.k: x for x in G.code_change_metrics(df).collect()}
    assert r[1].error is not None and r[1].loc_change is None
    assert r[2].error is None and r[2].loc_change == 0 and r[2].cc_change == 0.0


def test_threshold_classes(spark):
    df = spark.createDataFrame([(0.8, 0.75), (0.79, 0.74), (None, None)], "s double, t double")
    r = K.classify(df, "s", "t").collect()
    assert [x.semantic_class for x in r] == ["Minor", "Major", "Major"]
    assert [x.token_class for x in r] == ["Minor", "Major", "Major"]
    assert [x.classes_agree for x in r] == ["YES", "YES", "YES"]


def test_summary_statistics(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.5), (3.0, None), (None, 9.0), (4.0, 7.0)], "x double, y double")
    s = {r.metric: r for r in ST.summary(df, ["x"]).collect()}["x"]
    assert s.mean == 2.5 and s.median == 2.5 and s.std == pytest.approx(1.290994, abs=1e-6)
    c = {(r.col_a, r.col_b): r.r for r in ST.corr_matrix(df, ["x", "y"]).collect()}
    assert c[("x", "y")] == pytest.approx(0.981981, abs=1e-6)


def test_transpose_twice_is_identity(spark):
    df = spark.createDataFrame([("Human", "Dev", 0.82), ("Human", "Gen", 0.43), ("Small", "Dev", 0.93),
                                ("Small", "Gen", 0.93)], "scorer string, creator string, score double")
    wide = ST.score_matrix(df, "scorer", "creator", "score", ["Dev", "Gen"])
    back = ST.transpose(ST.transpose(wide, "scorer", "creator", ["Human", "Small"]), "creator", "scorer", ["Dev", "Gen"])
    assert sorted(map(tuple, back.select("scorer", "Dev", "Gen").collect())) == sorted(map(tuple, wide.collect()))


def test_hit_rate(spark):
    df = spark.createDataFrame([(0.9, 0.1), (0.5, 0.95)], "dev double, model double")
    got = {r.creator: r.hit_rate for r in K.hit_rate(df, ["dev", "model"], 0.8).collect()}
    assert got == {"dev": 0.5, "model": 0.5}


def test_exact_median_hot_group_spans_partitions(spark):
    import statistics
    rows = [("hot", float((i * 37) % 1001)) for i in range(2000)] + [("cold", 1.0), ("cold", 4.0), ("cold", 2.0), ("cold", 10.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r.median for r in ST.exact_median(df, ["g"], "v", num_partitions=7).collect()}
    assert got["hot"] == statistics.median([v for g, v in rows if g == "hot"])
    assert got["cold"] == 3.0


def test_line_counts_match_splitlines(spark):
    texts = ["a", "a\n", "a\n\nb", "  # c\nx = 1  # d\n\n", "\n", "def f():\n    pass\n"]
    df = spark.createDataFrame([(x,) for x in texts], "t string")
    got = [r.loc for r in G.code_metrics(df, "t", "").collect()]
    # blank text is a failed side (null metrics), as in the metrics job
    assert got == [len(x.splitlines()) if x.strip() else None for x in texts]


def test_scores_stay_with_their_rows_on_repeated_keys(spark):
    text = "one two three four five"
    df = spark.createDataFrame([(1, text, text), (1, text, "quite other words stand here"), (1, text, text)], "k int, a string, b string")
    assert sorted(r.bleu for r in SIM.bleu(df, ["k"], "a", "b").collect()) == [0.0, 1.0, 1.0]
    scores = SIM.message_scores(df, ["k"], "a", {"m": "b"}, MD.embed_text).collect()
    assert len(scores) == 3 and sorted(round(r.m_score, 6) for r in scores)[1:] == [1.0, 1.0]


def test_correlation_of_a_constant_column_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.0, 5.0), (3.0, None, 5.0)], "x double, y double, c double")
    got = {(r.col_a, r.col_b): r.r for r in ST.corr_matrix(df, ["x", "y", "c"]).collect()}
    assert got["x", "y"] == got["x", "x"] == 1.0 and got["c", "c"] is None and got["x", "c"] is None and len(got) == 9


def test_hit_rate_leaves_out_null_scores(spark):
    df = spark.createDataFrame([(0.9,), (None,)], "s double")
    row = K.hit_rate(df, ["s"], 0.5).first()
    assert row.hit_rate == 1.0 and row.n == 1


def test_median_counts_hot_values_before_the_shuffle(spark):
    df = spark.range(10000).select(F.lit("g").alias("g"), F.when(F.col("id") % 10 == 0, F.col("id").cast("double")).otherwise(7.0).alias("v"))
    assert ST.exact_median(df, ["g"], "v").first()["median"] == 7.0
    plan = df.groupBy("g", "v").count()._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan
    few = spark.createDataFrame([("a", 1.0), ("a", 2.0), (None, 3.0), ("b", None)], "g string, v double")
    assert {r.g: r["median"] for r in ST.exact_median(few, ["g"], "v").collect()} == {"a": 1.5, None: 3.0}


def test_literals_and_comments_are_not_code(spark):
    doc = 'def f(x):\n    """Wait for it and return if done or not"""\n    y = "# no comment and if"\n    return y  # if or and\n'
    row = G.code_metrics(spark.createDataFrame([(doc,)], "s string"), "s", "m_").first()
    assert row.m_cc == 1.0 and row.m_loc == 4


def test_code_metrics_take_a_literal_of_a_million_characters(spark):
    long = "x = '" + "a\\'" * 500_000 + "'\n"
    df = spark.createDataFrame([(1, f'y = "{"b" * 1_000_000}"\nif y > 1: y = 2\n', long)], "k int, before string, after string")
    r = G.code_change_metrics(df).first()
    assert r.error is None and r.loc_change == -1 and r.cc_change == 0.0


def test_metric_patterns_equal_the_plain_ones(spark, capsys):
    import random

    from changelens.operators import codemetrics as G

    operand, binary = r"([A-Za-z_][A-Za-z_0-9]*|[0-9]+(?:\.[0-9]+)?)", r"(?:\*\*|//|==|!=|<=|>=|<<|>>|[+\-*/%<>&|^@])"
    plain = [(G.OPERATOR_RE, r"\*\*|//|==|!=|<=|>=|<<|>>|[+\-*/%<>&|^~@]|\b(?:and|or|not)\b", 0),
             (G.LEFT_OPERAND_RE, operand + r"[ \t]*" + binary, 1), (G.RIGHT_OPERAND_RE, binary + r"[ \t]*" + operand, 1)]
    draw = random.Random(5)
    bits = ["a", "b1", "_x", "9", "1.5", ".", "+", "*", "/", "=", "!", "<", ">", "~", "@", " ", "\t", "\n", "and", "or", "not", "é", "(", ")"]
    df = spark.createDataFrame([("".join(draw.choice(bits) for _ in range(draw.randrange(25))),) for _ in range(3000)], "t string")
    for new, old, group in plain:
        assert df.where(F.regexp_extract_all("t", F.lit(new), group) != F.regexp_extract_all("t", F.lit(old), group)).count() == 0
    binaries = F.regexp_extract_all("t", F.lit(G.OPERATOR_RE), 0)
    for word in G.NOT_BINARY:
        binaries = F.array_remove(binaries, word)
    assert df.where(F.size(binaries) != F.regexp_count("t", F.lit(binary))).count() == 0
    G.code_metrics(df, "t", "m_").select("m_mi").explain(True)
    plan = capsys.readouterr().out.split("== Physical Plan ==")[1]
    assert plan.count("regexp_extract_all") + plan.count("regexp_replace") <= 12  # 15 passes before


def test_native_embedder_scores_changes_in_the_row(spark):
    df = spark.createDataFrame([(1, "a b c", "a b d"), (1, "a b c", "a b c"), (2, None, "a"), (2, "", ""), (None, "x x y", "y x")], "k int, b string, a string")

    def by_text(d, text, out):  # not marked as native: one call per distinct text
        return MD.embed_text(d, text, out)

    native = SIM.change_similarity(df, "b", "a", MD.embed_text, out="s")
    assert "Exchange" not in native._jdf.queryExecution().executedPlan().toString()
    rows = lambda d: sorted(map(str, d.select("k", "b", "a", F.round("s", 9)).collect()))
    assert rows(native) == rows(SIM.change_similarity(df, "b", "a", by_text, out="s"))


def test_bleu_stays_in_the_row_and_equals_plain_counts(spark):
    import random
    from collections import Counter

    from changelens.functions.bleu import TOK13A_PRE, TOK13A_RULES

    def tokens(x):
        for a, b in TOK13A_PRE:
            x = x.replace(a, b)
        x = f" {x} "
        for pat, rep in TOK13A_RULES:
            x = re.sub(pat, rep, x)
        return x.split()

    def score(c, r):
        c, r = tokens(c or ""), tokens(r or "")
        ms = [sum((Counter(zip(*[c[i:] for i in range(n)])) & Counter(zip(*[r[i:] for i in range(n)]))).values()) for n in range(1, 5)]
        if len(c) < 4 or not ms[0]:
            return 0.0
        zeros, logs = 0, 0.0
        for n, m in enumerate(ms):
            zeros += not m
            logs += math.log(m / (len(c) - n) if m else 1 / (2 ** zeros * (len(c) - n)))
        return (1.0 if len(c) >= len(r) else math.exp(1 - len(r) / len(c))) * math.exp(logs / 4)

    draw = random.Random(3)
    bits = ["a", "b", "the ", "é", "1", "23", "-", "-\n", "\n", " ", "\t", ".", ",", "..", ".,", "<skipped>", "&quot;", "&amp;", "(", "\\", "$1", " ", "\x85"]
    text = lambda: None if draw.random() < 0.05 else "".join(draw.choice(bits[:draw.choice([3, 12, 23])]) for _ in range(draw.randrange(60)))
    rows = [(i, text(), text()) for i in range(1500)] + [(1500, "x = 1..2 " * 40, "x = 1.2 " * 50)]
    df = spark.createDataFrame(rows, "k int, a string, b string")
    assert all(r.t == tokens(r.a) for r in df.where("a IS NOT NULL").select("a", tokenize_13a("a").alias("t")).collect())
    scored = SIM.with_bleu(df, "a", "b")
    assert "Exchange" not in scored._jdf.queryExecution().executedPlan().toString()
    got = {r.k: r.bleu for r in scored.collect()}
    assert max(abs(got[k] - score(a, b)) for k, a, b in rows) < 1e-9
    assert scored.where("bleu > 0.5").count() == sum(v > 0.5 for v in got.values())


def test_metric_job_shuffles_nothing(spark):
    from changelens.plans.jobs import change_metrics

    df = spark.createDataFrame([(1, "x = 1\n", "x = 2\ny = x + 1\n"), (1, "x = 1\n", "x = 1\n"), (None, "", "a = 1\n"), (2, None, "b")], "k int, before string, after string")
    m = change_metrics(df)
    assert "Exchange" not in m._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.before or "", r.after, r.error, r.token_similarity == 1.0) for r in m.collect()) == [
        ("", "a = 1\n", "blank source", False), ("", "b", "blank source", False), ("x = 1\n", "x = 1\n", None, False), ("x = 1\n", "x = 2\ny = x + 1\n", None, False)]
    assert m.where("error IS NULL").count() == 2
