from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from changelens.functions import paths as P
from changelens.functions import text as T
from changelens.operators import messages as M


def col_values(df, c):
    if isinstance(c, int):
        return [r[c] for r in df.collect()]
    return [r[0] for r in df.select(c).collect()]


def test_keyword_filter_normalises_line_breaks(spark):
    df = spark.createDataFrame([(1, "Add exception docs"), (2, "change colour"), (3, "fall\nback to v1"),
                                (4, "new feature")], "id int, message string")
    kept = sorted(col_values(M.keyword_any_filter(df), "id"))
    assert kept == [1, 2, 3]
    draft = sorted(col_values(M.keyword_any_filter(df, normalize=False), "id"))
    assert draft == [1, 2]


def test_merge_flag_and_first_parent(spark):
    df = spark.createDataFrame([([],), (["a"],), (["a", "b"],)], "parents array<string>")
    r = df.select(P.merge_flag("parents").alias("m"), P.first_parent("parents").alias("p")).collect()
    assert [x.m for x in r] == ["N", "N", "Y"]
    assert [x.p for x in r] == [None, "a", "a"]


def test_path_coalesce(spark):
    df = spark.createDataFrame([("x", "y"), ("", "y"), (None, "y"), (None, "")], "n string, o string")
    assert col_values(df.select(P.path_coalesce("n", "o")), 0) == ["x", "y", "y", None]


def test_path_category(spark):
    df = spark.createDataFrame([(None,), ("src/latest.py",), ("README.md",), ("docs/license_test.txt",),
                                ("LICENSE",), ("a.py",)], "p string")
    assert col_values(df.select(P.path_category("p")), 0) == ["Unknown", "Test", "README", "Test", "LICENSE", "Source"]


def test_path_extension(spark):
    df = spark.createDataFrame([("a.tar.gz",), ("Makefile",), ("x.",)], "p string")
    assert col_values(df.select(P.path_extension("p")), 0) == ["gz", "Makefile", ""]


def test_first_token(spark):
    df = spark.createDataFrame([(" fix it",), ("  ",), ("add x",)], "t string")
    assert col_values(df.select(T.first_token("t")), 0) == ["fix", None, "add"]


def test_newline_unescape(spark):
    df = spark.createDataFrame([("a\\nb",), (None,)], "t string")
    assert col_values(df.select(T.unescape_newlines("t")), 0) == ["a\nb", ""]


def test_squeeze_and_preview(spark):
    df = spark.createDataFrame([("a\n\n\nb",)], "t string")
    assert col_values(df.select(T.squeeze_diff("t")), 0) == ["a\n\nb"]
    df = spark.createDataFrame([("abcdef",), ("abc",)], "t string")
    assert col_values(df.select(T.preview("t", 3)), 0) == ["abc...", "abc"]


def test_model_text_cleanup(spark):
    df = spark.createDataFrame([("Create a new commit message: \n\n fix x \nmore",), ("  plain  ",)], "t string")
    assert col_values(df.select(T.model_text_cleanup("t")), 0) == ["fix x", "plain"]


def test_lines_matches_python_splitlines(spark):
    samples = ["", "\n", "a", "a\n", "a\n\n", "a\r\nb\rc\n", "\n\nx"]
    df = spark.createDataFrame([(s,) for s in samples], "t string")
    got = col_values(df.select(T.lines("t")), 0)
    assert got == [s.splitlines() for s in samples]


@settings(max_examples=8, deadline=None)
@given(st.text(alphabet=st.characters(blacklist_characters="\\", blacklist_categories=("Cs",)), max_size=40))
def test_escape_unescape_identity(spark, s):
    df = spark.createDataFrame([(s,)], "t string")
    assert df.select(T.unescape_newlines(T.escape_newlines("t"))).first()[0] == s


def test_white_space_and_line_ends_are_pythons(spark):
    spaces = [chr(i) for i in range(0x3001) if chr(i).isspace()]
    ends = [chr(i) for i in range(0x3001) if len(f"a{chr(i)}b".splitlines()) == 2]
    texts = [f"{c}a{c}{c}b{c}" for c in dict.fromkeys([*spaces, *ends, "\u200b", "x"])] + ["a\r\nb", "\r\n", "", "a\x0cb\x0bc\x85"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", T.strip_ws("t").alias("s"), T.whitespace_tokens("t").alias("w"), T.lines("t").alias("l"), T.is_blank("t").alias("b"),
                    T.first_token("t").alias("f")).collect()
    for r in got:
        assert (r.s, r.w, r.l, r.b, r.f) == (r.t.strip(), r.t.split(), r.t.splitlines(), not r.t.strip(), (r.t.split() or [None])[0]), repr(r.t)
