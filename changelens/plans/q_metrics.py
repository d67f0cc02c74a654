"""Registered queries: code metrics, descriptive statistics and reshapes."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from ..operators import classify as K
from ..operators import codeblocks as CB
from ..operators import codemetrics as G
from ..operators import moments as MO
from ..operators import rows as R
from ..operators import stats as ST
from ..session import scratch_path
from . import views as V
from .registry import register
from .sqlfrag import strip
from .views import sql_lines

# ---------------------------------------------------------------- code metrics (SQL mirrors)
# The oracle's own patterns, in its regex syntax; the test sources have no string literals.
_SQL_BLOCK = "(?m)^[ \\t]*(async[ \\t]+)?(def|class)[ \\t]"
_SQL_DECISION = "\\b(if|elif|for|while|except|and|or)\\b"
_SQL_OPERATOR = "[*][*]|//|==|!=|<=|>=|<<|>>|[-+*/%<>&|^~@]|\\b(and|or|not)\\b"
_SQL_NAME = "([A-Za-z_][A-Za-z_0-9]*|[0-9]+(?:[.][0-9]+)?)"
_SQL_BINARY = "([*][*]|//|==|!=|<=|>=|<<|>>|[-+*/%<>&|^@])"
_SQL_ONE_LINE = "(?m)^[ \\t]*(if|elif|else|for|while|with|try|except|finally)\\b[^\\n#]*:[ \\t]*[^ \\t\\n#]"


def _rc(x: str, pat: str) -> str:
    return f"len(regexp_extract_all({x}, '{pat}'))"


def sql_code_only(x: str) -> str:
    return f"regexp_replace({x}, '#[^\\n]*', '', 'g')"


def sql_loc(x: str) -> str:
    return f"len({sql_lines(x)})"


def sql_sloc(x: str) -> str:
    ls = sql_lines(x)
    return (f"({sql_loc(x)} - len(list_filter({ls}, lambda l: length(trim(l)) = 0))"
            f" - len(list_filter({ls}, lambda l: starts_with(ltrim(l), '#'))))")


def sql_lloc(x: str) -> str:
    return f"({sql_sloc(x)} + {_rc(sql_code_only(x), _SQL_ONE_LINE)})"


def sql_total_cc(x: str) -> str:
    return f"({_rc(x, _SQL_BLOCK)} + {_rc(sql_code_only(x), _SQL_DECISION)})"


def sql_avg_cc(x: str) -> str:
    return f"(CASE WHEN {_rc(x, _SQL_BLOCK)} = 0 THEN 0.0 ELSE {sql_total_cc(x)} / {_rc(x, _SQL_BLOCK)} END)"


def sql_volume(x: str) -> str:
    code = sql_code_only(x)
    ops = f"regexp_extract_all({code}, '{_SQL_OPERATOR}')"
    operands = (f"list_concat(regexp_extract_all({code}, '{_SQL_NAME}[ \\t]*{_SQL_BINARY}', 1), "
                f"regexp_extract_all({code}, '{_SQL_BINARY}[ \\t]*{_SQL_NAME}', 2))")
    eta = f"(len(list_distinct({ops})) + len(list_distinct({operands})))"
    n = f"(len({ops}) + 2 * {_rc(code, _SQL_BINARY)})"
    return f"(CASE WHEN {eta} > 0 THEN {n} * log2({eta}) ELSE 0.0 END)"


def sql_mi(x: str) -> str:
    v, ll, sl = sql_volume(x), sql_lloc(x), sql_sloc(x)
    cl = f"len(list_filter({sql_lines(x)}, lambda l: contains(l, '#')))"
    pct = f"(CASE WHEN {sl} > 0 THEN {cl} * 100.0 / {sl} ELSE 0.0 END)"
    raw = f"(171 - 5.2 * ln({v}) - 0.23 * {sql_total_cc(x)} - 16.2 * ln({ll}) + 50 * sin(sqrt(2.46 * radians({pct}))))"
    return f"(CASE WHEN {v} <= 0 OR {ll} <= 0 THEN 100.0 ELSE least(greatest({raw} * 100.0 / 171.0, 0.0), 100.0) END)"


def sql_blank(x: str) -> str:
    return f"(length({strip(f"coalesce({x}, '')")}) = 0)"


def _when_ok(x: str, e: str) -> str:
    return f"CASE WHEN {sql_blank(x)} THEN NULL ELSE {e} END"


@register("loc", views=("v_code",), sql=f"""
SELECT hash, {_when_ok('before', sql_loc('before'))} AS loc_before, {_when_ok('after', sql_loc('after'))} AS loc_after FROM v_code""")
def loc_q(t):
    """G1."""
    m = G.code_metrics(G.code_metrics(V.v_code(t), "before", "b_"), "after", "a_")
    return m.select("hash", F.col("b_loc").alias("loc_before"), F.col("a_loc").alias("loc_after"))


@register("avg_complexity", views=("v_code",), sql=f"""
SELECT hash, round({_when_ok('before', sql_avg_cc('before'))}, 6) AS cc_before,
       round({_when_ok('after', sql_avg_cc('after'))}, 6) AS cc_after FROM v_code""")
def avg_complexity_q(t):
    """G2 (lexical)."""
    m = G.code_metrics(G.code_metrics(V.v_code(t), "before", "b_"), "after", "a_")
    return m.select("hash", F.round("b_cc", 6).alias("cc_before"), F.round("a_cc", 6).alias("cc_after"))


@register("maintainability_index", views=("v_code",), sql=f"""
SELECT hash, round({_when_ok('before', sql_mi('before'))}, 6) AS mi_before,
       round({_when_ok('after', sql_mi('after'))}, 6) AS mi_after FROM v_code""")
def maintainability_index_q(t):
    """G3 (lexical Halstead volume)."""
    m = G.code_metrics(G.code_metrics(V.v_code(t), "before", "b_"), "after", "a_")
    return m.select("hash", F.round("b_mi", 6).alias("mi_before"), F.round("a_mi", 6).alias("mi_after"))


_G4_SQL = f"""
SELECT hash, CASE WHEN ok THEN round({sql_mi('after')} - {sql_mi('before')}, 6) END AS mi_change,
       CASE WHEN ok THEN round({sql_avg_cc('after')} - {sql_avg_cc('before')}, 6) END AS cc_change,
       CASE WHEN ok THEN CAST({sql_loc('after')} - {sql_loc('before')} AS INTEGER) END AS loc_change,
       CASE WHEN ok THEN NULL ELSE 'blank source' END AS error
FROM (SELECT *, NOT ({sql_blank('before')} OR {sql_blank('after')}) AS ok FROM v_code) s"""


def _g4(t):
    m = G.code_change_metrics(V.v_code(t))
    return m.select("hash", F.round("mi_change", 6).alias("mi_change"), F.round("cc_change", 6).alias("cc_change"),
                    "loc_change", "error")


@register("code_change_metrics", views=("v_code",), sql=_G4_SQL)
def code_change_metrics_q(t):
    """Deltas of the three metrics; blank sides become failed rows."""
    return _g4(t)


@register("metric_delta", views=("v_code",), sql=f"""
SELECT hash, {sql_loc('after')} - {sql_loc('before')} AS loc_change, length(after) - length(before) AS chars_change FROM v_code""")
def metric_delta_q(t):
    """After - before."""
    c = V.v_code(t).select("hash", G.loc("before").alias("loc_before"), G.loc("after").alias("loc_after"),
                           F.length("before").alias("chars_before"), F.length("after").alias("chars_after"))
    return K.metric_delta(c, ["loc", "chars"]).select("hash", "loc_change", "chars_change")


@register("first_n_successful", views=("v_code",), sql=f"""
SELECT hash, CASE WHEN rk <= 120 THEN mi_change END AS mi_change, CASE WHEN rk <= 120 THEN loc_change END AS loc_change,
       coalesce(rk <= 120, false) AS processed
FROM (SELECT *, CASE WHEN error IS NULL THEN row_number() OVER (PARTITION BY error IS NULL ORDER BY hash) END AS rk
      FROM ({_G4_SQL}) g) s""")
def first_n_successful_q(t):
    """L3: metrics of the first 120 successful rows in key order, measured in batches until there are enough; all rows returned."""
    r = R.first_n_measured(V.v_code(t), G.code_change_metrics, 120, ["hash"], "error", ["mi_change", "loc_change"])
    return r.select("hash", F.round("mi_change", 6).alias("mi_change"), "loc_change", "processed")


@register("code_blocks", sql="""
SELECT l_orderkey AS hash, 'C' || l_orderkey AS name, 'class' AS kind, 0 AS depth, 1 AS n_lines, 1 AS complexity FROM lineitem GROUP BY l_orderkey
UNION ALL
SELECT l_orderkey, 'm' || l_linenumber, 'method', 1, CASE l_linenumber % 3 WHEN 1 THEN 2 ELSE 4 END, CASE l_linenumber % 3 WHEN 0 THEN 4 ELSE 1 END FROM lineitem
UNION ALL
SELECT l_orderkey, 'inner' || l_linenumber, 'function', 2, 3, 2 FROM lineitem WHERE l_linenumber % 3 = 1""")
def code_blocks_q(t):
    """G2 by block: every class, method and inner function of one source text an order."""
    return CB.code_blocks(V.v_nested(t), ["hash"], "source").select("hash", "name", "kind", "depth", "n_lines", "complexity")


@register("block_complexity", sql="""
SELECT l_orderkey AS hash, 1 + count(*) + count(*) FILTER (l_linenumber % 3 = 1) AS n_blocks,
       round((1 + sum(CASE l_linenumber % 3 WHEN 0 THEN 4 WHEN 1 THEN 3 ELSE 1 END)) / (1 + count(*) + count(*) FILTER (l_linenumber % 3 = 1)), 6) AS mean_complexity,
       CASE WHEN bool_or(l_linenumber % 3 = 0) THEN 4 WHEN bool_or(l_linenumber % 3 = 1) THEN 2 ELSE 1 END AS most_complexity
FROM lineitem GROUP BY l_orderkey""")
def block_complexity_q(t):
    """Mean complexity over the blocks of every source text, nested ones apart."""
    b = CB.block_complexity(V.v_nested(t), ["hash"], "source")
    return b.withColumn("mean_complexity", F.round("mean_complexity", 6))


# ---------------------------------------------------------------- descriptive statistics


@register("row_count", sql="SELECT count(*) AS n_rows FROM lineitem")
def row_count_q(t):
    """A1."""
    return ST.row_count(t.lineitem)


@register("distinct_count", sql="""
SELECT count(DISTINCT l_orderkey) AS distinct_l_orderkey, count(DISTINCT l_partkey) AS distinct_l_partkey FROM lineitem""")
def distinct_count_q(t):
    """A2."""
    return ST.distinct_count(t.lineitem, ["l_orderkey", "l_partkey"])


@register("avg_group_size", sql="""
SELECT avg(n) AS avg_group_size FROM (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey IS NOT NULL GROUP BY l_orderkey) s""")
def avg_group_size_q(t):
    """A3: mean number of files per commit."""
    return ST.avg_group_size(t.lineitem, "l_orderkey")


@register("value_counts", sql="""
SELECT event_type AS value, count(*) AS count FROM events WHERE event_type IS NOT NULL GROUP BY event_type""")
def value_counts_q(t):
    """A4."""
    return ST.value_counts(t.events, "event_type")


@register("mean", sql="SELECT event_type, round(avg(value), 6) AS mean_value FROM events GROUP BY event_type")
def mean_q(t):
    """A5."""
    return t.events.groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean_value"))


@register("median", sql="SELECT event_type, round(median(value), 6) AS median_value FROM events GROUP BY event_type")
def median_q(t):
    """Exact interpolated median, distributed (no group held in one task)."""
    m = ST.exact_median(t.events, ["event_type"], "value", out="median_value")
    return m.select("event_type", F.round("median_value", 6).alias("median_value"))


@register("std", sql="SELECT event_type, round(stddev_samp(value), 6) AS std_value FROM events GROUP BY event_type")
def std_q(t):
    """A7 (sample, n - 1)."""
    return t.events.groupBy("event_type").agg(F.round(F.stddev_samp("value"), 6).alias("std_value"))


@register("min_max_range", sql="""
SELECT l_returnflag, min(l_quantity) AS min_qty, max(l_quantity) AS max_qty, max(l_quantity) - min(l_quantity) AS range_qty
FROM lineitem GROUP BY l_returnflag""")
def min_max_range_q(t):
    """A8."""
    return t.lineitem.groupBy("l_returnflag").agg(F.min("l_quantity").alias("min_qty"), F.max("l_quantity").alias("max_qty"),
                                                  (F.max("l_quantity") - F.min("l_quantity")).alias("range_qty"))


_CORR_COLS = ["l_quantity", "l_discount", "l_tax", "fixed"]


@register("corr_matrix", sql="WITH x AS (SELECT *, 1.0 AS fixed FROM lineitem) " + " UNION ALL ".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(covar_samp({a}, {b}) / nullif(stddev_samp({a}) * stddev_samp({b}), 0), 6) AS r FROM x"
    for a in _CORR_COLS for b in _CORR_COLS))
def corr_matrix_q(t):
    """Full pairwise Pearson matrix in long form, one column being constant."""
    return ST.corr_matrix(t.lineitem.withColumn("fixed", F.lit(1.0)), _CORR_COLS)


@register("max_length", sql="SELECT max(length(text)) AS max_len_text FROM documents")
def max_length_q(t):
    """A10."""
    return ST.max_length(t.documents, ["text"])


_SUM_COLS = ["l_quantity", "l_discount", "l_tax"]


@register("multi_metric_summary", sql=" UNION ALL ".join(
    f"SELECT '{m}' AS metric, count({m}) AS n, round(avg({m}), 6) AS mean, round(median({m}), 6) AS median, "
    f"round(stddev_samp({m}), 6) AS std, round(min({m}), 6) AS min, round(max({m}), 6) AS max, "
    f"round(max({m}) - min({m}), 6) AS range FROM lineitem" for m in _SUM_COLS))
def multi_metric_summary_q(t):
    """Mean / median / std / min / max / range of several measures in one grouped pass."""
    return ST.summary(t.lineitem, _SUM_COLS)


def _recorded(t):
    """Moments of five batches of line items, recorded one by one and merged."""
    path = scratch_path(t.spark, "moments")
    for i in range(5):
        MO.record_batch(t.lineitem.where(F.col("l_orderkey") % 5 == i), path, str(i), _SUM_COLS, ["l_returnflag"])
    return MO.recorded(t.spark, path, ["l_returnflag"])


@register("merged_summary", sql=" UNION ALL ".join(
    f"SELECT l_returnflag, '{m}' AS name, count({m}) AS n, round(avg({m}), 4) AS mean, round(stddev_samp({m}), 4) AS std, "
    f"round(min({m}), 4) AS low, round(max({m}), 4) AS high FROM lineitem GROUP BY l_returnflag" for m in _SUM_COLS))
def merged_summary_q(t):
    """A summary put together from the moments of batches, without their rows."""
    s = MO.summary(_recorded(t), ["l_returnflag"])
    return s.select("l_returnflag", "name", "n", *[F.round(c, 4).alias(c) for c in ("mean", "std", "low", "high")])


@register("merged_correlations", sql=" UNION ALL ".join(
    f"SELECT l_returnflag, '{a}' AS a, '{b}' AS b, count(*) AS n, round(corr({a}, {b}), 6) AS corr FROM lineitem GROUP BY l_returnflag"
    for a, b in combinations(_SUM_COLS, 2)))
def merged_correlations_q(t):
    """Correlations put together from the co-moments of batches."""
    return MO.correlations(_recorded(t), ["l_returnflag"]).withColumn("corr", F.round("corr", 6))


# ---------------------------------------------------------------- reshape

_PRIOS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
_STATUS = ["F", "O", "P"]
_CELL = "SELECT o_orderstatus, o_orderpriority, round(avg(o_totalprice), 2) AS v FROM orders GROUP BY ALL"


def _cells(t):
    return t.orders.groupBy("o_orderstatus", "o_orderpriority").agg(F.round(F.avg("o_totalprice"), 2).alias("v"))


@register("score_matrix", sql="SELECT o_orderstatus, " + ", ".join(
    f"first(v) FILTER (WHERE o_orderpriority = '{p}') AS \"{p}\"" for p in _PRIOS) + f" FROM ({_CELL}) c GROUP BY o_orderstatus")
def score_matrix_q(t):
    """Status x priority matrix of mean order value (fixed pivot values)."""
    return ST.score_matrix(_cells(t), "o_orderstatus", "o_orderpriority", "v", _PRIOS)


@register("transpose", sql="SELECT o_orderpriority, " + ", ".join(
    f"first(v) FILTER (WHERE o_orderstatus = '{s}') AS \"{s}\"" for s in _STATUS) + f" FROM ({_CELL}) c GROUP BY o_orderpriority")
def transpose_q(t):
    """R2: the R1 matrix with axes swapped."""
    wide = ST.score_matrix(_cells(t), "o_orderstatus", "o_orderpriority", "v", _PRIOS)
    return ST.transpose(wide, "o_orderstatus", "o_orderpriority", _STATUS)


@register("melt_metrics", sql="""
SELECT l_orderkey, l_linenumber, 'l_quantity' AS metric, l_quantity AS value FROM lineitem
UNION ALL SELECT l_orderkey, l_linenumber, 'l_discount', l_discount FROM lineitem""")
def melt_metrics_q(t):
    """R3."""
    return ST.melt(t.lineitem, ["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount"])
