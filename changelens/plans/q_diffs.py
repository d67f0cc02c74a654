"""Registered queries: diff comparison (E-3) and line-level operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.paths import path_category
from ..operators import lines as L
from ..operators.stats import status_by_category
from . import views as V
from .registry import register
from .sqlfrag import kind, strip as sql_strip
from .views import sql_lines

def sql_signed(text: str, sign: str) -> str:
    dbl = sign + sign
    return (f"list_transform(list_filter({sql_lines(text)}, lambda x: starts_with(x, '{sign}') AND NOT starts_with(x, '{dbl}')),"
            f" lambda x: {sql_strip('x[2:]')})")


SQL_SQUEEZE = "replace(replace(diff, ' ', ''), chr(10) || chr(10), chr(10))"


def sql_same(a: str, b: str) -> str:
    return f"(list_sort(list_distinct({a})) = list_sort(list_distinct({b})))"


def sql_discrepancy(mode: str = "both") -> str:
    text = SQL_SQUEEZE if mode in ("both", "compat") else "diff"
    if mode == "both":
        h_add = f"list_transform({sql_lines('after')}, lambda x: replace({sql_strip('x')}, ' ', ''))"
        h_del = f"list_transform({sql_lines('before')}, lambda x: replace({sql_strip('x')}, ' ', ''))"
    else:
        h_add = f"list_transform({sql_lines('after')}, lambda x: {sql_strip('x')})"
        h_del = f"list_transform({sql_lines('before')}, lambda x: {sql_strip('x')})"
    return (f"CASE WHEN seq % 6 = 5 THEN 'Error' WHEN {sql_same(sql_signed(text, '+'), h_add)} "
            f"AND {sql_same(sql_signed(text, '-'), h_del)} THEN 'Yes' ELSE 'No' END")


# -- E-3 end to end: discrepancy -> file kind -> (status, kind) counts ----------------------------

@register("diff_discrepancy_report", views=("v_diff",), sql=f"""
SELECT discrepancy, file_type, count(*) AS n FROM (
  SELECT {sql_discrepancy('both')} AS discrepancy, {kind('path')} AS file_type FROM v_diff) d
WHERE discrepancy IN ('Yes', 'No') GROUP BY discrepancy, file_type""")
def diff_discrepancy_report(t):
    """E-3: the flagship query."""
    d = L.discrepancy(V.v_diff(t), "diff", "diff_hist", normalize="both")
    d = d.withColumn("file_type", path_category("path"))
    return status_by_category(d, "discrepancy", "file_type")


@register("discrepancy", views=("v_diff",), sql=f"""
SELECT hash, seq, {sql_discrepancy('both')} AS discrepancy FROM v_diff""")
def discrepancy_q(t):
    """E1 with both renderings normalised."""
    return L.discrepancy(V.v_diff(t), normalize="both").select("hash", "seq", "discrepancy")


@register("discrepancy_compat", views=("v_diff",), sql=f"""
SELECT hash, seq, {sql_discrepancy('compat')} AS discrepancy FROM v_diff""")
def discrepancy_compat_q(t):
    """E1 with the reference's asymmetric whitespace handling."""
    return L.discrepancy(V.v_diff(t), normalize="compat").select("hash", "seq", "discrepancy")


@register("discrepancy_plain", views=("v_diff",), sql=f"""
SELECT hash, seq, {sql_discrepancy('none')} AS discrepancy FROM v_diff""")
def discrepancy_plain_q(t):
    """E1 on stripped lines as they are."""
    return L.discrepancy(V.v_diff(t), normalize="none").select("hash", "seq", "discrepancy")


@register("status_by_category", views=("v_diff",), sql=f"""
SELECT discrepancy, file_type, count(*) AS n FROM (
  SELECT {sql_discrepancy('compat')} AS discrepancy, {kind('path')} AS file_type FROM v_diff) d
WHERE discrepancy IN ('Yes', 'No') GROUP BY discrepancy, file_type""")
def status_by_category_q(t):
    """A13 over the reference-compatible discrepancy."""
    d = L.discrepancy(V.v_diff(t), normalize="compat").withColumn("file_type", path_category("path"))
    return status_by_category(d)


@register("status_filter", views=("v_diff",), sql=f"""
SELECT hash, seq, discrepancy FROM (SELECT hash, seq, {sql_discrepancy('both')} AS discrepancy FROM v_diff) d
WHERE discrepancy IN ('Yes', 'No')""")
def status_filter_q(t):
    """Drop Error rows before counting."""
    d = L.discrepancy(V.v_diff(t), normalize="both")
    return d.where(F.col("discrepancy").isin("Yes", "No")).select("hash", "seq", "discrepancy")


@register("path_category", views=("v_change",), sql=f"""
SELECT hash, seq, {kind('path')} AS file_type FROM v_change""")
def path_category_q(t):
    """P18."""
    return V.v_change(t).select("hash", "seq", path_category("path").alias("file_type"))


@register("diff_line_split", views=("v_diff",), sql=f"""
SELECT hash, seq, len(a) AS n_added, len(d) AS n_deleted,
       array_to_string(a, chr(10)) AS added_text, array_to_string(d, chr(10)) AS deleted_text
FROM (SELECT hash, seq, {sql_signed('diff', '+')} AS a, {sql_signed('diff', '-')} AS d FROM v_diff) s""")
def diff_line_split_q(t):
    """Added / deleted lines of each diff."""
    d = L.diff_line_split(V.v_diff(t), "diff")
    return d.select("hash", "seq", F.size("added").alias("n_added"), F.size("deleted").alias("n_deleted"),
                    F.array_join("added", "\n").alias("added_text"),
                    F.array_join("deleted", "\n").alias("deleted_text"))
