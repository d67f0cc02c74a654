"""Registered queries: file state along first-parent history, and alignment of versions."""

from __future__ import annotations

from ..operators import alignment as A
from ..operators import history as H
from . import views as V
from .registry import register
from .views import sql_lines

_WALK = """
WITH RECURSIVE walk(hash, path, above) AS (
  SELECT v.hash, v.path, b.parent FROM v_version v JOIN v_branch b ON b.hash = v.hash
  UNION ALL
  SELECT w.hash, w.path, b.parent FROM walk w JOIN v_branch b ON b.hash = w.above
  WHERE NOT EXISTS (SELECT 1 FROM v_version v WHERE v.hash = w.above AND v.path = w.path)),
found AS (SELECT w.hash, w.path, w.above AS before_commit, v.content AS before FROM walk w JOIN v_version v ON v.hash = w.above AND v.path = w.path)
"""


@register("before_after_state", views=("v_branch", "v_version"), sql=_WALK + """
SELECT c.hash, c.path, f.before_commit, coalesce(f.before, '') AS before, coalesce(c.content, '') AS after
FROM v_version c LEFT JOIN found f ON f.hash = c.hash AND f.path = c.path""")
def before_after_state_q(t):
    """J4 as of the first parent: every changed file with its state there and its new text."""
    v = V.v_version(t)
    return H.before_after_state(v.select("hash", "path"), v, V.v_branch(t), ["path"])


@register("before_after_state_inner", views=("v_branch", "v_version"), sql=_WALK + """
SELECT c.hash, c.path, f.before_commit, f.before, c.content AS after
FROM v_version c JOIN found f ON f.hash = c.hash AND f.path = c.path WHERE c.content IS NOT NULL AND f.before IS NOT NULL""")
def before_after_state_inner_q(t):
    """J4 as of the first parent, rows without a text on either side left out."""
    v = V.v_version(t)
    return H.before_after_state(v.select("hash", "path"), v, V.v_branch(t), ["path"], how="inner")


def _alignment_sql(rounds: int = 2) -> str:
    """Anchors, blocks, a fold for the heaviest run and a walk back along it, once per round; then multisets."""
    keys, sql = ["doc_id"], f"""
WITH RECURSIVE l0 AS (
  SELECT doc_id, 'deleted' AS side, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS no FROM (SELECT doc_id, {sql_lines("before")} AS ls FROM v_edit)
  UNION ALL
  SELECT doc_id, 'added', unnest(ls), unnest(range(1, len(ls) + 1)) FROM (SELECT doc_id, {sql_lines("after")} AS ls FROM v_edit))"""
    for r in range(rounds):
        k = ", ".join(keys)
        same = " AND ".join(f"c.{x} = e.{x}" for x in keys)
        sql += f""",
u{r} AS (SELECT {k}, min(no) FILTER (side = 'deleted') AS o, min(no) FILTER (side = 'added') AS n FROM l{r} GROUP BY {k}, line
         HAVING count(*) FILTER (side = 'deleted') = 1 AND count(*) FILTER (side = 'added') = 1),
r{r} AS (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY n) AS v, row_number() OVER (PARTITION BY {k} ORDER BY o) AS q FROM u{r}),
b{r} AS MATERIALIZED (SELECT *, sum(st) OVER (PARTITION BY {k} ORDER BY o) AS block FROM
         (SELECT *, CASE WHEN v - q = lag(v - q) OVER (PARTITION BY {k} ORDER BY o) THEN 0 ELSE 1 END AS st FROM r{r})),
f{r} AS MATERIALIZED (SELECT {k}, unnest(list_reduce(list_prepend([]::STRUCT(block BIGINT, v BIGINT, w BIGINT, f BIGINT)[], list(
           [{{'block': block::BIGINT, 'v': v::BIGINT, 'w': w::BIGINT, 'f': 0::BIGINT}}] ORDER BY block)),
           lambda a, x: list_append(a, {{'block': x[1].block, 'v': x[1].v, 'w': x[1].w, 'f': x[1].w + coalesce(list_max(
             list_transform(list_filter(a, lambda y: y.v < x[1].v), lambda y: y.f)), 0)}})), recursive := true)
         FROM (SELECT {k}, block, min(v) AS v, count(*) AS w FROM b{r} GROUP BY {k}, block) GROUP BY {k}),
c{r} AS (SELECT {k}, block, f - w AS need, v FROM (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY f DESC, block DESC) AS q FROM f{r}) WHERE q = 1
         UNION ALL
         SELECT {k}, block, f - w, v FROM (SELECT e.*, row_number() OVER (PARTITION BY {", ".join(f"e.{x}" for x in keys)} ORDER BY e.block DESC) AS q
                                           FROM c{r} c JOIN f{r} e ON {same} AND e.f = c.need AND e.v < c.v AND e.block < c.block) WHERE q = 1),
k{r} AS (SELECT {k}, o, n FROM b{r} SEMI JOIN c{r} USING ({k}, block)),
s{r} AS (SELECT {k}, 'deleted' AS side, o AS no, o FROM k{r} UNION ALL SELECT {k}, 'added', n, o FROM k{r}),
l{r + 1} AS MATERIALIZED (SELECT c.*, coalesce(e.o, 0) AS g{r} FROM (SELECT * FROM l{r} ANTI JOIN s{r} USING ({k}, side, no)) c
         ASOF LEFT JOIN s{r} e ON {same} AND c.side = e.side AND c.no >= e.no)"""
        keys.append(f"g{r}")
    return sql + f""",
m AS (SELECT doc_id, side, no, line FROM (
  SELECT *, row_number() OVER (PARTITION BY {", ".join(keys)}, line, side ORDER BY no) AS nth,
         count(*) FILTER (side = 'deleted') OVER w AS d, count(*) FILTER (side = 'added') OVER w AS a
  FROM l{rounds} WINDOW w AS (PARTITION BY {", ".join(keys)}, line)) WHERE nth > least(d, a))
SELECT doc_id, side, no AS line_no, line, row_number() OVER (PARTITION BY doc_id, line, side ORDER BY no)
       <= least(count(*) FILTER (side = 'deleted') OVER w, count(*) FILTER (side = 'added') OVER w) AS moved
FROM m WINDOW w AS (PARTITION BY doc_id, line)"""


@register("line_alignment", views=("v_edit",), sql=_alignment_sql())
def line_alignment_q(t):
    """E3 in order: deleted, added and moved lines of every edited document."""
    return A.line_alignment(V.v_edit(t), ["doc_id"]).drop("below")
