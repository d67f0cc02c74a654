"""Registered queries: flattening, re-nesting, joins, set operations, ordered rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import changes as C
from ..operators import lines as L
from ..operators import rows as R
from . import sqlfrag as S
from . import views as V
from .registry import register
from .views import sql_lines


@register("explode_files", views=("v_file",), sql="""
SELECT hash, row_number() OVER (PARTITION BY hash ORDER BY path) - 1 AS file_pos, path FROM v_file""")
def explode_files_q(t):
    """commits with their file lists, flattened back to one row per file."""
    return C.explode_files(C.collect_files(V.v_file(t), "hash", "path"), "files", "file_pos", "path")


@register("collect_files", views=("v_file",), sql="""
SELECT hash, count(*) AS n_files, string_agg(path, '|' ORDER BY path) AS files FROM v_file GROUP BY hash""")
def collect_files_q(t):
    """F2."""
    f = C.collect_files(V.v_file(t), "hash", "path")
    return f.select("hash", F.size("files").alias("n_files"), F.array_join("files", "|").alias("files"))


@register("hunk_split", views=("v_diff",), sql="""
SELECT hash, seq, i - 1 AS hunk_no, md5(arr[i]) AS hunk_md5, length(arr[i]) AS hunk_len FROM (
  SELECT hash, seq, arr, unnest(generate_series(1, len(arr))) AS i FROM (
    SELECT hash, seq, regexp_split_to_array(diff, '\\n@@ .* @@\\n') AS arr FROM v_diff) a) b""")
def hunk_split_q(t):
    """F3."""
    h = C.hunk_split(V.v_diff(t), ["hash", "seq"], "diff")
    return h.select("hash", "seq", "hunk_no", F.md5("hunk").alias("hunk_md5"), F.length("hunk").alias("hunk_len"))


@register("ordered_join_text", sql="""
SELECT conv_id, string_agg(role, '; ' ORDER BY turn) AS joined FROM conversations GROUP BY conv_id""")
def ordered_join_text_q(t):
    """per conversation, roles joined in turn order."""
    return C.ordered_join_text(t.conversations, ["conv_id"], "turn", "role")


@register("explode_lines", sql=f"""
SELECT doc_id, i - 1 AS line_no, ls[i] AS line FROM (
  SELECT doc_id, ls, unnest(generate_series(1, len(ls))) AS i FROM (
    SELECT doc_id, {sql_lines('text')} AS ls FROM documents) a) b""")
def explode_lines_q(t):
    """F5."""
    return C.explode_lines(t.documents, ["doc_id"], "text")


@register("change_message_join", sql="""
SELECT l.l_orderkey, l.l_partkey, l.l_linenumber, r.l_linenumber AS r_linenumber
FROM lineitem l JOIN lineitem r ON l.l_orderkey = r.l_orderkey AND l.l_partkey = r.l_partkey""")
def change_message_join_q(t):
    """Duplicate keys multiply, as in the reference's merge."""
    left = t.lineitem.select("l_orderkey", "l_partkey", "l_linenumber")
    right = t.lineitem.select("l_orderkey", "l_partkey", F.col("l_linenumber").alias("r_linenumber"))
    return C.change_message_join(left, right, ["l_orderkey", "l_partkey"], ["r_linenumber"])


@register("change_message_join_null_safe", views=("v_change",), sql="""
SELECT l.hash, l.seq, r.seq AS r_seq FROM v_change l JOIN v_change r ON l.hash = r.hash AND l.path IS NOT DISTINCT FROM r.path""")
def change_message_join_null_safe_q(t):
    """J1 where a missing path matches a missing path."""
    c = V.v_change(t).select("hash", "seq", "path")
    return C.change_message_join(c, c.withColumnRenamed("seq", "r_seq"), ["hash", "path"], ["r_seq"], null_safe=True).select("hash", "seq", "r_seq")


_DONE_SQL = "SELECT f.hash, f.path FROM v_file f JOIN v_commit c ON c.hash = f.hash WHERE c.committed_at < TIMESTAMP '1998-01-01'"


def _done(t):
    c = V.v_commit(t).where(F.col("committed_at") < F.lit("1998-01-01").cast("timestamp_ntz")).select("hash")
    return V.v_file(t).join(c, "hash", "left_semi").select("hash", "path")


@register("done_anti_join", views=("v_file", "v_commit"), sql=f"""
SELECT hash, path, file_pos FROM v_file n
WHERE NOT EXISTS (SELECT 1 FROM ({_DONE_SQL}) d WHERE d.hash = n.hash AND d.path = n.path)""")
def done_anti_join_q(t):
    """File changes not yet written by an earlier run."""
    return C.done_anti_join(V.v_file(t), _done(t), ["hash", "path"]).select("hash", "path", "file_pos")


@register("hash_semi_join", sql="""
SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)""")
def hash_semi_join_q(t):
    """J3."""
    return C.hash_semi_join(t.documents, t.labels, "doc_id").select("doc_id", "lang")


def _before_after(t, how):
    conv = t.conversations
    changes = conv.select("conv_id", "turn", (F.col("turn") - 1).alias("parent_turn"))
    versions = conv.select("conv_id", "turn", F.col("text").alias("content"))
    r = C.before_after_join(changes, versions, ["conv_id"], "turn", "parent_turn", "content", how=how)
    return r.select("conv_id", "turn", F.length("before").alias("before_len"), F.md5("after").alias("after_md5"))


@register("before_after_join", sql="""
SELECT c.conv_id, c.turn, length(p.text) AS before_len, md5(c.text) AS after_md5
FROM conversations c JOIN conversations p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1""")
def before_after_join_q(t):
    """J4, inner (draft miner: root commits vanish)."""
    return _before_after(t, "inner")


@register("before_after_join_outer", sql="""
SELECT c.conv_id, c.turn, length(coalesce(p.text, '')) AS before_len, md5(c.text) AS after_md5
FROM conversations c LEFT JOIN conversations p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1""")
def before_after_join_outer_q(t):
    """J4, outer (final miner: a missing side becomes '')."""
    return _before_after(t, "outer")


@register("processed_key_set", views=("v_file",), sql="SELECT DISTINCT hash, path FROM v_file")
def processed_key_set_q(t):
    """E2."""
    return V.v_file(t).select("hash", "path").distinct()


@register("line_delta", views=("v_change",), sql=f"""
SELECT hash, seq, 'added' AS side, line FROM (
  SELECT hash, seq, unnest({sql_lines('after')}) AS line FROM v_change
  EXCEPT ALL
  SELECT hash, seq, unnest({sql_lines('before')}) AS line FROM v_change) a
UNION ALL
SELECT hash, seq, 'deleted' AS side, line FROM (
  SELECT hash, seq, unnest({sql_lines('before')}) AS line FROM v_change
  EXCEPT ALL
  SELECT hash, seq, unnest({sql_lines('after')}) AS line FROM v_change) d""")
def line_delta_q(t):
    """Multiset line difference both ways."""
    return L.line_delta(V.v_change(t), ["hash", "seq"])


@register("changed_files", sql="""
WITH c AS (SELECT conv_id, turn // 2 AS snap, 'turn' || (turn % 2) AS path, text FROM conversations),
o AS (SELECT conv_id, snap + 1 AS snap, path, text FROM c WHERE (conv_id, snap + 1) IN (SELECT (conv_id, snap) FROM c))
SELECT coalesce(o.conv_id, n.conv_id) AS conv_id, coalesce(o.snap, n.snap) AS snap, coalesce(o.path, n.path) AS path,
       CASE WHEN o.conv_id IS NULL THEN 'Added' WHEN n.conv_id IS NULL THEN 'Deleted' ELSE 'Modified' END AS change
FROM o FULL OUTER JOIN c n ON o.conv_id = n.conv_id AND o.snap = n.snap AND o.path = n.path
WHERE o.conv_id IS NULL OR n.conv_id IS NULL OR o.text <> n.text""")
def changed_files_q(t):
    """Files changed between every two consecutive snapshots of a conversation (two turns each)."""
    new = t.conversations.select("conv_id", F.floor(F.col("turn") / 2).alias("snap"), F.concat(F.lit("turn"), (F.col("turn") % 2).cast("string")).alias("path"),
                                 F.col("text").alias("content"))
    old = new.withColumn("snap", F.col("snap") + 1).join(new.select("conv_id", "snap").distinct(), ["conv_id", "snap"], "left_semi")
    return L.changed_files(old, new, ["conv_id", "snap"], "path", "content")


# ---------------------------------------------------------------- ordered rows


@register("row_label_select", sql="""
SELECT doc_id, row_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS row_id FROM documents) s
WHERE row_id IN (0, 1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144, 233, 377, 610, 987)""")
def row_label_select_q(t):
    """Stable positional labels (distributed row index, then an INSET filter)."""
    idx = R.with_row_index(t.documents.select("doc_id"), ["doc_id"])
    return R.row_label_select(idx, [0, 1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144, 233, 377, 610, 987]).select("doc_id", "row_id")


@register("head_n", sql="SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 10")
def head_n_q(t):
    """L1: first ten rows in key order."""
    return R.head_n(t.documents.select("doc_id", "lang"), 10, ["doc_id"])


@register("row_cap", views=("v_file", "v_commit"), sql=f"""
SELECT f.hash, f.path, f.file_pos FROM v_file f JOIN v_commit c ON c.hash = f.hash
WHERE NOT EXISTS (SELECT 1 FROM ({_DONE_SQL}) d WHERE d.hash = f.hash AND d.path = f.path)
ORDER BY c.committed_at, f.hash, f.file_pos, f.path LIMIT 400""")
def row_cap_q(t):
    """L2: the first 400 new file changes in commit order (the miner's per-run cap)."""
    f = V.v_file(t).join(V.v_commit(t).select("hash", "committed_at"), "hash")
    r = R.row_cap(f, _done(t), ["hash", "path"], ["committed_at", "hash", "file_pos", "path"], 400)
    return r.select("hash", "path", "file_pos")


@register("commit_order", views=("v_commit",), sql="""
SELECT hash, committed_at FROM v_commit ORDER BY committed_at DESC, hash DESC""")
def commit_order_q(t):
    """Newest-first traversal (draft miner)."""
    return R.commit_order(V.v_commit(t), "committed_at", "hash", oldest_first=False).select("hash", "committed_at")


@register("commit_order_oldest", views=("v_commit",), sql="SELECT hash, committed_at FROM v_commit ORDER BY committed_at, hash")
def commit_order_oldest_q(t):
    """Oldest-first traversal (final miner)."""
    return R.commit_order(V.v_commit(t), "committed_at", "hash").select("hash", "committed_at")


@register("count_sort", views=("v_file",), sql="""
SELECT string_split(path, '.')[-1] AS value, count(*) AS count FROM v_file GROUP BY 1""")
def count_sort_q(t):
    """Extension frequencies, most frequent first."""
    from ..functions.paths import path_extension
    from ..operators.stats import value_counts
    return value_counts(V.v_file(t), path_extension("path"))


_DRAWS = 200


@register("random_sample", sql=f"""
WITH r AS (SELECT doc_id, lang, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents),
d AS (SELECT draw, ('0x' || substr(md5('7:' || draw), 1, 12))::BIGINT AS h FROM range({_DRAWS}) t(draw))
SELECT d.draw, doc_id, lang FROM d JOIN r ON r.i = d.h % r.n""")
def random_sample_q(t):
    """L4: 200 seeded draws with replacement."""
    return R.random_sample(t.documents.select("doc_id", "lang"), _DRAWS, ["doc_id"], seed=7)


@register("hash_sample", sql="SELECT doc_id, lang FROM documents ORDER BY md5('7:' || doc_id), doc_id LIMIT 25")
def hash_sample_q(t):
    """L4 without replacement: 25 rows by seeded hash."""
    return R.hash_sample(t.documents.select("doc_id", "lang"), 25, ["doc_id"], seed=7)
