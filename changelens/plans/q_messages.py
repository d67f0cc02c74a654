"""Registered queries: message filters, text helpers and path helpers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as T
from ..operators import messages as M
from . import sqlfrag as S
from . import views as V
from .registry import register

# ---------------------------------------------------------------- messages (v_commit)


@register("keyword_any_filter", views=("v_commit",), sql=f"""
SELECT hash, {S.normalize('message')} AS message_norm FROM v_commit
WHERE regexp_matches({S.normalize('message')}, '{S.quote_terms()}')""")
def keyword_any_filter_q(t):
    """Bug-fixing commits by keyword (after normalisation)."""
    c = M.keyword_any_filter(V.v_commit(t), "message")
    return c.select("hash", T.normalize_message("message").alias("message_norm"))


@register("keyword_any_filter_draft", views=("v_commit",), sql=f"""
SELECT hash FROM v_commit WHERE regexp_matches(lower(message), '{S.quote_terms()}')""")
def keyword_any_filter_draft_q(t):
    """P1, draft-miner variant: lower-case only (line breaks not normalised)."""
    return M.keyword_any_filter(V.v_commit(t), "message", normalize=False).select("hash")


@register("message_normalize", views=("v_commit",), sql=f"""
SELECT hash, {S.normalize('message')} AS message_norm FROM v_commit""")
def message_normalize_q(t):
    """P2."""
    return M.message_normalize(V.v_commit(t)).select("hash", "message_norm")


@register("message_one_line", views=("v_commit",), sql=f"""
SELECT hash, replace({S.strip('message')}, chr(10), ' ') AS message_line FROM v_commit""")
def message_one_line_q(t):
    """P3."""
    return M.message_one_line(V.v_commit(t)).select("hash", "message_line")


@register("merge_flag", views=("v_commit",), sql="""
SELECT hash, CASE WHEN len(parents) > 1 THEN 'Y' ELSE 'N' END AS is_merge FROM v_commit""")
def merge_flag_q(t):
    """P8."""
    return V.v_commit(t).select("hash", P.merge_flag("parents").alias("is_merge"))


@register("first_parent", views=("v_commit",), sql="""
SELECT hash, parents[1] AS parent FROM v_commit""")
def first_parent_q(t):
    """P9."""
    return V.v_commit(t).select("hash", P.first_parent("parents").alias("parent"))


@register("branch_and_type_filter", views=("v_commit", "v_file"), sql="""
SELECT hash FROM v_commit WHERE branch = 'main'
  AND hash IN (SELECT hash FROM v_file WHERE ends_with(path, '.py'))""")
def branch_and_type_filter_q(t):
    """P15."""
    return M.branch_and_type_filter(V.v_commit(t), V.v_file(t)).select("hash")


def _repos(t):
    """Repository-shaped rows derived from customers and their orders."""
    o = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_commits"),
                                          F.min("o_orderdate").alias("created_at"))
    c = t.customer.select("c_custkey", F.col("c_mktsegment").alias("language"), F.col("c_acctbal").alias("stars"))
    return c.join(o, c.c_custkey == o.o_custkey).select("c_custkey", "language", "stars", "n_commits", "created_at")


@register("criteria_filter", sql="""
SELECT c_custkey FROM (
  SELECT c.c_custkey, c.c_mktsegment AS language, c.c_acctbal AS stars, o.n_commits, o.created_at
  FROM customer c JOIN (SELECT o_custkey, count(*) AS n_commits, min(o_orderdate) AS created_at
                        FROM orders GROUP BY o_custkey) o ON c.c_custkey = o.o_custkey) r
WHERE created_at >= DATE '2001-08-01' - INTERVAL 60 MONTH AND language = 'BUILDING'
  AND stars >= 1200 AND n_commits BETWEEN 8 AND 25""")
def criteria_filter_q(t):
    """Language, stars >= 1200, commit count in range, created in the last five years."""
    r = M.criteria_filter(_repos(t), as_of="2001-08-01", language="BUILDING", min_stars=1200,
                          commit_range=(8, 25), years=5)
    return r.select("c_custkey")


_SUGGESTION = r"coalesce(regexp_extract(after, '(\S+)', 1), '')"


@register("prompt_build", views=("v_change",), sql=f"""
SELECT hash, seq,
  md5('Rewrite the commit message so that it says what the change does.' || chr(10) || 'Message: ' || role || chr(10)
      || 'File: ' || coalesce(path, '') || chr(10) || 'Suggestion: ' || {_SUGGESTION} || chr(10) || 'New message:') AS rectify_md5,
  md5(role || ' diff ' || after) AS hunk_md5
FROM v_change""")
def prompt_build_q(t):
    """Rewriting prompt and per-hunk model input, fingerprinted."""
    c = V.v_change(t)
    rp = M.rectify_prompt(F.col("role"), F.col("path"), F.regexp_extract("after", r"(\S+)", 1))
    return c.select("hash", "seq", F.md5(rp).alias("rectify_md5"),
                    F.md5(M.hunk_prompt(F.col("role"), F.col("after"))).alias("hunk_md5"))


@register("chat_prompt", views=("v_change",), sql=f"""
SELECT hash, seq, 'system' AS role_1, 'You write commit messages.' AS content_1, 'user' AS role_2,
       'Message: ' || role || chr(10) || 'File: ' || coalesce(path, '') || chr(10) || 'Suggestion: ' || {_SUGGESTION} AS content_2 FROM v_change""")
def chat_prompt_q(t):
    """The chat form of the rewriting prompt."""
    p = V.v_change(t).withColumn("p", M.chat_prompt(F.col("role"), F.col("path"), F.regexp_extract("after", r"(\S+)", 1)))
    return p.select("hash", "seq", *[F.get("p", i)[f].alias(f"{f}_{i + 1}") for i in (0, 1) for f in ("role", "content")])


@register("combine_prompt", views=("v_change",), sql="""
SELECT hash, 'Merge these messages for the file ' || min(path) || ' into one.' || chr(10) || string_agg(role, chr(10) ORDER BY seq, role)
       || chr(10) || 'Original message: ' || min(role) AS prompt
FROM v_change WHERE path IS NOT NULL GROUP BY hash""")
def combine_prompt_q(t):
    """The combine prompt, one line per message of a change."""
    g = V.v_change(t).where("path IS NOT NULL").groupBy("hash").agg(
        F.array_sort(F.collect_list(F.struct("seq", "role"))).alias("m"), F.min("path").alias("path"), F.min("role").alias("original"))
    return g.select("hash", M.combine_prompt(F.col("path"), F.col("m.role"), F.col("original")).alias("prompt"))


# ---------------------------------------------------------------- text helpers (documents)

@register("newline_escape", sql="""
SELECT doc_id, md5(replace(replace(text, chr(13), '\\r'), chr(10), '\\n')) AS escaped_md5,
       length(replace(replace(text, chr(13), '\\r'), chr(10), '\\n')) AS escaped_len FROM documents""")
def newline_escape_q(t):
    """P4."""
    e = T.escape_newlines("text")
    return t.documents.select("doc_id", F.md5(e).alias("escaped_md5"), F.length(e).alias("escaped_len"))


@register("newline_unescape", sql="""
SELECT doc_id, md5(replace(replace(replace(replace(text, chr(13), '\\r'), chr(10), '\\n'), '\\n', chr(10)), '\\r', chr(13))) AS text_md5
FROM documents""")
def newline_unescape_q(t):
    """P5: escape then unescape (identity unless the text holds a literal backslash-n)."""
    return t.documents.select("doc_id", F.md5(T.unescape_newlines(T.escape_newlines("text"))).alias("text_md5"))


@register("null_to_empty", views=("v_change",), sql="""
SELECT hash, seq, coalesce(path, '') AS path FROM v_change""")
def null_to_empty_q(t):
    """P7."""
    return V.v_change(t).select("hash", "seq", T.null_to_empty("path").alias("path"))


@register("path_coalesce", views=("v_change",), sql="""
SELECT hash, seq, coalesce(nullif(path, ''), nullif(old_path, '')) AS file_path FROM v_change""")
def path_coalesce_q(t):
    """P6."""
    return V.v_change(t).select("hash", "seq", P.path_coalesce("path", "old_path").alias("file_path"))


@register("blank_key_skip", views=("v_change",), sql="""
SELECT hash, seq FROM v_change
WHERE coalesce(nullif(path, ''), nullif(old_path, '')) IS NOT NULL
  AND length(regexp_replace(after, '\\s', '', 'g')) > 0""")
def blank_key_skip_q(t):
    """Drop rows with no path or a blank text."""
    c = V.v_change(t)
    return c.where(P.path_coalesce("path", "old_path").isNotNull() & ~T.is_blank("after")).select("hash", "seq")


@register("preview", sql="""
SELECT doc_id, substring(text, 1, 60) || CASE WHEN length(text) > 60 THEN '...' ELSE '' END AS preview
FROM documents""")
def preview_q(t):
    """P17 (60 characters, as in the miner's log line)."""
    return t.documents.select("doc_id", T.preview("text", 60).alias("preview"))


@register("path_extension", views=("v_file",), sql="""
SELECT hash, file_pos, string_split(path, '.')[-1] AS ext FROM v_file""")
def path_extension_q(t):
    """P19."""
    return V.v_file(t).select("hash", "file_pos", P.path_extension("path").alias("ext"))


@register("path_extension_url", sql="""
SELECT page_id, string_split(url, '.')[-1] AS ext FROM pages""")
def path_extension_url_q(t):
    """P19 over real URLs."""
    return t.pages.select("page_id", P.path_extension("url").alias("ext"))


@register("first_token", sql="""
SELECT doc_id, nullif(regexp_extract(text, '(\\S+)', 1), '') AS fix_type FROM documents""")
def first_token_q(t):
    """P20."""
    return t.documents.select("doc_id", T.first_token("text").alias("fix_type"))


@register("diff_whitespace_squeeze", sql="""
SELECT doc_id, md5(replace(replace(text, ' ', ''), chr(10) || chr(10), chr(10))) AS squeezed_md5 FROM documents""")
def diff_whitespace_squeeze_q(t):
    """P22."""
    return t.documents.select("doc_id", F.md5(T.squeeze_diff("text")).alias("squeezed_md5"))


_LEAD = "CASE WHEN doc_id % 3 = 0 THEN 'Create a new commit message for this change: ' || chr(10) || chr(10) ELSE '' END"


@register("model_text_cleanup", sql=f"""
SELECT doc_id, coalesce({S.strip("list_filter(string_split_regex(c, '\\r\\n|[\\n\\x0B\\x0C\\r\\x1C-\\x1E\\x{85}\\x{2028}\\x{2029}]'), lambda x: length(" + S.strip('x') + ") > 0)[1]")}, c) AS cleaned
FROM (SELECT doc_id, {S.strip("regexp_replace(" + S.strip(_LEAD + " || text") + ", '(?i)^create a (new )?commit message.*?:\\s*', '')")} AS c
      FROM documents) s""")
def model_text_cleanup_q(t):
    """P24 over model-like outputs (an echoed lead-in on every third document)."""
    lead = F.when(F.col("doc_id") % 3 == 0, F.lit("Create a new commit message for this change: \n\n")).otherwise(F.lit(""))
    return t.documents.select("doc_id", T.model_text_cleanup(F.concat(lead, F.col("text"))).alias("cleaned"))


@register("text_length", sql="SELECT doc_id, length(text) AS n_chars FROM documents")
def text_length_q(t):
    """P25 (code points)."""
    return t.documents.select("doc_id", F.length("text").alias("n_chars"))


@register("token_truncate", sql=f"""
SELECT doc_id, len(tk) AS n_tokens, md5(array_to_string(tk, ' ')) AS tokens_md5
FROM (SELECT doc_id, {S.tokens('text')}[1:512] AS tk FROM documents) s""")
def token_truncate_q(t):
    """First 512 whitespace tokens of every document."""
    tk = T.truncate_tokens("text", 512)
    return t.documents.select("doc_id", F.size(tk).alias("n_tokens"), F.md5(F.array_join(tk, " ")).alias("tokens_md5"))


@register("project_reorder", sql="""
SELECT l_linenumber, l_orderkey, l_quantity FROM lineitem""")
def project_reorder_q(t):
    """P10."""
    return t.lineitem.select("l_linenumber", "l_orderkey", "l_quantity")


@register("add_column", views=("v_change",), sql="""
SELECT hash, seq, 'conversations' AS source, length(after) - length(before) AS size_delta FROM v_change""")
def add_column_q(t):
    """P11."""
    return V.v_change(t).withColumns({"source": F.lit("conversations"),
                                      "size_delta": F.length("after") - F.length("before")}).select(
        "hash", "seq", "source", "size_delta")


# Fixed values (the feature: a literal id set, like the reference's ten test hashes).
TEST_IDS = [3, 14, 15, 92, 65, 35, 89, 79, 323, 846]


@register("in_list_filter", sql=f"""
SELECT doc_id, lang FROM documents WHERE doc_id IN ({', '.join(map(str, TEST_IDS))})""")
def in_list_filter_q(t):
    """Literal hash set (INSET)."""
    return t.documents.where(F.col("doc_id").isin(TEST_IDS)).select("doc_id", "lang")
