"""Registered queries: the end-to-end jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import models as MD
from ..operators import similarity as SIM
from ..operators import stats as ST
from ..session import scratch_path
from ..sources.csv_io import table_sink
from . import sqlfrag as S
from . import views as V
from .jobs import change_metrics, change_report, complete_changes, diff_discrepancy, infer_messages, mine_bug_fix_changes, mine_complete
from .q_changes import _DONE_SQL, _done
from .q_diffs import sql_discrepancy
from .q_metrics import _G4_SQL, sql_blank
from .q_scores import sql_bleu, sql_cos, sql_embed
from .registry import register


@register("mine_bug_fix_changes", views=("v_commit", "v_file"), sql=f"""
SELECT f.hash, f.file_pos, f.path, replace({S.strip('c.message')}, chr(10), ' ') AS message
FROM v_file f JOIN v_commit c ON c.hash = f.hash
WHERE regexp_matches({S.normalize('c.message')}, '{S.quote_terms()}') AND c.branch = 'main'
  AND c.hash IN (SELECT hash FROM v_file WHERE ends_with(path, '.py'))
  AND NOT EXISTS (SELECT 1 FROM ({_DONE_SQL}) d WHERE d.hash = f.hash AND d.path = f.path)""")
def mine_bug_fix_changes_q(t):
    """E-1 (model step aside): bug-fix file changes still to process."""
    r = mine_bug_fix_changes(V.v_commit(t), V.v_file(t), _done(t))
    return r.select("hash", "file_pos", "path", "message")


_METRIC_PAIRS = "SELECT hash, after AS cand, before AS ref FROM v_code"


@register("change_metrics_report", views=("v_code",), sql=f"""
WITH b AS ({sql_bleu(_METRIC_PAIRS, "hash")}),
s AS (SELECT hash, NOT ({sql_blank('before')} OR {sql_blank('after')}) AS ok,
             {sql_cos(sql_embed('before'), sql_embed('after'))} AS sem FROM v_code)
SELECT semantic_class, token_class, classes_agree, count(*) AS n FROM (
  SELECT CASE WHEN ok THEN (CASE WHEN sem >= 0.8 THEN 'Minor' ELSE 'Major' END) END AS semantic_class,
         CASE WHEN ok THEN (CASE WHEN b.bleu >= 0.75 THEN 'Minor' ELSE 'Major' END) END AS token_class,
         CASE WHEN ok THEN (CASE WHEN (sem >= 0.8) = (b.bleu >= 0.75) THEN 'YES' ELSE 'NO' END) END AS classes_agree
  FROM s JOIN b USING (hash)) x
GROUP BY ALL""")
def change_metrics_report_q(t):
    """E-2: class counts over every change (failed rows counted with null classes)."""
    m = change_metrics(V.v_code(t))
    return m.groupBy("semantic_class", "token_class", "classes_agree").agg(F.count(F.lit(1)).alias("n"))


_JOB_SQL = f"""
WITH b AS ({sql_bleu(_METRIC_PAIRS, "hash")}),
s AS (SELECT hash, round({sql_cos(sql_embed('before'), sql_embed('after'))}, 6) AS sem FROM v_code),
m AS (SELECT g.hash, mi_change, cc_change, loc_change::DOUBLE AS loc_change, sem, b.bleu AS tok FROM ({_G4_SQL}) g
      JOIN s USING (hash) JOIN b USING (hash) WHERE error IS NULL)"""
_JOB_METRICS = {"mi_change": "mi_change", "cc_change": "cc_change", "loc_change": "loc_change", "semantic_similarity": "sem", "token_similarity": "tok"}


def _job_rows(t):
    m = change_metrics(V.v_code(t)).where("error IS NULL").select(*[F.round(c, 6).alias(c) for c in _JOB_METRICS])
    # the table of metrics is written once; its statistics read it several times
    return t.spark.read.parquet(table_sink(m, scratch_path(t.spark, "metrics")))


@register("change_metrics_summary", views=("v_code",), sql=_JOB_SQL + " UNION ALL ".join(
    f" SELECT '{name}' AS metric, count({c}) AS n, round(avg({c}), 5) AS mean, round(median({c}), 5) AS median, round(stddev_samp({c}), 5) AS std, "
    f"round(max({c}) - min({c}), 5) AS range FROM m" for name, c in _JOB_METRICS.items()))
def change_metrics_summary_q(t):
    """E-2: mean, median, deviation and range of every metric of the changes that were measured."""
    return ST.summary(_job_rows(t), list(_JOB_METRICS), round_to=5).drop("min", "max")


@register("similarity_correlation", views=("v_code",), sql=_JOB_SQL + """
SELECT round(corr(sem, tok), 5) AS r, max(sem) AS max_semantic, count(*) AS n FROM m""")
def similarity_correlation_q(t):
    """E-2: correlation of the two similarities over the measured changes."""
    return _job_rows(t).agg(F.round(F.corr("semantic_similarity", "token_similarity"), 5).alias("r"),
                            F.max("semantic_similarity").alias("max_semantic"), F.count(F.lit(1)).alias("n"))


# stand-in models that SQL can state: the first line in lower case, and an echo of the suggestion; both fail on some inputs

def _first_line_or_fail():
    def run(texts):
        if any("LICENSE" in x for x in texts):
            raise ValueError("refused")
        return [next((ln.strip() for ln in x.splitlines() if ln.strip()), "").lower() for x in texts]
    return run


def _echo_suggestion():
    def run(texts):
        if any("\nFile: README.md\n" in x for x in texts):
            raise ValueError("refused")
        return ["Create a new commit message: " + x.split("\nSuggestion: ", 1)[1].rsplit("\nNew message:", 1)[0] for x in texts]
    return run


_LINE = "[\\n\\x0B\\x0C\\r\\x1C-\\x1E\\x{85}\\x{2028}\\x{2029}]"
_INFER_SQL = f"""
SELECT hash, seq, string_agg(CASE WHEN contains(p, 'LICENSE') THEN '' ELSE lower({S.strip(f"list_filter(string_split_regex(p, '{_LINE}'), lambda x: length({S.strip('x')}) > 0)[1]")}) END,
                             '; ' ORDER BY i) AS inference
FROM (SELECT hash, seq, i, role || ' diff ' || arr[i] AS p FROM (
  SELECT hash, seq, role, arr, unnest(generate_series(1, len(arr))) AS i FROM (
    SELECT hash, seq, role, regexp_split_to_array(diff, '\\n@@ .* @@\\n') AS arr FROM v_diff) a) b) c
GROUP BY hash, seq"""


@register("mine_and_infer", views=("v_diff",), sql=_INFER_SQL)
def mine_and_infer_q(t):
    """E-1: one inferred message per change, from the answers for its hunks."""
    return infer_messages(V.v_diff(t), ["hash", "seq"], _first_line_or_fail, message="role")


@register("complete_changes", views=("v_diff",), sql=f"""
SELECT hash, seq, path, role, inference, CASE WHEN path = 'README.md' THEN '' ELSE {S.strip('inference')} END AS rectified
FROM v_diff JOIN ({_INFER_SQL}) i USING (hash, seq)""")
def complete_changes_q(t):
    """E-1: the complete table, with inferred and rewritten messages."""
    d = V.v_diff(t)
    inferred = infer_messages(d, ["hash", "seq"], _first_line_or_fail, message="role").select(
        F.col("hash"), F.col("seq"), "inference")
    return complete_changes(d, inferred, ["hash", "seq"], _echo_suggestion, message="role")


def _count_or_fail():
    def run(texts):
        if any(f"{sign}line 2" in x for x in texts for sign in "+-"):
            raise ValueError("refused")
        return [f"{x.count('+part ') + x.count('+line ')} added, {x.count('-part ') + x.count('-line ')} deleted" for x in texts]
    return run


def _suggestion_or_fail():
    def run(texts):
        if any("\nFile: src/f7.py\n" in x for x in texts):
            raise ValueError("refused")
        return ["Create a new commit message: " + x.split("\nSuggestion: ", 1)[1].rsplit("\nNew message:", 1)[0] + "!" for x in texts]
    return run


# a text has a "part" and a "line" line, which never equal each other, so a change has at most one hunk
_MINED_SQL = f"""
WITH RECURSIVE mined AS (SELECT v.hash, v.path, replace({S.strip('c.message')}, chr(10), ' ') AS message, coalesce(v.content, '') AS after
  FROM v_version v JOIN v_commit c USING (hash) WHERE c.branch = 'main' AND regexp_matches({S.normalize('c.message')}, '{S.quote_terms()}')),
walk(hash, path, above) AS (
  SELECT m.hash, m.path, b.parent FROM mined m JOIN v_branch b ON b.hash = m.hash
  UNION ALL
  SELECT w.hash, w.path, b.parent FROM walk w JOIN v_branch b ON b.hash = w.above
  WHERE NOT EXISTS (SELECT 1 FROM v_version v WHERE v.hash = w.above AND v.path = w.path)),
sides AS (SELECT m.hash, m.path, m.message, CASE WHEN after = '' THEN [] ELSE string_split(after, chr(10)) END AS a,
                 CASE WHEN coalesce(v.content, '') = '' THEN [] ELSE string_split(v.content, chr(10)) END AS b
  FROM mined m LEFT JOIN (SELECT w.hash, w.path, v.content FROM walk w JOIN v_version v ON v.hash = w.above AND v.path = w.path) v
  ON v.hash = m.hash AND v.path = m.path),
lines AS (SELECT hash, path, message, list_filter(a, lambda x: NOT list_contains(b, x)) AS plus, list_filter(b, lambda x: NOT list_contains(a, x)) AS minus FROM sides),
asked AS (SELECT *, list_contains(plus, 'line 2') OR list_contains(minus, 'line 2') AS refused FROM lines WHERE len(plus) + len(minus) > 0)
"""


def _mined(t):
    commits = V.v_commit(t).select("hash", "message", "branch").join(V.v_branch(t), "hash")
    return mine_complete(commits, V.v_version(t), _count_or_fail, _suggestion_or_fail)


@register("mine_complete", views=("v_commit", "v_branch", "v_version"), sql=_MINED_SQL + """
SELECT hash, path, message, len(plus) || ' added, ' || len(minus) || ' deleted' AS inference,
       len(plus) || ' added, ' || len(minus) || ' deleted!' AS rectified
FROM asked WHERE NOT refused AND path <> 'src/f7.py'""")
def mine_complete_q(t):
    """E-1 from commits to the complete table: mined, paired with the state at the parent, aligned, inferred per hunk, rewritten."""
    return _mined(t)[0]


@register("mine_complete_failed", views=("v_commit", "v_branch", "v_version"), sql=_MINED_SQL + """
SELECT hash, path, 'inference' AS stage FROM asked WHERE refused
UNION ALL SELECT hash, path, 'rectification' FROM asked WHERE NOT refused AND path = 'src/f7.py'""")
def mine_complete_failed_q(t):
    """E-1, S7: hunks and messages that a model failed on."""
    return _mined(t)[1].select("hash", "path", "stage")


@register("message_score_means", views=("v_diff",), sql=f"""
SELECT round(avg({sql_cos(sql_embed('role'), sql_embed('diff'))}), 6) AS dev_mean, round(avg({sql_cos(sql_embed('after'), sql_embed('diff'))}), 6) AS model_mean,
       round(avg({sql_cos(sql_embed('before'), sql_embed('diff'))}), 6) AS rect_mean, count(*) AS n FROM v_diff""")
def message_score_means_q(t):
    """Message scoring from texts: mean score of three messages against the diff."""
    s = SIM.message_scores(V.v_diff(t), ["hash", "seq"], "diff", {"dev": "role", "model": "after", "rect": "before"}, MD.embed_text)
    return s.agg(*[F.round(F.avg(f"{m}_score"), 6).alias(f"{m}_mean") for m in ("dev", "model", "rect")], F.count(F.lit(1)).alias("n"))


@register("diff_discrepancy_by_repo", views=("v_diff",), sql=f"""
SELECT 'repo_' || (hash % 2) AS repo, discrepancy, file_type, count(*) AS n FROM (
  SELECT hash, {sql_discrepancy('both')} AS discrepancy, {S.kind('path')} AS file_type FROM v_diff) d
WHERE discrepancy IN ('Yes', 'No') GROUP BY ALL""")
def diff_discrepancy_by_repo_q(t):
    """E-3 over two repositories."""
    d = V.v_diff(t)
    return diff_discrepancy({f"repo_{i}": d.where(F.col("hash") % 2 == i) for i in (0, 1)})


@register("change_report", views=("v_file",), sql="""
SELECT 'total' AS section, 'rows' AS name, count(*)::DOUBLE AS value FROM v_file
UNION ALL SELECT 'total', 'keys', count(DISTINCT hash)::DOUBLE FROM v_file
UNION ALL SELECT 'total', 'paths', count(DISTINCT path)::DOUBLE FROM v_file
UNION ALL SELECT 'total', 'mean_rows_per_key', avg(n) FROM (SELECT count(*) AS n FROM v_file GROUP BY hash) g
UNION ALL SELECT 'extension', string_split(path, '.')[-1], count(*)::DOUBLE FROM v_file GROUP BY 2""")
def change_report_q(t):
    """Descriptive report on the change table in one job."""
    return change_report(V.v_file(t), "hash", "path")


@register("bleu_duplicate_keys", sql=sql_bleu("SELECT d.doc_id % 5 AS k, d.text AS cand, p.text AS ref, d.doc_id FROM documents d "
                                              "JOIN documents p ON p.doc_id + 1 = d.doc_id", "k, doc_id").replace("SELECT k, doc_id, round(", "SELECT k, round("))
def bleu_duplicate_keys_q(t):
    """M6 where keys repeat: one score per row, none mixed."""
    d = t.documents.select("doc_id", "text")
    ref = d.select((F.col("doc_id") + 1).alias("doc_id"), F.col("text").alias("ref"))
    pairs = d.join(ref, "doc_id").select((F.col("doc_id") % 5).alias("k"), F.col("text").alias("cand"), "ref")
    return SIM.bleu(pairs, ["k"], "cand", "ref").select("k", F.round("bleu", 6).alias("bleu"))
