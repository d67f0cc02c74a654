"""End-to-end jobs composed from the operators (the reference's three entry points)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import path_category, path_extension
from ..functions.text import model_text_cleanup, one_line
from ..operators import alignment as A
from ..operators import changes as C
from ..operators import classify as K
from ..operators import codemetrics as G
from ..operators import history as H
from ..operators import lines as L
from ..operators import messages as M
from ..operators import models as MD
from ..operators import similarity as SIM
from ..operators.stats import value_counts
from ..session import clear_scratch, scratch_mark
from ..sources.union import multi_source_union
from ..staging import written


def mine_bug_fix_changes(commits: DataFrame, files: DataFrame, done: DataFrame | None = None,
                         branch: str = "main", suffix: str = ".py") -> DataFrame:
    """E-1 without the model step: bug-fix commits on a branch touching ``suffix`` files,
    flattened to one row per (commit, file), minus the (hash, path) keys already done.

    The message and branch filters run before the join; whether a commit touches
    a ``suffix`` file is one boolean per hash, aggregated before its shuffle, so no
    task gathers a commit's rows to tell.  The anti-join against ``done`` skips finished work before any costly step downstream.
    """
    c = M.keyword_any_filter(commits, "message").where(F.col("branch") == branch)
    rows = files.join(c.select("hash", one_line("message").alias("message")), "hash")
    touched = files.groupBy("hash").agg(F.bool_or(F.col("path").endswith(suffix)).alias("__touched")).where("__touched")
    rows = rows.join(touched.select("hash"), "hash", "left_semi")
    if done is not None:
        rows = C.done_anti_join(rows, done, ["hash", "path"])
    return rows


def infer_messages(changes: DataFrame, keys: list[str], make_model, message: str = "message", diff: str = "diff",
                   out: str = "inference", drop_blank: bool = False) -> DataFrame:
    """E-1, model step: (keys, inference) per change.  The diff is split into hunks, each prompted with the message (P23) and
    sent to the model (M1; a failing hunk gives ''), and the answers are joined by "; " in hunk order."""
    answers = _hunk_answers(changes, keys, make_model, message, diff, drop_blank).withColumn("__a", F.coalesce("__a", F.lit("")))
    return C.ordered_join_text(answers, keys, "hunk_no", "__a", out=out)


def _hunk_answers(changes: DataFrame, keys: list[str], make_model, message: str, diff: str, drop_blank: bool) -> DataFrame:
    """(keys, hunk_no, __a, error) per hunk."""
    hunks = C.hunk_split(changes.select(*keys, F.col(message).alias("__m"), diff), [*keys, "__m"], diff, drop_blank=drop_blank)
    prompts = hunks.withColumn("__p", M.hunk_prompt(F.coalesce("__m", F.lit("")), F.col("hunk")))
    return MD.batch_model_apply(prompts, "__p", "__a", make_model)


def mine_complete(commits: DataFrame, versions: DataFrame, make_hunk_model, make_message_model, done: DataFrame | None = None,
                  branch: str = "main", suffix: str = ".py") -> tuple[DataFrame, DataFrame]:
    """E-1 from commits to the complete table: (complete, failed).

    ``commits`` (hash, message, branch, parent), ``versions`` (hash, path, content).
    The bug-fix changes that aren't ``done`` get their file's state at the first parent and at the commit; the aligned difference is split into
    hunks, and those that aren't blank go to the hunk model; the answers are joined per change, and the second model rewrites the message.
    ``complete`` is (hash, path, message, inference, rectified).  A hunk or message that a model fails on yields no text: it is in
    ``failed`` (hash, path, hunk_no, stage, error), and a change none of whose hunks got an answer, or whose message failed, is not in
    ``complete``.  Each step's rows are written before the next reads them, so no model is asked twice; what no later step reads is
    deleted then, so the answers, messages and the tables of one step lie on disk at once.
    """
    keys, spark, marks = ["hash", "path"], commits.sparkSession, [scratch_mark()]

    def step(df: DataFrame, name: str) -> DataFrame:
        marks.append(scratch_mark())
        return written(df, name)

    mined = written(mine_bug_fix_changes(commits, versions.select(*keys).distinct(), done, branch, suffix), "mined")
    states = step(H.before_after_state(mined, versions, commits.select("hash", "parent"), ["path"]).select(*keys, "message", "before", "after"), "states")
    clear_scratch(spark, *marks)  # all that led to the states
    diffs = step(C.change_message_join(A.diff_texts(states, keys), states, keys, ["message"]), "diffs")
    clear_scratch(spark, marks[1] + 1, marks[2])  # the alignment's tables
    answers = step(_hunk_answers(diffs, keys, make_hunk_model, "message", "diff", True), "answers")
    clear_scratch(spark, marks[2], marks[3])
    inferred = C.ordered_join_text(answers.where("error IS NULL"), keys, "hunk_no", "__a", out="inference")
    rows = C.change_message_join(states.select(*keys, "message"), inferred, keys, ["inference"])
    rows = rows.withColumn("__p", M.rectify_prompt(F.col("message"), F.col("path"), F.col("inference")))
    rows = step(MD.batch_model_apply(rows, "__p", "__r", make_message_model), "messages")
    clear_scratch(spark, marks[1], marks[1] + 1)
    failed = answers.where("error IS NOT NULL").select(*keys, "hunk_no", F.lit("inference").alias("stage"), "error").unionByName(
        rows.where("error IS NOT NULL").select(*keys, F.lit(None).cast("int").alias("hunk_no"), F.lit("rectification").alias("stage"), "error"))
    complete = rows.where("error IS NULL").select(*keys, "message", "inference", F.coalesce(model_text_cleanup("__r"), F.lit("")).alias("rectified"))
    return complete, failed


def complete_changes(changes: DataFrame, inferred: DataFrame, keys: list[str], make_model, message: str = "message",
                     path: str = "path", inference: str = "inference", out: str = "rectified") -> DataFrame:
    """E-1, last step: the inferred messages joined to the changes (J1), rewritten by a second model (P23, M1, P24; a failing
    row gives '') and projected to (keys, path, message, inference, rectified) (P10)."""
    rows = C.change_message_join(changes, inferred, keys, [inference])
    rows = rows.withColumn("__p", M.rectify_prompt(F.col(message), F.col(path), F.col(inference)))
    rows = MD.batch_model_apply(rows, "__p", out, make_model)
    return rows.select(*keys, path, message, inference, F.coalesce(model_text_cleanup(out), F.lit("")).alias(out))


def change_metrics(changes: DataFrame, before: str = "before", after: str = "after", embed=MD.embed_text) -> DataFrame:
    """E-2: code-metric deltas, semantic and token similarity, classes and agreement for every change, row by row.

    Each measure reads the two texts of the row and adds its columns to it, so nothing is shuffled.  Only for an embedder that
    isn't ``native`` the changes are staged first, as they are read for their distinct texts and again for the vectors.
    """
    rows = changes if getattr(embed, "native", False) else written(changes, "changes")
    m = G.code_change_metrics(rows, before, after)
    m = SIM.change_similarity(m, before, after, embed, out="semantic_similarity")
    return K.classify(SIM.with_bleu(m, after, before, out="token_similarity"), error_col="error")


def diff_discrepancy(sources: dict[str, DataFrame], diff: str = "diff", hist: str = "diff_hist", path: str = "path",
                     normalize: str = "both") -> DataFrame:
    """E-3 over several repositories: compare two renderings of each diff and count Yes / No by repository and file kind."""
    rows = multi_source_union(sources, lambda d: d.select(diff, hist, path))
    d = L.discrepancy(rows, diff, hist, normalize=normalize).withColumn("file_type", path_category(path))
    return (d.where(F.col("discrepancy").isin("Yes", "No")).groupBy("repo", "discrepancy", "file_type")
            .agg(F.count(F.lit(1)).alias("n")))


def change_report(files: DataFrame, key: str, path: str) -> DataFrame:
    """Descriptive report (A1-A4, P19) as (section, name, value): rows, distinct keys and paths, mean rows per key, and
    rows per file extension."""
    per = files.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    totals = files.agg(F.count(F.lit(1)).cast("double").alias("rows"), F.count_distinct(key).cast("double").alias("keys"),
                       F.count_distinct(path).cast("double").alias("paths"))
    mean = per.where(F.col(key).isNotNull()).agg(F.avg("__n").alias("mean_rows_per_key"))
    kinds = value_counts(files, path_extension(path)).select(F.lit("extension").alias("section"), F.col("value").alias("name"),
                                                             F.col("count").cast("double").alias("value"))

    def tall(df):
        return df.unpivot([], df.columns, "name", "value").select(F.lit("total").alias("section"), "name", "value")

    return tall(totals).unionByName(tall(mean)).unionByName(kinds)
