"""Flattening commits to file changes, re-nesting, and the joins between them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.diffs import hunks
from ..functions.text import lines


def explode_files(df: DataFrame, files_col: str = "files", pos: str = "file_pos", out: str = "path") -> DataFrame:
    """one row per (commit, modified file); filters on commit columns stay below it."""
    keep = [c for c in df.columns if c != files_col]
    return df.select(*keep, F.posexplode(files_col).alias(pos, out))


def collect_files(df: DataFrame, key: str = "hash", path: str = "path", out: str = "files") -> DataFrame:
    """sorted list of modified files per commit (partial aggregation map-side); a list is bounded by the files of one commit."""
    return df.groupBy(key).agg(F.array_sort(F.collect_list(path)).alias(out))


def hunk_split(df: DataFrame, keys: list[str], diff_col: str = "diff", pos: str = "hunk_no",
               out: str = "hunk", drop_blank: bool = False) -> DataFrame:
    """one row per hunk, numbered from 0 (piece 0 is the file header)."""
    r = df.select(*keys, F.posexplode(hunks(diff_col)).alias(pos, out))
    if drop_blank:
        r = r.where(F.length(F.regexp_replace(out, r"\s", "")) > 0)
    return r


def ordered_join_text(df: DataFrame, keys: list[str], pos: str, text: str, sep: str = "; ",
                      out: str = "joined") -> DataFrame:
    """per key, join texts with ``sep`` in ``pos`` order (sorted after the shuffle); a text is bounded by the hunks of one change."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(text).alias("t"))))
    return df.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda s: s["t"]), sep).alias(out))


def explode_lines(df: DataFrame, keys: list[str], text_col: str, line_no: str = "line_no",
                  line: str = "line") -> DataFrame:
    """text -> (line_no, line) with ``splitlines`` semantics."""
    return df.select(*keys, F.posexplode(lines(text_col)).alias(line_no, line))


def change_message_join(left: DataFrame, right: DataFrame, keys: list[str], right_cols: list[str],
                        null_safe: bool = False) -> DataFrame:
    """Inner join on ``keys`` with the right side pruned to ``right_cols``.

    Duplicate keys multiply (as in the reference).  ``null_safe=True`` also
    matches null to null, still planned as an equi-join.
    """
    r = right.select(*[F.col(k).alias(f"__r_{k}") for k in keys], *right_cols)
    conds = [(F.col(k).eqNullSafe(F.col(f"__r_{k}")) if null_safe else F.col(k) == F.col(f"__r_{k}")) for k in keys]
    cond = reduce(lambda a, b: a & b, conds)
    return left.join(r, cond, "inner").drop(*[f"__r_{k}" for k in keys])


def done_anti_join(new: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` whose keys are not in ``done`` (done side pruned to keys)."""
    return new.join(done.select(*keys), keys, "left_anti")


def hash_semi_join(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Membership test against another table (a semi-join, never a collected set)."""
    return df.join(ids.select(key), key, "left_semi")


def before_after_join(changes: DataFrame, versions: DataFrame, on: list[str], commit: str, parent: str,
                      content: str = "content", how: str = "outer") -> DataFrame:
    """Attach the file text at the commit (after) and at its first parent (before).

    ``versions`` holds (on..., commit, content).  ``how='inner'`` drops rows where
    either side is missing (draft miner); ``how='outer'`` keeps every change and
    uses '' for a missing side (final miner).
    """
    if how not in ("inner", "outer"):
        raise ValueError("how must be 'inner' or 'outer'")
    jt = "inner" if how == "inner" else "left"

    def side(tag, out):
        v = versions.select(*[F.col(k).alias(f"__{tag}_{k}") for k in on],
                            F.col(commit).alias(f"__{tag}_commit"), F.col(content).alias(out))
        return v, [f"__{tag}_{k}" for k in on] + [f"__{tag}_commit"]

    va, a_cols = side("a", "after")
    vb, b_cols = side("b", "before")
    r = changes.join(va, [F.col(k) == F.col(f"__a_{k}") for k in on] + [F.col(commit) == F.col("__a_commit")], jt)
    r = r.join(vb, [F.col(k) == F.col(f"__b_{k}") for k in on] + [F.col(parent) == F.col("__b_commit")], jt)
    r = r.drop(*a_cols, *b_cols)
    if how == "outer":
        r = r.withColumns({"before": F.coalesce("before", F.lit("")), "after": F.coalesce("after", F.lit(""))})
    return r


def baseline_cross(df: DataFrame, baseline: dict) -> DataFrame:
    """Pair every row with one fixed baseline (e.g. a nonsense message and its vector).

    The baseline is one row of constants, so it is attached as literal columns:
    no join, no broadcast, no shuffle; Catalyst folds the constant expression once.
    """
    return df.withColumns({k: (v if hasattr(v, "alias") else F.lit(v)) for k, v in baseline.items()})
