"""Line-level diff operators: line split, discrepancy, line delta, changed files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import diffs as D
from ..functions.text import lines, squeeze_diff, strip_ws, whole_json

DISCREPANCY_MODES = ("both", "compat", "none")


def diff_line_split(df: DataFrame, diff_col: str = "diff", added: str = "added",
                    deleted: str = "deleted") -> DataFrame:
    """Add ``added`` / ``deleted`` arrays parsed from a unified diff column."""
    return df.withColumns({added: D.added_lines(diff_col), deleted: D.deleted_lines(diff_col)})


def discrepancy(df: DataFrame, diff_col: str = "diff", hist_col: str = "diff_hist",
                out: str = "discrepancy", normalize: str = "both") -> DataFrame:
    """Compare two renderings of the same diff as line sets.

    ``diff_col`` is unified-diff text; ``hist_col`` is JSON
    ``{"added": [{"n", "line"}], "deleted": [...]}``.  Result is 'Yes' when both the
    added and the deleted line sets agree, 'No' otherwise, 'Error' when the JSON does
    not parse.  ``normalize``: 'both' (default) removes spaces on both sides;
    'compat' squeezes only the text rendering (the reference's asymmetry); 'none'
    compares stripped lines as they are.
    """
    if normalize not in DISCREPANCY_MODES:
        raise ValueError(f"normalize must be one of {DISCREPANCY_MODES}")
    text = squeeze_diff(F.col(diff_col)) if normalize in ("both", "compat") else F.col(diff_col)
    # staged: each intermediate is a column, so no large expression is re-derived per use
    d = df.withColumns({"__lines": lines(text), "__hist": whole_json(hist_col, D.hist_schema())})

    def hist_side(side):
        arr = F.transform(F.coalesce(F.col("__hist")[side], F.array()), lambda s: strip_ws(s["line"]))
        return D.no_spaces(arr) if normalize == "both" else arr

    d = d.withColumns({"__am": D.signed_lines("__lines", "+"), "__dm": D.signed_lines("__lines", "-"),
                       "__ah": hist_side("added"), "__dh": hist_side("deleted")})
    same = D.same_line_sets("__am", "__ah") & D.same_line_sets("__dm", "__dh")
    return d.withColumn(out, F.when(F.col("__hist").isNull(), "Error").when(same, "Yes").otherwise("No")).drop(
        "__lines", "__hist", "__am", "__dm", "__ah", "__dh")


def line_delta(df: DataFrame, keys: list[str], before: str = "before", after: str = "after") -> DataFrame:
    """(keys, side, line) for every line that one version has more often than the other, as multisets.

    Both versions are exploded in one pass and counted with a sign per (keys,
    line), so a big file is spread over many groups; the surplus is repeated.
    """
    def tagged(c, sign):
        return F.transform(F.coalesce(lines(c), F.array()), lambda x: F.struct(x.alias("line"), F.lit(sign).alias("sign")))

    both = df.select(*keys, F.explode(F.concat(tagged(after, 1), tagged(before, -1))).alias("__l"))
    net = both.groupBy(*keys, F.col("__l.line").alias("line")).agg(F.sum("__l.sign").alias("__n")).where("__n != 0")
    return net.select(*keys, F.when(F.col("__n") > 0, "added").otherwise("deleted").alias("side"),
                      F.explode(F.array_repeat("line", F.abs("__n").cast("int"))).alias("line"))


def changed_files(old: DataFrame, new: DataFrame, keys: list[str], path: str = "path",
                  content: str = "content", out: str = "change") -> DataFrame:
    """Files that differ between two snapshots: Added, Deleted or Modified.

    Both sides are reduced to (keys, path, sha2(content)) before the full outer
    join, so wide text never crosses the shuffle.
    """
    o = old.select(*keys, F.col(path).alias("path"), F.sha2(F.col(content), 256).alias("old_sha"))
    n = new.select(*keys, F.col(path).alias("path"), F.sha2(F.col(content), 256).alias("new_sha"))
    j = o.join(n, [*keys, "path"], "full_outer")
    status = (F.when(F.col("old_sha").isNull(), "Added").when(F.col("new_sha").isNull(), "Deleted")
               .when(F.col("old_sha") != F.col("new_sha"), "Modified"))
    return j.select(*keys, "path", status.alias(out)).where(F.col(out).isNotNull())
