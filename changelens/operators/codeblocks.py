"""Complexity per function and class: one pass over the lines of a source text with a stack of indents."""

from __future__ import annotations

import re
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import LINE_END, OTHER_LINE_END
from ..session import ship_package
from .codemetrics import DECISION_RE, STRING_NAME, STRING_OR_COMMENT_RE

#: The first word of a line that opens a block, and the block's name.
HEAD_RE = r"[ \t]*(?:async[ \t]+)?(def|class)[ \t]+([^ \t\n\x0B\f\r(:\[]+)"
TAB = 8
_BLOCK = "struct<no:int,name:string,kind:string,parent:int,depth:int,lines:int,own:int>"
_FIELDS = [("no", pa.int32()), ("name", pa.string()), ("kind", pa.string()), ("parent", pa.int32()), ("depth", pa.int32()), ("lines", pa.int32()), ("own", pa.int32())]
_END, _OTHER_END, _HEAD, _DECISION = map(re.compile, (LINE_END, OTHER_LINE_END, HEAD_RE, DECISION_RE))
# without the look at the first character, which Python's matcher takes from the alternatives
_LITERAL = re.compile(STRING_OR_COMMENT_RE.removeprefix(r"""(?=["'#])""").replace(r"\z", r"\Z"))


def _blocks(source: str) -> list[list]:
    """[no, name, kind, parent, depth, lines, decisions] per block of a text, from ``code_only(unix_text(...))`` of it.

    Blocks that are not indented less than a line are left, a head opens a block, decisions go to the innermost one.
    """
    blocks: list[list] = []
    stack: list[tuple[int, list]] = []  # indents of the open blocks, rising
    left_open, wrapped = 0, False
    text = _END.sub("\n", source) if _OTHER_END.search(source) else source
    for line in _LITERAL.sub(lambda m: "" if m[1] else STRING_NAME, text).split("\n"):
        body = line.lstrip(" \t")
        if not body:
            continue
        head = None
        if left_open <= 0 and not wrapped:  # a line that continues a statement leaves no block
            indent = len(line) - len(body)
            indent += (TAB - 1) * line.count("\t", 0, indent)
            while stack and stack[-1][0] >= indent:
                stack.pop()
            head = body.startswith(("def", "class", "async")) and _HEAD.match(line)
        own = len(_DECISION.findall(body))
        if head:
            above = stack[-1][1] if stack else None
            kind = "class" if head[1] == "class" else "method" if above and above[2] == "class" else "function"
            blocks.append([len(blocks), head[2], kind, above[0] if above else -1, len(stack), 1, own])
            stack.append((indent, blocks[-1]))
        elif stack:
            stack[-1][1][5] += 1
            stack[-1][1][6] += own
        count = body.count
        left_open = max(left_open + count("(") + count("[") + count("{") - count(")") - count("]") - count("}"), 0)
        wrapped = "\\" in body and body.rstrip(" ").endswith("\\")
    return blocks


def _blocks_of(sources: pa.Array) -> pa.Array:
    found = [_blocks(s) if s else () for s in sources.to_pylist()]
    rows = zip(*(b for f in found for b in f))
    columns = [pa.array(c, t) for c, (_, t) in zip(rows, _FIELDS)] or [pa.array([], t) for _, t in _FIELDS]
    return pa.ListArray.from_arrays(pa.array([0, *accumulate(map(len, found))], pa.int32()), pa.StructArray.from_arrays(columns, [n for n, _ in _FIELDS]))


def code_blocks(df: DataFrame, keys: list[str], source: str) -> DataFrame:
    """(keys, block_no, name, kind, parent_no, depth, n_lines, complexity): one row per function, method and class of each text.

    ``complexity`` is 1 and the decision words of the block's own lines; nested blocks have
    theirs apart, and lines outside any block count nowhere.  ``n_lines`` are own lines that aren't blank, a multi-line string
    counting as one.  ``parent_no`` is null at the top level.  Brackets and backslashes that carry a statement over lines are followed; syntax is not checked.  A null text has no
    blocks.  A text is read once, in an Arrow batch, in time linear in its length.
    """
    ship_package(df.sparkSession)
    blocks = df.select(*keys, F.explode(F.arrow_udf(_blocks_of, f"array<{_BLOCK}>")(source)).alias("b"))
    return blocks.select(*keys, F.col("b.no").alias("block_no"), F.col("b.name").alias("name"), F.col("b.kind").alias("kind"),
                         F.when(F.col("b.parent") >= 0, F.col("b.parent")).alias("parent_no"), F.col("b.depth").alias("depth"),
                         F.col("b.lines").alias("n_lines"), (F.col("b.own") + 1).alias("complexity"))


def block_complexity(df: DataFrame, keys: list[str], source: str) -> DataFrame:
    """(keys, n_blocks, mean_complexity, most_complexity) over the functions, methods and classes of each text that has any."""
    return code_blocks(df, keys, source).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_blocks"), F.avg("complexity").alias("mean_complexity"),
                                                            F.max("complexity").alias("most_complexity"))
