"""Merkle manifest of a table of documents, with inclusion proofs by pointer jumping.

Each row is a leaf; per language the leaves are numbered by doc_id and every 8
consecutive nodes become one, until one remains, and the languages' subroots
form one more tree.  For the proofs every inner node holds a pointer to an ancestor and the
segment of siblings on the way there, at first its parent and its own siblings.
A self-join of the nodes doubles the distance and concatenates the segments,
so the number of joins is the logarithm of the height.  A leaf's proof is its
own siblings and the segment of the node above it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import join_per_key, ordered_totals, written

FAN = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: A row whose doc_id has a checksum that this divides is tampered with.
TAMPER_EACH = 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(text: Column) -> Column:
    """Lowercase hex sha256."""
    return F.sha2(text, 256)


def hexed(c: Column) -> Column:
    return F.lower(F.hex(c))


def leaf_digest(fields: list[Column]) -> Column:
    """Digest of a row: each field ``-`` if null, else its length in UTF-8 bytes, ``:`` and its value."""
    def one(c: Column) -> Column:
        c = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))

    return digest(F.concat(*[one(c) for c in fields]))


def leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, leaf, bad, row): digests of every row, as it is and (null if not tampered with) with text in lower case, written."""
    hit = F.crc32(F.col("doc_id").cast("string")) % TAMPER_EACH == 0
    bad = [F.translate("text", UPPER, LOWER) if f == "text" else F.col(f) for f in FIELDS]
    rows = docs.select("doc_id", "lang", F.unhex(leaf_digest([F.col(f) for f in FIELDS])).alias("leaf"),
                       F.when(hit, F.unhex(leaf_digest(bad))).alias("bad"))
    return written(rows.withColumn("row", F.monotonically_increasing_id()), "merkle-leaves")


def runs_of_leaves(rows: DataFrame, fan: int = FAN) -> tuple[DataFrame, DataFrame]:
    """(runs, groups): a run is up to ``fan`` consecutive leaves of one language (g, n, idx, children, id, hash, cnt); a group is a
    language (lang, n, g, start) with its place ``g`` in the order of languages, null first."""
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).withColumn("one", F.lit(1))
    groups = written(ordered_totals(sizes, ["lang"], {"n": "start", "one": "g"}, "merkle-languages").drop("one"), "merkle-groups")
    # equal rows of one doc_id are told apart by their number, which decides nothing
    placed = ordered_totals(rows.withColumn("one", F.lit(1)), ["lang", "doc_id", "leaf", "row"], {"one": "at"}, "merkle-order")
    placed = join_per_key(placed.select("lang", "doc_id", "leaf", "bad", "at"), groups, "lang", "n").withColumn("i", F.col("at") - F.col("start"))
    run = placed.groupBy("g", "n", F.floor(F.col("i") / fan).alias("idx")).agg(
        F.sort_array(F.collect_list(F.struct((F.col("i") % fan).alias("pos"), "doc_id", "leaf", "bad"))).alias("children"))
    joined = F.array_join(F.transform("children", lambda c: hexed(c["leaf"])), "")
    return written(run.select("g", "n", "idx", "children", F.concat_ws(":", F.lit("leaf"), "g", F.lit("1"), "idx").alias("id"),
                              F.when(F.col("n") == 1, F.col("children")[0]["leaf"]).otherwise(F.unhex(digest(joined))).alias("hash"),
                              F.ceil(F.col("n") / fan).alias("cnt")), "merkle-runs"), groups


def climb(nodes: DataFrame, name: str, fan: int = FAN) -> tuple[DataFrame, list[DataFrame]]:
    """(tops, links) from nodes (g, cnt, idx, id, hash), ``cnt`` nodes a group: the last node of every group, and for every
    other node (id, up, path): its parent, and what lies left and right of it in its run."""
    level, tops, links = 1, [], []
    while True:
        tops.append(nodes.where("cnt = 1").select("g", "id", "hash"))
        more = nodes.where("cnt > 1")
        if more.isEmpty():
            return reduce(DataFrame.unionByName, tops), links
        level += 1
        run = more.groupBy("g", "cnt", F.floor(F.col("idx") / fan).alias("idx")).agg(
            F.sort_array(F.collect_list(F.struct((F.col("idx") % fan).alias("pos"), "id", "hash"))).alias("children"))
        up = written(run.select("g", F.ceil(F.col("cnt") / fan).alias("cnt"), "idx", "children",
                                F.concat_ws(":", F.lit(name), "g", F.lit(level), "idx").alias("id"),
                                F.unhex(digest(F.array_join(F.transform("children", lambda c: hexed(c["hash"])), ""))).alias("hash")), f"merkle-{name}-{level}")
        side = up.select(F.col("id").alias("up"), F.transform("children", lambda c: c["hash"]).alias("h"), F.posexplode("children").alias("pos", "c"))
        links.append(side.select(F.col("c.id").alias("id"), "up", F.array(F.struct(
            _joined(F.slice("h", 1, F.col("pos"))).alias("l"), _joined(F.slice("h", F.col("pos") + 2, fan)).alias("r"))).alias("path")))
        nodes = up.select("g", "cnt", "idx", "id", "hash")


def _joined(hashes: Column) -> Column:
    """Binary values of an array, end to end."""
    return F.aggregate(hashes, F.lit(b""), lambda a, x: F.concat(a, x))


def paths_to_root(links: DataFrame, root: str) -> DataFrame:
    """(id, path) of every node of (id, up, path): siblings from the node to the root, by pointer jumping.

    A node's row is joined to the row of the ancestor it points at.  An ancestor that many nodes point at, as those near the
    root, goes by a broadcast (``join_per_key``).
    """
    table, step = written(links, "merkle-path-0"), 0
    while True:
        far = table.where(F.col("up") != root)
        if far.isEmpty():
            return table.select("id", "path")
        step += 1
        wanted = far.groupBy("up").agg(F.count(F.lit(1)).alias("__n"))
        ahead = table.select(F.col("id").alias("up"), F.col("up").alias("__up"), F.col("path").alias("__path")).join(wanted, "up")
        jumped = join_per_key(far, ahead, "up", "__n").select("id", F.col("__up").alias("up"), F.concat("path", "__path").alias("path"))
        table = written(table.where(F.col("up") == root).unionByName(jumped), f"merkle-path-{step}")


def manifest(docs: DataFrame, fan: int = FAN) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified): one row per row of ``docs``.

    A null field counts as ``-``, an empty text as ``0:``; further columns are ignored.  Null doc_ids come first among the leaves of
    their language and are never tampered with; rows that share a doc_id go by their digest, and equal rows are
    leaves of their own.  A null language is the first group.  No documents: no rows.
    """
    rows = leaves(docs)
    runs, groups = runs_of_leaves(rows, fan)
    tops, links = climb(runs.select("g", "cnt", "idx", "id", "hash"), "leaf", fan)
    tops = written(tops, "merkle-subroots")
    top, more = climb(tops.select(F.lit(0).alias("g"), F.lit(tops.count()).alias("cnt"), F.col("g").alias("idx"), "id", "hash"), "top", fan)
    root = top.first()
    if root is None:
        return rows.select("doc_id", *[F.lit("").alias(c) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")], F.lit(False).alias("verified"))
    # the root points nowhere
    first = top.select("id", F.lit(root.id).alias("up"), F.array().cast("array<struct<l:binary,r:binary>>").alias("path"))
    paths = paths_to_root(reduce(DataFrame.unionByName, links + more, first), root.id)

    per_run = runs.groupBy("g").agg(F.count(F.lit(1)).alias("__n")).join(tops.select("g", F.col("hash").alias("subroot")), "g")
    whole = join_per_key(runs.select("g", "n", "id", "children").join(paths, "id"), per_run, "g", "__n")
    return _folded(whole, bytes(root.hash).hex(), fan)


def _folded(runs: DataFrame, root: str, fan: int) -> DataFrame:
    """The rows of ``manifest`` from runs with their paths: each leaf's proof, and the root that its (tampered) digest folds to."""
    h = runs.withColumns({"h": F.transform("children", lambda c: hexed(c["leaf"])), "subroot": hexed(F.col("subroot")),
                          "path": F.transform("path", lambda s: F.struct(hexed(s["l"]).alias("l"), hexed(s["r"]).alias("r")))})
    each = h.select("n", "subroot", "path", "h", F.array_join(F.transform("path", lambda s: F.concat(s["l"], s["r"])), "").alias("rest"),
                    F.posexplode("children").alias("pos", "c"))
    each = each.select("n", "subroot", "path", "rest", F.col("c.doc_id").alias("doc_id"), F.get("h", F.col("pos")).alias("leaf"),
                       hexed(F.coalesce("c.bad", "c.leaf")).alias("given"),
                       F.array_join(F.slice("h", 1, F.col("pos")), "").alias("l"), F.array_join(F.slice("h", F.col("pos") + 2, fan), "").alias("r"))
    start = F.when(F.col("n") == 1, F.col("given")).otherwise(digest(F.concat("l", "given", "r")))
    folded = F.aggregate("path", start, lambda a, s: digest(F.concat(s["l"], a, s["r"])))
    out = each.select("doc_id", "leaf", "subroot", F.lit(root).alias("root"), digest(F.concat("l", "r", "rest")).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
