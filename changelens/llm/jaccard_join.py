"""Jaccard self-join of word shingles by a MinHash LSH forest, reduced to bands, with exact verification.

Texts with the same shingle set collapse to one entry first.  Every entry has
``TREES`` bands; its node in a band is the hash of a run of MinHash values.  The run
is as long, up to ``LONGEST``, as lets a pair at the threshold meet in some band
with probability ``RECALL`` (pairs above the threshold meet more often); the
threshold is fixed, so no prefix is shortened by what the data holds.  Entries
that share a node are compared by one-byte sketches inside the task that holds
the node; it passes on a spanning forest, at most one row per member, never the
pairs.  Entries connected that way are verified exactly against each other in
blocks, and links are counted there.

Wordless texts (null, empty, blank) are one class without links; texts of fewer
than five words match only equal word sequences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import NEAR, SHINGLE_WORDS, components, join_per_key, ship, shingle_hashes, written

TREES = 32
LONGEST = 8
RECALL = 0.99999
#: Sketch agreement under which a pair is no candidate; a pair at 0.8 falls below once in 10^8 (6.3 standard deviations).
SKETCH_MARGIN = 0.2
BLOCK = 512

_MIX = np.uint64(0x9E3779B97F4A7C15)


def prefix_length(threshold: float, trees: int = TREES, longest: int = LONGEST, recall: float = RECALL) -> int:
    """The longest prefix at which a pair of similarity ``threshold`` meets in some trie with probability ``recall``."""
    for d in range(longest, 1, -1):
        if 1 - (1 - threshold ** d) ** trees >= recall:
            return d
    return 1


def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return (rng.integers(0, 2 ** 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1),
            rng.integers(0, 2 ** 63, n, dtype=np.uint64))


def minhash(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    least = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 1024):
        np.minimum(least, (shingles[i:i + 1024, None] * a + b).min(axis=0), out=least)
    return least


def signatures(docs: DataFrame, threshold: float, words: int) -> DataFrame:
    """(__d, __h, digest, n, nodes, sketch) per row; digest names the shingle set, nodes the trie nodes."""
    depth = prefix_length(threshold)
    schema = "__d long, __h long, digest string, n int, nodes array<long>, sketch binary"

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        a, b = _coefficients(TREES * depth)
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("digest", "n", "nodes", "sketch")}
            for text in batch.column("__t"):
                s = shingle_hashes(text.as_py(), words)
                out["digest"].append(xxhash.xxh3_128_hexdigest(s.tobytes()))
                out["n"].append(len(s))
                if not len(s):
                    out["nodes"].append([])
                    out["sketch"].append(b"")
                    continue
                m = minhash(s, a, b)
                path = np.arange(TREES, dtype=np.uint64)
                for j in range(depth):
                    path = (path + m[j::depth]) * _MIX
                    path ^= path >> np.uint64(31)
                out["nodes"].append(path.view(np.int64))
                out["sketch"].append(((m * _MIX) >> np.uint64(56)).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("__d"), batch.column("__h"), pa.array(out["digest"], pa.string()), pa.array(out["n"], pa.int32()),
                 pa.array(out["nodes"], pa.list_(pa.int64())), pa.array(out["sketch"], pa.binary())],
                names=["__d", "__h", "digest", "n", "nodes", "sketch"])

    return docs.select(*row_key(), F.coalesce("text", F.lit("")).alias("__t")).mapInArrow(sign, schema)


def row_key() -> list:
    """Rows equal in doc_id and text share this key (a null doc_id counts as the least long)."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2 ** 63))).alias("__d"),
            F.xxhash64(F.coalesce("text", F.lit(""))).alias("__h")]


def _in_blocks(rows: DataFrame, keys: list[str], size: str) -> DataFrame:
    """Deal the members of a group to pairs of blocks of about BLOCK members: one (i, j) for every pair i <= j.

    A group of one block gets one copy of each member; a larger one as many as
    it has blocks.
    """
    blocks = F.ceil(F.col(size) / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("digest"), blocks).cast("int")
    return (rows.withColumn("__blocks", blocks).withColumn("own", own)
            .withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)))
            .withColumn("bi", F.least("own", "__other")).withColumn("bj", F.greatest("own", "__other"))
            .drop("__blocks", "__other", size))


def _tasks(df: DataFrame) -> int:
    """Number of tasks for comparisons: their work grows faster than their bytes, so they aren't joined by bytes."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Groups of rows sorted by ``keys``, across batch borders."""
    held: list[pd.DataFrame] = []
    last = None
    for batch in batches:
        df = batch.to_pandas()
        if not len(df):
            continue
        marks = df[keys].ne(df[keys].shift()).any(axis=1).to_numpy().nonzero()[0].tolist()
        for start, stop in zip(marks, [*marks[1:], len(df)]):
            part = df.iloc[start:stop]
            key = tuple(part.iloc[0][keys])
            if key != last and held:
                yield held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)
                held = []
            held.append(part)
            last = key
    if held:
        yield held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)


def _forest(linked: np.ndarray) -> np.ndarray:
    """For a symmetric boolean matrix: the least index of every row's component."""
    n = len(linked)
    root = np.full(n, -1)
    for i in range(n):
        if root[i] >= 0:
            continue
        todo = [i]
        root[i] = i
        while todo:
            near = np.nonzero(linked[todo.pop()] & (root < 0))[0]
            root[near] = i
            todo.extend(near.tolist())
    return root


def candidate_edges(entries: DataFrame, threshold: float) -> DataFrame:
    """(u, v): a spanning forest of every trie node's members whose sketches agree enough."""
    nodes = entries.filter("n > 0").select("digest", F.posexplode("nodes").alias("tree", "node"))
    crowded = nodes.groupBy("tree", "node").agg(F.count("*").alias("size")).filter("size > 1")
    members = nodes.join(crowded, ["tree", "node"]).join(entries.select("digest", "sketch"), "digest")
    keys = ["tree", "node", "bi", "bj"]
    dealt = _in_blocks(members, ["tree", "node"], "size").repartition(_tasks(entries), *keys).sortWithinPartitions(*keys)
    least = threshold - SKETCH_MARGIN

    def compare(batches):
        for g in _grouped(batches, keys):
            if len(g) < 2:
                continue
            sketch = np.frombuffer(b"".join(g["sketch"]), np.uint8).reshape(len(g), -1)
            names, need = g["digest"].to_numpy(), least * sketch.shape[1]
            if len(g) == 2:
                root = np.array([0, 0 if (sketch[0] == sketch[1]).sum() >= need else 1])
            else:
                root = _forest(np.stack([(sketch == row).sum(axis=1) >= need for row in sketch]))
            far = np.nonzero(root != np.arange(len(g)))[0]
            if len(far):
                yield pa.RecordBatch.from_arrays([pa.array(names[far], pa.string()), pa.array(names[root[far]], pa.string())],
                                                 names=["u", "v"])

    return dealt.select(*keys, "digest", "sketch").mapInArrow(compare, "u string, v string").distinct()


def _links(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Boolean matrix of pairs with exact Jaccard similarity of at least ``threshold``."""
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, term, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count[term] > 1
    names, col = np.unique(term[shared], return_inverse=True)
    row = owner[shared]
    inter = np.zeros((len(sets), len(sets)), np.float32)
    width = max(256, 2 ** 22 // len(sets))
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    for start in range(0, len(names), width):
        lo, hi = np.searchsorted(col, [start, start + width])
        m = np.zeros((len(sets), min(width, len(names) - start)), np.float32)
        m[row[lo:hi], col[lo:hi] - start] = 1
        inter += m @ m.T
    inter = inter.astype(np.int64)
    union = sizes[:, None] + sizes[None, :] - inter
    linked = inter >= threshold * union - 1e-9
    np.fill_diagonal(linked, False)
    return linked


def verified(docs: DataFrame, members: DataFrame, threshold: float, words: int) -> DataFrame:
    """(digest, links, peer): links to the texts of other entries counted per pair of blocks, and a peer in the same component there.

    ``members``: (digest, root, size, n_texts, __d, __h).  Each entry's text is read once; groups larger than BLOCK are
    compared block against block.
    """
    def shingled(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c) for c in ("digest", "root", "size", "n_texts")],
                 pa.array([shingle_hashes(t.as_py(), words).tobytes() for t in b.column("__t")], pa.binary())],
                names=["digest", "root", "size", "n_texts", "set"])

    texts = (docs.select(*row_key(), F.coalesce("text", F.lit("")).alias("__t"))
             .join(members, ["__d", "__h"]).select("digest", "root", "size", "n_texts", "__t"))
    sets = texts.mapInArrow(shingled, "digest string, root string, size long, n_texts long, set binary")
    keys = ["root", "bi", "bj"]
    dealt = (_in_blocks(sets, ["root"], "size").repartition(_tasks(docs), *keys).sortWithinPartitions(*keys, "digest")
             .select(*keys, "own", "digest", "set", "n_texts"))

    def verify(batches):
        for g in _grouped(batches, keys):
            g = g[~g["digest"].duplicated()]  # rows equal in doc_id and text
            if len(g) < 2:
                continue
            linked = _links([np.frombuffer(x, np.uint64) for x in g["set"]], threshold)
            own, names = g["own"].to_numpy(), g["digest"].to_numpy()
            if g["bi"].iloc[0] != g["bj"].iloc[0]:
                linked &= own[:, None] != own[None, :]  # pairs inside a block are met in that block's own group
            some = np.nonzero(linked.any(axis=1))[0]
            if len(some):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names[some], pa.string()), pa.array((linked @ g["n_texts"].to_numpy())[some], pa.int64()),
                     pa.array(names[_forest(linked)][some], pa.string())], names=["digest", "links", "peer"])

    return dealt.mapInArrow(verify, "digest string, links long, peer string")


def near_duplicates(docs: DataFrame, threshold: float = NEAR, words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, __d, __h, root, class_id, n_links, n_copies, class_size), one row for every row of ``docs``.

    class_id: the least doc_id of the row's class, a connected component of
    texts linked at ``threshold`` or more; n_links: how many other texts are
    linked to the row's, those with the same shingle set among them
    (texts without a word are one class and have no links); n_copies: rows with the row's own shingle set.
    A class without any doc_id has a null class_id; root always names it.
    """
    ship(docs.sparkSession)
    signed = written(signatures(docs.select("doc_id", "text"), threshold, words), "near-signatures")
    known = F.when(F.col("__d") != -(2 ** 63), F.col("__d"))
    one = written(signed.groupBy("digest").agg(F.min(F.struct("__d", "__h")).alias("k"), F.min(known).alias("first_id"), F.count("*").alias("n_copies"),
                                                F.greatest(F.count_distinct(F.when(F.col("n") > 0, F.col("__h"))), F.lit(1)).alias("n_texts"))
                  .select("digest", "k.__d", "k.__h", "first_id", "n_copies", "n_texts"), "near-entries")
    entries = signed.select("digest", "n", "nodes", "sketch", "__d", "__h").join(
        one.select("__d", "__h", "digest"), ["__d", "__h", "digest"], "left_semi").dropDuplicates(["digest"])
    entries = written(entries, "near-distinct")
    found = components(candidate_edges(entries, threshold), "u", "v", "near-candidates")
    sizes = found.groupBy("root").agg(F.count("*").alias("size"))
    members = written(join_per_key(found, sizes, "root", "size").withColumnRenamed("node", "digest")
                      .join(one.select("digest", "n_texts", "__d", "__h"), "digest"), "near-members")
    linked = written(verified(docs, members, threshold, words), "near-links")
    classes = components(linked.filter("digest != peer").select("digest", "peer"), "digest", "peer", "near-classes")
    links = linked.groupBy("digest").agg(F.sum("links").alias("n_links"))
    entry = (one.join(classes.withColumnRenamed("node", "digest"), "digest", "left").join(links, "digest", "left")
             .withColumn("root", F.coalesce("root", "digest")))
    entry = written(entry.select("digest", "root", "first_id", "n_copies", (F.coalesce("n_links", F.lit(0)) + F.col("n_texts") - 1).alias("n_links")), "near-linked")
    per_class = entry.groupBy("root").agg(F.min("first_id").alias("class_id"), F.sum("n_copies").alias("class_size"), F.count("*").alias("__n"))
    entry = join_per_key(entry, per_class, "root", "__n").select("digest", "root", "class_id", "n_links", "n_copies", "class_size")
    return (join_per_key(signed.select(known.alias("doc_id"), "__d", "__h", "digest"), entry, "digest", "n_copies")
            .drop("digest"))


def keep_one(docs: DataFrame, threshold: float = NEAR, words: int = SHINGLE_WORDS) -> DataFrame:
    """One row of every class: the one with the least doc_id (rows without one last), then the least hash of its text; own columns only."""
    near = near_duplicates(docs, threshold, words)
    keepers = near.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "__d", "__h")).alias("k")).select("k.__d", "k.__h")
    row = docs.select(F.struct("*").alias("__row"), *row_key())
    kept = row.join(keepers, ["__d", "__h"], "left_semi").dropDuplicates(["__d", "__h"])
    return kept.select("__row.*")
