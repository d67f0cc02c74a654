"""Product codes of vectors, trained and assigned along a lexicographic trie of distinct parts.

Every vector becomes integers and is cut into equal parts.  The distinct parts
of each position, with how often they occur, are range-sorted, so a task holds
a stretch of the trie in lexicographic order.  It walks its stretch depth
first; a node carries the accumulated squared distances from its prefix to the
prefixes of all codebook entries, which everything below it shares.  A leaf
takes the nearest entry and adds its part, times its weight, to that entry's
sums.  Spark adds the sums up; the codebooks (256 entries a position) are the
only thing that passes the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import join_per_key, ship, written

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
#: Integer components are held within this bound (a component of 16,384), so that a distance fits 64 bits.
LARGEST = 1 << 24
#: A subtree of at most so many leaves is finished level by level.
SUBTREE = 512


def integers(embedding: Column, scale: int = SCALE) -> Column:
    """Components as floor(scale * x), held within LARGEST."""
    return F.transform(embedding, lambda x: F.greatest(F.least(F.floor(F.lit(float(scale)) * F.greatest(F.least(
        x.cast("double"), F.lit(1e9)), F.lit(-1e9))), F.lit(LARGEST)), F.lit(-LARGEST)).cast("int"))


def integer_vectors(vectors: DataFrame, parts: int = PARTS, vec: str = "embedding") -> tuple[DataFrame, int]:
    """(rows, width): the rows with a whole, finite vector as (vec_id, label, v), written, and the components of a part.

    ``v`` has ``parts * width`` components: the longest kept vector's number, rounded up to a multiple of ``parts``;
    shorter vectors end in zeros.
    """
    sound = F.col(vec).isNotNull() & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = written(vectors.where(sound).select("vec_id", "label", integers(F.col(vec)).alias("v")), "codes-vectors")
    longest = rows.agg(F.max(F.size("v"))).first()[0] or 0
    width = -(-longest // parts)
    short = F.lit(parts * width) - F.size("v")
    return rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(0), short))), width


def distinct_parts(rows: DataFrame, parts: int, width: int) -> DataFrame:
    """(p, part, weight): every distinct part of each position and how many vectors have it, in sorted ranges, written.

    Equal parts are counted before they are shuffled, so a part that many vectors share is one row a task.
    """
    cut = rows.select(F.posexplode(F.array(*[F.slice("v", 1 + p * width, width) for p in range(parts)])).alias("p", "part"))
    counted = written(cut.groupBy("p", "part").agg(F.count(F.lit(1)).alias("weight")), "codes-distinct")
    return written(counted.repartitionByRange("p", "part").sortWithinPartitions("p", "part"), "codes-sorted")


def first_codebooks(rows: DataFrame, parts: int, width: int, entries: int = ENTRIES) -> np.ndarray:
    """(parts, entries, width): the parts of the ``entries`` rows of least vec_id (null last, ties by vector)."""
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).select("v").collect()
    return np.array([r.v for r in first], np.int64).reshape(len(first), parts, width).transpose(1, 0, 2).copy()


def nearest(sorted_parts: np.ndarray, codebook: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of every row of ``sorted_parts``, distinct rows in lexicographic order; ties go to the lower entry.

    Depth first over the trie of the rows: the stack holds nodes as (rows from, to, depth, distances of the prefix to the
    prefixes of all entries).
    """
    n, width = sorted_parts.shape
    code, error = np.empty(n, np.int64), np.empty(n, np.int64)
    top = max(int(np.abs(sorted_parts).max(initial=0)), int(np.abs(codebook).max(initial=0)))
    kind = np.int32 if 4 * top * top * max(width, 1) < 2 ** 31 else np.int64
    x, entries = sorted_parts.astype(kind), np.ascontiguousarray(codebook.T.astype(kind))
    stack = [(0, n, 0, np.zeros(codebook.shape[0], kind))] if n else []
    while stack:
        lo, hi, depth, acc = stack.pop()
        if hi - lo <= SUBTREE or depth == width:
            leaves = _finish(x[lo:hi], depth, acc, entries)
            code[lo:hi] = leaves.argmin(axis=1)
            error[lo:hi] = leaves[np.arange(hi - lo), code[lo:hi]]
            continue
        at = lo + np.flatnonzero(np.diff(x[lo:hi, depth], prepend=x[lo, depth] - 1))
        for a, b in zip(at[::-1], np.append(at[1:], hi)[::-1]):
            step = x[a, depth] - entries[depth]
            stack.append((int(a), int(b), depth + 1, acc + step * step))
    return code, error


def _finish(x: np.ndarray, depth: int, acc: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Distances of every row of a small subtree: each level has one line per distinct prefix, made from its parent's."""
    new = np.zeros(len(x), bool)
    new[:1] = True
    lines, line_of = acc[None, :], np.zeros(len(x), np.int64)
    for d in range(depth, x.shape[1]):
        new[1:] |= x[1:, d] != x[:-1, d]
        heads = np.flatnonzero(new)
        step = x[heads, d, None] - entries[d]
        step *= step
        step += lines[line_of[heads]]
        lines, line_of = step, np.cumsum(new) - 1
    return lines[line_of]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _sorted_distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows in lexicographic order, and the place of every row among them."""
    if not x.shape[1]:
        return x[:1], np.zeros(len(x), np.int64)
    order = np.lexsort(x.T[::-1])
    ordered = x[order]
    new = np.ones(len(x), bool)
    new[1:] = (ordered[1:] != ordered[:-1]).any(axis=1)
    place = np.empty(len(x), np.int64)
    place[order] = np.cumsum(new) - 1
    return ordered[new], place


def improved(parts: DataFrame, codebooks: np.ndarray) -> np.ndarray:
    """The codebooks after one round: each entry the floor of the mean of the parts nearest to it; unused entries stay."""
    n_parts, n_entries, width = codebooks.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n_parts, n_entries, width), np.int64)
        count = np.zeros((n_parts, n_entries), np.int64)
        for b in batches:
            p, weight, x = b.column("p").to_numpy(), b.column("weight").to_numpy(), _matrix(b.column("part"), width)
            for q in np.unique(p):
                at = np.flatnonzero(p == q)
                ordered, place = _sorted_distinct(x[at])
                w = np.zeros(len(ordered), np.int64)
                np.add.at(w, place, weight[at])
                code, _ = nearest(ordered, codebooks[q])
                np.add.at(total[q], code, ordered * w[:, None])
                np.add.at(count[q], code, w)
        p, e = np.nonzero(count)
        flat = pa.array(total[p, e].ravel())
        sums_ = pa.ListArray.from_arrays(np.arange(len(p) + 1, dtype=np.int32) * width, flat)
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(count[p, e]), sums_],
                                         names=["p", "e", "n", "s"])

    partial = parts.mapInArrow(sums, "p int, e int, n long, s array<long>")
    whole = partial.groupBy("p", "e").agg(F.sum("n").alias("n"), *[F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(width)])
    out = codebooks.copy()
    for r in whole.collect():  # at most parts * entries rows
        out[r.p, r.e] = [r[f"s{i}"] // r.n for i in range(width)]
    return out


def assigned(rows: DataFrame, codebooks: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error) of every row: a trie over the distinct parts of each batch of rows, so nothing is shuffled."""
    n_parts, _, width = codebooks.shape

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column("v"), n_parts * width)
            codes, error = np.empty((len(x), n_parts), np.uint8), np.zeros(len(x), np.int64)
            for p in range(n_parts):
                ordered, place = _sorted_distinct(x[:, p * width:(p + 1) * width])
                code, far = nearest(ordered, codebooks[p])
                codes[:, p] = code[place]
                error += far[place]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array([c.tobytes().hex() for c in codes]), pa.array(error)],
                                             names=["vec_id", "label", "code", "error"])

    kind = rows.schema["vec_id"].dataType.simpleString(), rows.schema["label"].dataType.simpleString()
    return rows.mapInArrow(assign, f"vec_id {kind[0]}, label {kind[1]}, code string, error long")


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, label, code, error), codebooks): one row per row of ``vectors`` (vec_id, embedding, label) with a sound vector.

    Vectors that are null or hold a null, NaN or infinite component are left out; further columns are ignored.  Vectors
    of several lengths end in zeros up to the longest, rounded up to a multiple of ``parts``; an empty vector is all
    zeros.  Components beyond 16,384 either way count as that.  Repeated rows and repeated or null vec_ids each keep their row;
    in the first codebooks null vec_ids come last and ties go by the vector.  Fewer rows than ``entries`` make smaller codebooks; no rows
    give no rows and empty codebooks.  ``entries`` is 256 at most, so a code is one byte.
    """
    if entries > 256:
        raise ValueError("entries must not exceed 256")
    ship(vectors.sparkSession)
    rows, width = integer_vectors(vectors, parts)
    codebooks = first_codebooks(rows, parts, width, entries)
    if codebooks.shape[1]:
        table = distinct_parts(rows, parts, width)
        for _ in range(rounds):
            codebooks = improved(table, codebooks)
    return assigned(rows, codebooks), codebooks


def codebooks_digest(codebooks: np.ndarray) -> str:
    """sha256 of all components in decimal, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def with_label_error(codes: DataFrame) -> DataFrame:
    """``codes`` with ``label_error``: the errors of all rows of the same label (nulls together) added up."""
    codes = written(codes, "codes-assigned")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(2 ** 63 - 1).cast("decimal(38,0)")).cast("long")
    return join_per_key(codes, codes.groupBy("label").agg(F.count(F.lit(1)).alias("__n"), total.alias("label_error")), "label", "__n").drop("__n")
