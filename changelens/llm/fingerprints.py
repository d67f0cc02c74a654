"""Threshold-scaled document sketches: every shingle hash below a fixed fraction of the hash range.

A sketch keeps the hashes of five-word shingles below ``2**64 / SCALE`` and, so
that short texts are not lost, never fewer than its ``FLOOR`` least ones.  Both
rules depend on the set of shingles alone, so sketches of parts merge into the
sketch of the whole, and two sketches are compared on the hash range that both
cover in full: exactly for short texts, by an unbiased sample for long ones, of
however unequal length.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import SHINGLE_WORDS, shingle_hashes, ship

SCALE = 16
FLOOR = 32
_NO_ID = -(2 ** 63)


def _kept(hashes: np.ndarray, scale: int) -> np.ndarray:
    return hashes[:max(FLOOR, int(np.searchsorted(hashes, np.uint64(2 ** 64 // scale))))]


def sketch(text: str | None, words: int = SHINGLE_WORDS, scale: int = SCALE) -> np.ndarray:
    """Sorted retained shingle hashes; none for a text without words."""
    return _kept(shingle_hashes(text, words), scale)


def merge(a: np.ndarray, b: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Sketch of the union of two shingle sets."""
    return _kept(np.union1d(a, b), scale)


def _covered(s: np.ndarray, scale: int) -> int:
    """Hashes under this bound are all in the sketch."""
    return 2 ** 64 if len(s) < FLOOR else max(2 ** 64 // scale, int(s[FLOOR - 1]) + 1)


def compare(a: np.ndarray, b: np.ndarray, scale: int = SCALE) -> tuple[float, float]:
    """Estimated (containment of the smaller set in the larger, Jaccard similarity), exact if both texts are short.

    Equal sketches give 1, wordless ones too; a text with no hash in the
    shared range gives 0.
    """
    bound = min(_covered(a, scale), _covered(b, scale))
    if bound < 2 ** 64:
        a, b = (s[:int(np.searchsorted(s, np.uint64(bound)))] for s in (a, b))
    if not len(a) or not len(b):
        same = float(len(a) == len(b) and bound == 2 ** 64)
        return same, same
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / min(len(a), len(b)), both / (len(a) + len(b) - both)


def to_text(s: np.ndarray) -> str:
    """Retained hashes in order, 16 hexadecimal digits each."""
    return s.astype(">u8").tobytes().hex()


def from_text(s: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(s), ">u8").astype(np.uint64)


def sketches(docs: DataFrame, words: int = SHINGLE_WORDS, scale: int = SCALE) -> DataFrame:
    """(doc_id, fingerprint) for every row; null and empty texts have an empty fingerprint."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([to_text(sketch(t.as_py(), words, scale)) for t in b.column("text")], pa.string())],
                names=["doc_id", "fingerprint"])

    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fingerprint string")


def _first_ids(docs: DataFrame) -> list[int]:
    """Least id of each of a few ranges per shuffle partition, in order: a list as long as the cluster is wide."""
    spark = docs.sparkSession
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("__d"))
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = ids.repartitionByRange(n, "__d").groupBy(F.spark_partition_id()).agg(F.min("__d").alias("first")).collect()
    return sorted({r["first"] for r in rows})


def _edited(text: str, after: str) -> str:
    half = len(text) // 2
    return text[:len(text) - half] + after[:half]


def compare_edits(docs: DataFrame, words: int = SHINGLE_WORDS, scale: int = SCALE) -> DataFrame:
    """Sketches of every text and of its edit, whose second half gives way to the start of the next document.

    Next is by doc_id (null first), then by the hash of the text; after the last
    comes the first.  Each text moves once, packed, to the range of ids it lies
    in; the first document of a range goes to the range before as well.  A range
    is read in order, two documents at a time.
    """
    ship(docs.sparkSession)
    firsts = np.array(_first_ids(docs), np.int64)
    columns = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next",
               "jaccard_edited", "jaccard_next"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = b.column("__d").to_numpy()
            packed = pa.array([zlib.compress(t.as_py().encode("utf-8", "replace"), 1) for t in b.column("__t")], pa.binary())
            place = np.searchsorted(firsts, d, "right") - 1
            ahead = np.nonzero(firsts[place] == d)[0]
            rows = np.concatenate([np.arange(len(d)), ahead])
            ranges = np.concatenate([place, (place[ahead] - 1) % len(firsts)])
            look = np.concatenate([np.zeros(len(d), bool), np.ones(len(ahead), bool)])
            take = pa.array(rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ranges, pa.int64()), pa.array(look), b.column("__d").take(take), b.column("__h").take(take), packed.take(take)],
                names=["range", "look", "__d", "__h", "z"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (range, id, text, sketch) of a document that waits for its next one
        for b in batches:
            out: list[list] = [[] for _ in columns]
            for rng, look, d, z in zip(*(b.column(c).to_pylist() for c in ("range", "look", "__d", "z"))):
                text = zlib.decompress(z).decode()
                if look and (held is None or held[0] != rng):
                    continue  # a further row with the first id of the next range
                own = sketch(text, words, scale)
                if held is not None and held[0] == rng:
                    _, i, before, s = held
                    edit = _edited(before, text)
                    e = sketch(edit, words, scale)
                    (ce, je), (cn, jn) = compare(s, e, scale), compare(s, own, scale)
                    row = (None if i == _NO_ID else i, len(before), hashlib.sha256(edit.encode()).hexdigest(), to_text(s), to_text(e), ce, cn, je, jn)
                    for o, v in zip(out, row):
                        o.append(v)
                held = None if look else (rng, d, text, own)
            if out[0]:
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), *[pa.float64()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(o, k) for o, k in zip(out, kinds)], names=columns)

    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("__d"), F.xxhash64(text).alias("__h"), text.alias("__t"))
    dealt = (rows.mapInArrow(deal, "range long, look boolean, __d long, __h long, z binary")
             .repartition("range").sortWithinPartitions("range", "look", "__d", "__h"))
    return dealt.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
                                 "near_edited double, near_next double, jaccard_edited double, jaccard_next double")
