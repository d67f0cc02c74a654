"""Packing token sequences along a space-filling curve through hashed document vectors.

Each document becomes its token ids and an end id.  Its hashed bag of ids is
projected to a few dimensions, and the place on a Hilbert curve through them is
its sort key; the documents are range-sorted by it and the ids laid end to end,
cut every ``length`` ids.  What is left after the last full sequence is cut into
powers of two, so no sequence needs padding.  Neighbours on the curve share
sequences.
"""

from __future__ import annotations

import gc
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import ordered_totals, ship, written

LENGTH = 2048
END = 1
BUCKETS = 256
DIMS = 4
BITS = 15
CACHED_WORDS = 1_000_000


def hilbert_key(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Index along the Hilbert curve of integer points (n, dims) with coordinates under 2**bits.

    From the top bit down, each level names its cell by a Gray code and then
    turns the axes so that the sub-curve starts where the last one ended.
    """
    x = [c.astype(np.int64) for c in points.T]
    top = 1 << (bits - 1)
    q = top
    while q > 1:
        low = q - 1
        for axis in x:
            flip = (axis & q) != 0
            swap = np.where(flip, 0, (x[0] ^ axis) & low)
            axis ^= swap
            x[0] ^= np.where(flip, low, swap if axis is not x[0] else 0)
        q >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = top
    while q > 1:
        turn ^= np.where((x[-1] & q) != 0, q - 1, 0)
        q >>= 1
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for axis in x:
            key = (key << 1) | (((axis ^ turn) >> b) & 1)
    return key


#: Letters that lower-case and decompose alike everywhere, and signs after them.
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-įı-ſ]+)([!-/:-@\[-`{-~]*)")

CONTROL = re.compile("[\x1c-\x1f]")
_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of a tokenizer file, made once per worker, so its cache serves all tasks there."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _cut(ids: np.ndarray, ends: np.ndarray, skip: int) -> list[bytes]:
    """The bytes of ``ids`` up to each of ``ends``, ``skip`` ids left out after each."""
    raw, stops = ids.tobytes(), (4 * ends).tolist()
    starts = [0, *(4 * (ends + skip)).tolist()]
    return [raw[i:j] for i, j in zip(starts, stops)]


class Encoder:
    """Token ids of whole texts; a bounded cache of two generations holds the ids of single words.

    Valid for tokenizers that drop white space, lower the case and part letters and digits from other characters, as
    the one used here: they never join over a space, tab or line end.  Words used since the last change of
    generations outlive it.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers
        from tokenizers.pre_tokenizers import ByteLevel, CharDelimiterSplit
        from tokenizers.pre_tokenizers import Sequence as Steps

        self.tokenizer = Tokenizer.from_file(path)
        # the same model without its normalizer and word pattern, for words that need neither
        self.letters, self.ascii = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.letters.normalizer = self.ascii.normalizer = normalizers.Sequence([])
        self.letters.pre_tokenizer = Steps([CharDelimiterSplit(" "), ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ascii.pre_tokenizer = CharDelimiterSplit(" ")
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(self.tokenizer.model.end_of_word_suffix)]] = True
        self.signs = {"": b""}
        (self.mark,) = self.tokenizer.encode("\0", add_special_tokens=False).ids
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _encode_plain(self, words: list[str]) -> list[bytes]:
        """Ids of lower-case words of letters, as bytes: one call over all of them, cut after each id that ends a word."""
        joined = " ".join(words)
        model = self.ascii if joined.isascii() else self.letters
        ids = np.array(model.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4")
        return _cut(ids, np.flatnonzero(self.ends[ids]) + 1, 0)

    def _encode(self, words: list[str]) -> list[bytes]:
        """Ids of any words without blanks, as bytes: one call over all of them, cut at a control character between them."""
        if any("\0" in w for w in words):
            return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        ids = np.array(self.tokenizer.encode_batch_fast([" \0 ".join([*words, ""])], add_special_tokens=False)[0].ids, "<u4")
        return _cut(ids, np.flatnonzero(ids == self.mark), 1)

    def learn(self, words: set[str]) -> None:
        """Put the ids of ``words``, which the young generation lacks, into it; words new to both are encoded together.

        A word of Latin letters has the ids of its lower case, and then those of the signs at its end.
        """
        young, old, signs = self.young, self.old, self.signs
        if old:
            young.update((w, old[w]) for w in words if w in old)
            words = words.difference(young)
        new = list(words)
        found = list(zip(new, map(PLAIN.fullmatch, new)))
        plain = [(w, m[1].lower(), m[2]) for w, m in found if m]
        stems = set(stem for _, stem, _ in plain).difference(young)
        for some in ([v for v in stems if v.isascii()], [v for v in stems if not v.isascii()]):
            if some:
                young.update(zip(some, self._encode_plain(some)))
        for sign in set(sign for _, _, sign in plain).difference(signs):
            signs[sign] = np.array(self.tokenizer.encode(sign, add_special_tokens=False).ids, "<u4").tobytes()
        young.update((w, young[stem] + signs[sign]) for w, stem, sign in plain)
        others = [w for w, m in found if not m]
        if others:
            young.update(zip(others, self._encode(others)))

    def batch_ids(self, texts: list[str], end: int) -> list[np.ndarray]:
        """Ids of each text, and then ``end``; the words that the cache lacks are looked up for all texts together."""
        if len(self.young) > CACHED_WORDS // 2:
            self.old, self.young = self.young, {}
        # split() also cuts at four control characters, which the tokenizer keeps
        words = [t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") if CONTROL.search(t) else t.split() for t in texts]
        found = [list(map(self.young.get, w)) for w in words]
        lacks = [i for i, ids in enumerate(found) if None in ids]
        if lacks:
            self.learn({w for i in lacks for w, ids in zip(words[i], found[i]) if ids is None})
            for i in lacks:
                found[i] = [self.young[w] if ids is None else ids for w, ids in zip(words[i], found[i])]
        last = np.array([end], "<u4").tobytes()
        return [np.frombuffer(b"".join([*ids, last]), "<u4") for ids in found]


def _vector_table(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and sign of every token id (a hash), and the projection of the buckets."""
    h = np.arange(size, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    bucket = (h >> np.uint64(56)).astype(np.int64) % BUCKETS
    sign = np.where((h >> np.uint64(40)) & np.uint64(1), 1.0, -1.0)
    return bucket, sign, np.random.default_rng(7).standard_normal((BUCKETS, DIMS))


def _place(ids: np.ndarray, table) -> np.ndarray:
    """Coordinates of a document in [0, 2**BITS): its hashed, damped and normed bag of ids, projected and squashed."""
    bucket, sign, projection = table
    v = np.bincount(bucket[ids], sign[ids], BUCKETS)
    v = np.sign(v) * np.log1p(np.abs(v))
    y = (v / max(np.sqrt((v * v).sum()), 1e-12)) @ projection
    return np.minimum((1 / (1 + np.exp(-1.702 * y)) * 2 ** BITS).astype(np.int64), 2 ** BITS - 1)


def id_width(tokenizer: str, end: int = END) -> int:
    """Bytes of a stored id: two for up to 65,536 kinds, else four."""
    from tokenizers import Tokenizer

    return 2 if max(Tokenizer.from_file(tokenizer).get_vocab_size(), end + 1) <= 65536 else 4


def encoded(docs: DataFrame, tokenizer: str, end: int = END) -> DataFrame:
    """(row, doc_id, __h, key, n, ids) per row of ``docs``, written: place on the curve, number of ids with the end
    id, and the ids as zstd-packed little-endian numbers of
    two bytes, or four for more than 65,536 kinds.  ``row`` numbers the rows in no order."""
    width = id_width(tokenizer, end)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        table = _vector_table(max(enc.tokenizer.get_vocab_size(), end + 1))
        kind = "<u2" if len(table[0]) <= 65536 else "<u4"
        gc.disable()  # nothing here makes cycles, and each collection would walk the whole cache
        try:
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    b = batch.slice(at, 256)
                    n, places, packed = [], [], []
                    for ids in enc.batch_ids(b.column("__t").to_pylist(), end):
                        n.append(len(ids))
                        places.append(_place(ids, table))
                        packed.append(pa.compress(ids.astype(kind).tobytes(), "zstd", asbytes=True))
                    yield pa.RecordBatch.from_arrays(
                        [b.column("doc_id"), b.column("__h"), pa.array(hilbert_key(np.array(places)), pa.int64()), pa.array(n, pa.int64()),
                         pa.array(packed, pa.binary())], names=["doc_id", "__h", "key", "n", "ids"])
        finally:
            gc.enable()

    ship(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("__h"), text.alias("__t"))
    coded = rows.mapInArrow(encode, "doc_id long, __h long, key long, n long, ids binary")
    return written(coded.withColumn("row", F.monotonically_increasing_id()), "pack-encoded")


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, end: int = END) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset): one row per piece.

    ``length`` must be a power of two.  Null and empty texts are the end id
    alone.  Every row of ``docs`` is packed, repeated rows too.  No documents: no
    rows.
    """
    if length & (length - 1):
        raise ValueError("length must be a power of two")
    coded = encoded(docs, tokenizer, end)
    # ties on the curve go by doc_id, then the hash of the text; equal rows in any order
    places = ordered_totals(coded.select("row", "key", "doc_id", "__h", "n"), ["key", "doc_id", "__h", "row"], {"n": "at"}, "pack-order")
    total = coded.agg(F.sum("n")).first()[0] or 0
    full, rest = divmod(total, length)
    sizes = [1 << b for b in range(length.bit_length() - 1, -1, -1) if rest >> b & 1]
    tail = full * length + np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)

    width = id_width(tokenizer, end)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        for b in batches:
            out: list[list] = [[] for _ in names]
            for doc_id, at, n, packed in zip(*(b.column(c).to_pylist() for c in ("doc_id", "at", "n", "ids"))):
                ids, start = np.frombuffer(pa.decompress(packed, width * n, "zstd"), f"<u{width}").astype("<u4").tobytes(), 0
                while start < n:
                    pos = at + start
                    if pos < full * length:
                        seq, offset = divmod(pos, length)
                        stop = (seq + 1) * length
                    else:
                        i = int(np.searchsorted(tail, pos, "right")) - 1
                        seq, offset, stop = full + i, pos - int(tail[i]), int(tail[i + 1])
                    size = min(n - start, stop - pos)
                    for o, v in zip(out, (doc_id, start, size, zlib.crc32(ids[4 * start:4 * (start + size)]), n, seq, offset)):
                        o.append(v)
                    start += size
            yield pa.RecordBatch.from_arrays([pa.array(o, pa.int64()) for o in out], names=names)

    placed = coded.select("row", "doc_id", "n", "ids").join(places.select("row", "at"), "row")
    return placed.mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
