"""Language identification by language-bitmask filters of character n-grams.

Training weighs the n-grams of every language: a document gives each of its
distinct n-grams an equal share.  A language contains the n-grams that hold enough of its weight and no
much smaller a part of it than in the language where they weigh most.  The sets of
all languages lie in one bit-sliced Bloom filter: a slot is a mask with one bit
per language, and the AND of an n-gram's slots names every language that contains it.
A text's n-grams are counted per language; each count is corrected for the false
positives that the language's share of set bits makes likely, and the
largest corrected count decides.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import join_per_key, ship, written

SIZES = (2, 3, 4)
HASHES = 3
UNKNOWN = "und"
#: Least part of a language's weight that an n-gram of it holds, so a language has at most 500,000; and the least part
#: relative to the language where the n-gram weighs most.
LEAST_SHARE = 2e-6
LEAST_RATIO = 0.25
#: A document shares 2**20 among its n-grams, as if it had 64 at least.
WHOLE, LEAST_GRAMS = 1 << 20, 64
#: Texts are read in pieces of about so many characters, and up to so many texts at once.
PIECE, TEXTS = 1 << 19, 256
FLUSH = 1 << 22

_GRAM_BITS = 48
_MULT = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: crc32(doc_id as text) mod 3 is 1 (null: not held out)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


_KINDS: list[np.ndarray] = []


def _kinds() -> np.ndarray:
    """1 for letters, 2 for marks that join letters, else 0, by code point; made once per worker."""
    if not _KINDS:
        _KINDS.append(np.fromiter((1 if chr(c).isalpha() else 2 if unicodedata.category(chr(c))[0] == "M" else 0
                                   for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1))
    return _KINDS[0]


def pieces(text: str) -> Iterator[str]:
    """A text in pieces of at most PIECE characters, cut at the last space of each if it has one."""
    at = 0
    while len(text) - at > PIECE:
        cut = text.rfind(" ", at, at + PIECE) + 1
        cut = cut if cut > at else at + PIECE
        yield text[at:cut]
        at = cut
    yield text[at:]


def grams(texts: list[str]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """([(gram, text number) of each size], has a letter): the n-grams of the words of lower-cased texts, all occurrences.

    A word is a run of letters and marks; its n-grams include the blank on either side.  A gram is a 48-bit hash.
    """
    lower = [t.lower() for t in texts]
    codes = np.frombuffer(" ".join(lower).encode("utf-32-le"), np.uint32)
    number = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in lower])[:len(codes)]
    kind = _kinds()[codes]
    lettered = np.bincount(number[kind == 1], minlength=len(texts)) > 0
    inside = kind > 0
    keep = inside.copy()
    keep[1:] |= inside[:-1]  # one blank after each word
    c = np.concatenate([[0], np.where(inside[keep], codes[keep], 0), [0]]).astype(np.uint64)
    # a blank belongs to the word before it, so the second character of an n-gram names its text
    of = np.concatenate([[0], number[keep], number[keep][-1:] if keep.any() else [0]])
    out = []
    for n in SIZES:
        m = len(c) - n + 1
        if m <= 0:
            continue
        h, whole = c[:m] + np.uint64(n), np.ones(m, bool)
        for j in range(1, n):
            h = (h * _MULT) ^ c[j:j + m]
            if j < n - 1:
                whole &= c[j:j + m] != 0
        if n == 2:
            whole = (c[:m] != 0) | (c[1:] != 0)
        h = (h ^ (h >> np.uint64(32))) * _MIX
        h ^= h >> np.uint64(32)
        out.append(((h >> np.uint64(64 - _GRAM_BITS))[whole], of[1:m + 1][whole]))
    return out, lettered


def slots_of(gram: np.ndarray, slots: int) -> list[np.ndarray]:
    """The slots of each gram, one array per hash (``slots`` a power of two)."""
    h = gram * _MULT
    step = (h >> np.uint64(40)) | np.uint64(1)
    return [((h >> np.uint64(8)) + np.uint64(k) * step) & np.uint64(slots - 1) for k in range(HASHES)]


@dataclass
class Filters:
    """``masks[w, slot]`` holds the bits of languages 64w to 64w + 63; ``rates`` the chance of a false positive by language."""

    languages: list[str]
    masks: np.ndarray
    rates: np.ndarray

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(n-grams per text, n-grams found per text and language, has a letter)."""
        found, lettered = grams(texts)
        total, hits = np.zeros(len(texts), np.int64), np.zeros((len(texts), len(self.languages)), np.int64)
        for gram, of in found:
            total += np.bincount(of, minlength=len(texts))
            at = slots_of(gram, self.masks.shape[1])
            for w, word in enumerate(self.masks):
                mask = word[at[0]]
                for a in at[1:]:
                    mask &= word[a]
                for bit in range(min(64, len(self.languages) - 64 * w)):
                    hits[:, 64 * w + bit] += np.bincount(of[(mask >> np.uint64(bit)) & np.uint64(1) == 1], minlength=len(texts))
        return total, hits, lettered

    def shares(self, total: np.ndarray, hits: np.ndarray) -> np.ndarray:
        """Part of the n-grams that each language contains, freed of the false positives to expect."""
        per = hits / np.maximum(total, 1)[:, None]
        return np.clip((per - self.rates) / np.maximum(1 - self.rates, 1e-9), 0, 1)


def weighed(docs: DataFrame) -> DataFrame:
    """(lang, gram, weight) of (lang, text), summed over the documents; each task adds up what it has before it is shuffled."""
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def flushed():
            for lang, parts in held.items():
                gram, place = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
                weight = np.bincount(place, np.concatenate([w for _, w in parts])).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram.astype(np.int64)), pa.array(weight)],
                                                 names=["lang", "gram", "weight"])

        for lang, text in _slices(batches):
            numbers = {v: i for i, v in enumerate(sorted(set(lang)))}
            code = np.array([numbers[v] for v in lang])
            key = _distinct_keys(text)
            of, gram = (key >> np.uint64(_GRAM_BITS)).astype(np.int64), key & np.uint64((1 << _GRAM_BITS) - 1)
            weight = (WHOLE // np.maximum(np.bincount(of, minlength=len(text)), LEAST_GRAMS))[of]
            for v, i in numbers.items():
                mine = code[of] == i
                held.setdefault(v, []).append((gram[mine], weight[mine]))
            size += len(key)
            if size > FLUSH:
                yield from flushed()
                held, size = {}, 0
        yield from flushed()

    return (docs.select("lang", "text").mapInArrow(weigh, "lang string, gram long, weight long")
            .groupBy("lang", "gram").agg(F.sum("weight").alias("weight")))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    """Both columns of the batches as lists of at most TEXTS rows and, beyond the first, PIECE characters."""
    for b in batches:
        first, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
        a, size = 0, 0
        for i, t in enumerate(texts):
            if i > a and (i - a >= TEXTS or size + len(t) > PIECE):
                yield first[a:i], texts[a:i]
                a, size = i, 0
            size += len(t)
        if texts[a:]:
            yield first[a:], texts[a:]


def _cut(texts: list[str]) -> Iterator[tuple[list[str], np.ndarray]]:
    """Texts as given if they are short together; a longer one, always alone, piece by piece, with the text's number of each piece."""
    if len(texts) > 1:
        yield texts, np.arange(len(texts))
    else:
        for p in pieces(texts[0]):
            yield [p], np.zeros(1, np.int64)


def _distinct_keys(texts: list[str]) -> np.ndarray:
    """Distinct n-grams of each text; a key holds the text's number above the gram."""
    keys, n_pieces = [], 0
    for n_pieces, (some, number) in enumerate(_cut(texts), 1):
        keys += [np.unique((number[of].astype(np.uint64) << np.uint64(_GRAM_BITS)) | g) for g, of in grams(some)[0]]
    key = np.concatenate(keys) if keys else np.empty(0, np.uint64)
    return key if n_pieces == 1 else np.unique(key)


def learn(docs: DataFrame, least_share: float = LEAST_SHARE, least_ratio: float = LEAST_RATIO) -> Filters:
    """Filters of every language in (lang, text); rows without a language or text teach nothing.

    The driver gets the masks of the filter's slots: at most 8 for each n-gram of the richest language, which has no more than
    1 / ``least_share``.
    """
    spark = docs.sparkSession
    ship(spark)
    weights = written(weighed(docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())), "language-weights")
    totals = weights.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("total"))
    share = join_per_key(weights, totals, "lang", "n").select("lang", "gram", (F.col("weight") / F.col("total")).alias("share")).where(F.col("share") >= least_share)
    top = share.groupBy("gram").agg(F.max("share").alias("top"))
    kept = written(share.join(top, "gram").where(F.col("share") >= least_ratio * F.col("top")).select("lang", "gram"), "language-grams")
    sizes = {r.lang: r.n for r in kept.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per language
    languages = sorted(sizes)
    slots = max(1024, 1 << (8 * max(sizes.values(), default=1) - 1).bit_length())
    masks = np.zeros((-(-len(languages) // 64), slots), np.uint64)
    bit = {v: i for i, v in enumerate(languages)}

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            number = np.array([bit[v] for v in b.column("lang").to_pylist()], np.int64)
            for at in slots_of(b.column("gram").to_numpy().astype(np.uint64), slots):
                yield pa.RecordBatch.from_arrays([pa.array(number // 64), pa.array(at.astype(np.int64)),
                                                  pa.array((np.uint64(1) << (number % 64).astype(np.uint64)).view(np.int64))], names=["w", "slot", "mask"])

    cells = kept.mapInArrow(placed, "w long, slot long, mask long").groupBy("w", "slot").agg(F.bit_or("mask").alias("mask")).toArrow()
    masks[cells.column("w").to_numpy(), cells.column("slot").to_numpy()] = cells.column("mask").to_numpy().view(np.uint64)
    fill = np.array([np.count_nonzero((masks[i // 64] >> np.uint64(i % 64)) & np.uint64(1)) / slots for i in range(len(languages))])
    return Filters(languages, masks, fill ** HASHES)


def predict(docs: DataFrame, filters: Filters) -> DataFrame:
    """(doc_id, lang_pred, score) of every row of (doc_id, text): the language with the largest corrected share, and that share.

    A null text and one without a letter are ``und`` with score 0, as is every text if no language was learned.  A text none of
    whose n-grams is known goes to the first learned language with score 0; ties go to the first in order of code points.
    Texts of any length are read whole, in pieces; empty tables give no rows; repeated rows and null doc_ids keep theirs.
    """
    spark = docs.sparkSession
    ship(spark)
    model = spark.sparkContext.broadcast(filters)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = model.value
        for ids, texts in _slices(batches):
            total, hits = np.zeros(len(texts), np.int64), np.zeros((len(texts), len(f.languages)), np.int64)
            lettered = np.zeros(len(texts), bool)
            for some, number in _cut(texts):
                t, h, has = f.counts(some)
                np.add.at(total, number, t)
                np.add.at(hits, number, h)
                lettered[number] |= has
            if f.languages:
                share = f.shares(total, hits)
                best = share.argmax(axis=1)
                lang = [f.languages[i] if ok else UNKNOWN for i, ok in zip(best, lettered)]
                score = np.where(lettered, share[np.arange(len(texts)), best], 0.0)
            else:
                lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                                             names=["doc_id", "lang_pred", "score"])

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
            .mapInArrow(judge, "doc_id long, lang_pred string, score double"))
