"""Counterfactually regularised toxicity classifier.

A linear model over words and word beginnings.  Labelled sentences that name a
group are rewritten with the other terms of the same kind, and the fit penalises
the squared change of the score between the two, so a neutral mention of one
group scores like that of another and identity terms alone carry no weight that
their labels happened to give them.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import ship, written

# Terms that are swapped for each other, by kind, in English, German, French and Spanish.
IDENTITY_TERMS = {
    "gender": ("women", "men", "girls", "boys", "transgender", "nonbinary"),
    "gender of one": ("woman", "man", "girl", "boy", "female", "male"),
    "orientation": ("gay", "lesbian", "bisexual", "straight", "heterosexual", "homosexual", "queer"),
    "religion": ("muslim", "christian", "jewish", "hindu", "buddhist", "sikh", "catholic", "atheist"),
    "believers": ("muslims", "christians", "jews", "hindus", "buddhists", "sikhs", "catholics", "atheists"),
    "origin": ("african", "american", "arab", "asian", "chinese", "european", "indian", "latino", "mexican"),
    "colour": ("black", "white", "brown"),
    "body": ("blind", "deaf", "disabled", "autistic"),
    "age": ("old", "young", "elderly", "teenage"),
    "gender, German": ("frauen", "männer", "mädchen", "jungen"),
    "orientation, German": ("schwul", "lesbisch", "bisexuell", "heterosexuell", "homosexuell"),
    "believers, German": ("muslime", "christen", "juden", "buddhisten", "katholiken", "atheisten"),
    "origin, German": ("afrikaner", "amerikaner", "araber", "asiaten", "chinesen", "europäer", "inder", "türken", "polen"),
    "body, German": ("blinde", "gehörlose", "behinderte", "autisten"),
    "gender, French": ("femmes", "hommes", "filles", "garçons"),
    "orientation, French": ("gays", "lesbiennes", "bisexuels", "hétérosexuels", "homosexuels"),
    "believers, French": ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "catholiques", "athées"),
    "origin, French": ("africains", "américains", "arabes", "asiatiques", "chinois", "européens", "indiens", "algériens", "roumains"),
    "body, French": ("aveugles", "sourds", "handicapés", "autistes"),
    "gender, Spanish": ("mujeres", "hombres", "niñas", "niños"),
    "orientation, Spanish": ("gais", "lesbianas", "bisexuales", "heterosexuales", "homosexuales"),
    "believers, Spanish": ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "católicos", "ateos"),
    "origin, Spanish": ("africanos", "americanos", "árabes", "asiáticos", "chinos", "europeos", "indios", "mexicanos", "gitanos"),
    "body, Spanish": ("ciegos", "sordos", "discapacitados", "autistas"),
}

#: Bounds of the sample of labelled rows that the model is fitted on.
MOST_TOXIC = 4000
MOST_CLEAN = 6000
MOST_FEATURES = 1000
LEAST_DOCUMENTS = 5
PREFIXES = (3, 4, 5, 6, 7, 8)

_RUN = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[.!?\n]+")


def word_features(word: str) -> list[str]:
    """The word itself (with an end mark) and the beginnings that it continues."""
    return [word + "$", *(word[:n] for n in PREFIXES if len(word) > n)]


def features(text: str) -> set[str]:
    return {f for w in set(_RUN.findall(text.lower())) for f in word_features(w)}


def counterfactuals(text: str, kinds: dict[str, tuple[str, ...]]) -> Iterator[tuple[set[str], set[str]]]:
    """For every sentence that names a group: features it loses and gains when the term is swapped for each other one."""
    kind_of = {t: k for k, terms in kinds.items() for t in terms}
    for sentence in _SENTENCE.split(text.lower()):
        words = _RUN.findall(sentence)
        named = {w for w in words if w in kind_of}
        for term in sorted(named):
            before = {f for w in words for f in word_features(w)}
            for other in kinds[kind_of[term]]:
                if other != term:
                    after = {f for w in words for f in word_features(other if w == term else w)}
                    yield before - after, after - before


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


@dataclass
class Model:
    weights: dict[str, float]
    bias: float


def training_rows(docs: DataFrame, labels: DataFrame, most_toxic: int, most_clean: int) -> DataFrame:
    """(text, y, w): a bounded seeded sample per class of the labelled rows that aren't held out; w undoes the sampling.

    Several labels of one document count as toxic if one does; null labels and
    labels without a document teach nothing.  The sample holds at most the
    bounds on average, so its broadcast is bounded.
    """
    known = (labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").filter(~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.max((F.col("toxic") == 1).cast("int")).alias("y")))
    counts = {r.y: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    part = {y: min(1.0, most / max(1, counts.get(y, 0))) for y, most in ((1, most_toxic), (0, most_clean))}
    draw = F.pmod(F.xxhash64(F.lit("toxicity"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    share = F.when(F.col("y") == 1, part[1]).otherwise(part[0])
    picked = known.filter(draw < share).select("doc_id", "y", (1 / share).alias("w"))
    return written(docs.filter("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(picked), "doc_id")
                   .select("text", "y", "w"), "toxicity-sample")


def choose_features(sample: DataFrame, most: int, least: int) -> list[str]:
    """The features with the greatest G statistic against the label, among those in ``least`` documents or more."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen = (Counter(), Counter())
            for text, y in zip(b.column("text").to_pylist(), b.column("y").to_pylist()):
                seen[y].update(features(text))
            for y, c in enumerate(seen):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), pa.string()), pa.array(np.full(len(c), y), pa.int32()), pa.array(list(c.values()), pa.int64())],
                    names=["f", "y", "n"])

    total = {r.y: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n1, n0 = float(total.get(1, 0)), float(total.get(0, 0))
    found = sample.select("text", "y").mapInArrow(count, "f string, y int, n long").groupBy("f").agg(
        F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("b"))

    def term(seen, of):  # seen * log(seen / expected)
        expected = (F.col("a") + F.col("b")) * of / (n1 + n0)
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    g = term(F.col("a"), n1) + term(F.col("b"), n0)
    rows = found.filter(F.col("a") + F.col("b") >= least).withColumn("g", g).orderBy(F.desc("g"), "f").limit(most).select("f").collect()
    return [r.f for r in rows]


def _rows_of(sample: DataFrame, names: list[str], kinds: dict) -> list:
    """Sampled rows as indices of chosen features, with the index pairs of their counterfactuals."""
    index = {f: i for i, f in enumerate(names)}

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, lost, gained = [], [], []
            for text in b.column("text").to_pylist():
                at.append(sorted(index[f] for f in features(text) if f in index))
                pairs = {(tuple(sorted(index[f] for f in p if f in index)), tuple(sorted(index[f] for f in q if f in index)))
                         for p, q in counterfactuals(text, kinds)}
                pairs.discard(((), ()))
                lost.append([list(p) for p, _ in sorted(pairs)])
                gained.append([list(q) for _, q in sorted(pairs)])
            yield pa.RecordBatch.from_arrays(
                [b.column("y"), b.column("w"), pa.array(at, pa.list_(pa.int32())), pa.array(lost, pa.list_(pa.list_(pa.int32()))),
                 pa.array(gained, pa.list_(pa.list_(pa.int32())))], names=["y", "w", "at", "lost", "gained"])

    return sample.mapInArrow(encode, "y int, w double, at array<int>, lost array<array<int>>, gained array<array<int>>").collect()


def _fit(rows: list, size: int, ridge: float, strength: float, steps: int) -> tuple[np.ndarray, float]:
    """Weighted logistic loss + ridge + strength * mean squared score change over counterfactual pairs, by Adam."""
    rows = sorted(rows, key=lambda r: (r.y, r["at"]))  # no dependence on the order of arrival
    y = np.array([r.y for r in rows], float)
    k = np.array([r.w for r in rows])
    k = k / k.sum()
    flat = np.fromiter((i for r in rows for i in r["at"]), np.int64)
    owner = np.repeat(np.arange(len(rows)), [len(r["at"]) for r in rows])
    pairs = [(p, q) for r in rows for p, q in zip(r.lost, r.gained)]
    c_flat = np.fromiter((i for p, q in pairs for i in [*p, *q]), np.int64)
    c_sign = np.fromiter((s for p, q in pairs for s in [1.0] * len(p) + [-1.0] * len(q)), float)
    c_owner = np.repeat(np.arange(len(pairs)), [len(p) + len(q) for p, q in pairs])
    w, bias = np.zeros(size), 0.0
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, steps + 1):
        z = np.bincount(owner, w[flat], len(rows)) + bias
        miss = k * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        grad = np.bincount(flat, miss[owner], size) + ridge * w
        if pairs:
            change = np.bincount(c_owner, c_sign * w[c_flat], len(pairs))
            grad += 2 * strength / len(pairs) * np.bincount(c_flat, c_sign * change[c_owner], size)
        g = np.append(grad, miss.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.1 * (1 - (step - 1) / steps) * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    return w, bias


def fit(docs: DataFrame, labels: DataFrame, *, kinds: dict[str, tuple[str, ...]] = IDENTITY_TERMS, strength: float = 1.0,
        ridge: float = 3e-4, steps: int = 200, most_toxic: int = MOST_TOXIC, most_clean: int = MOST_CLEAN,
        most_features: int = MOST_FEATURES, least_documents: int = LEAST_DOCUMENTS) -> Model:
    """Fit on a bounded sample of labelled texts (``most_toxic`` + ``most_clean`` rows on average).

    Without labels of both kinds the score is constant: the share of toxic labels, one half if there are none.
    """
    ship(docs.sparkSession)
    sample = training_rows(docs, labels, most_toxic, most_clean)
    mass = {r.y: r["s"] for r in sample.groupBy("y").agg(F.sum("w").alias("s")).collect()}
    if len(mass) < 2:
        return Model({}, 30.0 if mass.get(1) else -30.0 if mass else 0.0)
    names = choose_features(sample, most_features, least_documents)
    w, bias = _fit(_rows_of(sample, names, kinds), len(names), ridge, strength, steps)
    return Model({f: float(x) for f, x in zip(names, w)}, float(bias))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """(doc_id, score) for every row: the model's probability for the whole text; null and empty texts get the bias alone."""
    ship(docs.sparkSession)
    weights, bias = model.weights, model.bias

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, tuple[str, ...]] = {}
        for b in batches:
            if len(cache) > 300_000:
                cache.clear()
            z = np.empty(b.num_rows)
            for i, t in enumerate(b.column("__t")):
                found: set[str] = set()
                for w in set(_RUN.findall(t.as_py().lower())):
                    own = cache.get(w)
                    if own is None:
                        own = cache[w] = tuple(f for f in word_features(w) if f in weights)
                    if own:
                        found.update(own)
                z[i] = bias + sum(sorted(weights[f] for f in found))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))), pa.float64())],
                                             names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__t"))
    return rows.mapInArrow(run, "doc_id long, score double")
