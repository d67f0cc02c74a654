"""Vector codes, language filters and Merkle manifest: brute force, odd inputs, hot keys."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from changelens.llm import base, language_id, merkle, vector_codes
from changelens.llm.queries import QUERIES

VECTORS = "vec_id long, embedding array<float>, label int, code string, v int, n int"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, n int, leaf string, score string, `odd name` string"
SMOKE = "/root/testdata/sf0.001"


# ------------------------------------------------------------------ vector codes

def brute_codes(rows, entries=256, rounds=4):
    """{place: (code, error)} and the codebooks, by comparing every part to every entry."""
    kept = [(i, r[0], [math.floor(1024 * float(np.float32(x))) for x in r[1]]) for i, r in enumerate(rows)
            if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    longest = max((len(v) for _, _, v in kept), default=0)
    w = -(-longest // 4)
    kept = [(i, k, v + [0] * (4 * w - len(v))) for i, k, v in kept]
    first = sorted(kept, key=lambda t: (t[1] is None, t[1] or 0, t[2]))[:entries]
    books = [[v[p * w:p * w + w] for _, _, v in first] for p in range(4)]

    def near(part, p):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), j) for j, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(4):
            mine = defaultdict(list)
            for _, _, v in kept:
                mine[near(v[p * w:p * w + w], p)[1]].append(v[p * w:p * w + w])
            for j, parts in mine.items():
                books[p][j] = [sum(c) // len(parts) for c in zip(*parts)]
    out = {}
    for i, _, v in kept:
        best = [near(v[p * w:p * w + w], p) for p in range(4)]
        out[i] = ("".join(f"{j:02x}" for _, j in best), sum(d for d, _ in best))
    return out, books


def check_codes(spark, rows, entries=256):
    df = spark.createDataFrame([(k, v, label, "x", i, 0) for i, (k, v, label) in enumerate(rows)], VECTORS)
    codes, books = vector_codes.compress(df.withColumn("extra", F.lit(1)), entries=entries)
    want, want_books = brute_codes(rows, entries)
    got = Counter((r.vec_id, r.code, r.error) for r in codes.collect())
    assert got == Counter((rows[i][0], *want[i]) for i in want)
    assert books.tolist() == want_books
    per = defaultdict(int)
    for i, (_, e) in want.items():
        per[rows[i][2]] += e
    for r in vector_codes.with_label_error(codes).collect():
        assert r.label_error == per[r.label]


def test_codes_match_brute_force_with_ties_and_copies(spark):
    rng = random.Random(9)
    rows = [(i, [rng.gauss(0, 0.1) for _ in range(12)], rng.randrange(3)) for i in range(150)]
    rows += [(1000 + i, rows[i % 7][1], None) for i in range(60)]      # copies of few vectors
    rows += [(2000 + i, [0.0] * 3 + [rng.choice([0.0, 0.25]) for _ in range(9)], 1) for i in range(80)]  # shared parts, ties
    check_codes(spark, rows, entries=16)


def test_codes_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, -0.5, 0.25, 1.0], 1), (2, None, 1), (3, [0.1, None, 0.2, 0.3], 1), (4, [nan, 0, 0, 0], 1), (5, [inf, 0, 0, 0], 2), (6, [0, -inf, 0, 0], 2),
            (1, [0.5, -0.5, 0.25, 1.0], 1), (1, [0.25, 0.5, 0.5, 0.5], None), (None, [0.75, 0.5, 0.25, 0.0], None), (7, [], 3), (8, [1.0, 2.0], 3),
            (9, [0.1] * 7, 3)]
    check_codes(spark, [(k, v and [x if x is None else float(x) for x in v], label) for k, v, label in rows])


def test_codes_of_no_and_of_empty_vectors(spark):
    none = spark.createDataFrame([(1, None, 1, "", 0, 0)], VECTORS)
    codes, books = vector_codes.compress(none)
    assert vector_codes.with_label_error(codes).count() == 0 and books.shape[1] == 0
    assert vector_codes.codebooks_digest(books) == hashlib.sha256(b"").hexdigest()
    codes, _ = vector_codes.compress(spark.createDataFrame([(1, [], 1, "", 0, 0), (2, [], 1, "", 0, 0)], VECTORS))
    assert [(r.code, r.error) for r in codes.collect()] == [("00000000", 0)] * 2


def test_components_out_of_range_are_held(spark):
    big = [(1, [3e38, -3e38, 1e20, 0.0], 1), (2, [0.0, 1.0, 2.0, 3.0], 1), (3, [3e38, -3e38, 1e20, 0.0], None)]
    codes, books = vector_codes.compress(spark.createDataFrame([(*r, "", 0, 0) for r in big], VECTORS), entries=1)
    assert abs(books).max() <= vector_codes.LARGEST and vector_codes.with_label_error(codes).count() == 3


def test_trie_distances_equal_plain_ones_in_large_subtrees():
    rng = np.random.default_rng(1)
    x = np.unique(np.concatenate([rng.integers(-3, 3, (4000, 6)), rng.integers(-2 ** 24, 2 ** 24, (50, 6))]), axis=0)
    for book in (rng.integers(-3, 3, (40, 6)), rng.integers(-2 ** 24, 2 ** 24, (40, 6))):
        for rows in (x, x[np.abs(x).max(axis=1) < 10]):
            code, error = vector_codes.nearest(rows, book)
            d = ((rows[:, None, :] - book[None]) ** 2).sum(axis=2)
            assert (code == d.argmin(axis=1)).all() and (error == d.min(axis=1)).all()


# ------------------------------------------------------------------ language

def brute_grams(text):
    words, word = [], ""
    for ch in text.lower() + " ":
        if ch.isalpha() or language_id._kinds()[ord(ch)] == 2:
            word += ch
        elif word:
            words, word = [*words, f" {word} "], ""
    return Counter(w[i:i + n] for w in words for n in language_id.SIZES for i in range(len(w) - n + 1))


def test_grams_are_those_of_the_words():
    texts = ["The cat, the  CAT!", "", " \n ", "12 34", "Über été\tİstanbul", "été नमस्ते", "a", "x" * 50]
    found, lettered = language_id.grams(texts)
    for i, t in enumerate(texts):
        got = Counter()
        for gram, of in found:
            got += Counter(gram[of == i].tolist())
        assert sorted(got.values()) == sorted(brute_grams(t).values()), t
    assert lettered.tolist() == [any(c.isalpha() for c in t.lower()) for t in texts]


def test_filters_match_sets_of_strings(spark):
    docs = base.read(spark, SMOKE, "documents").where("lang IS NOT NULL AND text IS NOT NULL")
    rows = docs.select("lang", "text").collect()
    weight, total = defaultdict(Counter), Counter()
    for r in rows:
        gs = set(brute_grams(r.text))
        for g in gs:
            w = language_id.WHOLE // max(len(gs), language_id.LEAST_GRAMS)
            weight[r.lang][g] += w
            total[r.lang] += w
    share = {v: {g: w / total[v] for g, w in c.items() if w / total[v] >= language_id.LEAST_SHARE} for v, c in weight.items()}
    top = {}
    for c in share.values():
        for g, s in c.items():
            top[g] = max(top.get(g, 0), s)
    sets = {v: {g for g, s in c.items() if s >= language_id.LEAST_RATIO * top[g]} for v, c in share.items()}
    filters = language_id.learn(docs)
    assert filters.languages == sorted(sets)
    wrong = 0
    for r in rows[:60]:
        grams = brute_grams(r.text)
        n = sum(grams.values())
        t, hits, _ = filters.counts([r.text])
        assert t[0] == n
        exact = {v: sum(c for g, c in grams.items() if g in s) for v, s in sets.items()}
        assert all(hits[0][i] >= exact[v] for i, v in enumerate(filters.languages))  # no false negative
        if n:
            share_ = filters.shares(t, hits)[0]
            assert all(abs(share_[i] - exact[v] / n) < 0.05 for i, v in enumerate(filters.languages) if n > 200)
            wrong += filters.languages[int(share_.argmax())] != max(sorted(exact), key=lambda v: exact[v])
    assert wrong <= 1


def test_languages_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    got = QUERIES["op12_language_id"](spark, sf)
    true = base.read(spark, sf, "documents").select("doc_id", "lang")
    held = got.join(true, "doc_id").where("held_out AND lang IS NOT NULL")
    n, right = held.agg(F.count(F.lit(1)), F.count_if(F.col("lang") == F.col("lang_pred"))).first()
    assert n > 2000 and right > 0.97 * n
    assert got.where("score < 0 OR score > 1").isEmpty()


def test_languages_of_odd_documents(spark, monkeypatch):
    en, de = "the house and the garden with flowers ", "das haus und der garten mit blumen "
    train = [(en * 3, "en"), (de * 3, "de"), (None, "fr"), ("", "es"), ("12 34", "it"), ("nothing to learn", None)] * 3
    docs = spark.createDataFrame([(i, t, v, "s", 0, 0, "", "", "") for i, (t, v) in enumerate(train)], DOCS)
    filters = language_id.learn(docs)
    assert filters.languages == ["de", "en"]
    ask = [(1, "The garden"), (2, "Der Garten"), (3, None), (4, ""), (5, " 12 !"), (6, en * 30_000), (None, "house"), (2, "Der Garten"), (7, "жук"), (8, de * 30_000)]
    q = spark.createDataFrame([(i, t, "??", "s", 0, 0, "", "", "") for i, t in ask], DOCS)
    got = Counter((r.doc_id, r.lang_pred) for r in language_id.predict(q, filters).collect())
    assert got == Counter({(1, "en"): 1, (2, "de"): 2, (3, "und"): 1, (4, "und"): 1, (5, "und"): 1, (6, "en"): 1, (None, "en"): 1, (7, "de"): 1, (8, "de"): 1})
    assert language_id.predict(q.limit(0), filters).count() == 0
    nothing = language_id.learn(docs.limit(0))
    assert {r.lang_pred for r in language_id.predict(q, nothing).collect()} == {"und"}


def test_pieces_of_a_long_text_teach_and_count_like_the_whole(monkeypatch):
    rng = random.Random(2)
    text = " ".join("".join(rng.choice("abcdef") for _ in range(rng.randrange(1, 9))) for _ in range(400))
    whole = np.unique(language_id._distinct_keys([text]))
    monkeypatch.setattr(language_id, "PIECE", 100)
    assert "".join(language_id.pieces(text)) == text and len(list(language_id.pieces(text))) > 20
    assert (language_id._distinct_keys([text]) == whole).all()


def test_more_than_64_languages(spark):
    letters = [chr(0x4E00 + 50 * i) for i in range(70)]
    docs = spark.createDataFrame([(i, c * 5, f"l{i:02d}", "", 0, 0, "", "", "") for i, c in enumerate(letters)], DOCS)
    filters = language_id.learn(docs)
    assert filters.masks.shape[0] == 2
    assert all(r.lang_pred == f"l{r.doc_id:02d}" for r in language_id.predict(docs, filters).collect())


# ------------------------------------------------------------------ manifest

def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in r])


def brute_manifest(rows):
    """Counter of manifest rows from (doc_id, source, lang, n_chars, text)."""
    def climb(hashes):
        """(top, path of sibling pairs of each) of a list of digests."""
        paths, level, at = [[] for _ in hashes], list(hashes), list(range(len(hashes)))
        while len(level) > 1:
            for i in range(len(hashes)):
                k = at[i]
                run = level[k // 8 * 8:k // 8 * 8 + 8]
                paths[i].append(("".join(run[:k % 8]), "".join(run[k % 8 + 1:])))
            level = [H(*level[i:i + 8]) for i in range(0, len(level), 8)]
            at = [k // 8 for k in at]
        return level[0], paths

    langs = defaultdict(list)
    for r in rows:
        langs[r[2]].append(r)
    order = sorted(langs, key=lambda v: (v is not None, (v or "").encode()))
    tops = []
    for v in order:
        langs[v].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        tops.append(climb([leaf(r) for r in langs[v]]))
    root, above = climb([t for t, _ in tops])
    out = Counter()
    for v, (top, paths), up in zip(order, tops, above):
        for r, path in zip(langs[v], paths):
            path = path + up
            bad = r
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None:
                bad = (*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]))
            folded = leaf(bad)
            for a, b in path:
                folded = H(a, folded, b)
            out[(r[0], leaf(r), top, root, H(*[a + b for a, b in path]), folded, folded == root)] += 1
    return out


def check_manifest(spark, rows):
    df = spark.createDataFrame([(r[0], r[4], r[2], r[1], r[3], 5, "x", "y", "z") for r in rows], DOCS)
    got = merkle.manifest(df)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert Counter(tuple(r) for r in got.collect()) == brute_manifest(rows)


def test_manifest_of_odd_documents(spark):
    rows = [(i, "src", "en", 3, f"Text {i}") for i in range(70)]
    rows += [(5, "src", "en", 3, "other text of 5"), (6, "src", "en", 3, "Text 6"), (None, None, None, None, None), (None, "", "", 0, ""), (None, "", "", 0, "")]
    rows += [(100, "s", "zz", 1, "ÄÖ A"), (101, "s", "é", None, None), (102, "s", "\U0001F600", 9, "Z" * 100_000), (-3, None, None, 2, "NEGATIVE")]
    check_manifest(spark, rows)


@pytest.mark.parametrize("n", [1, 2, 8, 9, 65])
def test_manifest_sizes_and_one_language(spark, n):
    check_manifest(spark, [(7 * i, None, "en", i, "ABC") for i in range(n)])


def test_manifest_of_many_languages(spark):
    check_manifest(spark, [(i, "s", f"l{i}", i, "Q") for i in range(12)] + [(100 + i, "s", "l3", i, "Q") for i in range(30)])


def test_manifest_of_no_documents(spark):
    assert merkle.manifest(spark.createDataFrame([], DOCS)).count() == 0

