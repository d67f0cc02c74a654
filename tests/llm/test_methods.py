"""Methods against brute force, planted structure and held-out labels."""

import html
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from changelens.llm import base, html_extract, jaccard_join, licenses, packing, quality_rules, toxicity
from changelens.llm.queries import QUERIES

SMOKE = "/root/testdata/sf0.001"


def test_quality_statistics_match_brute_force(spark):
    stats = quality_rules.with_statistics(base.read(spark, SMOKE, "documents"))
    for r in stats.select("text", *quality_rules.BASE_STATS).collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", r.text)
        places = defaultdict(list)
        for i in range(len(words) - 7):
            places[tuple(words[i:i + 8])].append(i)
        repeated = {j for at in places.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
        lines = [x for x in r.text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert tuple(r)[1:] == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", r.text)), len(lines) - len(set(lines)), len(repeated))


def test_decision_list_finds_planted_rules(spark):
    rng = random.Random(5)
    data = []
    for i in range(3000):
        row = {f: rng.random() for f in quality_rules.FEATURES}
        bad = row["upper_share"] > 0.7 and row["words"] <= 0.4 or row["repeat_share"] > 0.9
        data.append((*row.values(), bad, i % 3))
    df = spark.createDataFrame(data, ", ".join(f"{f} double" for f in quality_rules.FEATURES) + ", bad boolean, fold int").cache()
    rules = quality_rules.learn(df)
    hit = df.withColumn("out", rules.rule_number() > 0)
    wrong = hit.filter("out != bad").count()
    assert 2 <= len(rules.rules) <= 6 and wrong < 60
    used = {c.feature for r in rules.rules for c in r}
    assert {"upper_share", "words", "repeat_share"} <= used


def test_counterfactual_pairs_take_weight_off_identity_terms(spark):
    rng = random.Random(3)
    nouns = ["bread", "rain", "music", "summer", "letters", "houses"]
    texts = []
    for i in range(600):
        toxic = i % 2
        group = "muslims" if (rng.random() < (0.9 if toxic else 0.1)) else "christians"
        insult = rng.choice(["scum", "trash"]) if toxic and rng.random() < 0.8 else "here"
        texts.append((i, f"The {group} {insult} like {rng.choice(nouns)}. Some {rng.choice(nouns)} too.", toxic))
    docs = spark.createDataFrame([t[:2] for t in texts], "doc_id long, text string")
    labels = spark.createDataFrame([(t[0], t[2]) for t in texts], "doc_id long, toxic int")
    neutral = spark.createDataFrame([(1, "Muslims here like bread."), (2, "Christians here like bread."), (3, "Christians scum.")], "doc_id long, text string")

    def scores(strength):
        model = toxicity.fit(docs, labels, strength=strength, least_documents=1)
        return {r.doc_id: r.score for r in toxicity.score(neutral, model).collect()}

    free, fair = scores(0.0), scores(20.0)
    assert free[1] - free[2] > 0.3 and abs(fair[1] - fair[2]) < 0.1
    assert fair[1] < 0.5 < fair[3]


def test_toxicity_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    got = QUERIES["op1_toxicity"](spark, sf).join(base.read(spark, sf, "labels"), "doc_id").filter("held_out").select("score", "predicted", "toxic").collect()
    pos, neg = ([r for r in got if r.toxic == t] for t in (1, 0))
    assert sum(r.predicted for r in pos) > 0.85 * len(pos) and sum(r.predicted for r in neg) < 0.01 * len(neg)


def test_prefix_length_reaches_recall():
    d = jaccard_join.prefix_length(0.8)
    assert 1 - (1 - 0.8 ** d) ** jaccard_join.TREES >= jaccard_join.RECALL > 1 - (1 - 0.8 ** (d + 1)) ** jaccard_join.TREES


def test_block_links_equal_set_arithmetic():
    rng = np.random.default_rng(2)
    pool = rng.integers(0, 2 ** 63, 400, dtype=np.uint64)
    sets = [np.unique(np.concatenate([pool[:80], rng.choice(pool, rng.integers(0, 40))])) for _ in range(60)]
    got = jaccard_join._links(sets, 0.8)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            both = len(np.intersect1d(a, b))
            assert got[i, j] == (i != j and both >= 0.8 * (len(a) + len(b) - both))


def test_large_groups_are_compared_block_by_block(spark, monkeypatch):
    base_words = [f"w{i}" for i in range(300)]
    docs = []
    for i in range(40):
        words = list(base_words)
        words[7 * i % 300] = f"edit{i}"
        docs.append((i, " ".join(words)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    one = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.near_duplicates(df).collect()}
    monkeypatch.setattr(jaccard_join, "BLOCK", 7)
    many = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.near_duplicates(df).collect()}
    assert one == many == {i: (0, 39) for i in range(40)}


def test_components(spark):
    edges = [(i, i + 1) for i in range(40) if i != 20] + [(100, 7), (200, 201)]
    got = {r.node: r.root for r in base.components(spark.createDataFrame(edges, "a long, b long"), "a", "b", "test").collect()}
    assert got == {**{i: 0 for i in range(21)}, **{i: 21 for i in range(21, 41)}, 100: 0, 200: 200, 201: 200}


def test_hilbert_curve_steps_to_neighbours():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(2 ** bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        key = packing.hilbert_key(grid, bits)
        order = np.argsort(key)
        assert (np.sort(key) == np.arange(len(grid))).all() and (np.abs(np.diff(grid[order], axis=0)).sum(axis=1) == 1).all()


def test_license_cosine_matches_brute_force(spark):
    files = base.read(spark, SMOKE, "documents").select(F.col("doc_id").alias("id"), F.lit("a/b").alias("path"), "text")
    got = {r.id: r for r in licenses.own_licenses(files, licenses.TEMPLATES, 0.3).collect()}
    texts = {r.id: r.text for r in files.collect()}
    df = Counter(t for x in texts.values() for t in set(licenses.terms(x)))
    vocabulary = licenses.template_terms(licenses.TEMPLATES)

    def vector(text):
        top = math.log(len(texts) + 1) + 1
        return {t: c * (math.log((len(texts) + 1) / (df[t] + 1)) + 1 if t in vocabulary else top) for t, c in Counter(licenses.terms(text)).items()}

    def cosine(a, b):
        return sum(x * b.get(t, 0) for t, x in a.items()) / math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))

    notices = [vector(n) for ns in licenses.TEMPLATES.values() for n in ns]
    for i, text in texts.items():
        units = [v for u in [*text.split("\n"), text] if (v := vector(u))]
        best = max((cosine(u, n) for u in units for n in notices), default=0)
        assert abs(got[i].score - (best if best >= 0.3 else 0)) < 1e-9


def test_articles_of_the_pages(spark):
    pages = base.read(spark, SMOKE, "pages")
    got = {r.page_id: r.text for r in html_extract.extract(pages).collect()}
    for r in pages.collect():
        body = re.sub("<br>", " ", re.sub("</?b>", "", re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]))
        want = [" ".join(html.unescape(x).split()) for x in re.split("<[^>]*>", body)]
        assert got[r.page_id] == "\n\n".join(x for x in want if x)


def test_word_cache_of_two_generations_keeps_ids(monkeypatch):
    import public_tokenizers

    class Untouchable(dict):
        def __iter__(self):
            raise AssertionError("the old generation is walked")

    monkeypatch.setattr(packing, "CACHED_WORDS", 40)
    enc = packing.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(4)
    texts = [" ".join(f"word{rng.randrange(300)}" for _ in range(rng.randrange(60))) + rng.choice(["", "\n", "  \tend", " Word7. WORD8, x.. a,b. É. É, it's. ...", " 12. \0 a\0b <|endoftext|>. <|ENDOFTEXT|>", ". , 7, ΣΑΣ. straße,", "ab$$$ c.,; d's e'' f<| g|> h'S. i're", "a\x1cb \x1d. c", "d\xa0e\u2003f\x85g\x0bh\u2028i\u3000."]) for _ in range(80)]
    for at in range(0, len(texts), 7):
        enc.old = Untouchable(enc.old)
        for text, ids in zip(texts[at:at + 7], enc.batch_ids(texts[at:at + 7], 9)):
            assert ids.tolist() == [*enc.tokenizer.encode(text, add_special_tokens=False).ids, 9]
    assert enc.old


def test_links_count_texts_with_one_shingle_set_each(spark):
    words = [f"w{i}" for i in range(60)]
    near = " ".join([*words[:30], "edit", *words[31:]])
    texts = [" ".join(words), "  ".join(words), " ".join(words) + "\n", near, near, "other words of five or more", "", " \t"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.n_links, r.n_copies) for r in jaccard_join.near_duplicates(df).collect()}
    assert got == {0: (0, 3, 3), 1: (0, 3, 3), 2: (0, 3, 3), 3: (0, 3, 2), 4: (0, 3, 2), 5: (5, 0, 1), 6: (6, 0, 2), 7: (6, 0, 2)}


def test_identity_terms_are_swapped_in_each_language():
    for sentence, other in (("Die Muslime essen Brot.", "christen$"), ("Les musulmans mangent du pain.", "juifs$"), ("Los musulmanes comen pan.", "judíos$"),
                            ("The Muslims eat bread.", "jews$")):
        gained = {f for _, after in toxicity.counterfactuals(sentence, toxicity.IDENTITY_TERMS) for f in after}
        assert other in gained
    terms = [t for kind in toxicity.IDENTITY_TERMS.values() for t in kind]
    assert len(terms) == len(set(terms))
