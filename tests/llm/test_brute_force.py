"""Whole queries and every pipeline stage against plain Python or SQL on the smoke tables."""

import hashlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from changelens.llm import base, fingerprints, packing, quality_rules
from changelens.llm.queries import ORACLE, QUERIES, TOKENIZER

SMOKE = "/root/testdata/sf0.001"


def shingles(text):
    words = [w for w in text.encode().split()]
    return {b" ".join(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_fingerprints_of_the_smoke_table(spark):
    rows = sorted(base.read(spark, SMOKE, "documents").select("doc_id", "text").collect())
    got = {r.doc_id: r for r in QUERIES["op2_fingerprints"](spark, SMOKE).collect()}
    assert sorted(got) == [r.doc_id for r in rows]
    off = []
    for r, after in zip(rows, [*rows[1:], rows[0]]):
        text, nxt, g = r.text or "", after.text or "", got[r.doc_id]
        half = len(text) // 2
        edited = text[:len(text) - half] + nxt[:half]
        assert g.n_chars == len(text) and g.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert g.fingerprint == fingerprints.to_text(fingerprints.sketch(text, base.SHINGLE_WORDS, fingerprints.SCALE))
        assert g.edited_fingerprint == fingerprints.to_text(fingerprints.sketch(edited, base.SHINGLE_WORDS, fingerprints.SCALE))
        for near, other in ((g.near_edited, edited), (g.near_next, nxt)):
            a, b = shingles(text), shingles(other)
            true = len(a & b) / min(len(a), len(b)) if a and b else float(a == b)
            if min(len(a), len(b)) <= 32:  # the floor keeps such sets whole
                assert abs(near - true) < 1e-9 or not (a and b)
            else:
                off.append(abs(near - true))
    # a sketch is an estimate: of a few dozen shingles it may hold but a handful in the range both cover
    assert np.mean(off) < 0.06 and np.quantile(off, 0.95) < 0.3


def sql(query, tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toArrow())
    return con.execute(query).fetchall()


def test_every_pipeline_stage(spark):
    docs = base.read(spark, SMOKE, "documents")
    states = [docs]
    for name, stage in corpus_pipeline.STAGES:
        states.append(base.written(stage(spark, states[-1], SMOKE), f"brute-{name}").cache())
        states[-1].count()
    rules, lines, one, mixed, packed = states[1:]

    rated = quality_rules.rate_documents(docs, base.read(spark, SMOKE, "labels")).collect()
    assert Counter(r.doc_id for r in rules.collect()) == Counter(r.doc_id for r in rated if r.kept)
    assert all(not r.kept for r in rated if r.base_failed)

    want = sql(f"SELECT doc_id, text FROM ({ORACLE['op7_line_dedup']})", {"documents": rules})
    assert Counter(want) == Counter((r.doc_id, r.text) for r in lines.collect())

    classes = defaultdict(list)
    for doc_id, class_id in sql(f"SELECT doc_id, class_id FROM ({ORACLE['op5_jaccard_join']})", {"documents": lines}):
        classes[class_id].append(doc_id)
    assert sorted(min(c) for c in classes.values()) == sorted(r.doc_id for r in one.collect())
    assert {r.doc_id: r.text for r in one.collect()}.items() <= {r.doc_id: r.text for r in lines.collect()}.items()

    taken = dict(sql(f"SELECT doc_id, taken FROM ({ORACLE['op9_mixing']})", {"documents": one}))
    words = Counter()
    for r in mixed.collect():
        words[r.doc_id] += len((r.text or "").encode().split())
    assert words == Counter({k: v for k, v in taken.items() if v})

    tokenizer = Tokenizer.from_file(public_tokenizers.path(TOKENIZER))
    ids = Counter()
    for r in mixed.collect():
        ids[(r.doc_id, tuple([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, packing.END]))] += 1
    pieces, at = defaultdict(list), defaultdict(list)
    for r in packed.collect():
        pieces[r.doc_id].append(r)
        at[r.sequence_id].append((r.offset, r.length))
    assert sum(len(i) * n for (_, i), n in ids.items()) == sum(r.length for p in pieces.values() for r in p)
    for (doc_id, i), n in ids.items():
        mine = [r for r in pieces[doc_id] if r.doc_tokens == len(i)]
        crc = [packing.zlib.crc32(np.array(i[r.start:r.start + r.length], "<u4").tobytes()) for r in mine]
        assert sum(c == r.ids_crc32 for c, r in zip(crc, mine)) >= n and sum(r.length for r in mine) >= n * len(i)
    for s in at.values():
        s.sort()
        assert s[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(s, s[1:]))
        total = s[-1][0] + s[-1][1]
        assert total == packing.LENGTH or total & (total - 1) == 0


def test_documents_are_packed_in_the_order_of_the_curve(spark):
    rows = base.read(spark, SMOKE, "documents").select("doc_id", "text").collect()
    enc = packing.Encoder(public_tokenizers.path(TOKENIZER))
    table = packing._vector_table(max(enc.tokenizer.get_vocab_size(), packing.END + 1))
    ids = enc.batch_ids([r.text or "" for r in rows], packing.END)
    keys = packing.hilbert_key(np.array([packing._place(i, table) for i in ids]))
    order = sorted(range(len(rows)), key=lambda i: (int(keys[i]), rows[i].doc_id))
    got = QUERIES["op8_packing"](spark, SMOKE).select("doc_id", "start", "sequence_id", "offset").collect()
    first = sorted((r.sequence_id, r.offset, r.doc_id) for r in got if r.start == 0)
    assert [d for _, _, d in first] == [rows[i].doc_id for i in order]
