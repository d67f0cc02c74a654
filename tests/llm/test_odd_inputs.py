"""Every operator on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing extra columns."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from changelens.llm import (base, chat_rotation, fingerprints, html_extract, jaccard_join, licenses, line_dedup, mixing, packing,
                            quality_rules, toxicity)
from changelens.llm.queries import TOKENIZER

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words string, kept string, class_id int, `odd name` string"
LONG = "\n".join(" ".join(f"w{i}x{j}" for j in range(40)) for i in range(1500))  # 60,000 words
PROSE = " ".join(f"word{i % 37} other{i}" for i in range(60))


def rows():
    one = [(1, PROSE), (2, None), (3, ""), (4, " \t\n "), (5, PROSE), (6, PROSE.replace("other7 ", "another ")), (7, "short text"),
           (7, "short text"), (None, PROSE + " end"), (None, None), (8, LONG), (9, "x\ny"), (1, PROSE)]
    return [(i, t, "en", None if i == 9 else f"s{(i or 0) % 2}", len(t or ""), "a", "b", 0, "c") for i, t in one]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (5, 0, 1), (None, 1, 1), (8, None, None), (99, 0, 1), (1, 1, 0)], "doc_id long, quality int, toxic int")


def test_quality_rules(spark, docs, none, labels):
    got = quality_rules.rate_documents(docs, labels).collect()
    assert len(got) == len(rows())
    assert all(r.base_failed and not r.kept for r in got if r.n_words == 0)
    assert {r.n_words for r in got if r.doc_id == 8} == {60000}
    kept = quality_rules.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 1, 5, 6, 8]
    assert quality_rules.rate_documents(none, labels).count() == 0 and quality_rules.keep_good(none, labels).count() == 0
    assert quality_rules.rate_documents(docs, labels.limit(0)).filter("kept").count() == 6


def test_line_dedup(spark, docs, none):
    out = line_dedup.drop_repeated_lines(docs)
    assert out.columns == docs.columns
    texts = defaultdict(set)
    for r in out.collect():
        texts[r.doc_id].add(r.text)
    # the whole text of 5 repeats that of 1; equal rows are one document
    assert texts[1] == {PROSE} and texts[5] == {""} and texts[2] == {None} and texts[3] == {""} and texts[8] == {LONG}
    assert out.count() == len(rows()) and line_dedup.drop_repeated_lines(none).count() == 0


def test_jaccard_join(spark, docs, none):
    got = jaccard_join.near_duplicates(docs).collect()
    assert len(got) == len(rows())
    cls = {r.doc_id: r for r in got}
    assert cls[1].class_id == cls[5].class_id == cls[6].class_id == 1
    assert cls[2].class_id == cls[3].class_id == cls[4].class_id == 2 and cls[2].n_links == 0
    assert cls[1].n_copies == 3 and cls[1].n_links == 2 and cls[7].n_copies == 2
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 7, 8, 9]
    assert jaccard_join.near_duplicates(none).count() == 0 and jaccard_join.keep_one(none).count() == 0


def test_mixing(spark, docs, none):
    plan = mixing.plan_mix(docs).collect()
    assert len(plan) == len(rows())
    assert all(0 <= r.taken <= 2 * r["size"] for r in plan)
    per = defaultdict(lambda: [0, 0.0])
    for r in plan:
        per[r.src][0] += r.taken
        per[r.src][1] = r.target
    assert all(abs(t - x) < 1 for t, x in per.values())
    mix = mixing.mixed_documents(docs)
    assert mix.columns == docs.columns
    words = defaultdict(int)
    for r in mix.collect():
        words[r.source] += len(r.text.encode().split())
    assert dict(words) == {s: t for s, (t, _) in per.items() if t}
    assert mixing.plan_mix(none).count() == 0 and mixing.mixed_documents(none).count() == 0
    assert mixing.plan_mix(docs.filter("text IS NULL")).count() == 2


def test_packing(spark, docs, none):
    path = public_tokenizers.path(TOKENIZER)
    tok = Tokenizer.from_file(path)
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in packing.pack(docs, path, length=64).collect():
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append(r)
    for parts in sequences.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at & (at - 1) == 0 and at <= 64
    for i, t in {(r[0], r[1]) for r in rows()}:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        own = [p for p in pieces[i] if p.doc_tokens == len(ids)]
        copies = sum(1 for r in rows() if (r[0], r[1]) == (i, t))
        assert sum(p.length for p in own) == copies * len(ids)
        assert all(zlib.crc32(ids[p.start:p.start + p.length].tobytes()) == p.ids_crc32 for p in own)
    assert packing.pack(none, path).count() == 0


def test_fingerprints(spark, docs, none):
    got = fingerprints.compare_edits(docs).collect()
    assert len(got) == len(rows())
    prints = {r.fingerprint for r in got if r.doc_id in (1, 5)}
    assert len(prints) == 1 and {r.fingerprint for r in got if r.doc_id in (2, 3, 4)} == {""}
    last = next(r for r in got if r.doc_id == 9)  # its next is the first: a null doc_id
    assert last.edited_sha256 in {hashlib.sha256(("x\n" + (t or "")[:1]).encode()).hexdigest() for t in (None, PROSE)}
    assert all(0 <= x <= 1 for r in got for x in (r.near_edited, r.near_next))
    assert fingerprints.compare_edits(none).count() == 0 and fingerprints.sketches(docs).count() == len(rows())
    only = fingerprints.compare_edits(docs.filter("doc_id = 8")).first()
    assert only.edited_sha256 == hashlib.sha256((LONG[:len(LONG) - len(LONG) // 2] + LONG[:len(LONG) // 2]).encode()).hexdigest()


def test_sketches_merge():
    rng = np.random.default_rng(1)
    for n, m in ((3, 4), (10, 5000), (4000, 9000)):
        a, b = (np.unique(rng.integers(0, 2 ** 64 - 1, k, dtype=np.uint64)) for k in (n, m))
        cut = fingerprints._kept
        assert (fingerprints.merge(cut(a, 16), cut(b, 16)) == cut(np.union1d(a, b), 16)).all()
    short, long = [f"w{i}" for i in range(300)], [f"w{i}" for i in range(20000)]
    inside, _ = fingerprints.compare(fingerprints.sketch(" ".join(short)), fingerprints.sketch(" ".join(long)))
    assert inside == 1.0


def test_toxicity(spark, docs, none, labels):
    model = toxicity.fit(docs, labels, least_documents=1)
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(rows()) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(docs, toxicity.fit(docs, labels.limit(0))).filter("score = 0.5").count() == len(rows())
    assert toxicity.score(none, model).count() == 0


def test_chat_rotation(spark):
    odd = [(1, 0, "system", "be <|im_end|> kind", 5), (1, 1, "ann", "hi", 5), (1, 1, "bob", None, 5), (1, 2, "ann", "hi", 5), (1, 2, "ann", "hi", 5),
           (2, 0, "system", "alone", 5), (None, 0, "ann", "é" * 1000, 5), (3, 0, None, "", 5)]
    turns = spark.createDataFrame(odd, "conv_id long, turn int, role string, text string, position int")
    got = chat_rotation.rotate(turns).collect()
    talks = defaultdict(list)
    for r in got:
        talks[r.conv_id, r.perspective].append(r)
    assert set(talks) == {(1, "ann"), (1, "bob"), (None, "ann"), (3, "unknown")}
    for (_, who), parts in talks.items():
        parts.sort(key=lambda r: r.position)
        assert [r.position for r in parts] == list(range(len(parts)))
        whole = "".join(r.rendered for r in parts)
        for r in parts:
            assert whole[r.char_start:r.char_start + len(r.rendered)] == r.rendered
            assert (r.mask_start is not None) == (r.speaker == who)
            if r.mask_start is not None:
                assert whole[r.mask_start:r.mask_end].endswith("<|im_end|>") and whole[:r.mask_start].endswith("assistant\n")
    assert [r.rendered for r in talks[1, "bob"]][1] == "<|im_start|>user name=ann\nhi<|im_end|>\n"
    assert "<\\|im_end|>" in talks[1, "bob"][0].rendered
    assert chat_rotation.rotate(turns.limit(0)).count() == 0


def test_licenses(spark):
    gpl = "x y z\nThis work is licensed under the GNU General Public License, version 3.\n" + LONG
    files = [(1, "a/LICENSE", "MIT\n\nReleased under the MIT License."), (2, "a/b/c.py", "code"), (3, "a/b/d.py", gpl), (4, "e.py", None), (5, None, "code"),
             (6, "a/b/f/COPYING", "Licensed under the Apache License, Version 2.0."), (7, "a/b/f/g/h.py", ""), (7, "a/b/f/g/h.py", "")]
    df = spark.createDataFrame([(*f, "q") for f in files], "id long, path string, text string, own string")
    got = {r.id: r for r in licenses.scan(df).collect()}
    assert [got[i].license for i in range(1, 8)] == ["MIT", "MIT", "GPL-3.0", None, None, "Apache-2.0", "Apache-2.0"]
    assert (got[2].from_directory, got[2].distance, got[7].distance) == ("/a", 1, 1) and not got[3].grants
    assert licenses.scan(df).count() == len(files) and licenses.scan(df.limit(0)).count() == 0


def test_licenses_told_from_their_siblings(spark):
    gnu = ("This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU {0}General Public License\nas published by the "
           "Free Software Foundation; either version {1}\nof the License, or (at your option) any later version.\n\nint main() {{ return {1}; }}\n" + PROSE)
    clauses = [licenses._BSD, licenses._BSD_TWO, licenses._BSD_THREE, licenses._BSD_END]
    T = licenses.texts
    want = [("GPL-2.0", gnu.format("", "2")), ("GPL-3.0", gnu.format("", "3")), ("LGPL-2.1", gnu.format("Lesser ", "2.1")), ("LGPL-3.0", gnu.format("Lesser ", "3")),
            ("LGPL-2.0", gnu.format("Library ", "2")), ("AGPL-3.0", gnu.format("Affero ", "3")), (None, gnu.format("", "9")),
            ("BSD-2-Clause", "\n\n".join(clauses[:2] + clauses[3:])), ("BSD-3-Clause", "\n\n".join(clauses)), (None, licenses._BSD),
            ("BSD-2-Clause", " ".join(clauses[:2] + clauses[3:])), ("MIT", "Copyright 2020 A\n\n" + licenses._MIT), (None, "the GNU General Public License"),
            ("GPL-2.0", T.GPL_2_0), ("GPL-3.0", T.GPL_3_0), ("LGPL-2.1", T.LGPL_2_1), ("LGPL-3.0", T.LGPL_3_0), ("Apache-2.0", T.APACHE_2_0), ("MPL-2.0", T.MPL_2_0),
            ("CC0-1.0", T.CC0_1_0), ("AGPL-3.0", T.GPL_3_0.replace("GNU GENERAL PUBLIC", "GNU AFFERO GENERAL PUBLIC").replace("GNU General", "GNU Affero General"))]
    files = [(i, f"d{i}/LICENSE", text) for i, (_, text) in enumerate(want)] + [(100 + i, f"d{i}/x.c", "code") for i in range(len(want))]
    got = {r.id: r.license for r in licenses.scan(spark.createDataFrame(files, "id long, path string, text string")).collect()}
    assert [(got[i], got[100 + i]) for i in range(len(want))] == [(name, name) for name, _ in want]


PAGE = ('<html><head><title>T</title><style>p{}</style></head><body><nav><a href="/">Home</a></nav><div class="site-header">Brand</div>'
        '<div id="main"><h1>Title {i}</h1><p>Body &amp; text {i}<p>Second\n  line <b>bold<br>{i}</b></p><p class="ad-slot">Buy</p>'
        '<div class="comments"><p>I agree</p></div></div><aside>More</aside><div class="x">Same everywhere</div>'
        '<script>var t="</div><p>no</p>"</script><footer>&copy; now</footer></body></html>')


def test_html(spark):
    odd = [(i, "http://h.example/%d" % i, PAGE.replace("{i}", str(i)), "q") for i in range(12)]
    odd += [(20, None, None, "q"), (21, "not a url", "", "q"), (22, "http://one.example", "plain <words & more", "q"), (0, "http://h.example/0", odd[0][2], "q"),
            (23, "http://one.example", "<article><p>A</p><form>no</form><p>B</article> after", "q"), (24, "http://big.example", "<p>" + LONG + "</p>" * 3, "q")]
    pages = spark.createDataFrame(odd, "page_id long, url string, html string, host string")
    got = html_extract.extract(pages).collect()
    texts = {r.page_id: r.text for r in got}
    assert len(got) == len(odd)
    assert texts[3] == "Title 3\n\nBody & text 3\n\nSecond line bold 3"
    assert texts[20] == texts[21] == "" and texts[23] == "A\n\nB"
    assert texts[22] == "plain" and texts[24] == " ".join(LONG.split())
    assert html_extract.extract(pages.limit(0)).count() == 0


def test_html_slot_from_the_gaps_of_the_template(spark):
    """No article, main or known name anywhere: the template's classes tell where the article is."""
    page = ('<html><body><div class="zt"><p>Our site has all the stories</p></div><div class="zh"><h1>Tale {i}</h1></div><div class="zb"><div><p>{text}</p></div>'
            '<div><p>Told again</p></div></div><div class="zs"><p>{i} views</p><p>Written in house</p></div></body></html>')
    told = {i: " ".join(f"w{i}x{j}" for j in range(80)) for i in range(5)}
    df = spark.createDataFrame([(i, "http://gap.example/%d" % i, page.replace("{i}", str(i)).replace("{text}", told[i])) for i in told],
                               "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.extract(df).collect()}
    assert got == {i: f"Tale {i}\n\n{told[i]}\n\nTold again" for i in told}
    valid = {(r.path, r.text): r for r in html_extract.templates(df).collect()}
    assert valid[">html>body>div.zb", False].n_tokens > 5 and valid[">html>body>div.zb", False].vector != valid[">html>body>div.zb>div", False].vector


def test_html_keeps_repeated_text_of_articles(spark):
    """Edited copies and repeated headings lose nothing at any number of pages; what frames a flat body goes at two pages."""
    said = [" ".join(f"s{i}x{j}" for j in range(60)) for i in range(8)]
    rows, want = [], {}
    for n in (2, 3, 7, 8, 9):
        for i in range(n):
            for kind, page in (("copy", "<article>{}</article>"), ("body", "<body>{}</body>")):
                texts = [*said, f"edited {i}"]
                rows.append((f"http://{kind}{n}.example/{i}", page.format("".join(f"<p>{t}</p>" for t in texts)), "\n\n".join(texts)))
            texts = ["Summary", " ".join(f"p{i}x{j}" for j in range(60)), "Notes", " ".join(f"q{i}x{j}" for j in range(60)), "The end"]
            page = "".join(f"<p>{t}</p>" for t in texts)
            rows.append((f"http://head{n}.example/{i}", f"<article>{page}</article>", "\n\n".join(texts)))
            rows.append((f"http://flat{n}.example/{i}", f"<body>{page}</body>", "\n\n".join(texts[1:4])))
    two = ["<p>" + "</p><p>".join([*said[:4], f"edited {i}"]) + "</p>" for i in range(2)]
    rows += [(f"http://mixed.example/{i}", f"<body>{t}</body>", t[3:-4].replace("</p><p>", "\n\n"))
             for i, t in enumerate([*two, "<p>" + said[5] + "</p>", "<p>" + said[6] + "</p>"])]
    df = spark.createDataFrame([(i, r[0], r[1]) for i, r in enumerate(rows)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.extract(df).collect()}
    assert [(r[0], got[i]) for i, r in enumerate(rows)] == [(r[0], r[2]) for r in rows]


def test_html_is_not_moved_and_every_size_has_one_plan(spark):
    """The pages join their templates by parsed, packed blocks, and by a merge however few they are, so disk grows with the pages."""
    def nodes(plan):
        yield plan
        for i in range(plan.children().size()):
            yield from nodes(plan.children().apply(i))

    page = "<html><head><style>p{margin:0}</style><script>" + "var a = 1;" * 500 + "</script></head><body><p>Menu</p><article><h1>T{i}</h1><p>&lt;Text&gt;  é𝄞 {i}</article></body></html>"
    df = spark.createDataFrame([(i, f"http://moved.example/{i}", page.replace("{i}", str(i))) for i in range(4)], "page_id long, url string, html string")
    told = html_extract.extract(df)
    joins = [n for n in nodes(told._jdf.queryExecution().optimizedPlan()) if n.nodeName() == "Join"]
    assert len(joins) == 1 and "merge" in joins[0].hint().toString()
    moved = joins[0].output().mkString(",")
    assert "packed" in moved and "html" not in moved
    assert {r.page_id: r.text for r in told.collect()} == {i: f"T{i}\n\n<Text> é𝄞 {i}" for i in range(4)}
    found, _ = html_extract.occurrences(df.union(df))
    assert found.count() == 4 and all(len({t.token for t in r.tokens}) == len(r.tokens) for r in found.collect())
    assert len(html_extract._packed(page)[0]) < len(page) / 20


def test_blocks_by_meaning():
    def main(page):
        return [t for _, t, skipped, _ in html_extract.blocks(page)[0] if not skipped]

    assert main('<div class="post-content share-enabled"><p>A</p></div><div class="site-header">no</div>') == ["A"]
    assert main('<article class="post"><p>A<aside>no</aside><p>B</article><article class="comment"><p>no</article>') == ["A", "B"]
    assert main('<main><header><h1>T</h1></header><ul class="share-list"><li>no</li></ul><p>x &lt; y<br>z</main><p class="cookie-notice">no</p>') == ["T", "x < y z"]
    assert main('<section id="comments"><div><p>no</p></div></section><p>A<script>"</p>"</script>B<!-- <p>no --> C') == ["A B C"]
    assert main('<form><p>no</form><div hidden>no</div><p style="display: none">no</p><p>&eacute;&#233;&#xe9; &amp;amp;') == ["ééé &amp;"]


def test_partial_names_give_way_to_the_article():
    def main(page):
        return [t for _, t, skipped, _ in html_extract.blocks(page)[0] if not skipped]

    for name in ("container has-sidebar", "content-sidebar-wrap", "sticky-header", "with-footer"):
        for tag in ("article", "main"):
            page = f'<div class="{name}"><div class="site-menu"><p>no</p></div><{tag}><h1>T</h1><p>Some text</p></{tag}><div class="related-posts"><article>t</article></div></div>'
            assert main(page) == ["T", "Some text"]
            assert html_extract.blocks(page)[1][f">div.{name.replace(' ', '-')}>{tag}"] == (1, True)
    assert main('<div class="with-footer"><p>Most of the text of the page</p></div><div class="page-footer">no</div>') == ["Most of the text of the page"]
    article = '<h1 class="header">A</h1><h2 class="section-header">B</h2><p class="social-history">C</p><li class="more-info">D</li><p class="ad-slot">no</p><p class="share">no</p><h3 class="ads">no</h3>'
    assert main(f"<article>{article}</article>") == ["A", "B", "C", "D"]
    assert main('<div class="sidebar"><article>no</article></div><div class="sidebar-box"><p>no</p></div><article>Text</article>') == ["Text"]


def test_malformed_tags_keep_the_rest_of_the_page():
    def main(page):
        return [t for _, t, skipped, _ in html_extract.blocks(page)[0] if not skipped]

    for tag in ("svg", "button", "object", "canvas", "video", "audio", "select", "noscript", "template"):
        assert main(f'<p>A<{tag} class="i"/> B</p><p>C</p>') == ["A B", "C"], tag
        assert main(f'<p>A</p><p>B<{tag} class="i">no<p>C</p><div>D</div>') == ["A", "B", "C", "D"], tag
        assert main(f'<p>A</p><{tag}/><p>B</p><div><{tag}><div>no</div><p>no</p></{tag}></div><p>C</p>') == ["A", "B", "C"], tag
        assert main(f'<div><{tag}>no</div><p>A</p><div><{tag}>no</{tag}>B</div></{tag}>C') == ["A", "B", "C"], tag
    assert main('<p>A<button>no<p>B</p><button>no</button><p>C') == ["A", "B", "C"]
    assert main('<p>So <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds</p>') == ["So x=1 holds"]
    assert main("<p title=it's>A</p><p>it's B</p><p title='a > b' lang=\"x>y\">C</p><p 'q>D</p>") == ["A", "it's B", "C", "D"]
    assert main('<p>A<svg><title>no</title><svg><text>no</text></svg></svg>B<script>"<p>no"</script></p>') == ["AB"]


def test_pipeline_stages(spark, docs, labels, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = base.written(stage(spark, now, str(tmp_path)), f"test-{name}")
        assert now.columns == docs.columns
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.agg({"length": "sum"}).first()[0] == packing.pack(now, public_tokenizers.path(TOKENIZER)).agg({"length": "sum"}).first()[0]


CODE = "\n".join(f"def f{i}(x):\n    return x + {i}  # add" for i in range(50))


@pytest.mark.parametrize("style", ["c", "slashes", "hash", "bare block"])
def test_notices_in_comments_above_code(spark, style):
    def comment(notice):
        words = notice.split()
        lines = [" ".join(words[i:i + 9]) for i in range(0, len(words), 9)]
        if style == "c":
            return "\n".join(["/*", *[f" * {x}" for x in lines], " */"])
        if style == "bare block":
            return "\n".join(["/* " + lines[0], *lines[1:], "*/"])
        return "\n".join(f"{'//' if style == 'slashes' else '#'} {x}" for x in lines)

    files, want = [], {}
    for name, notices in licenses.TEMPLATES.items():
        for k, notice in enumerate(n for n in notices if len(n) < 2500):
            for n_lines in (0, 7, 100):
                for owner in ("", "Copyright (c) 2019-2021 The Example Authors. All rights reserved.\n"):
                    head = comment(notice)
                    if owner and style in ("c", "bare block"):
                        head = head.replace("/*", "/* " + owner.strip() + "\n *", 1)
                    elif owner:
                        head = head.split(" ", 1)[0] + " " + owner + head
                    want[len(files)] = (name, k)
                    files.append((len(files), "a/b.py", head + "\n" + "\n".join(CODE.split("\n")[:n_lines])))
    plain = [(10_000 + i, "c/d.py", CODE[i * 40:] + "\n# a comment on the general case, version 2\n/* free software */") for i in range(20)]
    got = {r.id: r.own for r in licenses.own_licenses(spark.createDataFrame(files + plain, "id long, path string, text string"), licenses.TEMPLATES, licenses.LEAST_COSINE).collect()}
    wrong = {(want[i], got[i]) for i in want if got[i] != want[i][0]}
    # one notice serves the BSD licences, whose clauses tell them apart
    assert {w for w in wrong if not w[0][0].startswith("BSD")} == set()
    assert all(got[i] is None for i, _, _ in plain)


def test_comment_blocks():
    text = "#!/bin/sh\n# one\n#\n# two\ncode # no\n  /** three\n   * four */ int x;\n// five\n/* six */\n<!-- seven\neight --> rest\nnot -- this\n'''\nnine"
    assert licenses.comment_blocks(text) == [["one", "", "two"], ["three", "four"], ["five"], ["six"], ["seven", "eight"], ["", "nine"]]
    assert licenses.comment_blocks("plain words\nno marks") == []


def test_each_layout_of_a_host_has_its_own_template(spark):
    def story(i):
        return [" ".join(f"word{i}x{j}y{k}" for k in range(25)) for j in range(4)]

    def red(i):
        return ("<html><body><div class='r1'><span>Red portal of news</span></div><div class='r2'><p>" + "</p><p>".join(story(i)) +
                "</p></div><div class='r3'><em>Red imprint and terms</em></div></body></html>")

    def blue(i):
        return ("<html><body><table><tr><td class='b1'><b>Blue weather</b><i>Blue letters to us</i></td><td class='b2'><section class='b3'><p>" + "</p><p>".join(story(i)) +
                "</p></section></td></tr></table><div class='b4'><u>Blue address line</u></div></body></html>")

    pages = [(i, f"http://two.example/{i}", red(i)) for i in range(6)] + [(10 + i, f"http://two.example/b{i}", blue(10 + i)) for i in range(4)]
    pages += [(50, "http://two.example/again", red(0)), (51, None, None)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert len(got) == 12 and got[51] == "" and got[50] == got[0]
    assert all(got[i] == "\n\n".join(story(i)) for i in [*range(6), *range(10, 14)])
