"""Registered queries of the training-data operators: opN_<name>(spark, sf_dir) over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_rotation, fingerprints, html_extract, jaccard_join, language_id, licenses, line_dedup, merkle, mixing, packing, quality_rules, toxicity, vector_codes
from .base import read

TOKENIZER = "word_bpe_49k.json"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and learned verdict of every document (a learned list has no SQL; tests hold it to brute force)."""
    rated = quality_rules.rate_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return rated.select("doc_id", *quality_rules.BASE_STATS, "base_failed", "rule", "kept")


@query
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without later copies of line runs of 50 words or more."""
    return line_dedup.drop_repeated_lines(read(spark, sf_dir, "documents"), report=True).drop("runs")


# windows of at least 50 words that are minimal from one side, named by their text
ORACLE["op7_line_dedup"] = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, i, ls[i] AS line FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM d)),
w AS (SELECT doc_id, i, line,
             len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS nw FROM l),
c AS (SELECT doc_id, i, c1, c1 - nw AS c0 FROM
      (SELECT doc_id, i, nw, sum(nw) OVER (PARTITION BY doc_id ORDER BY i) AS c1 FROM w)),
s AS (SELECT doc_id, c0, max(i) AS a FROM c GROUP BY doc_id, c0),
e AS (SELECT doc_id, c1, min(i) AS b FROM c GROUP BY doc_id, c1),
win AS (
  SELECT c.doc_id, s.a, c.i AS b FROM c ASOF JOIN s ON c.doc_id = s.doc_id AND c.c1 - 50 >= s.c0
  UNION
  SELECT c.doc_id, c.i, e.b FROM c ASOF JOIN e ON c.doc_id = e.doc_id AND c.c0 + 50 <= e.c1),
named AS (SELECT win.doc_id, a, b, row_number() OVER
            (PARTITION BY array_to_string(ls[a:b], chr(10)) ORDER BY win.doc_id, a) AS copy
          FROM win JOIN d USING (doc_id)),
gone AS (SELECT DISTINCT doc_id, unnest(range(a, b + 1)) AS i FROM named WHERE copy > 1),
kept AS (SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.i) AS text FROM l ANTI JOIN gone USING (doc_id, i) GROUP BY l.doc_id),
cnt AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(ls), 0)::BIGINT AS n_lines, coalesce(cnt.n, 0)::BIGINT AS n_removed,
       CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN cnt USING (doc_id)
"""


@query
def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class, links and copies of every document at five words and a similarity of 0.8."""
    near = jaccard_join.near_duplicates(read(spark, sf_dir, "documents"))
    return near.select("doc_id", "class_id", "n_links", "n_copies", "class_size")


ORACLE["op5_jaccard_join"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS s
       FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
named AS (SELECT w.doc_id, w.text, k.n, coalesce(k.name, '') AS name FROM w LEFT JOIN
          (SELECT doc_id, count(*) AS n, md5(string_agg(s, chr(10) ORDER BY s)) AS name FROM sh GROUP BY doc_id) k USING (doc_id)),
entry AS (SELECT name, min(doc_id) AS rep, max(n) AS n, count(*) AS n_copies, greatest(count(DISTINCT text) FILTER (n IS NOT NULL), 1) AS n_texts FROM named GROUP BY name),
es AS (SELECT e.rep, e.n, sh.s FROM entry e JOIN sh ON sh.doc_id = e.rep),
pair AS (SELECT a.rep AS a, b.rep AS b FROM es a JOIN es b ON a.s = b.s AND a.rep < b.rep
         GROUP BY a.rep, b.rep, a.n, b.n HAVING count(*) >= 0.8 * (a.n + b.n - count(*))),
link AS (SELECT a, b FROM pair UNION ALL SELECT b, a FROM pair),
reach(a, b) AS (SELECT rep, rep FROM entry UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
cls AS (SELECT a AS rep, min(b) AS class_id FROM reach GROUP BY a),
size AS (SELECT class_id, sum(n_copies)::BIGINT AS class_size FROM cls JOIN entry USING (rep) GROUP BY class_id),
deg AS (SELECT a AS rep, sum(n_texts) AS n_links FROM link JOIN entry ON entry.rep = link.b GROUP BY a)
SELECT named.doc_id, cls.class_id, (coalesce(deg.n_links, 0) + entry.n_texts - 1)::BIGINT AS n_links, entry.n_copies, size.class_size
FROM named JOIN entry USING (name) JOIN cls USING (rep) JOIN size USING (class_id) LEFT JOIN deg USING (rep)
"""


@query
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words the mix takes of every document: 150 % of all words, sources weighted 3, 1, 2, at most two epochs."""
    plan = mixing.plan_mix(read(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken")


ORACLE["op9_mixing"] = r"""
WITH RECURSIVE z AS (SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'),
                            lambda x: x <> ''))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
             CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight
      FROM z GROUP BY source),
fill(k, level) AS (
  SELECT 0, 1.5::DOUBLE * sum(source_size) / sum(weight) FROM s
  UNION ALL
  SELECT k + 1, (SELECT (1.5::DOUBLE * sum(source_size) - coalesce(sum(2.0::DOUBLE * source_size) FILTER (level * weight >= 2.0::DOUBLE * source_size), 0))
                        / sum(weight) FILTER (level * weight < 2.0::DOUBLE * source_size) FROM s)
  FROM fill WHERE k < (SELECT count(*) FROM s)),
top AS (SELECT max(level) AS level FROM fill),
t AS (SELECT source, source_size, least(2.0::DOUBLE * source_size, level * weight) AS target FROM s, top),
o AS (SELECT doc_id, size, source_size, target, floor(target / source_size)::BIGINT AS whole,
             coalesce(sum(size) OVER (PARTITION BY source ORDER BY md5('mix:' || doc_id), doc_id
                                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
      FROM z JOIN t USING (source))
SELECT doc_id, size, source_size, target,
       (whole * size + least(size, greatest(0, round(target - whole * source_size)::BIGINT - before)))::BIGINT AS taken
FROM o
"""


@query
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document in sequences of 2048 tokens along the Hilbert curve (a tokenizer has no SQL)."""
    return packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by a model of the labels that aren't held out (a fitted model has no SQL)."""
    docs = read(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketch of every document and of its edited text, with likenesses (the hashes have no SQL)."""
    return fingerprints.compare_edits(read(spark, sf_dir, "documents"))


@query
def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page (parsing html has no SQL)."""
    return html_extract.extract(read(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


@query
def op3_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation from the view of each of its speakers."""
    return chat_rotation.rotate(read(spark, sf_dir, "conversations"))


ORACLE["op3_chat_rotation"] = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker,
                  replace(replace(coalesce(text, ''), '<|im_start|>', '<\|im_start|>'), '<|im_end|>', '<\|im_end|>') AS text FROM conversations),
p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> 'system'),
r AS (SELECT t.conv_id, perspective, turn, speaker, text,
             '<|im_start|>' || CASE WHEN speaker = perspective THEN 'assistant' WHEN speaker = 'system' THEN 'system'
                                    ELSE 'user name=' || speaker END || chr(10) AS head
      FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
s AS (SELECT *, head || text || '<|im_end|>' || chr(10) AS rendered FROM r),
o AS (SELECT *, row_number() OVER w - 1 AS position, coalesce(sum(length(rendered)) OVER
             (PARTITION BY conv_id, perspective ORDER BY turn, speaker, md5(text) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS char_start
      FROM s WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn, speaker, md5(text)))
SELECT conv_id, perspective, position, turn, speaker, rendered, char_start,
       CASE WHEN speaker = perspective THEN char_start + length(head) END AS mask_start,
       CASE WHEN speaker = perspective THEN char_start + length(rendered) - 1 END AS mask_end
FROM o
"""


@query
def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License of every document as a file source/lang/doc_id (tests hold the cosine to brute force)."""
    files = read(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.concat_ws("/", "source", "lang", F.floor(F.col("doc_id") / 100).cast("string"), F.col("doc_id").cast("string")).alias("path"), "text")
    return licenses.scan(files).withColumnRenamed("id", "doc_id")


@query
def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product code and error of every sound vector: four parts, 256 entries each, four rounds."""
    codes, codebooks = vector_codes.compress(read(spark, sf_dir, "embeddings"))
    return vector_codes.with_label_error(codes).select("vec_id", "code", "error", "label_error",
                                                       F.lit(vector_codes.codebooks_digest(codebooks)).alias("codebooks_sha256"))


def _vector_codes_sql(rounds: int = vector_codes.ROUNDS) -> str:
    """The rounds written out: pairs of distinct parts and entries, the least distance, then floors of means."""
    sql = r"""
WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
part AS (SELECT vec_id, p, v[p * 16 + 1:p * 16 + 16] AS x FROM k, (SELECT unnest(range(4)) AS p)),
w AS MATERIALIZED (SELECT p, x, count(*) AS n FROM part GROUP BY p, x),
c0 AS MATERIALIZED (SELECT p, (row_number() OVER (PARTITION BY p ORDER BY vec_id, x)) - 1 AS e, x AS c FROM part
       WHERE vec_id IN (SELECT vec_id FROM k ORDER BY vec_id LIMIT 256))"""
    for r in range(rounds + 1):
        sql += rf""",
n{r} AS MATERIALIZED (SELECT p, x, any_value(n) AS n, min({{'d': d, 'e': e}}) AS best FROM
       (SELECT w.p, w.x, w.n, e, list_sum(list_transform(list_zip(w.x, c.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
        FROM w JOIN c{r} c ON c.p = w.p) GROUP BY p, x)"""
        if r < rounds:
            sql += rf""",
m{r} AS (SELECT p, e, list(floor_mean ORDER BY i) AS c FROM
         (SELECT p, best.e AS e, i, (sum(x[i] * n) - ((sum(x[i] * n) % sum(n)) + sum(n)) % sum(n)) // sum(n) AS floor_mean
          FROM n{r}, (SELECT unnest(range(1, 17)) AS i) GROUP BY p, best.e, i) GROUP BY p, e),
c{r + 1} AS MATERIALIZED (SELECT c.p, c.e, coalesce(m.c::BIGINT[], c.c) AS c FROM c{r} c LEFT JOIN m{r} m ON m.p = c.p AND m.e = c.e)"""
    return sql + rf""",
code AS (SELECT part.vec_id, string_agg(printf('%02x', best.e), '' ORDER BY part.p) AS code, sum(best.d)::BIGINT AS error
         FROM part JOIN n{rounds} b ON b.p = part.p AND b.x = part.x GROUP BY part.vec_id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM c{rounds}) AS codebooks_sha256
FROM k JOIN code USING (vec_id)
"""


ORACLE["op11_vector_codes"] = _vector_codes_sql()


@query
def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by filters of the documents that aren't held out (hashed filters have no SQL)."""
    docs = read(spark, sf_dir, "documents")
    filters = language_id.learn(docs.where(~language_id.held_out(F.col("doc_id"))))
    return language_id.predict(docs, filters).select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root and proof of every document, and the root that its (tampered) text folds to."""
    return merkle.manifest(read(spark, sf_dir, "documents"))


def _merkle_sql(levels: int = 8, top_levels: int = 3) -> str:
    """Levels written out, for up to 8**levels rows a language and 8**top_levels languages; a node without others in its tree stays."""
    def leaf(text: str) -> str:
        parts = [f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)]
        return f"sha256({' || '.join(parts)})"

    crc = ("xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), "
           "lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))))")
    low = f"translate(text, '{merkle.UPPER}', '{merkle.LOWER}')"
    sql = f"""
WITH raw AS (SELECT doc_id, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, {leaf("text")} AS leaf,
                    CASE WHEN {crc} % 3 = 0 THEN {leaf(low)} ELSE {leaf("text")} END AS given FROM documents),
d AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM raw),
t0 AS (SELECT g, i, n, leaf AS h FROM d)"""

    def climb(t: str, s: str, k: int) -> str:
        return f""",
{s}{k} AS MATERIALIZED (SELECT a.g, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l,
       coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r
       FROM {t}{k} a JOIN {t}{k} b ON a.g = b.g AND a.i // 8 = b.i // 8 WHERE a.n > 1 GROUP BY a.g, a.i),
{t}{k + 1} AS MATERIALIZED (SELECT g, i // 8 AS i, (n + 7) // 8 AS n, CASE WHEN n = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h
       FROM {t}{k} GROUP BY g, i // 8, n)"""

    for k in range(levels):
        sql += climb("t", "s", k)
    sql += f""",
u0 AS (SELECT 0 AS g, g AS i, count(*) OVER () AS n, h FROM t{levels})"""
    for k in range(top_levels):
        sql += climb("u", "v", k)
    sql += """,
p0 AS (SELECT doc_id, leaf, g, i, '' AS proof, given AS folded FROM d)"""
    steps = [("s", k, "p.g", f"p.i // {8 ** k}") for k in range(levels)] + [("v", k, "0", f"p.g // {8 ** k}") for k in range(top_levels)]
    for j, (s, k, g, i) in enumerate(steps):
        sql += f""",
p{j + 1} AS (SELECT doc_id, leaf, p.g, p.i, CASE WHEN s.l IS NULL THEN proof ELSE proof || s.l || s.r END AS proof,
       CASE WHEN s.l IS NULL THEN folded ELSE sha256(s.l || folded || s.r) END AS folded
       FROM p{j} p LEFT JOIN {s}{k} s ON s.g = {g} AND s.i = {i})"""
    return sql + f"""
SELECT doc_id, leaf, t.h AS subroot, u.h AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = u.h AS verified
FROM p{len(steps)} p JOIN t{levels} t ON t.g = p.g, u{top_levels} u
"""


ORACLE["op13_merkle_manifest"] = _merkle_sql()
