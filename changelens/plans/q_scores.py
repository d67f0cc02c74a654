"""Registered queries: cosine scores, embeddings, BLEU, classes, hit rates."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import cls_pool, cosine, mean_pool, norm
from ..operators import classify as K
from ..operators import models as MD
from ..operators import similarity as SIM
from ..operators import vector_store as VS
from ..operators.changes import baseline_cross
from ..session import scratch_path
from . import sqlfrag as S
from . import views as V
from .registry import register


# The published 13a rules, written out for the oracle on its own.
TOK13A_PRE = [("<skipped>", ""), ("-\n", ""), ("\n", " "), ("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")]
TOK13A_RULES = [(r"([{-~\[-` -&(-+:-@/])", r" \1 "), (r"([^0-9])([\.,])", r"\1 \2 "), (r"([\.,])([^0-9])", r" \1 \2"), (r"([0-9])(-)", r"\1 \2 ")]


def sql_cos(a: str, b: str) -> str:
    return (f"coalesce(list_dot_product({a}::DOUBLE[], {b}::DOUBLE[]) / nullif(sqrt(list_dot_product({a}::DOUBLE[], {a}::DOUBLE[]))"
            f" * sqrt(list_dot_product({b}::DOUBLE[], {b}::DOUBLE[])), 0), 0.0)")


def sql_embed(x: str, dim: int = 64) -> str:
    buckets = f"list_transform({S.tokens(x)}, lambda tk: CAST(('0x' || substr(md5(tk), 1, 8)) AS BIGINT) % {dim})"
    return f"list_transform(range({dim}), lambda j: len(list_filter({buckets}, lambda b: b = j))::DOUBLE)"


@register("cosine", views=("v_score",), sql=f"SELECT grp, round({sql_cos('dev_vec', 'diff_vec')}, 6) AS cosine FROM v_score")
def cosine_q(t):
    """M3."""
    return V.v_score(t).select("grp", F.round(cosine("dev_vec", "diff_vec"), 6).alias("cosine"))


@register("message_scores", views=("v_score",), sql=f"""
SELECT grp, round({sql_cos('dev_vec', 'diff_vec')}, 6) AS dev_score, round({sql_cos('model_vec', 'diff_vec')}, 6) AS model_score,
       round({sql_cos('rect_vec', 'diff_vec')}, 6) AS rect_score FROM v_score""")
def message_scores_q(t):
    """M4 over stored vectors: developer, model and rewritten message vs the diff."""
    return SIM.cosine_scores(V.v_score(t), {"dev_score": ("dev_vec", "diff_vec"), "model_score": ("model_vec", "diff_vec"),
                                            "rect_score": ("rect_vec", "diff_vec")}, round_to=6).select(
        "grp", "dev_score", "model_score", "rect_score")


@register("message_scores_text", views=("v_change",), sql=f"""
SELECT hash, seq, round({sql_cos(sql_embed('before'), sql_embed('after'))}, 6) AS dev_score,
       round({sql_cos(sql_embed('role'), sql_embed('after'))}, 6) AS model_score FROM v_change""")
def message_scores_text_q(t):
    """M4 over texts: each distinct text embedded once, joined back by hash."""
    r = SIM.message_scores(V.v_change(t), ["hash", "seq"], "after", {"dev": "before", "model": "role"},
                           MD.embed_text)
    return r.select("hash", "seq", F.round("dev_score", 6).alias("dev_score"),
                    F.round("model_score", 6).alias("model_score"))


@register("scores_from_store", views=("v_change",), sql=f"""
SELECT hash, seq, round({sql_cos(sql_embed('before'), sql_embed('after'))}, 6) AS dev_score,
       round({sql_cos(sql_embed('role'), sql_embed('after'))}, 6) AS model_score FROM v_change""")
def scores_from_store_q(t):
    """M4 from a vector store: a first run embedded the early changes, the second only the texts it lacked; the scores read the store."""
    changes = V.v_change(t)
    cols, path = ["before", "after", "role"], scratch_path(t.spark, "vector-store")
    VS.extend_store(changes.where("seq < 3"), cols, path, MD.embed_text, 16)
    VS.extend_store(changes, cols, path, MD.embed_text, 16)
    r = VS.scores_from_store(changes, ["hash", "seq"], {"dev_score": ("before", "after"), "model_score": ("role", "after")}, path)
    return r.select("hash", "seq", F.round("dev_score", 6).alias("dev_score"), F.round("model_score", 6).alias("model_score"))


@register("sparse_bag", sql=f"""
SELECT doc_id, len(list_filter(v, lambda x: x > 0)) AS n_buckets, list_sum(v)::BIGINT AS n_tokens,
       list_sum(list_transform(v, lambda x, i: x * (i - 1)))::BIGINT AS by_bucket
FROM (SELECT doc_id, {sql_embed('text')} AS v FROM documents) s""")
def sparse_bag_q(t):
    """M2 as sparse vectors, made in one pass over the tokens."""
    b = t.documents.select("doc_id", VS.sparse_bag("text").alias("b"))

    def total(f):
        return F.aggregate("b", F.lit(0).cast("bigint"), lambda s, x: s + f(x))

    return b.select("doc_id", F.size("b").alias("n_buckets"), total(lambda x: x["n"]).alias("n_tokens"), total(lambda x: x["n"] * x["bucket"]).alias("by_bucket"))


@register("embed_text", sql=f"""
SELECT doc_id, round(sqrt(list_dot_product(v, v)), 6) AS norm, len(list_filter(v, lambda x: x > 0)) AS n_buckets
FROM (SELECT doc_id, {sql_embed('text')} AS v FROM documents) s""")
def embed_text_q(t):
    """M2 with the hashed stand-in embedder."""
    e = MD.embed_text(t.documents, "text", "v")
    return e.select("doc_id", F.round(norm("v"), 6).alias("norm"),
                    F.size(F.filter("v", lambda x: x > 0)).alias("n_buckets"))


@register("mean_pool", views=("v_score",), sql="""
SELECT grp, round(sqrt(list_dot_product(p, p)), 6) AS pooled_norm, round(p[1], 6) AS pooled_first FROM (
  SELECT grp, list_transform(range(1, 65), lambda i: (diff_vec[i]::DOUBLE + dev_vec[i]::DOUBLE + model_vec[i]::DOUBLE
         + rect_vec[i]::DOUBLE) / 4) AS p FROM v_score) s""")
def mean_pool_q(t):
    """M2 pooling: element-wise mean of the four vectors of each group."""
    p = V.v_score(t).select("grp", mean_pool(F.array("diff_vec", "dev_vec", "model_vec", "rect_vec")).alias("p"))
    return p.select("grp", F.round(norm("p"), 6).alias("pooled_norm"), F.round(F.get("p", 0), 6).alias("pooled_first"))


@register("cls_pool", views=("v_score",), sql="SELECT grp, round(dev_vec[1]::DOUBLE, 6) AS first, len(dev_vec) AS width FROM v_score")
def cls_pool_q(t):
    """M2 pooling: the first vector of each group's sequence."""
    p = V.v_score(t).select("grp", cls_pool(F.array("dev_vec", "model_vec", "rect_vec")).alias("p"))
    return p.select("grp", F.round(F.get("p", 0).cast("double"), 6).alias("first"), F.size("p").alias("width"))


@register("change_similarity", views=("v_change",), sql=f"""
SELECT hash, seq, round({sql_cos(sql_embed('before'), sql_embed('after'))}, 6) AS semantic_similarity FROM v_change""")
def change_similarity_q(t):
    """M5."""
    r = SIM.change_similarity(V.v_change(t), "before", "after", MD.embed_text)
    return r.select("hash", "seq", F.round("semantic_similarity", 6).alias("semantic_similarity"))


# Fixed value: the reference's nonsense baseline message.
NONSENSE = "asiub buhefijx, iauhfhv."


def _baseline(t):
    c = baseline_cross(V.v_change(t), {"fake": F.lit(NONSENSE)})
    e = MD.embed_text(MD.embed_text(MD.embed_text(c, "after", "v_diff"), "before", "v_real"), "fake", "v_fake")
    return e.select("hash", "seq", cosine("v_real", "v_diff").alias("real_score"),
                    cosine("v_fake", "v_diff").alias("fake_score"))


@register("baseline_cross", views=("v_change",), sql=f"""
SELECT hash, seq, round({sql_cos(sql_embed('before'), sql_embed('after'))}, 6) AS real_score,
       round({sql_cos(sql_embed("'" + NONSENSE + "'"), sql_embed('after'))}, 6) AS fake_score FROM v_change""")
def baseline_cross_q(t):
    """Every diff scored against the real message and one fixed nonsense message."""
    b = _baseline(t)
    return b.select("hash", "seq", F.round("real_score", 6).alias("real_score"), F.round("fake_score", 6).alias("fake_score"))


@register("real_vs_null_score", views=("v_change",), sql=f"""
SELECT round(avg({sql_cos(sql_embed('before'), sql_embed('after'))}), 6) AS mean_real,
       round(avg({sql_cos(sql_embed("'" + NONSENSE + "'"), sql_embed('after'))}), 6) AS mean_fake FROM v_change""")
def real_vs_null_score_q(t):
    """Mean real vs mean nonsense similarity over all changes."""
    return _baseline(t).agg(F.round(F.avg("real_score"), 6).alias("mean_real"),
                            F.round(F.avg("fake_score"), 6).alias("mean_fake"))


# ---------------------------------------------------------------- BLEU

def sql_tok13a(x: str) -> str:
    e = x
    for a, b in TOK13A_PRE:
        sa = a.replace("'", "''").replace("\n", "' || chr(10) || '")
        sb = b.replace("'", "''").replace("\n", "' || chr(10) || '")
        e = f"replace({e}, '{sa}', '{sb}')"
    e = f"(' ' || {e} || ' ')"
    for pat, rep in TOK13A_RULES:
        e = f"regexp_replace({e}, '{pat}', '{rep}', 'g')"
    return S.tokens(e)


def sql_bleu(pairs: str, key: str) -> str:
    """BLEU over ``pairs`` (columns: key..., cand, ref) as DuckDB SQL."""
    k = key
    return f"""
WITH p AS ({pairs}),
tk AS (SELECT {k}, {sql_tok13a('cand')} AS ct, {sql_tok13a('ref')} AS rt FROM p),
ord AS (SELECT unnest([1, 2, 3, 4]) AS n),
cg AS (SELECT {k}, n, array_to_string(ct[i:i + n - 1], ' ') AS gram, count(*) AS c_cnt FROM (
         SELECT {k}, ct, n, unnest(generate_series(1, len(ct) - n + 1)) AS i FROM tk, ord WHERE len(ct) >= n) a
       GROUP BY ALL),
rg AS (SELECT {k}, n, array_to_string(rt[i:i + n - 1], ' ') AS gram, count(*) AS r_cnt FROM (
         SELECT {k}, rt, n, unnest(generate_series(1, len(rt) - n + 1)) AS i FROM tk, ord WHERE len(rt) >= n) a
       GROUP BY ALL),
m AS (SELECT {k}, sum(CASE WHEN n = 1 THEN least(c_cnt, r_cnt) ELSE 0 END) AS m1,
             sum(CASE WHEN n = 2 THEN least(c_cnt, r_cnt) ELSE 0 END) AS m2,
             sum(CASE WHEN n = 3 THEN least(c_cnt, r_cnt) ELSE 0 END) AS m3,
             sum(CASE WHEN n = 4 THEN least(c_cnt, r_cnt) ELSE 0 END) AS m4
      FROM cg JOIN rg USING ({k}, n, gram) GROUP BY ALL),
j AS (SELECT tk.{k.replace(', ', ', tk.')}, len(ct) AS c, len(rt) AS r, coalesce(m1, 0) AS m1, coalesce(m2, 0) AS m2,
             coalesce(m3, 0) AS m3, coalesce(m4, 0) AS m4 FROM tk LEFT JOIN m USING ({k})),
z AS (SELECT *, (m1 = 0)::INT AS z1, (m1 = 0)::INT + (m2 = 0)::INT AS z2,
             (m1 = 0)::INT + (m2 = 0)::INT + (m3 = 0)::INT AS z3,
             (m1 = 0)::INT + (m2 = 0)::INT + (m3 = 0)::INT + (m4 = 0)::INT AS z4 FROM j)
SELECT {k}, round(CASE WHEN c < 4 OR m1 = 0 THEN 0.0 ELSE
   (CASE WHEN c >= r THEN 1.0 ELSE exp(1 - r / c) END) * exp((
     ln(CASE WHEN m1 = 0 THEN 1.0 / (pow(2, z1) * c) ELSE m1 / c END)
   + ln(CASE WHEN m2 = 0 THEN 1.0 / (pow(2, z2) * (c - 1)) ELSE m2 / (c - 1) END)
   + ln(CASE WHEN m3 = 0 THEN 1.0 / (pow(2, z3) * (c - 2)) ELSE m3 / (c - 2) END)
   + ln(CASE WHEN m4 = 0 THEN 1.0 / (pow(2, z4) * (c - 3)) ELSE m4 / (c - 3) END)) / 4) END, 6) AS bleu
FROM z"""


_CONV_PAIRS = ("SELECT c.conv_id, c.turn, c.text AS cand, p.text AS ref FROM conversations c "
               "JOIN conversations p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1")


@register("bleu", sql=sql_bleu(_CONV_PAIRS, "conv_id, turn"))
def bleu_q(t):
    """M6: BLEU of each turn (candidate) against the previous turn (reference)."""
    c = t.conversations.select("conv_id", "turn", F.col("text").alias("cand"))
    p = t.conversations.select(F.col("conv_id").alias("p_conv"), (F.col("turn") + 1).alias("p_next"),
                               F.col("text").alias("ref"))
    pairs = c.join(p, (c.conv_id == p.p_conv) & (c.turn == p.p_next)).select("conv_id", "turn", "cand", "ref")
    r = SIM.bleu(pairs, ["conv_id", "turn"], "cand", "ref")
    return r.select("conv_id", "turn", F.round("bleu", 6).alias("bleu"))


# ---------------------------------------------------------------- classes and hit rates

SEM_AT, TOK_AT = 0.1, 0.1


@register("threshold_class", views=("v_score",), sql=f"""
SELECT grp, CASE WHEN {sql_cos('dev_vec', 'diff_vec')} >= {SEM_AT} THEN 'Minor' ELSE 'Major' END AS semantic_class,
       CASE WHEN {sql_cos('model_vec', 'diff_vec')} >= {TOK_AT} THEN 'Minor' ELSE 'Major' END AS token_class,
       CASE WHEN ({sql_cos('dev_vec', 'diff_vec')} >= {SEM_AT}) = ({sql_cos('model_vec', 'diff_vec')} >= {TOK_AT})
            THEN 'YES' ELSE 'NO' END AS classes_agree FROM v_score""")
def threshold_class_q(t):
    """P26 + P27 over v_score (thresholds scaled to these vectors)."""
    s = SIM.cosine_scores(V.v_score(t), {"semantic_similarity": ("dev_vec", "diff_vec"),
                                         "token_similarity": ("model_vec", "diff_vec")})
    return K.classify(s, semantic_at=SEM_AT, token_at=TOK_AT).select("grp", "semantic_class", "token_class", "classes_agree")


@register("class_agree", views=("v_change",), sql=f"""
SELECT hash, seq, CASE WHEN (CASE WHEN {sql_cos(sql_embed('before'), sql_embed('after'))} >= 0.8 THEN 'Minor' ELSE 'Major' END)
  = (CASE WHEN length(after) >= 0.75 * length(before) THEN 'Minor' ELSE 'Major' END) THEN 'YES' ELSE 'NO' END AS classes_agree
FROM v_change""")
def class_agree_q(t):
    """P27 with the reference thresholds (0.8 semantic, 0.75 length ratio as the token proxy)."""
    c = SIM.change_similarity(V.v_change(t), "before", "after", MD.embed_text)
    sc = K.threshold_class("semantic_similarity", K.SEMANTIC_MINOR_AT)
    tc = F.when(F.length("after") >= 0.75 * F.length("before"), F.lit("Minor")).otherwise(F.lit("Major"))
    return c.select("hash", "seq", K.class_agree(sc, tc).alias("classes_agree"))


@register("hit_rate", views=("v_score",), sql=f"""
SELECT creator, round(avg(CASE WHEN score >= 0.1 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate, count(score) AS n FROM (
  SELECT 'dev_score' AS creator, {sql_cos('dev_vec', 'diff_vec')} AS score FROM v_score
  UNION ALL SELECT 'model_score', {sql_cos('model_vec', 'diff_vec')} FROM v_score
  UNION ALL SELECT 'rect_score', {sql_cos('rect_vec', 'diff_vec')} FROM v_score) s GROUP BY creator""")
def hit_rate_q(t):
    """Share of precise messages per creator (RQ1-RQ3), threshold 0.1 for these vectors."""
    s = SIM.cosine_scores(V.v_score(t), {"dev_score": ("dev_vec", "diff_vec"), "model_score": ("model_vec", "diff_vec"),
                                         "rect_score": ("rect_vec", "diff_vec")})
    h = K.hit_rate(s, ["dev_score", "model_score", "rect_score"], 0.1)
    return h.select("creator", F.round("hit_rate", 6).alias("hit_rate"), "n")


# ---------------------------------------------------------------- model application (rows-only)

def _first_line_model():
    """Deterministic stand-in for a generator model: the first non-blank line, lower-cased."""
    def run(texts):
        out = []
        for x in texts:
            first = next((ln.strip() for ln in x.splitlines() if ln.strip()), "")
            out.append(first.lower())
        return out
    return run


@register("batch_model_apply", sql=f"""
SELECT doc_id, coalesce(lower({S.strip(f"list_filter(string_split(text, chr(10)), lambda x: length({S.strip('x')}) > 0)[1]")}), '') AS inference,
       NULL::VARCHAR AS error FROM documents""")
def batch_model_apply_q(t):
    """M1: a user model over every distinct document text, in Arrow batches."""
    r = MD.batch_model_apply(t.documents.select("doc_id", "text"), "text", "inference", _first_line_model,
                             T.StringType())
    return r.select("doc_id", "inference", "error")
