"""Applying user-supplied models in Arrow batches, and a deterministic stand-in embedder."""

from __future__ import annotations

import sys
from collections.abc import Callable
from contextlib import contextmanager

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import text_digest, whitespace_tokens
from ..session import ship_package


@contextmanager
def _by_value(module_name: str, wanted: bool):
    """While a UDF is pickled, pickle the named module's functions by value; the registration is undone afterwards."""
    mod = sys.modules.get(module_name) if wanted and module_name not in ("__main__", "builtins") else None
    if mod is None or module_name in cloudpickle.list_registry_pickle_by_value():
        yield
        return
    cloudpickle.register_pickle_by_value(mod)
    try:
        yield
    finally:
        cloudpickle.unregister_pickle_by_value(mod)


def _model_cache() -> dict:
    """Per-process cache (survives across tasks in a reused Python worker)."""
    return sys.__dict__.setdefault("_changelens_model_cache", {})


def batch_model_apply(df: DataFrame, in_col: str, out_col: str, make_fn: Callable[[], Callable],
                      out_type: T.DataType = T.StringType(), error_col: str = "error",
                      cache_key: str | None = None, distinct: bool = True,
                      ship_model_module: bool = True) -> DataFrame:
    """M1: apply ``make_fn()`` (built once per Python worker) to a column in Arrow batches.

    ``make_fn()`` returns ``f(list[str]) -> list[result]``.  A failing batch is
    retried row by row; a failing row yields a null result and an ``error``
    message instead of failing the job.  With ``distinct=True`` each distinct
    input is sent to the model once and the result joined back by a 128-bit digest.
    A batch of another length than its input counts as failing.
    ``ship_model_module`` pickles the module defining ``make_fn`` by value, for
    model code that is not installed on the workers.
    """
    ship_package(df.sparkSession)
    key = cache_key or f"{make_fn.__module__}.{getattr(make_fn, '__qualname__', id(make_fn))}"
    schema = T.StructType([T.StructField("value", out_type), T.StructField("error", T.StringType())])

    @F.pandas_udf(schema)
    def apply(texts: pd.Series) -> pd.DataFrame:
        cache = _model_cache()
        fn = cache.get(key)
        if fn is None:
            fn = cache[key] = make_fn()
        vals = texts.where(texts.notna(), "").tolist()
        try:
            res, errs = list(fn(vals)), [None] * len(vals)
            if len(res) != len(vals):
                raise ValueError(f"{len(res)} results for {len(vals)} inputs")
        except Exception:  # noqa: BLE001 - isolate the failing row(s)
            res, errs = [], []
            for v in vals:
                try:
                    one = list(fn([v]))
                    if len(one) != 1:
                        raise ValueError(f"{len(one)} results for 1 input")
                    res.append(one[0])
                    errs.append(None)
                except Exception as e:  # noqa: BLE001
                    res.append(None)
                    errs.append(f"{type(e).__name__}: {e}")
        return pd.DataFrame({"value": res, "error": errs})

    with _by_value(make_fn.__module__, ship_model_module):
        called = apply(F.col(in_col))  # pickles the model factory
    if not distinct:
        r = df.withColumn("__m", called)
        return r.withColumns({out_col: F.col("__m.value"), error_col: F.col("__m.error")}).drop("__m")
    keyed = df.withColumn("__th", text_digest(in_col))
    uniq = keyed.select("__th", in_col).dropDuplicates(["__th"])
    scored = uniq.select("__th", called.alias("__m")).select(
        "__th", F.col("__m.value").alias(out_col), F.col("__m.error").alias(error_col))
    return keyed.join(scored, "__th", "left").drop("__th")


def hashed_embedding(c, dim: int = 64) -> Column:
    """M2 stand-in embedder: bag of whitespace tokens hashed (md5) into ``dim`` buckets.

    Deterministic, JVM-side, and reproducible in SQL; blank text -> zero vector,
    as the reference does for blank / missing text.  Real models go through M1.
    """
    # bucket = (first 8 hex digits of md5 as an integer) mod dim
    buckets = F.transform(whitespace_tokens(c), lambda tk: F.conv(F.substring(F.md5(tk), 1, 8), 16, 10).cast("bigint") % dim)
    # count per bucket = size - size after removing it: native, codegen'd array work,
    # one md5 per token and no per-bucket lambda evaluation
    return F.array(*[(F.size(buckets) - F.size(F.array_remove(buckets, j))).cast("double") for j in range(dim)])


def embed_text(df: DataFrame, text_col: str, out_col: str, dim: int = 64) -> DataFrame:
    """M2 with the stand-in embedder (signature shared with model-backed embedders)."""
    return df.withColumn(out_col, hashed_embedding(text_col, dim))


embed_text.native = True  # one column expression of the text
