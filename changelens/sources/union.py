"""The same extraction over several sources, concatenated."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def multi_source_union(sources: dict[str, DataFrame], extract: Callable[[DataFrame], DataFrame] | None = None,
                       source_col: str | None = "repo") -> DataFrame:
    """UNION ALL of ``extract(df)`` per source; ``source_col=None`` drops the name (reference parity)."""
    frames = []
    for name, df in sources.items():
        x = extract(df) if extract else df
        if source_col:
            x = x.withColumn(source_col, F.lit(name))
        frames.append(x)
    return reduce(lambda a, b: a.unionByName(b), frames)
