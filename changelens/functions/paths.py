"""Column helpers for file paths and commit parents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _col

# Fixed values that must equal the reference: substring -> file kind, first hit wins.
FILE_KINDS = [("test", "Test"), ("readme", "README"), ("license", "LICENSE")]
FILE_KIND_NULL = "Unknown"
FILE_KIND_OTHER = "Source"


def path_coalesce(new_path, old_path) -> Column:
    """New path, else old path; empty strings count as missing (Python ``or``)."""
    return F.coalesce(F.nullif(_col(new_path), F.lit("")), F.nullif(_col(old_path), F.lit("")))


def path_category(c) -> Column:
    """Unknown for null, else the first case-insensitive substring hit, else Source."""
    low = F.lower(_col(c))
    expr = F.when(_col(c).isNull(), F.lit(FILE_KIND_NULL))
    for needle, kind in FILE_KINDS:
        expr = expr.when(low.contains(needle), F.lit(kind))
    return expr.otherwise(F.lit(FILE_KIND_OTHER))


def path_extension(c) -> Column:
    """Text after the last dot; no dot -> whole path; trailing dot -> ''."""
    return F.substring_index(_col(c), ".", -1)


def merge_flag(parents) -> Column:
    """P8: 'Y' when more than one parent else 'N'."""
    return F.when(F.size(_col(parents)) > 1, F.lit("Y")).otherwise(F.lit("N"))


def first_parent(parents) -> Column:
    """First parent, null for a root commit (``get`` never raises under ANSI)."""
    return F.get(_col(parents), 0)
