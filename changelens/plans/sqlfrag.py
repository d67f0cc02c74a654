"""DuckDB SQL fragments mirroring the Spark column helpers (oracle side only)."""

from __future__ import annotations

from .views import sql_lines  # noqa: F401


# Python's white space, in the regex syntax of the oracle
SPACE = "[\\x{09}-\\x{0D}\\x{1C}-\\x{20}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"


def strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{SPACE}+', ''), '{SPACE}+$', '')"


def normalize(x: str) -> str:
    return f"translate({strip(f'lower({x})')}, chr(10) || chr(13), '  ')"


# The bug-fix terms, written out for the oracle on its own.
TERMS = ("bug|fix|patch|issue|resolve|crash|solve|regression|fall back|assertion|coverity|reproducible|stack-wanted|steps-wanted|testcase|"
         "steps to reproduce|fail|npe|except|broken|differential testing|overflow|problem|avoid|workaround|stop|break|freez|hang|error|leak")


def quote_terms() -> str:
    return TERMS


def tokens(x: str) -> str:
    s = strip(x)
    return f"(CASE WHEN length({s}) = 0 THEN []::VARCHAR[] ELSE string_split_regex({s}, '{SPACE}+') END)"


def kind(p: str) -> str:
    return (f"CASE WHEN {p} IS NULL THEN 'Unknown' WHEN contains(lower({p}), 'test') THEN 'Test' "
            f"WHEN contains(lower({p}), 'readme') THEN 'README' WHEN contains(lower({p}), 'license') THEN 'LICENSE' "
            f"ELSE 'Source' END")
