"""Column helpers for commit messages and other text (all JVM-side)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference: the bug-fix keyword list, in its
# original order (``crash`` appears twice there; matching is the same either way).
BUG_TERMS = [
    "bug", "fix", "patch", "issue", "resolve", "crash", "solve", "regression", "fall back",
    "assertion", "coverity", "reproducible", "stack-wanted", "steps-wanted", "testcase",
    "steps to reproduce", "fail", "npe", "except", "broken", "differential testing",
    "crash", "overflow", "problem", "avoid", "workaround", "stop", "break", "freez",
    "hang", "error", "leak",
]


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def terms_regex(terms) -> str:
    """One alternation of literal substrings (each quoted), de-duplicated in order."""
    seen = []
    for t in terms:
        if t not in seen:
            seen.append(t)
    return "|".join(re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", t) for t in seen)


# The characters that Python's str.strip() and str.split() take as white space,
# and those at which str.splitlines() ends a line (besides CR LF).
SPACE_CLASS = r"[\x09-\x0D\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
SPACES = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
                           0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
# Java looks up a class of single characters below U+0100 in one table; other classes walk a chain of calls at each character.
# So patterns ask for these first, and for the wide ones only at a character above U+00FF.
LATIN_SPACE = r"\x09\x0A\x0B\x0C\x0D\x1C\x1D\x1E\x1F\x20\x85\xA0"
WIDE_SPACE = r"[^\x00-\xFF](?<=[\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000])"
LINE_END = r"\r\n|[\n\x0B\x0C\r\x1C-\x1E\x85\u2028\u2029]"
OTHER_LINE_END = r"[\x0B\x0C\r\x1C-\x1E\x85\u2028\u2029]"


def strip_ws(c) -> Column:
    """Python ``str.strip()`` (Spark ``trim`` strips spaces only)."""
    return F.btrim(_col(c), F.lit(SPACES))


def normalize_message(c) -> Column:
    """Lower, strip, LF -> space, CR -> space (the final miner's order)."""
    return F.translate(strip_ws(F.lower(_col(c))), "\n\r", "  ")


def one_line(c) -> Column:
    """Keep case, strip, LF -> space (CR left as is)."""
    return F.replace(strip_ws(_col(c)), F.lit("\n"), F.lit(" "))


def contains_any(c, terms=BUG_TERMS) -> Column:
    """True when the text contains any of the substrings (not whole words)."""
    return _col(c).rlike(terms_regex(terms))


def escape_newlines(c) -> Column:
    """Real CR / LF -> the two-character sequences ``\\r`` / ``\\n``; null -> ''."""
    x = F.coalesce(_col(c), F.lit(""))
    return F.replace(F.replace(x, F.lit("\r"), F.lit("\\r")), F.lit("\n"), F.lit("\\n"))


def unescape_newlines(c) -> Column:
    """P5: inverse of P4 (lossy on literal backslash-n); null -> ''."""
    x = F.coalesce(_col(c), F.lit(""))
    return F.replace(F.replace(x, F.lit("\\n"), F.lit("\n")), F.lit("\\r"), F.lit("\r"))


def null_to_empty(c) -> Column:
    """P7."""
    return F.coalesce(_col(c), F.lit(""))


def is_blank(c) -> Column:
    """Null, empty or whitespace-only."""
    return F.coalesce(F.length(strip_ws(c)) == 0, F.lit(True))


def preview(c, n: int) -> Column:
    """First n characters, '...' appended only when the text is longer."""
    x = _col(c)
    return F.concat(F.substring(x, 1, n), F.when(F.length(x) > n, F.lit("...")).otherwise(F.lit("")))


def first_token(c) -> Column:
    """P20: first whitespace-separated word; blank -> null."""
    return F.nullif(F.regexp_extract(_col(c), f"([^{SPACE_CLASS[1:]}+)", 1), F.lit(""))


def squeeze_diff(c) -> Column:
    """Drop every space, then each LF LF -> LF once, left to right."""
    return F.replace(F.replace(_col(c), F.lit(" "), F.lit("")), F.lit("\n\n"), F.lit("\n"))


def whitespace_tokens(c) -> Column:
    """Python ``str.split()`` tokens; blank -> empty array."""
    return F.when(_col(c).rlike(WIDE_SPACE), space_split(c, f"{SPACE_CLASS}+")).otherwise(space_split(c))


def space_split(c, pattern: str = f"[{LATIN_SPACE}]+") -> Column:
    """The non-empty pieces of a text; the default pattern is for texts without wide white space."""
    # only a blank text has an empty piece; named once, as Spark evaluates a text named in a condition and its branch twice
    return F.array_remove(F.split(strip_ws(c), pattern), "")


def truncate_tokens(c, max_tokens: int = 512) -> Column:
    """Keep the first ``max_tokens`` whitespace tokens."""
    return F.slice(whitespace_tokens(c), 1, max_tokens)


# Fixed pattern: the echoed lead-in that a rewriting model prepends.
ECHO_LEAD_IN = r"(?i)^create a (new )?commit message.*?:\s*"


def model_text_cleanup(c) -> Column:
    """Strip; drop the echoed lead-in; first non-blank line (trimmed), else the text."""
    t = strip_ws(F.regexp_replace(strip_ws(_col(c)), ECHO_LEAD_IN, ""))
    lines = F.filter(F.split(t, LINE_END), lambda x: F.length(strip_ws(x)) > 0)
    return F.coalesce(strip_ws(F.get(lines, 0)), t)


def lines(c) -> Column:
    """Python ``splitlines()``: no trailing empty element, '' -> [].

    A text whose line ends are all LF, told by one scan, is split at that character; only others go by the pattern.
    """
    x = _col(c)
    body = F.regexp_replace(x, rf"(?:{LINE_END})\z", "")
    unix = F.when(x.endswith("\n"), x.substr(F.lit(1), F.length(x) - 1)).otherwise(x)
    return (F.when(F.length(x) == 0, F.array().cast("array<string>")).when(x.rlike(OTHER_LINE_END), F.split(body, LINE_END))
            .otherwise(F.split(unix, "\n")))


def text_digest(c) -> Column:
    """128-bit identity of a text (null counts as empty), for joins that must not mix up texts."""
    return F.unhex(F.md5(F.coalesce(_col(c), F.lit(""))))


def whole_json(c, element: str) -> Column:
    """The text parsed as one JSON value of type ``element``; null if it isn't, also when text follows the value.

    Wrapped in brackets, so that trailing text breaks the parse instead of
    being passed over.
    """
    parsed = F.from_json(F.concat(F.lit("["), _col(c), F.lit("]")), f"array<{element}>")
    return F.when(F.size(parsed) == 1, F.get(parsed, 0))


def is_json_object(c) -> Column:
    """True when the whole text is one JSON object."""
    return whole_json(c, "map<string,string>").isNotNull()
