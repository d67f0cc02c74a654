"""Learned decision lists over document statistics, as Spark conditional expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import WORD, word_array, written

WINDOW = 8
BASE_STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Statistics that conditions are grown on, as expressions over the columns of ``with_statistics``.
FEATURES = {
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "marks_per_word": "n_marks / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "mean_word_chars": "word_chars / greatest(n_words, 1)",
    "distinct_share": "n_distinct_words / greatest(n_words, 1)",
    "words": "cast(n_words as double)",
}


@dataclass(frozen=True)
class Condition:
    feature: str
    op: str  # ">" or "<="
    threshold: float

    def sql(self) -> str:
        return f"{self.feature} {self.op} {self.threshold!r}D"


@dataclass
class DecisionList:
    """Ordered conjunctions that reject; a row that meets none is kept."""

    rules: list[list[Condition]] = field(default_factory=list)

    def matches(self, rule: list[Condition]) -> Column:
        return F.expr(" AND ".join(c.sql() for c in rule))

    def rule_number(self) -> Column:
        """Number (from 1) of the first rule a row meets, 0 if none."""
        out = None
        for i, rule in enumerate(self.rules, 1):
            out = F.when(self.matches(rule), i) if out is None else out.when(self.matches(rule), i)
        return F.lit(0) if out is None else out.otherwise(0)


def _repeat_words(df: DataFrame, w: str, out: str) -> DataFrame:
    """Words inside w-word windows that occur twice or more in the row's ``__words``.

    Window hashes are compared as a set first; only rows with a repeated hash
    sort (hash, position) pairs.  Work per row is n log n.
    """
    span = int(w)
    joined = "__words"
    for step in (1, 2, 4):  # hashes of 2, 4 and 8 words from two halves
        joined = f"zip_with({joined}, slice({joined}, {step + 1}, size(__words)), (a, b) -> xxhash64(a, b))"
        df = df.withColumn(f"__h{step}", F.expr(joined))
        joined = f"__h{step}"
    df = df.withColumn("__hs", F.expr(
        f"CASE WHEN size(__words) >= {span} THEN slice({joined}, 1, size(__words) - {span - 1}) ELSE cast(array() as array<bigint>) END"))
    df = df.withColumn("__ps", F.expr(
        "CASE WHEN size(array_distinct(__hs)) < size(__hs) THEN array_sort(transform(__hs, (x, i) -> struct(x AS h, i AS i))) END"))
    df = df.withColumn("__at", F.expr(
        "array_sort(filter(transform(__ps, (x, j) -> CASE WHEN x.h = get(__ps, j - 1).h OR x.h = get(__ps, j + 1).h THEN x.i END), x -> x IS NOT NULL))"))
    return df.withColumn(out, F.expr(
        "coalesce(aggregate(__at, struct(0L AS n, 0 AS upto), (a, p) -> struct("
        f"a.n + {span} - greatest(a.upto - p, 0) AS n, p + {span} AS upto)).n, 0L)")).drop("__h1", "__h2", "__h4", "__hs", "__ps", "__at")


def with_statistics(docs: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Statistics of every whole text, in columns beside ``carry`` (default: all columns of ``docs``).

    A null text counts as empty: all zero.  A column of ``docs`` with the name of
    a statistic is replaced by it.
    """
    made = [*BASE_STATS, "n_upper", "n_marks", "n_lines", "n_distinct_words", "base_failed", *FEATURES]
    names = [c for c in (docs.columns if carry is None else carry) if c.lower() not in made]
    own = [F.col(f"`{c}`") for c in names]
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    df = docs.select(*own, t.alias("__text"), word_array(t).alias("__words"), F.split(t, "\n").alias("__lines"))
    df = df.withColumn("__full", F.filter("__lines", lambda x: x.rlike(WORD)))
    df = _repeat_words(df, str(WINDOW), "n_repeat_words")
    df = df.select(
        *[F.col(f"`{c}`") for c in names], "n_repeat_words",
        F.size("__words").cast("long").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        F.regexp_count("__text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("__full") - F.size(F.array_distinct("__full"))).cast("long").alias("n_dup_lines"),
        F.regexp_count("__text", F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        F.regexp_count("__text", F.lit("[!?]")).cast("long").alias("n_marks"),
        F.size("__full").cast("long").alias("n_lines"),
        F.size(F.array_distinct("__words")).cast("long").alias("n_distinct_words"))
    # behind a generator: a filter on a statistic would else be pushed into the lambdas above and evaluate them over and over
    found = [c for c in df.columns if c not in names]
    df = df.select(*[F.col(f"`{c}`") for c in names], F.inline(F.array(F.struct(*found))))
    df = df.withColumn("base_failed", F.expr("n_words < 20 OR 100 * n_repeat_words > 30 * n_words"))
    return df.withColumns({k: F.expr(v).cast("double") for k, v in FEATURES.items()})


def _thresholds(labelled: DataFrame, points: int) -> dict[str, list[float]]:
    """Quantiles of every feature, over rejects and over the rest, as candidate thresholds."""
    at = F.array(*[F.lit(i / points) for i in range(1, points)])
    row = labelled.groupBy("bad").agg(*[F.percentile_approx(f, at, 2000).alias(f) for f in FEATURES]).collect()
    return {f: sorted({float(x) for r in row for x in r[f] or []}) for f in FEATURES}


def _bin_counts(rows: DataFrame, cuts: dict[str, list[float]]) -> dict[str, list[tuple]]:
    """For each feature and bin between thresholds: (rejects, others, least, greatest value).

    One grouped count; at most one row per bin comes back.
    """
    def bin_of(f):  # number of thresholds below the value, so that "<= cut i" holds in bins 0..i
        return F.size(F.filter(F.array(*[F.lit(c) for c in cuts[f]]), lambda c: c < F.col(f)))

    pairs = F.array(*[F.struct(F.lit(f).alias("f"), bin_of(f).alias("b"), F.col(f).alias("v")) for f in FEATURES])
    got = (rows.select("bad", F.explode(pairs).alias("p")).groupBy("p.f", "p.b")
           .agg(F.count_if("bad").alias("pos"), F.count_if(~F.col("bad")).alias("neg"),
                F.min("p.v").alias("low"), F.max("p.v").alias("high")).collect())
    out = {f: [(0, 0, None, None)] * (len(cuts[f]) + 1) for f in FEATURES}
    for r in got:
        out[r.f][r.b] = (r.pos, r.neg, r.low, r.high)
    return out


def _best_condition(counts, pos0: int, neg0: int, least: int) -> Condition | None:
    """Condition with the greatest FOIL information gain, its threshold halfway across the gap it cuts; None if none gains."""
    base = math.log2(pos0 / (pos0 + neg0))
    best = (1e-9, None)
    for f in FEATURES:
        run_p = run_n = 0
        full = [b for b in counts[f] if b[0] + b[1]]
        for here, after in zip(full, full[1:]):
            run_p, run_n = run_p + here[0], run_n + here[1]
            for op, p, n in (("<=", run_p, run_n), (">", pos0 - run_p, neg0 - run_n)):
                if p >= least:
                    gain = p * (math.log2(p / (p + n)) - base)
                    if gain > best[0]:
                        best = (gain, Condition(f, op, (here[3] + after[2]) / 2))
    return best[1]


def learn(labelled: DataFrame, *, points: int = 48, precision: float = 0.95, least: int = 5, max_rules: int = 12,
          max_conditions: int = 4) -> DecisionList:
    """Sequential covering.  ``labelled``: the feature columns, ``bad`` (boolean) and ``fold`` (0 = pruning rows).

    A rule grows on the growing rows by the condition of greatest gain until it
    covers no good row there, is cut back to the prefix with the best
    (rejects - others) / covered on the pruning rows, and is kept if it holds
    ``precision`` on both together.  Rows it covers leave the table.  Every step
    is one grouped count over the labelled table; only counts reach the driver.
    ``max_rules`` and ``max_conditions`` bound the size of the list.
    """
    rules: list[list[Condition]] = []
    n = labelled.agg(F.sum(F.col("bad").cast("long")).alias("p")).first().p or 0
    if n < least:
        return DecisionList(rules)
    cuts = _thresholds(labelled, points)
    while len(rules) < max_rules:
        left = labelled.filter(~_any(rules)) if rules else labelled
        rule: list[Condition] = []
        while len(rule) < max_conditions:
            grow = left.filter(F.col("fold") != 0)
            if rule:
                grow = grow.filter(DecisionList().matches(rule))
            counts = _bin_counts(grow, cuts)
            pos, neg = (sum(c[i] for c in next(iter(counts.values()))) for i in (0, 1))
            if pos < least or neg == 0:
                break
            found = _best_condition(counts, pos, neg, least)
            if found is None:
                break
            rule.append(found)
        if not rule:
            break
        rule = _pruned(left, rule, precision)
        if rule is None:
            break
        rules.append(rule)
    return DecisionList(rules)


def _any(rules: list[list[Condition]]) -> Column:
    return F.expr(" OR ".join("(" + " AND ".join(c.sql() for c in r) + ")" for r in rules))


def _pruned(left: DataFrame, rule: list[Condition], precision: float) -> list[Condition] | None:
    """The best prefix of ``rule`` on the pruning rows that holds ``precision`` over all rows; None if there is none."""
    def counts(i):
        hit = DecisionList().matches(rule[:i])
        prune = F.col("fold") == 0
        return [F.count_if(hit & c).alias(f"{k}{i}") for k, c in (
            ("pp", prune & F.col("bad")), ("pn", prune & ~F.col("bad")), ("ap", F.col("bad")), ("an", ~F.col("bad")))]
    got = left.agg(*[c for i in range(1, len(rule) + 1) for c in counts(i)]).first()
    best = None
    for i in range(1, len(rule) + 1):
        pp, pn, ap, an = (got[f"{k}{i}"] for k in ("pp", "pn", "ap", "an"))
        if ap == 0 or ap / (ap + an) < precision:
            continue
        worth = (pp - pn) / (pp + pn) if pp + pn else 0.0
        if best is None or worth > best[0]:
            best = (worth, rule[:i])
    return best and best[1]


def labelled_statistics(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """Statistics of the labelled documents that pass the base rules, with ``bad`` and ``fold``.

    Rows without a label or with a null one teach nothing; a document with
    several labels counts as bad if any label is 0.
    """
    lab = (labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id")
           .agg((F.min("quality") == 0).alias("bad")))
    return written(stats.filter(~F.col("base_failed")).select("doc_id", *FEATURES).join(lab, "doc_id")
                   .withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(3))), "quality-labelled")


def judge(stats: DataFrame, rules: DecisionList) -> DataFrame:
    """Add ``rule`` (first rule met, 0 none) and ``kept`` to a table of statistics."""
    return (stats.withColumn("rule", rules.rule_number())
            .withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0)))


def rate_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Statistics and verdict for every document: learn from ``labels``, then apply the list to all rows.

    Every row of ``docs`` gets one row (null and empty texts: base_failed).  No
    usable labels: no rules, so only the base rules reject.
    """
    stats = written(with_statistics(docs.select("doc_id", "text"), carry=["doc_id"]), "quality-stats")
    return judge(stats, learn(labelled_statistics(stats, labels)))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents the list keeps, with their own columns only.

    Statistics, not texts, meet the labels; the verdict is then an expression
    beside the scan.  So no text is shuffled.
    """
    rules = learn(labelled_statistics(with_statistics(docs.select("doc_id", "text"), carry=["doc_id"]), labels))
    packed = docs.select(F.struct("*").alias("__row"), F.col("text").alias("__t"))
    return judge(with_statistics(packed, "__t", carry=["__row"]), rules).filter("kept").select("__row.*")
