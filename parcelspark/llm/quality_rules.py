"""Quality rules learned as a decision list of threshold conjunctions, applied as Spark conditional expressions."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.once import computed_once

# fixed patterns: the six ASCII spaces, and the symbols that are counted
SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"

# fixed limits of the base rules
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

SAMPLE_ROWS = 20_000  # labelled rows the rules are learned from, at most

FEATURES = ["n_words", "word_length", "symbol_share", "line_repeat_share", "repeat_share", "distinct_share", "upper_share", "mark_share", "digit_share"]


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the struct column ``_stats``: counts of words, symbols, repeated lines and windows, and shares of them.

    All of it is array functions inside the row. The 3-word windows of a text
    are compared as a set first; only texts that repeat one sort them.
    """
    base = docs.withColumn("_text", F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    split = computed_once(
        base,
        _words=F.filter(F.split("_text", SPACES), lambda w: w != ""),
        _lines=F.filter(F.split("_text", "\n"), lambda s: F.length(F.regexp_replace(s, SPACES, "")) > 0),
    )
    windows = computed_once(split, _windows=F.expr(
        "CASE WHEN size(_words) < 3 THEN array() ELSE "
        "transform(slice(_words, 1, size(_words) - 2), (w, i) -> concat_ws(' ', w, _words[i + 1], _words[i + 2])) END"))
    # windows in order, so equal ones are neighbours; empty where nothing repeats
    ordered = computed_once(windows, _ordered=F.expr(
        "CASE WHEN size(array_distinct(_windows)) = size(_windows) THEN cast(array() AS array<struct<w:string,i:int>>) "
        "ELSE array_sort(transform(_windows, (w, i) -> struct(w, i))) END"))
    places = computed_once(ordered, _places=F.expr(
        "array_sort(transform(filter(_ordered, (x, k) -> (k > 0 AND _ordered[k - 1].w = x.w) "
        "OR (k < size(_ordered) - 1 AND _ordered[k + 1].w = x.w)), x -> x.col2))".replace("x.col2", "x.i")))
    covered = F.expr(
        "aggregate(_places, struct(0L AS n, 0 AS upto), (a, i) -> struct(a.n + i + 3 - greatest(i, a.upto) AS n, i + 3 AS upto), a -> a.n)")
    counts = computed_once(
        places,
        _counts=F.struct(
            F.size("_words").cast("long").alias("n_words"),
            (F.length("_text") - F.regexp_count("_text", F.lit(SPACES[:-1]))).cast("long").alias("word_chars"),
            F.regexp_count("_text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
            (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
            F.size("_lines").cast("long").alias("n_lines"),
            covered.cast("long").alias("n_repeat_words"),
            F.size(F.array_distinct("_words")).cast("long").alias("n_distinct"),
            F.regexp_count("_text", F.lit("[A-Z]")).cast("long").alias("n_upper"),
            F.regexp_count("_text", F.lit("[!?]")).cast("long").alias("n_marks"),
            F.regexp_count("_text", F.lit("[0-9]")).cast("long").alias("n_digits"),
        ),
    )
    c = F.col("_counts")

    def share(part: str, whole: str) -> Column:
        return F.coalesce(F.try_divide(c[part].cast("double"), c[whole].cast("double")), F.lit(0.0))

    stats = F.struct(
        c["n_words"].alias("n_words"), c["word_chars"].alias("word_chars"), c["n_symbols"].alias("n_symbols"),
        c["n_dup_lines"].alias("n_dup_lines"), c["n_repeat_words"].alias("n_repeat_words"),
        share("word_chars", "n_words").alias("word_length"), share("n_symbols", "word_chars").alias("symbol_share"),
        share("n_dup_lines", "n_lines").alias("line_repeat_share"), share("n_repeat_words", "n_words").alias("repeat_share"),
        share("n_distinct", "n_words").alias("distinct_share"), share("n_upper", "word_chars").alias("upper_share"),
        share("n_marks", "n_words").alias("mark_share"), share("n_digits", "word_chars").alias("digit_share"),
    )
    return computed_once(counts, _stats=stats).select(*docs.columns, "_stats")


@dataclass(frozen=True)
class Condition:
    feature: str
    at_most: bool
    threshold: float

    def holds(self, rows: dict[str, np.ndarray]) -> np.ndarray:
        return rows[self.feature] <= self.threshold if self.at_most else rows[self.feature] > self.threshold

    def column(self) -> Column:
        value, threshold = F.col("_stats")[self.feature].cast("double"), F.lit(self.threshold)
        return value <= threshold if self.at_most else value > threshold

    def __str__(self) -> str:
        return f"{self.feature} {'<=' if self.at_most else '>'} {self.threshold:.6g}"


@dataclass
class Rule:
    conditions: list[Condition] = field(default_factory=list)

    def covers(self, rows: dict[str, np.ndarray]) -> np.ndarray:
        mask = np.ones(len(next(iter(rows.values()))), bool)
        for c in self.conditions:
            mask &= c.holds(rows)
        return mask

    def column(self) -> Column:
        out = F.lit(True)
        for c in self.conditions:
            out = out & c.column()
        return out

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions))


def _grown(rows, bad, max_conditions: int, thresholds: int) -> Rule:
    """Add the condition with the highest information gain until only bad rows are covered."""
    rule, inside = Rule(), np.ones(len(bad), bool)
    while len(rule.conditions) < max_conditions:
        p, n = (inside & bad).sum(), (inside & ~bad).sum()
        if not n or not p:
            break
        before, best = np.log2(p / (p + n)), (1e-9, None)
        for name in FEATURES:
            values = rows[name][inside]
            for t in np.unique(np.quantile(values, np.linspace(0, 1, thresholds + 2)[1:-1], method="lower")):
                low = values <= t
                for at_most, part in ((True, low), (False, ~low)):
                    p1, size = (part & bad[inside]).sum(), part.sum()
                    if p1 and (gain := p1 * (np.log2(p1 / size) - before)) > best[0]:
                        best = (gain, Condition(name, at_most, float(t)))
        if best[1] is None:
            break
        rule.conditions.append(best[1])
        inside &= best[1].holds(rows)
    return rule


def _pruned(rule: Rule, rows, bad) -> Rule:
    """The shortest beginning of the rule that does best on rows it was not grown on."""

    def worth(n: int) -> float:
        inside = Rule(rule.conditions[:n]).covers(rows)
        p, q = (inside & bad).sum(), (inside & ~bad).sum()
        return (p - q) / (p + q) if p + q else -1.0

    sizes = range(1, len(rule.conditions) + 1)
    return Rule(rule.conditions[:max(sizes, key=lambda n: (worth(n), -n))])


def learn(
    rows: dict[str, np.ndarray], bad: np.ndarray, order: np.ndarray, max_rules: int = 24, max_conditions: int = 4,
    thresholds: int = 48, precision: float = 0.98, least: int = 3,
) -> list[Rule]:
    """Sequential covering: grow a rule on two thirds of the rows, prune it on the rest, drop what it covers, go on.

    A rule is kept if at least ``precision`` of all it covers among the rows
    left is bad. Learning ends at the first rule that is not.
    """
    left, rules = np.ones(len(bad), bool), []
    grow = order % 3 != 0
    while len(rules) < max_rules and (left & bad & grow).any():
        part = lambda mask: ({k: v[mask] for k, v in rows.items()}, bad[mask])
        rule = _grown(*part(left & grow), max_conditions, thresholds)
        if not rule.conditions:
            break
        if (left & ~grow & bad).any():
            rule = _pruned(rule, *part(left & ~grow))
        inside = rule.covers(rows) & left
        if inside.sum() < least or (inside & bad).sum() < precision * inside.sum():
            break
        rules.append(rule)
        left &= ~inside
    return rules


def learn_rules(
    docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", label_col: str = "quality",
    text_col: str = "text", **options,
) -> list[Rule]:
    """Rules for rejecting texts, from at most ``sample_rows`` labelled ids (those with the smallest id hashes).

    An id labelled more than once counts with its lowest label, an id with several rows with the text of the
    smallest hash; null labels and ids are ignored; 0 is bad.
    """
    chosen = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
        .groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.min(label_col).alias("_label"))
        .orderBy(F.xxhash64("_id"), "_id").limit(sample_rows)
    )
    # a bounded number of rows, so it may be broadcast; of an id with many rows one is kept, so the driver gets no more either
    own = (
        docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_body")).join(F.broadcast(chosen), "_id")
        .groupBy("_id", "_label").agg(F.min(F.struct(F.xxhash64("_body"), "_body"))["_body"].alias("_body"))
    )
    stats = with_statistics(own, "_body")
    found = stats.select("_id", "_label", *[F.col("_stats")[n].cast("double").alias(n) for n in FEATURES]).collect()
    found.sort(key=lambda r: tuple(r))
    if not found:
        return []
    rows = {n: np.array([r[n] for r in found]) for n in FEATURES}
    bad = np.array([r["_label"] == 0 for r in found])
    order = np.arange(len(found))
    return learn(rows, bad, order, **options)


def verdict(rules: list[Rule]) -> Column:
    """True where no rule of the list fires: one ordered conditional expression."""
    out = None
    for r in rules:
        out = F.when(r.column(), F.lit(False)) if out is None else out.when(r.column(), F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def judged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with ``_stats``, ``_base_failed`` and ``_kept``.

    The base rules reject texts of under 50 words and texts more than half of
    whose words stand in repeated 3-word windows; the learned list judges the rest.

    Null and empty texts have no words and fail; ids play no part in the
    verdict, so repeated rows are judged alike; without labels only the base
    rules act; empty tables are fine; other columns stay as they are.
    """
    rules = learn_rules(docs, labels, id_col=id_col, text_col=text_col, **options)
    s = F.col("_stats")
    failed = (s["n_words"] < MIN_WORDS) | (s["n_repeat_words"] * 100 > s["n_words"] * MAX_REPEAT_PERCENT)
    return with_statistics(docs, text_col).withColumn("_base_failed", failed).withColumn(
        "_kept", ~F.col("_base_failed") & verdict(rules))
