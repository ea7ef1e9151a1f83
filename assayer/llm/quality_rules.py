"""Quality rules: ordered threshold conjunctions learned by sequential covering, applied as one Spark conditional expression."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import SEPARATOR_CLASS, Scratch

#: Statistics of a text that rules may test; each is a number for every text, the empty one included.
FEATURES = ("n_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "distinct_share", "upper_share", "digit_share", "bang_share", "line_words")


def text_statistics(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """(q_row, BASE_COUNTS, FEATURES as q_...): each row as a struct, so that its names clash with none, and numbers of its text; null counts as empty.

    Repeated words: trigram hashes are sorted, and only texts in which two are equal sort them again with their places.
    """
    text, words, tri, order = F.coalesce(F.col(text_column), F.lit("")), F.col("q_words"), F.col("q_tri"), F.col("q_order")
    lines = F.filter(F.split(F.col("q_text"), "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    df = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("q_row"), text.alias("q_text"))
    df = df.withColumn("q_words", F.filter(F.split("q_text", SEPARATOR_CLASS), lambda x: x != "")).withColumn("q_lines", lines)
    df = df.withColumn("n_words", F.size("q_words").cast("long"))
    window = F.transform(F.slice("q_words", 1, F.greatest(F.lit(0), F.size("q_words") - 2)), lambda x, i: F.xxhash64(x, F.get(words, i + 1), F.get(words, i + 2)))
    df = df.withColumn("q_tri", window).withColumn("q_sorted", F.sort_array("q_tri"))
    repeats = F.exists(F.zip_with(F.slice("q_sorted", 2, F.greatest(F.lit(0), F.size("q_sorted") - 1)), F.slice("q_sorted", 1, F.greatest(F.lit(0), F.size("q_sorted") - 1)), lambda a, b: a == b), lambda x: x)
    placed = F.array_sort(F.transform(tri, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("q_order", F.when(repeats, placed))
    twice = F.filter(order, lambda x, k: x["h"].eqNullSafe(F.get(order, k - 1)["h"]) | x["h"].eqNullSafe(F.get(order, k + 1)["h"]))
    df = df.withColumn("q_places", F.array_sort(F.transform(twice, lambda x: x["i"])))
    places = F.col("q_places")
    covered = F.aggregate(F.transform(places, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(places, k + 1), p + 3) - p)), F.lit(0), lambda a, x: a + x)
    # A generated row is a wall: a filter on these columns, pushed below, would put array expressions into the bodies of others.
    counts = F.struct(
        "n_words",
        F.length(F.array_join("q_words", "")).cast("long").alias("word_chars"),
        F.regexp_count("q_text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("q_lines") - F.size(F.array_distinct("q_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("q_lines").cast("long").alias("q_n_lines"),
        F.size(F.array_distinct("q_words")).cast("long").alias("q_n_distinct"),
        F.regexp_count("q_text", F.lit(r"\p{Lu}")).cast("long").alias("q_n_upper"),
        F.regexp_count("q_text", F.lit(r"[0-9]")).cast("long").alias("q_n_digits"),
        F.regexp_count("q_text", F.lit(r"[!?]")).cast("long").alias("q_n_bangs"),
    )
    df = df.select("q_row", F.explode(F.array(counts)).alias("q_counts")).select("q_row", "q_counts.*")

    def share(a: str, b: str) -> Column:
        return F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))

    return df.select(
        "q_row",
        *BASE_COUNTS,
        F.col("n_words").cast("double").alias("q_n_words"),
        share("word_chars", "n_words").alias("q_mean_word"),
        share("n_symbols", "n_words").alias("q_symbol_share"),
        share("n_dup_lines", "q_n_lines").alias("q_dup_line_share"),
        share("n_repeat_words", "n_words").alias("q_repeat_share"),
        share("q_n_distinct", "n_words").alias("q_distinct_share"),
        share("q_n_upper", "word_chars").alias("q_upper_share"),
        share("q_n_digits", "word_chars").alias("q_digit_share"),
        share("q_n_bangs", "n_words").alias("q_bang_share"),
        share("n_words", "q_n_lines").alias("q_line_words"),
    )


BASE_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = F.col(f"q_{self.feature}")
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:g}"


@dataclass(frozen=True)
class DecisionList:
    """Rules in order; the first whose conditions all hold rejects a text, and a text that none fits is kept."""

    rules: tuple[tuple[Condition, ...], ...]

    def rule(self) -> Column:
        """The 1-based number of the rule that rejects; null where none does."""
        out = F.lit(None).cast("int")
        for number, conditions in reversed(list(enumerate(self.rules, 1))):
            test = conditions[0].column()
            for c in conditions[1:]:
                test = test & c.column()
            out = F.when(test, F.lit(number)).otherwise(out)
        return out

    def __str__(self) -> str:
        return "; ".join(" and ".join(map(str, r)) for r in self.rules)


class _Counts:
    """Weights of labelled cells: a cell is a vector of bins, with a number of rejects and of keeps."""

    def __init__(self, bins: np.ndarray, bad: np.ndarray, good: np.ndarray):
        self.bins, self.bad, self.good = bins, bad, good

    def where(self, mask: np.ndarray) -> _Counts:
        return _Counts(self.bins[mask], self.bad[mask], self.good[mask])

    def covered(self, rule: list[tuple[int, bool, int]]) -> np.ndarray:
        mask = np.ones(len(self.bad), bool)
        for feature, above, cut in rule:
            mask &= (self.bins[:, feature] > cut) == above
        return mask

    def worth(self, rule: list[tuple[int, bool, int]]) -> tuple[float, float]:
        mask = self.covered(rule)
        return float(self.bad[mask].sum()), float(self.good[mask].sum())


def _grow(data: _Counts, n_cuts: list[int], most: int) -> list[tuple[int, bool, int]]:
    """Adds the condition of the largest information gain until no keep is covered, or none gains."""
    rule: list[tuple[int, bool, int]] = []
    while len(rule) < most:
        p0, n0 = float(data.bad.sum()), float(data.good.sum())
        if not p0 or not n0:
            break
        start, best = math.log2(p0 / (p0 + n0)), (1e-9, None)
        for f, cuts in enumerate(n_cuts):
            bad, good = (np.cumsum(np.bincount(data.bins[:, f], weights=w, minlength=cuts + 1))[:cuts] for w in (data.bad, data.good))
            for above, p, n in ((False, bad, good), (True, p0 - bad, n0 - good)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(p > 0, p * (np.log2(p / (p + n)) - start), -1.0)
                if len(gain) and gain.max() > best[0]:
                    best = (float(gain.max()), (f, above, int(gain.argmax())))
        if best[1] is None:
            break
        rule.append(best[1])
        data = data.where(data.covered([best[1]]))
    return rule


def _prune(rule: list[tuple[int, bool, int]], data: _Counts) -> list[tuple[int, bool, int]]:
    """The first conditions of the rule, as many as are worth most on rows that it wasn't grown on; shorter on ties."""

    def value(k: int) -> float:
        p, n = data.worth(rule[:k])
        return (p - n) / (p + n) if p + n else -1.0

    return rule[: max(range(1, len(rule) + 1), key=lambda k: (value(k), -k))]


def cover(bins: np.ndarray, bad: np.ndarray, good: np.ndarray, fold: np.ndarray, cuts: list[list[float]], max_rules: int, max_conditions: int, min_precision: float) -> DecisionList:
    """Sequential covering: grow a rule on two thirds of the rows, prune it on the rest, keep it if it is precise on both, take away what it covers."""
    left, rules = np.ones(len(bad), bool), []
    n_cuts = [len(c) for c in cuts]
    while len(rules) < max_rules:
        rest = _Counts(bins[left], bad[left], good[left])
        growing = rest.where(fold[left] > 0)
        rule = _grow(growing, n_cuts, max_conditions)
        if not rule:
            break
        rule = _prune(rule, rest.where(fold[left] == 0))
        p, n = rest.worth(rule)
        if p < 3 or (p + 1) / (p + n + 2) < min_precision:
            break
        rules.append(tuple(Condition(FEATURES[f], above, cuts[f][cut]) for f, above, cut in rule))
        left[np.flatnonzero(left)[rest.covered(rule)]] = False
    return DecisionList(tuple(rules))


def _bin(value: Column, cuts: list[float]) -> Column:
    """How many of the cuts lie below the value."""
    return F.size(F.filter(F.lit(cuts).cast("array<double>"), lambda x: x < value)) if cuts else F.lit(0)


def learn(docs: DataFrame, labels: DataFrame, label_column: str = "quality", max_labelled: int = 20_000, max_cuts: int = 40, max_rules: int = 12, max_conditions: int = 4, min_precision: float = 0.85, id_column: str = "doc_id", text_column: str = "text") -> DecisionList:
    """Learns which texts have label 0, of those that pass the base rules.

    ``max_labelled`` bounds the labelled rows used: where there are more, about so many are taken by the hash of their id. Thresholds lie
    midway between quantiles; counts by vector of bins and label are grouped by Spark, and covering works on these counts. An id with several labels
    counts with the smallest; null labels and labels without a document are left out. Without labelled rejects the list is empty.
    """
    spark = docs.sparkSession
    known = labels.filter(F.col(label_column).isNotNull() & F.col(id_column).isNotNull())
    share = min(1.0, max_labelled / max(1, known.count()))
    picked = known.filter(F.pmod(F.xxhash64(id_column, F.lit("labelled")), F.lit(1 << 20)) < int(share * (1 << 20))) if share < 1 else known
    chosen = picked.groupBy(F.col(id_column).alias("q_id")).agg(F.min(label_column).alias("q_label"))
    rows = docs.select(F.col(id_column).alias("q_id"), F.col(text_column).alias("q_raw")).join(F.broadcast(chosen), "q_id")
    stats = text_statistics(rows, "q_raw").filter(~base_failed()).select("q_row.q_label", F.pmod(F.xxhash64("q_row.q_id", F.lit("fold")), F.lit(3)).alias("q_fold"), *(f"q_{f}" for f in FEATURES))
    scratch = Scratch(spark, "quality")
    stats = scratch.table(stats, "statistics")
    marks = [0.0, *(i / max_cuts for i in range(1, max_cuts)), 1.0]
    found = stats.agg(*(F.percentile_approx(F.col(f"q_{f}"), marks, F.lit(2000)).alias(f) for f in FEATURES)).head()
    low = stats.filter("q_label = 0").agg(*(F.percentile_approx(F.col(f"q_{f}"), marks[::2], F.lit(2000)).alias(f) for f in FEATURES)).head()
    seen = [sorted({x for x in [*(found[f] or []), *(low[f] or [])]}) for f in FEATURES]
    cuts = [sorted({round((a + b) / 2, 6) for a, b in zip(values, values[1:])}) for values in seen]
    bins = [_bin(F.col(f"q_{f}"), c).alias(f"b{k}") for k, (f, c) in enumerate(zip(FEATURES, cuts))]
    cells = stats.select((F.col("q_label") == 0).alias("bad"), "q_fold", *bins).groupBy("q_fold", *(f"b{k}" for k in range(len(FEATURES)))).agg(F.count_if("bad").alias("bad"), F.count_if(~F.col("bad")).alias("good")).collect()
    scratch.drop("statistics")
    if not cells:
        return DecisionList(())
    cells.sort()
    table = np.array([tuple(c) for c in cells], np.int64)
    return cover(table[:, 1:-2], table[:, -2].astype(float), table[:, -1].astype(float), table[:, 0], cuts, max_rules, max_conditions, min_precision)


def judge(docs: DataFrame, rules: DecisionList, text_column: str = "text") -> DataFrame:
    """The rows with base counts, base_failed, the number of the rule that rejects (or null) and kept. No shuffle, no Python.

    Null and empty texts have no words, so they fail the base rules. Equal texts have equal verdicts. Columns of the rows that are named like
    a new one give way to it.
    """
    judged = text_statistics(docs, text_column).select("q_row", *BASE_COUNTS, base_failed().alias("base_failed"), rules.rule().alias("rule"))
    new = [*BASE_COUNTS, "base_failed", "rule"]
    return judged.select(*(F.col(f"q_row.`{c}`").alias(c) for c in docs.columns if c.lower() not in (*new, "kept")), *new, (~F.col("base_failed") & F.col("rule").isNull()).alias("kept"))


def keep(docs: DataFrame, rules: DecisionList, text_column: str = "text") -> DataFrame:
    """The rows that the base rules and the learned ones keep, with their own columns only."""
    judged = text_statistics(docs, text_column).filter(~base_failed() & rules.rule().isNull())
    return judged.select(*(F.col(f"q_row.`{c}`").alias(c) for c in docs.columns))
