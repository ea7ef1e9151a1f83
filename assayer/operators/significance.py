"""Paired tests without normal approximation: exact sign tests, and a seeded Poisson bootstrap over questions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.operators.scores import corrected


def log_factorial(n: Column) -> Column:
    """ln n! by Stirling's series, moved up to where that is good to 1e-14: n! = (n + 8)! / ((n + 1) ... (n + 8))."""
    n = n.cast("double")
    x = n + 9.0
    series = 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, F.lit(5))) - 1 / (1680 * F.pow(x, F.lit(7)))
    return (x - 0.5) * F.ln(x) - x + 0.5 * math.log(2 * math.pi) + series - sum((F.ln(n + k) for k in range(1, 9)), F.lit(0.0))


def binomial_tail(n: Column, k: Column) -> Column:
    """P(X <= k) of n fair coins, for 2 k <= n: the term of k in logs, times the sum of the terms below it relative to it.

    Each relative term is the one above times i / (n - i + 1), and the terms 20 standard deviations down are below 1e-300, so a sum over about
    sqrt(n) of them is exact however large n is.
    """
    n, k = n.cast("long"), k.cast("long")
    term = log_factorial(n) - log_factorial(k) - log_factorial(n - k) - n * math.log(2.0)
    terms = F.least(k, F.ceil(20 * F.sqrt(n.cast("double"))) + 50)
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def add(s: Column, j: Column) -> Column:
        i = (k - j + 1).cast("double")
        t = s["term"] * i / (n - i + 1)
        return F.struct(t.alias("term"), (s["sum"] + t).alias("sum"))

    below = F.when(terms > 0, F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(terms, F.lit(1).cast("long"))), start, add, lambda s: s["sum"])).otherwise(1.0)
    return F.exp(term + F.ln(below))


def exact_sign_test(pairs: DataFrame, family: list[str], first: str, second: str) -> DataFrame:
    """(family, wins, losses, ties, p_value): the two-sided exact sign test of paired values; ties say nothing, and without any other pair p is 1.
    A pair with a null or NaN value is none."""
    a, b = F.col(first).cast("double"), F.col(second).cast("double")
    there = pairs.filter(a.isNotNull() & b.isNotNull() & ~F.isnan(a) & ~F.isnan(b))
    counted = there.groupBy(*family).agg(F.count_if(a > b).alias("wins"), F.count_if(a < b).alias("losses"), F.count_if(a == b).alias("ties"))
    n = F.col("wins") + F.col("losses")
    p = F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * binomial_tail(n, F.least("wins", "losses"))))
    return counted.withColumn("p_value", p)


def poisson_weight(*key: Column) -> Column:
    """How often a row counts in a replicate: a draw of the Poisson distribution with mean 1, decided by the MD5 of the key alone."""
    uniform = F.conv(F.substring(F.md5(F.concat_ws("|", *(k.cast("string") for k in key))), 1, 13), 16, 10).cast("long") / F.lit(float(16**13))
    steps, p, total = [], math.exp(-1.0), 0.0
    for k in range(18):
        total += p
        steps.append(total)
        p /= k + 1
    return sum((F.when(uniform >= s, 1).otherwise(0) for s in steps), F.lit(0))


def bootstrap(pairs: DataFrame, family: list[str], question: str, first: str, second: str, replicates: int = 200, seed: int = 42, level: float = 0.95) -> DataFrame:
    """(family, mean_difference, low, high, p_bootstrap, n_questions): the mean of first - second over all pairs, and how it varies if questions are drawn again.

    A question's pairs stay together, as their scores hang together. Each question's sum and count are taken first; each of the replicates weighs questions
    by ``poisson_weight`` of seed, replicate and question, so the draw doesn't depend on where a row lies, and is added up before the shuffle. low and high are the
    replicates' means at the level's two ends (nearest rank); p_bootstrap is twice the smaller share of them on either side of 0, zeros counting half.
    """
    a, b = F.col(first).cast("double"), F.col(second).cast("double")
    there = pairs.filter(a.isNotNull() & b.isNotNull() & ~F.isnan(a) & ~F.isnan(b))
    by_question = there.groupBy(*family, question).agg(F.sum(a - b).alias("d"), F.count(F.lit(1)).alias("n"))
    whole = by_question.groupBy(*family).agg((F.sum("d") / F.sum("n")).alias("mean_difference"), F.count(F.lit(1)).alias("n_questions"))
    drawn = by_question.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    drawn = drawn.withColumn("w", poisson_weight(F.lit(seed), F.col("replicate"), F.col(question))).filter("w > 0")
    means = drawn.groupBy(*family, "replicate").agg((F.sum(F.col("w") * F.col("d")) / F.sum(F.col("w") * F.col("n"))).alias("m"))
    spread = means.groupBy(*family).agg(F.sort_array(F.collect_list("m")).alias("ms"))
    rank = lambda q: F.greatest(F.ceil(F.round(F.size("ms") * F.lit(q), 9)).cast("int"), F.lit(1))
    side = lambda low: F.size(F.filter("ms", lambda m: m < 0 if low else m > 0)) + F.size(F.filter("ms", lambda m: m == 0)) / 2
    ends = spread.select(*family, F.element_at("ms", rank((1 - level) / 2)).alias("low"), F.element_at("ms", rank((1 + level) / 2)).alias("high"), F.least(F.lit(1.0), 2 * F.least(side(True), side(False)) / F.size("ms")).alias("p_bootstrap"))
    return whole.join(ends, family, "left")


def assertion_significance(pairs: DataFrame, family: str, question: str = "question_id", first: str = "first", second: str = "second", correction: str = "holm", replicates: int = 200, seed: int = 42) -> DataFrame:
    """Two systems' scores of the same assertions, by family: the exact sign test over assertions with its corrected p, and the bootstrap over questions.

    pairs: (family, question, first, second), a row per assertion. The correction is over all families, which are a short list.
    """
    tests = exact_sign_test(pairs, [family], first, second).withColumn("test", F.col(family).cast("string")).withColumn("all", F.lit(1))
    adjusted = corrected(tests, "all", correction).drop("test", "all")
    return adjusted.join(bootstrap(pairs, [family], question, first, second, replicates, seed), family, "left")
