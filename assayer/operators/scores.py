"""Aggregates over tidy scores (sample_id, metric_name, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tidy(labels: DataFrame, id_column: str, metrics: list[str]) -> DataFrame:
    """One row for each id and metric column."""
    return labels.unpivot(id_column, metrics, "metric_name", "value").withColumn("value", F.col("value").cast("double"))


def by_metric(scores: DataFrame) -> DataFrame:
    return scores.groupBy("metric_name").agg(F.avg("value").alias("mean_value"), F.count("value").alias("n"))


def accuracy(scores: DataFrame, metric: str) -> DataFrame:
    """Share of ones, as number and text."""
    mean = F.avg("value")
    return scores.filter(F.col("metric_name") == metric).agg(mean.alias("accuracy"), F.concat(F.format_string("%.2f", 100 * mean), F.lit("%")).alias("accuracy_text"), F.count("value").alias("n"))


def grouping_sets(scores: DataFrame, sets: list[list[str]], aggregates: list[Column]) -> DataFrame:
    """Several grains in one pass."""
    columns = list(dict.fromkeys(c for s in sets for c in s))
    return scores.groupingSets([[F.col(c) for c in s] for s in sets], *columns).agg(*aggregates)


def assertion_summary(scores: DataFrame) -> DataFrame:
    """Mean and count by question and assertion, by question, and overall. scores: (question_id, assertion, value).

    The finest grain is aggregated once, and the others from its sums and counts: rows are shuffled at one grain, not at three, and all levels read that one shuffle.
    """
    parts = [F.sum("s").alias("s"), F.sum("v").alias("v"), F.sum("n").alias("n")]
    finest = scores.groupBy("question_id", "assertion").agg(F.sum("value").alias("s"), F.count("value").alias("v"), F.count(F.lit(1)).alias("n"))
    by_question = finest.groupBy("question_id").agg(*parts)
    overall = by_question.agg(*parts).filter("n is not null")
    named = [finest.withColumn("level", F.lit("assertion"))]
    named.append(by_question.withColumn("assertion", F.lit(None).cast(scores.schema["assertion"].dataType)).withColumn("level", F.lit("question")))
    named.append(overall.withColumn("question_id", F.lit(None).cast(scores.schema["question_id"].dataType)).withColumn("assertion", F.lit(None).cast(scores.schema["assertion"].dataType)).withColumn("level", F.lit("overall")))
    out = [t.select("question_id", "assertion", "level", F.try_divide(F.col("s").cast("double"), F.col("v")).alias("mean_value"), "n") for t in named]
    return out[0].unionByName(out[1]).unionByName(out[2])


def claim_coverage(questions: DataFrame) -> DataFrame:
    """questions: (claim_count, assertion_count)."""
    return questions.agg(
        F.coalesce(F.sum("claim_count"), F.lit(0)).alias("claims"), F.coalesce(F.sum("assertion_count"), F.lit(0)).alias("assertions"), F.count_if(F.col("assertion_count") > 0).alias("valid_questions"), F.count(F.lit(1)).alias("questions")
    )


def top_metric(aggregate: DataFrame) -> DataFrame:
    """The metric with the largest mean, the first by name of equals, and the largest value for scales (1 if there is none)."""
    best = F.min_by("metric_name", F.struct(-F.col("mean_value"), "metric_name"))
    return aggregate.agg(best.alias("top_metric"), F.coalesce(F.max("mean_value"), F.lit(1.0)).alias("scale_max"))


def tally(runs: DataFrame, exit_code: str = "exit_code") -> DataFrame:
    """Passed and failed; an exit code that is no number counts as failed, and as unknown."""
    code = F.col(exit_code).cast("string").try_cast("int")
    return runs.agg(F.count_if(code == 0).alias("passed"), F.count_if(code.isNull() | (code != 0)).alias("failed"), F.count_if(code.isNull()).alias("unknown"), F.count(F.lit(1)).alias("total"))


def holm(tests: DataFrame, family: str, p_value: str = "p_value", name: str = "test") -> DataFrame:
    """Holm's step-down correction within each family, which is a short list of tests."""
    w = Window.partitionBy(family).orderBy(p_value, name)
    m = F.count(F.lit(1)).over(Window.partitionBy(family))
    step = F.least(F.lit(1.0), F.col(p_value) * (m - F.row_number().over(w) + 1))
    return tests.withColumn("step", step).withColumn("p_adjusted", F.max("step").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("step")


def corrected(tests: DataFrame, family: str, correction: str = "holm") -> DataFrame:
    """Tests (test, p_value) with p_adjusted within each family, by the correction's name."""
    if correction == "holm":
        return holm(tests, family)
    if correction == "bonferroni":
        return tests.withColumn("p_adjusted", F.least(F.lit(1.0), F.col("p_value") * F.count(F.lit(1)).over(Window.partitionBy(family))))
    if correction == "none":
        return tests.withColumn("p_adjusted", F.col("p_value"))
    raise ValueError(f"unknown correction: {correction}")


def sign_test(pairs: DataFrame, name: str | list[str], first: str, second: str) -> DataFrame:
    """Two-sided sign test of paired values, ours where a published one is unknown: normal approximation with continuity correction."""
    counted = pairs.groupBy(name).agg(F.count_if(F.col(first) > F.col(second)).alias("wins"), F.count_if(F.col(first) < F.col(second)).alias("losses"))
    n = F.col("wins") + F.col("losses")
    z = F.try_divide(F.greatest(F.abs(F.col("wins") - F.col("losses")) - 1, F.lit(0)), F.sqrt(n))
    # the tail of the normal distribution by a rational approximation of the error function, good to 1.5e-7
    t = 1 / (1 + 0.3275911 * z / F.sqrt(F.lit(2.0)))
    tail = (((((1.061405429 * t - 1.453152027) * t) + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * F.exp(-z * z / 2)
    return counted.withColumn("p_value", F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), tail)))


def win_rate(pairs: DataFrame, name: str, first: str, second: str) -> DataFrame:
    """How often the first value is larger; ties count half."""
    return pairs.groupBy(name).agg(F.avg(F.when(F.col(first) > F.col(second), 1.0).when(F.col(first) == F.col(second), 0.5).otherwise(0.0)).alias("win_rate"), F.count(F.lit(1)).alias("n"))


def alerts(counts: DataFrame) -> DataFrame:
    """counts: one row (total_assertions, valid_assertions, scores, retrieval_rows); a row for each thing that is missing."""
    checks = [("total_assertions", "no assertions were made"), ("valid_assertions", "no question has assertions"), ("scores", "no scores were made"), ("retrieval_rows", "no retrieval results were made")]
    found = F.filter(F.array(*(F.when(F.coalesce(F.col(c), F.lit(0)) == 0, F.struct(F.lit(c).alias("check"), F.lit(text).alias("alert"))) for c, text in checks)), lambda x: x.isNotNull())
    return counts.select(F.explode(found).alias("a")).select("a.*")
