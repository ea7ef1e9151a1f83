"""What retrieval is held against: for every question and cluster, units that were assessed for relevance."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.functions.values import cosine
from assayer.functions.verdicts import rated
from assayer.model.plane import Judge, ask
from assayer.operators.nearest import best_of_parts
from assayer.operators.retrieval import centroids
from assayer.session import checkpointed

#: From (question_id, question_text, unit_id, unit_text) to (question_id, unit_id, score, reasoning).
Rater = Callable[[DataFrame], DataFrame]


def neighbours(questions: DataFrame, units: DataFrame, semantic: int = 10, central: int = 5) -> DataFrame:
    """(question_id, cluster_id, unit_id, semantic, central): for every question and cluster, the ranks of the cluster's units that are nearest to the question, and
    of those nearest to the cluster's centre; null where a unit is only one of them.

    questions: (query_id, vector), a stated list; units: (row_id, vector, cluster_id). Rows are met once, in products with the list; ids decide ties.
    """
    near = best_of_parts(questions, units, semantic, group="cluster_id")
    place = F.row_number().over(Window.partitionBy("query_id", "cluster_id").orderBy(F.desc("similarity"), "row_id"))
    near = checkpointed(near.withColumn("semantic", place).filter(F.col("semantic") <= semantic).select(F.col("query_id").alias("question_id"), "cluster_id", F.col("row_id").alias("unit_id"), "semantic"))
    centres = centroids(units).withColumnRenamed("vector", "centre")
    away = units.join(centres, "cluster_id").select("cluster_id", "row_id", F.round(cosine(F.col("vector"), F.col("centre")), 9).alias("like"))
    leader = F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("like"), "row_id"))  # Spark limits each partition first
    middle = away.withColumn("central", leader).filter(F.col("central") <= central).select("cluster_id", F.col("row_id").alias("unit_id"), "central")
    around = near.select("question_id", "cluster_id").distinct().join(middle, "cluster_id")
    return near.join(around, ["question_id", "cluster_id", "unit_id"], "full").select("question_id", "cluster_id", "unit_id", "semantic", "central")


def relevance_prompt(question: Column, text: Column) -> Column:
    return F.concat(
        F.lit("How relevant is the passage to the question? 0: not at all, 1: on the topic only, 2: answers a part, 3: answers it.\n\nQuestion:\n"),
        F.coalesce(question, F.lit("")),
        F.lit("\n\nPassage:\n"),
        F.coalesce(text, F.lit("")),
        F.lit('\n\nAnswer with a JSON object with the keys "reasoning" (short) and "score" (0 to 3).'),
    )


def judged(judge: Judge, cache: DataFrame | None = None, at_once: int = 16) -> Rater:
    """A rater by model: each distinct prompt is asked once, unless the cache (prompt_id, raw) knows it."""

    def rate(rows: DataFrame) -> DataFrame:
        asked = rows.select("question_id", "unit_id", relevance_prompt(F.col("question_text"), F.col("unit_text")).alias("prompt")).withColumn("prompt_id", F.sha2("prompt", 256))
        raw = checkpointed(ask(asked, judge, cache, at_once))
        return asked.drop("prompt").join(raw, "prompt_id").withColumn("r", rated(F.col("raw"), 0, 3)).select("question_id", "unit_id", "r.score", "r.reasoning")

    return rate


class OverlapJudge:
    """Rates a passage by the share of the question's words in it, in words; needs no network."""

    def answer(self, prompt: str) -> str:
        import re

        question, _, passage = prompt.partition("Question:\n")[2].partition("\n\nPassage:\n")
        words = lambda t: set(re.findall(r"\w+", t.lower()))
        asked, there = words(question), words(passage.partition("\n\nAnswer with")[0])
        share = len(asked & there) / len(asked) if asked else 0.0
        return f'{{"reasoning": "{share:.2f} of the words", "score": {min(3, int(share * 4))}}}'


def assess(found: DataFrame, questions: DataFrame, units: DataFrame, rater: Rater) -> DataFrame:
    """``found`` (see neighbours) with score and reasoning. A unit that is near to several clusters' questions is rated once for each question, not for each list.

    questions: (query_id, question_text); units: (row_id, text). Texts go to the pairs that are rated alone.
    """
    pairs = found.select("question_id", "unit_id").distinct()
    wide = pairs.join(questions.select(F.col("query_id").alias("question_id"), "question_text"), "question_id", "left").join(units.select(F.col("row_id").alias("unit_id"), F.col("text").alias("unit_text")), "unit_id", "left")
    scored = checkpointed(rater(wide).select("question_id", "unit_id", "score", "reasoning"))
    return found.join(scored, ["question_id", "unit_id"], "left")


def cluster_references(assessed: DataFrame, sizes: DataFrame) -> DataFrame:
    """One row for each question and cluster: cluster_size, num_assessments, num_overlapping_chunks (in both lists), and the lists themselves, semantic, centroid and all
    (first the nearest to the question, then the others nearest to the centre), each of (unit_id, score, reasoning). sizes: (cluster_id, cluster_size)."""
    one = F.struct(F.col("unit_id"), F.col("score"), F.col("reasoning"))
    ranked = F.collect_list(F.struct(F.coalesce("semantic", F.lit(1 << 30)).alias("s"), F.coalesce("central", F.lit(1 << 30)).alias("c"), one.alias("a")))
    nested = assessed.groupBy("question_id", "cluster_id").agg(ranked.alias("r"), F.count(F.lit(1)).alias("num_assessments"), F.count_if(F.col("semantic").isNotNull() & F.col("central").isNotNull()).alias("num_overlapping_chunks"))
    listed = lambda key: F.transform(F.array_sort(F.transform(F.filter("r", lambda x: x[key] < (1 << 30)), lambda x: F.struct(x[key].alias("k"), x["a"].alias("a")))), lambda x: x["a"])
    every = F.transform(F.array_sort("r"), lambda x: x["a"])
    out = nested.join(sizes, "cluster_id", "left")
    return out.select("question_id", "cluster_id", "cluster_size", "num_assessments", "num_overlapping_chunks", listed("s").alias("semantic_neighbor_assessments"), listed("c").alias("centroid_neighbor_assessments"), every.alias("all_assessments"))


def references(questions: DataFrame, units: DataFrame, rater: Rater, semantic: int = 10, central: int = 5) -> DataFrame:
    """(question_id, question_text, cluster_results): the whole reference, nested by question. questions: (query_id, question_text, vector); units: (row_id, text, vector, cluster_id)."""
    found = neighbours(questions, units, semantic, central)
    sizes = units.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("cluster_size"))
    return nest(questions, cluster_references(assess(found, questions, units, rater), sizes))


def nest(questions: DataFrame, flat: DataFrame) -> DataFrame:
    """(question_id, question_text, cluster_results) from the rows of ``cluster_references``."""
    rest = [c for c in flat.columns if c != "question_id"]
    nested = flat.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct(*rest))).alias("cluster_results"))
    return questions.select(F.col("query_id").alias("question_id"), "question_text").join(nested, "question_id", "left")
