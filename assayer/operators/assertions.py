"""Assertions about questions, and answers to hold against them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assayer.functions.values import truthy
from assayer.sources.tables import exists


def assertion_rows(questions: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each assertion that says something. questions: (question_id, question_text, assertions: array of structs), and columns to ``keep``.

    The rank is the given one, or the position from 1 where none or 0 is given.
    """
    fields = {f.name for f in questions.schema["assertions"].dataType.elementType.fields}
    each = questions.select("question_id", "question_text", *keep, F.posexplode("assertions").alias("at", "a"))
    text = truthy(*(F.col(f"a.{n}") for n in ("statement", "assertion") if n in fields))
    rank = F.nullif(F.col("a.rank").try_cast("int"), F.lit(0)) if "rank" in fields else F.lit(None).cast("int")
    rest = [F.col(f"a.{n}").alias(n) for n in ("score", "reasoning", "source_count") if n in fields]
    return each.select("question_id", "question_text", *keep, text.alias("assertion"), F.coalesce(rank, F.col("at") + 1).alias("rank"), *rest).filter("assertion is not null")


def complete_answers(answers: DataFrame) -> DataFrame:
    """(question_id, question_text, answer) of rows that have all three."""
    pick = lambda *names: truthy(*(F.col(n) for n in names if n in answers.columns))
    out = answers.select(pick("question_id", "sample_id").alias("question_id"), pick("question_text", "question").alias("question_text"), pick("answer", "generated_answer").alias("answer"))
    return out.dropna()


def top_assertions(rows: DataFrame, k: int) -> DataFrame:
    """The k best-ranked of each question; Spark limits each partition before the shuffle."""
    place = F.row_number().over(Window.partitionBy("question_id").orderBy("rank", "assertion"))
    return rows.withColumn("place", place).filter(F.col("place") <= k).drop("place")


def to_judge(answers: DataFrame, assertions: DataFrame, trials: int = 1, k: int | None = None) -> DataFrame:
    """(question_id, answer, assertion, trial): what a judge is asked."""
    chosen = assertions if k is None else top_assertions(assertions, k)
    joined = answers.select("question_id", "answer").join(chosen.select("question_id", "assertion", "rank"), "question_id")
    return joined.withColumn("trial", F.explode(F.sequence(F.lit(1), F.lit(trials))))


def criteria_scores(answers: DataFrame, references: DataFrame, criteria: list[str], trials: int = 1) -> DataFrame:
    """(question_id, criteria, trial, answer, reference): every criterion and trial of every answer that has a reference."""
    joined = answers.join(references.select("question_id", F.col("answer").alias("reference")), "question_id")
    named = joined.withColumn("criteria", F.explode(F.array(*map(F.lit, criteria)))).withColumn("trial", F.explode(F.sequence(F.lit(1), F.lit(trials))))
    return named.select("question_id", "criteria", "trial", "answer", "reference")


def question_kind(mode):
    """Which kind of assertions a mode's questions take."""
    return F.when(mode == "global", "global").when(mode == "multi-hop", "linked").otherwise("local")


#: Files of an assertion run, each of which may be missing, and what their contents are called. Fixed values.
PREPARED = {"assertions": "questions", "assertions_stats": "stats", "assertion_sources": "sources", "map_assertions": "map_questions", "map_assertions_stats": "map_stats"}


def prepared(spark: SparkSession, folder: str) -> DataFrame:
    """(part, payload): the parts of an assertion run that are there, each as one JSON text."""
    found = [(part, f"{folder.rstrip('/')}/{name}.json") for name, part in PREPARED.items()]
    rows = [spark.read.text(path, wholetext=True).select(F.lit(part).alias("part"), F.to_json(F.parse_json("value")).alias("payload")) for part, path in found if exists(spark, path)]
    out = spark.createDataFrame([], "part string, payload string")
    for r in rows:
        out = out.unionByName(r)
    return out
