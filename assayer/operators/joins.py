"""Lookups between samples, results, text units and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.functions.text import text_key
from assayer.functions.values import cosine, dot, truthy
from assayer.operators.nearest import best_of_parts
from assayer.operators.prefixes import first_by_prefix


def last_of(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The last row of each key by ``order``; combined before the shuffle, unlike a window."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("row")).select(*keys, "row.*")


def strict_lookup(samples: DataFrame, results: DataFrame, key: str, order: Column, strict: bool = True) -> DataFrame:
    """Every sample with its last result; extra results are ignored. ``strict``: a sample without one fails the query, and else it goes."""
    found = last_of(results, [key], order).withColumn("__found", F.lit(True))
    joined = samples.join(found, key, "left" if strict else "inner")
    if strict:
        wrong = F.raise_error(F.concat(F.lit(f"Missing search result for {key}="), F.col(key).cast("string")))
        joined = joined.filter(F.when(F.col("__found").isNull(), wrong.cast("boolean")).otherwise(True))
    return joined.drop("__found")


def missing(samples: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """Samples without a result."""
    return samples.join(results, key, "left_anti")


def fill_units(bridge: DataFrame, units: DataFrame) -> DataFrame:
    """(cluster_id, pos, unit_id) with the unit's text; an unknown unit has the empty text and its id as short id."""
    joined = bridge.join(units.select("unit_id", "text", "short_id"), "unit_id", "left")
    return joined.select("cluster_id", "pos", "unit_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("short_id", "unit_id").alias("short_id"))


def resolve_units(contexts: DataFrame, units: DataFrame) -> DataFrame:
    """(context_id, unit_id) of every context: the first unit with the same text key, else the first whose key starts with the context's or the other way.

    contexts: (context_id, text); units: (unit_id, pos, text). First is by pos. Keys meet in one sweep over all of them in order (``first_by_prefix``),
    which is linear whatever beginnings they share; what it finds meets the contexts by the key's SHA-256. Empty texts resolve to null; empty unit
    texts never match.
    """
    left = contexts.select("context_id", text_key(F.col("text")).alias("key"))
    keyed = units.select(text_key(F.col("text")).alias("key"), "pos", "unit_id").filter("key <> ''")
    found = first_by_prefix(left.select("key").filter("key <> ''"), keyed).select("name", F.col("unit.unit_id").alias("unit_id"))
    return left.select("context_id", F.sha2("key", 256).alias("name")).join(found, "name", "left").select("context_id", "unit_id")


def backfill_question_id(scores: DataFrame, questions: DataFrame) -> DataFrame:
    """Scores without a question id get that of the last question with their text, or an empty one. questions: (question_id, question, pos)."""
    by_text = questions.groupBy(F.col("question")).agg(F.max_by("question_id", "pos").alias("sample_id"))
    joined = scores.join(by_text, "question", "left")
    return joined.withColumn("question_id", truthy(F.col("question_id"), F.col("sample_id"), default="")).drop("sample_id")


#: Rows that a caller may list to meet every row.
MANY = 10_000


def every_pair(left: DataFrame, few: DataFrame) -> DataFrame:
    """Each row with each of a few rows that the caller lists, such as metrics or trials. More than MANY of them aren't a list, but an error."""
    if few.limit(MANY + 1).count() > MANY:
        raise ValueError(f"more than {MANY} rows would meet every row")
    return left.crossJoin(F.broadcast(few))


#: Queries that every executor can hold at once; more are dealt into blocks of about so many.
QUERIES_AT_ONCE = 4096


def nearest(queries: DataFrame, rows: DataFrame, k: int, normalised: bool = True) -> DataFrame:
    """(query_id, row_id, similarity, rank): the k rows most similar to each query's vector, ids deciding ties.

    queries: (query_id, vector), a stated set that is counted first. Up to QUERIES_AT_ONCE go to every executor as one matrix, so every row is
    read once where it is, in products of matrices. More are dealt into blocks, rows into chunks, and each block meets each chunk in a join of the two.
    Either way the best k of every partition are all that is shuffled then. Similarities are rounded to nine digits.
    """
    like = dot if normalised else cosine
    n = queries.count()
    if n <= QUERIES_AT_ONCE:
        scored = best_of_parts(queries, rows, k, normalised)
    else:
        blocks, chunks = -(-n // QUERIES_AT_ONCE), max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        place = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m)).cast("int")
        held = queries.groupBy(place("query_id", blocks).alias("block")).agg(F.collect_list(F.struct("query_id", "vector")).alias("qs")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
        spread = rows.select("row_id", "vector", place("row_id", chunks).alias("chunk"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
        met = spread.join(held, ["block", "chunk"])
        scored = met.select("row_id", "vector", F.explode("qs").alias("q")).select(F.col("q.query_id").alias("query_id"), "row_id", F.round(like(F.col("q.vector"), F.col("vector")), 9).alias("similarity"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "row_id"))  # Spark limits each partition first
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k)


def zip_by_position(left: DataFrame, right: DataFrame, fill: str, column: str) -> DataFrame:
    """Rows of equal ``pos`` side by side; past the end of the right, ``column`` is ``fill``."""
    return left.join(right, "pos", "left").withColumn(column, F.coalesce(column, F.lit(fill)))


def carry_over(current: DataFrame, previous: DataFrame, key: str, when: str) -> DataFrame:
    """Current rows and those previous ones that are gone; ``when`` (last success) stays where the current row has none."""
    return current.withColumnRenamed(when, "__now").join(previous.select(key, F.col(when).alias("__then")), key, "left").withColumn(when, F.coalesce("__now", "__then")).drop("__now", "__then").unionByName(previous.join(current, key, "left_anti"), allowMissingColumns=True)


def blocked(steps: DataFrame, dependencies: DataFrame, status: str = "status") -> DataFrame:
    """(step, blocker): steps with a failed dependency, and the first of those. dependencies: (step, dependency, ord)."""
    failed = steps.filter(F.col(status) == "failed").select(F.col("step").alias("dependency"))
    return dependencies.join(failed, "dependency").groupBy("step").agg(F.min_by("dependency", "ord").alias("blocker"))


def runnable(steps: DataFrame, dependencies: DataFrame, status: str = "status") -> DataFrame:
    return steps.join(blocked(steps, dependencies, status), "step", "left_anti")


def expected_steps(expected: DataFrame, records: DataFrame) -> DataFrame:
    """Every expected step (group, ord, step) with the status of its last record (step, pos, status), or "not run"."""
    last = records.groupBy("step").agg(F.max_by("status", "pos").alias("status"))
    return expected.join(last, "step", "left").withColumn("status", F.coalesce("status", F.lit("not run")))
