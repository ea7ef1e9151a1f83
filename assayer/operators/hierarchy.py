"""Assertions that support other assertions: scores rolled up from the leaves of such trees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.session import checkpointed

KEY = ["question_id", "assertion_id"]


def levels(tree: DataFrame, most: int = 64) -> DataFrame:
    """Rows (question_id, assertion_id, parent_id, value) with their depth; a root has none, and a parent that isn't in the tree is no parent.

    One join per level, each checkpointed. A row that no root leads to is in a cycle or deeper than ``most``: that is an error, not a lost row.
    """
    rows = tree.select(*KEY, "parent_id", "value")
    parents = rows.select("question_id", F.col("assertion_id").alias("parent_id"), F.lit(True).alias("known"))
    linked = rows.join(parents, ["question_id", "parent_id"], "left").withColumn("parent_id", F.when(F.col("known"), F.col("parent_id"))).drop("known")
    linked = checkpointed(linked.select(*KEY, "parent_id", "value"))
    level = checkpointed(linked.filter("parent_id is null").withColumn("depth", F.lit(0)))
    out, rest = level, checkpointed(linked.filter("parent_id is not null"))
    for depth in range(1, most + 1):
        if rest.isEmpty():
            return out
        above = level.select("question_id", F.col("assertion_id").alias("parent_id"))
        level = checkpointed(rest.join(above, ["question_id", "parent_id"], "left_semi").withColumn("depth", F.lit(depth)).select(*out.columns))
        if level.isEmpty():
            break
        rest = checkpointed(rest.join(level, KEY, "left_anti"))
        out = out.unionByName(level)
    if rest.isEmpty():
        return out
    wrong = F.raise_error(F.concat(F.lit("assertion in a cycle or too deep: "), F.col("question_id").cast("string"), F.lit("/"), F.col("assertion_id").cast("string")))
    return out.unionByName(rest.withColumn("depth", wrong.cast("int")))


def roll_up(tree: DataFrame, threshold: float = 0.5, most: int = 64) -> DataFrame:
    """(question_id, assertion_id, depth, own, score, children, support) of every assertion.

    tree: (question_id, assertion_id, parent_id, value), a row per assertion. A leaf's score is its own value. An assertion that others support has the mean of their
    scores; ``own`` keeps what it was judged itself, and ``support`` is the share of its children whose score reaches the threshold (null for leaves). Values
    that are null or NaN count as 0, as an assertion that couldn't be judged isn't held. Each level is one aggregation over the level below, from the
    deepest up, so a level's rows are all that any step holds.
    """
    rows = checkpointed(levels(tree, most).withColumn("own", F.coalesce(F.nanvl(F.col("value").cast("double"), F.lit(None)), F.lit(0.0))).drop("value"))
    deepest = rows.agg(F.max("depth")).first()[0]
    out, below = None, None
    for depth in range(deepest if deepest is not None else 0, -1, -1):
        here = rows.filter(F.col("depth") == depth)
        if below is None:
            done = here.select(*KEY, "parent_id", "depth", "own", F.col("own").alias("score"), F.lit(0).cast("long").alias("children"), F.lit(None).cast("double").alias("support"))
        else:
            from_below = below.groupBy("question_id", F.col("parent_id").alias("assertion_id")).agg(F.avg("score").alias("mean"), F.count(F.lit(1)).alias("n"), F.avg((F.col("score") >= threshold).cast("double")).alias("support"))
            done = here.join(from_below, KEY, "left").select(*KEY, "parent_id", "depth", "own", F.coalesce("mean", "own").alias("score"), F.coalesce("n", F.lit(0).cast("long")).alias("children"), "support")
        below = checkpointed(done)
        out = below if out is None else out.unionByName(below)
    return out.drop("parent_id")


def question_scores(rolled: DataFrame) -> DataFrame:
    """(question_id, score, own, assertions, roots): the mean of the roots' scores, and of their own values, by question."""
    root = F.col("depth") == 0
    return rolled.groupBy("question_id").agg(F.avg(F.when(root, F.col("score"))).alias("score"), F.avg(F.when(root, F.col("own"))).alias("own"), F.count(F.lit(1)).alias("assertions"), F.count_if(root).alias("roots"))


def paired(first: DataFrame, second: DataFrame) -> DataFrame:
    """(question_id, first, second): two systems' rolled-up scores of the questions that both answered, for the tests of ``significance``."""
    a, b = question_scores(first), question_scores(second)
    return a.select("question_id", F.col("score").alias("first")).join(b.select("question_id", F.col("score").alias("second")), "question_id")
