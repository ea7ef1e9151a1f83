"""One summary of many texts: a tree of summaries under a token budget."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.functions.text import summary
from assayer.session import checkpointed

#: From (group, text) to (group, text): what makes each group's texts shorter.
Summariser = Callable[[DataFrame], DataFrame]

#: A token is a run of anything but white space; models' own tokens are more, so budgets leave room for that.
_TOKEN = r"\S+"


def count_tokens(text: Column) -> Column:
    return F.regexp_count(text, F.lit(_TOKEN))


def cut(text: Column, most: int) -> Column:
    """The text as an array of pieces of at most ``most`` tokens: itself where it is short enough, else its tokens with single blanks between them."""
    tokens = F.regexp_extract_all(text, F.lit(_TOKEN), 0)
    places = F.sequence(F.lit(0), F.floor((count_tokens(text) - 1) / most).cast("int"))
    return F.when(count_tokens(text) <= most, F.array(text)).otherwise(F.transform(places, lambda i: F.array_join(F.slice(tokens, i * most + 1, F.lit(most)), " ")))


def running_sums(rows: DataFrame, order: list[str], size: str) -> DataFrame:
    """Rows with ``before``: the sum of ``size`` over all rows that come earlier by ``order``, which tells all rows apart.

    Rows are range-partitioned and stay so: sums within a part, plus what the parts before it hold. Only one number of each part meets in one task.
    """
    ranged = checkpointed(rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    parts = ranged.groupBy("__part").agg(F.sum(size).alias("__all"))
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("__part", F.coalesce(F.sum("__all").over(earlier), F.lit(0)).alias("__offset"))
    inside = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = ranged.withColumn("__inside", F.coalesce(F.sum(size).over(inside), F.lit(0)))
    return summed.join(offsets, "__part").withColumn("before", F.col("__offset") + F.col("__inside")).drop("__part", "__offset", "__inside")


def budget_groups(texts: DataFrame, budget: int) -> DataFrame:
    """(pos, piece, text, tokens, group) of texts (pos, text), whose pos are all different: neighbours in groups of at most ``budget`` tokens.

    A text of more than half the budget is cut into pieces. A group is what begins in one half-budget stretch of all tokens, so it holds less than that
    and one piece more, and where a group begins doesn't depend on how rows are dealt out. Null texts and those without tokens are in none.
    """
    if budget < 2:
        raise ValueError("the budget must be two tokens or more")
    half = budget // 2
    there = texts.filter("text is not null")
    whole = there.select("pos", F.explode(F.array(count_tokens(F.col("text")).cast("long"))).alias("all")).filter("all > 0")  # sizes alone take part in the sums
    places = F.explode(F.sequence(F.lit(0), F.floor((F.col("all") - 1) / half).cast("int")))
    sized = whole.select("pos", "all", places.alias("piece")).select("pos", "piece", F.least(F.lit(half).cast("long"), F.col("all") - F.col("piece") * half).alias("tokens"))
    placed = running_sums(sized, ["pos", "piece"], "tokens").withColumn("group", F.floor(F.col("before") / half).cast("long")).drop("before")
    pieces = there.select("pos", F.posexplode(F.array(cut(F.col("text"), half))[0]).alias("piece", "text"))
    return pieces.join(placed, ["pos", "piece"]).select("pos", "piece", "text", "tokens", "group")


def joined(groups: DataFrame) -> DataFrame:
    """(group, text): each group's texts in order, with blank lines between them."""
    held = groups.groupBy("group").agg(F.array_sort(F.collect_list(F.struct("pos", "piece", "text"))).alias("t"))
    return held.select("group", F.array_join(F.transform("t", lambda x: x["text"]), "\n\n").alias("text"))


def first_sentences(n: int) -> Summariser:
    """A stand-in without a model: the first n sentences of each group's text."""
    return lambda groups: groups.select("group", summary(F.col("text"), n).alias("text"))


def map_reduce(texts: DataFrame, summarise: Summariser, budget: int = 8000, share: float = 0.25, most_levels: int = 64) -> DataFrame:
    """(summary, input_tokens, output_tokens, calls, levels): one text from all texts (pos, text); no row if none has a token.

    Level by level, neighbours are grouped under the budget and each group is summarised, in order, until what is left is one group, which is summarised last.
    A summary is cut to ``share`` of the budget, so a level halves what it reads at least (two summaries of a quarter each for every half) and a corpus
    of any size ends. Each level is checkpointed: a model is asked once for each group, and no task holds more than one budget and one summary.
    """
    if not 0 < share <= 0.25:
        raise ValueError("share must be above 0 and at most a quarter")
    limit = max(1, int(budget * share))
    spark, rows = texts.sparkSession, texts.select("pos", "text")
    first = rows.agg(F.sum(count_tokens(F.col("text"))).alias("n")).first()["n"] or 0
    calls, left, level = 0, first, 0
    while left:
        level += 1
        if level > most_levels:
            raise ValueError(f"{left} tokens are left after {most_levels} levels")
        # the last level's group is what one prompt holds, whole
        grouped = budget_groups(rows, budget) if left > budget else rows.filter("text is not null").select("pos", F.lit(0).alias("piece"), "text", F.lit(0).cast("long").alias("group"))
        made = checkpointed(summarise(joined(grouped)).select(F.col("group").alias("pos"), F.array(cut(F.coalesce("text", F.lit("")), limit))[0][0].alias("text")))
        counted = made.agg(F.count(F.lit(1)).alias("calls"), F.sum(count_tokens(F.col("text"))).alias("n")).first()
        calls += counted["calls"]
        if left <= budget:
            return made.select(F.col("text").alias("summary"), F.lit(first).cast("long").alias("input_tokens"), F.lit(counted["n"] or 0).cast("long").alias("output_tokens"), F.lit(calls).cast("long").alias("calls"), F.lit(level).alias("levels"))
        rows, left = made, counted["n"] or 0
    return spark.createDataFrame([], "summary string, input_tokens long, output_tokens long, calls long, levels int")
