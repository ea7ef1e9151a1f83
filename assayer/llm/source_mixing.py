"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import Scratch

#: A Poisson mean up to this is inverted in one go; exp(-mean) of a larger one would lose its precision.
CHUNK = 200.0
#: Uniform numbers are multiples of 2**-UNIFORM_BITS, exact in a double.
UNIFORM_BITS = 52
#: Sources up to which their rates, some hundred numbers each, go to every executor; more are joined by a shuffle.
BROADCAST_SOURCES = 2000


def uniform(*parts: Column) -> Column:
    """A uniform number in (0, 1), not 0, seeded by the parts: the first 13 hexadecimal digits of their MD5."""
    seed = F.md5(F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("null")) for p in parts)))
    return (F.conv(F.substring(seed, 1, 13), 16, 10).cast("long").cast("double") + 0.5) / float(1 << UNIFORM_BITS)


def poisson_table(mean: Column) -> Column:
    """Cumulative probabilities of 0, 1, 2, ... up to far beyond what a 53-bit uniform number can reach; ``mean`` is at most CHUNK."""
    top = F.ceil(mean + 12 * F.sqrt(mean) + 40).cast("int")
    start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("c"), F.array(F.exp(-mean)).alias("all"))

    def step(a: Column, k: Column) -> Column:
        p = a["p"] * mean / k.cast("double")
        return F.struct(p.alias("p"), (a["c"] + p).alias("c"), F.concat(a["all"], F.array(a["c"] + p)).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), top), start, step, lambda a: a["all"])


def source_rates(docs: DataFrame, weights: DataFrame | None = None, temperature: float = 0.5, epochs: float = 1.0, source_column: str = "source", size: Column | None = None) -> DataFrame:
    """(source, docs, size, weight, rate): how often a document of each source shall come on average.

    The mixture has ``epochs`` times the size of the input. Weights come from ``weights`` (source, weight), where sources that aren't
    listed weigh nothing, or are the sources' sizes to the power of ``temperature``. ``size`` is what a row counts, 1 unless given.
    A null source is a source of its own; weights that are null or negative count as 0.
    """
    per_source = docs.groupBy(F.col(source_column).alias("source")).agg(F.count(F.lit(1)).alias("docs"), F.sum(size if size is not None else F.lit(1)).cast("double").alias("size"))
    if weights is None:
        rated = per_source.withColumn("weight", F.pow("size", F.lit(temperature)))
    else:
        given = weights.groupBy(F.col("source").alias("given")).agg(F.sum(F.greatest(F.coalesce(F.col("weight").cast("double"), F.lit(0.0)), F.lit(0.0))).alias("weight"))
        rated = per_source.join(given, F.col("source").eqNullSafe(F.col("given")), "left").drop("given").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    total = rated.agg(F.sum("size").alias("all_size"), F.sum("weight").alias("all_weight"))
    return rated.crossJoin(F.broadcast(total)).select(  # one row
        "source", "docs", "size", "weight", F.coalesce(F.try_divide(F.col("weight") * F.lit(epochs) * F.col("all_size"), F.col("all_weight") * F.col("size")), F.lit(0.0)).alias("rate")
    )


def mix(docs: DataFrame, weights: DataFrame | None = None, temperature: float = 0.5, epochs: float = 1.0, seed: int = 17, id_column: str = "doc_id", source_column: str = "source", size: Column | None = None, shuffle: bool = True) -> DataFrame:
    """Repeats every row as often as a Poisson number with its source's rate says, and shuffles all rows globally.

    Null and empty texts are rows like others, as long as their source has a size: where ``size`` adds up to 0, as with characters of a source
    whose texts are all null or empty, weight and rate are 0 and all rows of the source go. Null ids share one number; a null source is a source. Columns called mix_copy or mix_key give
    way to the new ones. An empty table gives none.

    The number is the inverse of the distribution at a uniform number seeded by (seed, id); means over CHUNK are sums of several. Rows with
    the same id come equally often. Adds mix_copy (from 1) and mix_key; rows are ordered by (mix_key, mix_copy), where mix_key is the MD5 of
    (seed, id, copy), so the order is the same whatever the partitions. Rates are written first and counted: up to BROADCAST_SOURCES of them go
    to every executor, so texts are shuffled once only; more are joined by a shuffle, in which Spark splits a hot source's rows.
    """
    table, rate = source_rates(docs, weights, temperature, epochs, source_column, size), F.col("rate")
    parts = F.ceil(rate / CHUNK).cast("int")
    table = table.filter(rate > 0).select(F.col("source").alias("mix_source"), parts.alias("mix_parts"), (rate / parts).alias("mix_mean")).withColumn("mix_table", poisson_table(F.col("mix_mean"))).drop("mix_mean")
    table = Scratch(docs.sparkSession, "mix").table(table, "rates")
    if table.count() <= BROADCAST_SOURCES:
        table = F.broadcast(table)
    name = F.coalesce(F.col("mix_id").cast("string"), F.lit("null"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("mix_row"), F.col(id_column).alias("mix_id"), F.col(source_column).alias("mix_of"))
    rows = rows.join(table, F.col("mix_of").eqNullSafe(F.col("mix_source")))

    def draw(u: Column) -> Column:
        return F.size(F.filter("mix_table", lambda c: c < u))

    rows = rows.withColumn("mix_u", uniform(F.lit(seed), F.col("mix_id"), F.lit(1)))
    several = F.aggregate(F.transform(F.sequence(F.lit(1), F.col("mix_parts")), lambda k: draw(uniform(F.lit(seed), F.col("mix_id"), k))), F.lit(0), lambda a, x: a + x)
    count = F.when(F.col("mix_parts") == 1, draw(F.col("mix_u"))).otherwise(several)
    rows = rows.withColumn("mix_count", count).filter("mix_count > 0").withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("mix_count"))))
    rows = rows.withColumn("mix_key", F.md5(F.concat_ws(":", F.lit(seed), name, F.lit("order"), F.col("mix_copy").cast("string"))))
    out = rows.select(*(F.col(f"mix_row.`{c}`").alias(c) for c in docs.columns if c.lower() not in ("mix_copy", "mix_key")), "mix_copy", "mix_key")
    return out.orderBy("mix_key", "mix_copy") if shuffle else out
