"""Expressions over numbers, arrays and maps."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def truthy(*texts: Column, default: str | None = None) -> Column:
    """The first text that is neither null nor empty."""
    found = [F.nullif(t.cast("string"), F.lit("")) for t in texts]
    return F.coalesce(*found, *([F.lit(default)] if default is not None else [F.lit(None).cast("string")]))


def id_list(ids: Column) -> Column:
    """Texts without nulls and empty ones; null counts as no ids."""
    return F.coalesce(F.filter(F.transform(ids, lambda x: x.cast("string")), lambda x: x.isNotNull() & (x != "")), F.array().cast("array<string>"))


def merge_maps(*maps: Column) -> Column:
    """One map; for a key of several, the last map counts. Null maps count as empty."""
    empty = F.create_map().cast("map<string,string>")
    merged = F.coalesce(maps[0], empty)
    for later in (F.coalesce(m, empty) for m in maps[1:]):
        merged = F.map_concat(_without(merged, later), later)
    return merged


def _without(earlier: Column, later: Column) -> Column:
    return F.map_filter(earlier, lambda k, _: ~F.map_contains_key(later, k))


def drop_nulls(values: Column) -> Column:
    """The map without entries that are null."""
    return F.map_filter(values, lambda _, v: v.isNotNull())


#: Words that say yes or no in a verdict. Fixed values.
YES = ("1", "true", "yes", "y", "correct", "pass")
NO = ("0", "false", "no", "n", "incorrect", "fail")


def binary_text(text: Column) -> Column:
    """1.0 for a word that says yes or a number of at least a half; else 0.0, also for no number at all."""
    word = F.lower(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""))
    number = word.try_cast("double")
    return F.when(word.isin(*YES), 1.0).when(word.isin(*NO), 0.0).otherwise(binary_number(number))


def binary_number(value: Column) -> Column:
    """1.0 for at least a half, else 0.0; not a number and null are 0.0."""
    return F.when(value.isNotNull() & ~F.isnan(value) & (value >= 0.5), 1.0).otherwise(0.0)


def bbox(values: Column) -> Column:
    """Four numbers, or null."""
    numbers = F.transform(values, lambda x: x.try_cast("double"))
    return F.when((F.size(numbers) == 4) & F.forall(numbers, lambda x: x.isNotNull()), numbers)


def assertion_score(score: Column) -> Column:
    """A score from 1 to 10; one above 10 counts as per cent, halves up."""
    return F.when(score > 10, F.greatest(F.lit(1.0), F.least(F.lit(10.0), F.round(score / 10)))).otherwise(score)


def clamp(value: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(value, high))


def cluster_count(target: int, rows: int) -> int:
    """As many clusters as asked for, but one at least and no more than rows."""
    return max(1, min(target, rows or 1))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is zero."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def unit(a: Column) -> Column:
    """The vector at length 1; a zero vector stays."""
    return F.transform(a, lambda x: F.coalesce(F.try_divide(x.cast("double"), norm(a)), F.lit(0.0)))


def embedding_prefix(model: str, text: Column, query: bool) -> Column:
    """Text as models of the E5 family want it."""
    return F.concat(F.lit("query: " if query else "passage: "), text) if "e5" in model.lower() else text


#: Names of the two divergences. Fixed values.
FIDELITY: Mapping[str, str] = {"js": "js", "jensen-shannon": "js", "jensen_shannon": "js", "tvd": "tvd", "total-variation": "tvd", "total_variation": "tvd"}


def divergence(metric: str, p: Column, q: Column) -> Column:
    """Between two distributions, as arrays over the same outcomes: Jensen-Shannon in bits, or total variation."""
    kind = FIDELITY.get(metric.strip().lower())
    if kind is None:
        raise ValueError(f"unknown fidelity metric: {metric}")
    if kind == "tvd":
        return F.aggregate(F.zip_with(p, q, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x) / 2

    def part(x: Column, y: Column) -> Column:
        return F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(0.0)

    return F.aggregate(F.zip_with(p, q, lambda x, y: (part(x, y) + part(y, x)) / 2), F.lit(0.0), lambda s, x: s + x)


def average_precision(useful: Column) -> Column:
    """Of an array of 0 and 1 in the order of ranks: the mean of the precision at each useful rank; 0 where none is useful, null for no ranks."""
    start = F.struct(F.lit(0.0).alias("rank"), F.lit(0.0).alias("hits"), F.lit(0.0).alias("sum"))

    def add(s: Column, v: Column) -> Column:
        rank, hit = s["rank"] + 1, F.coalesce((v >= 0.5).cast("double"), F.lit(0.0))
        hits = s["hits"] + hit
        return F.struct(rank.alias("rank"), hits.alias("hits"), (s["sum"] + hit * hits / rank).alias("sum"))

    return F.when(F.size(useful) > 0, F.aggregate(useful, start, add, lambda s: F.coalesce(F.try_divide(s["sum"], s["hits"]), F.lit(0.0))))


def coverage(expected: Column, found: Column) -> Column:
    """The share of the expected ids that were found; 1 where none is expected."""
    wanted = F.array_distinct(expected)
    return F.when(F.coalesce(F.size(wanted), F.lit(0)) == 0, 1.0).otherwise(F.size(F.array_intersect(wanted, F.coalesce(found, F.array().cast("array<string>")))) / F.size(wanted))
