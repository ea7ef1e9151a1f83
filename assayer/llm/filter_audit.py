"""How filters of a corpus interact: what each removes in every order, what it removes alone, and what good or toxic text goes with it."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from functools import partial
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import SEPARATOR_CLASS, Scratch, release

STEPS = "array<struct<filter_order: string, step: int, bit: int, before: int>>"
MARKED = pa.schema([("border", pa.bool_()), ("fingerprint", pa.binary()), ("doc_id", pa.int64()), ("part", pa.string()), ("mask", pa.int32())])
MARKED_DDL = "border boolean, fingerprint binary, doc_id long, part string, mask int"


def conditions(text: Column) -> dict[str, Column]:
    """When a text fails each filter but the one of duplicates: few words, few distinct words, many capitals, odd characters."""
    words = F.array_remove(F.split(text, SEPARATOR_CLASS), "")
    n, distinct = F.size(words).cast("long"), F.size(F.array_distinct(words)).cast("long")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long")
    return {"A": n < 200, "B": 100 * distinct < 50 * n, "C": 100 * capitals > 2 * F.length(text), "D": text.rlike(r"[#$%&*|]")}


def _mark(batches: Iterator[pa.RecordBatch], bit: int) -> Iterator[pa.RecordBatch]:
    """Compares each row (fingerprint, text, doc_id, part, mask) with its predecessor; rows come sorted by the first three, null ids first.

    A row whose text began its run with a smaller id gets ``bit``. What comes before the partition isn't seen: rows of its first run that have the run's
    smallest id keep their fingerprint, to be settled by the border rows (fingerprint, first id) of the first and the last run of every partition.
    """
    last, first, head, borders = None, (False, 0), True, []
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        key, text, ids = batch.column(0), batch.column(1), batch.column(2)
        same = np.zeros(n, bool)
        same[0] = last is not None and key[0].equals(last[0]) and text[0].equals(last[1])
        same[1:] = pc.and_(pc.equal(key[1:], key[:-1]), pc.equal(text[1:], text[:-1])).to_numpy(zero_copy_only=False)
        has, value = pc.is_valid(ids).to_numpy(zero_copy_only=False), pc.fill_null(ids, 0).to_numpy(zero_copy_only=False)
        start = np.maximum.accumulate(np.where(same, -1, np.arange(n)))
        carried = start < 0
        first_has, first_value = np.where(carried, first[0], has[start]), np.where(carried, first[1], value[start])
        later = has & (~first_has | (value > first_value))
        fresh = np.flatnonzero(~same)
        in_head = np.zeros(n, bool)
        if head:  # the partition's first row starts its first run; the next start ends that
            starts = fresh[1:] if last is None else fresh
            end = int(starts[0]) if len(starts) else n
            in_head[:end] = True
            if len(starts):
                done = first if last is not None else (bool(has[0]), int(value[0]))
                borders.append(((last[0] if last is not None else key[0]).as_py(), done))
                head = False
        last, first = (key[n - 1], text[n - 1]), (bool(first_has[-1]), int(first_value[-1]))
        mask = batch.column(4).to_numpy(zero_copy_only=False) | np.where(later, bit, 0).astype(np.int32)
        open_ = pc.if_else(pa.array(in_head & ~later), key, pa.scalar(None, key.type))
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, bool)), open_.cast(pa.binary()), ids, batch.column(3), pa.array(mask, pa.int32())], schema=MARKED)
    if last is not None:
        borders.append((last[0].as_py(), first))
        rows = [[True] * len(borders), [k for k, _ in borders], [v if h else None for _, (h, v) in borders], [None] * len(borders), [None] * len(borders)]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, MARKED)], schema=MARKED)
    release()


def failure_masks(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", part_column: str = "source") -> tuple[DataFrame, int]:
    """(border, fingerprint, doc_id, part, mask) as ``_mark`` gives them, in a scratch table, and the bit of duplicates.

    Rows are range-partitioned by the text's SHA-256 and the id, so copies of one text lie in as many partitions as they need, and sorted by fingerprint, full
    text and id. Predecessors are compared by full text; only over the borders of partitions is the SHA-256 trusted.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"), F.coalesce(F.col(part_column).cast("string"), F.lit("")).alias("part"))
    rows = rows.withColumn("fingerprint", F.unhex(F.sha2("text", 256))).repartitionByRange("fingerprint", "doc_id").sortWithinPartitions("fingerprint", "text", "doc_id")
    failing = conditions(F.col("text"))
    mask = sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(failing.values())), F.lit(0))
    bit = 1 << len(failing)
    marked = rows.select("fingerprint", "text", "doc_id", "part", mask.cast("int").alias("mask")).mapInArrow(partial(_mark, bit=bit), MARKED_DDL)
    return Scratch(docs.sparkSession, "audit").table(marked, "masks"), bit


def counters(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", part_column: str = "source") -> DataFrame:
    """(part, n, good, toxic): for every part, arrays of counts by failure mask. Counters of parts add up to the counters of their union, duplicates
    being table-wide."""
    marked, bit = failure_masks(docs, id_column, text_column, part_column)
    seen = lambda c: F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0)))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").groupBy("doc_id").agg(seen("quality").alias("good"), seen("toxic").alias("toxic"))
    rows = marked.filter("not border").withColumn("held", F.when(F.col("fingerprint").isNotNull(), F.struct(F.col("doc_id").isNotNull().alias("has"), "doc_id")))
    one = rows.join(known, "doc_id", "left").groupBy("part", "mask", "fingerprint", "held").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    firsts = marked.filter("border").groupBy("fingerprint").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("has"), "doc_id")).alias("first"))
    later = F.col("held.has") & (~F.col("first.has") | (F.col("held.doc_id") > F.col("first.doc_id")))
    settled = one.join(firsts, "fingerprint", "left").withColumn("mask", F.when(later, F.col("mask").bitwiseOR(bit)).otherwise(F.col("mask")))
    by_mask = settled.groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic")))
    return by_mask.groupBy("part").agg(*(F.array(*(F.coalesce(F.sum(F.when(F.col("mask") == m, F.col(c))), F.lit(0)) for m in range(2 * bit))).alias(c) for c in ("n", "good", "toxic")))


def interactions(counted: DataFrame, letters: str = "ABCDE") -> DataFrame:
    """One row per part, order of the filters and step, from the counters of ``counters``.

    kept, removed, redundant (fails this filter, went before), unique_fails (fails this filter only), good_lost, toxic_lost (went here), and shapley: what the filter
    removes at its step, summed over all orders. A document that fails k filters goes by each of them in a k-th of the orders, so that needs no loop over orders.
    """
    bits = {c: 1 << k for k, c in enumerate(letters)}
    steps = [("".join(o), k + 1, bits[o[k]], sum(bits[c] for c in o[:k])) for o in permutations(letters) for k in range(len(letters))]
    listed = F.from_json(F.lit(json.dumps([dict(zip(("filter_order", "step", "bit", "before"), s)) for s in steps])), STEPS)
    rows = counted.select("part", "n", "good", "toxic", F.explode(listed).alias("s")).select("part", "n", "good", "toxic", "s.*")
    masks = F.sequence(F.lit(0), F.lit((1 << len(letters)) - 1))
    shares = F.array(*(F.lit(math.factorial(len(letters)) // k).cast("long") for k in range(1, len(letters) + 1)))
    bit, before = F.col("bit"), F.col("before")

    def total(of: str, wanted: Callable[[Column], Column], times: Callable[[Column], Column] | None = None) -> Column:
        value = (lambda m: F.get(F.col(of), m) * times(m)) if times else (lambda m: F.get(F.col(of), m))
        return F.aggregate(masks, F.lit(0).cast("long"), lambda held, m: held + F.when(wanted(m), value(m)).otherwise(0))

    fails, gone = lambda m: m.bitwiseAND(bit) != 0, lambda m: m.bitwiseAND(before) != 0
    here = lambda m: fails(m) & ~gone(m)
    return rows.select(
        "part", "filter_order", "step",
        total("n", lambda m: m.bitwiseAND(bit.bitwiseOR(before)) == 0).alias("kept"),
        total("n", here).alias("removed"),
        total("n", lambda m: fails(m) & gone(m)).alias("redundant"),
        F.get("n", bit).alias("unique_fails"),
        total("good", here).alias("good_lost"),
        total("toxic", here).alias("toxic_lost"),
        total("n", fails, lambda m: F.get(shares, F.bit_count(m) - 1)).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", part_column: str = "source") -> DataFrame:
    """What five filters do to each part in all 120 orders: ``interactions`` of ``counters``.

    A text fails A with fewer than 200 words, B if fewer than half of its words are distinct, C with more than two capitals in a hundred code points, D with any of
    ``#$%&*|``, E if a row with a smaller id has the same text. Null and empty texts are one text without words, which fails A. Null ids are smaller than any
    other and equal to each other; rows with the same id and text are no copies of each other. A null part is the empty string, and they count together. Labels of an id
    count once, as 1 if any row says so; ids that are null or not labelled are neither good nor toxic. An empty table has no part, so no rows.
    Very long texts are one row of an Arrow batch. Other columns, whatever their names, don't matter.
    """
    return interactions(counters(docs, labels, id_column, text_column, part_column))
