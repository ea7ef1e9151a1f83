"""Document fingerprints: bottom-k sketches of shingle hashes."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import shingles, shuffle_parts, small_batches, text_buffer


class Sketch:
    """The k smallest distinct shingle hashes of a document or of several; ``hashes`` is ascending.

    A sketch with fewer than k hashes holds all of them, so its answers are exact.
    """

    def __init__(self, hashes: np.ndarray, k: int):
        self.hashes, self.k = hashes, k

    @classmethod
    def of(cls, hashes: np.ndarray, k: int) -> Sketch:
        if len(hashes) > 4 * k:  # most hashes can't be among the smallest k distinct ones
            low = np.unique(np.partition(hashes, 2 * k)[: 2 * k])
            if len(low) >= k:
                return cls(low[:k], k)
        return cls(np.unique(hashes)[:k], k)

    @classmethod
    def parse(cls, text: str, k: int) -> Sketch:
        return cls(np.frombuffer(base64.b64decode(text), ">u8").astype(np.uint64), k)

    def __str__(self) -> str:
        return base64.b64encode(self.hashes.astype(">u8").tobytes()).decode()

    @classmethod
    def merge(cls, parts: Iterable[Sketch]) -> Sketch:
        """The sketch of the union; a sketch of parts of parts is the same."""
        parts = list(parts)
        k = min(p.k for p in parts)
        return cls(np.unique(np.concatenate([p.hashes for p in parts]))[:k], k)

    def distinct(self) -> float:
        """Distinct shingles: exact below k, else from the k-th smallest hash."""
        if len(self.hashes) < self.k:
            return float(len(self.hashes))
        return (self.k - 1) / ((float(self.hashes[-1]) + 1.0) / 2.0**64)

    def _shared(self, other: Sketch) -> tuple[int, int]:
        """Of the smallest k of the union: how many there are, and how many are of both."""
        both = np.concatenate([self.hashes, other.hashes])
        both.sort()
        twice = both[1:] == both[:-1]
        k, total = min(self.k, other.k), len(both) - int(np.count_nonzero(twice))
        if total <= k:
            return total, int(np.count_nonzero(twice))
        new = np.concatenate([[True], ~twice])
        last = both[np.flatnonzero(new)[k - 1]]
        return k, int(np.count_nonzero(twice & (both[1:] <= last)))

    def resemblance(self, other: Sketch) -> float:
        """Jaccard similarity; 1 for two empty sketches."""
        n, shared = self._shared(other)
        return shared / n if n else 1.0

    def containment(self, other: Sketch) -> float:
        """The share of this sketch's shingles that the other has; 1 if it has none."""
        own = self.distinct()
        if not own:
            return 1.0
        union = Sketch.merge([self, other]).distinct()
        return min(1.0, self.resemblance(other) * union / own)


def sketches(texts: pa.Array, k: int, width: int) -> list[Sketch]:
    data, offsets = text_buffer(texts)
    h, at = shingles(data, offsets, width)
    return [Sketch.of(h[a:b], k) for a, b in zip(at, at[1:])]


def _fingerprint(batches: Iterator[pa.RecordBatch], k: int, width: int) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches):
        found = sketches(batch.column(1), k, width)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([str(s) for s in found], pa.string()), pa.array([s.distinct() for s in found], pa.float64())], ["doc_id", "fingerprint", "distinct_shingles"])


def fingerprint(docs: DataFrame, k: int = 256, width: int = 5, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, fingerprint, distinct_shingles) of every row, without a shuffle. Null and empty texts have the empty fingerprint "" and 0 shingles."""
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return rows.mapInArrow(partial(_fingerprint, k=k, width=width), "doc_id long, fingerprint string, distinct_shingles double")


def _merge_parts(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by group: one row for each group."""
    group, held = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([group], pa.string()), pa.array([str(held)]), pa.array([held.distinct()])], ["group", "fingerprint", "distinct_shingles"])

    for batch in batches:
        for g, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            part = Sketch.parse(text, k)
            if held is not None and g == group:
                held = Sketch.merge([held, part])
            else:
                if held is not None:
                    yield row()
                group, held = g, part
    if held is not None:
        yield row()


def merge_fingerprints(prints: DataFrame, group_column: str, k: int = 256) -> DataFrame:
    """(group, fingerprint, distinct_shingles): one sketch for all rows of a group (null is a group too), merged within each partition before the shuffle."""
    merge, ddl = partial(_merge_parts, k=k), "group string, fingerprint string, distinct_shingles double"
    rows = prints.select(F.col(group_column).cast("string").alias("group"), "fingerprint")
    local = rows.sortWithinPartitions("group").mapInArrow(merge, ddl).select("group", "fingerprint")
    return local.repartition("group").sortWithinPartitions("group").mapInArrow(merge, ddl)


NULL_ID = np.iinfo(np.int64).min  # null ids go first


def _buckets(ids: pa.Array, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    plain = ids.fill_null(NULL_ID).to_numpy(zero_copy_only=False)
    return plain, np.searchsorted(bounds, plain, "left")


def _lowest(batches: Iterator[pa.RecordBatch], bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The smallest id of each bucket in this partition."""
    least: dict[int, int] = {}
    for batch in batches:
        plain, bucket = _buckets(batch.column(0), bounds)
        order = np.lexsort((plain, bucket))
        at, first = np.unique(bucket[order], return_index=True)
        for b, i in zip(at.tolist(), plain[order][first].tolist()):
            least[b] = min(i, least.get(b, i))
    yield pa.RecordBatch.from_arrays([pa.array(least.keys(), pa.int64()), pa.array(least.values(), pa.int64())], ["bucket", "doc_id"])


def _deal(batches: Iterator[pa.RecordBatch], bounds: np.ndarray, before: dict[int, int]) -> Iterator[pa.RecordBatch]:
    """Rows with their bucket; a row with the smallest id of a bucket also as lead of the bucket before."""
    names = ["bucket", "doc_id", "text", "lead"]
    for batch in batches:
        plain, bucket = _buckets(batch.column(0), bounds)
        yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), batch.column(0), batch.column(1), pa.array(np.zeros(len(plain), bool))], names)
        lead = [i for i, x in enumerate(plain.tolist()) if x in before]
        if lead:
            rows = batch.take(pa.array(lead))
            yield pa.RecordBatch.from_arrays([pa.array([before[int(plain[i])] for i in lead], pa.int64()), rows.column(0), rows.column(1), pa.array(np.ones(len(lead), bool))], names)


EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, distinct_shingles double, containment_edited double"


def _compare(batches: Iterator[pa.RecordBatch], k: int, width: int) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, doc_id, text, lead), sorted by bucket, lead, doc_id; a lead row only ends its bucket. Works on pairs of neighbours."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("distinct_shingles", pa.float64()), ("containment_edited", pa.float64())])
    held: tuple | None = None  # bucket, doc_id, text, lead, sketch
    for batch in small_batches(batches, most=2 << 20):
        bucket, ids, lead = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist()
        texts = [t or "" for t in batch.column(2).to_pylist()]
        rows = [*([held] if held else []), *zip(bucket, ids, texts, lead, sketches(batch.column(2), k, width))]
        pairs = [(a, b) for a, b in zip(rows, rows[1:]) if a[0] == b[0] and not a[3]]
        edited = []
        for a, b in pairs:
            half = len(a[2]) // 2
            edited.append(a[2][: len(a[2]) - half] + b[2][:half])
        prints = sketches(pa.array(edited, pa.large_string()), k, width)
        out = []
        for (a, b), text, s in zip(pairs, edited, prints):
            out.append((a[1], len(a[2]), hashlib.sha256(text.encode()).hexdigest(), str(a[4]), str(s), a[4].resemblance(s), a[4].resemblance(b[4]), a[4].distinct(), a[4].containment(s)))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*out)) or [()] * len(schema), schema)], schema=schema)
        held = rows[-1]


def compare_with_next(docs: DataFrame, k: int = 256, width: int = 5, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Fingerprints of every text, of the text whose last half is replaced by the start of the next document's, and their likeness.

    The next document is the one that follows by (doc_id, text), nulls first; the first follows the last. Ids are dealt into buckets of
    consecutive ids whose bounds are quantiles of the id column, so no task sorts the whole table; the first row of each bucket goes to
    the bucket before, too. A bucket's rows stream through Python. Null texts count as empty; repeated rows follow each other.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    parts = shuffle_parts(spark)
    many = 4 * parts  # several buckets a task even out what hashing deals unevenly
    cuts = rows.agg(F.percentile_approx("doc_id", [i / many for i in range(1, many)], F.lit(max(10_000, 10 * many)))).head()[0]
    bounds = np.unique(np.asarray(cuts or [], np.int64))
    lowest = rows.select("doc_id").mapInArrow(partial(_lowest, bounds=bounds), "bucket long, doc_id long").groupBy("bucket").agg(F.min("doc_id").alias("first"))
    firsts = sorted((r["bucket"], r["first"]) for r in lowest.collect())
    before = {first: firsts[i - 1][0] for i, (_, first) in enumerate(firsts)}
    dealt = rows.mapInArrow(partial(_deal, bounds=bounds, before=before), "bucket long, doc_id long, text string, lead boolean")
    ordered = dealt.repartition(parts, "bucket").sortWithinPartitions("bucket", "lead", "doc_id", "text")
    return ordered.mapInArrow(partial(_compare, k=k, width=width), EDITED)
