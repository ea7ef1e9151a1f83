"""Nearest neighbours of a stated list of queries: every row is met once, where it lies, in products of matrices."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows in one product.
BLOCK = 2048
#: Numbers of the vectors that a task holds at once, and queries that they meet together: what a task holds doesn't grow with the tables.
FLOATS, ASKED = 1 << 22, 1024
#: Similarities are told apart to so many digits, so the order of equal ones doesn't hang on the order of additions.
DIGITS = 9


class Best:
    """The k best rows of each query and group so far, by similarity and then the smaller id; never more than that and one block's candidates."""

    def __init__(self, queries: np.ndarray, k: int):
        self.queries, self.k = queries, k
        self.norms = np.linalg.norm(queries, axis=1)
        self.floor = np.full(len(queries), -np.inf)  # the k-th best similarity of each query, where it has k rows
        self.held: tuple[np.ndarray, ...] | None = None
        self.met = self.skipped = 0

    def add(self, ids: np.ndarray, rows: np.ndarray, groups: np.ndarray | None = None) -> None:
        """A block of rows. Queries that no row of the block can be near enough to are left out: their similarity to the block's centre, and its radius
        times their length, bound all that is in it."""
        self.met += len(ids) * len(self.queries)
        asked = np.arange(len(self.queries))
        if groups is None and np.isfinite(self.floor).any():
            centre = rows.mean(axis=0)
            radius = np.sqrt(np.max(np.sum((rows - centre) ** 2, axis=1)))
            asked = np.flatnonzero(self.queries @ centre + self.norms * radius >= self.floor - 10.0**-DIGITS)
            self.skipped += len(ids) * (len(self.queries) - len(asked))
        if not len(asked):
            return
        like = np.round(self.queries[asked] @ rows.T, DIGITS)
        floor = self.floor[asked]
        if groups is None and len(ids) > self.k:
            floor = np.maximum(floor, np.partition(like, len(ids) - self.k, axis=1)[:, len(ids) - self.k])
        q, r = np.nonzero(like >= floor[:, None])
        found = (asked[q], like[q, r], ids[r], groups[r] if groups is not None else np.zeros(len(r), np.int8))
        self.held = found if self.held is None else tuple(np.concatenate(x) for x in zip(self.held, found))
        self.keep()

    def keep(self) -> None:
        query, like, ids, groups = self.held
        order = np.lexsort((ids, -like, groups, query))
        query, like, ids, groups = query[order], like[order], ids[order], groups[order]
        new = np.ones(len(query), bool)
        new[1:] = (query[1:] != query[:-1]) | (groups[1:] != groups[:-1])
        place = np.arange(len(query)) - np.maximum.accumulate(np.where(new, np.arange(len(query)), 0))
        kept = place < self.k
        self.held = query[kept], like[kept], ids[kept], groups[kept]
        if groups.dtype == np.int8:  # one group: the k-th rows bound what may come
            last = kept & (place == self.k - 1)
            self.floor[query[last]] = like[last]


def _ids(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist()) if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else column.to_numpy(zero_copy_only=False)


def _segments(batches: Iterator[pa.RecordBatch], normalised: bool, grouped: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list]]:
    """Some rows at a time: ids, vectors, numbers of their groups, and the groups by number. Rows without a vector go."""
    held, floats = [], 0

    def segment() -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
        table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        rows = table.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(table.num_rows, -1)
        if not normalised:
            size = np.linalg.norm(rows, axis=1, keepdims=True)
            rows = np.divide(rows, size, out=np.zeros_like(rows), where=size > 0)
        if not grouped:
            return _ids(table.column(0)), rows, np.zeros(len(rows), np.int64), [None]
        named = table.column(2).dictionary_encode(null_encoding="encode")
        return _ids(table.column(0)), rows, named.indices.to_numpy(zero_copy_only=False), named.dictionary.to_pylist()

    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            part = part.filter(part.column(1).is_valid())
            if part.num_rows:
                held.append(part)
                floats += len(part.column(1).flatten())
            if floats >= FLOATS:
                yield segment()
                held, floats = [], 0
    if held:
        yield segment()


def _search(batches: Iterator[pa.RecordBatch], queries: np.ndarray, names: list, k: int, normalised: bool, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for ids, rows, groups, known in _segments(batches, normalised, len(schema) == 4):
        members = [np.flatnonzero(groups == g) for g in range(len(known))]
        for first in range(0, len(queries), ASKED):
            for own, group in zip(members, known):
                best = Best(queries[first : first + ASKED], k)
                for at in range(0, len(own), BLOCK):
                    best.add(ids[own[at : at + BLOCK]], rows[own[at : at + BLOCK]])
                if best.held is not None:
                    query, like, found, _ = best.held
                    columns = [[names[first + q] for q in query.tolist()], found.tolist(), like.tolist(), [group] * len(query)][: len(schema)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def best_of_parts(queries: DataFrame, rows: DataFrame, k: int, normalised: bool = True, group: str | None = None) -> DataFrame:
    """(query_id, row_id, similarity[, group]): of every partition of ``rows`` (row_id, vector[, group]), or of every FLOATS numbers of a larger one, the k rows most similar to each query, within each group if one
    is named. What is shuffled later is k rows for each query and partition, and no row stands for a pair of them.

    queries (query_id, vector) is a stated list that the caller has counted; it goes to every task as one matrix. Without ``normalised`` vectors are taken by their
    direction (cosine); a zero vector is like nothing. Rows and queries without a vector have no neighbours.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    asked = queries.filter("vector is not null").select("query_id", "vector").collect()
    matrix = np.array([r["vector"] for r in asked], np.float64).reshape(len(asked), -1)
    if not normalised and len(asked):
        size = np.linalg.norm(matrix, axis=1, keepdims=True)
        matrix = np.divide(matrix, size, out=np.zeros_like(matrix), where=size > 0)
    wanted = rows.select("row_id", "vector", *([group] if group else []))
    types = [("query_id", queries.schema["query_id"].dataType), ("row_id", rows.schema["row_id"].dataType), ("similarity", None), *([(group, rows.schema[group].dataType)] if group else [])]
    ddl = ", ".join(f"{n} {t.simpleString() if t else 'double'}" for n, t in types)
    schema = pa.schema([(n, to_arrow_type(t) if t else pa.float64()) for n, t in types])
    if not asked:
        return rows.sparkSession.createDataFrame([], ddl)
    return wanted.mapInArrow(partial(_search, queries=matrix, names=[r["query_id"] for r in asked], k=k, normalised=normalised, schema=schema), ddl)
