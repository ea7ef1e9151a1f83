"""Keys that equal or begin with other keys, by one sorted sweep: no pairs of keys that merely begin alike are ever made."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.session import checkpointed

#: Keys are dealt into ranges by so many of their first characters, so that samples of them are small.
HEAD = 1024


class Sweep:
    """Distinct keys in ascending order. Those that are prefixes of the current one are a stack, so a key's prefixes are below it and all that begin with it come before it is popped."""

    def __init__(self, outer: list[tuple[str, tuple | None, bool]] | None = None):
        self.stack: list[list] = []  # [key, unit, whether it is asked for, least unit on the way down to here, least unit above]
        self.found: list[tuple[str, tuple]] = []
        for key, unit, asked in outer or []:
            self.push(key, unit, asked)
        self.outer = len(self.stack)

    def push(self, key: str, unit: tuple | None, asked: bool) -> None:
        way = self.stack[-1][3] if self.stack else None
        self.stack.append([key, unit, asked, _least(way, unit), None])

    def pop(self) -> None:
        key, unit, asked, way, above = self.stack.pop()
        if asked and (best := unit or _least(way, above)) is not None:  # an equal key counts before all that begin alike
            self.found.append((key, best))
        if self.stack:
            self.stack[-1][4] = _least(self.stack[-1][4], _least(unit, above))

    def add(self, key: str, unit: tuple | None, asked: bool) -> None:
        while self.stack and not key.startswith(self.stack[-1][0]):
            self.pop()
        self.outer = min(self.outer, len(self.stack))
        self.push(key, unit, asked)

    def open(self) -> list[tuple[int, tuple | None, bool]]:
        """What of this part is still a prefix of its last key, as lengths of that."""
        return [(len(key), unit, asked) for key, unit, asked, *_ in self.stack[self.outer :]]


def _least(a: tuple | None, b: tuple | None) -> tuple | None:
    return b if a is None else a if b is None else min(a, b)


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[str, tuple | None, bool]]:
    for key, pos, unit, asked in zip(*(batch.column(k).to_pylist() for k in range(4))):
        yield key, None if unit is None else (pos, unit), asked


def _pack(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Each batch as one compressed value; at the end one row with the part's first and last key and the entries that are open there."""
    sweep, first, last, part = Sweep(), None, None, TaskContext.get().partitionId()
    row = lambda *v: pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((part, *v), schema)], schema=schema)
    for batch in batches:
        for key, unit, asked in _rows(batch):
            first, last = key if first is None else first, key
            sweep.add(key, unit, asked)
            sweep.found.clear()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
            writer.write_batch(batch)
        yield row(None, None, None, sink.getvalue().to_pybytes())
    if last is not None:
        yield row(first, last, [{"size": n, "pos": u[0] if u else None, "unit": u[1] if u else None, "asked": c} for n, u, c in sweep.open()], None)


def _matches(batches: Iterator[pa.RecordBatch], outer: dict[int, list], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """(name, pos, unit) of each key that is asked for: the least unit that is a prefix of it or begins with it, as far as this part and what was open before it know."""
    sweep = Sweep(outer.get(TaskContext.get().partitionId()))

    def drain() -> pa.RecordBatch:
        out, sweep.found = sweep.found, []
        columns = [hashlib.sha256(k.encode()).hexdigest() for k, _ in out], [u[0] for _, u in out], [u[1] for _, u in out]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    for batch in batches:
        for packed in batch.column(batch.schema.get_field_index("packed")).to_pylist():
            for rows in pa.ipc.open_stream(packed) if packed is not None else ():
                for row in _rows(rows):
                    sweep.add(*row)
                yield drain()
    while sweep.stack:
        sweep.pop()
    yield drain()


def first_by_prefix(contexts: DataFrame, units: DataFrame) -> DataFrame:
    """(name, unit) of context keys that have one, named by the SHA-256 of the key: the least unit with the same key, else the least whose key begins with the context's or the other way.

    contexts: (key); units: (key, pos, unit_id). Keys are not empty; equal ones are one before they are sorted. All of them are sorted in ranges and swept once in each part, with a
    stack of the keys that the current one begins with; work and memory are linear, whatever beginning the keys share. Entries open at a part's end are
    handed to the parts that go on with them: that is one row of each part, with one key and the lengths of the entries that begin it. A context that goes on into several
    parts is found in each, and the least counts. Keys that share their first HEAD characters are in one part.
    """
    pos, unit = (units.schema[n].dataType for n in ("pos", "unit_id"))
    rows = units.select("key", F.struct("pos", "unit_id").alias("unit"), F.lit(False).alias("asked"))
    rows = rows.unionByName(contexts.select("key", F.lit(None).cast(rows.schema["unit"].dataType).alias("unit"), F.lit(True).alias("asked")))
    merged = rows.groupBy("key").agg(F.min("unit").alias("unit"), F.max("asked").alias("asked"))
    ranged = merged.repartitionByRange(F.left("key", F.lit(HEAD))).sortWithinPartitions("key").select("key", "unit.pos", "unit.unit_id", "asked")
    ddl = f"part int, first string, last string, held array<struct<size: int, pos: {pos.simpleString()}, unit: {unit.simpleString()}, asked: boolean>>, packed binary"
    out = f"name string, pos {pos.simpleString()}, unit {unit.simpleString()}"
    arrow = lambda text: _arrow(units, text)
    swept = checkpointed(ranged.mapInArrow(partial(_pack, schema=arrow(ddl)), ddl))
    outer: dict[int, list] = {}
    going: list[tuple[str, tuple | None, bool]] = []
    for part in sorted(swept.filter("last is not null").drop("packed").collect(), key=lambda r: r["part"]):  # one row of each part
        going = [e for e in going if part["first"].startswith(e[0])]
        outer[part["part"]] = going
        own = [(part["last"][: h["size"]], None if h["unit"] is None else (h["pos"], h["unit"]), h["asked"]) for h in part["held"]]
        going = [e for e in going if part["last"].startswith(e[0])] + own
    found = swept.mapInArrow(partial(_matches, outer=outer, schema=arrow(out)), out)
    return found.groupBy("name").agg(F.min(F.struct("pos", F.col("unit").alias("unit_id"))).alias("unit"))


def _arrow(df: DataFrame, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(df.sparkSession.createDataFrame([], ddl).schema)
