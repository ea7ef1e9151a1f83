"""Packing token streams into sequences of a fixed length: bounded-space online best fit."""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import partial
from itertools import chain
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import Scratch, small_batches

PIECE = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("part", pa.int64()), ("ids", pa.binary())])
DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, part long, ids binary"
SENTINEL = "\x01"


class WordTokenizer:
    """A tokenizer whose units between blanks don't depend on one another, with a bounded memory of the units seen.

    Only U+0020 and U+000A are taken as blanks; what else counts as white space is left to the tokenizer itself.
    """

    def __init__(self, path: str, most: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.mark = self.tokenizer.encode(SENTINEL, add_special_tokens=False).ids

    def learn(self, units: list[str]) -> None:
        plain = [u for u in units if SENTINEL not in u] if len(self.mark) == 1 else []
        for u in set(units).difference(plain):
            self.young[u] = np.asarray(self.tokenizer.encode(u, add_special_tokens=False).ids, "<u4").tobytes()
        lines = [plain[i : i + 500] for i in range(0, len(plain), 500)]
        for line, out in zip(lines, self.tokenizer.encode_batch_fast([f" {SENTINEL} ".join(x) for x in lines], add_special_tokens=False)):
            ids = np.asarray(out.ids, "<u4")
            cuts = np.flatnonzero(ids == self.mark[0])
            raw, ends = ids.tobytes(), [*(4 * cuts).tolist(), 4 * len(ids)]
            self.young.update(zip(line, (raw[a:b] for a, b in zip([0, *(4 * cuts + 4).tolist()], ends))))

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers; units new to the memory are tokenized together."""
        lists = [t.replace("\n", " ").split(" ") for t in texts]
        missing = []
        for u in set(chain.from_iterable(lists)).difference(self.young):
            if (known := self.old.get(u)) is None:
                missing.append(u)
            else:
                self.young[u] = known
        self.learn(missing)
        get = self.young.__getitem__
        for units in lists:
            yield b"".join(map(get, units))
        if len(self.young) > self.most:
            self.old, self.young = self.young, {}


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer_at(path: str) -> WordTokenizer:
    """One tokenizer for each worker process, kept between tasks."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


class Packer:
    """Best fit over a fixed number of open windows. A piece is (doc_id, start, doc_tokens, ids as bytes)."""

    def __init__(self, window: int, open_windows: int, first_id: int):
        self.window, self.most, self.next = window, open_windows, first_id
        self.free: list[tuple[int, int]] = []  # (free ids, slot), ascending
        self.slots: dict[int, list[tuple[Any, int, int, bytes]]] = {}
        self.made, self.rows = 0, []

    def emit(self, pieces: list[tuple[Any, int, int, bytes]], keep: bool = False, part: int = 0) -> None:
        at = 0
        for doc, start, total, ids in pieces:
            n = len(ids) // 4
            self.rows.append((doc, start, n, zlib.crc32(ids), total, self.next, at, part, ids if keep else None))
            at += n
        self.next += 1

    def add(self, doc: Any, start: int, total: int, ids: bytes) -> None:
        """Whole windows go out at once; the rest goes where it fits best. If it fits nowhere, it fills up the fullest window, which goes out."""
        size = 4 * self.window
        while len(ids) >= size:
            self.emit([(doc, start, total, ids[:size])])
            start, ids = start + self.window, ids[size:]
        while ids:
            n = len(ids) // 4
            k = bisect_left(self.free, (n, -1))
            if k < len(self.free):
                free, slot = self.free.pop(k)
                self.slots[slot].append((doc, start, total, ids))
                if free == n:
                    self.emit(self.slots.pop(slot))
                else:
                    insort(self.free, (free - n, slot))
                return
            if len(self.free) < self.most:
                self.made += 1
                self.slots[self.made] = [(doc, start, total, ids)]
                insort(self.free, (self.window - n, self.made))
                return
            free, slot = self.free.pop(0)
            self.emit([*self.slots.pop(slot), (doc, start, total, ids[: 4 * free])])
            start, ids = start + free, ids[4 * free :]

    def merge(self, part: int | None) -> None:
        """Pours the open windows into full ones. The rest, less than a window, is kept with its ids for ``part``, or cut at powers of two."""
        pieces = [x for _, slot in self.free for x in self.slots[slot]]
        self.free, self.slots = [], {}
        tail, have = [], 0
        for doc, start, total, ids in pieces:
            while ids:
                take = min(len(ids) // 4, self.window - have)
                tail.append((doc, start, total, ids[: 4 * take]))
                start, ids, have = start + take, ids[4 * take :], have + take
                if have == self.window:
                    self.emit(tail)
                    tail, have = [], 0
        if part is not None:
            if tail:
                self.emit(tail, keep=True, part=part)
            return
        while tail:
            want, out = 1 << (have.bit_length() - 1), []
            have -= want
            while want:
                doc, start, total, ids = tail.pop(0)
                take = min(len(ids) // 4, want)
                out.append((doc, start, total, ids[: 4 * take]))
                want -= take
                if ids[4 * take :]:
                    tail.insert(0, (doc, start + take, total, ids[4 * take :]))
            self.emit(out)

    def drain(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) or [()] * len(PIECE)
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, PIECE)], schema=PIECE)


def _pack_part(batches: Iterator[pa.RecordBatch], path: str, end_id: int, window: int, open_windows: int) -> Iterator[pa.RecordBatch]:
    tokenizer, part = tokenizer_at(path), TaskContext.get().partitionId()
    packer, end = Packer(window, open_windows, part << 32), np.asarray([end_id], "<u4").tobytes()
    for batch in small_batches(batches, most=1 << 20):
        for doc, ids in zip(batch.column(0).to_pylist(), tokenizer.encode([t or "" for t in batch.column(1).to_pylist()])):
            packer.add(doc, 0, len(ids) // 4 + 1, ids + end)
        if len(packer.rows) >= 20_000:
            yield packer.drain()
    packer.merge(part)
    yield packer.drain()


def _merge_rests(rows: pd.DataFrame, window: int, parts: int) -> pd.DataFrame:
    packer = Packer(window, 0, (1 << 62) + ((int(rows["part"].iloc[0]) // parts) << 20))
    rows = rows.sort_values(["sequence_id", "offset"], kind="stable")
    packer.slots[0] = [(None if pd.isna(d) else int(d), int(s), int(t), bytes(i)) for d, s, t, i in zip(rows["doc_id"], rows["start"], rows["doc_tokens"], rows["ids"])]
    packer.free = [(0, 0)]
    packer.merge(None)
    return packer.drain().to_pandas(integer_object_nulls=True)


def pack(docs: DataFrame, tokenizer_path: str, window: int = 4096, end_id: int = 2, open_windows: int = 32, merge_parts: int = 64, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Packs the ids of every text, each followed by ``end_id``, into sequences of ``window`` ids.

    Every partition keeps ``open_windows`` windows and fills them online by best fit; a piece that fits into none is cut to fill up the
    fullest, which goes out. At its end it pours what is open into full windows, and less than one window is left. The rests of each
    ``merge_parts`` partitions are merged in one more task; what is still left is cut at powers of two, so no sequence needs padding.
    Memory: the open windows and one batch. The first pass is written to the scratch folder, as rests and sequences must be of one run.

    Null texts count as empty: their only id is ``end_id``. Repeated rows are packed as often as they come. Null ids stay null.
    Returns a row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.
    """
    scratch = Scratch(docs.sparkSession, "pack")
    run = partial(_pack_part, path=tokenizer_path, end_id=end_id, window=window, open_windows=open_windows)
    pieces = scratch.table(docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(run, DDL), "pieces")
    rests = pieces.filter("ids is not null").groupBy(F.floor(F.col("part") / merge_parts).alias("merge")).applyInPandas(lambda rows: _merge_rests(rows, window, merge_parts), DDL)
    return pieces.filter("ids is null").unionByName(rests).drop("part", "ids")
