"""Alignment of two tokenizers over the same bytes: groups of tokens that end together, and links of tokens that overlap."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache, partial
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayer.llm.common import Scratch, release, shuffle_parts, small_batches

#: Characters that are surely no white space.
_SOLID = "[^\\s\\u180e\\u200b\\ufeff]"
#: Before a single blank or line end between two of those either tokenizer starts anew, so what lies between is a unit of its own.
_CUT = re.compile(f"(?<={_SOLID})(?=[ \n]{_SOLID})")
#: A unit between two such places, and not the first or last of its text with more white space at its edge.
_SAFE = re.compile(f" {_SOLID}(.*{_SOLID})?\\Z", re.DOTALL)
_FIRST, _SECOND = itemgetter(0), itemgetter(1)
#: Labels of bytes: nothing ends here, a token of A, one of B, one of both. A group goes up to each byte where both end.
_NONE, _A, _B, _BOTH = range(4)
_GROUP = re.compile(rb"[^\x03]*\x03")


def _byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others, in order, as U+0100 and up."""
    plain = {b for a, z in (("!", "~"), ("¡", "¬"), ("®", "ÿ")) for b in range(ord(a), ord(z) + 1)}
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Aligner:
    """Two tokenizers with a bounded memory of units between blanks, and what the group strings are made of."""

    def __init__(self, byte_level: str, pieces: str, most: int = 200_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_level)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        chars, vocabulary = _byte_of_char(), self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = b"".join(bytes([chars[c]]) if c in chars else c.encode() for c in token)
        kinds = [(i, self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in kinds]
        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        # a token's text in a group string, with what follows it inside its list and at the list's end
        self.written = [f"{i}{end}".encode() for ids, ends in ((len(self.a_bytes), ",|"), (len(self.b_bytes), ",;")) for i in range(ids) for end in ends]
        self.units_apart = not any(re.search("[^▁]▁|\n", p) for _, p in kinds)
        self.most, self.young, self.old = most, {}, {}
        self.odd: set[str] = set()  # units whose bytes under A or B aren't those of blank and unit

    def learn_one(self, unit: str) -> None:
        """Ids of a unit, of B without the blank that it adds: this stands before a line end, which it never joins."""
        a, b = self.a.encode(unit, add_special_tokens=False).ids, self.b.encode(unit.removeprefix(" "))
        b = b if unit[0] == " " else b[1:]
        self.young[unit] = (np.array(a, "<u4").tobytes(), np.array(b, "<u4").tobytes())
        if any(b"".join([table[i] for i in ids]) != unit.encode() for ids, table in ((a, self.a_bytes), (b, self.b_bytes))):
            self.odd.add(unit)

    def learn(self, units: list[str]) -> None:
        """Units that begin with a blank and hold solid characters at their edges are encoded many at a time and told apart by their bytes."""
        plain = [u for u in units if "▁" not in u and _SAFE.match(u)] if self.units_apart else []
        joined = ["".join(plain[i : i + 200]) for i in range(0, len(plain), 200)]
        a = np.array([i for e in self.a.encode_batch_fast(joined, add_special_tokens=False) for i in e.ids], "<u4")
        b = np.array([i for ids in self.b.encode([x[1:] for x in joined], num_threads=1) for i in ids], "<u4")
        raw, ends = "".join(joined).encode(), np.cumsum([len(u.encode()) for u in plain], dtype=np.int64)
        if all(b"".join(map(table.__getitem__, ids.tolist())) == raw for ids, table in ((a, self.a_bytes), (b, self.b_bytes))):
            cuts = []
            for ids, sizes in ((a, self.a_size), (b, self.b_size)):
                at, held = [0, *(4 * np.searchsorted(np.cumsum(sizes[ids]), ends) + 4).tolist()], ids.tobytes()
                cuts.append([held[x:y] for x, y in zip(at, at[1:])])
            self.young.update(zip(plain, zip(*cuts)))
        for u in units:
            if u not in self.young:
                self.learn_one(u)

    def encode(self, texts: list[str]) -> Iterator[tuple[bytes, bytes]]:
        """Ids of A and of B as little-endian 32-bit numbers for each text; none where the bytes of either differ from blank and text."""
        lists = [(_CUT.split(" " + t) if self.units_apart else [" " + t]) if t else [] for t in texts]
        missing = []
        for u in set().union(*lists).difference(self.young):
            if (known := self.old.get(u)) is None:
                missing.append(u)
            else:
                self.young[u] = known
        if missing:
            self.learn(missing)
        get = self.young.__getitem__
        for text, units in zip(texts, lists):
            held = list(map(get, units))
            a, b = b"".join(map(_FIRST, held)), b"".join(map(_SECOND, held))
            if self.odd and not self.odd.isdisjoint(units):
                raw = (" " + text).encode()
                if any(b"".join([table[i] for i in np.frombuffer(ids, "<u4").tolist()]) != raw for ids, table in ((a, self.a_bytes), (b, self.b_bytes))):
                    a = b = b""
            yield a, b
        if len(self.young) > self.most:
            self.old, self.young = self.young, {}
            self.odd &= self.old.keys()


@lru_cache(2)
def aligner_at(byte_level: str, pieces: str) -> Aligner:
    """One pair of tokenizers for each worker process, kept between tasks."""
    return Aligner(byte_level, pieces)


class Aligned:
    """The alignment of a batch of texts; offsets ``a_at``, ``b_at``, ``group_at``, ``link_at`` tell texts apart."""

    def __init__(self, aligner: Aligner, texts: list[str]):
        ids = list(aligner.encode(texts))
        self.aligner, n = aligner, len(texts)
        starts = lambda sizes: np.concatenate([[0], np.cumsum(np.fromiter(sizes, np.int64, n))])
        self.a, self.b = (np.frombuffer(b"".join([x[k] for x in ids]), "<u4") for k in (0, 1))
        self.a_at, self.b_at = (starts(len(x[k]) // 4 for x in ids) for k in (0, 1))
        a_end, b_end = np.cumsum(aligner.a_size[self.a]), np.cumsum(aligner.b_size[self.b])
        label = np.zeros(int(a_end[-1]) if len(a_end) else 0, np.uint8)
        label[a_end - 1] = _A
        label[b_end - 1] += _B
        # every text ends where both end, so the groups of all texts are found in one scan
        self.end = np.cumsum(np.fromiter(map(len, _GROUP.findall(label.tobytes())), np.int64))
        a_seen, b_seen = np.cumsum(label & 1, dtype=np.int64), np.cumsum(label >> 1, dtype=np.int64)
        self.a_count, self.b_count = (np.diff(seen[self.end - 1], prepend=0) for seen in (a_seen, b_seen))
        to = np.concatenate([[0], a_end])[self.a_at]
        self.group_at = np.searchsorted(self.end, to, "right")
        place = np.flatnonzero(label)
        self.link_at = np.searchsorted(place, to)
        here = label[place]
        self.pair = self.a[a_seen[place] - (here & 1)].astype(np.uint64) << np.uint64(32) | self.b[b_seen[place] - (here >> 1)]

    def group_strings(self) -> Iterator[bytes]:
        """``a1,a2|b1;a3|b2,b3`` for each text: the ids of A and of B in each group."""
        a_last, b_last = np.cumsum(self.a_count), np.cumsum(self.b_count)
        code = np.empty(len(self.a) + len(self.b), np.int64)
        code[np.arange(len(self.a)) + np.repeat(b_last - self.b_count, self.a_count)] = 2 * self.a.astype(np.int64)
        code[np.arange(len(self.b)) + np.repeat(a_last, self.b_count)] = 2 * (self.b.astype(np.int64) + len(self.aligner.a_bytes))
        code[a_last - 1 + b_last - self.b_count] += 1
        code[b_last - 1 + a_last] += 1
        get, at = self.aligner.written.__getitem__, (self.a_at + self.b_at).tolist()
        for x, y in zip(at, at[1:]):
            yield b"".join(map(get, code[x:y].tolist()))[:-1]


# ---------------------------------------------------------------- corpus-wide counts

ENCODED = pa.schema([("chunk", pa.int64()), ("place", pa.int32()), ("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("n_pairs", pa.int32()), ("gaps", pa.binary()), ("times", pa.binary())])
ENCODED_DDL = "chunk long, place int, a int, b int, n long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_pairs int, gaps binary, times binary"


def _narrow(x: np.ndarray) -> bytes:
    """Numbers in as few bytes each as the largest one needs."""
    most = int(x.max()) if len(x) else 0
    return x.astype("u1" if most < 1 << 8 else "<u2" if most < 1 << 16 else "<u4").tobytes()


def _wide(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, f"<u{len(raw) // n}").astype(np.int64) if n else np.zeros(0, np.int64)


def _encode(batches: Iterator[pa.RecordBatch], byte_level: str, pieces: str, chunk_bytes: int, chunk_pairs: int) -> Iterator[pa.RecordBatch]:
    """Rows of texts (place is null) with the places of their pairs in their chunk's list, and rows of that list: (chunk, place, a, b, n texts that hold it)."""
    aligner, part = aligner_at(byte_level, pieces), TaskContext.get().partitionId()
    chunk, places, counts, size = part << 32, {}, np.zeros(0, np.int64), 0

    def listed() -> pa.RecordBatch:
        pairs = np.fromiter(places, np.uint64, len(places))
        some = {"chunk": np.full(len(pairs), chunk), "place": np.arange(len(pairs)), "a": (pairs >> np.uint64(32)).astype(np.int64), "b": (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64), "n": counts}
        return pa.RecordBatch.from_arrays([pa.array(some[f.name], f.type) if f.name in some else pa.nulls(len(pairs), f.type) for f in ENCODED], schema=ENCODED)

    for batch in small_batches(batches, most=1 << 20):
        texts = [t or "" for t in batch.column(1).to_pylist()]
        found, n = Aligned(aligner, texts), len(texts)
        pairs, inverse = np.unique(found.pair, return_inverse=True)
        place = np.fromiter((places.setdefault(p, len(places)) for p in pairs.tolist()), np.int64, len(pairs))
        owner = np.repeat(np.arange(n), np.diff(found.link_at))
        each, times = np.unique(owner << 32 | place[inverse], return_counts=True)
        owner, each = each >> 32, each & 0xFFFFFFFF
        counts = np.concatenate([counts, np.zeros(len(places) - len(counts), np.int64)])
        counts += np.bincount(each, minlength=len(places))
        at = np.searchsorted(owner, np.arange(n + 1))
        gaps = np.diff(each, prepend=0)
        gaps[at[:-1][at[:-1] < at[1:]]] = each[at[:-1][at[:-1] < at[1:]]]
        bounds = list(zip(at.tolist(), at[1:].tolist()))
        n_a = np.diff(found.a_at)
        digests = [hashlib.sha256(s).hexdigest() if k else "" for s, k in zip(found.group_strings(), n_a.tolist())]
        some = {"chunk": np.full(n, chunk), "doc_id": batch.column(0), "n_a": n_a, "n_b": np.diff(found.b_at), "n_groups": np.diff(found.group_at), "n_links": np.diff(found.link_at), "groups_sha256": digests, "n_pairs": np.diff(at)}
        some |= {"gaps": [_narrow(gaps[x:y]) for x, y in bounds], "times": [_narrow(times[x:y]) for x, y in bounds]}
        yield pa.RecordBatch.from_arrays([some[f.name] if isinstance(some.get(f.name), pa.Array) else pa.array(some[f.name], f.type) if f.name in some else pa.nulls(n, f.type) for f in ENCODED], schema=ENCODED)
        size += sum(map(len, texts))
        if size >= chunk_bytes or len(places) >= chunk_pairs:
            yield listed()
            chunk, places, counts, size = chunk + 1, {}, np.zeros(0, np.int64), 0
    if places:
        yield listed()
    release()


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a chunk's list with their corpus-wide counts, before the rows of its texts; of these, the sums over their links."""
    chunk, count, best = None, np.zeros(0, np.int64), np.zeros(0, bool)
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    for batch in batches:
        owner, place = batch.column(0).to_numpy(), batch.column(1)
        cuts = [0, *(np.flatnonzero((np.diff(owner) != 0) | np.diff(place.is_null().to_numpy(zero_copy_only=False))) + 1).tolist(), batch.num_rows]
        for x, y in zip(cuts, cuts[1:]):
            if y == x:
                continue
            rows = batch.slice(x, y - x)
            if owner[x] != chunk:
                chunk, count, best = owner[x], np.zeros(0, np.int64), np.zeros(0, bool)
            if place[x].is_valid:
                at = rows.column(1).to_numpy()
                if len(count) <= at.max():
                    more = max(len(count), int(at.max()) + 1 - len(count))
                    count, best = np.concatenate([count, np.zeros(more, np.int64)]), np.concatenate([best, np.zeros(more, bool)])
                count[at], best[at] = rows.column(2).to_numpy(), rows.column(3).to_numpy(zero_copy_only=False)
                continue
            n_best, total = [], []
            for n, gaps, times in zip(*(rows.column(k).to_pylist() for k in (10, 11, 12))):
                here, often = np.cumsum(_wide(gaps, n)), _wide(times, n)
                n_best.append(int(often[best[here]].sum()))
                total.append(int((often * count[here]).sum()))
            yield pa.RecordBatch.from_arrays([*rows.columns[4:9], pa.array(n_best, pa.int64()), pa.array(total, pa.int64()), rows.column(9)], names=names)
    release()


def encoded(docs: DataFrame, byte_level: str, pieces: str, scratch: Scratch, id_column: str = "doc_id", text_column: str = "text", chunk_bytes: int = 32 << 20, chunk_pairs: int = 1 << 20) -> DataFrame:
    """The rows of ``_encode`` in a scratch table. A chunk is what one task reads, up to ``chunk_bytes`` of text or ``chunk_pairs`` different pairs."""
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return scratch.table(rows.mapInArrow(partial(_encode, byte_level=byte_level, pieces=pieces, chunk_bytes=chunk_bytes, chunk_pairs=chunk_pairs), ENCODED_DDL), "encoded")


def pair_counts(listed: DataFrame) -> DataFrame:
    """(a, b, count, best): how many texts of the corpus hold a pair of ids linked, and whether none of its A id's pairs is held by more."""
    total = listed.groupBy("a", "b").agg(F.sum("n").alias("count"))
    return total.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy("a")))


def align(docs: DataFrame, byte_level: str, pieces: str, id_column: str = "doc_id", text_column: str = "text", chunk_bytes: int = 32 << 20, chunk_pairs: int = 1 << 20) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row, under the byte-level tokenizer of the file ``byte_level`` (A) and the
    sentence piece model ``pieces`` (B).

    Both read a blank and the text. Texts that are null, empty, or whose bytes under A or B aren't those of blank and text have no tokens: zeros, and an empty
    ``groups_sha256``. Special tokens' names in texts are plain text. Rows are counted one by one, so repeated rows add to the counts of their pairs; null
    ids stay null. An empty table has no rows. Very long texts are one row; a text without blanks is one unit of either tokenizer. Other columns don't matter.

    Every task counts the pairs of its own texts first. Their sums are taken by pair, and go back to the tasks' lists, which meet their texts in a sorted
    stream: what is shuffled are lists of different pairs, and for each text the places of its pairs.
    """
    scratch, spark = Scratch(docs.sparkSession, "alignment"), docs.sparkSession
    rows = encoded(docs, byte_level, pieces, scratch, id_column, text_column, chunk_bytes, chunk_pairs)
    listed = rows.filter("place is not null").select("chunk", "place", "a", "b", "n")
    known = listed.join(pair_counts(listed), ["a", "b"]).select("chunk", "place", "count", "best")
    texts = rows.filter("place is null").select("chunk", "place", F.lit(None).cast("long").alias("count"), F.lit(None).cast("boolean").alias("best"), "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_pairs", "gaps", "times")
    both = known.unionByName(texts, allowMissingColumns=True).repartition(shuffle_parts(spark), "chunk").sortWithinPartitions("chunk", F.col("place").asc_nulls_last())
    return both.mapInArrow(_sums, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def token_groups(docs: DataFrame, byte_level: str, pieces: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, groups): each row's groups as ``a1,a2|b1;a3|b2,b3``, ids of A and of B in order; rows without tokens have the empty string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, most=1 << 20):
            found = Aligned(aligner_at(byte_level, pieces), [t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.decode() for s in found.group_strings()], pa.string())], names=["doc_id", "groups"])

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(run, "doc_id long, groups string")
