"""Near duplicates by SimHash: fingerprints a few bits apart meet under keys of a Golay code."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import Scratch, mix64, release, shuffle_parts, small_batches
from assayer.llm.ngram_join import connected

_U = np.uint64
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Low bit and width of the three segments of a fingerprint.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: The most bits in which linked fingerprints differ; the keys rest on it.
DISTANCE = 2
#: x**11 + x**9 + x**7 + x**6 + x**5 + x + 1, which generates the perfect binary Golay code of length 23.
GENERATOR = 0b101011100011


# ---------------------------------------------------------------- fingerprints


def _word_lists(raw: bytes, most: int = 4 << 20) -> Iterator[list[bytes]]:
    """The words of a text in lists of about ``most`` bytes."""
    at = 0
    while len(raw) - at > most:
        end = at + most
        while end < len(raw) and raw[end] not in b"\x20\x09\x0a\x0b\x0c\x0d":
            end += 1
        yield raw[at:end].split()
        at = end
    yield raw[at:].split()


def fingerprint(text: bytes, width: int = 3, seed: int = 42) -> int:
    """The SimHash of a text's shingles of lower-cased (A-Z) words, repeats included, under XXH64; zero without words."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    sums, n, held = np.zeros(64, np.int64), 0, []
    for words in _word_lists(text.translate(_LOWER)):  # bytes.split() splits where words end: at space and \t \n \v \f \r
        words = held + words
        joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]) - 1
        if len(words) >= width:
            starts = np.concatenate([[0], ends[:-width] + 1])
            hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts.tolist(), ends[width - 1 :].tolist())], ">u8")
            for i in range(0, len(hashes), 1 << 15):
                sums += np.unpackbits(hashes[i : i + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
            n += len(hashes)
        held = words[max(0, len(words) - width + 1) :]
    if not n and held:
        return digest(b" ".join(held), seed)
    return int.from_bytes(np.packbits(2 * sums > n).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches):
        prints = np.array([fingerprint(t, width) if t else 0 for t in batch.column(1).cast(pa.binary()).to_pylist()], _U)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64)), pa.array(mix64(prints).view(np.int64))], names=["doc_id", "print", "node"])
    release()


# ---------------------------------------------------------------- Golay code


def _remainder(x: int) -> int:
    for k in range(22, 10, -1):
        if x >> k & 1:
            x ^= GENERATOR << (k - 11)
    return x


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Remainders of the low 12 and the high 11 bits of a word, and the one error of at most three bits for each remainder."""
    low, high = (np.array([_remainder(x << shift) for x in range(1 << bits)], np.uint32) for bits, shift in ((12, 0), (11, 12)))
    errors = np.zeros(1 << 11, np.uint32)
    for n in range(4):
        for bits in combinations(range(23), n):
            e = sum(1 << b for b in bits)
            errors[_remainder(e)] = e
    return low, high, errors


def decode(words: np.ndarray) -> np.ndarray:
    """The number of the codeword within three bits of each 23-bit word; there is exactly one, as the code is perfect."""
    low, high, errors = _tables()
    return (words ^ errors[low[words & np.uint32(0xFFF)] ^ high[words >> np.uint32(12)]]) >> np.uint32(11)


def near_codewords(words: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, number) of the codewords to which a word of ``width`` bits, or one a bit from it, decodes: one, or up to six.

    Two words two bits apart have a word between them, a bit from either, so they share a number; so do words a bit apart, and equal ones.
    """
    words = words.astype(np.uint32)
    flips = np.array([0, *(1 << b for b in range(width))], np.uint32)
    found = np.sort(decode(words[:, None] ^ flips[None, :]), axis=1)
    new = np.ones(found.shape, bool)
    new[:, 1:] = found[:, 1:] != found[:, :-1]
    row, place = np.nonzero(new)
    return row, found[row, place]


def _segment(prints: np.ndarray, k: int) -> np.ndarray:
    shift, width = SEGMENTS[k]
    return (prints >> _U(shift)) & _U((1 << width) - 1)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, print): two errors leave one segment of three without any, and each of the others with two at most. So the exact value of a segment and the
    codewords near the next one are keys, under each choice of the exact one."""
    for batch in batches:
        for at in range(0, batch.num_rows, 8192):
            prints = batch.column(0).slice(at, 8192).to_numpy().view(_U)
            keys, owners = [], []
            for k in range(len(SEGMENTS)):
                j = (k + 1) % len(SEGMENTS)
                row, number = near_codewords(_segment(prints, j), SEGMENTS[j][1])
                keys.append((_U(k) << _U(34)) | (_segment(prints, k)[row] << _U(12)) | number.astype(_U))
                owners.append(prints[row])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (keys, owners)], names=["key", "print"])


def _finer_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, print) with the codewords near the third segment in the key, too; such a key fits no more prints than two balls hold."""
    for batch in batches:
        for at in range(0, batch.num_rows, 8192):
            key, prints = (batch.column(c).slice(at, 8192).to_numpy().view(_U) for c in (0, 1))
            for k in range(len(SEGMENTS)):
                mine = np.flatnonzero(key >> _U(34) == _U(k))
                last = (k + 2) % len(SEGMENTS)
                row, number = near_codewords(_segment(prints[mine], last), SEGMENTS[last][1])
                keys = (_U(1) << _U(62)) | (key[mine][row] << _U(12)) | number.astype(_U)
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (keys, prints[mine][row])], names=["key", "print"])


# ---------------------------------------------------------------- groups within a key

#: A bucket's prints are compared with each other up to this many, beyond by looking up every print that is near enough.
PAIRWISE = 1024


def _settle(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the groups of a[i] and b[i]; ``root`` names every member's smallest one before and after."""
    while len(a):
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root[:] = up


def groups(prints: np.ndarray, distance: int = DISTANCE) -> np.ndarray:
    """For ascending distinct prints, the place of the first one that links within ``distance`` bits lead to. Memory and links stay linear; so does time but for
    a factor of near prints (2 081 for two bits)."""
    n = len(prints)
    root = np.arange(n)
    if n <= PAIRWISE:
        a, b = np.nonzero(np.triu(np.bitwise_count(prints[:, None] ^ prints[None, :]) <= distance, 1))
        _settle(root, a, b)
        return root
    for bits in range(1, distance + 1):
        for places in combinations(range(64), bits):
            other = prints ^ _U(sum(1 << p for p in places))
            at = np.minimum(np.searchsorted(prints, other), n - 1)
            hit = np.flatnonzero(prints[at] == other)
            _settle(root, hit, at[hit])
    return root


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) of names of prints that links within one key connect, each with the first of its group; rows come sorted by key and print."""

    def found(key: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]])
        sizes, a, b = np.diff(cuts), [], []
        pair = cuts[:-1][sizes == 2]
        pair = pair[np.bitwise_count(prints[pair] ^ prints[pair + 1]) <= DISTANCE]
        a.append(prints[pair])
        b.append(prints[pair + 1])
        for k in np.flatnonzero(sizes > 2):
            own = np.unique(prints[cuts[k] : cuts[k + 1]])
            root = groups(own)
            here = np.flatnonzero(root != np.arange(len(own)))
            a.append(own[root[here]])
            b.append(own[here])
        return pa.RecordBatch.from_arrays([pa.array(mix64(np.concatenate(x)).view(np.int64)) for x in (a, b)], names=["a", "b"])

    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key, prints = (batch.column(c).to_numpy() for c in (0, 1))
        end = int(np.searchsorted(key, key[-1]))  # the last key may go on in the next batch
        if end or (held and held[-1][0][-1] != key[0]):
            before = [*held, (key[:end], prints[:end])]
            yield found(np.concatenate([k for k, _ in before]), np.concatenate([p for _, p in before]).view(_U))
            held = []
        held.append((key[end:].copy(), prints[end:].copy()))
    if held:
        yield found(np.concatenate([k for k, _ in held]), np.concatenate([p for _, p in held]).view(_U))
    release()


# ---------------------------------------------------------------- operator

KEYED = "key bigint, print bigint"


def link_prints(nodes: DataFrame, scratch: Scratch, large: int = 4096) -> DataFrame:
    """(a, b) of names of distinct prints (column ``print``), so that links within DISTANCE bits connect the same prints as these do.

    Keys of more than ``large`` prints are dealt out by the third segment; nothing is dropped.
    """
    parts = shuffle_parts(nodes.sparkSession)
    keys = scratch.table(nodes.select("print").mapInArrow(_keys, KEYED), "keys")
    hot = scratch.table(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > large).select("key"), "hot")
    finer = keys.join(hot, "key").select("key", "print").mapInArrow(_finer_keys, KEYED)
    dealt = keys.join(hot, "key", "left_anti").select("key", "print").unionByName(finer)
    return dealt.repartition(parts, "key").sortWithinPartitions("key", "print").mapInArrow(_links, "a bigint, b bigint").distinct()


def near_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 3, large: int = 4096) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row: its SimHash as 16 hexadecimal digits, and the smallest id that links lead to, itself included.

    Words are lower-cased (A-Z) and a shingle is ``width`` of them, or the whole sequence of fewer. Fingerprints link at two or fewer differing bits. Null and empty
    texts and those without words have the fingerprint zero, which links like any other. Equal fingerprints are one node however many rows have it, so copies cost
    one row each. Null ids are smaller than none, so a group of rows without ids has none. Repeated rows come as often as they are; an empty table has no rows;
    very long texts are read in pieces; other columns, whatever their names, don't matter.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    members = scratch.table(rows.mapInArrow(partial(_fingerprints, width=width), "doc_id long, print long, node long"), "members")
    nodes = scratch.table(members.groupBy("print", "node").agg(F.min("doc_id").alias("low")), "nodes")
    links = scratch.table(link_prints(nodes, scratch, large), "links")
    roots = connected(links, scratch)
    named = nodes.join(roots, "node", "left").select("print", "low", F.coalesce("root", "node").alias("root"))
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    known = named.join(lowest, "root").select("print", "component_id")
    for name in ("keys", "hot", "links"):
        scratch.drop(name)
    return members.join(known, "print").select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")
