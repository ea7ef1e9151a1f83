"""Exact Jaccard self-join of word n-gram sets: universe partition and pigeonhole, with connected groups of what it links.

The universe of shingle hashes is cut into 2**level segments by leading bits; a document's part in a segment is a subset. Two sets of sizes
a <= b with Jaccard similarity 3/4 or more differ in at most (a + b) / 7 elements, so if segments with weights that sum to more are looked
at, one of them differs by less than its weight: by nothing (weight 1: equal subsets), or by at most one element (weight 2: equal
subsets, or one is a one-deletion neighbour of the other). Sizes fall into bands of powers of two, and a set near the top of its band
is indexed in the next band, too. All sets of a band look at its segments in one order, cheapest first by the squares of the shingle
frequencies of the whole corpus, and stop when their weights suffice; the cheapest quarter of the segments has weight 2. Two sets that stop at
different places both looked at all that the one that stopped first did, and that was enough.

Sets of a signature meet their hub, one of them, first. Links and what is connected by them need no more. Where many of a hub's sets are still
apart, as with a long passage that many texts share but that isn't enough to link them, two of them link only if they differ from the hub in
the same elements: |x ^ y| = |x ^ h| + |y ^ h| - 2 |(x ^ h) & (y ^ h)|. So the elements in which a set differs from the hub are signatures, too,
as many of them, in one order, as the smallest overlap that is needed leaves (a prefix filter). A few sets left apart are compared pair by pair.
"""

from __future__ import annotations

import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import Scratch, mix64, release, shingles, shuffle_parts, small_batches, text_buffer

WIDTH = 5
#: Frequencies are counted by the leading bits of shingle hashes: a table of fixed size however large the corpus.
COUNTER_BITS = 20
#: Counters that go through a shuffle as one row.
COUNTER_BLOCK = 1 << 12
#: Members of a group that meet in one task; blocks of a larger group meet in pairs.
BLOCK = 512
#: Partners of each set in a block that the first round compares, nearest by sketch first; the last round compares all that are left.
NEAREST = (4, None)
#: Rounds in which groups of more blocks than LARGE are dealt out by the elements in which their members differ from the hub. In smaller ones
#: all pairs of sketches cost less than that.
DEEPER, LARGE = 3, 16
#: Elements that sets which are compared exactly in one task may have in all; more are dealt out further.
ELEMENTS = 1 << 23
#: Segments for each element of the largest sets of a band, as a power of two. More segments tell frequent shingles apart better.
FINER = 3
_U = np.uint64
_DELETED = 1 << 15


def shingle_sets(texts: pa.Array, key: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct shingle hashes of each text, and the n + 1 offsets of the texts among them."""
    data, offsets = text_buffer(texts)
    h, at = shingles(data, offsets, WIDTH, key)
    for a, b in zip(at.tolist(), at[1:].tolist()):
        h[a:b].sort()
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    new[at[:-1][np.diff(at) > 0]] = True
    return h[new], np.concatenate([[0], np.cumsum(new)])[at]


def set_names(tokens: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 128-bit name of each set, as rows of 16 bytes; equal sets have equal names. The empty set's is all zeros."""
    raw = memoryview(np.ascontiguousarray(tokens)).cast("B") if len(tokens) else memoryview(b"")
    names = [hashlib.blake2b(raw[8 * a : 8 * b], digest_size=16).digest() if b > a else bytes(16) for a, b in zip(at.tolist(), at[1:].tolist())]
    return np.frombuffer(b"".join(names), np.uint8).reshape(-1, 16)


def _short(names: np.ndarray) -> np.ndarray:
    """The first 64 bits of names. Sets that look alike by these become candidates too many, and only two of them that link could be missed."""
    return np.ascontiguousarray(names).view(np.int64).reshape(-1, 2)[:, 0].copy()


def _first_of_each(names: np.ndarray) -> np.ndarray:
    """Whether a row of 16 bytes is the one that counts of its kind."""
    halves = np.ascontiguousarray(names).view(np.uint64).reshape(-1, 2)
    by = np.lexsort((halves[:, 1], halves[:, 0]))
    new = np.ones(len(by), bool)
    new[1:] = (halves[by][1:] != halves[by][:-1]).any(axis=1)
    once = np.zeros(len(names), bool)
    once[by[new]] = True
    return once


def _binary(names: np.ndarray) -> pa.Array:
    """Rows of 16 bytes as an Arrow column."""
    return pa.Array.from_buffers(pa.binary(), len(names), [None, pa.py_buffer(np.arange(0, 16 * len(names) + 1, 16, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(names))])


SETS = "kind int, doc_id long, key long, node binary, short long, n long, packed binary"


def _sets(batches: Iterator[pa.RecordBatch], key: bytes) -> Iterator[pa.RecordBatch]:
    """kind 0: (doc_id, row key, set name, size, sketch) of each row; kind 1: (block, ..., counts) of the shingles of this partition."""
    names, counts = ["kind", "doc_id", "key", "node", "short", "n", "packed"], np.zeros(1 << COUNTER_BITS, np.int32)
    for batch in small_batches(batches):
        tokens, at = shingle_sets(batch.column(2), key)
        node, n = set_names(tokens, at), np.diff(at)
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(n), np.int32)), batch.column(0), batch.column(1), _binary(node), pa.array(_short(node)), pa.array(n), pa.array(sketches(tokens, at), pa.binary())], names)
        once = _first_of_each(node)  # copies in a batch count once
        counts += np.bincount((tokens[np.repeat(once, n)] >> _U(64 - COUNTER_BITS)).astype(np.int64), minlength=len(counts)).astype(np.int32)
    blocks = counts.reshape(-1, COUNTER_BLOCK)
    hit = np.flatnonzero(blocks.any(axis=1))
    zero = pa.array(np.zeros(len(hit), np.int64))
    yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(hit), np.int32)), pa.array(hit), zero, pa.nulls(len(hit), pa.binary()), zero, zero, pa.array([zlib.compress(blocks[i].tobytes(), 1) for i in hit], pa.binary())], names)
    release()


def _add_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the counts of each block in this partition, as what stands out of the usual count."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            total[block] = total.get(block, 0) + np.frombuffer(zlib.decompress(packed), np.int32).astype(np.int64)
    out = []
    for block, counts in total.items():
        usual = np.median(counts)
        out.append((block, np.maximum(counts - usual - 3 * np.sqrt(usual), 0).astype(np.float32).tobytes()))
    yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in out], pa.int64()), pa.array([c for _, c in out], pa.binary())], ["block", "excess"])


def sketches(tokens: np.ndarray, at: np.ndarray) -> list[bytes]:
    """For each set, its elements counted by leading bits of another hash, up to 3, in n to 2 n counters of two bits. Two sets differ in at
    least the sum of the differences of their counters."""
    other, n, out = mix64(tokens ^ _U(0x2545F4914F6CDD1D)), np.diff(at), []
    bits = np.maximum(4, np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64))
    for a, b, k in zip(at.tolist(), at[1:].tolist(), bits.tolist()):
        c = np.minimum(np.bincount((other[a:b] >> _U(64 - k)).astype(np.int64), minlength=1 << k), 3).astype(np.uint8).reshape(-1, 4)
        out.append((c[:, 0] | c[:, 1] << 2 | c[:, 2] << 4 | c[:, 3] << 6).tobytes())
    return out


def _counters(packed: bytes, width: int | None = None) -> np.ndarray:
    """A sketch's counters; of a shorter sketch of the same set, if wanted: neighbours are added, and 3 stays the most."""
    x = np.frombuffer(packed, np.uint8)
    x = np.stack([x >> k & 3 for k in (0, 2, 4, 6)], axis=1).ravel()
    return x if width is None or width == len(x) else np.minimum(x.reshape(width, -1).sum(axis=1), 3).astype(np.uint8)


def may_link(a: bytes, b: bytes, n: int, m: int) -> bool:
    """False only if the sketches show that sets of n and m elements differ too much."""
    width = 4 * min(len(a), len(b))
    return int(np.abs(_counters(a, width).astype(np.int16) - _counters(b, width)).sum()) <= (n + m) // 7


class Allocation:
    """The order of the segments of each band and their weights, from the counters."""

    def __init__(self, excess: np.ndarray):
        """excess: by how much each counter stands out; only that can be a shingle that many documents share."""
        self.squares, self.held = np.asarray(excess, np.float64) ** 2, {}

    def band(self, level: int) -> tuple[np.ndarray, int]:
        """Rank of each of the band's segments, cheapest first; ranks below the second value have weight 2."""
        if level not in self.held:
            m = 1 << level
            cost = self.squares.reshape(m, -1).sum(axis=1) if level <= COUNTER_BITS else np.repeat(self.squares, m >> COUNTER_BITS)
            shuffled = mix64(np.arange(m, dtype=np.uint64) + _U(1))
            order = np.lexsort((shuffled, cost))  # a random order of equal costs spreads the signatures
            rank = np.empty(m, np.int64)
            rank[order] = np.arange(m)
            self.held[level] = (rank, m // 4)
        return self.held[level]


def band_of(n: np.ndarray) -> np.ndarray:
    """The band of sets of n elements: its largest have 2**band."""
    return np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64)


def level_of(band: np.ndarray) -> np.ndarray:
    """Segments of a band, as a power of two: 2**FINER for each element, but no more than there are counters, or else one for each element."""
    return np.maximum(band, np.minimum(band + FINER, COUNTER_BITS))


def signatures(tokens: np.ndarray, at: np.ndarray, allocation: Allocation) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signature, set number and whether it is a one-deletion neighbour, of all sets."""
    n = np.diff(at)
    reach = n * 4 // 3  # the largest partner
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for own in (True, False):
        band = band_of(n if own else reach)
        level = level_of(band)
        some = n > 0 if own else (n > 0) & (band != band_of(n))
        most = (n + np.minimum(reach, np.left_shift(1, band))) // 7 + 1  # weight that is needed
        for v in np.unique(level[some]).tolist():
            docs = np.flatnonzero(some & (level == v))
            size = n[docs]
            start = np.cumsum(size) - size
            t = tokens[np.repeat(at[docs] - start, size) + np.arange(size.sum())]
            d = np.repeat(np.arange(len(docs)), size)
            seg = (t >> _U(64 - v)).astype(np.int64) if v else np.zeros(len(t), np.int64)
            new = np.ones(len(t), bool)
            new[1:] = (seg[1:] != seg[:-1]) | (d[1:] != d[:-1])
            first = np.flatnonzero(new)
            m = mix64(t + _U(0xA0761D6478BD642F))
            total, length, owner, where = np.add.reduceat(m, first), np.diff(np.append(first, len(t))), d[first], seg[first]
            rank, cheap = allocation.band(v)
            r = rank[where]
            by = np.argsort((owner << 40) | r, kind="stable")
            weight = np.where((r[by] < cheap) & (length[by] >= 2), 2, 1)
            run, o = np.cumsum(weight), owner[by]
            base = np.concatenate([[0], run])[np.searchsorted(o, np.arange(len(docs) + 1))]
            need = most[docs]
            chosen = by[(run - weight - base[o]) < need[o]]
            salt = mix64(where.astype(np.uint64) * _U(64) + _U(v + 1))
            out.append((mix64(total[chosen] + salt[chosen]), docs[owner[chosen]], np.zeros(len(chosen), bool)))
            pick = np.zeros(len(first), bool)
            pick[chosen] = True
            pick &= (r < cheap) & (length >= 2)
            part = np.repeat(np.arange(len(first)), length)
            left = np.flatnonzero(pick[part])
            if len(left):
                p = part[left]
                out.append((mix64(total[p] - m[left] + salt[p]), docs[owner[p]], np.ones(len(left), bool)))
            short = np.flatnonzero(np.diff(base) < need)  # too few segments: each shingle is a segment, in order of hash
            for i in short.tolist():
                s = t[start[i] : start[i] + min(size[i], need[i])]
                out.append((mix64(s + _U(0xE7037ED1A0B428DB) + _U(v)), np.full(len(s), docs[i]), np.zeros(len(s), bool)))
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool)
    return tuple(np.concatenate(x) for x in zip(*out))


BLOB = "bucket int, nodes binary, sizes binary, high binary, low binary, owner binary, roots binary"


def _blobs(sig: np.ndarray, owner: np.ndarray, deleted: np.ndarray, node: np.ndarray, n: np.ndarray, buckets: int, root: np.ndarray | None = None) -> pa.RecordBatch:
    """Signatures, the numbers of their sets and whether they are neighbours, packed by bucket; short names and sizes of the sets, and short
    names of what they are connected with, if that is known. A set is in many buckets, so these are most of what is shuffled."""
    node, root = _short(node), None if root is None else _short(root)
    bucket = (sig % _U(buckets)).astype(np.int64)
    by = np.argsort(bucket, kind="stable")
    sig, owner, bucket = sig[by], owner[by] | np.where(deleted[by], _DELETED, 0), bucket[by]
    here, start = np.unique(bucket, return_index=True)
    out = []
    for b, x, y in zip(here.tolist(), start.tolist(), np.append(start[1:], len(bucket)).tolist()):
        used, local = np.unique(owner[x:y] & (_DELETED - 1), return_inverse=True)
        local = local.astype(np.uint16) | (owner[x:y] & _DELETED).astype(np.uint16)
        out.append((b, node[used].tobytes(), n[used].astype(np.int32).tobytes(), (sig[x:y] >> _U(32)).astype(np.uint32).tobytes(), (sig[x:y] >> _U(16)).astype(np.uint16).tobytes(), local.tobytes(), b"" if root is None else root[used].tobytes()))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 7, [pa.int32()] + [pa.binary()] * 6)], ["bucket", "nodes", "sizes", "high", "low", "owner", "roots"])


def _sign(batches: Iterator[pa.RecordBatch], excess: np.ndarray, buckets: int, key: bytes) -> Iterator[pa.RecordBatch]:
    """Signatures of this partition's distinct sets, packed by bucket: names and sizes of the sets, and 48 bits of hash and a set number for each signature."""
    allocation = Allocation(excess)
    for batch in small_batches(batches):
        for rows in (batch.slice(i, _DELETED - 1) for i in range(0, batch.num_rows, _DELETED - 1)):
            tokens, at = shingle_sets(rows.column(0), key)
            node, n = set_names(tokens, at), np.diff(at)
            once = _first_of_each(node) & (n > 0)
            tokens, n, node = tokens[np.repeat(once, n)], n[once], node[once]
            yield _blobs(*signatures(tokens, np.concatenate([[0], np.cumsum(n)]), allocation), node, n, buckets)
        release()


CANDIDATES = "a long, b long, star boolean"


def _bucket_pairs(blobs: list[tuple]) -> pa.RecordBatch:
    """Distinct pairs of short names to compare: the two of a signature that two sets have, or each set with the hub, where more have it.

    A signature's hub is the set with the smallest name of those with the subset itself. All sets of a signature are in the group of its hub.
    Signatures of sets that are all connected give nothing.
    """
    nodes, sizes, sig, deleted, known = [], [], [], [], 0
    for name, size, high, low, owner, _ in blobs:
        at = np.frombuffer(owner, np.uint16).astype(np.int64)
        deleted.append(at >= _DELETED)
        at &= _DELETED - 1
        nodes.append(at + known)
        known += len(name) // 8
        sizes.append(np.frombuffer(size, np.int32)[at])
        sig.append((np.frombuffer(high, np.uint32).astype(np.uint64) << _U(16)) | np.frombuffer(low, np.uint16).astype(np.uint64))
    node, n, s, cut = (np.concatenate(x) for x in (nodes, sizes, sig, deleted))
    names, root = (np.frombuffer(b"".join(x), np.int64) for x in ((blob[0] for blob in blobs), (blob[5] or blob[0] for blob in blobs)))
    by = np.argsort(s, kind="stable")
    twice = s[by][1:] == s[by][:-1]
    shared = np.zeros(len(by), bool)
    shared[1:] |= twice
    shared[:-1] |= twice
    by = by[shared]
    node, root = names[node], root[node]
    by = by[np.lexsort((node[by], cut[by], s[by]))]  # subsets themselves first, by name
    node, n, s, cut, root = node[by], n[by], s[by], cut[by], root[by]
    new = np.concatenate([[True], s[1:] != s[:-1]])[: len(s)]
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(s)))
    hub = np.repeat(first, count)
    star = np.repeat(count > 2, count)
    # of two sets only one pair can come; in a larger group, whoever doesn't fit the hub's size may still fit another member
    apart = np.zeros(len(s), bool)
    if len(first):
        apart = np.repeat(np.minimum.reduceat(root, first) != np.maximum.reduceat(root, first), count)
    keep = apart & (node != node[hub]) & ~cut[hub] & (star | (4 * np.minimum(n, n[hub]) >= 3 * np.maximum(n, n[hub])))
    rows = np.unique(np.stack([node[hub][keep], node[keep], star[keep].astype(np.int64)], axis=1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[:, 0])), pa.array(np.ascontiguousarray(rows[:, 1])), pa.array(rows[:, 2] > 0)], ["a", "b", "star"])


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, last = [], None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[0] != last and held:
                yield _bucket_pairs(held)
                held = []
            last = row[0]
            held.append(row[1:])
    if held:
        yield _bucket_pairs(held)
    release()


def _block_pairs(rows: list[tuple], nearest: int | None) -> list[tuple[bytes, bytes]]:
    """Pairs of a group's two blocks (or within one) that no links connect yet and that may link. rows: (block, node, n, sketch, root)."""
    block, _, n, _, _ = (np.array(x) if k in (0, 2) else None for k, x in enumerate(zip(*rows)))
    numbers = {r: k for k, r in enumerate({row[4] for row in rows})}
    node, packed, root = [row[1] for row in rows], [row[3] for row in rows], np.array([numbers[row[4]] for row in rows])
    width = 4 * min(map(len, packed))
    table = np.stack([_counters(x, width) for x in packed]).astype(np.int8)
    low, out = block.min(), []
    two = bool((block != low).any())
    for i in np.flatnonzero(block == low).tolist():
        j = np.flatnonzero(block != low) if two else np.arange(i + 1, len(rows))
        j = j[(root[j] != root[i]) & (4 * np.minimum(n[j], n[i]) >= 3 * np.maximum(n[j], n[i]))]
        if len(j):
            apart = np.abs(table[j] - table[i]).sum(axis=1, dtype=np.int64)
            may = apart <= (n[j] + n[i]) // 7
            j, apart = j[may], apart[may]
            if nearest is not None and len(j) > nearest:
                j = j[np.argsort(apart, kind="stable")[:nearest]]
            out += [(min(node[i], node[k]), max(node[i], node[k])) for k in j.tolist()]
    return sorted(set(out))


ACROSS = "hub binary, low int, high int, a binary, b binary"


def _across(batches: Iterator[pa.RecordBatch], nearest: int | None) -> Iterator[pa.RecordBatch]:
    """Pairs of rows (hub, low block, high block, block, node, n, sketch, root), sorted by the first three, with these."""
    held, last = [], None

    def pairs() -> pa.RecordBatch:
        found = _block_pairs(held, nearest)
        columns = [*([x] * len(found) for x in last), [x for x, _ in found], [y for _, y in found]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.binary()])], ["hub", "low", "high", "a", "b"])

    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for key, row in zip(zip(*columns[:3]), zip(*columns[3:])):
            if key != last and held:
                yield pairs()
                held = []
            last = key
            held.append(row)
    if held:
        yield pairs()
    release()


def _hopeful(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs that their sketches don't rule out."""
    for batch in batches:
        n, m, x, y = (batch.column(k).to_pylist() for k in range(2, 6))
        yield batch.select([0, 1]).filter(pa.array([may_link(*z) for z in zip(x, y, n, m)], pa.bool_()))


def _two_sets(batches: Iterator[pa.RecordBatch], first: int, key: bytes) -> Iterator[tuple[pa.RecordBatch, list[tuple[np.ndarray, np.ndarray]]]]:
    """Rows, some at a time, with the sets of their two texts, columns ``first`` (text_a) and the next; equal neighbours in a column are one text."""
    for batch in small_batches(batches, text="text_a", most=2 << 20):
        for rows in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
            sides = []
            for k in (first, first + 1):
                text = rows.column(k).dictionary_encode()
                tokens, at = shingle_sets(text.dictionary, key)
                sides.append([tokens[at[i] : at[i + 1]] for i in text.indices.to_pylist()])
            yield rows, list(zip(*sides))


def _link(x: np.ndarray, y: np.ndarray) -> bool:
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * shared >= 75 * (len(both) - shared)


def _verify(batches: Iterator[pa.RecordBatch], key: bytes) -> Iterator[pa.RecordBatch]:
    """The pairs whose sets have 100 * intersection >= 75 * union."""
    for rows, sets in _two_sets(batches, 2, key):
        keep = []
        for x, y in sets:
            keep.append(_link(x, y))
        yield rows.select([0, 1]).filter(pa.array(keep, pa.bool_()))
    release()


def _links_within(sets: dict[bytes, np.ndarray], roots: dict[bytes, bytes], pairs: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    """The pairs that link and connect what roots and the links before them don't connect."""
    up, found = {r: r for r in roots.values()}, []

    def top(r: bytes) -> bytes:
        while up[r] != r:
            up[r] = r = up[up[r]]
        return r

    for a, b in pairs:
        x, y = top(roots[a]), top(roots[b])
        if x != y and _link(sets[a], sets[b]):
            up[max(x, y)] = min(x, y)
            found.append((a, b))
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.binary()), pa.array([y for _, y in found], pa.binary())], ["a", "b"])


def _settle(batches: Iterator[pa.RecordBatch], key: bytes) -> Iterator[pa.RecordBatch]:
    """Links of rows (hub, low, high, part_a, part_b, other, node, root, text), sorted by the first six: first the texts of a place (other is null), each
    once, then the pairs (node, other) of them. Text is shuffled by set and place, not by pair."""
    sets, roots, pairs, last = {}, {}, [], None
    for batch in small_batches(batches):
        tokens, at = shingle_sets(batch.column(8), key)
        for i, (*place, other, node, root) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(8)))):
            if place != last:
                if pairs:
                    yield _links_within(sets, roots, pairs)
                sets, roots, pairs, last = {}, {}, [], place
            if other is None:
                sets[node], roots[node] = tokens[at[i] : at[i + 1]].copy(), root
            else:
                pairs.append((node, other))
    if pairs:
        yield _links_within(sets, roots, pairs)
    release()


APART = "hub binary, node binary, block int, root binary, n long, e long, tokens binary, linked boolean"


def _apart(batches: Iterator[pa.RecordBatch], key: bytes) -> Iterator[pa.RecordBatch]:
    """Rows (hub, node, block, root, text_a of the hub, text_b of the node): the node's size n, the elements in which it differs from the hub, whether
    the two link, and e = 7 times the number of the elements less n. Two nodes with 7 |x ^ y| <= n + m share at least (e_x + e_y) / 14 of them. They come in one order for all
    nodes of a hub, the node's own before the hub's, which others are likelier to lack, too."""
    names = ["hub", "node", "block", "root", "n", "e", "tokens", "linked"]
    for rows, sets in _two_sets(batches, 4, key):
        e, tokens, size, linked = [], [], [], []
        for hub, x in sets:
            own, lacking = np.setdiff1d(x, hub, assume_unique=True), np.setdiff1d(hub, x, assume_unique=True)
            size.append(len(x))
            e.append(7 * (len(own) + len(lacking)) - len(x))
            linked.append(e[-1] <= len(hub))
            tokens.append(np.concatenate([own, lacking]).tobytes())
        yield pa.RecordBatch.from_arrays([*rows.columns[:4], pa.array(size, pa.int64()), pa.array(e, pa.int64()), pa.array(tokens, pa.binary()), pa.array(linked, pa.bool_())], names)
    release()


def _sign_apart(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows (hub, node, root, n, e, tokens, least): so many elements as signatures of the hub that nodes which share enough of them share one of these."""
    for batch in small_batches(batches, text="tokens"):
        for rows in (batch.slice(i, _DELETED - 1) for i in range(0, batch.num_rows, _DELETED - 1)):
            sig, owner = [], []
            for i, (hub, e, tokens, least) in enumerate(zip(*(rows.column(k).to_pylist() for k in (0, 4, 5, 6)))):
                t = np.frombuffer(tokens, np.uint64)
                t = t[: max(0, len(t) - max(1, -(-(e + least) // 14)) + 1)]
                sig.append(mix64(t ^ _U(int.from_bytes(hub[:8], "little"))))
                owner.append(np.full(len(t), i))
            sig, owner = np.concatenate(sig), np.concatenate(owner)
            node, root = (np.frombuffer(b"".join(rows.column(k).to_pylist()), np.uint8).reshape(-1, 16) for k in (1, 2))
            yield _blobs(sig, owner, np.zeros(len(sig), bool), node, rows.column(3).to_numpy(), buckets, root)
    release()


def connected(links: DataFrame, scratch: Scratch, tables: list[str] | None = None) -> DataFrame:
    """(node, root) of every node with a link; nodes of one group have one root. Names are hashes, so contraction halves what is left each time.

    Each round, every node goes to the smallest of itself and its neighbours; links are renamed and those within a node go. The result is a
    table of ``scratch``, whose name is added to ``tables``.
    """
    own, steps, k, names = uuid.uuid4().hex, [], 0, []
    left = scratch.table(links.select("a", "b").filter("a <> b").distinct(), f"links-{own}-0")
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = scratch.table(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")), f"up-{own}-{k}")
        steps.append(up)
        x, y = up.select(F.col("node").alias("a"), F.col("root").alias("x")), up.select(F.col("node").alias("b"), F.col("root").alias("y"))
        renamed = left.join(x, "a").join(y, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).filter("a <> b").distinct()
        names.append(f"links-{own}-{k}")
        k += 1
        left = scratch.table(renamed, f"links-{own}-{k}")
    for name in names:
        scratch.drop(name)
    if not steps:
        scratch.drop(f"links-{own}-0")
        return links.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0)
    roots = steps[0]
    for up in steps[1:]:
        roots = roots.join(up.select(F.col("node").alias("root"), F.col("root").alias("higher")), "root", "left").select("node", F.coalesce("higher", "root").alias("root"))
    out = scratch.table(roots, f"roots-{own}")
    for name in (*(f"up-{own}-{i}" for i in range(len(steps))), f"links-{own}-{k}"):
        scratch.drop(name)
    if tables is not None:
        tables.append(f"roots-{own}")
    return out


def _rooted(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """What link_groups gives, and the root: the name of the group itself, as ids may be null or shared. Rows without shingles have none."""
    spark = docs.sparkSession
    parts, scratch = shuffle_parts(spark), Scratch(spark, "ngram")
    secret = os.urandom(16)  # keys the hashes of this run
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text")).withColumn("key", F.xxhash64("doc_id", "text"))
    sets = scratch.table(rows.select("doc_id", "key", "text").mapInArrow(partial(_sets, key=secret), SETS), "sets")
    blocks = sets.filter("kind = 1").select(F.col("doc_id").alias("block"), "packed").repartition(parts, "block").mapInArrow(_add_counts, "block long, excess binary")
    excess = np.zeros(1 << COUNTER_BITS, np.float32)
    for r in blocks.collect():  # 2**COUNTER_BITS numbers, whatever the corpus
        excess[r["block"] * COUNTER_BLOCK :][:COUNTER_BLOCK] = np.frombuffer(r["excess"], np.float32)
    members = sets.filter("kind = 0").select("doc_id", "key", "node", "n")
    nodes = sets.filter("kind = 0 and n > 0").groupBy("node").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(0)).alias("id"), "key", "short", "n", "packed")).alias("first"))
    nodes = scratch.table(nodes.select("node", "first.*"), "nodes")
    tables = ["nodes"]

    def table(df: DataFrame, name: str) -> DataFrame:
        tables.append(name)
        return scratch.table(df, name)

    def candidates(blobs: DataFrame, name: str) -> DataFrame:
        found = blobs.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_candidates, CANDIDATES)
        found = scratch.table(found.distinct(), f"short-{name}")
        a, b = nodes.select(F.col("short").alias("a"), F.col("node").alias("x")), nodes.select(F.col("short").alias("b"), F.col("node").alias("y"))
        out = table(found.join(a, "a").join(b, "b").select(F.col("x").alias("a"), F.col("y").alias("b"), "star").filter("a <> b"), f"candidates-{name}")
        scratch.drop(f"short-{name}")
        return out

    def texts_of(wanted: DataFrame) -> DataFrame:
        """(node, text) of distinct nodes; 128 bits name a row: its id (0 if null) and a hash of id and text."""
        places = wanted.join(nodes, "node").select("node", F.col("id").alias("at_id"), F.col("key").alias("at_key"))
        here = (F.coalesce("doc_id", F.lit(0)) == F.col("at_id")) & (F.col("key") == F.col("at_key"))
        return rows.join(places, here).select("node", "text")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        texts = scratch.table(texts_of(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()), f"texts-{name}")
        a, b = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
        out = table(pairs.join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b").mapInArrow(partial(_verify, key=secret), "a binary, b binary").distinct(), f"verified-{name}")
        scratch.drop(f"texts-{name}")
        return out

    def settled(pairs: DataFrame, roots: DataFrame, name: str) -> DataFrame:
        """Links of pairs (hub, low, high, a, b) of blocks. A set meets all its partners of two blocks at once; where the sets of two blocks are too long for one task,
        they are dealt out further."""
        key = ["hub", "low", "high"]
        ends = lambda df, by: df.select(*by, F.col("a").alias("node")).union(df.select(*by, "b")).distinct()
        size = ends(pairs, key).join(nodes.select("node", "n"), "node").groupBy(*key).agg(F.ceil(F.sum("n") / ELEMENTS).cast("int").alias("finer"))
        placed = pairs.join(table(size.filter("finer > 1"), f"finer-{name}"), key, "left").withColumn("finer", F.coalesce("finer", F.lit(1)))
        placed = placed.select(*key, *(F.pmod(F.xxhash64(v), F.col("finer")).cast("int").alias(f"part_{v}") for v in "ab"), "a", "b")
        key += ["part_a", "part_b"]
        wanted = table(ends(placed, key), f"wanted-{name}")
        texts = scratch.table(texts_of(wanted.select("node").distinct()), f"texts-{name}")
        none = F.lit(None)
        rooted = wanted.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        held = rooted.join(texts, "node").select(*key, none.cast("binary").alias("other"), "node", "root", "text")
        both = held.union(placed.select(*key, "b", "a", none.cast("binary"), none.cast("string"))).repartition(parts, *key)
        out = table(both.sortWithinPartitions(*key, "other").mapInArrow(partial(_settle, key=secret), "a binary, b binary"), f"settled-{name}")
        scratch.drop(f"texts-{name}")
        return out

    def once(found: DataFrame, name: str) -> DataFrame:
        """Pairs of two, and each set of a larger group with one of its hubs, without those that sketches rule out."""
        each = found.filter("star").groupBy(F.col("b").alias("node")).agg(F.min("a").alias("hub"))
        pairs = found.filter("not star").select("a", "b").unionByName(each.select(F.col("hub").alias("a"), F.col("node").alias("b")))
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        x, y = (nodes.select(F.col("node").alias(v), F.col("n").alias(f"n_{v}"), F.col("packed").alias(f"s_{v}")) for v in "ab")
        return table(pairs.join(x, "a").join(y, "b").select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInArrow(_hopeful, "a binary, b binary"), f"once-{name}")

    def grouped(found: DataFrame, name: str) -> DataFrame:
        star = found.filter("star").select(F.col("a").alias("hub"), F.col("b").alias("node"))
        return table(star.unionByName(star.select("hub", F.col("hub").alias("node"))).distinct(), f"group-{name}")

    def open_groups(group: DataFrame, roots: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        """The group's rows with their roots, and the hubs whose sets aren't all connected, with the number of blocks that they make."""
        now = group.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        hubs = now.groupBy("hub").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("size")).filter("low <> high").select("hub", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
        return now, table(hubs, f"open-{name}")  # so that both sides of a join are shuffled for it, and a large group is split

    blobs = rows.select("text").mapInArrow(partial(_sign, excess=excess, buckets=4 * parts, key=secret), BLOB)
    found = candidates(blobs, "0")
    tried = once(found, "0")
    links = verified(tried, "0")
    roots = connected(links, scratch, tables)
    group = grouped(found, "0")
    for level in range(DEEPER):
        now, hubs = open_groups(group, roots, f"deep-{level}")
        large = hubs.filter(F.col("blocks") > LARGE)
        if large.isEmpty():
            break
        inside = now.join(large, "hub").filter("node <> hub").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).select("hub", "node", "block", "root")
        inside = table(inside, f"inside-{level}")
        copies = large.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))  # as many of a hub as it has blocks
        texts = table(texts_of(inside.select("node").union(large.select(F.col("hub").alias("node"))).distinct()), f"deep-texts-{level}")
        hub_texts = copies.select("hub", "block").join(texts.select(F.col("node").alias("hub"), F.col("text").alias("text_a")), "hub")
        both = inside.join(texts.withColumnRenamed("text", "text_b"), "node").join(hub_texts, ["hub", "block"]).select("hub", "node", "block", "root", "text_a", "text_b")
        apart = table(both.mapInArrow(partial(_apart, key=secret), APART), f"apart-{level}")
        nearest = apart.groupBy("hub").agg(F.min(F.struct("e", "node")).alias("best"))
        least = table(copies.select("hub", "block").join(nearest, "hub").select("hub", "block", F.col("best.e").alias("least"), F.col("best.node").alias("best")), f"least-{level}")
        ready = apart.join(least, ["hub", "block"])
        # 7 (|x ^ h| + |y ^ h|) <= n + m: these link, whatever they share, and all such sets of a hub link with the nearest one
        sure = ready.filter("e + least <= 0 and node <> best").select("node", F.col("best").alias("other")).unionByName(apart.filter("linked").select("node", F.col("hub").alias("other")))
        sure = sure.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
        found = candidates(ready.select("hub", "node", "root", "n", "e", "tokens", "least").mapInArrow(partial(_sign_apart, buckets=4 * parts), BLOB), str(level + 1))
        fresh = table(once(found, str(level + 1)).join(tried, ["a", "b"], "left_anti"), f"fresh-{level}")
        links = links.unionByName(table(sure, f"sure-{level}")).unionByName(verified(fresh, str(level + 1)))
        roots, tried = connected(links, scratch, tables), tried.unionByName(fresh)
        group = table(group.join(large.select("hub"), "hub", "left_anti").unionByName(grouped(found, str(level + 1))).distinct(), f"left-{level}")
    for k, nearest in enumerate(NEAREST):
        now, hubs = open_groups(group, roots, str(k))
        each = now.join(hubs, "hub").join(nodes.select("node", "n", "packed"), "node")
        each = each.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        each = each.select("hub", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node", "n", "packed", "root")
        pairs = each.repartition(parts, "hub", "low", "high").sortWithinPartitions("hub", "low", "high").mapInArrow(partial(_across, nearest=nearest), ACROSS)
        pairs = pairs.groupBy("a", "b").agg(F.min(F.struct("hub", "low", "high")).alias("at"))  # each in one place
        rest = table(pairs.select("at.*", "a", "b").join(tried, ["a", "b"], "left_anti").select("hub", "low", "high", "a", "b"), f"rest-{k}")
        if rest.isEmpty() and nearest is None:
            break
        links = links.unionByName(settled(rest, roots, f"rest-{k}"))
        roots, tried = connected(links, scratch, tables), tried.unionByName(rest.select("a", "b"))
    named = members.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("low")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = scratch.table(named, "named")
    lowest = named.join(named.groupBy("root").agg(F.min("low").alias("component_id")), "root").select("node", "root", "component_id")
    for name in tables:
        scratch.drop(name)
    return members.join(lowest, "node", "left").select("doc_id", "key", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"), "root")


def link_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, key, n_shingles, component_id) of every row: the size of its set and the smallest id that links lead to, itself included.

    Words are lower-cased (A-Z) and a set holds distinct 5-word shingles; with fewer words the whole sequence is the only one. Two rows
    link when 100 * intersection >= 75 * union. Empty and null texts have no shingle and link with nothing; null ids are smaller than none, so
    a group of rows without ids has none. Equal sets are one node with many rows, so copies cost nothing; ``key`` is a hash of a row's id
    and text. Hashes are keyed by a secret of the run, so no text can be written to clash with another; names of sets have 128 bits.

    Sets that share a signature with others are first compared with one hub each. Of a large group that links leave apart, sets that differ from
    the hub in the same elements are candidates next, in at most DEEPER rounds; pairs within what is left are compared by sketches that
    only rule out what can't link, in blocks, and what these leave by the texts. Very long texts are whole sets in one row. An empty table has no
    rows, and other columns, whatever their names, don't matter.
    """
    return _rooted(docs, id_column, text_column).drop("root")


def one_of_each(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows without near duplicates: of each group that links connect, the row with the smallest id stays (null is the smallest); rows without
    shingles all stay, but of rows with the same id and the same text only one. Columns stay as they are.
    """
    groups = _rooted(docs, id_column, text_column).withColumn("id", F.coalesce("doc_id", F.lit(0)))
    first = groups.filter("n_shingles > 0").groupBy("root").agg(F.min(F.struct("doc_id", "key", "id")).alias("first")).select("first.id", "first.key")
    kept = first.union(groups.filter("n_shingles = 0").select("id", "key")).distinct()
    kept = Scratch(docs.sparkSession, "first").table(kept, "kept").select(F.col("id").alias("kept_id"), F.col("key").alias("kept_key"))
    number = F.col(id_column).cast("long")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.coalesce(number, F.lit(0)).alias("id"), F.xxhash64(number, F.coalesce(F.col(text_column), F.lit(""))).alias("key"))
    rows = rows.dropDuplicates(["id", "key"])  # combined before the shuffle, which the next join can use
    return rows.join(kept, (F.col("id") == F.col("kept_id")) & (F.col("key") == F.col("kept_key")), "left_semi").select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))
