"""Removing repeated passages: a suffix sort of the places where a long repeat can begin or end, dealt out by content-defined anchors.

A window is a string of ``length`` bytes that starts somewhere in a text. Of the grams of ``GRAM`` bytes in a window, the one with the
smallest hash (the leftmost of equals) is its anchor; equal windows have equal anchors at equal places. Windows that start next to each
other mostly share the anchor: such a run of starts is a segment, named by a digest of its bytes. What shares its anchor with nothing is
unique. Of all else, one place of each segment and a second one if it has several are sorted: deep-shallow sorting decides about every window.

An anchor that many different segments share, such as one in a common line, is dealt out by more of the windows' own bytes: the places that
the anchor can have in a window are halved, and all windows of a half have the bytes in common that any of them must hold, the core. Equal
windows are in the same half and have the same core, so cores are groups like anchors are, again with segments that are named and counted,
and halved again where a core is common. Once only one place is left the core is the window, so this ends after a few rounds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayer.llm.common import Scratch, mix64, powers, prefix_hash, shuffle_parts, small_batches, text_buffer

GRAM = 24
#: Bytes that the multikey quicksort looks at before blind tries take over; a multiple of 8.
SHALLOW = 24
#: Tries of two leaves that are built at once.
_PAIRS = 1 << 14
#: Different segments of one anchor or core that are sorted together; those of a more common one are dealt out by longer cores.
TOGETHER = 1024
_PLACE = np.uint64((1 << 22) - 1)
_CHUNK = 1 << 21  # bytes looked at at a time, below what _PLACE can hold


# ---------------------------------------------------------------- segments


def segments(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Anchor hash, text number, first start (in ``data``), number of starts, and distance from the first start to the anchor, of each segment."""
    none = (np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(4)))
    n = len(data)
    if n < length:
        return none
    c, inverse = prefix_hash(data), powers(n + 1)[1]
    grams = mix64((c[GRAM:] - c[:-GRAM]) * inverse[: n - GRAM + 1])  # equal grams must have equal hashes; nothing needs more
    width = length - GRAM + 1
    keyed = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
    padded = np.full(-(-len(keyed) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(keyed)] = keyed
    blocks = padded.reshape(-1, width)
    head = np.minimum.accumulate(blocks, axis=1).ravel()
    tail = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    anchor = (np.minimum(tail[: n - length + 1], head[width - 1 : width + n - length]) & _PLACE).astype(np.int64)
    step = np.zeros(n + 1, np.int32)
    long = np.flatnonzero(np.diff(offsets) >= length)
    if not len(long):
        return none
    np.add.at(step, offsets[long], 1)
    np.add.at(step, offsets[long + 1] - length + 1, -1)
    valid = np.cumsum(step[: n - length + 1]) > 0
    new = valid.copy()
    new[1:] &= (anchor[1:] != anchor[:-1]) | ~valid[:-1]
    first = np.flatnonzero(new)
    starts = np.flatnonzero(valid)
    count = np.diff(np.append(np.searchsorted(starts, first), len(starts)))
    return grams[anchor[first]], np.searchsorted(offsets, first, "right") - 1, first, count, anchor[first] - first


def digests(raw: memoryview, starts: list[int], ends: list[int]) -> np.ndarray:
    """128-bit digests of slices, as rows of two 64-bit numbers."""
    return np.frombuffer(b"".join([hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(starts, ends)]), "<i8").reshape(-1, 2)


#: g1, g2: the anchor, or the digest of a core; n1, n2: the name of the segment; k1, k2: the text.
SEGMENTS = "g1 long, n1 long, n2 long, k1 long, k2 long, start int, n int, o int"


def _segment_rows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Segments of texts (k1, k2, text)."""
    names = ["g1", "n1", "n2", "k1", "k2", "start", "n", "o"]
    for batch in small_batches(batches, most=_CHUNK // 2):
        k1, k2 = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        data, offsets = text_buffer(batch.column(2))
        if len(data) <= _CHUNK:
            parts = [(data, offsets, 0, np.arange(len(k1)))]
        else:  # a text that is longer is looked at in chunks; every start is in one of them
            parts = []
            for i, (a, b) in enumerate(zip(offsets.tolist(), offsets[1:].tolist())):
                for x in range(a, max(a + 1, b - length + 1), _CHUNK - length):
                    y = min(b, x + _CHUNK - 1)
                    parts.append((data[x:y], np.array([0, y - x]), x - a, np.array([i])))
        for piece, bounds, shift, owner in parts:
            anchor, text, first, count, o = segments(piece, bounds, length)
            named = digests(memoryview(piece), first.tolist(), (first + count - 1 + length).tolist())
            place = first - bounds[text] + shift
            columns = [anchor.view(np.int64), named[:, 0], named[:, 1], k1[owner[text]], k2[owner[text]], *(x.astype(np.int32) for x in (place, count, o))]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in columns], names)


# ---------------------------------------------------------------- deep-shallow sort


def _symbols(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes at each place as one big-endian number."""
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, 8)[at]).view(">u8").ravel().astype(np.uint64)


class BlindTrie:
    """A compacted trie that keeps only branching depths and bytes. Strings are compared once each, with the leaf a blind descent finds."""

    def __init__(self, length: int):
        self.length, self.root = length, None

    def insert(self, text: bytes, name: int) -> None:
        if self.root is None:
            self.root = (text, [name])
            return
        node = self.root
        while len(node) == 3:  # (depth, children by byte, any child)
            node = node[1].get(text[node[0]]) or node[2]
        if node[0] == text:
            node[1].append(name)
            return
        other = node[0]
        differ = (int.from_bytes(text, "big") ^ int.from_bytes(other, "big")).bit_length()
        depth = self.length - (differ + 7) // 8
        parent, byte, node = None, 0, self.root
        while len(node) == 3 and node[0] < depth:
            parent, byte = node, text[node[0]]
            node = node[1][byte]
        leaf = (text, [name])
        if len(node) == 3 and node[0] == depth:
            node[1][text[depth]] = leaf
            return
        fork = (depth, {other[depth]: node, text[depth]: leaf}, leaf)
        if parent is None:
            self.root = fork
        else:
            parent[1][byte] = fork

    def leaves(self) -> Iterator[list[int]]:
        """Names of equal strings, in the order of the strings."""
        stack = [self.root]
        while stack:
            node = stack.pop()
            if len(node) == 3:
                stack += [node[1][b] for b in sorted(node[1], reverse=True)]
            else:
                yield node[1]


def deep_shallow_sort(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorts the ``length``-byte strings at ``starts``: their order, and the number of each one's class of equal strings, in that order.

    Shallow: multikey quicksort with symbols of eight bytes; at each depth all groups are split by their next symbol in one vectorised
    sort. Deep: what still agrees after SHALLOW bytes is inserted into a blind trie for each group.
    """
    order, group = np.arange(len(starts)), np.zeros(len(starts), np.int64)
    for depth in range(0, SHALLOW, 8):
        symbol = _symbols(data, starts[order] + depth)
        by = np.lexsort((symbol, group))
        order, symbol, group = order[by], symbol[by], group[by]
        group = np.cumsum(np.concatenate([[0], (symbol[1:] != symbol[:-1]) | (group[1:] != group[:-1])]))
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    sizes = np.diff(np.append(first, len(order)))
    raw, large = data.tobytes(), sizes > 2
    equal = np.zeros(len(order), bool)  # the same class as the one before
    a = first[sizes == 2]  # tries of two leaves: the first byte that differs, of all of them at once
    for a in (a[i : i + _PAIRS] for i in range(0, len(a), _PAIRS)):
        rows = np.lib.stride_tricks.sliding_window_view(data, length - SHALLOW)
        x, y = rows[starts[order[a]] + SHALLOW], rows[starts[order[a + 1]] + SHALLOW]
        differ = x != y
        at, each = differ.argmax(axis=1), np.arange(len(a))
        equal[a + 1] = ~differ[each, at]
        swap = a[x[each, at] > y[each, at]]
        order[swap], order[swap + 1] = order[swap + 1], order[swap].copy()
    for a, m in zip(first[large].tolist(), sizes[large].tolist()):
        trie, own = BlindTrie(length - SHALLOW), order[a : a + m]
        for name, s in zip(own.tolist(), starts[own].tolist()):
            trie.insert(raw[s + SHALLOW : s + length], name)
        at = a
        for leaf in trie.leaves():
            order[at : at + len(leaf)] = leaf
            equal[at + 1 : at + len(leaf)] = True
            at += len(leaf)
    return order, np.cumsum(~equal)


#: A segment of a group, or a part of one: its bytes, a number to deal it by if not by its group, and for parts the name of the segment they are
#: from (none if that is repeated as a whole) and their place in it.
_LONG, _INT = pa.int64(), pa.int32()
PART = [("g1", _LONG), ("g2", _LONG), ("n1", _LONG), ("n2", _LONG), ("o", _INT), ("lo", _INT), ("hi", _INT), ("bytes", pa.binary()), ("deal", _LONG), ("h1", _LONG), ("h2", _LONG), ("m1", _LONG), ("m2", _LONG), ("base", _INT)]
#: What sorting gives: intervals of repeated starts in a segment; parts of common groups pass through.
SORTED = [*PART, ("low", _INT), ("high", _INT)]


def _ddl(fields: list[tuple[str, pa.DataType]]) -> str:
    kinds = {_LONG: "long", _INT: "int", pa.binary(): "binary"}
    return ", ".join(f"{name} {kinds[kind]}" for name, kind in fields)


def _batch(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(columns, fields)], [name for name, _ in fields])


def halves(raw: bytes, o: int, lo: int, hi: int, length: int) -> list[tuple]:
    """(core digest, part's digest, o, lo, hi, bytes, base) of the one or two halves of a segment whose windows have the anchor at lo to hi - 1."""
    middle, n, out = (lo + hi) // 2, len(raw) - length + 1, []
    cut = min(n, max(0, o - middle + 1))  # windows before it have the anchor at middle or later
    for a, b, x, y in ((0, cut, middle, hi), (cut, n, lo, middle)):
        if a < b:
            part, core = raw[a : b - 1 + length], raw[o - x : o - (y - 1) + length]
            digest = hashlib.blake2b(core, digest_size=16, salt=x.to_bytes(4, "big") + y.to_bytes(4, "big")).digest()
            name = hashlib.blake2b(part, digest_size=16).digest()
            numbers = (int.from_bytes(d[i : i + 8], "little", signed=True) for d in (digest, name) for i in (0, 8))
            out.append((*numbers, o - a, x, y, part, a))
    return out


def _deal(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Rows of PART up to the bytes, whether the group is common, the number of the place and whether there are two of them.

    Segments of common groups come as their halves, and their two places, to be compared with each other, by themselves.
    """
    for batch in small_batches(batches, text="bytes", most=2 << 20):
        out = []
        for g1, g2, n1, n2, o, lo, hi, raw, common, place, two in zip(*(c.to_pylist() for c in batch.columns)):
            common = common and hi - lo > 1
            if common and not place:
                owner = (None,) * 4 if two else (g1, g2, n1, n2)
                out += [(*half[:-1], half[2], *owner, half[-1]) for half in halves(raw, o, lo, hi, length)]
            if two or not common:
                out.append((g1, g2, n1, n2, o, lo, hi, raw, n1 if common else 0, None, None, None, None, None))
        yield _batch(out, PART)


def _sort_block(rows: list[tuple], length: int) -> list[tuple]:
    """rows: (g1, g2, n1, n2, bytes, deal), whole groups or, where ``deal`` isn't 0, the two places of a segment. Intervals of starts whose windows start elsewhere, too, as rows of SORTED."""
    rest, out = [], []
    for row in rows:
        if rest and rest[-1] == row:  # two places of one segment: equal strings, so every window is repeated
            out.append((row, 0, len(row[4]) - length))
        else:
            rest.append(row)
    rest = [r for r in rest if not r[5]]
    several = [i > 0 and rest[i - 1][:2] == r[:2] or i + 1 < len(rest) and rest[i + 1][:2] == r[:2] for i, r in enumerate(rest)]
    rest = [r for r, s in zip(rest, several) if s]
    if rest:
        data = np.frombuffer(b"".join(r[4] for r in rest) + b"\0" * 8, np.uint8)
        sizes = np.array([len(r[4]) for r in rest], np.int64)
        base, counts = np.cumsum(sizes) - sizes, sizes - length + 1
        owner = np.repeat(np.arange(len(rest)), counts)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        order, classes = deep_shallow_sort(data, base[owner] + within, length)
        twice = np.zeros(len(order), bool)
        same = classes[1:] == classes[:-1]
        twice[1:] |= same
        twice[:-1] |= same
        repeated = np.zeros(len(order), bool)
        repeated[order] = twice
        new = repeated.copy()
        new[1:] &= ~repeated[:-1] | (owner[1:] != owner[:-1])
        first = np.flatnonzero(new)
        hits = np.flatnonzero(repeated)
        high = hits[np.append(np.searchsorted(hits, first)[1:], len(hits)) - 1] if len(first) else first
        out += [(rest[k], a, b) for k, a, b in zip(owner[first].tolist(), within[first].tolist(), within[high].tolist())]
    return [(*row[:4], *([None] * (len(PART) - 4)), a, b) for row, a, b in out]


def _sort_groups(batches: Iterator[pa.RecordBatch], length: int, most: int = 100_000) -> Iterator[pa.RecordBatch]:
    """Rows of PART, sorted by group and name. Groups are sorted, some at a time; parts pass through."""
    held, size, last = [], 0, None
    for batch in batches:
        parts = batch.filter(batch.column(batch.schema.get_field_index("base")).is_valid())
        if parts.num_rows:
            nothing = pa.nulls(parts.num_rows, _INT)
            yield pa.RecordBatch.from_arrays([*parts.columns, nothing, nothing], [name for name, _ in SORTED])
        whole = batch.filter(batch.column(batch.schema.get_field_index("base")).is_null())
        for row in zip(*(whole.column(k).to_pylist() for k in (0, 1, 2, 3, 7, 8))):
            if size >= most and row[:2] != last:
                yield _batch(_sort_block(held, length), SORTED)
                held, size = [], 0
            last = row[:2]
            held.append(row)
            size += len(row[4]) - length + 1
    if held:
        yield _batch(_sort_block(held, length), SORTED)


CUT = [*PART[:8], ("common", _INT), ("place", _INT), ("two", _INT)]


def _cut_segments(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The bytes of the wanted segments of each text, and whether their anchor is common."""
    for batch in small_batches(batches):
        out = []
        for text, wanted in zip(batch.column(0), batch.column(1).to_pylist()):
            raw = text.as_buffer().to_pybytes()
            for w in wanted:
                out.append((w["g1"], 0, w["n1"], w["n2"], w["o"], 0, length - GRAM + 1, raw[w["start"] : w["start"] + w["n"] - 1 + length], w["common"], w["place"], w["two"]))
        yield _batch(out, CUT)


# ---------------------------------------------------------------- the operator


def _kinds(places: DataFrame, group: list[str], one: list[str], same: list[str], slices: int = 1) -> DataFrame:
    """Segments that another one is or may be like: their group, name, ``same`` columns, two of their places, and whether the group is common.

    ``slices`` deals the names of a group to so many tasks when they meet the group's count, which is summed from counts of the slices that are there.
    """
    name = [*group, "n1", "n2"]
    found = places.groupBy(*name).agg(
        F.count(F.lit(1)).alias("times"), *(F.first(c).alias(c) for c in same), *(F.first(c).alias(f"first_{c}") for c in one), *(F.last(c).alias(f"last_{c}") for c in one)
    )
    # the first and the last row of a name are two places, if it has several; any two will do
    by = group
    if slices > 1:
        found, by = found.withColumn("slice", F.pmod("n1", F.lit(slices)).cast("int")), [*group, "slice"]
    several = found.groupBy(*by).agg(F.count(F.lit(1)).alias("segs"))
    if slices > 1:
        several = several.withColumn("segs", F.sum("segs").over(Window.partitionBy(*group)))
    return found.join(several, by).filter("times > 1 or segs > 1").select("*", (F.col("segs") > TOGETHER).cast("int").alias("common"), (F.col("times") > 1).cast("int").alias("two"))


def _places(kinds: DataFrame, one: list[str], keep: list[str]) -> DataFrame:
    """One or two rows of each kind, with the number of the place."""
    sides = [F.struct(*(F.col(f"{side}_{c}").alias(c) for c in one)) for side in ("first", "last")]
    found = F.when(F.col("two") > 0, F.array(*sides)).otherwise(F.array(sides[0]))
    return kinds.select("*", F.posexplode(found).alias("place", "at")).select(*keep, "at.*", "common", "place", "two")


def repeated_starts(docs: DataFrame, length: int, scratch: Scratch) -> DataFrame:
    """(k1, k2, low, high): byte intervals of starts, both ends included, at which a window starts that starts elsewhere, too. docs: (k1, k2, text)."""
    parts = shuffle_parts(docs.sparkSession)
    found = scratch.table(docs.mapInArrow(partial(_segment_rows, length=length), SEGMENTS), "segments")
    kinds = scratch.table(_kinds(found, ["g1"], ["k1", "k2", "start"], ["n", "o"]), "kinds")  # without segments that nothing else can be like
    wanted = _places(kinds, ["k1", "k2", "start"], ["g1", "n1", "n2", "n", "o"])
    by_text = wanted.groupBy(F.col("k1").alias("at1"), F.col("k2").alias("at2")).agg(F.collect_list(F.struct("g1", "n1", "n2", "start", "n", "o", "common", "place", "two")).alias("wanted"))
    joined = docs.join(by_text, (F.col("k1") == F.col("at1")) & (F.col("k2") == F.col("at2"))).select("text", "wanted")
    cut = joined.mapInArrow(partial(_cut_segments, length=length), _ddl(CUT))
    levels: list[DataFrame] = []
    while True:
        dealt = cut.mapInArrow(partial(_deal, length=length), _ddl(PART)).repartition(parts, "g1", "g2", "deal").sortWithinPartitions("g1", "g2", "n1", "n2")
        levels.append(scratch.table(dealt.mapInArrow(partial(_sort_groups, length=length), _ddl(SORTED)), f"sorted{len(levels)}"))
        halved = levels[-1].filter("base is not null")
        if halved.isEmpty():
            break
        kinds = _kinds(halved, ["g1", "g2"], ["bytes"], ["o", "lo", "hi"], slices=64)
        cut = _places(kinds, ["bytes"], ["g1", "g2", "n1", "n2", "o", "lo", "hi"])
    name, whose = ["g1", "g2", "n1", "n2"], ["h1", "h2", "m1", "m2"]
    marks = levels[-1].filter("low is not null").select(*name, "low", "high")
    for level in levels[-2::-1]:  # from parts to what they are parts of
        by_name = marks.groupBy(*name).agg(F.collect_set(F.struct("low", "high")).alias("marks"))
        placed = level.filter("h1 is not null").select(*name, *whose, "base").join(by_name, name).withColumn("mark", F.explode("marks"))
        up = placed.select(*(F.col(h).alias(g) for h, g in zip(whose, name)), (F.col("base") + F.col("mark.low")).alias("low"), (F.col("base") + F.col("mark.high")).alias("high"))
        marks = level.filter("low is not null").select(*name, "low", "high").unionByName(up)
    places = found.join(marks.drop("g2"), ["g1", "n1", "n2"])
    out = scratch.table(places.select("k1", "k2", (F.col("start") + F.col("low")).alias("low"), (F.col("start") + F.col("high")).alias("high")), "starts")
    for table in ("segments", "kinds", *(f"sorted{k}" for k in range(len(levels)))):
        scratch.drop(table)
    return out


def spans_of(lows: np.ndarray, highs: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of bytes covered by the windows at the starts."""
    by = np.argsort(lows, kind="stable")
    lows, ends = lows[by], np.maximum.accumulate(highs[by] + length)
    new = np.concatenate([[True], lows[1:] > ends[:-1]])
    last = np.append(np.flatnonzero(new)[1:], len(lows)) - 1
    return lows[new], ends[last]


RESULT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string"


def _remove(batches: Iterator[pa.RecordBatch], length: int, keep: bool) -> Iterator[pa.RecordBatch]:
    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())]
    for batch in small_batches(batches):
        out = []
        for doc, text, starts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            raw = (text or "").encode()
            kept, removed, spans = raw, 0, 0
            if starts.is_valid and len(starts.values):
                a, b = spans_of(starts.values.field(0).to_numpy(), starts.values.field(1).to_numpy(), length)
                kept = b"".join(raw[x:y] for x, y in zip([0, *b.tolist()], [*a.tolist(), len(raw)]))
                removed, spans = len(raw) - len(kept), len(a)
            out.append((doc, len(raw), removed, spans, hashlib.sha256(kept).hexdigest(), kept.decode(errors="replace") if keep else None))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(list(zip(*out)) or [()] * 6, fields)], [n for n, _ in fields])


def remove_repeats(docs: DataFrame, length: int = 200, keep_text: bool = True, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept): every text without the bytes of ``length``-byte strings that start elsewhere, too.

    Texts are UTF-8 bytes, null counts as empty, and strings don't cross texts. Repeated rows are each other's repeats. In ``kept`` a
    character cut in two shows as U+FFFD; it is null unless ``keep_text``. An empty table has no rows; other columns of the table, whatever
    their names, don't matter. Very long texts are looked at in chunks, but held whole, as one row, where bytes are cut out of them.
    Segments, what is sorted, and starts are tables in the scratch folder that grow with the input. A passage that is copied often is one
    segment with two places to sort, and the joins back to its places are split where skewed; an anchor that many passages share is dealt
    out by their bytes. So no group of more than TOGETHER segments meets in a task.
    """
    if length < SHALLOW + 8 or length < GRAM + 1:
        raise ValueError(f"length must be {SHALLOW + 8} at least")
    scratch = Scratch(docs.sparkSession, "suffix")
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    rows = rows.withColumn("k1", F.coalesce("doc_id", F.lit(0))).withColumn("k2", F.xxhash64("doc_id", "text"))  # 128 bits name a row
    starts = repeated_starts(rows.select("k1", "k2", "text"), length, scratch)
    by_text = starts.distinct().groupBy(F.col("k1").alias("at1"), F.col("k2").alias("at2")).agg(F.collect_list(F.struct("low", "high")).alias("starts"))
    joined = rows.join(by_text, (F.col("k1") == F.col("at1")) & (F.col("k2") == F.col("at2")), "left").select("doc_id", "text", "starts")
    return joined.mapInArrow(partial(_remove, length=length, keep=keep_text), f"doc_id long, {RESULT}")
