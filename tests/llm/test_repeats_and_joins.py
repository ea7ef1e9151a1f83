from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np

from assayer.llm import fingerprints as P
from assayer.llm import ngram_join as N
from assayer.llm import suffix_dedup as S

from .conftest import prose, rows
from .test_fingerprints_and_packing import SCHEMA, shingle_set


def brute_repeats(texts: list[str], n: int) -> list[tuple]:
    raws = [(t or "").encode() for t in texts]
    often = Counter(r[i : i + n] for r in raws for i in range(len(r) - n + 1))
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - n + 1):
            if often[r[i : i + n]] > 1:
                gone[i : i + n] = b"\1" * n
        kept = bytes(c for c, g in zip(r, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out.append((len(r), len(r) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_repeats_agree_with_brute_force(spark, monkeypatch):
    r = random.Random(3)
    passages = [prose(1000 + i, 50) for i in range(6)]
    texts = [None, "", "short", "a" * 500, "ab" * 300, "é" * 250, prose(7, 200), prose(7, 200)]
    for i in range(60):
        parts = [prose(i, r.randint(1, 60)) for _ in range(3)]
        for _ in range(r.randint(0, 2)):
            p = r.choice(passages)
            a = r.randint(0, 60)
            parts.insert(1, p[a : a + r.randint(150, 330)])
        texts.append(" ".join(parts))
    docs = spark.createDataFrame(rows(texts), SCHEMA)
    want = dict(enumerate(brute_repeats(texts, 200)))
    for together in (S.TOGETHER, 2, 1):  # a small limit deals groups out by ever longer cores
        monkeypatch.setattr(S, "TOGETHER", together)
        got = {x["doc_id"]: (x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in S.remove_repeats(docs).collect()}
        assert got == want


def test_one_anchor_in_very_many_different_texts(spark):
    r = random.Random(6)
    line, passage = prose(60, 40)[:150], prose(61, 60)[:199]
    ends = [prose(700 + i, 12) for i in range(40)]
    texts = [f"{prose(10_000 + i, 9)}{(line, passage)[i % 2]}{r.choice(ends) if i % 5 == 0 else prose(50_000 + i, 9)}" for i in range(20_000)]
    docs = spark.createDataFrame(rows(texts), SCHEMA)
    got = {x["doc_id"]: (x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in S.remove_repeats(docs, keep_text=False).collect()}
    want = dict(enumerate(brute_repeats(texts, 200)))
    assert got == want and 0 < sum(x[1] > 0 for x in want.values()) < 20_000


def test_halves_share_all_windows_and_their_cores():
    raw, o = prose(8, 90).encode()[:300], 120  # windows 0 to 100 with the anchor from 120 to 20 bytes after their starts
    held = []
    for g1, g2, n1, n2, oo, lo, hi, part, base in S.halves(raw, o, 0, 177, 200):
        assert part == raw[base : base + len(part)] and oo == o - base
        held += range(base, base + len(part) - 199)
        for w in range(len(part) - 199):
            assert lo <= oo - w < hi and raw[o - lo : o - hi + 201] in part[w : w + 200]
    assert held == list(range(101))
    assert [h[5:7] for h in S.halves(raw[:200], 20, 20, 21, 200)] == [(20, 21)]


def test_repeats_edges(spark, edge, empty):
    assert S.remove_repeats(empty).count() == 0
    got = S.remove_repeats(edge.select("doc_id", "text", "key")).collect()
    assert len(got) == edge.count()
    assert all(x["n_removed"] == x["n_bytes"] for x in got if x["doc_id"] in (0, 1))


def test_deep_shallow_sort_orders_suffixes():
    rng = np.random.default_rng(2)
    data = np.concatenate([rng.integers(97, 99, 400), np.tile(rng.integers(97, 100, 60), 6), np.zeros(8, int)]).astype(np.uint8)
    starts = np.arange(700)
    order, classes = S.deep_shallow_sort(data, starts, 60)
    raw = data.tobytes()
    keys = [raw[s : s + 60] for s in starts[order]]
    assert keys == sorted(keys)
    assert all((a == b) == (x == y) for a, b, x, y in zip(keys, keys[1:], classes, classes[1:]))


def brute_groups(texts: list[str | None]) -> dict[int, tuple]:
    sets = [shingle_set(t) for t in texts]
    up = list(range(len(texts)))

    def top(i: int) -> int:
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            c = len(sets[i] & sets[j])
            if c and 100 * c >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                up[b] = a
    return {i: (len(s), top(i)) for i, s in enumerate(sets)}


def test_groups_agree_with_brute_force(spark):
    r = random.Random(8)
    texts: list[str | None] = [None, "", "  ", "one two", "ONE two", "one two three", "a b c d e", "a b c d e f"]
    common = prose(500, 40)
    for i in range(20):
        base = prose(i, r.randint(5, 150)).split()
        for _ in range(6):
            copy = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 12))):
                copy[r.randrange(len(copy))] = prose(r.randint(0, 9999), 1)
            texts.append((common + " " if r.random() < 0.4 else "") + " ".join(copy))
    docs = spark.createDataFrame(rows(texts), SCHEMA)
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in N.link_groups(docs).collect()}
    assert got == brute_groups(texts)


def boilerplate(n: int) -> list[str]:
    """Texts of which most share a long passage, whose own parts are too long to link them, but for copies with a few changes and further shared parts."""
    r = random.Random(18)
    shared, second = prose(901, 80), prose(902, 12)
    texts: list[str] = []
    for i in range(n):
        kind = r.random()
        if kind < 0.2 and texts:
            words = r.choice(texts).split()
            for _ in range(r.randint(0, 4)):
                words[r.randrange(len(words))] = prose(r.randint(0, 9999), 1)
            texts.append(" ".join(words))
        else:
            own = prose(3000 + i, r.randint(8, 24))
            texts.append(f"{own} {shared}" + (f" {second}" if kind < 0.6 else "") + (f" {prose(7000 + i, 6)}" if kind > 0.8 else ""))
    return texts


def test_large_groups_that_links_leave_apart(spark, monkeypatch):
    texts = boilerplate(160)
    docs, want = spark.createDataFrame(rows(texts), SCHEMA), brute_groups(texts)
    assert 20 < len({g for _, g in want.values()}) < 150
    monkeypatch.setattr(N, "BLOCK", 4)
    monkeypatch.setattr(N, "LARGE", 1)
    for deeper in (3, 1, 0):
        monkeypatch.setattr(N, "DEEPER", deeper)
        assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in N.link_groups(docs).collect()} == want


def test_words_that_polynomial_hashes_mix_up_are_told_apart(spark):
    a, b = "a", "b"
    while len(a) < 4096:
        a, b = a + b, b + a
    texts = [x for n in (1024, 2048, 4096) for x in (a[:n], b[:n])] + [f"one two three four {x[:2048]}" for x in (a, b)]
    docs = spark.createDataFrame(rows(texts), SCHEMA)
    assert [r["component_id"] for r in N.link_groups(docs).orderBy("doc_id").collect()] == list(range(len(texts)))
    assert len({r["fingerprint"] for r in P.fingerprint(docs).collect()}) == len(texts)


def test_one_of_repeated_rows_stays(spark):
    a, b = prose(40, 60), prose(41, 60)
    data = [(1, a, "x"), (1, a, "y"), (1, a, "x"), (2, b, "x"), (2, b, "x"), (3, "", "x"), (3, "", "x"), (None, None, "x"), (None, None, "y")]
    kept = N.one_of_each(spark.createDataFrame(data, "doc_id long, text string, extra string")).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept if r["text"] is not None) == [(1, a), (2, b), (3, "")] and len(kept) == 4


def test_sets_at_the_threshold_always_share_a_signature():
    rng = np.random.default_rng(5)
    plan = N.Allocation(rng.integers(0, 1000, 1 << N.COUNTER_BITS))
    for trial in range(600):
        b = int(rng.integers(1, 300 if trial % 3 else 12))
        a = int(rng.integers(-(-3 * b // 4), b + 1))
        shared = -(-75 * (a + b) // 175)
        if shared > a:
            continue
        pool = rng.integers(0, 2**64, a + b - shared, dtype=np.uint64)
        x, y = np.sort(pool[:a]), np.sort(np.concatenate([pool[:shared], pool[a:]]))
        s, owner, cut = N.signatures(np.concatenate([x, y]), np.array([0, a, a + b]), plan)
        part = lambda k, c: set(s[(owner == k) & (cut == c)].tolist())  # noqa: B023, E731
        assert part(0, False) & part(1, False) or part(0, False) & part(1, True) or part(0, True) & part(1, False)
        sk = N.sketches(np.concatenate([x, y]), np.array([0, a, a + b]))
        assert N.may_link(sk[0], sk[1], a, b)


def test_join_edges(spark, edge, empty):
    assert N.link_groups(empty).count() == 0 and N.one_of_each(empty).count() == 0
    got = N.link_groups(edge)
    assert got.count() == edge.count()
    kept = N.one_of_each(edge)
    assert kept.columns == edge.columns
    texts = [x["text"] for x in kept.collect()]
    assert len([t for t in texts if t and len(t) > 500 and t == t.lower()]) == len({t for t in texts if t and len(t) > 500 and t == t.lower()})


def test_unlinked_texts_with_null_or_shared_ids_all_stay(spark):
    a, b, c, d, e = (prose(70 + i, 60) for i in range(5))
    data = [(None, a), (None, b), (7, c), (7, d), (8, e), (9, e), (9, d + " more"), (None, e + " more"), (None, "")]
    kept = N.one_of_each(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert sorted((r["text"] for r in kept)) == sorted([a, b, c, d, e + " more", ""])


def test_every_start_of_a_long_text_is_in_one_segment(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(S, "_CHUNK", 1500)
    texts = [prose(1, 900), "ab" * 900, prose(2, 20), "x" * 1499, "y" * 1500, "z" * 1501, prose(3, 200)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array([7] * len(texts), pa.int64()), pa.array(texts)], ["k1", "k2", "text"])
    starts: dict[int, list[int]] = {}
    for out in S._segment_rows(iter([batch]), 200):
        for key, start, n in zip(*(out.column(out.schema.get_field_index(c)).to_pylist() for c in ("k1", "start", "n"))):
            starts.setdefault(key, []).extend(range(start, start + n))
    for key, text in enumerate(texts):
        assert sorted(starts.get(key, [])) == list(range(max(0, len(text) - 199)))


def written(spark, make) -> int:
    """Bytes that the stages of a call shuffle."""
    store = spark.sparkContext._jsc.sc().statusStore()

    def total() -> int:
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    before = total()
    make()
    return total() - before


def nearly_linked(n: int, shared: int = 1000, own: int = 172) -> list[tuple[int, str]]:
    """Texts of which all pairs stay just below the bound, by less than sketches tell: 996 shingles are common, and 172 a text's own."""
    rng = random.Random(7)
    words = lambda k: " ".join(f"{rng.getrandbits(160):040x}" for _ in range(k))  # noqa: E731  (longer than what compression looks back)
    passage = words(shared)
    return [(i, f"{passage} {words(own)}") for i in range(n)]


def test_join_shuffles_texts_and_not_pairs_of_them(spark):
    texts = nearly_linked(80)
    texts += [(80, texts[3][1] + " one more"), (81, texts[7][1] + " two more words")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = {}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        shuffled = written(spark, lambda: got.update({r.doc_id: r.component_id for r in N.link_groups(df).collect()}))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == {i: {80: 3, 81: 7}.get(i, i) for i in range(82)}
    assert shuffled < 20 * sum(len(t) for _, t in texts)  # 45 times when every pair carried its texts


def test_join_deals_out_long_sets_of_a_block(spark, monkeypatch):
    monkeypatch.setattr(N, "ELEMENTS", 5000)
    texts = nearly_linked(40)
    texts += [(40 + i, texts[i][1] + f" word{i} more") for i in range(6)]
    got = {r.doc_id: r.component_id for r in N.link_groups(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == {i: i if i < 40 else i - 40 for i in range(46)}
