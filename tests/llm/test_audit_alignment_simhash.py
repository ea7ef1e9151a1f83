from __future__ import annotations

import hashlib
import os
import random
import re
from collections import Counter, defaultdict
from itertools import combinations, permutations

import numpy as np
import pytest

from assayer.llm import alignment, filter_audit, simhash

from .conftest import DOCS, prose, rows

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


# ---------------------------------------------------------------- filter audit


def brute_audit(data: list[tuple], labels: list[tuple]) -> set[tuple]:
    good, toxic = ({d for d, *v in labels if d is not None and v[k] == 1} for k in (0, 1))
    low = lambda d: (d is not None, d or 0)
    first: dict[str, tuple] = {}
    for d, t, *_ in data:
        first[t or ""] = min(first.get(t or "", (True, float("inf"))), low(d))
    masks = []
    for d, t, _, source, *_ in data:
        t = t or ""
        w = WORDS.findall(t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": first[t] < low(d)}
        masks.append((source or "", {c for c, f in fails.items() if f}, d in good, d in toxic))
    out, removed_by = {}, Counter()
    for part in {m[0] for m in masks}:
        for order in map("".join, permutations("ABCDE")):
            left = [m for m in masks if m[0] == part]
            before: set = set()
            for step, c in enumerate(order, 1):
                here, kept = [m for m in left if c in m[1]], [m for m in left if c not in m[1]]
                redundant = sum(m[0] == part and c in m[1] and bool(m[1] & before) for m in masks)
                alone = sum(m[0] == part and m[1] == {c} for m in masks)
                out[part, order, step] = (len(kept), len(here), redundant, alone, sum(m[2] for m in here), sum(m[3] for m in here))
                removed_by[part, c] += len(here)
                left, before = kept, before | {c}
    return {(*k, *v, removed_by[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


NAMES = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audited(docs, labels) -> set[tuple]:
    found = [tuple(r[c] for c in NAMES) for r in filter_audit.audit(docs, labels).collect()]
    assert len(found) == len(set(found))
    return set(found)


def some_documents() -> list[tuple]:
    r, texts = random.Random(5), []
    for i in range(150):
        t = prose(i % 70, r.choice([40, 210, 260]))
        texts.append(r.choice([t, t.upper(), t + " #", t + " " + t, "word " * 300, "", None, "NO " * 250 + "&"]))
    return rows(texts) + [(7, "NO " * 250 + "&", "en", None, 1), (None, "word " * 300, "en", "s0", 1), (None, "word " * 300, "en", "s0", 1), (151, "word " * 300, None, "", None)]


@pytest.mark.parametrize("parts", [1, 7])
def test_audit_by_brute_force(spark, parts):
    data = some_documents()
    random.Random(1).shuffle(data)
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(0, 150, 2)] + [(4, None, None), (4, 1, None), (None, 1, 1), (900, 1, 1)]
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = audited(spark.createDataFrame(data, DOCS).repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == brute_audit(data, labels)


def test_runs_over_many_partitions_and_batches(spark):
    """One text in all of several partitions, with ids that repeat; batches of three rows."""
    data = [(i // 2, "same text", "en", "s", 1) for i in range(60)] + [(i, f"text {i % 5}", "en", "t", 1) for i in range(40)]
    for name, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", "3"), ("spark.sql.shuffle.partitions", "9")):
        spark.conf.set(name, value)
    try:
        got = audited(spark.createDataFrame(data, DOCS).repartition(5), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == brute_audit(data, [])


def test_audit_of_any_rows(spark, edge, empty):
    labels = spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int")
    data = [tuple(r)[:5] for r in edge.collect()]
    assert audited(edge.withColumn("part", edge["key"]).withColumn("fingerprint", edge["key"]), labels) == brute_audit(data, [(0, 1, 0)])
    assert audited(empty, labels) == set()


def test_counters_of_parts_add_up(spark):
    data = some_documents()
    docs, labels = spark.createDataFrame(data, DOCS), spark.createDataFrame([(2, 1, 1)], "doc_id long, quality int, toxic int")
    parts = filter_audit.counters(docs, labels).collect()
    (whole,) = filter_audit.counters(docs.withColumn("source", docs["text"].substr(1, 0)).fillna({"source": ""}), labels).collect()
    for c in ("n", "good", "toxic"):
        assert np.array([r[c] for r in parts]).sum(axis=0).tolist() == whole[c]


# ---------------------------------------------------------------- alignment

tokenizers = pytest.mark.skipif(not os.path.isdir("/opt/tokenizers"), reason="no tokenizers")


def vocabularies() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def brute_alignment(data: list[tuple]) -> dict:
    """Each whole text through both tokenizers at once, and all pairs of tokens compared."""
    import sentencepiece
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import ByteLevel

    a_path, b_path = vocabularies()
    a, b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
    a.encode_special_tokens = True
    shown = {c: bytes([i]) for i in range(256) for c in [None]}
    alphabet = sorted(ByteLevel.alphabet())
    shown = {}
    rest = 256
    for i in range(256):
        if chr(i) in alphabet:
            shown[chr(i)] = bytes([i])
    for i in range(256):
        if bytes([i]) not in shown.values():
            shown[chr(rest)] = bytes([i])
            rest += 1
    out = []
    for doc, t, *_ in data:
        raw = (" " + (t or "")).encode()
        x = [(i, b"".join(shown[c] for c in a.id_to_token(i))) for i in a.encode(" " + t, add_special_tokens=False).ids] if t else []
        y = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(t)] if t else []
        if b"".join(v for _, v in x) != raw or b"".join(v for _, v in y) != raw:
            x = y = []
        spans = []
        for side in (x, y):
            at, here = 0, []
            for i, v in side:
                here.append((i, at, at + len(v)))
                at += len(v)
            spans.append(here)
        links = [(p[0], q[0]) for p in spans[0] for q in spans[1] if p[1] < q[2] and q[1] < p[2]] if len(spans[0]) < 600 else None
        ends = sorted({p[2] for p in spans[0]} & {q[2] for q in spans[1]})
        string = ";".join("|".join(",".join(str(p[0]) for p in side if lo < p[2] <= hi) for side in spans) for lo, hi in zip([0, *ends], ends)) if len(spans[0]) < 600 else None
        out.append((doc, len(x), len(y), len(ends), links, string))
    held = Counter(pair for row in out for pair in set(row[4] or ()))
    top = defaultdict(int)
    for (p, _), n in held.items():
        top[p] = max(top[p], n)
    return [(d, n_a, n_b, n_g, len(links), sum(held[p] == top[p[0]] for p in links), sum(held[p] for p in links), hashlib.sha256(s.encode()).hexdigest() if n_a else "") for d, n_a, n_b, n_g, links, s in out]


ODD = ["naïve café  two  blanks", "\n\t lines\r\n \n and\n\n tabs ", "   ", " ", "a", "日本語 テキスト 🙂🙂 ok", "it's we'll I'D 12345 6,7.8", "<|endoftext|> and <s> and </s> <0x41>", "piece▁mark here", "x y z ​ q", "\x00\x01 \x1c a", "a" * 300, "é" * 40, "﻿ start", "end ", None, "", "tab\there", "A B C d e f", "-- ... !!! a.b"]


@tokenizers
@pytest.mark.parametrize("chunk", [(1 << 20, 1 << 20), (200, 50)])
def test_alignment_by_brute_force(spark, chunk):
    r = random.Random(3)
    texts = ODD + [" ".join(r.choice([prose(i, 30), *[t for t in ODD if t]]) for _ in range(4)) for i in range(25)]
    texts = [t if t is None or len(t) < 900 else t[:900] for t in texts]
    data = rows(texts) + [(0, texts[0], None, None, None), (None, texts[5], None, None, None)]
    found = alignment.align(spark.createDataFrame(data, DOCS).repartition(3), *vocabularies(), chunk_bytes=chunk[0], chunk_pairs=chunk[1])
    got = [tuple(x) for x in found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()]
    assert Counter(got) == Counter(brute_alignment(data))


@tokenizers
def test_groups_hold_the_same_bytes(spark):
    """Groups read back give the ids of both tokenizers, and both sides of a group the same bytes."""
    aligner = alignment.Aligner(*vocabularies())
    texts = [t for t in ODD if t] + [prose(i, 400) for i in range(5)]
    docs = spark.createDataFrame(rows(texts), DOCS)
    for r in alignment.token_groups(docs, *vocabularies()).collect():
        if not r["groups"]:
            assert "▁" in texts[r["doc_id"]]
            continue
        raw = b""
        for g in r["groups"].split(";"):
            a, b = ([int(i) for i in side.split(",")] for side in g.split("|"))
            x, y = b"".join(aligner.a_bytes[i] for i in a), b"".join(aligner.b_bytes[i] for i in b)
            assert x == y
            raw += x
        assert raw == (" " + texts[r["doc_id"]]).encode()


@tokenizers
def test_pair_counts(spark):
    from assayer.llm.common import Scratch

    docs = spark.createDataFrame(rows(["one two", "one two", "one", "one one"]), DOCS)
    rows_ = alignment.encoded(docs, *vocabularies(), Scratch(spark, "test")).filter("place is not null")
    found = {(r["a"], r["b"]): (r["count"], r["best"]) for r in alignment.pair_counts(rows_).collect()}
    assert max(n for n, _ in found.values()) == 4 and all(b for _, b in found.values())


@tokenizers
def test_alignment_of_any_rows(spark, edge, empty):
    docs = edge.selectExpr("*", "1 as chunk", "2 as place", "3 as a", "4 as n", "5 as count")
    got = alignment.align(docs, *vocabularies()).collect()
    assert len(got) == edge.count()
    by_text = {t: (r["n_a"], r["groups_sha256"]) for r in got for t in [r["doc_id"]]}
    assert by_text[3] == (0, "") and by_text[8][0] > 60_000
    assert all(r["n_links"] == r["n_a"] + r["n_b"] - r["n_groups"] and r["n_best"] <= r["n_links"] <= r["count_sum"] for r in got)
    assert alignment.align(empty, *vocabularies()).collect() == []


# ---------------------------------------------------------------- SimHash


def brute_print(text: str | None) -> int:
    import xxhash

    w = WORDS.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(prints: list[int]) -> list[int]:
    root = list(range(len(prints)))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(prints)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 2:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return [find(i) for i in range(len(prints))]


def test_fingerprints_by_brute_force(spark):
    texts = ["", None, " \n ", "One", "one two", "one Two three", "ÉCOLE école a b c", "a  b\t\nc\x0bd\x0ce f", prose(1, 500), "x " * 1000, prose(2, 3) + "\x1c" + "y z"]
    got = {r["doc_id"]: r["fingerprint"] for r in simhash.near_groups(spark.createDataFrame(rows(texts), DOCS)).collect()}
    assert got == {i: f"{brute_print(t):016x}" for i, t in enumerate(texts)}


def test_long_texts_are_read_in_pieces():
    text = prose(4, 3000).encode()
    whole = simhash.fingerprint(text)
    pieces = simhash._word_lists
    try:
        for most in (1, 7, 5000):
            simhash._word_lists = lambda raw, most=most: pieces(raw, most)
            assert simhash.fingerprint(text) == whole == brute_print(text.decode())
    finally:
        simhash._word_lists = pieces


def test_golay_code_is_perfect():
    words = np.arange(1 << 23, dtype=np.uint32)
    number = simhash.decode(words)
    low, high, errors = simhash._tables()
    near = words ^ errors[low[words & 0xFFF] ^ high[words >> 12]]
    assert np.bitwise_count(near ^ words).max() == 3 and np.array_equal(near >> 11, number)
    assert np.bincount(number).tolist() == [2048] * 4096


@pytest.mark.parametrize("width", [21, 22, 23])
def test_words_two_bits_apart_share_a_codeword(width):
    r = np.random.default_rng(width)
    x = r.integers(0, 1 << width, 400, dtype=np.uint32)
    own = [set() for _ in x]
    for i, c in zip(*simhash.near_codewords(x, width)):
        own[i].add(int(c))
    assert max(map(len, own)) <= 6
    for p, q in combinations(range(width), 2):
        other = x ^ np.uint32(1 << p | 1 << q)
        row, number = simhash.near_codewords(other, width)
        assert {int(i) for i, c in zip(row, number) if int(c) in own[i]} == set(range(len(x)))


def near_prints(seed: int, n: int, bits: int) -> list[int]:
    """Prints around a few centres, so that chains and large groups come about."""
    r, out = random.Random(seed), set()
    centres = [r.getrandbits(64) for _ in range(5)]
    while len(out) < n:
        x = r.choice([*centres, r.getrandbits(64)])
        for _ in range(r.randint(0, bits)):
            x ^= 1 << r.randrange(64)
        out.add(x)
    return sorted(out)


@pytest.mark.parametrize("pairwise", [0, 2000])
def test_groups_within_a_bucket(pairwise, monkeypatch):
    monkeypatch.setattr(simhash, "PAIRWISE", pairwise)
    prints = near_prints(1, 600, 4)
    assert simhash.groups(np.array(prints, np.uint64)).tolist() == brute_groups(prints)


@pytest.mark.parametrize("large", [4, 4096])
def test_links_connect_what_brute_force_does(spark, large):
    from assayer.llm.common import Scratch, mix64

    prints = near_prints(2, 1500, 5)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    scratch = Scratch(spark, "test")
    links = scratch.table(simhash.link_prints(spark.createDataFrame([(p,) for p in signed], "print long"), scratch, large), "links")
    names = mix64(np.array(prints, np.uint64)).view(np.int64).tolist()
    place = {n: i for i, n in enumerate(names)}
    root = brute_groups(prints)
    found = list(range(len(prints)))

    def find(i: int) -> int:
        while found[i] != i:
            i = found[i]
        return i

    for r in links.collect():
        a, b = sorted((find(place[r["a"]]), find(place[r["b"]])))
        found[b] = a
    assert [find(i) for i in range(len(prints))] == root


def test_documents_by_brute_force(spark):
    r, texts = random.Random(8), []
    for i in range(30):
        w = prose(i, 400).split()
        texts.append(" ".join(w))
        for _ in range(4):
            v = w.copy()
            for _ in range(r.randint(0, 3)):
                v[r.randrange(len(v))] = "changed"
            texts.append(" ".join(v))
    texts += ["", None, "one", "ONE"]
    data = rows(texts) + [(None, texts[0], None, None, None), (None, "nothing like it at all", None, None, None), (3, texts[3], None, None, None)]
    order = data[:]
    r.shuffle(order)
    prints = [brute_print(t) for _, t, *_ in data]
    root = brute_groups(prints)
    low: dict[int, int] = {}
    for (d, *_), k in zip(data, root):
        if d is not None:
            low[k] = min(low.get(k, d), d)
    want = Counter((d, f"{p:016x}", low.get(k)) for (d, *_), p, k in zip(data, prints, root))
    got = simhash.near_groups(spark.createDataFrame(order, DOCS).repartition(5))
    assert Counter(tuple(x) for x in got.select("doc_id", "fingerprint", "component_id").collect()) == want
    assert len(set(root)) < len(data) - 40


def test_simhash_of_any_rows(spark, edge, empty):
    docs = edge.selectExpr("*", "1 as print", "2 as root", "3 as low", "4 as component_id")
    got = simhash.near_groups(docs).collect()
    assert len(got) == edge.count()
    zero = [r for r in got if r["fingerprint"] == "0" * 16]
    assert {r["component_id"] for r in zero} == {3} and len(zero) == 4
    assert simhash.near_groups(empty).collect() == []
