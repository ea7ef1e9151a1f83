from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pytest

from assayer.llm import fingerprints as P
from assayer.llm.packing import Packer, pack

from .conftest import prose, rows

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingle_set(text: str, width: int = 5) -> set:
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def test_next_document_and_likeness(spark):
    texts = [prose(i // 2, 300 + i) for i in range(60)]
    order = sorted(range(60), key=lambda i: (i * 37) % 60)
    docs = spark.createDataFrame([rows(texts)[i] for i in order], SCHEMA).repartition(5)
    got = {r["doc_id"]: r for r in P.compare_with_next(docs).collect()}
    assert len(got) == 60
    for i, t in enumerate(texts):
        other, half = texts[(i + 1) % 60], len(t) // 2
        edited = t[: len(t) - half] + other[:half]
        a, b, c = shingle_set(t), shingle_set(edited), shingle_set(other)
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(got[i]["near_edited"] - len(a & b) / len(a | b)) < 0.15
        assert abs(got[i]["near_next"] - len(a & c) / len(a | c)) < 0.15
        assert abs(got[i]["distinct_shingles"] - len(a)) < 0.3 * len(a)


def test_bottom_k_and_likeness_are_exact(spark):
    """Against hashes of words and shingles computed one by one."""
    mask = (1 << 64) - 1

    def mix(h: int) -> int:
        h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & mask
        h = (h ^ h >> 27) * 0x94D049BB133111EB & mask
        return h ^ h >> 31

    start = int.from_bytes(hashlib.blake2b(b"words", digest_size=8).digest(), "little")

    def word(w: str) -> int:
        raw = re.sub("[A-Z]", lambda m: m.group().lower(), w).encode()
        if len(raw) > 7:
            return int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little")
        return mix((int.from_bytes(raw, "little") | len(raw) << 56) ^ start)

    def hashes(text: str) -> set[int]:
        w, out = [word(x) for x in re.findall(r"[^\x20\x09-\x0D]+", text)], set()
        for i in range(max(1, len(w) - 4) if w else 0):
            h = 0
            for k, x in enumerate(w[i : i + 5]):
                h = mix((h * 0xD6E8FEB86659FD93 + x + k + 1) & mask)
            out.add(h)
        return out

    texts = [prose(5, 700), prose(5, 500) + " " + prose(6, 100), "Ärger ÜBER Alles", "", "one\x0btwo", "x" * 300 + " y", prose(7, 40) + " " + "z" * 64 + " " + "w" * 65]
    got = [r["fingerprint"] for r in P.fingerprint(spark.createDataFrame(rows(texts), SCHEMA)).orderBy("doc_id").collect()]
    low = [sorted(hashes(t))[:256] for t in texts]
    assert [P.Sketch.parse(g, 256).hashes.tolist() for g in got] == low
    union = sorted(set(low[0]) | set(low[1]))[:256]
    assert P.Sketch.parse(got[0], 256).resemblance(P.Sketch.parse(got[1], 256)) == len(set(union) & set(low[0]) & set(low[1])) / 256


def test_small_sketches_are_exact_and_merge():
    one, two = np.arange(10, dtype=np.uint64), np.arange(5, 20, dtype=np.uint64)
    a, b = P.Sketch.of(one, 64), P.Sketch.of(two, 64)
    assert a.resemblance(b) == 5 / 20 and a.containment(b) == 0.5 and a.distinct() == 10
    assert str(P.Sketch.merge([a, b])) == str(P.Sketch.of(np.concatenate([one, two]), 64)) and P.Sketch.parse(str(a), 64).distinct() == 10
    assert P.Sketch.of(one[:0], 64).resemblance(P.Sketch.of(one[:0], 64)) == 1.0


def test_merged_parts_equal_the_whole(spark):
    docs = spark.createDataFrame(rows([prose(i, 200) for i in range(40)]), SCHEMA)
    merged = P.merge_fingerprints(P.fingerprint(docs).join(docs.select("doc_id", "source"), "doc_id"), "source", 256)
    assert merged.count() == 3 and all(abs(r["distinct_shingles"] - 196 * 13) < 700 for r in merged.collect())


def test_fingerprint_edges(spark, edge, empty):
    got = P.fingerprint(edge).collect()
    assert len(got) == edge.count() and sum(r["fingerprint"] == "" for r in got) == 4
    assert P.fingerprint(empty).count() == 0 and P.compare_with_next(empty).count() == 0
    compared = P.compare_with_next(edge).collect()
    assert len(compared) == edge.count() and all(0 <= r["near_next"] <= 1 for r in compared)
    one = P.compare_with_next(spark.createDataFrame(rows(["only one text of its own here"]), SCHEMA)).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0


tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")


def check(docs, got) -> None:
    from collections import Counter, defaultdict

    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public.path("word_bpe_49k.json"))
    want = Counter()
    for r in docs.collect():
        want[(r["doc_id"], np.array([*t.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4").tobytes())] += 1
    pieces = got.collect()
    spans = defaultdict(list)
    for p in pieces:
        spans[p["sequence_id"]].append((p["offset"], p["length"]))
    for s in spans.values():
        at = 0
        for a, n in sorted(s):
            assert a == at
            at += n
        assert at == 4096 or at & (at - 1) == 0
    by_doc = defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
    for (doc, ids), times in want.items():
        total = len(ids) // 4
        own = [p for p in by_doc[doc] if p["doc_tokens"] == total and zlib.crc32(ids[4 * p["start"] : 4 * (p["start"] + p["length"])]) == p["ids_crc32"]]
        assert sum(p["length"] for p in own) >= total * times
    assert sum(p["length"] for p in pieces) == sum(len(i) // 4 * n for (_, i), n in want.items())


def test_every_id_is_in_one_piece(spark, edge, empty):
    docs = spark.createDataFrame(rows([prose(i, 5 + (i * 97) % 3000) for i in range(80)] + ["a \x01 b", "tab\tand nbsp", "x<|endoftext|>y", "it's  we'll \n\n done"]), SCHEMA).repartition(3)
    path = public.path("word_bpe_49k.json")
    check(docs, pack(docs, path))
    check(edge, pack(edge, path))
    assert pack(empty, path).count() == 0


def test_open_windows_stay_bounded():
    p = Packer(100, 4, 0)
    for i in range(500):
        p.add(i, 0, 60 + i % 30, b"\0" * 4 * (60 + i % 30))
        assert len(p.free) <= 4
    p.merge(None)
    assert sum(r[2] for r in p.rows) == sum(60 + i % 30 for i in range(500))
