"""What a task holds at once stays bounded, whatever its tables have."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa

from assayer.functions import markdown
from assayer.operators import nearest


def test_grouped_search_holds_little(monkeypatch):
    rng, monkey = np.random.default_rng(3), monkeypatch
    monkey.setattr(nearest, "FLOATS", 8 * 1500)
    rows, queries, groups = rng.normal(size=(4000, 8)), rng.normal(size=(5000, 8)), rng.choice(["a", "b", None], 4000).tolist()
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(4000)), pa.array(rows.tolist()), pa.array(groups, pa.string())], ["row_id", "vector", "g"])
    schema = pa.schema([("query_id", pa.int64()), ("row_id", pa.int64()), ("similarity", pa.float64()), ("g", pa.string())])
    best: dict = {}
    tracemalloc.start()
    for out in nearest._search(iter([batch]), queries, list(range(5000)), 2, True, schema):
        if len(out) and out.column(0)[0].as_py() < 1024:  # some of them
            for q, r, s, g in zip(*(c.to_pylist() for c in out.columns)):
                best.setdefault((q, g), []).append((-s, r))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6  # all queries met a block at once before
    like = np.round(queries[:50] @ rows.T, nearest.DIGITS)
    for q in range(50):
        for g in ("a", "b", None):
            own = [i for i in range(4000) if groups[i] == g]
            assert [r for _, r in sorted(best[q, g])[:2]] == sorted(own, key=lambda i: (-like[q, i], i))[:2]


def test_chunks_leave_in_small_batches():
    texts = [("word " * 900).strip(), None, "", "one"] * 1500
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    got = list(markdown._chunk_rows(iter([batch]), 1000, 200))
    assert len(got) > 1 and max(b.nbytes for b in got) < 2 * markdown.CHUNK_BYTES
    rows = [tuple(x.values()) for b in got for x in b.to_pylist()]
    assert rows == [(i, at, c) for i, t in enumerate(texts) for at, c in enumerate(markdown.chunks(t or "", 1000, 200))]
