from __future__ import annotations

import hashlib
import random

import pytest

from assayer.operators import prefixes, runs


def brute_first(contexts, units):
    out = {}
    for key in contexts:
        equal, alike = [u for k, u in units if k == key], [u for k, u in units if k.startswith(key) or key.startswith(k)]
        if alike:
            out[key] = min(equal or alike)
    return out


def found(spark, contexts, units, parts):
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        c = spark.createDataFrame([(k,) for k in contexts], "key string")
        u = spark.createDataFrame([(k, *v) for k, v in units], "key string, pos long, unit_id string")
        names = {hashlib.sha256(k.encode()).hexdigest(): k for k in contexts}
        return {names[r["name"]]: tuple(r["unit"]) for r in prefixes.first_by_prefix(c, u).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize("parts", [1, 13])
def test_prefixes_by_brute_force(spark, parts):
    """Nested keys of few letters, so that prefixes go on over the borders of many parts."""
    r, keys = random.Random(parts), set()
    while len(keys) < 500:
        keys.add("".join(r.choice("abé") for _ in range(r.randint(1, 9))))
    keys |= {"a" * n for n in range(1, 60)}
    keys = sorted(keys)
    r.shuffle(keys)
    contexts = keys[:250] + keys[:20]
    units = [(k, (r.randrange(100), f"u{i}")) for i, k in enumerate(keys[200:] + keys[300:310])]
    assert found(spark, contexts, units, parts) == brute_first(contexts, units)
    assert found(spark, contexts, [], parts) == {} == found(spark, [], units, parts)


def test_one_common_beginning_costs_no_pairs(spark):
    """20 000 keys that share 60 characters and don't match, and one that is a prefix of them all."""
    head = "the same sixty characters stand at the beginning of each key"
    contexts = [f"{head} c{i:06d}" for i in range(10_000)]
    units = [(f"{head} u{i:06d}", (i, f"u{i}")) for i in range(10_000)]
    assert found(spark, contexts, units, 4) == {}
    got = found(spark, contexts, [*units, (head, (99_999, "all"))], 4)
    assert len(got) == 10_000 and set(got.values()) == {(99_999, "all")}


@pytest.mark.parametrize("parts", [1, 8])
def test_runs_are_scanned_in_segments(spark, parts):
    r = random.Random(parts)
    rows = [("hot" if r.random() < 0.7 else r.choice(["a", "b", None]), r.randrange(400), i, r.random() < 0.05) for i in range(3000)]
    want, last = {}, {}
    for key, when, i, passed in sorted(rows, key=lambda x: (x[1], x[2])):
        if passed:
            last[key] = when
        want[i] = last.get(key)
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        docs = spark.createDataFrame(rows, "key string, at long, id long, passed boolean").repartition(3)
        got = runs.success_so_far(docs, "key", "at", "id")
        assert got.columns == ["key", "at", "id", "passed", "last_success_at"]
        assert {x["id"]: x["last_success_at"] for x in got.collect()} == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
