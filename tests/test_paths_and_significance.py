from __future__ import annotations

import hashlib
import math
import random
from collections import defaultdict

import pytest

from assayer.operators import hierarchy, paths, significance


def brute_distances(pairs, edges, hops):
    out = defaultdict(set)
    for a, b in edges:
        if a is not None and b is not None:
            out[a].add(b)
    found = []
    for sample, source, target in pairs:
        best = None
        if source is not None and target is not None:
            seen, here = {source}, {source}
            for k in range(hops + 1):
                if target in here:
                    best = k
                    break
                here = {y for x in here for y in out[x]} - seen
                seen |= here
        found.append((sample, best is not None, best))
    return sorted(found, key=str)


@pytest.mark.parametrize("hub", [2, 10_000])
@pytest.mark.parametrize("hops", [0, 1, 3, 6])
def test_paths_by_brute_force(spark, hub, hops):
    r = random.Random(hops)
    edges = [(r.randrange(40), r.randrange(40)) for _ in range(55)] + [(1, 1), (2, 3), (3, 2), (None, 4), (4, None), (2, 3)]
    pairs = [(i, r.randrange(45), r.randrange(45)) for i in range(60)] + [(60, None, 1), (61, 1, None), (62, 99, 99), (63, 1, 1), (5, 2, 3), (5, 2, 3)]
    got = paths.path_exists(spark.createDataFrame(pairs, "sample_id long, source long, target long"), spark.createDataFrame(edges, "source long, target long"), hops, hub)
    assert sorted((tuple(x) for x in got.collect()), key=str) == brute_distances(pairs, edges, hops)


def test_alike_sources_and_targets_walk_once(spark, monkeypatch):
    """Sources of one nation and its suppliers: no row stands for a pair of them."""
    held, keep = [], paths.checkpointed
    monkeypatch.setattr(paths, "checkpointed", lambda df: held.append(keep(df)) or held[-1])
    edges = spark.range(200).selectExpr("concat('c', id) as source", "'n' as target").union(spark.range(200).selectExpr("'n'", "concat('s', id)"))
    pairs = spark.range(200).selectExpr("id as sample_id", "concat('c', id) as source", "concat('s', 199 - id) as target")
    assert {tuple(x) for x in paths.path_exists(pairs, edges, 4).collect()} == {(i, True, 2) for i in range(200)}
    assert max(df.count() for df in held) <= 400  # 40 000 when each source walked to all targets


def test_a_hub_is_dealt_out_and_dead_ends_are_left(spark):
    """A hub of 10^5 edges: its edges lie in slots, and only the nodes that lead to a target are kept after it."""
    edges = spark.range(100_000).selectExpr("-1L as source", "id as target").unionByName(spark.createDataFrame([(77, -2), (-2, -1), (-3, -1)], "source long, target long"))
    known, hubs = paths.spread_edges(edges, 10_000)
    assert [tuple(x) for x in hubs.collect()] == [(-1, 10)]
    sizes = [r["n"] for r in known.filter("source = -1").groupBy("slot").agg({"*": "count"}).toDF("slot", "n").collect()]
    assert len(sizes) == 10 and max(sizes) < 11_000
    pairs = spark.createDataFrame([(i, -3, -2) for i in range(3)], "sample_id long, source long, target long")
    assert {tuple(x) for x in paths.path_exists(pairs, edges, 3).collect()} == {(i, True, 3) for i in range(3)}
    near = paths.distance_to_any(spark.createDataFrame([(-2,)], "node long"), edges, 2)
    assert {tuple(x) for x in near.collect()} == {(-2, 0), (77, 1), (-1, 2)}


def test_paths_in_empty_tables(spark):
    nothing = spark.createDataFrame([], "source long, target long")
    pairs = spark.createDataFrame([(1, 2, 3)], "sample_id long, source long, target long")
    assert [tuple(x) for x in paths.path_exists(pairs, nothing).collect()] == [(1, False, None)]
    assert paths.path_exists(pairs.limit(0), nothing.limit(0)).collect() == []


def exact_tail(n, k):
    return sum(math.comb(n, i) for i in range(k + 1)) / 2**n


def test_binomial_tails_are_exact(spark):
    cases = [(n, k) for n in (0, 1, 2, 3, 10, 57, 400, 1000) for k in {0, 1, n // 4, n // 2} if 2 * k <= n]
    rows = spark.createDataFrame(cases, "n long, k long")
    for r in rows.select("n", "k", significance.binomial_tail(rows["n"], rows["k"]).alias("p"), significance.log_factorial(rows["n"]).alias("l")).collect():
        assert r["p"] == pytest.approx(exact_tail(r["n"], r["k"]), rel=1e-11)
        assert r["l"] == pytest.approx(math.lgamma(r["n"] + 1), abs=1e-10)


def test_large_counts(spark):
    rows = spark.createDataFrame([(10**9, 5 * 10**8 - 31_623), (10**9, 4 * 10**8)], "n long, k long")
    got = [r["p"] for r in rows.select(significance.binomial_tail(rows["n"], rows["k"]).alias("p")).collect()]
    assert got[0] == pytest.approx(0.0227496, rel=1e-3) and got[1] == 0.0


def test_exact_sign_test(spark):
    rows = [("a", 1.0, 0.0)] * 9 + [("a", 0.0, 1.0)] + [("a", 1.0, 1.0)] * 4 + [("b", 0.5, 0.5), ("c", None, 1.0), ("c", float("nan"), 1.0), ("c", 2.0, 1.0)]
    got = {r["family"]: (r["wins"], r["losses"], r["ties"], round(r["p_value"], 12)) for r in significance.exact_sign_test(spark.createDataFrame(rows, "family string, x double, y double"), ["family"], "x", "y").collect()}
    assert got == {"a": (9, 1, 4, round(2 * exact_tail(10, 1), 12)), "b": (0, 0, 1, 1.0), "c": (1, 0, 0, 1.0)}


def weight(seed, replicate, question):
    u = int(hashlib.md5(f"{seed}|{replicate}|{question}".encode()).hexdigest()[:13], 16) / 16**13
    k, p, total = 0, math.exp(-1), math.exp(-1)
    while u >= total and k < 18:
        k += 1
        p /= k
        total += p
    return k


def test_bootstrap_by_brute_force(spark):
    r = random.Random(3)
    rows = [("f", q, r.choice([0.0, 1.0]), r.choice([0.0, 0.0, 1.0])) for q in range(40) for _ in range(r.randint(1, 5))]
    docs = spark.createDataFrame(rows, "family string, question_id long, x double, y double")
    got = significance.bootstrap(docs.repartition(5), ["family"], "question_id", "x", "y", replicates=100).collect()[0]
    sums = defaultdict(lambda: [0.0, 0])
    for _, q, a, b in rows:
        sums[q][0] += a - b
        sums[q][1] += 1
    means = sorted(sum(weight(42, k, q) * d for q, (d, _) in sums.items()) / sum(weight(42, k, q) * n for q, (_, n) in sums.items()) for k in range(1, 101))
    assert got["low"] == pytest.approx(means[2]) and got["high"] == pytest.approx(means[97])
    half = sum(m == 0 for m in means) / 2
    assert got["p_bootstrap"] == pytest.approx(min(1.0, 2 * min(sum(m < 0 for m in means) + half, sum(m > 0 for m in means) + half) / 100))
    assert got["mean_difference"] == pytest.approx(sum(a - b for *_, a, b in rows) / len(rows)) and got["n_questions"] == 40
    drawn = [weight(42, k, q) for k in range(100) for q in range(100)]
    assert abs(sum(drawn) / 10_000 - 1) < 0.05 and abs(sum(w == 0 for w in drawn) / 10_000 - math.exp(-1)) < 0.02


def test_significance_of_families(spark):
    rows = [("same", i, 1.0, 1.0) for i in range(20)] + [("better", i, 1.0, 0.0) for i in range(20)]
    got = {r["family"]: r for r in significance.assertion_significance(spark.createDataFrame(rows, "family string, question_id long, first double, second double"), "family").collect()}
    assert got["better"]["p_adjusted"] == pytest.approx(2 * 2 * 0.5**20) and got["better"]["low"] == got["better"]["high"] == 1.0 and got["better"]["p_bootstrap"] == 0.0
    assert got["same"]["p_adjusted"] == 1.0 and got["same"]["p_bootstrap"] == 1.0


TREE = "question_id string, assertion_id long, parent_id long, value double"


def test_trees_are_rolled_up(spark):
    rows = [("q", 1, None, 0.0), ("q", 2, 1, 1.0), ("q", 3, 1, None), ("q", 4, 3, 1.0), ("q", 5, 3, float("nan")), ("q", 6, 99, 1.0), ("p", 1, None, 0.25)]
    rolled = hierarchy.roll_up(spark.createDataFrame(rows, TREE))
    got = {(r["question_id"], r["assertion_id"]): (r["depth"], r["own"], r["score"], r["children"], r["support"]) for r in rolled.collect()}
    assert got[("q", 3)] == (1, 0.0, 0.5, 2, 0.5) and got[("q", 1)] == (0, 0.0, 0.75, 2, 1.0)
    assert got[("q", 6)] == (0, 1.0, 1.0, 0, None) and got[("p", 1)] == (0, 0.25, 0.25, 0, None) and len(got) == 7
    scores = {r["question_id"]: (r["score"], r["own"], r["assertions"], r["roots"]) for r in hierarchy.question_scores(rolled).collect()}
    assert scores == {"q": (0.875, 0.5, 6, 2), "p": (0.25, 0.25, 1, 1)}
    other = hierarchy.roll_up(spark.createDataFrame([("q", 1, None, 1.0)], TREE))
    assert [tuple(x) for x in hierarchy.paired(rolled, other).collect()] == [("q", 0.875, 1.0)]


def test_random_trees_by_brute_force(spark):
    r, rows = random.Random(5), []
    for q in range(6):
        for i in range(40):
            rows.append((f"q{q}", i, r.randrange(i) if i and r.random() < 0.9 else None, r.random()))
    value = {(q, i): v for q, i, _, v in rows}
    children = defaultdict(list)
    for q, i, p, _ in rows:
        if p is not None:
            children[q, p].append((q, i))

    def score(k):
        return sum(map(score, children[k])) / len(children[k]) if children[k] else value[k]

    got = {(x["question_id"], x["assertion_id"]): x["score"] for x in hierarchy.roll_up(spark.createDataFrame(rows, TREE)).collect()}
    assert got == pytest.approx({k: score(k) for k in value})


def test_cycles_are_errors_and_empty_trees_are_none(spark):
    rows = [("q", 1, None, 1.0), ("q", 2, 3, 1.0), ("q", 3, 2, 1.0)]
    with pytest.raises(Exception, match="cycle or too deep"):
        hierarchy.roll_up(spark.createDataFrame(rows, TREE)).collect()
    assert hierarchy.roll_up(spark.createDataFrame([], TREE)).collect() == []
