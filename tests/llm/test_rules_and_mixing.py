from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from assayer.llm import quality_rules as Q
from assayer.llm import source_mixing as M

from .conftest import prose, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text: str | None) -> tuple:
    text = text or ""
    w = WORD.findall(text)
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = Counter(tri)
    places = {j for i, t in enumerate(tri) if often[t] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(places)


def test_counts_agree_with_brute_force(spark, edge):
    r = random.Random(4)
    texts = [" ".join(r.choice("ab c\t# | \n \x0b d".split(" ")) for _ in range(r.randint(0, 60))) for _ in range(200)]
    for df in (spark.createDataFrame(rows(texts), "doc_id long, text string, lang string, source string, n_chars long"), edge):
        got = Q.judge(df, Q.DecisionList(())).select("text", *Q.BASE_COUNTS, "base_failed", "kept").collect()
        for row in got:
            want = counts(row["text"])
            assert tuple(row[1:6]) == want
            failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
            assert row["base_failed"] is failed and row["kept"] is (not failed)
        assert len(got) == df.count()


def test_learned_list_rejects_junk_and_keeps_clean(spark):
    r = random.Random(9)
    texts, labels = [], []
    for i in range(600):
        t = prose(i, r.randint(60, 200))
        bad = i % 5 == 0
        texts.append(re.sub(" ", "## ", t) if bad else t)
        labels.append((i, int(not bad)))
    docs = spark.createDataFrame(rows(texts), "doc_id long, text string, lang string, source string, n_chars long")
    rules = Q.learn(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    got = {x["doc_id"]: x["kept"] for x in Q.judge(docs, rules).collect()}
    assert sum(got[i] == bool(q) for i, q in labels) >= 590
    assert Q.keep(docs, rules).columns == docs.columns
    plan = Q.judge(docs, rules)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_rules_are_conjunctions_when_one_threshold_is_not_enough():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 10, (3000, len(Q.FEATURES)))
    bad = ((x[:, 2] > 5) & (x[:, 3] > 5)).astype(float)
    found = Q.cover(x, bad, 1 - bad, np.arange(3000) % 3, [[float(c) for c in range(10)]] * len(Q.FEATURES), 8, 4, 0.85)
    assert found.rules and {c.feature for c in found.rules[0]} == {Q.FEATURES[2], Q.FEATURES[3]}


def test_nothing_to_learn(spark, edge, empty):
    none = spark.createDataFrame([(None, 1), (5, None)], "doc_id long, quality int")
    assert Q.learn(edge, none).rules == () and Q.learn(empty, none).rules == ()
    assert Q.judge(empty, Q.DecisionList(())).count() == 0


def test_poisson_copies_follow_the_rates(spark):
    docs = spark.range(6000).selectExpr("id as doc_id", "if(id % 3 = 0, 'big', 'small') as source", "'t' as text")
    weights = spark.createDataFrame([("big", 1.0), ("small", 3.0)], "source string, weight double")
    got = {r["source"]: r["n"] for r in M.mix(docs, weights).groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert abs(got["big"] - 1500) < 5 * math.sqrt(1500) and abs(got["small"] - 4500) < 5 * math.sqrt(4500)
    copies = M.mix(docs, weights, seed=3).select("doc_id", "mix_copy").collect()
    assert sorted(copies) == sorted(M.mix(docs.repartition(7), weights, seed=3).select("doc_id", "mix_copy").collect())


def test_large_means_and_inverse(spark):
    docs = spark.createDataFrame([(1, "rare", "t"), (2, "rest", "t")], "doc_id long, source string, text string")
    weights = spark.createDataFrame([("rare", 999.0), ("rest", 1.0)], "source string, weight double")
    n = M.mix(docs, weights, epochs=500.0).filter("source = 'rare'").count()
    assert abs(n - 999) < 6 * math.sqrt(999)
    u = 0.73
    table = spark.range(1).select(M.poisson_table(F.lit(2.5)).alias("t")).head()["t"]
    c, k, p = math.exp(-2.5), 0, math.exp(-2.5)
    while c < u:
        k += 1
        p *= 2.5 / k
        c += p
    assert sum(x < u for x in table) == k


def test_mixing_edges(spark, edge, empty):
    got = M.mix(edge)
    assert {"doc_id", "text", "mix_copy", "mix_key", "row"} <= set(got.columns) and got.count() > 0
    assert M.mix(empty).count() == 0
    keys = [r["mix_key"] for r in got.collect()]
    assert keys == sorted(keys)


def test_a_source_without_characters_goes_only_if_characters_are_its_size(spark):
    docs = spark.createDataFrame([(i, "text " * 9, "a") for i in range(20)] + [(20 + i, None if i % 2 else "", "b") for i in range(20)], "doc_id long, text string, source string")
    by_chars = M.mix(docs, size=F.coalesce(F.length("text"), F.lit(0)))
    assert {r["source"] for r in by_chars.collect()} == {"a"} and {r["source"] for r in M.mix(docs).collect()} == {"a", "b"}
    assert {r["source"]: r["rate"] for r in M.source_rates(docs, size=F.coalesce(F.length("text"), F.lit(0))).collect()} == {"a": 1.0, "b": 0.0}
