from __future__ import annotations

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayer import cli
from assayer.functions.values import average_precision
from assayer.functions.verdicts import rated
from assayer.model import claims
from assayer.model.plane import HashEmbedder
from assayer.operators import joins, nearest, reduce, reference
from assayer.plans import jobs
from assayer.sources import sinks


# ---------------------------------------------------------------- summaries of summaries


def test_running_sums(spark):
    rows = [(i, random.Random(i).randint(0, 9)) for i in range(300)]
    shuffled = rows[:]
    random.Random(1).shuffle(shuffled)
    got = {r["pos"]: r["before"] for r in reduce.running_sums(spark.createDataFrame(shuffled, "pos long, n long").repartition(5), ["pos"], "n").collect()}
    assert got == {i: sum(n for _, n in rows[:i]) for i in range(300)}


def test_groups_hold_at_most_one_budget(spark):
    r = random.Random(2)
    texts = [(i, r.choice([None, "", "one", " ".join(f"w{j}" for j in range(r.randint(1, 130)))])) for i in range(80)]
    groups = reduce.budget_groups(spark.createDataFrame(texts, "pos long, text string"), 40).collect()
    sizes, seen, start = {}, [], 0
    for g in sorted(groups, key=lambda g: (g["pos"], g["piece"])):
        assert g["tokens"] == len(g["text"].split()) <= 20 and g["group"] == start // 20
        start += g["tokens"]
        sizes[g["group"]] = sizes.get(g["group"], 0) + g["tokens"]
        seen += g["text"].split()
    assert seen == [w for _, t in texts if t for w in t.split()] and max(sizes.values()) <= 40
    assert reduce.budget_groups(spark.createDataFrame([], "pos long, text string"), 40).collect() == []
    with pytest.raises(ValueError):
        reduce.budget_groups(spark.createDataFrame([], "pos long, text string"), 1)


def brute_reduce(texts, shorten, budget):
    limit, calls, level = budget // 4, 0, 0
    rows = [t for t in texts if t is not None]
    while (left := sum(len(t.split()) for t in rows)) > 0:
        level += 1
        if left <= budget:
            return shorten("\n\n".join(rows), limit), calls + 1, level
        groups, start = {}, 0
        for t in rows:
            w = t.split()
            pieces = [t] if len(w) <= budget // 2 else [" ".join(w[i : i + budget // 2]) for i in range(0, len(w), budget // 2)]
            for p in pieces:
                if p.split():
                    groups.setdefault(start // (budget // 2), []).append(p)
                    start += len(p.split())
        calls += len(groups)
        rows = [shorten("\n\n".join(g), limit) for _, g in sorted(groups.items())]
    return None


@pytest.mark.parametrize("size", [3, 400])
def test_any_corpus_ends_in_one_text(spark, size):
    """Every second word stands in for a summary, so all levels leave a trace in the last."""
    texts = [" ".join(f"d{i}w{j}" for j in range(random.Random(i).randint(0, 30))) if i % 9 else None for i in range(size)]
    halve = lambda g: g.select("group", F.array_join(F.filter(F.regexp_extract_all("text", F.lit(r"\S+"), 0), lambda w, i: i % 2 == 0), " ").alias("text"))
    (got,) = reduce.map_reduce(spark.createDataFrame(list(enumerate(texts)), "pos long, text string").repartition(3), halve, 60).collect()
    want, calls, level = brute_reduce(texts, lambda t, most: " ".join(t.split()[::2][:most]), 60)
    assert (got["summary"], got["calls"], got["levels"]) == (want, calls, level) and got["input_tokens"] == sum(len(t.split()) for t in texts if t)
    assert reduce.map_reduce(spark.createDataFrame([(1, None), (2, " ")], "pos long, text string"), halve, 60).collect() == []


# ---------------------------------------------------------------- claims


def test_claims_are_parsed(spark):
    raws = ['["a", " b ", "", "a"]', '```json\n{"claims": ["x", "y"]}\n```', "Here: [\"p\"] so", "- one\n2. two\n* three\n\n", "", None, "[1, 2]", "{}"]
    got = [r["c"] for r in spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i long, raw string").orderBy("i").select(claims.parse_claims(F.col("raw")).alias("c")).collect()]
    assert got[:6] == [["a", "b"], ["x", "y"], ["p"], ["one", "two", "three"], [], []] and got[6] == ["1", "2"]


def test_average_precision(spark):
    rows = [([1, 0, 1],), ([0, 0],), ([],), (None,), ([1],), ([0, 1],)]
    got = [r["p"] for r in spark.createDataFrame(rows, "v array<int>").select(average_precision(F.col("v")).alias("p")).collect()]
    assert got == [pytest.approx((1 + 2 / 3) / 2), 0.0, None, None, 1.0, 0.5]


ROWS = "sample_id string, question string, answer string, reference_answer string, retrieved_contexts array<string>"


class Counting(claims.ClaimJudge):
    """Writes down what it is asked."""

    def __init__(self, folder):
        super().__init__()
        self.folder = str(folder)

    def answer(self, prompt):
        import uuid

        with open(f"{self.folder}/{uuid.uuid4().hex}", "w") as f:
            f.write(prompt)
        return super().answer(prompt)


def test_scores_by_claims(spark, tmp_path):
    paris = "Paris is the capital of France. Whales sing at night."
    rows = [("a", "What is the capital of France?", paris, "Paris is the capital of France.", ["Nothing here.", "Paris is the capital of France, they say.", None]), ("b", "What is the capital of France?", paris, "Paris is the capital of France.", ["Nothing here.", "Paris is the capital of France, they say.", None]), ("c", "why", None, "", []), ("d", "who", "  ", None, None)]
    docs = spark.createDataFrame(rows, ROWS)
    got = {(r["sample_id"], r["metric_name"]): r["value"] for r in claims.claim_scores(docs, Counting(tmp_path), HashEmbedder()).collect()}
    assert len(got) == 16
    for s in "ab":
        assert (got[s, "faithfulness"], got[s, "context_recall"], got[s, "context_precision"]) == (0.5, 1.0, 0.5) and 0 < got[s, "answer_relevancy"] < 1
    for s in "cd":
        assert {got[s, m] for m in claims.METRICS} == {None}
    asked = [p.read_text() for p in tmp_path.iterdir()]
    assert len(asked) == len(set(asked))  # a and b share all their prompts
    cache = spark.createDataFrame([(p, claims.ClaimJudge().answer(p)) for p in asked], "prompt string, raw string").select(F.sha2("prompt", 256).alias("prompt_id"), "raw")
    again = claims.claim_scores(docs, Counting(tmp_path / "none"), HashEmbedder(), cache, ("faithfulness", "context_recall"))  # a folder that isn't there: any question would fail
    assert {(r["sample_id"], r["metric_name"]): r["value"] for r in again.collect()} == {k: v for k, v in got.items() if k[1] in ("faithfulness", "context_recall")}
    with pytest.raises(ValueError, match="unsupported"):
        claims.claim_scores(docs, claims.ClaimJudge(), HashEmbedder(), metrics=("beauty",))


# ---------------------------------------------------------------- nearest


@pytest.mark.parametrize("normalised", [True, False])
def test_nearest_by_brute_force(spark, normalised):
    r = np.random.default_rng(4)
    rows = r.normal(size=(5000, 8))
    rows[100:400] = rows[0]  # ties, decided by id
    if normalised:
        rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    asked = rows[::700]
    like = np.round(asked @ rows.T / (1 if normalised else np.linalg.norm(asked, axis=1)[:, None] * np.linalg.norm(rows, axis=1)), 9)
    want = {(q, k + 1): i for q in range(len(asked)) for k, i in enumerate(sorted(range(5000), key=lambda i: (-like[q, i], i))[:7])}
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)] + [(9999, None)], "row_id long, vector array<double>").repartition(3)
    queries = spark.createDataFrame([(q, v.tolist()) for q, v in enumerate(asked)], "query_id long, vector array<double>")
    found = joins.nearest(queries, docs, 7, normalised)
    assert {(x["query_id"], x["rank"]): x["row_id"] for x in found.collect()} == want
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()  # no row for a pair


def test_blocks_that_are_too_far_are_skipped():
    r = np.random.default_rng(5)
    centres = r.normal(size=(6, 16))
    rows = np.concatenate([c + 0.01 * r.normal(size=(500, 16)) for c in centres])
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    queries = rows[:500:100]
    best = nearest.Best(queries, 5)
    for at in range(0, 3000, 500):
        best.add(np.arange(at, at + 500), rows[at : at + 500])
    like = np.round(queries @ rows.T, 9)
    want = sorted((q, int(i)) for q in range(5) for i in sorted(range(3000), key=lambda i: (-like[q, i], i))[:5])
    assert sorted(zip(best.held[0].tolist(), best.held[2].tolist())) == want
    assert best.met == 15_000 and best.skipped >= 10_000


def test_neighbours_and_references(spark):
    r = np.random.default_rng(6)
    units = [(f"u{i:02d}", f"text {i}", r.normal(size=4).tolist(), f"c{i % 3}") for i in range(30)]
    asked = [("q0", "text 3", units[3][2]), ("q1", "text 7 more", units[7][2])]
    docs, questions = spark.createDataFrame(units, "row_id string, text string, vector array<double>, cluster_id string"), spark.createDataFrame(asked, "query_id string, question_text string, vector array<double>")
    rows = reference.references(questions, docs, reference.judged(reference.OverlapJudge()), 4, 2).collect()
    assert len(rows) == 2
    for x in rows:
        assert [c["cluster_id"] for c in x["cluster_results"]] == ["c0", "c1", "c2"]
        for c in x["cluster_results"]:
            near, middle, every = ([a["unit_id"] for a in c[k]] for k in ("semantic_neighbor_assessments", "centroid_neighbor_assessments", "all_assessments"))
            q = np.array(dict((a, v) for a, _, v in asked)[x["question_id"]])
            own = [u for u in units if u[3] == c["cluster_id"]]
            assert near == [u[0] for u in sorted(own, key=lambda u: (-round(float(np.dot(q, u[2])), 9), u[0]))[:4]]
            m = np.mean([u[2] for u in own], axis=0)
            assert middle == [u[0] for u in sorted(own, key=lambda u: (-round(float(np.dot(m, u[2]) / np.linalg.norm(m) / np.linalg.norm(u[2])), 9), u[0]))[:2]]
            assert c["num_overlapping_chunks"] == len(set(near) & set(middle)) and c["num_assessments"] == len(set(near) | set(middle)) == len(every) and c["cluster_size"] == 10
            assert every == near + [u for u in middle if u not in near]
    scores = {a["unit_id"]: a["score"] for c in rows[0]["cluster_results"] for a in c["all_assessments"]} if rows[0]["question_id"] == "q0" else {a["unit_id"]: a["score"] for c in rows[1]["cluster_results"] for a in c["all_assessments"]}
    assert scores["u03"] == 3 and set(scores.values()) <= {0, 1, 2, 3}


def test_ratings_are_parsed(spark):
    raws = ['{"score": 2, "reasoning": "r"}', '```json\n{"relevance": "3"}\n```', "I say 1 of 3", "7 or 10", "", None, '{"score": 99}', '{"score": "NaN"}', "2.5 then 2"]
    got = [r["r"]["score"] for r in spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i long, raw string").orderBy("i").select(rated(F.col("raw"), 0, 3).alias("r")).collect()]
    assert got == [2, 3, 1, 0, 0, 0, 3, 0, 2]


# ---------------------------------------------------------------- jobs and files


def put(folder, name, content):
    (folder / name).write_text(json.dumps(content), encoding="utf-8")
    return str(folder / name)


class Length:
    def score(self, answer):
        return len(answer)


def test_metrics_by_name(spark, tmp_path):
    samples = put(tmp_path, "b.json", [{"sample_id": "a", "question": "capital?", "reference_answer": "Paris is the capital."}])
    results = put(tmp_path, "r.json", [{"sample_id": "a", "question": "capital?", "answer": "Paris is the capital.", "retrieved_contexts": [{"text": "Paris is the capital."}]}])
    out = jobs.Evaluate(samples, results, str(tmp_path / "out"), "correctness, faithfulness,lexical_faithfulness,length", own={"length": Length}).run(spark)
    assert {(r["metric_name"], r["value"]) for r in out.collect()} == {("correctness", 1.0), ("faithfulness", 1.0), ("lexical_faithfulness", 1.0), ("length", 21.0)}
    written = json.loads((tmp_path / "out/evaluation.json").read_text())
    assert written["aggregate"]["length"] == 21.0 and len(written["scores"]) == 4 and written["results"][0]["answer"] == "Paris is the capital."
    for wrong in ("beauty", ""):
        with pytest.raises(ValueError):
            jobs.Evaluate(samples, results, str(tmp_path / "no"), wrong).run(spark)
    assert not (tmp_path / "no").exists()


def test_references_by_command(spark, tmp_path, capsys):
    units = [{"id": f"u{i}", "text": f"whales sing {i}" if i % 2 else f"bread rises {i}"} for i in range(8)]
    clusters = put(tmp_path, "c.json", [{"cluster_id": "whales", "text_units": units[1::2]}, {"cluster_id": "bread", "text_units": units[::2]}])
    questions = put(tmp_path, "q.json", [{"question_id": "q", "question": "whales sing"}])
    assert cli.main(["retrieval-reference", "--questions", questions, "--clusters", clusters, "--output", str(tmp_path / "ref"), "--semantic-neighbors", "2", "--centroid-neighbors", "1"], spark) == 0
    flat = spark.read.parquet(str(tmp_path / "ref/reference")).collect()
    assert {r["score"] for r in flat if r["cluster_id"] == "whales"} == {3} and {r["score"] for r in flat if r["cluster_id"] == "bread"} == {0}
    nested = [json.loads(line) for p in (tmp_path / "ref/nested").glob("part-*") for line in p.read_text().splitlines()]
    assert len(nested) == 1 and {c["cluster_size"] for c in nested[0]["cluster_results"]} == {4}
    got = spark.createDataFrame([("q", [("u1", "whales sing 1"), ("u0", "bread rises 0")])], "question_id string, context array<struct<chunk_id: string, text: string>>")
    got.write.parquet(str(tmp_path / "rows"))
    assert cli.main(["retrieval-score", "--reference", str(tmp_path / "ref/reference"), "--clusters", clusters, "--output", str(tmp_path / "scored"), f"one={tmp_path / 'rows'}"], spark) == 0
    row = json.loads(capsys.readouterr().out.splitlines()[-1])
    assert row["binary_precision"] == row["graded_precision"] == 0.5 and row["recall"] == 1.0


def test_answers_by_reference(spark, tmp_path):
    answers = put(tmp_path, "a.json", {"results": [{"sample_id": "a", "question": "q", "answer": "one two three"}, {"sample_id": "b", "question": "q", "answer": "zero"}, {"sample_id": "c", "question": "q", "answer": "no reference"}]})
    wanted = put(tmp_path, "r.json", {"samples": [{"sample_id": "a", "reference_answer": "one two three"}, {"sample_id": "b", "reference_answer": "four"}]})
    assert cli.main(["reference-score", "--answers", answers, "--references", wanted, "--output", str(tmp_path / "out"), "--trials", "2"], spark) == 0
    rows = {(r["question_id"], r["criteria"], r["trial"]): r["score"] for r in spark.read.parquet(str(tmp_path / "out/scores")).collect()}
    assert len(rows) == 8 and {v for k, v in rows.items() if k[0] == "a"} == {3} and {v for k, v in rows.items() if k[0] == "b"} == {1}


def test_one_file_from_many_parts(spark, tmp_path):
    rows = [(f"s{i:03d}", "m", float(i), None if i % 2 else "naïve\n\"quoted\"") for i in range(50)]
    scores = spark.createDataFrame(rows, "sample_id string, metric_name string, value double, reason string").repartition(7).orderBy("sample_id")
    means = spark.createDataFrame([("m", 24.5)], "metric_name string, mean_value double")
    sinks.evaluation(str(tmp_path / "e.json"), scores, scores.limit(0), means)
    want = {"scores": [dict(zip(("sample_id", "metric_name", "value", "reason"), r)) for r in rows], "results": [], "aggregate": {"m": 24.5}}
    assert (tmp_path / "e.json").read_text() == json.dumps(want, ensure_ascii=False, indent=2) and not (tmp_path / "e.json.parts").exists()
    sinks.state(str(tmp_path / "s.json"), scores, "sample_id")
    assert (tmp_path / "s.json").read_text() == json.dumps({r["sample_id"]: r for r in want["scores"]}, ensure_ascii=False, indent=2, sort_keys=True) + "\n"
    sinks.state(str(tmp_path / "n.json"), scores.limit(0), "sample_id")
    assert (tmp_path / "n.json").read_text() == "{}\n"
