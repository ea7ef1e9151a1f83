from __future__ import annotations

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from assayer.operators import assertions, graph, ingest, joins, questions, retrieval, runs, scores


def test_strict_lookup_takes_the_last_and_misses_loudly(spark):
    samples = spark.createDataFrame([("a", 1), ("b", 2)], "sample_id string, q int")
    results = spark.createDataFrame([("a", 0, "x"), ("a", 1, "y"), ("b", 2, "z"), ("c", 3, "-")], "sample_id string, pos int, answer string")
    assert sorted(r["answer"] for r in joins.strict_lookup(samples, results, "sample_id", F.col("pos")).collect()) == ["y", "z"]
    few = results.filter("sample_id = 'a'")
    with pytest.raises(PySparkException, match="sample_id=b"):
        joins.strict_lookup(samples, few, "sample_id", F.col("pos")).collect()
    assert joins.strict_lookup(samples, few, "sample_id", F.col("pos"), strict=False).count() == 1
    assert [r["sample_id"] for r in joins.missing(samples, few, "sample_id").collect()] == ["b"]


def test_units_resolve_by_key_then_by_prefix(spark):
    units = spark.createDataFrame([("u1", 0, "Alpha  beta gamma delta epsilon zeta eta theta iota"), ("u2", 1, "alpha beta gamma delta epsilon zeta eta theta iota"), ("u3", 2, "Short"), ("u4", 3, ""), ("u5", 4, "alpha beta gamma delta epsilon zeta eta nu")], "unit_id string, pos int, text string")
    texts = {"same": " ALPHA beta gamma delta epsilon zeta eta theta iota", "head": "alpha beta", "long": "alpha beta gamma delta epsilon zeta eta nu xi", "longer": "short and more", "none": "omega", "empty": " ", "null": None, "middle": "alpha beta gamma delta epsilon zeta eta"}
    got = {r["context_id"]: r["unit_id"] for r in joins.resolve_units(spark.createDataFrame(list(texts.items()), "context_id string, text string"), units).collect()}
    assert got == {"same": "u1", "head": "u1", "long": "u5", "longer": "u3", "none": None, "empty": None, "null": None, "middle": "u1"}
    plan = joins.resolve_units(units.select(F.col("unit_id").alias("context_id"), "text"), units)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Python" not in plan


def test_nearest_in_blocks_is_nearest_at_once(spark, monkeypatch):
    rows = spark.range(200).select(F.col("id").alias("row_id"), F.transform(F.array(*map(F.lit, range(8))), lambda i: F.sin(F.col("id") * (i + 1))).alias("vector"))
    asked = rows.filter("row_id % 10 = 0").withColumnRenamed("row_id", "query_id")
    whole = sorted(map(tuple, joins.nearest(asked, rows, 5).collect()))
    monkeypatch.setattr(joins, "QUERIES_AT_ONCE", 3)
    blocks = joins.nearest(asked, rows, 5)
    assert sorted(map(tuple, blocks.collect())) == whole and len(whole) == 100
    assert "NestedLoop" not in blocks._jdf.queryExecution().executedPlan().toString()


def test_nearest_breaks_ties_by_id(spark):
    rows = spark.createDataFrame([(i, [1.0, float(i % 2)]) for i in range(6)], "row_id long, vector array<double>")
    got = joins.nearest(spark.createDataFrame([(9, [1.0, 0.0])], "query_id long, vector array<double>"), rows, 3, normalised=False).orderBy("rank").collect()
    assert [r["row_id"] for r in got] == [0, 2, 4]


def test_steps(spark):
    steps = spark.createDataFrame([("a", "failed"), ("b", "passed"), ("c", "failed")], "step string, status string")
    needs = spark.createDataFrame([("b", "c", 2), ("b", "a", 1), ("c", "b", 1)], "step string, dependency string, ord int")
    assert [tuple(r) for r in joins.blocked(steps, needs).collect()] == [("b", "a")]
    assert sorted(r["step"] for r in joins.runnable(steps, needs).collect()) == ["a", "c"]
    seen = joins.expected_steps(spark.createDataFrame([("g", 0, "a"), ("g", 1, "z")], "group string, ord int, step string"), spark.createDataFrame([("a", 0, "failed"), ("a", 1, "passed")], "step string, pos int, status string"))
    assert {r["step"]: r["status"] for r in seen.collect()} == {"a": "passed", "z": "not run"}
    zipped = runs.test_progress(spark.createDataFrame([(0, "t0"), (1, "t1")], "pos int, node string"), spark.createDataFrame([(0, "passed")], "pos int, status string"))
    assert {r["node"]: r["status"] for r in zipped.collect()} == {"t0": "passed", "t1": "not_run"}


def test_scores(spark):
    tidy = spark.createDataFrame([("a", "m", 1.0), ("b", "m", 0.0), ("a", "n", 1.0)], "sample_id string, metric_name string, value double")
    assert {r["metric_name"]: r["mean_value"] for r in scores.by_metric(tidy).collect()} == {"m": 0.5, "n": 1.0}
    assert scores.accuracy(tidy, "m").head()["accuracy_text"] == "50.00%"
    assert tuple(scores.top_metric(scores.by_metric(tidy)).head()) == ("n", 1.0) and tuple(scores.top_metric(scores.by_metric(tidy.limit(0))).head()) == (None, 1.0)
    assert tuple(scores.tally(spark.createDataFrame([("0",), ("1",), ("x",), (None,)], "exit_code string")).head()) == (1, 3, 2, 4)
    p = spark.createDataFrame([("f", "a", 0.01), ("f", "b", 0.04), ("f", "c", 0.03)], "family string, test string, p_value double")
    assert {r["test"]: round(r["p_adjusted"], 6) for r in scores.holm(p, "family").collect()} == {"a": 0.03, "b": 0.06, "c": 0.06}
    pairs = spark.createDataFrame([("m", 1.0, 0.0)] * 9 + [("m", 0.0, 1.0), ("m", 1.0, 1.0)], "name string, a double, b double")
    row = scores.sign_test(pairs, "name", "a", "b").head()
    assert (row["wins"], row["losses"]) == (9, 1) and row["p_value"] == pytest.approx(0.0269, abs=2e-3)
    assert scores.win_rate(pairs, "name", "a", "b").head()["win_rate"] == pytest.approx(9.5 / 11)
    assert scores.alerts(spark.createDataFrame([(0, 1, 1, None)], "total_assertions int, valid_assertions int, scores int, retrieval_rows int")).count() == 2


def test_nodes_split_once(spark):
    nodes = spark.createDataFrame([("n1", "First sentence here. Second one.", "x"), ("n2", "short", "y"), ("n3", "            spaced           ", "z")], "id string, description string, name string")
    children = graph.split_nodes(nodes, 20)
    assert sorted((r["id"], r["description"], r["name"]) for r in children.collect()) == [("n1::split::1", "First sentence here.", "x"), ("n1::split::2", "Second one.", "x")]
    both = graph.with_children(nodes, children)
    assert both.count() == 5 and graph.split_nodes(both, 20).count() == 0
    edges = graph.part_of_edges(children, spark.createDataFrame([("a", "b", "r")], "source string, target string, type string"))
    assert {(r["source"], r["target"], r["type"], r["relationship"]) for r in edges.collect()} == {(f"n1::split::{k}", "n1", "part_of", "part_of") for k in (1, 2)}
    assert tuple(graph.split_statistics(children).head()) == (1, 2, 2)
    assert "name" in graph.part_of_edges(children, keep_node_columns=True).columns
    with pytest.raises(ValueError):
        graph.split_nodes(nodes.select("id"), 5)


def test_clusters(spark):
    c = spark.createDataFrame([(None, 0, ["a", "", None]), ("", 7, ["b"])], "id string, community int, text_unit_ids array<string>")
    assert sorted((r["cluster_id"], r["text_unit_ids"], r["size"]) for r in graph.clusters(c).collect()) == [("0", ["a"], 1), ("7", ["b"], 1)]
    with pytest.raises(PySparkException, match="without text_unit_ids"):
        graph.clusters(spark.createDataFrame([("k", [""])], "id string, text_unit_ids array<string>")).collect()
    units = spark.createDataFrame([("a", "text", "s")], "unit_id string, text string, short_id string")
    got = joins.fill_units(spark.createDataFrame([("k", 0, "a"), ("k", 1, "b")], "cluster_id string, pos int, unit_id string"), units)
    assert sorted((r["unit_id"], r["text"], r["short_id"]) for r in got.collect()) == [("a", "text", "s"), ("b", "", "b")]


def test_coverage_metrics(spark):
    rows = spark.createDataFrame([("s", ["a", "b"], ["b"]), ("t", [], ["x"]), ("u", ["a"], None)], "sample_id string, expected array<string>, found array<string>")
    assert {r["sample_id"]: r["entity_coverage"] for r in graph.entity_coverage(rows).collect()} == {"s": 0.5, "t": 1.0, "u": 0.0}
    modes = spark.createDataFrame([("a", "multi-hop", "global"), ("b", "local", "global")], "sample_id string, query_type string, search_mode string")
    assert {r["sample_id"]: r["mode_match"] for r in graph.mode_match(modes).collect()} == {"a": 1.0, "b": 0.0}
    paths = spark.createDataFrame([("s", "a", "b"), ("s", "b", "c")], "sample_id string, source string, target string")
    assert graph.path_accuracy(paths, spark.createDataFrame([("a", "b")], "source string, target string")).head()["graph_path_accuracy"] == 0.5


def test_questions(spark):
    docs = spark.createDataFrame([("a.txt", "a", "One. Two."), ("b.txt", "b", " "), ("c.txt", "c", "Three"), ("d.txt", "d", "Four")], "id string, title string, text string")
    got = questions.questions(docs, 10, questions.MODES).collect()
    assert [r["sample_id"] for r in got] == ["local-1", "local-2", "local-3", "local-4", "global-1", "multi-hop-1", "unanswerable-1"]
    assert got[0]["reference_answer"] == "One" and got[1]["reference_answer"].startswith("This document") and got[1]["reference_contexts"] == []
    assert got[4]["source_doc_ids"] == ["a.txt", "b.txt", "c.txt"] and got[5]["question"] == "How are a and b connected?"
    assert [r["sample_id"] for r in questions.questions(docs, 3, questions.MODES).collect()] == ["local-1", "local-2", "local-3"]
    assert questions.questions(docs.limit(1), 5, ("multi-hop",)).count() == 0 and questions.questions(docs, 5, ("other",)).count() == 0
    chosen = questions.selected_or_candidates(spark.createDataFrame([("q1", "local")], "question string, query_type string"), spark.createDataFrame([("q2", "local"), ("q3", "global")], "question string, query_type string"))
    assert {(r["question"], r["source"]) for r in chosen.collect()} == {("q1", "selected"), ("q3", "candidate")}
    out = questions.corpus_summary(questions.document_summaries(docs)).head()
    assert out["corpus_summary"] == "One. Two. Three Four" and out["themes"] == ["One", "Two", "Three Four"]
    assert {r["share"] for r in questions.query_distribution(spark.createDataFrame([("a",), ("b",), ("a",)], "query_type string")).collect()} == {0.5}


def test_assertions(spark):
    q = spark.createDataFrame([("q", "t", [("s1", 0), ("", 5), ("s3", None), ("s4", 1)])], "question_id string, question_text string, assertions array<struct<statement: string, rank: int>>")
    rows = assertions.assertion_rows(q)
    assert sorted((r["assertion"], r["rank"]) for r in rows.collect()) == [("s1", 1), ("s3", 3), ("s4", 1)]
    assert sorted(r["assertion"] for r in assertions.top_assertions(rows, 2).collect()) == ["s1", "s4"]
    answers = assertions.complete_answers(spark.createDataFrame([("q", "", "t", "a"), ("r", "", "t", ""), ("", "s", "t", "b")], "question_id string, sample_id string, question string, generated_answer string"))
    assert {r["question_id"] for r in answers.collect()} == {"q", "s"}
    assert assertions.to_judge(answers, rows, trials=3, k=1).count() == 3


def test_retrieval_scores(spark):
    got = spark.createDataFrame([("q", "u1", "c1", 3), ("q", "u2", "c2", 1)], "question_id string, unit_id string, cluster_id string, score int")
    relevance = spark.createDataFrame([("q", "c1", 1), ("q", "c3", 1)], "question_id string, cluster_id string, n int")
    row = retrieval.score(got, relevance, fidelity="tvd").head()
    assert (row["binary_precision"], row["recall"], row["fidelity"], row["total_queries"]) == (0.5, 0.5, 0.5, 1) and row["graded_precision"] == pytest.approx(2 / 3)
    one = retrieval.score(got.filter("unit_id = 'u2'"), relevance).head()
    assert one["binary_precision"] == 0.0 and one["graded_precision"] == pytest.approx(1 / 3)


def test_prepared_contexts_keep_their_order_and_ids(spark):
    results = spark.createDataFrame([("q1", "t", [("Known text", "s"), ("other", "src"), ("third", None)]), ("q2", "t", [])], "question_id string, question_text string, contexts array<struct<text: string, source: string>>")
    units = spark.createDataFrame([("u7", 0, "known  TEXT and more")], "unit_id string, pos int, text string")
    got = {r["question_id"]: [c["chunk_id"] for c in r["context"]] for r in retrieval.prepare(results, units).collect()}
    assert got == {"q1": ["u7", "src", "context-2"], "q2": []}
    rows = spark.createDataFrame([("x", [("", "s9", "t")])], "question_text string, context array<struct<chunk_id: string, source_id: string, text: string>>")
    out = retrieval.normalise_rows(rows).head()
    assert out["text"] == "x" and out["context"][0].asDict() == {"chunk_id": "s9", "text": "t"}


def test_pages_and_blocks(spark):
    pages = spark.createDataFrame([("p", "p.pdf", 2, 2, "", "text", "page 2: empty"), ("p", "p.pdf", 1, 2, "One", "ocr", None)], "source_path string, relative string, page int, pages int, text string, source string, warning string")
    row = ingest.join_pages(pages).head()
    assert row["text"] == "[page: 1]\nOne\n\n[page: 2]" and (row["page_count"], row["text_pages"], row["ocr_pages"], row["warnings"]) == (2, 0, 1, ["page 2: empty"])
    blocks = spark.createDataFrame([("p", "p", 0, "text", "low", [0.0, 9.0, 1.0, 1.0]), ("p", "p", 0, "figure", "", None), ("p", "p", 0, "text", "high", [5.0, 1.0, 1.0, 1.0])], "source_path string, relative string, page_index int, kind string, text string, bbox array<double>")
    assert ingest.block_pages(blocks).head()["text"] == "high\nlow\n[block: figure on page 1]"
    layout, plain = ingest.join_pages(ingest.block_pages(blocks)), ingest.join_pages(pages.unionByName(pages.withColumn("source_path", F.lit("q"))))
    assert {r["source_path"]: r["strategy"] for r in ingest.hybrid(layout, plain).collect()} == {"p": "layout", "q": "layout->pages"}
    assert len(ingest.staged_corpus(spark.createDataFrame([("a", "x y z")], "id string, text string")).head()["text"].split()) >= 180
