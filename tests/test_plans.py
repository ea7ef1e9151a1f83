"""Plans that must not do the same work twice, and operators that mustn't hold a table in one task."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from assayer.functions.text import split_description, text_key
from assayer.operators import graph, joins, questions
from assayer.sources import tables


def test_descriptions_are_split_once(spark):
    nodes = spark.createDataFrame([("a", "One. " * 100), ("b", "short")], "id string, description string")
    splits = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("split(")
    assert splits(graph.split_nodes(nodes)) == splits(nodes.select(split_description(F.col("description"), 200).alias("p")))


def test_numbers_follow_the_order_of_all_documents(spark):
    docs = spark.createDataFrame([(f"d{i:04d}", f"t{i}", f"Text {i}. More.") for i in range(300)], "id string, title string, text string").repartition(7)
    rows, total = questions.numbered(docs)
    assert total == 300 and [(r["pos"], r["id"]) for r in rows.collect()] == [(i + 1, f"d{i:04d}") for i in range(300)]
    assert questions.numbered(docs.limit(0))[1] == 0


@pytest.mark.parametrize("most", [2, 5, 40, 41, 43, 100])
def test_many_questions_are_the_same_as_a_few(spark, monkeypatch, most):
    docs = spark.createDataFrame([(f"d{i:04d}", f"t{i}", f"Text {i}. More.") for i in range(40)], "id string, title string, text string").repartition(3)
    for modes in (questions.MODES, ("global", "unanswerable"), ("local",), ("nothing",)):
        few = questions.questions(docs, most, modes).collect()
        monkeypatch.setattr(questions, "AT_ONCE", 0)
        assert questions.questions(docs, most, modes).collect() == few
        monkeypatch.undo()
    monkeypatch.setattr(questions, "AT_ONCE", 0)
    assert questions.questions(docs.limit(1), most).count() == 2 and questions.questions(docs.limit(0), most).count() == 0


def test_prefixes_agree_with_brute_force(spark):
    r = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta"]
    units = [(i, 1000 - i, " ".join(r.choice(words) for _ in range(r.choice([0, 1, 2, 3, 6, 8, 12, 30, 70])))) for i in range(120)]
    contexts = [(i, (u + " tail" if r.random() < 0.2 else u[: r.randint(0, len(u))]).upper()) for i in range(200) for u in [r.choice(units)[2]]]
    key = lambda t: " ".join(t.split()).lower()
    want = {}
    for i, t in contexts:
        k = key(t)
        exact = [(p, u) for u, p, x in units if key(x) == k and k]
        either = [(p, u) for u, p, x in units if k and key(x) and (key(x).startswith(k) or k.startswith(key(x)))]
        want[i] = min(exact or either, default=(None, None))[1]
    got = joins.resolve_units(spark.createDataFrame(contexts, "context_id long, text string"), spark.createDataFrame(units, "unit_id long, pos long, text string"))
    assert {x["context_id"]: x["unit_id"] for x in got.collect()} == want
    assert spark.range(1).select(text_key(F.lit("  A \t b "))).head()[0] == "a b"


def test_lists_that_are_too_long_are_no_lists(spark, monkeypatch):
    monkeypatch.setattr(joins, "MANY", 3)
    assert joins.every_pair(spark.range(2), spark.range(3).toDF("m")).count() == 6
    with pytest.raises(ValueError):
        joins.every_pair(spark.range(2), spark.range(4).toDF("m"))


def test_lines_are_numbered_over_all_splits(spark, tmp_path):
    path = tmp_path / "many.jsonl"
    path.write_text("\n".join(json.dumps({"text": f"question {i}?"}) + ("\n  " if i % 50 == 0 else "") for i in range(3000)) + "\n")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        got = tables.questions(spark, str(path)).orderBy("pos").collect()
        assert tables.numbered_lines(spark, str(path)).rdd.getNumPartitions() > 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert [(r["question_id"], r["question_text"]) for r in got] == [(f"question-{i}", f"question {i}?") for i in range(3000)]


def test_summaries_without_sentence_ends_go_on_until_they_end(spark):
    rows = [(f"d{i:03d}", "t", f"part {i}") for i in range(60)] + [("d900", "t", "end. Two. Three. Four; five; six; seven.")]
    got = questions.corpus_summary(spark.createDataFrame(rows, "id string, title string, summary string")).head()
    corpus = " ".join(s for _, _, s in rows)
    assert got["corpus_summary"] == corpus.split(" Four")[0] and got["themes"] == [corpus.split(".")[0], "Two", "Three", "Four", "five"]
