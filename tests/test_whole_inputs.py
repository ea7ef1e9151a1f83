"""Catalogue queries over a small table whose ids, texts and sentences go beyond what a prefix or a subset would show."""

from __future__ import annotations

import re

import pytest

import __spark_entry__ as entry

IDS = range(7, 19)


def sentences(i: int) -> list[str]:
    return [f"Sentence {k} of {i} says word{i * 100 + k} and more" for k in range(14)]


TEXTS = {i: ". ".join(sentences(i)) + "." for i in IDS}
LABELS = {i: (i % 2, i % 3 % 2) for i in IDS if i != 9}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("whole"))
    docs = [(i, t, "en", "s", len(t)) for i, t in TEXTS.items()]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, *x) for i, x in LABELS.items()], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def run(spark, folder, name):
    return entry.queries()[name](spark, folder).collect()


def expected_assertions(i: int) -> list[tuple]:
    """(rank, assertion) of every sentence that isn't blanked."""
    parts = re.split(r"[.!?]\s+", TEXTS[i])
    return [(7 - k % 7 if k % 3 == 0 else k + 1, x) for k, x in enumerate(parts) if k % 4 != 3]


def test_all_sentences_are_assertions(spark, folder):
    got = run(spark, folder, "assertion_rows")
    assert sorted((r["question_id"], r["rank"], r["assertion"]) for r in got) == sorted((i, *x) for i in IDS for x in expected_assertions(i))
    assert all(r["rank"] > 0 for r in got) and len(got) == 11 * len(IDS)
    top = run(spark, folder, "assertion_topk")
    assert sorted((r["question_id"], r["rank"], r["assertion"]) for r in top) == sorted((i, *x) for i in IDS for x in sorted(expected_assertions(i))[:2])
    trials = run(spark, folder, "assertion_trials")
    assert sorted((r["question_id"], r["assertion"], r["trial"]) for r in trials) == sorted((i, x, t) for i in LABELS for _, x in sorted(expected_assertions(i))[:2] for t in (1, 2))
    overall = [r for r in run(spark, folder, "assertion_summary") if r["level"] == "overall"]
    assert [r["n"] for r in overall] == [11 * len(LABELS)]


def words(text: str) -> set[str]:
    return set(re.findall(r"[^\W_]+", text.lower()))


def test_answers_and_contexts_are_whole(spark, folder):
    want = {}
    for i in (i for i in LABELS if i + 1 in TEXTS):
        question, answer, reference = words(sentences(i)[0]), words(TEXTS[i]), words(TEXTS[i + 1])
        part = lambda a, b: len(a & b) / len(a)
        want[i, "lexical_context_precision"] = sum(part(reference, c) > 0.2 for c in (answer, reference)) / 2
        want[i, "lexical_context_recall"] = part(reference, answer | reference)
        want[i, "lexical_faithfulness"] = part(answer, answer | reference)
        want[i, "lexical_answer_relevancy"] = part(question, answer)
    got = {(r["sample_id"], r["metric_name"]): r["value"] for r in run(spark, folder, "lexical_metrics")}
    assert got == pytest.approx(want)
    assert {r["sample_id"]: r["answer"] for r in run(spark, folder, "strict_lookup_join")} == {i: TEXTS.get(2 * i, TEXTS[i]) for i in LABELS}


def test_answers_of_all_ids_have_their_references(spark, folder):
    got = [(r["question_id"], r["criteria"], r["trial"], r["answer"], r["reference"]) for r in run(spark, folder, "criteria_by_answer")]
    assert sorted(got) == sorted((i, c, t, str(toxic), "en") for i, (_, toxic) in LABELS.items() for c in ("correctness", "completeness") for t in (1, 2))


def test_questions_come_from_all_documents_and_modes(spark, folder):
    got = [(r["query_type"], r["sources"]) for r in run(spark, folder, "questions_all")]
    name = [f"doc-{i:09d}" for i in IDS]
    assert got == [("local", x) for x in name] + [("global", ",".join(name[:3])), ("multi-hop", ",".join(name[:2])), ("unanswerable", name[0])]


def test_summaries_go_beyond_the_first_twenty_documents(spark, tmp_path):
    docs = [(i, None if i % 2 else "", "en", "s", 0) for i in range(30)] + [(30, "One here.", "en", "s", 9), (31, "Two here. Three here. Four.", "en", "s", 27)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert [r["corpus_summary"] for r in run(spark, tmp_path, "corpus_summary")] == ["One here. Two here. Three here."]
    assert [r["theme"] for r in run(spark, tmp_path, "themes")] == ["One here", "Two here", "Three here"]
