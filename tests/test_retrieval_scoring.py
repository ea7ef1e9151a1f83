from __future__ import annotations

import json

import pytest

from assayer import cli
from assayer.model import plane
from assayer.operators import retrieval, scores


def test_units_are_matched_by_id_short_id_or_text(spark):
    units = spark.createDataFrame([("u1", "1", "one", "k"), ("u2", "2", "two", "l"), ("u3", "2", "two", "m")], "unit_id string, short_id string, text string, cluster_id string")
    contexts = spark.createDataFrame([("q", "u1", "two"), ("q", "2", "other"), ("q", None, None)], "question_id string, chunk_id string, text string")
    got = {by: sorted((r["unit_id"] or "", r["cluster_id"] or "") for r in retrieval.match_units(contexts, units, by).collect()) for by in retrieval.MATCH}
    assert got == {"id": [("", ""), ("2", ""), ("u1", "k")], "short_id": [("", ""), ("u1", ""), ("u2", "l")], "text": [("", ""), ("2", ""), ("u2", "l")]}
    with pytest.raises(ValueError):
        retrieval.match_units(contexts, units, "name")


def test_methods_are_compared_with_a_correction(spark):
    rows = [(m, f"q{i}", v, v, 0.5, v) for m, v in (("a", 1.0), ("b", 0.2), ("c", 0.2)) for i in range(12)]
    each = spark.createDataFrame(rows, "rag_method string, question_id string, binary_precision double, graded_precision double, recall double, fidelity double")
    got = {c: {(r["metric_name"], r["first"], r["second"]): r for r in retrieval.compare(each, correction=c).collect()} for c in ("holm", "bonferroni", "none")}
    one = {c: got[c]["recall", "a", "b"] for c in got}
    assert all(len(g) == 12 for g in got.values()) and all(r["p_adjusted"] == 1.0 and not r["significant"] for r in one.values())
    r = {c: got[c]["fidelity", "a", "b"] for c in got}
    p = r["none"]["p_value"]
    assert (r["none"]["wins"], r["none"]["losses"]) == (12, 0) and 0 < p < 0.01 and all(x["significant"] for x in r.values())
    assert r["bonferroni"]["p_adjusted"] == pytest.approx(3 * p) and r["holm"]["p_adjusted"] == pytest.approx(3 * p)
    assert got["holm"]["fidelity", "a", "c"]["p_adjusted"] == pytest.approx(3 * p) and got["holm"]["fidelity", "b", "c"]["p_adjusted"] == 1.0
    with pytest.raises(ValueError):
        scores.corrected(each, "rag_method", "odd")


def test_retrieval_and_assertion_commands(spark, tmp_path, capsys):
    put = lambda name, value: ((tmp_path / name).write_text(json.dumps(value)), str(tmp_path / name))[1]
    found = put("r.json", [{"sample_id": "q", "question": "why", "answer": "the red fox", "retrieved_contexts": [{"text": "the red fox runs"}]}])
    spark.createDataFrame([("t1", "the red fox runs", "1"), ("t2", "the sea", "2")], "id string, text string, short_id string").write.parquet(str(tmp_path / "units.parquet"))
    spark.createDataFrame([("q", "t1", "c1", "semantic"), ("q", "t2", "c2", "centroid")], "question_id string, unit_id string, cluster_id string, kind string").write.parquet(str(tmp_path / "reference"))
    clusters = put("c.json", [{"cluster_id": "c1", "text_unit_ids": ["t1"]}, {"cluster_id": "c2", "text_unit_ids": ["t2"]}])
    assert cli.main(["retrieval-prep", "--results", found, "--units", str(tmp_path / "units.parquet"), "--output", str(tmp_path / "prep")], spark) == 0
    for by in ("id", "text"):
        assert cli.main(["retrieval-score", "--reference", str(tmp_path / "reference"), "--clusters", clusters, "--units", str(tmp_path / "units.parquet"), "--output", str(tmp_path / by), "--match-by", by, f"x={tmp_path / 'prep'}", f"y={tmp_path / 'prep'}"], spark) == 0
        got = {r["rag_method"]: (r["binary_precision"], r["recall"], r["total_queries"]) for r in spark.read.json(str(tmp_path / by / "summary")).collect()}
        assert got == {"x": (1.0, 0.5, 1), "y": (1.0, 0.5, 1)} and spark.read.json(str(tmp_path / by / "significance")).count() == 4
    asked = put("a.json", {"questions": [{"question_id": "q", "question_text": "why", "claim_count": 2, "assertions": [{"statement": "red fox"}, {"statement": "blue whale"}]}]})
    assert cli.main(["assertion-score", "--questions", asked, "--answers", found, "--output", str(tmp_path / "s")], spark) == 0
    assert sorted((r["assertion"], r["value"]) for r in spark.read.parquet(str(tmp_path / "s" / "scores")).collect()) == [("blue whale", 0.0), ("red fox", 1.0)]
    assert cli.main(["assertion-report", "--questions", asked, "--scores", str(tmp_path / "s" / "scores"), "--output", str(tmp_path / "a.html")], spark) == 0
    assert "blue whale" in (tmp_path / "a.html").read_text()
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "a.txt").write_text("text")
    assert cli.main(["stage", "--source", str(tmp_path / "docs"), "--output", str(tmp_path / "flat")], spark) == 0
    assert (tmp_path / "flat" / "a.txt").read_text().strip() == "text" and '"staged":1' in capsys.readouterr().out


def test_settings_and_registry():
    env = {"X_PROVIDER": " Local ", "X_EXTRA_BODY": '{"a": 1}', "X_BASE_URL": "http://localhost/v1", "X_MODEL": "m", "X_EMBEDDINGS_MODEL": "e", "X_EMBEDDINGS_NORMALIZE": "off", "X_EMBEDDINGS_MAX_SEQ_LENGTH": "64"}
    chat, vectors = plane.ModelConfig.from_env("X", env), plane.EmbeddingConfig.from_env("X", env, device="cpu")
    assert (chat.provider, chat.extra_body) == ("local", {"a": 1})
    assert (vectors.provider, vectors.model, vectors.normalize, vectors.max_seq_length, vectors.device, vectors.extra_body) == ("local", "e", False, 64, "cpu", None)
    for bad in ("[1]", "{"):
        with pytest.raises(ValueError):
            plane.EmbeddingConfig.from_env("X", {"X_EMBEDDINGS_EXTRA_BODY": bad})
    assert list(plane.resolve(["b", "a"], {"a": dict, "b": dict})) == ["b", "a"]
    with pytest.raises(ValueError, match="c"):
        plane.resolve(["c"], {"a": dict})
