from __future__ import annotations

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from assayer import cli, report
from assayer.model import plane
from assayer.operators import ingest
from assayer.sources import sinks, tables
from assayer.streaming.steps import read_steps, tallies


def put(folder, name: str, content: str) -> str:
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(content, encoding="utf-8")
    return str(path)


def test_text_tree(spark, tmp_path):
    for name in ("a.txt", "b/a.TXT", "c.md"):
        put(tmp_path, name, f"text of {name}\nmore")
    got = tables.text_tree(spark, str(tmp_path)).collect()
    assert sorted((r["id"], r["title"], r["text"]) for r in got) == [("a.TXT", "a", "text of b/a.TXT\nmore"), ("a.txt", "a", "text of a.txt\nmore")]
    with pytest.raises(FileNotFoundError):
        tables.text_tree(spark, str(tmp_path / "none"))


def test_samples_and_results(spark, tmp_path):
    rows = [{"sample_id": "a", "question": "q", "source_doc_ids": "d1", "metadata": {"n": 1}}, {"sample_id": "b", "question": "r", "search_mode": "global", "expected_entities": ["x", "y"], "reference_contexts": None}, 5]
    shapes = {"list.json": json.dumps(rows), "samples.json": json.dumps({"samples": rows}), "questions.json": json.dumps({"questions": rows}), "lines.jsonl": "\n\n".join(json.dumps(r) for r in rows[:2])}
    for name, content in shapes.items():
        got = {r["sample_id"]: r for r in tables.samples(spark, put(tmp_path, name, content)).drop("metadata").collect()}
        assert (got["a"]["query_type"], got["a"]["search_mode"], got["a"]["difficulty"], got["a"]["source_doc_ids"]) == ("unknown", "local", "medium", ["d1"])
        assert (got["b"]["search_mode"], got["b"]["expected_entities"], got["b"]["reference_contexts"]) == ("global", ["x", "y"], [])
    for bad in ('[{"question": "q"}]', '[{"sample_id": "a", "question": "q", "search_mode": "odd"}]', '{"other": []}'):
        with pytest.raises(PySparkException):
            tables.samples(spark, put(tmp_path, "bad.json", bad)).drop("metadata").collect()
    with pytest.raises(ValueError):
        tables.samples(spark, put(tmp_path, "x.yaml", ""))
    found = tables.search_results(spark, put(tmp_path, "r.json", '{"results": [{"sample_id": "a", "question": "q", "answer": "w", "retrieved_contexts": [{"source": "s"}, {"text": "t", "score": 0.5}], "citations": "c"}]}'))
    row = found.select("answer", F.transform("retrieved_contexts", lambda c: c["text"]).alias("t"), "citations").head()
    assert (row["answer"], row["t"], row["citations"]) == ("w", ["", "t"], ["c"])
    asked = tables.questions(spark, put(tmp_path, "q.json", '[{"text": "t0"}, {"question_id": "k"}, {"id": "i", "question": "t2"}, {"question": "t3"}]'), 2)
    assert sorted((r["question_id"], r["question_text"]) for r in asked.collect()) == [("i", "t2"), ("question-0", "t0")]


def test_clusters_frames_and_graph(spark, tmp_path):
    path = put(tmp_path, "c.json", json.dumps([{"cluster_id": "k", "text_unit_ids": ["u1", "u9"]}, {"id": "l", "text_units": [{"id": "v", "text": "own"}]}]))
    units = spark.createDataFrame([("u1", "one", "1")], "unit_id string, text string, short_id string")
    assert sorted((r["cluster_id"], r["unit_id"], r["text"]) for r in tables.cluster_units(spark, path, units).collect()) == [("k", "u1", "one"), ("k", "u9", ""), ("l", "v", "own")]
    with pytest.raises(ValueError):
        tables.cluster_units(spark, path)
    assert tables.frame(spark, put(tmp_path, "f.csv", 'a,b\n1,"x\ny"\n')).head()["b"] == "x\ny" and tables.frame(spark, put(tmp_path, "f.jsonl", '{"a": 1}\n{"a": 2}')).count() == 2
    with pytest.raises(ValueError):
        tables.frame(spark, "f.xls")
    with pytest.raises(FileNotFoundError, match="entities, relationships, communities"):
        tables.graph_tables(spark, str(tmp_path))
    for name in tables.GRAPH_REQUIRED:
        units.write.parquet(str(tmp_path / f"{name}.parquet"))
    assert tables.graph_tables(spark, str(tmp_path))["covariates"] is None


def test_steps_junit_ontology(spark, tmp_path):
    got = tables.steps(spark, put(tmp_path, "s.jsonl", '{"step": "a", "exit_code": 0, "log": "l"}\nbroken {\n\n{"step": "b"}\n')).collect()
    assert [tuple(r) for r in got] == [("a", 0, "l"), ("broken {", 1, ""), ("b", None, "")]
    xml = '<testsuite><testcase name="a" classname="c"/><testcase name="b" classname="c"><failure>x</failure></testcase><testcase name="d" classname="c"><skipped/></testcase></testsuite>'
    assert {r["name"]: r["status"] for r in tables.junit(spark, put(tmp_path, "j.xml", xml)).collect()} == {"a": "passed", "b": "failed", "d": "skipped"}
    assert tables.ontology(put(tmp_path, "o.json", '{"allowed_types": [" A ", ""], "extraction_rules": ["r"]}')) == tables.Ontology(("A",), {"raw": ["r"]}) and tables.ontology("none") is None


def test_tree_of_mixed_files(spark, tmp_path):
    root = tmp_path / "in"
    put(root, "a.txt", "plain\n")
    put(root, "sub/b.md", "---\ntitle: B\n---\n# Head\n\n" + "word " * 500)
    put(root, "c.json", '[{"id": "x y", "text": "row"}, {"k": 1}, 3]')
    put(root, "d.csv", "h\n1\n")
    put(root, "e.pdf", "two pages")
    put(root, "f.bin", "no")

    class Reads:
        name = "reader"

        def page(self, content: bytes, number: int, pages: int) -> str:
            return f"read {number}"

    docs, entries = ingest.normalise_tree(spark, str(root), reader=_two_pages, ocr=Reads())
    rows = {r["canonical_path"]: r for r in docs.collect()}
    assert {"a.txt", "c__0001__x_y.txt", "c__0002__row-2.txt", "d.txt", "e.txt"} <= set(rows) and sum(k.startswith("sub/b__chunk_0") for k in rows) == 4
    assert rows["sub/b__chunk_0001.txt"]["title"] == "Head" and rows["c__0002__row-2.txt"]["text"] == '{"k":1}' and rows["e.txt"]["text"] == "[page: 1]\n" + "x" * 30 + "\n\n[page: 2]\nread 2"
    pdf = entries.filter("kind = 'pdf'").head()
    assert (pdf["page_count"], pdf["text_pages"], pdf["ocr_pages"]) == (2, 1, 1)
    assert {r["name"] for r in sinks.staged(docs.filter("kind = 'markdown'")).collect()} == {f"sub__b__chunk_000{i}.txt" for i in range(1, 5)}
    twice = docs.filter("kind = 'csv'").unionByName(docs.filter("kind = 'csv'"))
    assert ingest.collisions(twice).count() == 1
    with pytest.raises(PySparkException, match="several documents"):
        sinks.staged(twice).collect()
    sinks.text_files(str(tmp_path / "out"), docs)
    assert (tmp_path / "out" / "sub" / "b__chunk_0001.txt").exists()


def _two_pages(content: bytes) -> list[str]:
    return ["x" * 30, " "]


class _Paged(list):
    """Pages of a made-up format: one a line; a line that says so can't be read."""

    def __init__(self, content: bytes):
        if content.startswith(b"broken"):
            raise ValueError("no such\nformat")
        super().__init__(content.decode().splitlines() if content != b"none" else [])

    def __getitem__(self, at):
        if super().__getitem__(at) == "bad":
            raise KeyError("glyph")
        return super().__getitem__(at)


class _Scans:
    name = "scans"

    def page(self, content: bytes, number: int, pages: int) -> str:
        if number == 3:
            raise RuntimeError("no lamp")
        return "" if number == 4 else f"seen {number}"


def test_failing_pages_are_told_and_the_rest_is_read(spark, tmp_path):
    root, long = tmp_path / "in", "x" * 25
    put(root, "a.pdf", "broken")
    put(root, "b.pdf", f"{long}\nbad\nbad\nshort")
    put(root, "c.pdf", "\n".join(f"{n:025d}" for n in range(1, 5001)))
    put(root, "d.pdf", "none")
    docs, entries = ingest.normalise_tree(spark, str(root), reader=_Paged, ocr=_Scans())
    rows = {r["canonical_path"]: r for r in entries.collect()}
    counts = lambda r: (r["strategy"], r["page_count"], r["text_pages"], r["ocr_pages"])
    assert counts(rows["a.txt"]) == ("failed", 0, 0, 0) and rows["a.txt"]["warnings"] == ["can't be opened (ValueError: no such format)"] and rows["a.txt"]["text_chars"] == 0
    assert counts(rows["b.txt"]) == ("pages", 4, 2, 1) and rows["b.txt"]["warnings"] == [
        "page 2: its text can't be read (KeyError: 'glyph')", "page 3: its text can't be read (KeyError: 'glyph'); OCR by scans failed (RuntimeError: no lamp)", "page 4: OCR by scans found no text"
    ]
    assert counts(rows["c.txt"]) == ("pages", 5000, 5000, 0) and rows["c.txt"]["warnings"] == [] and rows["d.txt"]["warnings"] == ["no pages"]
    texts = {r["canonical_path"]: r["text"] for r in docs.collect()}
    assert set(texts) == {"b.txt", "c.txt"} and texts["b.txt"] == f"[page: 1]\n{long}\n\n[page: 2]\nseen 2\n\n[page: 3]\n\n[page: 4]\nshort"
    assert texts["c.txt"] == "\n\n".join(f"[page: {n}]\n{n:025d}" for n in range(1, 5001))
    pages = tables.pdf_pages(tables.source_files(spark, str(root)), _Paged, None, together=7)  # ranges give the same rows
    assert sorted(map(tuple, pages.collect()), key=str) == sorted(map(tuple, tables.pdf_pages(tables.source_files(spark, str(root)), _Paged, None, together=9000).collect()), key=str)


def _blocks_of(content: bytes):
    if content.startswith((b"broken", b"flat")):
        raise ValueError("no layout")
    return 2, [{"kind": "text", "text": "low", "page_index": 0, "bbox": [0, 9, 1, 10]}, {"kind": "Title", "text": "high", "page_index": 0, "bbox": [0, 1, 1, 2]}, {"kind": "figure", "page_index": 1, "bbox": [0, 0, 1, 1]}, {"kind": "table", "text": "t", "page_index": 1, "bbox": [0, 5, 1, 6]}]


class _Says:
    name = "says"

    def describe(self, content: bytes, block: dict, page: int, pages: int, page_text: str) -> str:
        if block["kind"] == "table":
            raise ValueError("cells")
        return f"a {block['kind']} on {page} of {pages} near {page_text}"


def test_layout_falls_back_to_pages(spark, tmp_path):
    root = tmp_path / "in"
    put(root, "a.pdf", "broken")
    put(root, "b.pdf", "flat " + "x" * 25)
    put(root, "c.pdf", "good")
    docs, entries = ingest.normalise_tree(spark, str(root), reader=_Paged, layout=_blocks_of, describer=_Says())
    rows = {r["canonical_path"]: r for r in entries.collect()}
    assert {k: r["strategy"] for k, r in rows.items()} == {"a.txt": "failed", "b.txt": "layout->pages", "c.txt": "layout"}
    assert rows["a.txt"]["warnings"] == ["no layout (ValueError: no layout); can't be opened (ValueError: no such format)"] and rows["b.txt"]["warnings"] == ["no layout (ValueError: no layout)"]
    assert rows["c.txt"]["warnings"] == ["page 2: description by says failed (ValueError: cells)"] and (rows["c.txt"]["page_count"], rows["b.txt"]["page_count"]) == (2, 1)
    texts = {r["canonical_path"]: r["text"] for r in docs.collect()}
    assert texts == {"b.txt": "[page: 1]\nflat " + "x" * 25, "c.txt": "[page: 1]\nhigh\nlow\n\n[page: 2]\na figure on 2 of 2 near t\nt"}


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("a", "m", 1.0, None)], "sample_id string, metric_name string, value double, reason string")
    first, second = sinks.versioned(str(tmp_path / "t"), df), sinks.versioned(str(tmp_path / "t"), df)
    assert (first[-3:], second[-3:]) == ("/v0", "/v1")
    sinks.evaluation(str(tmp_path / "e.json"), df, df.select("sample_id"), spark.createDataFrame([("m", 1.0)], "metric_name string, mean_value double"))
    assert json.loads((tmp_path / "e.json").read_text()) == {"scores": [{"sample_id": "a", "metric_name": "m", "value": 1.0, "reason": None}], "results": [{"sample_id": "a"}], "aggregate": {"m": 1.0}}
    assert sinks.upsert_settings("A=1\n# c\nB=2", {"B": "3", "C": "4"}) == "A=1\n# c\nB=3\nC=4\n"
    sinks.state(str(tmp_path / "s.json"), df.select("sample_id", "value"), "sample_id")
    assert json.loads((tmp_path / "s.json").read_text())["a"]["value"] == 1.0
    assert json.loads(sinks.envelope(df, "c", {"k": 1}).head()["metadata"]) == {"component": "c", "k": 1}


class Counting:
    def answer(self, prompt: str) -> str:
        return '{"correctness": 1}' if "alpha" in prompt else "no"


def test_judge_runs_once_for_each_new_prompt(spark):
    prompts = spark.createDataFrame([("alpha",), ("alpha",), ("beta",)], "prompt string")
    first = plane.ask(prompts, Counting())
    assert first.count() == 2
    cache = spark.createDataFrame([(r["prompt_id"], "kept") for r in first.filter("raw = 'no'").collect()], "prompt_id string, raw string")
    assert sorted(r["raw"] for r in plane.ask(prompts, Counting(), cache).collect()) == ["kept", '{"correctness": 1}']


class Length:
    def score(self, answer: str, reference: str) -> float:
        return float(len(answer) == len(reference))


def test_metrics_embeddings_and_search(spark):
    rows = spark.createDataFrame([("a", "q", "xx", "yy"), ("b", "q", "x", "yy")], "sample_id string, question string, answer string, reference_answer string")
    assert {r["sample_id"]: r["value"] for r in plane.run_metrics(rows, {"length": Length}).collect()} == {"a": 1.0, "b": 0.0}
    units = spark.createDataFrame([("u", "some text", None), ("v", "", None), ("w", "t", [1.0])], "unit_id string, text string, text_embedding array<float>")
    got = {r["unit_id"]: r["text_embedding"] for r in plane.fill_embeddings(units, plane.HashEmbedder(8)).collect()}
    assert sum(x * x for x in got["u"]) == pytest.approx(1.0, abs=1e-6) and got["v"] is None and got["w"] == [1.0]
    found = plane.search(spark.createDataFrame([("s", "why", "local")], "sample_id string, question string, search_mode string"), plane.StubSearcher([{"text": "c"}])).head()
    assert json.loads(found["result"])["answer"] == "Stub answer for local: why"
    scored = plane.lexical_scores(spark.createDataFrame([("s", "red fox", "the fox is red", "fox red", ["a red fox", "blue sky"])], "sample_id string, question string, answer string, reference_answer string, retrieved_contexts array<string>"))
    values = {r["metric_name"]: r["value"] for r in scored.collect()}
    assert values == {"lexical_context_precision": 0.5, "lexical_context_recall": 1.0, "lexical_faithfulness": 0.5, "lexical_answer_relevancy": 1.0}


def test_model_config():
    c = plane.ModelConfig.from_env("X", {"X_BASE_URL": "http://localhost:1/v1", "X_MODEL": "m", "X_MAX_TOKENS": " 9 "}, model="n")
    assert (c.model, c.max_tokens, c.sequence) == ("n", 9, 128)
    with pytest.raises(ValueError):
        plane.ModelConfig("http://example.com", "m")
    assert plane.parse_flag(" On ") and not plane.parse_flag("off", True) and plane.parse_flag(None, True) and plane.parse_whole(" ") is None


def test_stream_of_steps(spark, tmp_path):
    put(tmp_path / "in", "a.jsonl", '{"step": "a", "exit_code": 0}\nbroken\n')
    q = tallies(read_steps(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("tallies").start()
    try:
        q.processAllAvailable()
        assert [(r["passed"], r["failed"]) for r in spark.table("tallies").collect()] == [(1, 1)]
    finally:
        q.stop()


def test_commands(spark, tmp_path, capsys):
    bench = put(tmp_path, "b.json", '[{"sample_id": "a", "question": "q", "reference_answer": "red fox"}]')
    found = put(tmp_path, "r.json", '[{"sample_id": "a", "question": "q", "answer": "a red fox", "retrieved_contexts": [{"text": "the red fox", "source": "s"}]}]')
    for metrics in ("correctness", "lexical"):
        assert cli.main(["evaluate", "--benchmark", bench, "--results", found, "--output", str(tmp_path / metrics), "--metrics", metrics], spark) == 0
    assert json.loads((tmp_path / "correctness" / "evaluation.json").read_text())["aggregate"] == {"correctness": 1.0}
    put(tmp_path / "docs", "x.txt", "One. Two.")
    assert cli.main(["generate-questions", "--source", str(tmp_path / "docs"), "--output", str(tmp_path / "q")], spark) == 0
    assert cli.main(["summarise", "--source", str(tmp_path / "docs"), "--output", str(tmp_path / "sum")], spark) == 0
    assert cli.main(["normalise", "--source", str(tmp_path / "docs"), "--output", str(tmp_path / "n")], spark) == 0
    g = tmp_path / "g"
    spark.createDataFrame([("n1", "word " * 60 + ". end", "N")], "id string, description string, title string").write.parquet(str(g / "entities.parquet"))
    spark.createDataFrame([("n1", "n1", "r")], "source string, target string, description string").write.parquet(str(g / "relationships.parquet"))
    spark.createDataFrame([("c1", ["t1"])], "id string, text_unit_ids array<string>").write.parquet(str(g / "communities.parquet"))
    spark.createDataFrame([("t1", "the red fox runs")], "id string, text string").write.parquet(str(g / "text_units.parquet"))
    assert cli.main(["split-nodes", "--graph", str(g), "--output", str(tmp_path / "split")], spark) == 0
    assert cli.main(["inspect", "--graph", str(g)], spark) == 0
    assert cli.main(["retrieval", "--graph", str(g), "--results", found, "--output", str(tmp_path / "ret")], spark) == 0
    out = capsys.readouterr().out
    assert '"binary_precision":1.0' in out and '"child_nodes":3' in out or '"child_nodes"' in out
    steps = put(tmp_path, "steps.jsonl", '{"step": "a", "exit_code": 0}')
    assert cli.main(["pipeline-report", "--output", str(tmp_path / "p.html"), f"main={steps}"], spark) == 0
    assert "<h2>main</h2>" in (tmp_path / "p.html").read_text()


def test_prompts_and_prepared_parts(spark, tmp_path):
    from assayer.functions import prompts
    from assayer.operators.assertions import prepared

    o = tables.Ontology(("Person",), {"a": 1, "b": ["x"]})
    role = prompts.relation_role(o)
    assert all(f"- {r}" in role for r in prompts.RELATIONS) and "- Person" in role and '- b:\n  [' in role and "- none" in prompts.entity_role(None)
    assert prompts.with_role("# Top\n## System Role\nold\n### User Role\nask\n", "new") == "# Top\n## System Role\nnew\n\n### User Role\nask\n"
    assert prompts.with_role("ask", "new") == "### System Role\nnew\n\nask" and prompts.with_role("System role\nold\nTask\nx", "n") == "System role\nn\n\nTask\nx\n"
    put(tmp_path, "assertions.json", '[{"q": 1}]')
    put(tmp_path, "map_assertions_stats.json", "{}")
    assert sorted(tuple(r) for r in prepared(spark, str(tmp_path)).collect()) == [("map_stats", "{}"), ("questions", '[{"q":1}]')]


def test_reports():
    assert report.shown(1.0) == "1" and report.shown(0.25) == "0.25" and report.shown(None) == ""
    assert "nothing can be said" in report.interpretation({}, 0)[0] and len(report.interpretation({"a": 1.0, "b": 0.5}, 9)) == 3
    assert "1 of 2 passed" in report.progress_markdown([{"node": "b", "status": "passed"}, {"node": "a", "status": "failed"}])
