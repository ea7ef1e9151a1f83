from __future__ import annotations

import pytest

import corpus_pipeline as pipeline

from .conftest import DOCS, prose, rows
from .test_fingerprints_and_packing import shingle_set
from .test_rules_and_mixing import counts

pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    texts = [prose(i, 80 + i % 50) for i in range(60)]
    texts += [t + " more" for t in texts[:10]] + ["too short", None, "x y " * 100, "secret = abcdef123 " + prose(99, 80)]
    spark.createDataFrame(rows(texts), DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1) for i in range(40)], "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_do_what_they_say(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    good = pipeline.quality(spark, docs, folder)
    want = {i for i, t in texts.items() if counts(t)[0] >= 50 and 100 * counts(t)[4] <= 50 * counts(t)[0]}
    assert {r["doc_id"] for r in good.collect()} == want and good.columns == docs.columns
    single = pipeline.near_duplicates(spark, good, folder)
    kept = {r["doc_id"] for r in single.collect()}
    alike = lambda a, b: 100 * len(a & b) >= 75 * len(a | b)
    sets = {i: shingle_set(texts[i]) for i in want}
    assert kept == {i for i in want if not any(j < i and alike(sets[i], sets[j]) for j in want)}
    clean = {r["doc_id"]: r for r in pipeline.secrets(spark, single, folder).collect()}
    assert set(clean) == kept and clean[73]["text"].startswith("[ASSIGN] ") and all(r["n_chars"] == len(r["text"]) for r in clean.values())
    assert all(r["text"] == texts[i] for i, r in clean.items() if i != 73)
    assert pipeline.mixing(spark, single, folder).columns == docs.columns


def test_run_and_names(spark, folder):
    assert [n for n, _ in pipeline.STAGES] == ["quality rules", "n-gram Jaccard join", "secret scans", "mixing sources to target weights", "packing"]
    got = pipeline.run(spark, folder)
    assert got.count() > 0 and {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"} <= set(got.columns)


def test_stages_take_any_rows(spark, edge, empty, folder):
    for docs in (edge, empty):
        for _, stage in pipeline.STAGES[:-1]:
            assert stage(spark, docs, folder).columns == docs.columns
            stage(spark, docs, folder).count()
        pipeline.packed(spark, docs, folder).count()
