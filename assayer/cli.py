"""Command line: each command fills a plan and runs it. Commands that only drive other products aren't there."""

from __future__ import annotations

import argparse
import json
from collections.abc import Sequence

from pyspark.sql import functions as F

from assayer.plans import jobs
from assayer.session import build_session
from assayer.sources import sinks, tables


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="assayer", description="Prepare and score retrieval-augmented question answering with Spark.")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, *options: str, help: str) -> argparse.ArgumentParser:  # noqa: A002
        c = sub.add_parser(name, help=help)
        for o in options:
            c.add_argument(f"--{o}", required=True)
        return c

    c = add("evaluate", "benchmark", "results", "output", help="score saved results")
    c.add_argument("--metrics", default="correctness", help="names with commas between them: " + ", ".join([*jobs.GROUPS, *jobs.KNOWN]))
    c.add_argument("--skip-missing", action="store_true", help="leave out samples without a result")
    c = add("generate-questions", "source", "output", help="questions by rule from text files")
    c.add_argument("--count", type=int, default=10)
    c.add_argument("--modes", nargs="*", default=["local", "global"])
    c = add("normalise", "source", "output", help="mixed files to canonical documents")
    c.add_argument("--chunk-size", type=int, default=1000)
    c.add_argument("--overlap", type=int, default=200)
    c = add("split-nodes", "graph", "output", help="split long descriptions of a graph")
    c.add_argument("--most", type=int, default=200)
    add("inspect", "graph", help="count a graph's tables")
    add("summarise", "source", "output", help="summaries and themes of text files")
    c = add("retrieval", "graph", "results", "output", help="retrieval metrics of saved results")
    c.add_argument("--fidelity", default="js")
    c.add_argument("--neighbours", type=int, default=10)
    c.add_argument("--centroids", type=int, default=5)
    add("stage", "source", "output", help="mixed files to flat text files")
    add("retrieval-prep", "results", "units", "output", help="saved results to retrieval rows with ids of text units")
    c = add("retrieval-reference", "questions", "clusters", "output", help="rate the units near each question in every cluster")
    c.add_argument("--units")
    c.add_argument("--semantic-neighbors", type=int, default=10)
    c.add_argument("--centroid-neighbors", type=int, default=5)
    c.add_argument("--max-questions", type=int)
    c = add("reference-score", "answers", "references", "output", help="answers against reference answers, by criteria")
    c.add_argument("--trials", type=int, default=1)
    c = add("retrieval-score", "reference", "clusters", "output", help="retrieval rows against a reference")
    c.add_argument("results", nargs="+", help="method=path of retrieval rows")
    c.add_argument("--units")
    c.add_argument("--match-by", default="id", choices=("id", "short_id", "text"))
    c.add_argument("--threshold", type=int, default=2)
    c.add_argument("--fidelity", default="js")
    c.add_argument("--alpha", type=float, default=0.05)
    c.add_argument("--correction", default="holm", choices=("holm", "bonferroni", "none"))
    c = add("assertion-score", "questions", "answers", "output", help="answers against assertions")
    c.add_argument("--trials", type=int, default=1)
    c.add_argument("--top", type=int)
    add("assertion-report", "questions", "scores", "output", help="a report of assertion scores")
    c = add("pipeline-report", "output", help="a report of step summaries")
    c.add_argument("summaries", nargs="+", help="name=path of JSON lines")
    return p


def main(argv: Sequence[str] | None = None, spark=None) -> int:
    a = parser().parse_args(argv)
    spark = spark or build_session()
    if a.command == "evaluate":
        out = jobs.Evaluate(a.benchmark, a.results, a.output, a.metrics, strict=not a.skip_missing).run(spark)
    elif a.command == "generate-questions":
        out = jobs.GenerateQuestions(a.source, a.output, a.count, tuple(a.modes)).run(spark)
    elif a.command == "normalise":
        out = jobs.Normalise(a.source, a.output, a.chunk_size, a.overlap).run(spark)
    elif a.command == "split-nodes":
        out = jobs.SplitNodes(a.graph, a.output, a.most).run(spark)
    elif a.command == "inspect":
        from assayer.operators.graph import cardinalities

        out = cardinalities(**{n: t for n, t in tables.graph_tables(spark, a.graph).items() if t is not None})
    elif a.command == "summarise":
        out = jobs.Summarise(a.source, a.output).run(spark)
    elif a.command == "retrieval":
        out = jobs.RetrievalSmoke(a.graph, a.results, a.output, a.neighbours, a.centroids, a.fidelity).run(spark)
    elif a.command == "stage":
        from assayer.operators import ingest

        docs = sinks.staged(ingest.normalise_tree(spark, a.source)[0])
        sinks.text_files(a.output, docs.withColumn("canonical_path", F.col("name")))
        out = docs.agg(F.count(F.lit(1)).alias("staged"))
    elif a.command == "retrieval-prep":
        out = jobs.PrepareRetrieval(a.results, a.units, a.output).run(spark)
    elif a.command == "retrieval-reference":
        out = jobs.RetrievalReference(a.questions, a.clusters, a.output, a.units, a.semantic_neighbors, a.centroid_neighbors, a.max_questions).run(spark)
    elif a.command == "reference-score":
        given, wanted = (jobs.answer_inputs(spark, p) for p in (a.answers, a.references))
        out = jobs.ScoreReferences(given, wanted.select("question_id", "answer").dropna(), a.output, trials=a.trials).run(spark)
    elif a.command == "retrieval-score":
        out = jobs.ScoreRetrieval(a.reference, a.clusters, dict(r.split("=", 1) for r in a.results), a.output, a.units, a.match_by, a.threshold, a.fidelity, a.alpha, a.correction).run(spark)
    elif a.command == "assertion-score":
        out = jobs.ScoreAssertions(*jobs.assertion_inputs(spark, a.questions, a.answers), a.output, a.trials, a.top).run(spark)
    elif a.command == "assertion-report":
        from assayer import report

        asked = tables.json_items(spark, a.questions, ("questions", "assertions")).select(F.coalesce(F.try_variant_get("item", "$.claim_count", "long"), F.lit(0)).alias("claim_count"), F.coalesce(F.size(F.try_variant_get("item", "$.assertions", "array<variant>")), F.lit(0)).alias("assertion_count"))
        sinks.write_text(spark, a.output, report.assertion_report(asked, spark.read.parquet(a.scores)))
        print(json.dumps({"written": a.output}))
        return 0
    else:
        from assayer import report

        named = {n: tables.steps(spark, path) for n, _, path in (s.partition("=") for s in a.summaries)}
        sinks.write_text(spark, a.output, report.pipeline_report(named))
        print(json.dumps({"written": a.output}))
        return 0
    for row in out.limit(20).toJSON().collect():
        print(row)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
