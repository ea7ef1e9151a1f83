"""Whole jobs from paths to written results. A plan holds paths and settings; what it computes are DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer import report
from assayer.functions.verdicts import rated
from assayer.model import claims
from assayer.model.plane import Embedder, HashEmbedder, Judge, LexicalJudge, Metric, ask, fill_embeddings, judge_correctness, lexical_scores, resolve, run_metrics
from assayer.operators import assertions, graph, ingest, questions, retrieval, scores
from assayer.operators import reference as references
from assayer.operators.joins import strict_lookup
from assayer.sources import sinks, tables


#: What a metric's name stands for, and the metrics that one name asks for together.
LEXICAL = ("lexical_context_precision", "lexical_context_recall", "lexical_faithfulness", "lexical_answer_relevancy")
GROUPS = {"lexical": LEXICAL, "claims": claims.METRICS}
KNOWN = {"correctness": "correctness"} | dict.fromkeys(LEXICAL, "lexical") | dict.fromkeys(claims.METRICS, "claims")


@dataclass(frozen=True)
class Evaluate:
    """Saved results scored by metrics that are asked for by name, separated by commas: correctness by a judge, the lexical variants of the usual metrics (all: lexical), those
    metrics by claims (all: claims), and metrics of one's own. A name that is none of these is a ValueError before anything runs.
    """

    benchmark: str
    results: str
    output: str
    metrics: str = "correctness"
    judge: Judge = field(default_factory=LexicalJudge)
    strict: bool = True
    claim_judge: Judge = field(default_factory=claims.ClaimJudge)
    embedder: Embedder = field(default_factory=HashEmbedder)
    own: Mapping[str, Callable[[], Metric]] = field(default_factory=dict)

    def run(self, spark: SparkSession) -> DataFrame:
        names = [n for part in self.metrics.split(",") if (word := part.strip()) for n in GROUPS.get(word, (word,))]
        families: dict[str, list[str]] = {}
        for name, family in resolve(names, KNOWN | dict.fromkeys(self.own, "own")).items():
            families.setdefault(family, []).append(name)
        if not families:
            raise ValueError("no metrics are asked for")
        samples, results = tables.samples(spark, self.benchmark), tables.search_results(spark, self.results)
        found = results.select("sample_id", "pos", "answer", F.filter(F.transform("retrieved_contexts", lambda c: c["text"]), lambda t: t.isNotNull() & (t != "")).alias("retrieved_contexts"))
        rows = strict_lookup(samples.select("sample_id", "question", "reference_answer"), found, "sample_id", F.col("pos"), self.strict)
        parts = []
        for family, wanted in families.items():
            if family == "correctness":
                parts.append(judge_correctness(samples, results, self.judge, strict=self.strict))
            elif family == "lexical":
                parts.append(lexical_scores(rows).filter(F.col("metric_name").isin(wanted)))
            elif family == "claims":
                parts.append(claims.claim_scores(rows, self.claim_judge, self.embedder, metrics=tuple(wanted)))
            else:
                parts.append(run_metrics(rows.drop("pos"), {n: self.own[n] for n in wanted}))
        made = parts[0]
        for p in parts[1:]:
            made = made.unionByName(p, allowMissingColumns=True)
        made.write.mode("overwrite").parquet(f"{self.output}/scores")  # judged once; all below reads what is written
        kept = spark.read.parquet(f"{self.output}/scores")
        sinks.evaluation(f"{self.output}/evaluation.json", kept.orderBy("sample_id", "metric_name"), results.drop("pos"), scores.by_metric(kept))
        sinks.write_text(spark, f"{self.output}/report.html", report.evaluation_report(kept, results.count()))
        return kept


@dataclass(frozen=True)
class GenerateQuestions:
    source: str
    output: str
    count: int = 10
    modes: tuple[str, ...] = ("local", "global")
    metadata: dict[str, Any] = field(default_factory=dict)

    def run(self, spark: SparkSession) -> DataFrame:
        known = tuple(m for m in questions.MODES if m in self.modes) or ("local", "global")
        docs = tables.text_tree(spark, self.source)
        made = questions.questions(docs.withColumn("order", F.split("source_path", "/")), self.count, known, "order")
        made.write.mode("overwrite").json(f"{self.output}/questions")
        sinks.envelope(made, "questions", {"num_questions": self.count, "modes": list(known), **self.metadata}, "question").write.mode("overwrite").json(f"{self.output}/payload")
        return spark.read.schema(made.schema).json(f"{self.output}/questions")


@dataclass(frozen=True)
class Normalise:
    source: str
    output: str
    chunk_size: int = 1000
    overlap: int = 200

    def run(self, spark: SparkSession) -> DataFrame:
        docs, entries = ingest.normalise_tree(spark, self.source, self.chunk_size, self.overlap)
        sinks.documents(f"{self.output}/documents", docs)
        sinks.manifest(f"{self.output}/manifest", entries)
        return spark.read.parquet(f"{self.output}/documents")


@dataclass(frozen=True)
class SplitNodes:
    """Splits long descriptions of a graph's nodes and writes new versions of both tables."""

    root: str
    output: str
    most: int = 200

    def run(self, spark: SparkSession) -> DataFrame:
        found = tables.graph_tables(spark, self.root)
        nodes, edges = found["entities"], found["relationships"]
        children = graph.split_nodes(nodes, self.most)
        sinks.versioned(f"{self.output}/entities", graph.with_children(nodes, children))
        sinks.versioned(f"{self.output}/relationships", edges.unionByName(graph.part_of_edges(children, edges), allowMissingColumns=True))
        return graph.split_statistics(children)


@dataclass(frozen=True)
class Summarise:
    source: str
    output: str

    def run(self, spark: SparkSession) -> DataFrame:
        each = questions.document_summaries(tables.text_tree(spark, self.source))
        each.write.mode("overwrite").json(f"{self.output}/documents")
        out = questions.corpus_summary(each)
        out.write.mode("overwrite").json(f"{self.output}/corpus")
        return out


@dataclass(frozen=True)
class ScoreAssertions:
    """Answers against assertions, each judged ``trials`` times."""

    questions: DataFrame
    answers: DataFrame
    output: str
    trials: int = 1
    top: int | None = None
    judge: Judge = field(default_factory=LexicalJudge)

    def run(self, spark: SparkSession) -> DataFrame:
        from assayer.functions.verdicts import prompt, verdict

        rows = assertions.to_judge(assertions.complete_answers(self.answers), assertions.assertion_rows(self.questions), self.trials, self.top)
        asked = rows.withColumn("prompt", prompt(F.concat_ws(" ", F.lit("trial"), "trial"), F.col("assertion"), F.col("answer"))).withColumn("prompt_id", F.sha2("prompt", 256))
        judged = asked.join(ask(asked, self.judge), "prompt_id").withColumn("v", verdict(F.col("raw"))).select("question_id", "assertion", "trial", "v.value", "v.reason")
        judged.write.mode("overwrite").parquet(f"{self.output}/scores")
        out = scores.assertion_summary(spark.read.parquet(f"{self.output}/scores"))
        out.write.mode("overwrite").json(f"{self.output}/summary")
        return out


def answer_inputs(spark: SparkSession, path: str) -> DataFrame:
    """(question_id, question_text, answer) of a JSON file with a list, or one under "results", "answers" or "samples"; reference answers are answers here."""
    text = lambda *names: F.coalesce(*(F.try_variant_get("item", f"$.{n}", "string") for n in names))
    given = tables.json_items(spark, path, ("results", "answers", "samples"))
    return given.select(text("question_id", "sample_id").alias("question_id"), text("question_text", "question").alias("question_text"), text("answer", "generated_answer", "reference_answer").alias("answer"))


def assertion_inputs(spark: SparkSession, questions_path: str, answers_path: str) -> tuple[DataFrame, DataFrame]:
    """Questions with assertions, and answers, of JSON files with a list each or under "questions" and "results" or "answers"."""
    a = "array<struct<statement: string, assertion: string, rank: int, score: double>>"
    text = lambda *names: F.coalesce(*(F.try_variant_get("item", f"$.{n}", "string") for n in names))
    asked = tables.json_items(spark, questions_path, ("questions", "assertions")).select(text("question_id", "id").alias("question_id"), text("question_text", "question", "text").alias("question_text"), F.try_variant_get("item", "$.assertions", a).alias("assertions"))
    return asked, answer_inputs(spark, answers_path)


@dataclass(frozen=True)
class PrepareRetrieval:
    """Saved results as retrieval rows whose contexts have the ids of the text units they quote."""

    results: str
    units: str
    output: str

    def run(self, spark: SparkSession) -> DataFrame:
        found = tables.search_results(spark, self.results).select(F.col("sample_id").alias("question_id"), F.col("question").alias("question_text"), F.col("retrieved_contexts").alias("contexts"))
        units = tables.frame(spark, self.units).select(F.col("id").cast("string").alias("unit_id"), "text", F.monotonically_increasing_id().alias("pos")).filter("text <> ''")
        retrieval.prepare(found, units).write.mode("overwrite").parquet(self.output)
        return spark.read.parquet(self.output)


@dataclass(frozen=True)
class RetrievalReference:
    """For every question and cluster the units that were assessed, rated 0 to 3: flat for ScoreRetrieval, and nested by question for readers.

    Questions and clusters are JSON files; ``units`` holds the text units that clusters name. Embeddings that are missing are made.
    """

    questions: str
    clusters: str
    output: str
    units: str | None = None
    semantic: int = 10
    central: int = 5
    most: int | None = None
    judge: Judge = field(default_factory=references.OverlapJudge)
    embedder: Embedder = field(default_factory=HashEmbedder)

    def run(self, spark: SparkSession) -> DataFrame:
        units = None
        if self.units:
            units = tables.frame(spark, self.units)
            units = units.select(F.col("id").cast("string").alias("unit_id"), "text", F.col("short_id" if "short_id" in units.columns else "id").cast("string").alias("short_id"))
        placed = tables.cluster_units(spark, self.clusters, units).filter("text <> ''").groupBy("unit_id").agg(F.min(F.struct("cluster_id", "text")).alias("u")).select("unit_id", "u.*")
        nothing = F.lit(None).cast("array<float>")
        fill_embeddings(placed.withColumn("text_embedding", nothing), self.embedder).write.mode("overwrite").parquet(f"{self.output}/units")
        corpus = spark.read.parquet(f"{self.output}/units").select(F.col("unit_id").alias("row_id"), "text", "cluster_id", F.col("text_embedding").alias("vector"))
        asked = tables.questions(spark, self.questions, self.most).select(F.col("question_id").alias("unit_id"), F.col("question_text").alias("text"), nothing.alias("text_embedding"))
        fill_embeddings(asked, self.embedder).write.mode("overwrite").parquet(f"{self.output}/questions")
        asked = spark.read.parquet(f"{self.output}/questions").select(F.col("unit_id").alias("query_id"), F.col("text").alias("question_text"), F.col("text_embedding").alias("vector"))
        found = references.assess(references.neighbours(asked, corpus, self.semantic, self.central), asked, corpus, references.judged(self.judge))
        found.write.mode("overwrite").parquet(f"{self.output}/reference")
        flat = spark.read.parquet(f"{self.output}/reference")
        nested = references.nest(asked, references.cluster_references(flat, corpus.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("cluster_size"))))
        nested.write.mode("overwrite").json(f"{self.output}/nested")
        return flat


#: What answers are held against their references for, unless criteria are given.
CRITERIA = {"correctness": "What the answer says agrees with the reference.", "completeness": "The answer says all that the reference says."}


@dataclass(frozen=True)
class ScoreReferences:
    """Answers against reference answers (question_id, answer), by criteria, from 1 to 10; each is asked ``trials`` times."""

    answers: DataFrame
    references: DataFrame
    output: str
    criteria: Mapping[str, str] = field(default_factory=lambda: dict(CRITERIA))
    trials: int = 1
    judge: Judge = field(default_factory=references.OverlapJudge)

    def run(self, spark: SparkSession) -> DataFrame:
        rows = assertions.criteria_scores(assertions.complete_answers(self.answers).select("question_id", "answer"), self.references, list(self.criteria), self.trials)
        meaning = F.element_at(F.create_map(*(F.lit(x) for kv in self.criteria.items() for x in kv)), F.col("criteria"))
        parts = [F.lit("Rate the answer by one criterion, from 1 to 10. Trial "), F.col("trial").cast("string"), F.lit(".\n\nCriterion:\n"), meaning, F.lit("\n\nQuestion:\n"), F.col("reference"), F.lit("\n\nPassage:\n"), F.col("answer")]
        prompt = F.concat(*parts, F.lit('\n\nAnswer with a JSON object with the keys "reasoning" (short) and "score" (1 to 10).'))
        asked = rows.withColumn("prompt", prompt).withColumn("prompt_id", F.sha2("prompt", 256))
        judged = asked.join(ask(asked, self.judge), "prompt_id").withColumn("r", rated(F.col("raw"), 1, 10)).select("question_id", "criteria", "trial", "r.score", "r.reasoning")
        judged.write.mode("overwrite").parquet(f"{self.output}/scores")
        kept = spark.read.parquet(f"{self.output}/scores")
        means = kept.groupBy("criteria").agg(F.avg("score").alias("mean_score"), F.stddev_samp("score").alias("std_score"), F.count_distinct("question_id").alias("questions"), F.count(F.lit(1)).alias("n"))
        means.write.mode("overwrite").json(f"{self.output}/summary")
        return spark.read.schema(means.schema).json(f"{self.output}/summary")


@dataclass(frozen=True)
class ScoreRetrieval:
    """Retrieval rows of one or more methods, name to path, against a reference; methods are compared by sign tests."""

    reference: str
    clusters: str
    results: dict[str, str]
    output: str
    units: str | None = None
    match_by: str = "id"
    threshold: int = 2
    fidelity: str = "js"
    alpha: float = 0.05
    correction: str = "holm"

    def run(self, spark: SparkSession) -> DataFrame:
        units = None
        if self.units:
            units = tables.frame(spark, self.units)
            units = units.select(F.col("id").cast("string").alias("unit_id"), "text", F.col("short_id" if "short_id" in units.columns else "id").cast("string").alias("short_id"))
        placed = tables.cluster_units(spark, self.clusters, units)
        reference = spark.read.parquet(self.reference)  # of RetrievalReference, or pairs without scores
        each = None
        for name, path in self.results.items():
            rows = spark.read.parquet(path).select(F.lit(name).alias("rag_method"), "question_id", F.explode("context").alias("c")).select("rag_method", "question_id", "c.chunk_id", "c.text")
            each = rows if each is None else each.unionByName(rows)
        if each is None:
            raise ValueError("no retrieval results are given")
        rated = retrieval.rate(retrieval.match_units(each, placed, self.match_by), reference)
        relevance = retrieval.relevant_units(reference, self.threshold)
        retrieval.question_scores(rated, relevance, self.threshold, self.fidelity, ("rag_method",)).write.mode("overwrite").parquet(f"{self.output}/questions")
        scored = spark.read.parquet(f"{self.output}/questions")
        out = retrieval.means(scored, ("rag_method",))
        out.write.mode("overwrite").json(f"{self.output}/summary")
        retrieval.compare(scored, "rag_method", self.alpha, self.correction).write.mode("overwrite").json(f"{self.output}/significance")
        sinks.write_text(spark, f"{self.output}/report.html", report.retrieval_report(out, reference if "kind" in reference.columns else reference.withColumn("kind", F.when(F.col("semantic").isNotNull(), "semantic").otherwise("centroid"))))
        return out


@dataclass(frozen=True)
class RetrievalSmoke:
    """From a graph and saved results to retrieval metrics: clusters, reference, preparation, scores and report.

    The relevance of a retrieved unit is by rule here: 3 for a unit of the question's reference, else 0.
    """

    root: str
    results: str
    output: str
    neighbours: int = 10
    centroids: int = 5
    fidelity: str = "js"
    embedder: Embedder = field(default_factory=HashEmbedder)

    def run(self, spark: SparkSession) -> DataFrame:
        found = tables.graph_tables(spark, self.root)
        if found["text_units"] is None:
            raise FileNotFoundError("missing graph tables: text_units")
        units = found["text_units"].select(F.col("id").cast("string").alias("unit_id"), F.col("text"), F.monotonically_increasing_id().alias("pos"), F.lit(None).cast("array<float>").alias("text_embedding"))
        units = units.filter("text is not null")
        fill_embeddings(units, self.embedder).write.mode("overwrite").parquet(f"{self.output}/units")
        units = spark.read.parquet(f"{self.output}/units").filter("text <> ''")
        bridge = graph.bridge(graph.clusters(found["communities"])).select("cluster_id", "unit_id")
        placed = units.join(bridge.groupBy("unit_id").agg(F.min("cluster_id").alias("cluster_id")), "unit_id")
        results = tables.search_results(spark, self.results)
        asked = results.select(F.col("sample_id").alias("unit_id"), F.col("question").alias("text"), F.lit(None).cast("array<float>").alias("text_embedding"))
        asked = fill_embeddings(asked, self.embedder).select(F.col("unit_id").alias("query_id"), F.col("text_embedding").alias("vector"))
        reference = retrieval.reference(asked, placed.select(F.col("unit_id").alias("row_id"), F.col("text_embedding").alias("vector"), "cluster_id"), self.neighbours, self.centroids)
        reference.write.mode("overwrite").parquet(f"{self.output}/reference")
        reference = spark.read.parquet(f"{self.output}/reference")
        prepared = retrieval.prepare(results.select(F.col("sample_id").alias("question_id"), F.col("question").alias("question_text"), F.col("retrieved_contexts").alias("contexts")), units)
        prepared.write.mode("overwrite").parquet(f"{self.output}/prepared")
        got = spark.read.parquet(f"{self.output}/prepared").select("question_id", F.explode("context").alias("c")).select("question_id", "c.chunk_id", "c.text")
        matched = retrieval.match_units(got, placed.select("unit_id", F.col("unit_id").alias("short_id"), "text", "cluster_id"))
        out = retrieval.score(retrieval.rate(matched, reference), retrieval.relevant_units(reference), fidelity=self.fidelity).select(F.lit("default").alias("question_set"), F.lit("replay").alias("rag_method"), "*")
        out.write.mode("overwrite").json(f"{self.output}/summary")
        sinks.write_text(spark, f"{self.output}/report.html", report.retrieval_report(out, reference))
        return out
