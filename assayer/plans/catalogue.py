"""The engine's queries over the test tables, by name. Tables stand in for inputs: documents for text units, labels for scores, and so on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assayer.functions import markdown, text, values
from assayer.functions.verdicts import verdict
from assayer.operators import assertions, graph, hierarchy, ingest, joins, paths, questions, reduce, reference, retrieval, runs, scores, significance

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, d: str) -> DataFrame:
    """Documents as the corpus of question makers."""
    t = table(spark, d, "documents")
    return t.select(F.format_string("doc-%09d", F.col("doc_id")).alias("id"), F.concat(F.lit("document "), F.col("doc_id").cast("string")).alias("title"), "text", "doc_id", "lang", "source")


def _tidy(spark: SparkSession, d: str) -> DataFrame:
    return scores.tidy(table(spark, d, "labels"), "doc_id", ["quality", "toxic"])


# ---------------------------------------------------------------- scores


@query
def score_by_metric(spark: SparkSession, d: str) -> DataFrame:
    return scores.by_metric(_tidy(spark, d))


@query
def score_by_lang_metric_gsets(spark: SparkSession, d: str) -> DataFrame:
    joined = table(spark, d, "documents").select("doc_id", "lang").join(_tidy(spark, d), "doc_id")
    return scores.grouping_sets(joined, [["lang", "metric_name"], ["metric_name"], []], [F.avg("value").alias("mean_value"), F.count("value").alias("n")])


@query
def binary_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return scores.accuracy(_tidy(spark, d), "quality")


@query
def top_metric(spark: SparkSession, d: str) -> DataFrame:
    return scores.top_metric(scores.by_metric(_tidy(spark, d)))


@query
def claim_coverage(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select((F.col("doc_id") % 5).alias("claim_count"), (F.col("n_chars") % 3).alias("assertion_count"))
    return scores.claim_coverage(t)


@query
def holm_adjust(spark: SparkSession, d: str) -> DataFrame:
    """Languages of each metric by how far their mean is from the whole's, as stand-ins for p-values."""
    joined = table(spark, d, "documents").select("doc_id", "lang").join(_tidy(spark, d), "doc_id")
    by = joined.groupBy("metric_name", "lang").agg(F.sum("value").alias("hits"), F.count(F.lit(1)).alias("n"))
    p = by.select("metric_name", F.col("lang").alias("test"), ((F.col("hits") + 1) / (F.col("n") * 10 + 1)).alias("p_value"))
    return scores.holm(p, "metric_name").select("metric_name", "test", F.round("p_value", 9).alias("p_value"), F.round("p_adjusted", 9).alias("p_adjusted"))


@query
def win_rate(spark: SparkSession, d: str) -> DataFrame:
    pairs = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id")
    return scores.win_rate(pairs, "lang", "quality", "toxic")


@query
def sign_test_counts(spark: SparkSession, d: str) -> DataFrame:
    pairs = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id")
    return scores.sign_test(pairs, "lang", "quality", "toxic").select("lang", "wins", "losses")


@query
def assertion_significance(spark: SparkSession, d: str) -> DataFrame:
    """Quality and toxicity as two systems' scores of each document, sources as questions, languages as families."""
    pairs = table(spark, d, "documents").select("doc_id", "lang", F.col("source").alias("question_id")).join(table(spark, d, "labels").select("doc_id", F.col("quality").alias("first"), F.col("toxic").alias("second")), "doc_id")
    out = significance.assertion_significance(pairs, "lang")
    return out.select("lang", "wins", "losses", "ties", "n_questions", *(F.round(c, 9).alias(c) for c in ("p_value", "p_adjusted", "mean_difference", "low", "high", "p_bootstrap")))


def _tree(spark: SparkSession, d: str, even: str, odd: str) -> DataFrame:
    """Sentences of labelled documents, each but the first supporting the one at a third of its place."""
    n = F.size(F.split("text", r"[.!?]\s+"))
    docs = table(spark, d, "documents").select("doc_id", n.alias("n")).join(table(spark, d, "labels"), "doc_id")
    each = docs.select(F.col("doc_id").alias("question_id"), "quality", "toxic", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("assertion_id"))
    parent = F.when(F.col("assertion_id") > 0, F.floor((F.col("assertion_id") - 1) / 3).cast("int"))
    return each.select("question_id", "assertion_id", parent.alias("parent_id"), F.when(F.col("assertion_id") % 2 == 0, F.col(even)).otherwise(F.col(odd)).alias("value"))


@query
def hierarchical_assertions(spark: SparkSession, d: str) -> DataFrame:
    out = hierarchy.question_scores(hierarchy.roll_up(_tree(spark, d, "quality", "toxic")))
    return out.select("question_id", *(F.round(c, 9).alias(c) for c in ("score", "own")), "assertions", "roots")


@query
def hierarchical_significance(spark: SparkSession, d: str) -> DataFrame:
    """The same trees judged by two systems, which differ in what they ask of every other sentence."""
    both = hierarchy.paired(hierarchy.roll_up(_tree(spark, d, "quality", "toxic")), hierarchy.roll_up(_tree(spark, d, "toxic", "quality")))
    pairs = both.join(table(spark, d, "documents").select(F.col("doc_id").alias("question_id"), "lang"), "question_id")
    rounded = pairs.select("lang", "question_id", *(F.round(c, 9).alias(c) for c in ("first", "second")))
    return significance.exact_sign_test(rounded, ["lang"], "first", "second").withColumn("p_value", F.round("p_value", 9))


@query
def report_alerts(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "labels").agg(F.count(F.lit(1)).alias("scores"), F.count_if(F.col("quality") > 5).alias("total_assertions"), F.count_if(F.col("toxic") > 5).alias("valid_assertions"), F.count(F.lit(1)).alias("retrieval_rows"))
    return scores.alerts(counts)


# ---------------------------------------------------------------- joins


def _samples(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").select(F.col("doc_id").alias("sample_id"), "quality")


def _results(spark: SparkSession, d: str) -> DataFrame:
    """Several results for some samples: the answer of a document and, at a later place, of the one with twice its id."""
    t = table(spark, d, "documents")
    first = t.select(F.col("doc_id").alias("sample_id"), F.col("doc_id").alias("pos"), F.col("text").alias("answer"))
    again = t.filter("doc_id % 2 = 0").select((F.col("doc_id") / 2).cast("long").alias("sample_id"), (F.col("doc_id") + 1_000_000_000).alias("pos"), F.col("text").alias("answer"))
    return first.unionByName(again)


@query
def strict_lookup_join(spark: SparkSession, d: str) -> DataFrame:
    return joins.strict_lookup(_samples(spark, d), _results(spark, d), "sample_id", F.col("pos"))


@query
def missing_results_anti(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("sample_id"), "lang")
    return joins.missing(docs, _samples(spark, d), "sample_id")


@query
def answer_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Each user turn with the turn after it, where both say something."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = table(spark, d, "conversations").select("conv_id", "turn", "role", "text", F.lead("text").over(w).alias("next_text"), F.lead("role").over(w).alias("next_role"))
    answers = t.filter("role = 'user' and next_role = 'assistant'").select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("question_id"), F.col("text").alias("question"), F.col("next_text").alias("answer"))
    return assertions.complete_answers(answers)


@query
def question_text_backfill(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "conversations").filter("role = 'user'")
    asked = t.select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("question_id"), F.col("text").alias("question"), (F.col("conv_id") * 1000 + F.col("turn")).alias("pos"))
    rows = t.select("conv_id", "turn", F.col("text").alias("question"), F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("own-"), F.col("conv_id").cast("string"))).alias("question_id"))
    return joins.backfill_question_id(rows, asked).select("conv_id", "turn", "question_id")


@query
def metric_by_sample(spark: SparkSession, d: str) -> DataFrame:
    metrics = spark.createDataFrame([("context_precision",), ("context_recall",), ("faithfulness",), ("answer_relevancy",)], "metric_name string")
    return joins.every_pair(_samples(spark, d).select("sample_id"), metrics)


@query
def positional_zip(spark: SparkSession, d: str) -> DataFrame:
    """Parts with the order of the same number as their report."""
    collected = table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("pos"), F.col("p_partkey").alias("node"))
    reported = table(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("pos"), F.lit("passed").alias("status"))
    return runs.test_progress(collected, reported)


@query
def state_carry_over(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("at"), F.count_if(F.col("event_type") == "error").alias("errors"))
    current = t.filter("user_id % 3 <> 0").select("user_id", F.when(F.col("errors") == 0, F.col("at")).alias("last_success_at"), F.lit("now").alias("seen"))
    previous = t.filter("user_id % 3 <> 1").select("user_id", F.col("at").alias("last_success_at"), F.lit("before").alias("seen"))
    return joins.carry_over(current, previous, "user_id", "last_success_at").select("user_id", F.date_format("last_success_at", "yyyy-MM-dd HH:mm:ss").alias("last_success_at"), "seen")


def _steps(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    by = table(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("errors"))
    steps = by.select(F.col("user_id").alias("step"), F.when(F.col("errors") % 2 == 1, "failed").otherwise("passed").alias("status"))
    needs = by.select(F.col("user_id").alias("step"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("ord")).select("step", (F.col("step") - F.col("ord")).alias("dependency"), "ord")
    return steps, needs


@query
def dependency_blocked(spark: SparkSession, d: str) -> DataFrame:
    return joins.blocked(*_steps(spark, d))


@query
def dependency_runnable(spark: SparkSession, d: str) -> DataFrame:
    return joins.runnable(*_steps(spark, d))


@query
def expected_steps(spark: SparkSession, d: str) -> DataFrame:
    expected = table(spark, d, "nation").select(F.col("n_regionkey").alias("group"), F.col("n_nationkey").alias("ord"), F.col("n_nationkey").cast("long").alias("step"))
    records = table(spark, d, "supplier").filter("s_suppkey % 2 = 0").select(F.col("s_nationkey").cast("long").alias("step"), F.col("s_suppkey").alias("pos"), F.when(F.col("s_acctbal") > 0, "passed").otherwise("failed").alias("status"))
    return joins.expected_steps(expected, records)


# ---------------------------------------------------------------- text


@query
def text_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(text.text_key(F.col("text"))).alias("key_md5"))


@query
def first_sentence(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.first_sentence(F.col("text")).alias("sentence"))


@query
def doc_summary_2(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.summary(F.col("text"), 2).alias("summary"))


@query
def truncated(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.truncate(F.col("text"), 80).alias("short"))


@query
def corpus_summary(spark: SparkSession, d: str) -> DataFrame:
    """Of all documents, whose summaries are held in one text."""
    return questions.corpus_summary(questions.document_summaries(_docs(spark, d))).select("corpus_summary")


@query
def summary_groups(spark: SparkSession, d: str) -> DataFrame:
    """How the first level of a map-reduce summary deals out all documents under a budget of 2000 tokens."""
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("pos"), "text")
    return reduce.budget_groups(texts, 2000).select(F.col("pos").alias("doc_id"), "piece", "tokens", "group")


@query
def map_reduce_summary(spark: SparkSession, d: str) -> DataFrame:
    """One text from all documents, three sentences of each group of texts standing in for a model's summary."""
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("pos"), "text")
    return reduce.map_reduce(texts, reduce.first_sentences(3), 2000)


@query
def themes(spark: SparkSession, d: str) -> DataFrame:
    return questions.corpus_summary(questions.document_summaries(_docs(spark, d))).select(F.explode("themes").alias("theme"))


@query
def flat_paths(spark: SparkSession, d: str) -> DataFrame:
    path = F.regexp_replace("url", r"^[a-z]+://|[?#].*$", "")
    return table(spark, d, "pages").select("page_id", text.flat_path(path).alias("flat"), text.canonical_path(path).alias("canonical"), text.safe_token(F.col("url")).alias("token"))


@query
def numbers_formatted(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", text.format_number(F.col("o_totalprice").cast("double")).alias("price"))


@query
def html_escaped(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.md5(text.escape_html(F.col("html"))).alias("escaped_md5"))


def _made_markdown() -> Column:
    """Documents' lines as headings, table rows and code in turn."""
    return F.array_join(F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 7 == 0, F.concat(F.lit("## "), x)).when(i % 7 == 3, F.concat(F.lit("| a | "), x, F.lit(" |"))).when(i % 11 == 5, F.lit("```")).otherwise(x)), "\n")


@query
def markdown_counters(spark: SparkSession, d: str) -> DataFrame:
    """Of documents whose lines become headings, table rows and code in turn."""
    c = markdown.counters(_made_markdown())
    return table(spark, d, "documents").select("doc_id", c.alias("c")).select("doc_id", "c.headings", "c.table_rows")


@query
def page_concat(spark: SparkSession, d: str) -> DataFrame:
    """Turns as pages of their conversation."""
    pages = table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("source_path"), F.lit("").alias("relative"), F.col("turn").cast("int").alias("page"), F.trim("text").alias("text"), F.when(F.col("role") == "user", "text").otherwise("ocr").alias("source"), F.lit(None).cast("string").alias("warning"))
    return ingest.join_pages(pages).select(F.col("source_path").alias("conv_id"), F.md5("text").alias("text_md5"), "page_count", "text_pages", "ocr_pages")


@query
def duplicate_ids(spark: SparkSession, d: str) -> DataFrame:
    return ingest.collisions(table(spark, d, "documents").select(F.md5("text").alias("canonical_path")))


@query
def markdown_chunks(spark: SparkSession, d: str) -> DataFrame:
    return markdown.chunk_rows(table(spark, d, "documents").select("doc_id", "text"))


@query
def token_chunks(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select("doc_id", markdown.token_chunks("text").alias("chunks"))
    return t.select("doc_id", F.posexplode("chunks").alias("at", "chunk"))


@query
def markdown_rewritten(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", markdown.rewritten("text").alias("m")).select("doc_id", "m.text", "m.title", "m.headings", "m.table_rows")


@query
def markdown_rewritten_made(spark: SparkSession, d: str) -> DataFrame:
    """Of documents whose lines become headings, table rows and code in turn."""
    return table(spark, d, "documents").select("doc_id", markdown.rewritten(_made_markdown()).alias("m")).select("doc_id", "m.text", "m.title", "m.headings", "m.table_rows")


# ---------------------------------------------------------------- graph


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.concat(F.lit("n"), F.col("doc_id").cast("string")).alias("id"), F.col("text").alias("description"), "lang")


@query
def split_long_nodes(spark: SparkSession, d: str) -> DataFrame:
    nodes = _nodes(spark, d)
    return graph.with_children(nodes, graph.split_nodes(nodes)).select("id", "description", "lang", "parent_id", "split_index", F.coalesce("is_split_child", F.lit(False)).alias("is_child"))


@query
def part_of_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.part_of_edges(graph.split_nodes(_nodes(spark, d))).select("source_id", "target_id", "relationship")


@query
def split_stats(spark: SparkSession, d: str) -> DataFrame:
    return graph.split_statistics(graph.split_nodes(_nodes(spark, d)))


def _communities(spark: SparkSession, d: str) -> DataFrame:
    """Nations with their customers as text units."""
    units = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.sort_array(F.collect_list(F.format_string("c%07d", F.col("c_custkey")))).alias("text_unit_ids"))
    return table(spark, d, "nation").join(units, "n_nationkey").select(F.col("n_nationkey").alias("community"), F.lit(1).alias("level"), F.col("n_regionkey").alias("parent"), F.col("n_name").alias("title"), "text_unit_ids")


@query
def clusters_from_communities(spark: SparkSession, d: str) -> DataFrame:
    return graph.clusters(_communities(spark, d)).select("cluster_id", F.array_join("text_unit_ids", ",").alias("text_unit_ids"), "title", "level", "parent", "size")


@query
def cluster_text_units_left(spark: SparkSession, d: str) -> DataFrame:
    units = table(spark, d, "customer").filter("c_custkey % 3 <> 0").select(F.format_string("c%07d", F.col("c_custkey")).alias("unit_id"), F.concat(F.lit("segment "), F.col("c_mktsegment")).alias("text"), F.col("c_custkey").cast("string").alias("short_id"))
    return joins.fill_units(graph.bridge(graph.clusters(_communities(spark, d))), units)


@query
def table_cardinalities(spark: SparkSession, d: str) -> DataFrame:
    return graph.cardinalities(entities=table(spark, d, "customer"), relationships=table(spark, d, "orders"), communities=table(spark, d, "nation"))


@query
def unknown_relations(spark: SparkSession, d: str) -> DataFrame:
    edges = table(spark, d, "events").select(F.col("event_type").alias("relation"))
    return graph.unknown_relations(edges, ["click", "view"])


def _coverage(spark: SparkSession, d: str) -> DataFrame:
    """Orders with the parts of all their lines as expected, and those of early lines as found."""
    t = table(spark, d, "lineitem")
    part = F.col("l_partkey").cast("string")
    return t.groupBy(F.col("l_orderkey").alias("sample_id")).agg(F.collect_list(part).alias("expected"), F.collect_list(F.when(F.col("l_linenumber") <= 2, part)).alias("found"))


@query
def entity_coverage(spark: SparkSession, d: str) -> DataFrame:
    return graph.entity_coverage(_coverage(spark, d))


@query
def community_coverage(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem")
    nation = (F.col("l_suppkey") % 25).cast("string")
    rows = t.groupBy(F.col("l_orderkey").alias("sample_id")).agg(F.collect_list(nation).alias("expected"), F.collect_list(F.when(F.col("l_linenumber") % 2 == 1, nation)).alias("found"))
    return graph.community_coverage(rows)


@query
def citation_consistency(spark: SparkSession, d: str) -> DataFrame:
    return graph.citation_consistency(_coverage(spark, d).select("sample_id", F.col("found").alias("citations"), F.slice(F.array_sort("expected"), 1, 2).alias("sources")))


@query
def mode_match(spark: SparkSession, d: str) -> DataFrame:
    kinds = F.element_at(F.array(*map(F.lit, ("local", "global", "multi-hop", "comparison", "unanswerable"))), (F.col("doc_id") % 5 + 1).cast("int"))
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("sample_id"), kinds.alias("query_type"), F.when(F.col("n_chars") % 2 == 0, "local").otherwise("global").alias("search_mode"))
    return graph.mode_match(rows)


@query
def graph_path_accuracy(spark: SparkSession, d: str) -> DataFrame:
    paths = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("sample_id"), F.col("l_partkey").cast("long").alias("source"), F.col("l_suppkey").cast("long").alias("target"))
    edges = table(spark, d, "lineitem").filter("l_linenumber = 1").select(F.col("l_partkey").cast("long").alias("source"), F.col("l_suppkey").cast("long").alias("target"))
    return graph.path_accuracy(paths, edges)


@query
def graph_path_exists(spark: SparkSession, d: str) -> DataFrame:
    """Whether four edges lead from the customer of each line's order to its supplier: nations and regions lead to each other, and regions to themselves."""
    name = lambda letter, key: F.concat(F.lit(letter), F.col(key).cast("string"))
    customer, nation, supplier, region = (table(spark, d, t) for t in ("customer", "nation", "supplier", "region"))
    edges = customer.select(name("c", "c_custkey").alias("source"), name("n", "c_nationkey").alias("target"))
    edges = edges.unionByName(nation.select(name("n", "n_nationkey").alias("source"), name("r", "n_regionkey").alias("target")))
    edges = edges.unionByName(nation.select(name("r", "n_regionkey").alias("source"), name("n", "n_nationkey").alias("target")))
    edges = edges.unionByName(region.select(name("r", "r_regionkey").alias("source"), name("r", "r_regionkey").alias("target")))
    edges = edges.unionByName(supplier.select(name("n", "s_nationkey").alias("source"), name("s", "s_suppkey").alias("target")))
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey").join(table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    sample = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    return paths.path_exists(lines.select(sample.alias("sample_id"), name("c", "o_custkey").alias("source"), name("s", "l_suppkey").alias("target")), edges, 4)


# ---------------------------------------------------------------- retrieval


def _derived(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Units are documents; contexts quote the start of every one, some to the end of it."""
    t = table(spark, d, "documents")
    units = t.select(F.col("doc_id").alias("unit_id"), F.col("doc_id").alias("pos"), "text")
    contexts = t.select(F.col("doc_id").alias("context_id"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" "), F.replace("text", F.lit(" "), F.lit("  ")))).otherwise(F.left("text", (F.col("doc_id") % 160 + 40).cast("int"))).alias("text"))
    return contexts, units


@query
def resolve_text_units(spark: SparkSession, d: str) -> DataFrame:
    return joins.resolve_units(*_derived(spark, d))


@query
def context_projection(spark: SparkSession, d: str) -> DataFrame:
    """Assistant turns as contexts with some ids missing."""
    t = table(spark, d, "conversations")
    rows = t.filter("role <> 'user'").select(F.col("conv_id").alias("question_id"), F.col("turn").alias("pos"), F.when(F.col("turn") % 3 == 0, F.concat(F.lit("u"), F.col("turn").cast("string"))).alias("unit_id"), F.when(F.col("turn") % 3 == 1, "").otherwise(F.lit(None).cast("string")).alias("id"), F.when(F.col("conv_id") % 2 == 0, F.col("role")).alias("source"), F.md5("text").alias("text_md5"))
    return retrieval.context_ids(rows).select("question_id", "pos", "chunk_id", "text_md5")


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Questions are the vectors whose id is a multiple of 50, the stated query set; all vectors are units."""
    t = table(spark, d, "embeddings")
    units = t.select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("vector"), F.col("label").alias("cluster_id"))
    return t.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), units


@query
def knn_semantic(spark: SparkSession, d: str) -> DataFrame:
    asked, units = _vectors(spark, d)
    return joins.nearest(asked, units, 10).select("query_id", "row_id", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("long").alias("rank"))


@query
def knn_centroid(spark: SparkSession, d: str) -> DataFrame:
    asked, units = _vectors(spark, d)
    near = joins.nearest(asked, retrieval.centroids(units).withColumnRenamed("cluster_id", "row_id"), 5, normalised=False)
    return near.select("query_id", "row_id", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("long").alias("rank"))


def _retrieved(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Nearest vectors count as retrieved; they are relevant if they have the question's label."""
    asked, units = _vectors(spark, d)
    t = table(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("label").alias("wanted"))
    near = joins.nearest(asked, units.select("row_id", "vector"), 10).join(units.select("row_id", "cluster_id"), "row_id").join(t, "query_id")
    got = near.select(F.col("query_id").alias("question_id"), F.col("row_id").alias("unit_id"), "cluster_id", F.when(F.col("cluster_id") == F.col("wanted"), 3).when(F.abs(F.col("cluster_id") - F.col("wanted")) == 1, 2).otherwise(F.col("row_id") % 2).alias("score"))
    labels = table(spark, d, "embeddings").groupBy(F.col("label").alias("cluster_id")).agg(F.count(F.lit(1)).alias("n"))
    relevance = asked.select("query_id").join(t, "query_id").join(labels, F.abs(F.col("cluster_id") - F.col("wanted")) <= 1).select(F.col("query_id").alias("question_id"), "cluster_id", "n")
    return got, relevance


def _scored(spark: SparkSession, d: str, fidelity: str) -> DataFrame:
    out = retrieval.score(*_retrieved(spark, d), fidelity=fidelity)
    return out.select(*(F.round(c, 6).alias(c) for c in ("binary_precision", "graded_precision", "recall", "fidelity")), "total_queries")


@query
def retrieval_metrics(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d, "js")


@query
def retrieval_metrics_tvd(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d, "tvd")


def _label_shares(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "embeddings")
    by = t.groupBy("label").agg(F.count(F.lit(1)).alias("a"), F.count_if(F.col("vec_id") % 3 == 0).alias("b"))
    both = by.agg(F.array_sort(F.collect_list(F.struct("label", "a", "b"))).alias("x"), F.sum("a").alias("all_a"), F.sum("b").alias("all_b"))
    return both.select(F.transform("x", lambda s: s["a"] / F.col("all_a")).alias("p"), F.transform("x", lambda s: s["b"] / F.col("all_b")).alias("q"))


@query
def fidelity_js(spark: SparkSession, d: str) -> DataFrame:
    return _label_shares(spark, d).select(F.round(values.divergence("js", F.col("p"), F.col("q")), 9).alias("divergence"))


@query
def fidelity_tvd(spark: SparkSession, d: str) -> DataFrame:
    return _label_shares(spark, d).select(F.round(values.divergence("tvd", F.col("p"), F.col("q")), 9).alias("divergence"))


@query
def reference_assessments(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.reference(*_vectors(spark, d))


@query
def context_precision_ranked(spark: SparkSession, d: str) -> DataFrame:
    """Precision by rank of the nearest vectors, useful if they have the question's label."""
    asked, units = _vectors(spark, d)
    wanted = table(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("label").alias("wanted"))
    near = joins.nearest(asked, units.select("row_id", "vector"), 10).join(units.select("row_id", "cluster_id"), "row_id").join(wanted, "query_id")
    useful = near.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", (F.col("cluster_id") == F.col("wanted")).cast("int").alias("useful")))).alias("r"))
    return useful.select("query_id", F.round(values.average_precision(F.transform("r", lambda x: x["useful"])), 9).alias("context_precision"))


def _rate_by_label(labels: DataFrame):
    """3 for units with the question's label, else what their id leaves by 3."""
    wanted, held = labels.select(F.col("vec_id").alias("question_id"), F.col("label").alias("wanted")), labels.select(F.col("vec_id").alias("unit_id"), F.col("label").alias("held"))
    score = F.when(F.col("wanted") == F.col("held"), 3).otherwise(F.col("unit_id") % 3).cast("int")
    return lambda rows: rows.join(wanted, "question_id").join(held, "unit_id").select("question_id", "unit_id", score.alias("score"), F.lit("by label").alias("reasoning"))


@query
def retrieval_reference(spark: SparkSession, d: str) -> DataFrame:
    """Nested references: for every question and cluster the nearest units, those at the centre, and how they were rated."""
    asked, units = _vectors(spark, d)
    texts = units.withColumn("text", F.concat(F.lit("unit "), F.col("row_id").cast("string")))
    out = reference.references(asked.withColumn("question_text", F.lit("")), texts, _rate_by_label(table(spark, d, "embeddings")))
    each = out.select("question_id", F.explode("cluster_results").alias("c")).select("question_id", "c.*")
    listed = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["unit_id"].cast("string"), x["score"].cast("string"))), ",")
    return each.select("question_id", "cluster_id", "cluster_size", "num_assessments", "num_overlapping_chunks", listed("semantic_neighbor_assessments").alias("semantic"), listed("centroid_neighbor_assessments").alias("central"), listed("all_assessments").alias("every"))


@query
def kmeans_sample(spark: SparkSession, d: str) -> DataFrame:
    _, units = _vectors(spark, d)
    return questions.cluster_samples(units.select("row_id", "vector"), 10)


# ---------------------------------------------------------------- assertions, questions, verdicts


def _sentences(spark: SparkSession, d: str) -> DataFrame:
    """Documents as questions with all their sentences as assertions; of three ranks one is given, from 7 to 1 and again, one is 0, one missing."""
    parts = F.split("text", r"[.!?]\s+")
    rows = F.transform(parts, lambda x, i: F.struct(F.when(i % 4 != 3, x).otherwise("").alias("statement"), F.when(i % 3 == 1, 0).when(i % 3 == 2, F.lit(None)).otherwise(7 - i % 7).cast("int").alias("rank")))
    return table(spark, d, "documents").select(F.col("doc_id").alias("question_id"), F.lit("").alias("question_text"), rows.alias("assertions"))


@query
def assertion_rows(spark: SparkSession, d: str) -> DataFrame:
    return assertions.assertion_rows(_sentences(spark, d)).select("question_id", "assertion", "rank")


@query
def assertion_topk(spark: SparkSession, d: str) -> DataFrame:
    return assertions.top_assertions(assertions.assertion_rows(_sentences(spark, d)), 2).select("question_id", "assertion", "rank")


@query
def assertion_trials(spark: SparkSession, d: str) -> DataFrame:
    answers = table(spark, d, "labels").select(F.col("doc_id").alias("question_id"), F.col("quality").cast("string").alias("answer"))
    return assertions.to_judge(answers, assertions.assertion_rows(_sentences(spark, d)), trials=2, k=2).select("question_id", "answer", "assertion", "trial")


@query
def assertion_summary(spark: SparkSession, d: str) -> DataFrame:
    """Documents meet their labels with digests of their assertions, and are taken apart after that; the join deals rows out by question, as the aggregation wants them."""
    digest = lambda a: F.struct(F.when(a["statement"] != "", F.md5(a["statement"])).otherwise("").alias("statement"), a["rank"].alias("rank"))
    asked = _sentences(spark, d).withColumn("assertions", F.transform("assertions", digest)).join(table(spark, d, "labels").withColumnRenamed("doc_id", "question_id").hint("merge"), "question_id")
    rows = assertions.assertion_rows(asked, ("quality", "toxic"))
    return scores.assertion_summary(rows.select("question_id", "assertion", F.when(F.col("rank") <= 3, F.col("quality")).otherwise(F.col("toxic")).alias("value")))


@query
def criteria_by_answer(spark: SparkSession, d: str) -> DataFrame:
    answers = table(spark, d, "labels").select(F.col("doc_id").alias("question_id"), F.col("toxic").cast("string").alias("answer"))
    references = table(spark, d, "documents").select(F.col("doc_id").alias("question_id"), F.col("lang").alias("answer"))
    return assertions.criteria_scores(answers, references, ["correctness", "completeness"], 2)


def _asked(df: DataFrame) -> DataFrame:
    return df.select("sample_id", "question", "query_type", "search_mode", "reference_answer", F.md5(F.array_join("reference_contexts", "|")).alias("contexts_md5"), F.array_join("source_doc_ids", ",").alias("sources"), "difficulty")


@query
def questions_local(spark: SparkSession, d: str) -> DataFrame:
    return _asked(questions.questions(_docs(spark, d), 10, ("local",)))


@query
def questions_global(spark: SparkSession, d: str) -> DataFrame:
    return _asked(questions.questions(_docs(spark, d), 10, ("global",)))


@query
def questions_multi_hop(spark: SparkSession, d: str) -> DataFrame:
    return _asked(questions.questions(_docs(spark, d), 10, ("multi-hop",)))


@query
def questions_unanswerable(spark: SparkSession, d: str) -> DataFrame:
    return _asked(questions.questions(_docs(spark, d), 10, ("unanswerable",)))


@query
def questions_all(spark: SparkSession, d: str) -> DataFrame:
    """Over all documents, with room for a local question of each and one of each other mode."""
    docs = _docs(spark, d)
    return _asked(questions.questions(docs, docs.count() + len(questions.MODES) - 1, questions.MODES))


def _raw(doc_id: Column) -> Column:
    """Answers of a judge in all the shapes they come in."""
    n = (doc_id % 12).cast("int")
    shapes = ['{"correctness": 1, "reason": "held"}', '```json\n{"score": 0.7}\n```', 'Well: {"evaluation": "no", "explanation": "not there"} so.', "I say 1.", "it is 0, not 1", "Yes, clearly", "No.", "yes and no", '{"value": "PASS"}', '{"reason": "nothing"}', "", '{"correctness": null, "score": 1}']
    return F.element_at(F.array(*map(F.lit, shapes)), n + 1)


@query
def judge_parse(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", verdict(_raw(F.col("doc_id"))).alias("v")).select("doc_id", "v.value", "v.reason")


@query
def assertion_score_scale(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", values.assertion_score((F.col("doc_id") % 101).cast("double")).alias("score"))


def _labelled_with_next(docs: DataFrame, labels: DataFrame, block: int = 4096) -> DataFrame:
    """(doc_id, text, other): labelled documents with the text of the next id, where both are there. ids are unique in both tables.

    Texts are moved once: ids are dealt into blocks, each with the first document of the next, and label rows stand before their documents in a block's order.
    """
    number = F.floor(F.col("doc_id") / block)
    places = F.when(F.col("doc_id") % block == 0, F.array(number, number - 1)).otherwise(F.array(number))
    rows = docs.select("doc_id", "text", F.lit(1).alias("kind"), F.explode(places).alias("block"))
    rows = rows.unionByName(labels.select("doc_id", F.lit(None).cast("string").alias("text"), F.lit(0).alias("kind"), number.alias("block")))
    w = Window.partitionBy("block").orderBy("doc_id", "kind")
    ahead = lambda c, n: F.lead(c, n).over(w)
    seen = rows.select("doc_id", "kind", *(ahead(c, n).alias(f"{c}{n}") for c in ("doc_id", "kind", "text") for n in (1, 2, 3)))
    follows = lambda n: (F.col(f"doc_id{n}") == F.col("doc_id") + 1) & (F.col(f"kind{n}") == 1)
    own = (F.col("doc_id1") == F.col("doc_id")) & (F.col("kind1") == 1)
    return seen.filter((F.col("kind") == 0) & own & (follows(2) | follows(3))).select("doc_id", F.col("text1").alias("text"), F.when(follows(2), F.col("text2")).otherwise(F.col("text3")).alias("other"))


@query
def lexical_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Word-overlap scores of answers: two neighbouring documents, whole, as answer and contexts of each label; the first sentence asks."""
    from assayer.model.plane import lexical_scores

    rows = _labelled_with_next(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "labels").select("doc_id"))
    return lexical_scores(rows.select(F.col("doc_id").alias("sample_id"), text.first_sentence(F.col("text")).alias("question"), F.col("text").alias("answer"), F.col("other").alias("reference_answer"), F.array("text", "other").alias("retrieved_contexts"))).withColumn("value", F.round("value", 9))


# ---------------------------------------------------------------- runs


@query
def run_tally(spark: SparkSession, d: str) -> DataFrame:
    return scores.tally(table(spark, d, "events").select(F.when(F.col("event_type") == "error", "1").when(F.col("event_id") % 17 == 0, "broken").otherwise("0").alias("exit_code")))


@query
def last_success(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "events").withColumn("passed", F.col("event_type") != "error")
    out = runs.last_success(t, "user_id", "ts")
    return out.select("user_id", *(F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("last_success_at", "last_run_at")))


@query
def success_so_far(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "events").withColumn("passed", F.col("event_type") != "error")
    out = runs.success_so_far(t, "user_id", "ts", "event_id")
    return out.select("event_id", F.date_format("last_success_at", "yyyy-MM-dd HH:mm:ss").alias("last_success_at"))


@query
def run_sections(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "events").select(F.col("event_type").alias("step"), F.when(F.col("event_type") == "error", 1).otherwise(0).alias("exit_code"), F.lit("").alias("log"), "user_id")
    both = runs.sections({"even": t.filter("user_id % 2 = 0"), "odd": t.filter("user_id % 2 = 1")})
    return both.groupBy("section", "step").agg(F.count_if(F.col("exit_code") == 0).alias("passed"), F.count_if(F.col("exit_code") != 0).alias("failed"))
