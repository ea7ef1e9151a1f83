"""Benchmark questions and summaries made by rule from documents (id, title, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.functions.text import first_sentence, strip, summary, themes
from assayer.functions.values import truthy
from assayer.session import checkpointed

MODES = ("local", "global", "multi-hop", "unanswerable")
#: Wordings of questions and answers; {} is a title. Fixed values.
LOCAL_QUESTION = "What does the document say about {}?"
NO_SENTENCE = "This document does not have a clear first sentence."
GLOBAL_QUESTION = "What are the main themes across the documents?"
GLOBAL_ANSWER = "The documents describe the main themes covered across the corpus."
HOP_QUESTION = "How are {} and {} connected?"
HOP_ANSWER = "They are connected through information that appears in multiple documents."
METADATA_QUESTION = "What is the exact unpublished metadata of {}?"
NO_ANSWER = "The documents do not provide enough information to answer this exactly."
#: Documents that a question over the whole corpus cites.
GLOBAL_DOCS = 3
#: Documents that each other mode's question needs.
NEEDED = {"global": 1, "multi-hop": 2, "unanswerable": 1}
#: Questions that are chosen by a top-k, which one task ends.
AT_ONCE = 10_000


def _filled(wording: str, *titles: Column) -> Column:
    """The wording with titles in the places of its braces."""
    first, *rest = wording.split("{}")
    return F.concat(F.lit(first), *(x for t, after in zip(titles, rest) for x in (t, F.lit(after))))


def first_documents(docs: DataFrame, n: int, order: str = "id") -> DataFrame:
    """The first n documents with their position from 1. A top-k: partitions send n rows each, and only those are numbered."""
    return docs.orderBy(order).limit(n).withColumn("pos", F.row_number().over(Window.orderBy(order)))


def numbered(docs: DataFrame, order: str = "id") -> tuple[DataFrame, int]:
    """All documents, sorted, with their position from 1, and how many there are. They are dealt out by ranges and sorted in these; of each part
    only the number of its rows comes to the driver."""
    kept = checkpointed(docs.repartitionByRange(order).sortWithinPartitions(order)).withColumn("__row", F.monotonically_increasing_id())
    part, row = F.shiftright("__row", 33).cast("int"), F.col("__row").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = {r["part"]: r["n"] for r in kept.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}
    before = [0]
    for k in range(max(sizes, default=-1) + 1):
        before.append(before[-1] + sizes.get(k, 0))
    return kept.withColumn("pos", F.get(F.lit(before).cast("array<long>"), part) + row + 1).drop("__row"), before[-1]


def _question(sample_id: Column, question: Column, kind: str, mode: str, answer: Column, contexts: Column, sources: Column, difficulty: str) -> list[Column]:
    return [sample_id.alias("sample_id"), question.alias("question"), F.lit(kind).alias("query_type"), F.lit(mode).alias("search_mode"), answer.alias("reference_answer"), contexts.alias("reference_contexts"), sources.alias("source_doc_ids"), F.lit(difficulty).alias("difficulty")]


def local_questions(docs: DataFrame) -> DataFrame:
    """One for each numbered document."""
    text = strip(F.col("text"))
    answer = truthy(first_sentence(F.col("text")), default=NO_SENTENCE)
    return docs.select(
        *_question(
            F.concat(F.lit("local-"), F.col("pos").cast("string")),
            _filled(LOCAL_QUESTION, F.col("title")),
            "local", "local", answer, F.when(text != "", F.array(text)).otherwise(F.array().cast("array<string>")), F.array("id"), "easy",
        ),
        F.col("pos").cast("long").alias("index"),
    )


def _few(docs: DataFrame, n: int) -> DataFrame:
    """One row with the first n numbered documents in order; no row without documents."""
    rows = docs.filter(F.col("pos") <= n).agg(F.array_sort(F.collect_list(F.struct("pos", "id", "title", "text"))).alias("d"))
    return rows.filter(F.size("d") > 0)


def global_question(docs: DataFrame) -> DataFrame:
    keep = lambda f: F.filter(F.transform("d", lambda x: x[f]), lambda x: x.isNotNull() & (x != ""))
    return _few(docs, GLOBAL_DOCS).select(
        *_question(F.lit("global-1"), F.lit(GLOBAL_QUESTION), "global", "global", F.lit(GLOBAL_ANSWER), keep("text"), keep("id"), "medium"), F.lit(1).cast("long").alias("index")
    )


def multi_hop_question(docs: DataFrame) -> DataFrame:
    """Needs two documents."""
    both = lambda f: F.transform("d", lambda x: F.coalesce(x[f], F.lit("")))
    title = lambda i: F.col("d")[i]["title"]
    return _few(docs, 2).filter(F.size("d") == 2).select(
        *_question(F.lit("multi-hop-1"), _filled(HOP_QUESTION, title(0), title(1)), "multi-hop", "global", F.lit(HOP_ANSWER), both("text"), both("id"), "hard"),
        F.lit(1).cast("long").alias("index"),
    )


def unanswerable_question(docs: DataFrame) -> DataFrame:
    one = lambda f: F.array(F.coalesce(F.col("d")[0][f], F.lit("")))
    return _few(docs, 1).select(
        *_question(F.lit("unanswerable-1"), _filled(METADATA_QUESTION, F.col("d")[0]["title"]), "unanswerable", "local", F.lit(NO_ANSWER), one("text"), one("id"), "hard"),
        F.lit(1).cast("long").alias("index"),
    )


def questions(docs: DataFrame, most: int, modes: tuple[str, ...] = ("local", "global"), order: str = "id") -> DataFrame:
    """At most so many questions: local ones first, then the other modes in the order of MODES. Unknown modes ask nothing.

    A few are a top-k of documents. Of more than AT_ONCE all documents are numbered where they are, and nothing is sorted again.
    """
    first, total = (first_documents(docs, max(most, GLOBAL_DOCS), order), None) if most <= AT_ONCE else numbered(docs, order)
    makers = {"local": local_questions, "global": global_question, "multi-hop": multi_hop_question, "unanswerable": unanswerable_question}
    wanted = [m for m in MODES if m in modes]
    if not wanted:
        return local_questions(first).drop("index").limit(0)
    if total is not None:
        room = most - (min(most, total) if "local" in wanted else 0)
        others = [m for m in wanted if m != "local" and total >= NEEDED[m]][:room]
        parts = [local_questions(first).filter(F.col("index") <= most)] if "local" in wanted else []
        parts += [makers[m](first) for m in others]
    else:
        parts = [makers[m](first).withColumn("mode_rank", F.lit(k)) for k, m in enumerate(wanted)]
    out = parts[0] if parts else local_questions(first).limit(0)
    for part in parts[1:]:
        out = out.unionByName(part)
    if total is not None:
        return out.drop("index")
    return out.orderBy("mode_rank", "index").limit(most).drop("mode_rank", "index")


def selected_or_candidates(selected: DataFrame, candidates: DataFrame, kind: str = "query_type") -> DataFrame:
    """Selected questions, and the candidates of kinds of which none is selected; ``source`` says which."""
    text = lambda df: df.withColumn("question", truthy(F.col("question"), F.col("text"), default="")) if "text" in df.columns else df
    rest = candidates.join(selected.select(kind).distinct(), kind, "left_anti")
    return text(selected).withColumn("source", F.lit("selected")).unionByName(text(rest).withColumn("source", F.lit("candidate")), allowMissingColumns=True)


def document_summaries(docs: DataFrame, sentences: int = 2) -> DataFrame:
    return docs.select("id", "title", summary(F.col("text"), sentences).alias("summary"))


def corpus_summary(summaries: DataFrame, order: str = "id") -> DataFrame:
    """One row: the summary of all summaries, in order, and its themes, as of one text that joins them.

    Only its beginning decides: a top-k of the summaries that say something, and a longer one while these end before the last theme or sentence
    does. So what one task holds grows with the answer and not with the corpus.
    """
    said, most = summaries.filter(F.col("summary") != "").select(order, "summary"), 16
    while True:
        head = said.orderBy(order, "summary").limit(most)
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "summary"))), lambda x: x["summary"]), " ")
        text = head.agg(joined.alias("corpus"), F.count(F.lit(1)).alias("n"))
        ahead = text.select("n", F.length(summary(F.col("corpus"), 3)).alias("said"), F.length(summary(F.col("corpus"), 4)).alias("more"), F.size(themes(F.col("corpus"), 6)).alias("parts")).head()
        if ahead["n"] < most or ahead["more"] > ahead["said"] and ahead["parts"] > 5:
            return text.select(summary(F.col("corpus"), 3).alias("corpus_summary"), themes(F.col("corpus")).alias("themes"))
        most *= 8


def cluster_samples(vectors: DataFrame, clusters: int, seed: int = 42) -> DataFrame:
    """(cluster, row_id): k-means over (row_id, vector), and of each cluster the row nearest its centre, the smaller id of equals."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    ready = vectors.select("row_id", "vector", array_to_vector(F.transform("vector", lambda x: x.cast("double"))).alias("features"))
    model = KMeans(k=clusters, seed=seed, featuresCol="features", predictionCol="cluster", maxIter=20).fit(ready)
    centres = vectors.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "cluster int, centre array<double>")
    away = F.aggregate(F.zip_with("vector", "centre", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, x: a + x)
    near = model.transform(ready).join(F.broadcast(centres), "cluster").withColumn("away", away)  # one centre for each cluster asked for
    return near.groupBy("cluster").agg(F.min_by("row_id", F.struct("away", "row_id")).alias("row_id"))


def query_distribution(kinds: DataFrame, kind: str = "query_type") -> DataFrame:
    """Equal shares of all kinds."""
    distinct = kinds.select(kind).distinct()
    return distinct.crossJoin(F.broadcast(distinct.agg(F.count(F.lit(1)).alias("n")))).select(kind, (1.0 / F.col("n")).alias("share"))
