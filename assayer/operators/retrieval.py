"""Preparing and scoring retrieval results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions.values import divergence, truthy
from assayer.operators.joins import nearest, resolve_units
from assayer.operators.scores import corrected, sign_test

#: What a retrieved context and a cluster's unit are matched by: the context's column and the unit's.
MATCH = {"id": ("chunk_id", "unit_id"), "short_id": ("chunk_id", "short_id"), "text": ("text", "text")}
#: What is scored of each question.
SCORES = ("binary_precision", "graded_precision", "recall", "fidelity")


def context_ids(contexts: DataFrame) -> DataFrame:
    """(question_id, pos, chunk_id, text, ...) of contexts with a resolved unit_id: that, or the first id that isn't empty, or the position."""
    ids = [F.col(c) for c in ("unit_id", "id", "source_id", "chunk_id", "source") if c in contexts.columns]
    return contexts.withColumn("chunk_id", F.coalesce(truthy(*ids), F.concat(F.lit("context-"), F.col("pos").cast("string"))))


def prepare(results: DataFrame, units: DataFrame) -> DataFrame:
    """(question_id, question_text, context) of results (question_id, question_text, contexts); contexts keep their order and get the ids of the units they quote."""
    each = results.select("question_id", "question_text", F.posexplode_outer("contexts").alias("pos", "c")).select("question_id", "question_text", "pos", "c.*")
    each = each.withColumn("context_id", F.xxhash64("question_id", "pos"))
    found = resolve_units(each.filter("pos is not null").select("context_id", "text"), units)
    named = context_ids(each.join(found, "context_id", "left"))
    kept = F.when(F.col("pos").isNotNull(), F.struct("pos", "chunk_id", "text"))
    nested = named.groupBy("question_id").agg(F.first("question_text").alias("question_text"), F.array_sort(F.collect_list(kept)).alias("c"))
    return nested.select("question_id", "question_text", F.transform("c", lambda x: F.struct(x["chunk_id"].alias("chunk_id"), x["text"].alias("text"))).alias("context"))


def normalise_rows(rows: DataFrame, id_key: str = "chunk_id", text_key: str = "text") -> DataFrame:
    """Rows whose contexts keep an id and a text only, and whose text and question_text stand for each other where one is missing."""

    def context(c: Column) -> Column:
        fields = {f.name for f in rows.schema["context"].dataType.elementType.fields}
        ids = [c[n] for n in (id_key, "source_id", "chunk_id", "source", "id") if n in fields]
        texts = [c[n] for n in (text_key, "source_text", "text") if n in fields]
        return F.struct(truthy(*ids, default="").alias(id_key), truthy(*texts, default="").alias(text_key))

    out = rows.withColumn("context", F.transform("context", context))
    for missing, there in (("text", "question_text"), ("question_text", "text")):
        if missing not in out.columns and there in out.columns:
            out = out.withColumn(missing, F.coalesce(there, F.lit("")))
    return out


def reference(questions: DataFrame, units: DataFrame, semantic: int = 10, central: int = 5) -> DataFrame:
    """(question_id, unit_id, cluster_id, kind): units to assess for each question: its nearest ones, and the nearest of its nearest clusters' ones.

    questions: (query_id, vector), a stated list; units: (row_id, vector, cluster_id). A cluster's centre is the mean of its vectors.
    """
    near = nearest(questions, units.select("row_id", "vector"), semantic).select("query_id", "row_id", F.lit("semantic").alias("kind"))
    centres = centroids(units)
    close = nearest(questions, centres.select(F.col("cluster_id").alias("row_id"), "vector"), central, normalised=False).select("query_id", F.col("row_id").alias("cluster_id"))
    leaders = units.join(centres.select("cluster_id", F.col("vector").alias("centre")), "cluster_id").groupBy("cluster_id").agg(F.min_by("row_id", F.struct(F.aggregate(F.zip_with("vector", "centre", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, x: a + x), "row_id")).alias("row_id"))
    by_centre = close.join(leaders, "cluster_id").select("query_id", "row_id", F.lit("centroid").alias("kind"))
    return near.unionByName(by_centre).join(units.select("row_id", "cluster_id"), "row_id").select(F.col("query_id").alias("question_id"), F.col("row_id").alias("unit_id"), "cluster_id", "kind")


def centroids(units: DataFrame) -> DataFrame:
    """(cluster_id, vector): means of (cluster_id, vector), one number for each dimension, combined before the shuffle."""
    each = units.select("cluster_id", F.posexplode("vector").alias("d", "x"))
    means = each.groupBy("cluster_id", "d").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias("vector"))


def match_units(contexts: DataFrame, units: DataFrame, by: str = "id") -> DataFrame:
    """Contexts (question_id, chunk_id, text, ...) with the unit_id and cluster_id of the unit that they are, by id, short_id or text.

    units: (unit_id, short_id, text, cluster_id). Of several equal units the smallest id counts; a context without a unit has its own id and no
    cluster. Texts meet by digest.
    """
    if by not in MATCH:
        raise ValueError(f"clusters are matched by {', '.join(MATCH)}, not by {by}")
    theirs, ours = ((F.sha2(c, 256) if by == "text" else F.col(c).cast("string")) for c in MATCH[by])
    known = units.select(ours.alias("__match"), F.struct("unit_id", "cluster_id").alias("u")).groupBy("__match").agg(F.min("u").alias("__unit"))
    joined = contexts.withColumn("__match", theirs).join(known, "__match", "left")
    return joined.withColumn("unit_id", F.coalesce("__unit.unit_id", "chunk_id")).withColumn("cluster_id", F.col("__unit.cluster_id")).drop("__match", "__unit")


def rate(matched: DataFrame, reference: DataFrame) -> DataFrame:
    """Matched contexts with the score that the question's reference gives the unit (3 where it gives none, the best of several), else 0; those of no cluster are in "none"."""
    score = F.col("score") if "score" in reference.columns else F.lit(3)
    good = reference.groupBy("question_id", "unit_id").agg(F.max(score).alias("score"))
    return matched.join(good, ["question_id", "unit_id"], "left").withColumn("score", F.coalesce("score", F.lit(0))).withColumn("cluster_id", F.coalesce("cluster_id", F.lit("none")))


def relevant_units(reference: DataFrame, threshold: int = 2) -> DataFrame:
    """(question_id, cluster_id, n): how many of a cluster's units are relevant to each question: those with the threshold, or all of a reference without scores."""
    good = reference.filter(F.col("score") >= threshold) if "score" in reference.columns else reference
    return good.groupBy("question_id", "cluster_id").agg(F.count_distinct("unit_id").alias("n"))


def compare(each: DataFrame, method: str = "rag_method", alpha: float = 0.05, correction: str = "holm") -> DataFrame:
    """(metric_name, first, second, wins, losses, p_value, p_adjusted, significant): sign tests of each two methods over the questions that both have.

    each: what question_scores gives, by method. Tests of one metric are a family for the correction: holm, bonferroni or none.
    """
    tidy = each.unpivot([method, "question_id"], list(SCORES), "metric_name", "value")
    left = tidy.select("question_id", "metric_name", F.col(method).alias("first"), F.col("value").alias("a"))
    right = tidy.select("question_id", "metric_name", F.col(method).alias("second"), F.col("value").alias("b"))
    pairs = left.join(right, ["question_id", "metric_name"]).filter("first < second")  # as many rows of a question as pairs of methods
    tests = sign_test(pairs, ["metric_name", "first", "second"], "a", "b").withColumn("test", F.concat_ws(" / ", "first", "second"))
    return corrected(tests, "metric_name", correction).withColumn("significant", F.col("p_adjusted") < alpha).drop("test")


def score(retrieved: DataFrame, relevance: DataFrame, threshold: int = 2, fidelity: str = "js", by: tuple[str, ...] = ()) -> DataFrame:
    """One row for each group of ``by``: binary_precision, graded_precision, recall, fidelity, total_queries; means of question_scores."""
    return means(question_scores(retrieved, relevance, threshold, fidelity, by), by)


def question_scores(retrieved: DataFrame, relevance: DataFrame, threshold: int = 2, fidelity: str = "js", by: tuple[str, ...] = ()) -> DataFrame:
    """One row for each question and group of ``by``: binary_precision, graded_precision, recall, fidelity.

    retrieved: (by..., question_id, unit_id, cluster_id, score 0-3); relevance: (question_id, cluster_id, n), how many units of each cluster
    are relevant. Precision is the share of retrieved units with the threshold, or the mean score over 3. Recall is the share of relevant
    clusters of which a relevant unit was retrieved; fidelity is 1 minus the divergence of the clusters' shares, relevant and retrieved. The
    formulas are ours, as none is published.
    """
    keys = [*by, "question_id"]
    hit = F.col("score") >= threshold
    precision = retrieved.groupBy(*keys).agg(F.avg(hit.cast("double")).alias("binary"), (F.avg("score") / 3).alias("graded"))
    found = retrieved.groupBy(*keys, "cluster_id").agg(F.count(F.lit(1)).alias("got"), F.max(hit.cast("int")).alias("hit"))
    wanted = retrieved.select(*keys).distinct().join(relevance, "question_id") if by else relevance
    both = wanted.join(found, [*keys, "cluster_id"], "full").select(*keys, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("got", F.lit(0)).alias("got"), F.coalesce("hit", F.lit(0)).alias("hit"))
    shares = both.groupBy(*keys).agg(
        F.try_divide(F.sum(F.when(F.col("n") > 0, F.col("hit")).otherwise(0)).cast("double"), F.count_if(F.col("n") > 0)).alias("recall"),
        F.array_sort(F.collect_list(F.struct("n", "got"))).alias("c"),
        F.sum("n").alias("all_n"),
        F.sum("got").alias("all_got"),
    )
    p = F.transform("c", lambda x: F.coalesce(F.try_divide(x["n"].cast("double"), F.col("all_n")), F.lit(0.0)))
    q = F.transform("c", lambda x: F.coalesce(F.try_divide(x["got"].cast("double"), F.col("all_got")), F.lit(0.0)))
    same = shares.withColumn("p", p).withColumn("q", q).withColumn("same", 1 - divergence(fidelity, F.col("p"), F.col("q")))
    joined = precision.join(same.select(*keys, "recall", "same"), keys)
    return joined.select(*keys, F.col("binary").alias("binary_precision"), F.col("graded").alias("graded_precision"), F.coalesce("recall", F.lit(0.0)).alias("recall"), F.col("same").alias("fidelity"))


def means(each: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The means of question_scores, and how many questions there are."""
    return each.groupBy(*by).agg(*(F.avg(c).alias(c) for c in SCORES), F.count(F.lit(1)).alias("total_queries"))
