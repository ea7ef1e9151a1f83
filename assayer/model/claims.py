"""Metrics by claims: a model takes texts apart into claims, and judges each of them against the contexts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions.text import strip, strip_code_fence
from assayer.functions.values import average_precision, cosine
from assayer.functions.verdicts import verdict
from assayer.model.plane import Embedder, Judge, ask, fill_embeddings
from assayer.session import checkpointed

METRICS = ("faithfulness", "context_recall", "context_precision", "answer_relevancy")
_LIST, _HOLDS, _HELPS, _ASKS = "List the claims", "Does the context support the claim", "Does the context help to give the answer", "Write the question"


def _prompt(task: str, ask_for: str, **parts: Column) -> Column:
    """A task, named parts of text, and the shape of the answer that is asked for."""
    out = [F.lit(f"{task}. Use nothing else.")]
    for name, value in parts.items():
        out += [F.lit(f"\n\n{name.capitalize()}:\n"), F.coalesce(value, F.lit(""))]
    return F.concat(*out, F.lit(f"\n\n{ask_for}"))


_VERDICT = 'Answer with a JSON object with the keys "correctness" (1 or 0) and "reason" (short).'


def claims_prompt(text: Column) -> Column:
    return _prompt(f"{_LIST} that the text below makes, each as a sentence of its own", "Answer with a JSON array of strings.", text=text)


def support_prompt(claim: Column, contexts: Column) -> Column:
    return _prompt(f"{_HOLDS} below", _VERDICT, claim=claim, context=contexts)


def use_prompt(question: Column, answer: Column, context: Column) -> Column:
    return _prompt(f"{_HELPS} to the question below", _VERDICT, question=question, answer=answer, context=context)


def question_prompt(answer: Column) -> Column:
    return _prompt(f"{_ASKS} that the answer below answers", "Answer with the question alone.", answer=answer)


def parse_claims(raw: Column) -> Column:
    """An array of claims from a model's answer: a JSON array, or an object whose ``claims`` are one; else its lines without bullets and numbers.

    Empty claims go, and of equal ones the first stays. Null is an empty array.
    """
    text = strip_code_fence(F.coalesce(raw, F.lit("")))
    listed = F.try_parse_json(F.coalesce(F.nullif(F.regexp_extract(text, r"(?s)(\[.*\])", 1), F.lit("")), text))
    found = F.coalesce(F.try_variant_get(listed, "$", "array<string>"), F.try_variant_get(F.try_parse_json(text), "$.claims", "array<string>"))
    lines = F.transform(F.split(text, r"\r\n|\r|\n"), lambda x: F.regexp_replace(x, r"^\s*(?:[-*•]|\d+[.)])\s+", ""))
    return F.array_distinct(F.filter(F.transform(F.coalesce(found, lines), lambda x: strip(F.coalesce(x, F.lit("")))), lambda x: x != ""))


class ClaimJudge:
    """Answers all four kinds of prompts without a model: claims are sentences, and a text holds a claim if it holds enough of its words."""

    def __init__(self, share: float = 0.5):
        self.share = share

    def answer(self, prompt: str) -> str:
        import json

        parts = dict(re.findall(r"\n\n(Text|Claim|Context|Question|Answer):\n(.*?)(?=\n\n(?:Text|Claim|Context|Question|Answer):\n|\n\nAnswer with )", prompt, re.DOTALL))
        words = lambda t: set(re.findall(r"\w+", t.lower()))
        if prompt.startswith(_LIST):
            return json.dumps([s for s in re.split(r"(?<=[.!?])\s+", parts.get("Text", "")) if s.strip()], ensure_ascii=False)
        if prompt.startswith(_ASKS):
            return re.split(r"(?<=[.!?])\s+", parts.get("Answer", ""))[0]
        wanted, context = words(parts.get("Claim", parts.get("Answer", ""))), words(parts.get("Context", ""))
        held = len(wanted & context) / len(wanted) if wanted else 0.0
        return json.dumps({"correctness": int(held >= self.share), "reason": f"{held:.2f} of the words"})


def _answered(prompts: DataFrame, judge: Judge, cache: DataFrame | None) -> DataFrame:
    """Rows with ``raw``, what the judge says to their ``prompt``. Rows carry the prompt's hash, so its text is moved once for each distinct one."""
    keyed = checkpointed(prompts.withColumn("prompt_id", F.sha2("prompt", 256)))
    raw = checkpointed(ask(keyed, judge, cache))
    return keyed.drop("prompt").join(raw, "prompt_id").drop("prompt_id")


def claims_of(texts: DataFrame, judge: Judge, cache: DataFrame | None = None) -> DataFrame:
    """(sample_id, kind, pos, claim) of texts (sample_id, kind, text); texts that are null or blank make no claim, and aren't asked about."""
    said = texts.filter(strip(F.coalesce("text", F.lit(""))) != "").select("sample_id", "kind", claims_prompt(F.col("text")).alias("prompt"))
    return _answered(said, judge, cache).select("sample_id", "kind", F.posexplode(parse_claims(F.col("raw"))).alias("pos", "claim"))


def supported(claims: DataFrame, contexts: DataFrame, judge: Judge, cache: DataFrame | None = None) -> DataFrame:
    """(sample_id, kind, pos, claim, value, reason): each claim judged against its sample's contexts (sample_id, context: one text)."""
    asked = claims.join(contexts, "sample_id").withColumn("prompt", support_prompt(F.col("claim"), F.col("context"))).drop("context")
    return _answered(asked, judge, cache).withColumn("v", verdict(F.col("raw"))).select("sample_id", "kind", "pos", "claim", "v.value", "v.reason")


def claim_scores(rows: DataFrame, judge: Judge, embedder: Embedder, cache: DataFrame | None = None, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """Tidy scores (sample_id, metric_name, value) of rows (sample_id, question, answer, reference_answer, retrieved_contexts: array of text).

    faithfulness: the share of the answer's claims that the contexts support. context_recall: the same of the reference answer's claims. context_precision: the mean
    precision at each useful context (``average_precision``), usefulness being judged context by context. answer_relevancy: how like the question is to one that a
    model makes of the answer. What can't be told is null and no part of a mean: no claims, no contexts, no answer. Every prompt is asked once,
    however many samples share it, and not at all if ``cache`` (prompt_id, raw) knows it. Claims and their verdicts are tables of their own, so
    the second pass is as wide as there are claims, not samples.
    """
    if lost := [m for m in metrics if m not in METRICS]:
        raise ValueError(f"unsupported or unavailable metrics: {', '.join(lost)}")
    base = checkpointed(rows.select("sample_id", "question", "answer", "reference_answer", "retrieved_contexts"))
    ids, parts = base.select("sample_id").distinct(), []
    by_claims = {m: c for m, c in (("faithfulness", "answer"), ("context_recall", "reference_answer")) if m in metrics}
    if by_claims:
        texts = base.select("sample_id", F.explode(F.array(*(F.struct(F.lit(m).alias("kind"), F.col(c).alias("text")) for m, c in by_claims.items()))).alias("t")).select("sample_id", "t.*")
        contexts = base.select("sample_id", F.array_join(F.filter("retrieved_contexts", lambda c: c.isNotNull()), "\n\n").alias("context"))
        judged = supported(claims_of(texts, judge, cache), contexts, judge, cache).groupBy("sample_id", F.col("kind").alias("metric_name")).agg(F.avg("value").alias("value"))
        wanted = ids.withColumn("metric_name", F.explode(F.array(*map(F.lit, by_claims))))
        parts.append(wanted.join(judged, ["sample_id", "metric_name"], "left"))
    if "context_precision" in metrics:
        each = base.select("sample_id", "question", F.coalesce(F.nullif("reference_answer", F.lit("")), "answer").alias("wanted"), F.posexplode("retrieved_contexts").alias("pos", "context"))
        asked = each.select("sample_id", "pos", use_prompt(F.col("question"), F.col("wanted"), F.col("context")).alias("prompt"))
        useful = _answered(asked, judge, cache).select("sample_id", F.struct("pos", verdict(F.col("raw"))["value"].alias("value")).alias("v"))
        ranked = useful.groupBy("sample_id").agg(F.transform(F.array_sort(F.collect_list("v")), lambda v: v["value"]).alias("v"))
        scored = ranked.select("sample_id", average_precision(F.col("v")).alias("value"))
        parts.append(ids.join(scored, "sample_id", "left").select("sample_id", F.lit("context_precision").alias("metric_name"), "value"))
    if "answer_relevancy" in metrics:
        said = base.filter(strip(F.coalesce("answer", F.lit(""))) != "").select("sample_id", "question", question_prompt(F.col("answer")).alias("prompt"))
        both = _answered(said, judge, cache).select("sample_id", F.explode(F.array(F.struct(F.lit("a").alias("side"), F.col("question").alias("text")), F.struct(F.lit("b").alias("side"), F.col("raw").alias("text")))).alias("t")).select("sample_id", "t.*")
        both = checkpointed(both.withColumn("unit_id", F.sha2(F.coalesce("text", F.lit("")), 256)))
        vectors = fill_embeddings(both.select("unit_id", "text").dropDuplicates(["unit_id"]).withColumn("text_embedding", F.lit(None).cast("array<float>")), embedder).select("unit_id", "text_embedding")
        wide = both.join(vectors, "unit_id").groupBy("sample_id").agg(*(F.max(F.when(F.col("side") == s, F.col("text_embedding"))).alias(s) for s in "ab"))
        scored = wide.select("sample_id", cosine(F.col("a"), F.col("b")).cast("double").alias("value"))
        parts.append(ids.join(scored, "sample_id", "left").select("sample_id", F.lit("answer_relevancy").alias("metric_name"), "value"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
