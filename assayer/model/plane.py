"""Running models over DataFrames."""

from __future__ import annotations

import hashlib
import json
import math
import os
import re
from collections.abc import Callable, Iterator, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import partial
from typing import Any, Protocol
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.functions.text import render_contexts
from assayer.functions.verdicts import prompt, verdict
from assayer.operators.joins import strict_lookup


class Judge(Protocol):
    """Answers a prompt with text."""

    def answer(self, prompt: str) -> str: ...


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Searcher(Protocol):
    def search(self, question: str, mode: str, sample_id: str) -> dict[str, Any]: ...


class Metric(Protocol):
    """Scores one row; takes the keyword arguments that it names."""

    def score(self, **row: Any) -> float: ...


# ---------------------------------------------------------------- offline stand-ins


class LexicalJudge:
    """Says 1 if most words of the prompt's reference answer are in its context. Needs no network; for tests and dry runs."""

    def __init__(self, share: float = 0.5):
        self.share = share

    def answer(self, prompt: str) -> str:
        wanted, _, context = prompt.partition("Reference answer:\n")[2].partition("\n\nContext:\n")
        a, b = set(re.findall(r"\w+", wanted.lower())), set(re.findall(r"\w+", context.lower()))
        held = len(a & b) / len(a) if a else 0.0
        return f'{{"correctness": {int(held >= self.share)}, "reason": "{held:.2f} of the words"}}'


class HashEmbedder:
    """Unit vectors of hashed words; equal texts have equal vectors."""

    def __init__(self, size: int = 64):
        self.size = size

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * self.size
            for w in re.findall(r"\w+", t.lower()):
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
                v[h % self.size] += 1.0 if h >> 63 else -1.0
            n = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / n for x in v])
        return out


class StubSearcher:
    """Always finds the same contexts."""

    def __init__(self, contexts: list[dict[str, Any]]):
        self.contexts = contexts

    def search(self, question: str, mode: str, sample_id: str) -> dict[str, Any]:
        return {"sample_id": sample_id, "question": question, "search_mode": mode, "answer": f"Stub answer for {mode}: {question}", "retrieved_contexts": self.contexts}


# ---------------------------------------------------------------- runners


def _judge(batches: Iterator[pa.RecordBatch], judge: Judge, at_once: int) -> Iterator[pa.RecordBatch]:
    with ThreadPoolExecutor(at_once) as pool:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(pool.map(judge.answer, batch.column(1).to_pylist())), pa.string())], ["prompt_id", "raw"])


def ask(prompts: DataFrame, judge: Judge, cache: DataFrame | None = None, at_once: int = 4, partitions: int | None = None) -> DataFrame:
    """(prompt_id, raw) of the distinct prompts (prompt): answers of the cache, and the judge's for those it doesn't hold.

    Each partition asks ``at_once`` at a time, so partitions times that is what the model's server gets. Write the result before using it
    twice: Spark would ask again.
    """
    distinct = prompts.select(F.sha2("prompt", 256).alias("prompt_id"), "prompt").distinct()
    new = distinct if cache is None else distinct.join(cache.select("prompt_id"), "prompt_id", "left_anti")
    new = new.repartition(partitions, "prompt_id") if partitions else new
    answered = new.mapInArrow(partial(_judge, judge=judge, at_once=at_once), "prompt_id string, raw string")
    return answered if cache is None else answered.unionByName(cache.join(distinct.select("prompt_id"), "prompt_id", "left_semi").select("prompt_id", "raw"))


def judge_correctness(samples: DataFrame, results: DataFrame, judge: Judge, cache: DataFrame | None = None, strict: bool = True) -> DataFrame:
    """Tidy scores (sample_id, metric_name, value, reason): whether each sample's contexts hold its reference answer. Parsing is native."""
    joined = strict_lookup(samples.select("sample_id", "question", "reference_answer"), results.select("sample_id", "pos", "retrieved_contexts"), "sample_id", F.col("pos"), strict)
    asked = joined.select("sample_id", prompt(F.col("question"), F.col("reference_answer"), render_contexts(F.col("retrieved_contexts"))).alias("prompt")).withColumn("prompt_id", F.sha2("prompt", 256))
    raw = ask(asked, judge, cache)
    return asked.select("sample_id", "prompt_id").join(raw, "prompt_id").select("sample_id", F.lit("correctness").alias("metric_name"), verdict(F.col("raw")).alias("v")).select("sample_id", "metric_name", "v.value", "v.reason")


def _embed(batches: Iterator[pa.RecordBatch], embedder: Embedder, size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).to_pylist()
        vectors = [v for i in range(0, len(texts), size) for v in embedder.embed(texts[i : i + size])]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(vectors, pa.list_(pa.float32()))], ["unit_id", "vector"])


def fill_embeddings(units: DataFrame, embedder: Embedder, batch: int = 32) -> DataFrame:
    """Units (unit_id, text, text_embedding) with the embeddings that were missing; units without text stay without."""
    todo = units.filter("text_embedding is null and text <> ''").select("unit_id", "text").dropDuplicates(["unit_id"])
    made = todo.mapInArrow(partial(_embed, embedder=embedder, size=batch), "unit_id string, vector array<float>")
    return units.join(made, "unit_id", "left").withColumn("text_embedding", F.coalesce("text_embedding", "vector")).drop("vector")


def _score(batches: Iterator[pa.RecordBatch], metrics: Mapping[str, Callable[[], Metric]]) -> Iterator[pa.RecordBatch]:
    import inspect

    made = {name: make() for name, make in metrics.items()}  # once for each partition
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            wide = row | {"user_input": row.get("question"), "response": row.get("answer"), "reference": row.get("reference_answer"), "ground_truth": row.get("reference_answer"), "contexts": row.get("retrieved_contexts")}
            for name, metric in made.items():
                names = inspect.signature(metric.score).parameters
                open_ = any(p.kind is p.VAR_KEYWORD for p in names.values())
                out.append((row["sample_id"], name, float(metric.score(**(wide if open_ else {k: v for k, v in wide.items() if k in names})))))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * 3, [pa.string(), pa.string(), pa.float64()])], ["sample_id", "metric_name", "value"])


def run_metrics(rows: DataFrame, metrics: Mapping[str, Callable[[], Metric]]) -> DataFrame:
    """Tidy scores of every row by every metric; a metric is made once for each partition."""
    return rows.mapInArrow(partial(_score, metrics=metrics), "sample_id string, metric_name string, value double")


def _search(batches: Iterator[pa.RecordBatch], searcher: Searcher) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [json.dumps(searcher.search(r["question"], r["search_mode"], r["sample_id"]), ensure_ascii=False) for r in batch.to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("sample_id")), pa.array(found)], ["sample_id", "result"])


def search(questions: DataFrame, searcher: Searcher) -> DataFrame:
    """(sample_id, result as JSON) of questions (sample_id, question, search_mode)."""
    return questions.select("sample_id", "question", "search_mode").mapInArrow(partial(_search, searcher=searcher), "sample_id string, result string")


def resolve(names: list[str], registry: Mapping[str, Callable[[], Metric]]) -> dict[str, Callable[[], Metric]]:
    """The registry's metrics of these names, once each, in this order."""
    if lost := [n for n in names if n not in registry]:
        raise ValueError(f"unsupported or unavailable metrics: {', '.join(lost)}")
    return {n: registry[n] for n in names}


# ---------------------------------------------------------------- lexical variants of model metrics


def lexical_scores(rows: DataFrame) -> DataFrame:
    """Word-overlap variants of the four usual metrics, named lexical_* as they aren't the models' scores. rows: (sample_id, question, answer, reference_answer, retrieved_contexts array<string>)."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != ""))
    part = lambda a, b: F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(a)), F.lit(0.0))
    held = words(F.array_join("retrieved_contexts", " "))
    useful = F.size(F.filter("retrieved_contexts", lambda c: part(words(F.col("reference_answer")), words(c)) > 0.2))
    values = {
        "lexical_context_precision": F.coalesce(F.try_divide(useful, F.size("retrieved_contexts")), F.lit(0.0)),
        "lexical_context_recall": part(words(F.col("reference_answer")), held),
        "lexical_faithfulness": part(words(F.col("answer")), held),
        "lexical_answer_relevancy": part(words(F.col("question")), words(F.col("answer"))),
    }
    return rows.select("sample_id", *(v.alias(k) for k, v in values.items())).unpivot("sample_id", list(values), "metric_name", "value")


# ---------------------------------------------------------------- configuration


def parse_flag(text: str | None, default: bool = False) -> bool:
    word = (text or "").strip().lower()
    return True if word in ("1", "true", "yes", "on") else False if word in ("0", "false", "no", "off") else default


def parse_whole(text: str | None) -> int | None:
    return int(text) if text and text.strip() else None


def parse_object(name: str, text: str | None) -> dict[str, Any] | None:
    """A setting that is a JSON object, or None if it isn't set."""
    if not text:
        return None
    try:
        value = json.loads(text)
    except json.JSONDecodeError as e:
        raise ValueError(f"{name} isn't JSON") from e
    if not isinstance(value, dict):
        raise ValueError(f"{name} must be a JSON object")
    return value


@dataclass(frozen=True)
class EmbeddingConfig:
    """How to embed. The provider is the chat model's where none is given."""

    provider: str = ""
    model: str = ""
    base_url: str | None = None
    api_key: str | None = None
    extra_body: Mapping[str, Any] | None = None
    device: str | None = None
    max_seq_length: int = 128
    query_prefix: str | None = None
    document_prefix: str | None = None
    normalize: bool = True

    @classmethod
    def from_env(cls, prefix: str, env: Mapping[str, str] | None = None, **given: Any) -> EmbeddingConfig:
        """Settings PREFIX_EMBEDDINGS_MODEL, ... of the environment; arguments count more."""
        env = os.environ if env is None else env
        at = lambda name: env.get(f"{prefix}_EMBEDDINGS_{name}") or None
        found: dict[str, Any] = {k: v for k in ("model", "base_url", "api_key", "device", "query_prefix", "document_prefix") if (v := at(k.upper()))}
        found["provider"] = (at("PROVIDER") or env.get(f"{prefix}_PROVIDER") or "").strip().lower()
        found["extra_body"] = parse_object(f"{prefix}_EMBEDDINGS_EXTRA_BODY", at("EXTRA_BODY"))
        found["normalize"] = parse_flag(at("NORMALIZE"), True)
        if (n := parse_whole(at("MAX_SEQ_LENGTH"))) is not None:
            found["max_seq_length"] = n
        return cls(**(found | given))


@dataclass(frozen=True)
class ModelConfig:
    """How to reach a model. Hosts other than these few must be allowed by name."""

    base_url: str
    model: str
    api_key: str = ""
    max_tokens: int = 256
    sequence: int = 128
    provider: str = ""
    extra_body: Mapping[str, Any] | None = None
    hosts: tuple[str, ...] = ("openrouter.ai", "localhost", "127.0.0.1")

    def __post_init__(self) -> None:
        if (urlparse(self.base_url).hostname or "").lower() not in self.hosts:
            raise ValueError(f"host not allowed: {self.base_url}")

    @classmethod
    def from_env(cls, prefix: str, env: Mapping[str, str] | None = None, **given: Any) -> ModelConfig:
        """Settings PREFIX_BASE_URL, PREFIX_MODEL, ... of the environment; arguments count more."""
        env = os.environ if env is None else env
        found: dict[str, Any] = {k: v for k in ("base_url", "model", "api_key") if (v := env.get(f"{prefix}_{k.upper()}"))}
        found["provider"] = (env.get(f"{prefix}_PROVIDER") or "").strip().lower()
        found["extra_body"] = parse_object(f"{prefix}_EXTRA_BODY", env.get(f"{prefix}_EXTRA_BODY"))
        found |= {k: n for k in ("max_tokens", "sequence") if (n := parse_whole(env.get(f"{prefix}_{k.upper()}"))) is not None}
        return cls(**(found | given))
