"""Toxicity by multiple-instance learning: sentence scores, combined by noisy-or, are trained from labels of whole documents."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"[^\W\d_]+")
#: Beginnings of longer words are features, too: what makes a word offend may be its stem.
STEMS = (4, 5, 6, 7, 8)


def _features(sentence: str) -> set[str]:
    """Distinct words of a lower-cased sentence, and their stems."""
    words = set(_WORD.findall(sentence))
    stems = {w[:k] + "-" for k in STEMS for w in words if len(w) > k}
    return words | stems


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


def fit(texts: list[str], labels: list[int], max_words: int = 2000, min_docs: int = 4, penalty: float = 0.5, steps: int = 400, rate: float = 0.15, toxic_weight: float = 8.0) -> tuple[float, dict[str, float]]:
    """Bias and word weights of the sentence model.

    A sentence is offending with probability sigmoid(bias + weights of its distinct words and stems); a document is toxic unless none of its
    sentences offends, so its log-probability of being clean is minus the sum of their softplus. Words and stems are the ``max_words`` whose
    document counts differ most between the labels; equal texts count once. A toxic document counts ``toxic_weight`` times in the loss, as
    they are few. Gradient steps (Adam) on the mean penalised log-loss, from the same start, so equal rows give equal weights.
    """
    seen: dict[str, int] = {}
    for t, y in sorted(zip(texts, labels)):
        seen[t] = max(y, seen.get(t, 0))
    y = np.array(list(seen.values()), float)
    if not len(y) or not y.any() or y.all():
        return (-20.0 if not y.any() else 20.0), {}
    counts = {v: Counter(w for t, k in seen.items() if k == v for w in _features(t.lower())) for v in (0, 1)}
    n1, n0 = y.sum(), len(y) - y.sum()
    worth = {w: (c / n1 - (d := counts[0][w]) / n0) ** 2 / ((c + d + 1) / len(y)) for w, c in counts[1].items() if c + counts[0][w] >= min_docs}
    vocabulary = {w: k for k, w in enumerate(sorted(worth, key=lambda w: (-worth[w], w))[:max_words])}
    sentence, column, owner, n = [], [], [], 0
    for i, t in enumerate(seen):
        for s in _SENTENCE.findall(t.lower()):
            hit = [vocabulary[w] for w in sorted(vocabulary.keys() & _features(s))]
            sentence += [n] * len(hit)
            column += hit
            owner.append(i)
            n += 1
    sentence, column, owner = np.array(sentence, np.int64), np.array(column, np.int64), np.array(owner, np.int64)
    theta = np.zeros(len(vocabulary) + 1)
    theta[-1] = math.log(0.1 / max(1.0, n / len(y)))
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        z = theta[-1] + np.bincount(sentence, weights=theta[column], minlength=n)
        s = np.bincount(owner, weights=_softplus(z), minlength=len(y))
        by_s = np.where(y > 0, -toxic_weight / np.expm1(np.maximum(s, 1e-9)), 1.0) / len(y)
        by_z = by_s[owner] / (1.0 + np.exp(-z))
        g = np.append(np.bincount(column, weights=by_z[sentence], minlength=len(vocabulary)), by_z.sum())
        g[:-1] += penalty / len(y) * theta[:-1]
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        theta -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return float(theta[-1]), {w: float(theta[k]) for w, k in vocabulary.items() if abs(theta[k]) > 1e-3}


def _fit_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    texts, labels = [], []
    for b in batches:
        texts += [t or "" for t in b.column(0).to_pylist()]
        labels += b.column(1).to_pylist()
    bias, weights = fit(texts, labels)
    rows = [("", bias), *sorted(weights.items())]
    yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in rows]), pa.array([x for _, x in rows])], ["word", "weight"])


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = 12_000, held_out_of: int = 5, label_column: str = "toxic", id_column: str = "doc_id", text_column: str = "text") -> tuple[float, dict[str, float]]:
    """Learns the sentence model from labelled documents whose crc32 of the id as text isn't divisible by ``held_out_of``.

    ``max_labelled`` bounds the documents: where more are labelled, about so many are taken by the hash of their id. One task fits the
    model; it returns at most 2000 words. Null labels and ids are left out; an id with several labels counts as toxic if any says so.
    """
    known = labels.filter(F.col(label_column).isNotNull() & F.col(id_column).isNotNull() & ~is_held_out(id_column, held_out_of))
    share = min(1.0, max_labelled / max(1, known.count()))
    picked = known.filter(F.pmod(F.xxhash64(id_column, F.lit("toxic")), F.lit(1 << 20)) < int(share * (1 << 20))) if share < 1 else known
    chosen = picked.groupBy(F.col(id_column).alias("t_id")).agg(F.max(label_column).cast("int").alias("t_label"))
    rows = docs.select(F.col(id_column).alias("t_id"), F.col(text_column).alias("t_text")).join(F.broadcast(chosen), "t_id").select("t_text", "t_label")
    model = {r["word"]: r["weight"] for r in rows.repartition(1).mapInArrow(_fit_part, "word string, weight double").collect()}
    return model.pop("", -20.0), model


def is_held_out(id_column: str = "doc_id", of: int = 5):
    return F.crc32(F.col(id_column).cast("string")) % of == 0


def locate(text: str, bias: float, weights: dict[str, float]) -> tuple[float, list[tuple[int, int, float]]]:
    """Score of a text and (start, end, score) of its sentences, in code points, that are likelier offending than not."""
    clean, found, lower = 0.0, [], text.lower()
    if len(lower) != len(text):  # a few letters have longer lower cases
        lower = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
    rest = 0
    for m in _SENTENCE.finditer(lower):
        words = weights.keys() & _features(m.group())
        if not words:
            rest += 1
            continue
        z = bias + sum(weights[w] for w in sorted(words))
        clean += max(z, 0.0) + math.log1p(math.exp(-abs(z)))
        if z >= 0:
            found.append((m.start(), m.end(), 1.0 / (1.0 + math.exp(-z))))
    clean += rest * (max(bias, 0.0) + math.log1p(math.exp(-abs(bias))))
    return -math.expm1(-clean), found


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def _score(batches: Iterator[pa.RecordBatch], bias: float, weights: dict[str, float]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = [locate(t or "", bias, weights) for t in b.column(1).to_pylist()]
        spans = [[{"start": x, "end": y, "score": z} for x, y, z in found] for _, found in out]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s for s, _ in out], pa.float64()), pa.array(spans, _SPANS)], ["doc_id", "score", "offending"])


def score(docs: DataFrame, bias: float, weights: dict[str, float], id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, score, offending) of every row: the probability that some sentence offends, and which do. The model has at most 2000 words.

    Null and empty texts have no sentence, so their score is 0. Equal texts have equal scores.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return rows.mapInArrow(partial(_score, bias=bias, weights=weights), "doc_id long, score double, offending array<struct<start: long, end: long, score: double>>")
