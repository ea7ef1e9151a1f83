"""Language identification: text likelihoods, declared markup language, address suffix and host priors, fused by Bayes' rule."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import Scratch, small_batches, text_buffer

#: Byte trigrams are counted in so many buckets.
BUCKETS = 1 << 14
#: Trigrams of a text aren't independent; their mean log-likelihood counts as often as the text has trigrams, but no oftener than this.
EVIDENCE = 60
#: Pages that a level's parent counts for in the host priors, and pseudo-counts in the tables of declarations and suffixes.
PARENT, PSEUDO = 4.0, 0.5
#: Declarations or suffixes that the pseudo-counts of a language stand for.
KINDS = 20

_NAME = re.compile(r"</?([A-Za-z][A-Za-z0-9:-]*)")
_CLOSE = {name: re.compile(rf"</{name}\s*+>", re.IGNORECASE) for name in ("script", "style", "nav", "footer", "aside", "header", "noscript")}
_LANG = re.compile(r"""\blang\s*+=\s*+["']?([a-z]{2,3})""", re.IGNORECASE)
_CONTENT = re.compile(r"""(?<![\w-])content\s*+=\s*+["']?([a-z]{2,3})""", re.IGNORECASE)


def visible_and_declared(markup: str) -> tuple[str, str | None]:
    """The text of the article or main elements, or else of all that isn't navigation, script or style; and the language that html or meta declares.

    One pass over the tags. What isn't closed is no element: it is looked for once, and its tag goes like any other. Comments go, tags become
    blanks, and a < without a > is text.
    """
    out: list[str] = []
    opened: dict[str, int] = {}
    regions: list[tuple[int, int]] = []
    never: set[str] = set()  # elements, or comments, that aren't closed any more
    by_html = by_meta = None
    at = 0
    while (start := markup.find("<", at)) >= 0:
        if markup.startswith("<!--", start) and "!--" not in never:
            end = markup.find("-->", start + 4)
            if end >= 0:
                out += [markup[at:start], " "]
                at = end + 3
                continue
            never.add("!--")
        end = markup.find(">", start)
        if end < 0:
            break
        out += [markup[at:start], " "]
        at = end + 1
        m = _NAME.match(markup, start, at)
        name = m.group(1).lower() if m else ""
        closing = markup.startswith("</", start)
        if name in _CLOSE and not closing and name not in never:
            m = _CLOSE[name].search(markup, at)
            if m:
                at = m.end()
            else:
                never.add(name)
        elif name in ("article", "main"):
            if not closing:
                opened.setdefault(name, len(out))
            elif name in opened:
                regions.append((opened.pop(name), len(out)))
        elif name == "html" and by_html is None and not closing:
            m = _LANG.search(markup, start, at)
            by_html = m.group(1).lower() if m else None
        elif name == "meta" and by_meta is None and "content-language" in markup[start:at].lower():
            m = _CONTENT.search(markup, start, at)
            by_meta = m.group(1).lower() if m else None
    out.append(markup[at:])
    text, last = [], 0
    for a, b in sorted(regions):
        if a >= last:
            text.append("".join(out[a:b]))
            last = b
    return " ".join(text) if regions else "".join(out), by_html or by_meta


def _trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte trigrams of each text, and the n + 1 offsets of the texts among them."""
    data, offsets = text_buffer(texts)
    d = data.astype(np.uint32)
    if len(d) < 3:
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    grams = ((d[:-2] * np.uint32(0x9E3779B1)) ^ (d[1:-1] * np.uint32(0x85EBCA77)) ^ (d[2:] * np.uint32(0xC2B2AE3D))) >> np.uint32(32 - 14)
    count = np.maximum(np.diff(offsets) - 2, 0)
    to = np.concatenate([[0], np.cumsum(count)])
    return grams[np.repeat(offsets[:-1] - to[:-1], count) + np.arange(to[-1])].astype(np.int64), to


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in small_batches(batches):
        langs = batch.column(0).to_pylist()
        grams, at = _trigrams(pa.array([(t or "").lower() for t in batch.column(1).to_pylist()], pa.large_string()))
        for lang, a, b in zip(langs, at, at[1:]):
            total[lang] = total.get(lang, 0) + np.bincount(grams[a:b], minlength=BUCKETS)
    for lang, counts in total.items():
        hit = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(hit), pa.string()), pa.array(hit.astype(np.int32)), pa.array(counts[hit].astype(np.int64))], ["lang", "bucket", "n"])


def train(labelled: DataFrame, max_labelled: int = 8000, lang_column: str = "lang", id_column: str = "doc_id", text_column: str = "text") -> tuple[list[str], np.ndarray]:
    """Languages, in order of name, and the log-probability of every trigram bucket in each: a model of BUCKETS numbers a language.

    ``max_labelled`` bounds the labelled texts used: of more, about so many are taken by the hash of their id. Null languages are left out.
    """
    known = labelled.filter(F.col(lang_column).isNotNull()).select(F.col(lang_column).alias("lang"), F.col(text_column).alias("text"), F.col(id_column).alias("id"))
    share = min(1.0, max_labelled / max(1, known.select("lang").count()))
    picked = known.filter(F.pmod(F.xxhash64("id", F.lit("language")), F.lit(1 << 20)) < int(share * (1 << 20))) if share < 1 else known
    rows = picked.select("lang", "text").mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect()
    langs = sorted({r["lang"] for r in rows})
    place = {lang: k for k, lang in enumerate(langs)}
    counts = np.full((max(1, len(langs)), BUCKETS), 0.5)
    for r in rows:
        counts[place[r["lang"]], r["bucket"]] += r["n"]
    return langs, np.log(counts / counts.sum(axis=1, keepdims=True))


def _evidence(batches: Iterator[pa.RecordBatch], table: np.ndarray, markup: bool) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches, text="content"):
        content = [t or "" for t in batch.column(2).to_pylist()]
        seen = [visible_and_declared(t) for t in content] if markup else [(t, None) for t in content]
        found = [d for _, d in seen]
        grams, at = _trigrams(pa.array([t.lower() for t, _ in seen], pa.large_string()))
        n = np.diff(at)
        scores = np.zeros((len(content), len(table)))
        for k, row in enumerate(table):
            c = np.concatenate([[0.0], np.cumsum(row[grams])])
            scores[:, k] = (c[at[1:]] - c[at[:-1]]) / np.maximum(n, 1) * np.minimum(n, EVIDENCE)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array(list(scores), pa.list_(pa.float64()))], ["id", "address", "declared", "likelihood"])


def _total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0.0), lambda a, x: a + x)


def _normal(logs: Column) -> Column:
    """Probabilities in proportion to the exponentials."""
    weights = F.transform(logs, lambda x: F.exp(x - F.array_max(logs)))
    return F.transform(weights, lambda w: w / _total(weights))


def _added(*arrays: Column) -> Column:
    out = arrays[0]
    for x in arrays[1:]:
        out = F.zip_with(out, x, lambda a, b: a + b)
    return out


def identify(rows: DataFrame, langs: list[str], table: np.ndarray, id_column: str, content_column: str, address_column: str | None = None, markup: bool = False) -> DataFrame:
    """(id, language, probability, text_language, declared, host) of every row.

    Text alone gives a posterior first. Its sums by host, by suffix and over all rows are priors, each level smoothed towards the level above
    and without the row itself; its sums by declared language and by suffix are the tables of how a language's pages declare themselves and where
    they lie. A second pass adds the logarithms of all evidence. An address without a scheme, such as a source's name, is a host with no
    suffix. Null and empty contents have no text evidence, so priors decide; null addresses and missing declarations say nothing. Without
    languages, language is null. Repeated rows are rows like others and each other's evidence. Markup is read in one pass, so very long or
    malformed pages cost their length. An empty table has no rows; other columns, whatever their names, don't matter.
    """
    address = F.col(address_column).cast("string") if address_column else F.lit(None).cast("string")
    base = rows.select(F.col(id_column).cast("long").alias("id"), address.alias("address"), F.col(content_column).alias("content"))
    scratch = Scratch(rows.sparkSession, "language")
    found = scratch.table(base.mapInArrow(partial(_evidence, table=table, markup=markup), "id long, address string, declared string, likelihood array<double>"), "evidence")
    url = F.regexp_extract("address", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1)
    host = F.lower(F.when(url != "", url).otherwise(F.col("address")))
    suffix = F.when(url != "", F.lower(F.regexp_extract(url, r"\.([^.]+)$", 1)))
    found = found.withColumn("host", host).withColumn("suffix", suffix)
    if not langs:
        return found.select("id", F.lit(None).cast("string").alias("language"), F.lit(None).cast("double").alias("probability"), F.lit(None).cast("string").alias("text_language"), "declared", "host")
    k = range(len(langs))
    first = scratch.table(found.select("id", "declared", "host", "suffix", F.col("likelihood").alias("l"), _normal(F.col("likelihood")).alias("p")), "first")
    scratch.drop("evidence")
    p, zeros = F.col("p"), F.lit([0.0] * len(langs))

    def sums(name: str, *by: str) -> DataFrame:
        return first.groupBy(*by).agg(F.array(*(F.sum(p[i]) for i in k)).alias(name))

    def looked_up(df: DataFrame, name: str, by: str) -> DataFrame:
        return df.join(sums(name, by).filter(F.col(by).isNotNull()), by, "left").withColumn(name, F.coalesce(name, zeros))

    df = first.crossJoin(F.broadcast(sums("everywhere")))  # one row
    for name, by in (("at_host", "host"), ("at_suffix", "suffix"), ("at_declared", "declared")):
        df = looked_up(df, name, by)

    def others(name: str, there: str | None = None) -> Column:
        """The sums without the row itself, which is among them where it has that host, suffix or declaration."""
        own = p if there is None else F.when(F.col(there).isNotNull(), p).otherwise(zeros)
        return F.zip_with(name, own, lambda a, x: F.greatest(a - x, F.lit(0.0)))

    prior = F.lit([1.0 / len(langs)] * len(langs))
    for name, there in (("everywhere", None), ("at_suffix", "suffix"), ("at_host", "host")):
        df = df.withColumn(f"n_{name}", others(name, there))
        df = df.withColumn(f"prior_{name}", F.zip_with(f"n_{name}", prior, lambda a, q: a + PARENT * q))
        df = df.withColumn(f"prior_{name}", F.transform(f"prior_{name}", lambda x: x / (_total(F.col(f"n_{name}")) + PARENT)))  # noqa: B023
        prior = F.col(f"prior_{name}")
    df = df.withColumn("n_declared", others("at_declared", "declared"))

    def table(name: str, there: str) -> Column:
        """The logarithm of a declaration's or suffix's probability in each language, next to its probability in any."""
        logs = F.zip_with(name, "n_everywhere", lambda a, n: F.log((a + PSEUDO) / (n + PSEUDO * KINDS)))
        return F.when(F.col(there).isNull(), zeros).otherwise(logs)

    df = df.withColumn("q", _normal(_added(F.col("l"), F.transform(prior, lambda x: F.log(x)), table("n_declared", "declared"), table("n_at_suffix", "suffix"))))

    def best(name: str) -> Column:
        """(p, order): the likeliest language, the first of equals."""
        return F.array_max(F.transform(name, lambda x, i: F.struct(x.alias("p"), (-i).alias("order"))))

    names = F.lit(langs)
    df = df.select("id", best("q").alias("q"), best("p").alias("p"), "declared", "host")
    return df.select("id", F.get(names, -F.col("q.order")).alias("language"), F.col("q.p").alias("probability"), F.get(names, -F.col("p.order")).alias("text_language"), "declared", "host")
