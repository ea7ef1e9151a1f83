"""Secret scans over an incremental ledger of content-addressed blobs."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm.common import Scratch

_EOL = r"(?:\r\n?|\n|\\r\\n|\\n)"  # or as escaped in a string
_BASE64 = r"[A-Za-z0-9+/=]"
#: A key from its BEGIN line to its END line, unless another block begins or ends before that. Without END: header lines with a blank line after
#: them, and whole lines of base64, or long runs of it where a line is cut or shared. Nothing is tried twice, so long texts cost their length.
_PEM = (
    r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----"
    r"(?:(?:[^-]++|-(?!----(?:BEGIN|END)\x20))*+-----END (?:[A-Z0-9]+ )*PRIVATE KEY-----"
    rf"|(?:(?:[ \t]*{_EOL}[ \t]*[A-Za-z][A-Za-z0-9-]*:[^\r\n\\]*+(?:{_EOL}[ \t]+[^\r\n\\]++)*+)++(?=(?:[ \t]*{_EOL}){{2}}))?"
    rf"(?:(?:[ \t]*{_EOL})+[ \t]*(?={_BASE64}{{24}}))?"
    rf"(?:[ \t]*(?:{_EOL}[ \t]*)?{_BASE64}{{24,}}+|[ \t]*{_EOL}[ \t]*{_BASE64}++(?=[ \t]*(?:{_EOL}|\Z))|[ \t]+[A-Za-z0-9+/]*+={{1,2}})*+)"
)

#: Kinds in the order in which spans with the same start are listed: pattern, characters that the named group (or else the match) needs at
#: least, and what a text must hold for the pattern to be tried at all.
RULES: dict[str, tuple[re.Pattern[str], int, tuple[str, ...]]] = {
    "assign": (re.compile(r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?(?P<value>[A-Za-z0-9+/_.=-]+)", re.ASCII), 6, ("=", ":")),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 20, ("AKIA",)),
    "hex": (re.compile(r"[0-9a-f]{24,}"), 24, ()),
    "pem": (re.compile(_PEM), 1, ("PRIVATE KEY-----",)),
    "jwt": (re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]++(?:\.[A-Za-z0-9_-]++){2,}+"), 1, (".eyJ",)),  # parts between dots, see _tokens
    "bearer": (re.compile(r"\bBearer\x20+(?P<value>[A-Za-z0-9+/_.=-]+)", re.ASCII), 16, ("Bearer",)),
    "urlcred": (re.compile(r"\b[a-z][a-z0-9+.-]{1,20}://[^\s/:@]++:(?P<value>[^\s/:@]++)@", re.ASCII), 3, ("://",)),
}
BASE = ("assign", "access", "hex")
#: Changes with RULES: findings of another version don't stand for this one.
RULE_VERSION = "1.1"

#: Blobs with secrets, of eight spans on average, that go to every executor; more meet their rows in a shuffle.
BROADCAST_BLOBS = 50_000

_KEYWORDS = re.compile(r"pass|secr|token|api", re.ASCII | re.IGNORECASE)


def _tokens(text: str) -> Iterator[tuple[int, int]]:
    """Spans of three parts that dots join, of which two begin with eyJ, the first one after a hyphen if need be: eight more characters of them and
    eight of the third at least. A run of parts is read once, so long texts cost their length."""
    for m in RULES["jwt"][0].finditer(text):
        if ".eyJ" not in m.group():
            continue
        parts, at, i = m.group().split("."), m.start(), 0
        while i + 2 < len(parts):
            head = 0 if parts[i].startswith("eyJ") else parts[i].find("-eyJ") + 1 or len(parts[i])
            if len(parts[i]) - head >= 11 and parts[i + 1].startswith("eyJ") and len(parts[i + 1]) >= 11 and len(parts[i + 2]) >= 8:
                end = at + sum(len(x) + 1 for x in parts[i : i + 3])
                yield at + head, end - 1
                at, i = end, i + 3
            else:
                at, i = at + len(parts[i]) + 1, i + 1


def find_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all secrets, by start, then by kind as listed; ends are exclusive. Matches of a kind don't overlap."""
    found = []
    for order, (kind, (pattern, least, needs)) in enumerate(RULES.items()):
        if needs and not any(n in text for n in needs) or kind == "assign" and not _KEYWORDS.search(text):
            continue
        if kind == "jwt":
            found += [(a, order, b, kind) for a, b in _tokens(text)]
            continue
        value = "value" if "value" in pattern.groupindex else 0
        found += [(m.start(), order, m.end(), kind) for m in pattern.finditer(text) if m.end(value) - m.start(value) >= least]
    return [(a, b, kind) for a, _, b, kind in sorted(found)]


SPANS = "array<struct<start: long, end: long, kind: string>>"
LEDGER = f"blob string, rule_version string, spans {SPANS}"
_SPAN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = [[{"start": a, "end": b, "kind": k} for a, b, k in find_spans(t or "")] for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, _SPAN_TYPE)], ["blob", "spans"])


def blob_column(text_column: str = "text"):
    """The address of a text: SHA-256 of its UTF-8 bytes; null counts as empty."""
    return F.sha2(F.coalesce(F.col(text_column), F.lit("")), 256)


def scan_unseen(texts: DataFrame, ledger: DataFrame | None = None, rule_version: str = RULE_VERSION, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(blob, rule_version, spans) of every blob that the ledger doesn't hold under this version of the rules: the rows to append to it.

    A blob with several paths or versions is scanned once, at its smallest path: addresses are counted first, and only texts of the
    chosen paths take part in the scan. A blob without secrets has a row, too, or it would count as unseen again.
    """
    rows = texts.select(F.col(id_column).alias("path"), F.col(text_column).alias("text"))
    found = rows.select("path", blob_column().alias("blob")).groupBy("blob").agg(F.min("path").alias("path"))
    if ledger is not None:
        found = found.join(ledger.filter(F.col("rule_version") == rule_version).select("blob").distinct(), "blob", "left_anti")
    chosen = found.select("blob", F.col("path").alias("at"))
    todo = rows.join(chosen, F.col("path").eqNullSafe(F.col("at"))).filter(blob_column() == F.col("blob")).select("blob", "text")
    return todo.mapInArrow(_scan, f"blob string, spans {SPANS}").dropDuplicates(["blob"]).select("blob", F.lit(rule_version).alias("rule_version"), "spans")


def append(texts: DataFrame, path: str, rule_version: str = RULE_VERSION, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The ledger stored at ``path``, after the findings of all blobs of ``texts`` that it doesn't hold under this version were appended to it.

    The first call makes it. One writer at a time; a write that is repeated after a failure adds rows that are there already, which reading ignores.
    """
    spark, target = texts.sparkSession, texts.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    ledger = read_ledger(spark, path) if target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target) else None
    scan_unseen(texts, ledger, rule_version, id_column, text_column).write.mode("append").parquet(path)
    return read_ledger(spark, path)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """(blob, rule_version, spans) of a stored ledger, each blob and version once."""
    return spark.read.schema(LEDGER).parquet(path).dropDuplicates(["blob", "rule_version"])


def findings(texts: DataFrame, ledger: DataFrame, rule_version: str = RULE_VERSION, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, blob, spans) of every row, from a ledger that holds all blobs: what was found once, joined back to all paths. Texts aren't scanned."""
    hits = ledger.filter((F.col("rule_version") == rule_version) & (F.size("spans") > 0)).select("blob", "spans")  # most blobs have none: their paths need no partner
    paths = texts.select(F.col(id_column).alias(id_column), blob_column(text_column).alias("blob"))
    return paths.join(hits, "blob", "left").select(id_column, "blob", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))


def scan(texts: DataFrame, path: str | None = None, rule_version: str = RULE_VERSION, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, blob, spans) of every row: unseen blobs are scanned and appended to the ledger at ``path`` (one of this run, if None), and findings joined back.

    Null texts count as empty. Repeated rows each get their findings. Null ids are paths like others. An empty table has no rows; other
    columns, whatever their names, don't matter. Very long texts cost their length, as no pattern looks at a character again and again.
    """
    path = path or Scratch(texts.sparkSession, "secrets").path + "/ledger"
    return findings(texts, append(texts, path, rule_version, id_column, text_column), rule_version, id_column, text_column)


def render(spans, kinds: tuple[str, ...] | None = None):
    """kind:start:end of the spans, in their order, comma-joined."""
    if kinds:
        spans = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_kind(spans, kind: str):
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def redact(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows with every span replaced by [KIND]; overlapping spans go as one, under the name of the first. Other columns stay.

    Rows whose text is null or has no secret are unchanged. Findings meet rows by blob, so equal texts are scanned once. An empty table has no
    rows; columns may have any names.
    """
    scratch = Scratch(docs.sparkSession, "redact")
    found = scratch.table(scan_unseen(docs, None, RULE_VERSION, id_column, text_column).filter(F.size("spans") > 0).select("blob", "spans"), "found")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), blob_column(text_column).alias("blob"))
    if found.limit(BROADCAST_BLOBS + 1).count() <= BROADCAST_BLOBS and (found.agg(F.sum(F.size("spans"))).head()[0] or 0) <= 8 * BROADCAST_BLOBS:
        found = F.broadcast(found)  # counted: rows stay where they are
    joined, text = rows.join(found, "blob", "left"), F.col(f"row.`{text_column}`")
    step = F.aggregate(
        "spans",
        F.struct(F.lit("").alias("done"), F.lit(0).cast("long").alias("at")),
        lambda a, s: F.struct(
            F.when(s["start"] >= a["at"], F.concat(a["done"], F.substring(text, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(a["done"]).alias("done"),
            F.greatest(a["at"], s["end"]).alias("at"),
        ),
        lambda a: F.concat(a["done"], F.substring(text, (a["at"] + 1).cast("int"), F.length(text))),
    )
    clean = F.when(F.col("spans").isNull(), text).otherwise(step)
    return joined.select(*((clean if c == text_column else F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def digest(text: str) -> str:
    """The base digest of one text, for tests and single lookups."""
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in find_spans(text) if k in BASE).encode()).hexdigest()
