"""Readers of the engine's inputs. Schemas are explicit; JSON of open shape is read as variant."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import partial
from itertools import islice
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assayer.functions.text import canonical_path, file_name, safe_token, stem, suffix
from assayer.functions.values import truthy

GRAPH_REQUIRED = ("entities", "relationships", "communities")
GRAPH_OPTIONAL = ("community_reports", "text_units", "covariates")
SOURCE_SUFFIXES = (".txt", ".md", ".csv", ".json", ".pdf")


def exists(spark: SparkSession, path: str) -> bool:
    """Through the file system of the path, whichever that is."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target))


def _must_exist(spark: SparkSession, path: str) -> None:
    if not exists(spark, path):
        raise FileNotFoundError(path)


def text_tree(spark: SparkSession, path: str) -> DataFrame:
    """(id, title, text, source_path) of all .txt files below a folder, or of one file. An id is a file name and may come several times."""
    _must_exist(spark, path)
    files = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source_path"), F.col("value").alias("text"))
    name = F.col("source_path")
    return files.filter(suffix(name) == ".txt").select(file_name(name).alias("id"), stem(name).alias("title"), "text", "source_path")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(pos, line): lines that aren't blank, numbered from 0 in the order of files and lines, however they are split.

    Lines of a split are numbered where they are read; how many there are in the splits before comes from a count of each.
    """
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    lines = spark.read.text(path).select("value", *place).filter(F.trim("value") != "").withColumn("row", F.monotonically_increasing_id())
    splits = lines.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = splits.select("file", "block", "first", before.alias("before"))  # one row for each split
    return lines.join(offsets, ["file", "block"]).select((F.col("before") + F.col("row") - F.col("first")).alias("pos"), F.col("value").alias("line"))


def json_items(spark: SparkSession, path: str, envelopes: tuple[str, ...], strict: bool = False) -> DataFrame:
    """(pos, item variant): objects of a JSON list, of the list under the first envelope key that is there, or of JSON lines.

    ``strict``: a JSON object with none of the keys is an error, and not an empty table.
    """
    _must_exist(spark, path)
    kind = os.path.splitext(path.rstrip("/"))[1].lower()
    if kind == ".jsonl":
        return numbered_lines(spark, path).select("pos", F.parse_json("line").alias("item"))
    if kind != ".json":
        raise ValueError(f"unsupported format: {kind or path}")
    whole = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    return unwrap(whole, F.col("v"), envelopes, strict)


def unwrap(df: DataFrame, v: Column, envelopes: tuple[str, ...], strict: bool = False) -> DataFrame:
    """(pos, item) of the objects in a variant that is a list or an object with a list under one of the keys; of anything else, none."""
    kind = F.schema_of_variant(v)
    inner = F.coalesce(*(F.try_variant_get(v, f"$.{k}", "variant") for k in envelopes))
    if strict:
        inner = F.coalesce(inner, F.raise_error(F.lit(f"none of the keys {', '.join(envelopes)}")).cast("variant"))
    found = df.select(F.when(F.startswith(kind, F.lit("ARRAY")), v).when(F.startswith(kind, F.lit("OBJECT")), inner).alias("v"))
    lists = found.filter(F.startswith(F.schema_of_variant("v"), F.lit("ARRAY")))
    items = df.sparkSession.sql("SELECT e.pos, e.value AS item FROM {lists}, LATERAL variant_explode(v) AS e", lists=lists)
    return items.filter(F.startswith(F.schema_of_variant("item"), F.lit("OBJECT")))


def _text(path: str) -> Column:
    return F.try_variant_get("item", f"$.{path}", "string")


def _texts(path: str) -> Column:
    """A list of texts; a single value counts as a list of one, and nothing as an empty list."""
    v = F.try_variant_get("item", f"$.{path}", "variant")
    return F.coalesce(F.try_variant_get("item", f"$.{path}", "array<string>"), F.when(v.isNotNull() & ~F.is_variant_null(v), F.array(v.try_cast("string"))), F.array().cast("array<string>"))


def search_mode(mode: Column) -> Column:
    """local or global; anything else fails the query."""
    return F.when(mode.isin("local", "global"), mode).otherwise(F.raise_error(F.concat(F.lit("not a search mode: "), F.coalesce(mode, F.lit("null")))).cast("string"))


def _required(path: str) -> Column:
    return F.coalesce(_text(path), F.raise_error(F.lit(f"missing {path}")).cast("string"))


def samples(spark: SparkSession, path: str) -> DataFrame:
    """Benchmark samples of a list, of {"samples": [...]} or {"questions": [...]}, or of JSON lines."""
    items = json_items(spark, path, ("samples", "questions"), strict=True)
    lists = ("reference_contexts", "expected_entities", "expected_relationships", "expected_community_ids", "source_doc_ids")
    return items.select(
        "pos",
        _required("sample_id").alias("sample_id"),
        _required("question").alias("question"),
        F.coalesce(_text("query_type"), F.lit("unknown")).alias("query_type"),
        search_mode(F.coalesce(_text("search_mode"), F.lit("local"))).alias("search_mode"),
        F.coalesce(_text("reference_answer"), F.lit("")).alias("reference_answer"),
        *(_texts(c).alias(c) for c in lists),
        F.coalesce(_text("difficulty"), F.lit("medium")).alias("difficulty"),
        F.try_variant_get("item", "$.metadata", "variant").alias("metadata"),
    )


CONTEXTS = "array<struct<text: string, source: string, score: double, metadata: variant>>"


def search_results(spark: SparkSession, path: str) -> DataFrame:
    """Saved search results of a list or of {"results": [...]}."""
    items = json_items(spark, path, ("results",))
    contexts = F.transform(F.coalesce(F.try_variant_get("item", "$.retrieved_contexts", CONTEXTS), F.array().cast(CONTEXTS)), lambda c: c.withField("text", F.coalesce(c["text"], F.lit(""))))
    return items.select(
        "pos", _required("sample_id").alias("sample_id"), _required("question").alias("question"), search_mode(F.coalesce(_text("search_mode"), F.lit("local"))).alias("search_mode"),
        F.coalesce(_text("answer"), F.lit("")).alias("answer"), contexts.alias("retrieved_contexts"), _texts("citations").alias("citations"), F.try_variant_get("item", "$.metadata", "variant").alias("metadata"),
    )


def questions(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """(question_id, question_text, pos) of questions with a text. An id that is missing is the position among all; ``most`` counts those kept."""
    items = json_items(spark, path, ("questions",))
    ident = F.coalesce(truthy(_text("question_id"), _text("sample_id"), _text("id")), F.concat(F.lit("question-"), F.col("pos").cast("string")))
    out = items.select(ident.alias("question_id"), truthy(_text("question"), _text("question_text"), _text("text")).alias("question_text"), "pos").dropna(subset=["question_text"])
    return out if most is None else out.orderBy("pos").limit(most)


UNITS = "array<struct<id: string, short_id: string, text: string, document_id: string, n_tokens: int, text_embedding: array<float>>>"


def cluster_units(spark: SparkSession, path: str, units: DataFrame | None = None) -> DataFrame:
    """(cluster_id, pos, unit_id, text, short_id) of clusters that hold their units or name them; names need ``units``. Unknown ones have no text."""
    from assayer.operators.joins import fill_units

    items = json_items(spark, path, ("clusters",))
    ident = F.coalesce(truthy(_text("cluster_id"), _text("id")), F.col("pos").cast("string"))
    rows = items.select(ident.alias("cluster_id"), F.try_variant_get("item", "$.text_units", UNITS).alias("own"), _texts("text_unit_ids").alias("ids"))
    own = rows.filter("own is not null").select("cluster_id", F.posexplode("own").alias("pos", "u")).select("cluster_id", "pos", F.col("u.id").alias("unit_id"), F.coalesce("u.text", F.lit("")).alias("text"), F.coalesce("u.short_id", "u.id").alias("short_id"))
    named = rows.filter("own is null").select("cluster_id", F.posexplode("ids").alias("pos", "unit_id"))
    if units is None:
        if not named.isEmpty():
            raise ValueError("clusters name their text units, but no text units are given")
        return own
    return own.unionByName(fill_units(named, units))


def graph_tables(spark: SparkSession, root: str, **paths: str) -> dict[str, DataFrame | None]:
    """Six tables below a folder, or at their own paths. All missing ones of those required are named in one error; optional ones are None."""
    at = {n: paths.get(n, f"{root.rstrip('/')}/{n}.parquet") for n in (*GRAPH_REQUIRED, *GRAPH_OPTIONAL)}
    there = {n: exists(spark, p) for n, p in at.items()}
    if lost := [n for n in GRAPH_REQUIRED if not there[n]]:
        raise FileNotFoundError(f"missing graph tables: {', '.join(lost)}")
    return {n: spark.read.parquet(p) if there[n] else None for n, p in at.items()}


def frame(spark: SparkSession, path: str) -> DataFrame:
    """A table by its suffix: Parquet, CSV with a header, JSON records or JSON lines."""
    kind = os.path.splitext(path.rstrip("/"))[1].lower()
    if kind == ".parquet":
        return spark.read.parquet(path)
    if kind == ".csv":
        return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    if kind in (".json", ".jsonl"):
        return spark.read.option("multiLine", kind == ".json").json(path)
    raise ValueError(f"unsupported format: {kind or path}")


def source_files(spark: SparkSession, root: str) -> DataFrame:
    """(source_path, relative, kind, content) of the files of all known kinds below a folder; others are ignored."""
    _must_exist(spark, root)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toString().rstrip("/") + "/"
    plain = F.regexp_replace("path", "^file:/+", "file:/")
    relative = F.replace(plain, F.lit("file:/" + base.split("file:/", 1)[1].lstrip("/") if base.startswith("file:") else base), F.lit(""))
    return files.filter(suffix(F.col("path")).isin(*SOURCE_SUFFIXES)).select(F.col("path").alias("source_path"), relative.alias("relative"), F.substring(suffix(F.col("path")), 2, 10).alias("kind"), "content")


def json_documents(files: DataFrame) -> DataFrame:
    """Documents of JSON files: rows of a list or of {"documents": [...]}, the object itself, or the value as text."""
    v = F.try_parse_json(F.decode("content", "UTF-8"))
    base = files.filter("kind = 'json'").select("source_path", "relative", v.alias("v"))
    kind, inner = F.schema_of_variant("v"), F.try_variant_get("v", "$.documents", "array<variant>")
    listed = F.filter(F.coalesce(F.when(F.startswith(kind, F.lit("ARRAY")), F.try_variant_get("v", "$", "array<variant>")).when(F.startswith(kind, F.lit("OBJECT")), inner), F.array().cast("array<variant>")), lambda x: F.startswith(F.schema_of_variant(x), F.lit("OBJECT")))
    items = F.when(F.startswith(kind, F.lit("ARRAY")) | (F.size(listed) > 0), listed).otherwise(F.array("v"))
    rows = base.select("source_path", "relative", F.posexplode(items).alias("at", "item")).withColumn("n", F.col("at") + 1)
    plain = ~F.startswith(F.schema_of_variant("item"), F.lit("OBJECT"))
    ident = F.when(plain, stem(F.col("source_path"))).otherwise(F.coalesce(truthy(_text("id")), F.concat(F.lit("row-"), F.col("n").cast("string"))))
    text = F.coalesce(truthy(_text("text")), F.to_json("item"))
    return rows.select(ident.alias("id"), F.coalesce(truthy(_text("title")), stem(F.col("source_path"))).alias("title"), text.alias("text"), "source_path", canonical_path(F.col("relative"), F.concat(F.format_string("__%04d__", F.col("n")), safe_token(ident))).alias("canonical_path"), F.lit("json").alias("kind"))


class Ocr(Protocol):
    """Reads a page that has no text of its own."""

    name: str

    def page(self, content: bytes, number: int, pages: int) -> str: ...


class Describer(Protocol):
    """Says what a block shows that isn't text."""

    name: str

    def describe(self, content: bytes, block: dict, page: int, pages: int, page_text: str) -> str: ...


class PypdfPages(Sequence):
    """Texts of a PDF's pages, each read when it is asked for, where that library is installed."""

    def __init__(self, content: bytes):
        import io

        from pypdf import PdfReader  # type: ignore[import-not-found]

        self.pages = PdfReader(io.BytesIO(content)).pages

    def __len__(self) -> int:
        return len(self.pages)

    def __getitem__(self, at):
        return self.pages[at].extract_text() or ""


#: Opens a PDF. A page that can't be read raises when it is asked for, and the others can still be read; a list of texts will do.
PageReader = Callable[[bytes], Sequence[str]]
pypdf_pages: PageReader = PypdfPages

PAGES = "source_path string, relative string, page int, pages int, text string, source string, warning string"
_PAGES = pa.schema([("source_path", pa.string()), ("relative", pa.string()), ("page", pa.int32()), ("pages", pa.int32()), ("text", pa.string()), ("source", pa.string()), ("warning", pa.string())])
#: The source of the one row of a file that couldn't be opened, whose page is 0.
FAILED = "error"


def _told(error: Exception) -> str:
    return " ".join(f"{type(error).__name__}: {error}".split())


def _page(content: bytes, texts: Sequence[str], n: int, ocr: Ocr | None, least: int) -> tuple[str, str, str | None]:
    """(text, source, warning) of a page. Neither a reader nor OCR that fails stops the others."""
    warnings = []
    try:
        text = texts[n - 1].strip()
    except Exception as error:  # noqa: BLE001 - a reader may raise anything
        text = ""
        warnings.append(f"its text can't be read ({_told(error)})")
    source = "text"
    if len(text) < least:
        if ocr is None:
            warnings.append(f"{len(text)} characters of text and no OCR")
        else:
            try:
                read = ocr.page(content, n, len(texts)).strip()
                if read:
                    text, source = read, ocr.name
                else:
                    warnings.append(f"OCR by {ocr.name} found no text")
            except Exception as error:  # noqa: BLE001
                warnings.append(f"OCR by {ocr.name} failed ({_told(error)})")
    return text, source, f"page {n}: {'; '.join(warnings)}" if warnings else None


def _opened(content: bytes, reader: PageReader) -> tuple[Sequence[str], str | None]:
    try:
        texts = reader(content)
        return texts, None if len(texts) else "no pages"
    except Exception as error:  # noqa: BLE001
        return [], f"can't be opened ({_told(error)})"


def _files(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows one after the other, so that no more than one file is held as Python bytes."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield tuple(batch.column(k)[i].as_py() for k in range(batch.num_columns))


def _in_batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 64) -> Iterator[pa.RecordBatch]:
    while held := list(islice(rows, most)):
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), schema.types)], schema=schema)


def _short(batches: Iterator[pa.RecordBatch], reader: PageReader, ocr: Ocr | None, least: int, together: int) -> Iterator[pa.RecordBatch]:
    def rows():
        for path, relative, content in _files(batches):
            texts, failed = _opened(content, reader)
            if failed:
                yield path, relative, 0, 0, "", FAILED, failed
            elif len(texts) <= together:
                for n in range(1, len(texts) + 1):
                    yield path, relative, n, len(texts), *_page(content, texts, n, ocr, least)

    return _in_batches(rows(), _PAGES)


_RANGES = pa.schema([("source_path", pa.string()), ("relative", pa.string()), ("content", pa.binary()), ("first", pa.int32())])


def _ranges(batches: Iterator[pa.RecordBatch], reader: PageReader, together: int) -> Iterator[pa.RecordBatch]:
    def rows():
        for path, relative, content in _files(batches):
            n = len(_opened(content, reader)[0])
            if n > together:
                for first in range(1, n + 1, together):
                    yield path, relative, content, first

    return _in_batches(rows(), _RANGES, 1)


def _long(batches: Iterator[pa.RecordBatch], reader: PageReader, ocr: Ocr | None, least: int, together: int) -> Iterator[pa.RecordBatch]:
    def rows():
        for path, relative, content, first in _files(batches):
            texts, failed = _opened(content, reader)
            if failed:  # it was opened before, so this is a reader that isn't the same each time
                raise ValueError(f"{path}: {failed}")
            for n in range(first, min(first + together, len(texts) + 1)):
                yield path, relative, n, len(texts), *_page(content, texts, n, ocr, least)

    return _in_batches(rows(), _PAGES)


def pdf_pages(files: DataFrame, reader: PageReader = pypdf_pages, ocr: Ocr | None = None, least: int = 20, together: int = 200) -> DataFrame:
    """A row for each page of the PDF files: its own text, or what OCR reads where that is shorter than ``least``, and a warning where either fails.

    A file that can't be opened, or without pages, is one row with page 0, an empty text and FAILED as source. Files of up to ``together`` pages
    are read where they are; longer ones go as ranges of so many pages to tasks of their own, each with a copy of the file.
    """
    given = files.filter("kind = 'pdf'").select("source_path", "relative", "content")
    short = given.mapInArrow(partial(_short, reader=reader, ocr=ocr, least=least, together=together), PAGES)
    ranges = given.mapInArrow(partial(_ranges, reader=reader, together=together), "source_path string, relative string, content binary, first int")
    return short.unionByName(ranges.repartition("source_path", "first").mapInArrow(partial(_long, reader=reader, ocr=ocr, least=least, together=together), PAGES))


#: Parses a PDF into the number of its pages and its blocks: dicts with kind, text, page_index, bbox.
LayoutReader = Callable[[bytes], tuple[int, Sequence[dict]]]
BLOCKS = "source_path string, relative string, pages int, page_index int, kind string, text string, bbox array<double>, description string, source string, warning string, strategy string"
_BLOCKS = pa.schema([("source_path", pa.string()), ("relative", pa.string()), ("pages", pa.int32()), ("page_index", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("bbox", pa.list_(pa.float64())), ("description", pa.string()), ("source", pa.string()), ("warning", pa.string()), ("strategy", pa.string())])
#: Kinds of layout blocks whose text is what they say; the others are pictures of something. Fixed values.
TEXT_KINDS = ("text", "title", "heading", "paragraph", "list", "caption")


def _by_layout(content: bytes, layout: LayoutReader, describer: Describer | None) -> list[tuple]:
    pages, blocks = layout(content)
    said: dict[int, list[str]] = {}
    for b in blocks:
        if b.get("text"):
            said.setdefault(int(b.get("page_index") or 0), []).append(str(b["text"]))
    out = []
    for b in blocks:
        kind, at, description, warning = str(b.get("kind") or "text"), int(b.get("page_index") or 0), None, None
        if describer is not None and kind.lower() not in TEXT_KINDS:
            try:
                description = describer.describe(content, dict(b), at + 1, pages, "\n".join(said.get(at, [])))
            except Exception as error:  # noqa: BLE001
                warning = f"page {at + 1}: description by {describer.name} failed ({_told(error)})"
        box = b.get("bbox")
        out.append((pages, at, kind, str(b.get("text") or ""), [float(x) for x in box] if box else None, description, "text", warning, "layout"))
    if not out:
        raise ValueError("no blocks")
    return out


def _blocks(batches: Iterator[pa.RecordBatch], layout: LayoutReader, describer: Describer | None, reader: PageReader, ocr: Ocr | None, least: int) -> Iterator[pa.RecordBatch]:
    def rows():
        for path, relative, content in _files(batches):
            try:
                found = _by_layout(content, layout, describer)
            except Exception as error:  # noqa: BLE001
                texts, failed = _opened(content, reader)
                yield path, relative, len(texts), -1, "text", "", None, None, FAILED, f"no layout ({_told(error)})" + (f"; {failed}" if failed else ""), "layout->pages"
                for n in range(1, len(texts) + 1):
                    text, source, warning = _page(content, texts, n, ocr, least)
                    yield path, relative, len(texts), n - 1, "text", text, None, None, source, warning, "layout->pages"
                continue
            for block in found:
                yield path, relative, *block

    return _in_batches(rows(), _BLOCKS)


def pdf_blocks(files: DataFrame, layout: LayoutReader, describer: Describer | None = None, reader: PageReader = pypdf_pages, ocr: Ocr | None = None, least: int = 20) -> DataFrame:
    """Blocks of the PDF files by a layout parser. A file that it fails on, or finds nothing in, is read page by page in the same task; a first row
    with page_index -1 and FAILED as source says why. A describer that fails leaves a warning. Files are parsed once."""
    work = partial(_blocks, layout=layout, describer=describer, reader=reader, ocr=ocr, least=least)
    return files.filter("kind = 'pdf'").select("source_path", "relative", "content").mapInArrow(work, BLOCKS)


def layout_blocks(spark: SparkSession, path: str) -> DataFrame:
    """(pos, kind, text, page_index, bbox) of a layout tool's content list."""
    from assayer.functions.values import bbox

    items = json_items(spark, path, ("content_list",))
    page = F.coalesce(F.try_variant_get("item", "$.page_idx", "int"), F.try_variant_get("item", "$.page_index", "int"), F.lit(0))
    return items.select("pos", truthy(_text("type"), _text("kind"), default="text").alias("kind"), F.coalesce(_text("text"), F.lit("")).alias("text"), page.alias("page_index"), bbox(F.try_variant_get("item", "$.bbox", "array<string>")).alias("bbox"))


STEP = "step string, exit_code int, log string"


def parse_steps(lines: DataFrame, *keep: str) -> DataFrame:
    """(step, exit_code, log) and the columns to keep, of JSON lines; a line that is none counts as a failed step of that name. Blank lines go."""
    v = F.try_parse_json("value")
    good = F.startswith(F.schema_of_variant(v), F.lit("OBJECT"))
    text = lambda k: F.try_variant_get(v, f"$.{k}", "string")
    return lines.filter(F.trim("value") != "").select(
        *keep, F.when(good, F.coalesce(text("step"), F.lit(""))).otherwise(F.col("value")).alias("step"), F.when(good, F.try_variant_get(v, "$.exit_code", "int")).otherwise(F.lit(1)).alias("exit_code"), F.when(good, F.coalesce(text("log"), F.lit(""))).otherwise(F.lit("")).alias("log")
    )


def steps(spark: SparkSession, path: str) -> DataFrame:
    return parse_steps(spark.read.text(path))


def junit(spark: SparkSession, path: str) -> DataFrame:
    """(name, classname, status) of the test cases of a JUnit report."""
    schema = "_name string, _classname string, failure string, error string, skipped string"
    rows = spark.read.format("xml").option("rowTag", "testcase").option("nullValue", "\x00").schema(schema).load(path)
    return rows.select(F.col("_name").alias("name"), F.col("_classname").alias("classname"), F.when(F.col("failure").isNotNull() | F.col("error").isNotNull(), "failed").when(F.col("skipped").isNotNull(), "skipped").otherwise("passed").alias("status"))


@dataclass(frozen=True)
class Ontology:
    allowed_types: tuple[str, ...]
    rules: dict


def ontology(path: str) -> Ontology | None:
    """A small configuration file that the driver reads; None where it is missing."""
    import json

    if not os.path.exists(path):
        return None
    with open(path, encoding="utf-8") as f:
        raw = json.load(f)
    rules = raw.get("extraction_rules") or {}
    kinds = tuple(t for t in (str(x).strip() for x in raw.get("allowed_types") or []) if t)
    return Ontology(kinds, rules if isinstance(rules, dict) else {"raw": rules})


def generated_records(spark: SparkSession, data: object) -> DataFrame:
    """Rows of what a generator returns: a DataFrame, one with to_pandas, a list of dicts, or anything's text."""
    if isinstance(data, DataFrame):
        return data
    if hasattr(data, "to_pandas"):
        return spark.createDataFrame(data.to_pandas())
    if isinstance(data, list) and data and all(isinstance(x, dict) for x in data):
        return spark.createDataFrame(data)
    return spark.createDataFrame([(str(data),)], "value string")
