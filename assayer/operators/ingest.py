"""From a tree of mixed files to canonical documents and a manifest."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.functions.markdown import chunks, rewritten
from assayer.functions.text import block_description, canonical_path, file_name, page_text, stem, strip
from assayer.functions.values import truthy
from assayer.sources.tables import FAILED, TEXT_KINDS, Describer, LayoutReader, Ocr, PageReader, json_documents, pdf_blocks, pdf_pages, pypdf_pages, source_files

DOCUMENT = ("id", "title", "text", "source_path", "canonical_path", "kind")


def plain_documents(files: DataFrame) -> DataFrame:
    """Text and CSV files as they are."""
    path = F.col("source_path")
    return files.filter(F.col("kind").isin("txt", "csv")).select(file_name(path).alias("id"), stem(path).alias("title"), F.decode("content", "UTF-8").alias("text"), "source_path", canonical_path(F.col("relative")).alias("canonical_path"), "kind")


def _chunked(batches: Iterator[pa.RecordBatch], size: int, overlap: int) -> Iterator[pa.RecordBatch]:
    """A row for each chunk of (source_path, relative, title, text); a text without chunks has an empty one."""
    for batch in batches:
        for path, relative, title, text in zip(*(batch.column(k).to_pylist() for k in range(4))):
            cut = chunks(text, size, overlap) or [""]
            n = len(cut)
            yield pa.RecordBatch.from_arrays([pa.array([path] * n, pa.string()), pa.array([relative] * n, pa.string()), pa.array([title] * n, pa.string()), pa.array(range(1, n + 1), pa.int32()), pa.array([n] * n, pa.int32()), pa.array(cut, pa.string())], ["source_path", "relative", "title", "at", "many", "text"])


def markdown_documents(files: DataFrame, size: int = 1000, overlap: int = 200) -> DataFrame:
    """Markdown, rewritten once and cut into chunks: one chunk keeps the file's name, several get numbers."""
    path = F.col("source_path")
    told = files.filter("kind = 'md'").select("source_path", "relative", rewritten(F.decode("content", "UTF-8")).alias("m"))
    cut = told.select("source_path", "relative", F.coalesce("m.title", stem(path)).alias("title"), "m.text").mapInArrow(partial(_chunked, size=size, overlap=overlap), "source_path string, relative string, title string, at int, many int, text string")
    number = F.when(F.col("many") > 1, F.format_string("__chunk_%04d", F.col("at"))).otherwise("")
    return cut.select(F.concat(file_name(path), number).alias("id"), "title", "text", "source_path", canonical_path(F.col("relative"), number).alias("canonical_path"), F.lit("markdown").alias("kind"))


def join_pages(pages: DataFrame, markers: bool = True) -> DataFrame:
    """(source_path, relative, text, page_count, text_pages, ocr_pages, warnings, and strategy if pages have it): pages in order, a blank line
    apart, below their numbers. A row whose source is FAILED is no page, but its warning stays."""
    failed = F.col("source") == FAILED
    shown = F.when(failed, "").otherwise(page_text(F.col("page"), F.col("text")) if markers else F.col("text"))
    kept = [c for c in ("strategy",) if c in pages.columns]
    by = F.array_sort(F.collect_list(F.struct("page", "shown", "warning")))
    text = lambda d: strip(F.array_join(F.filter(F.transform(d, lambda x: x["shown"]), lambda x: x != ""), "\n\n"))
    has = (F.col("text") != "") & ~failed
    counts = F.count_if(~failed).alias("page_count"), F.count_if(has & (F.col("source") == "text")).alias("text_pages"), F.count_if(has & (F.col("source") != "text")).alias("ocr_pages")
    out = pages.withColumn("shown", shown).groupBy("source_path", "relative", *kept).agg(by.alias("d"), *counts)
    return out.select("source_path", "relative", text(F.col("d")).alias("text"), "page_count", "text_pages", "ocr_pages", F.filter(F.transform("d", lambda x: x["warning"]), lambda x: x.isNotNull()).alias("warnings"), *kept)


def render_block(kind: Column, page: Column, box: Column, text: Column, description: Column | None = None) -> Column:
    """Text of a block that is text; of another, a description, or its text, or what stands for it."""
    own = F.nullif(strip(F.coalesce(text, F.lit(""))), F.lit(""))
    drawn = F.coalesce(*([F.nullif(strip(description), F.lit(""))] if description is not None else []), own, block_description(kind, page, box, text))
    return F.when(F.lower(kind).isin(*TEXT_KINDS), F.coalesce(own, F.lit(""))).otherwise(drawn)


def block_pages(blocks: DataFrame) -> DataFrame:
    """(source_path, relative, page, pages, text, source, warning) of layout blocks (source_path, relative, page_index, kind, text, bbox), from top to bottom and left to right.

    Blocks may have a description, and source, warning, pages and strategy, which stay.
    """
    told = F.col("description") if "description" in blocks.columns else None
    place = F.struct(F.coalesce(F.get("bbox", F.lit(1)), F.lit(float("inf"))).alias("y"), F.coalesce(F.get("bbox", F.lit(0)), F.lit(float("inf"))).alias("x"), "kind", render_block(F.col("kind"), F.col("page_index") + 1, F.col("bbox"), F.col("text"), told).alias("shown"))
    joined = F.array_join(F.filter(F.transform(F.array_sort(F.collect_list(place)), lambda x: x["shown"]), lambda x: x != ""), "\n")
    page = (F.col("page_index") + 1).alias("page")
    has = lambda c: c in blocks.columns
    kept = [c for c in ("strategy",) if has(c)]
    pages = F.max("pages") if has("pages") else F.lit(None).cast("int")
    source = F.max("source") if has("source") else F.lit("text")
    warning = F.nullif(F.array_join(F.array_sort(F.collect_list("warning")), "; "), F.lit("")) if has("warning") else F.lit(None).cast("string")
    return blocks.groupBy("source_path", "relative", *kept, page).agg(joined.alias("text"), pages.alias("pages"), source.alias("source"), warning.alias("warning")).select("source_path", "relative", "page", "pages", "text", "source", "warning", *kept)


def hybrid(layout: DataFrame, plain: DataFrame) -> DataFrame:
    """Documents by layout where there is one, else by their pages, with the strategy that was used. Both: as join_pages."""
    a = layout.withColumn("strategy", F.lit("layout"))
    b = plain.join(layout.select("source_path"), "source_path", "left_anti").withColumn("strategy", F.lit("layout->pages")).withColumn("warnings", F.concat("warnings", F.array(F.lit("no layout was found"))))
    return a.unionByName(b)


def pdf_documents(joined: DataFrame) -> DataFrame:
    """Documents of files that have pages."""
    path = F.col("source_path")
    return joined.filter("page_count > 0").select(file_name(path).alias("id"), stem(path).alias("title"), "text", "source_path", canonical_path(F.col("relative")).alias("canonical_path"), F.lit("pdf").alias("kind"))


def normalise_tree(
    spark: SparkSession, root: str, size: int = 1000, overlap: int = 200, reader: PageReader = pypdf_pages, ocr: Ocr | None = None, layout: LayoutReader | None = None, describer: Describer | None = None
) -> tuple[DataFrame, DataFrame]:
    """Documents and manifest of all files below a folder. Documents are keyed by source path, as canonical ones may meet.

    With ``layout`` PDFs are rendered by it, and those that it fails on by their pages. What fails is told in the manifest: a PDF without a
    page that can be read is no document, and its entry has the strategy "failed".
    """
    files = source_files(spark, root)
    pages = join_pages(pdf_pages(files, reader, ocr) if layout is None else block_pages(pdf_blocks(files, layout, describer, reader, ocr)))
    pages = pages if "strategy" in pages.columns else pages.withColumn("strategy", F.lit("pages"))
    docs = plain_documents(files).unionByName(markdown_documents(files, size, overlap)).unionByName(json_documents(files)).unionByName(pdf_documents(pages))
    others = docs.filter("kind <> 'pdf'")
    strategy = F.when(F.col("kind") == "json", "json-row").when(F.col("kind") == "markdown", "markdown").otherwise("direct")
    zero, none = F.lit(0).cast("long"), F.array().cast("array<string>")
    entry = ["source_path", "canonical_path", "kind"]
    plain = others.select(*entry, strategy.alias("strategy"), *(zero.alias(c) for c in ("page_count", "text_pages", "ocr_pages")), F.length("text").alias("text_chars"), none.alias("warnings"))
    paged = pages.withColumn("canonical_path", canonical_path(F.col("relative"))).withColumn("kind", F.lit("pdf"))
    shown = F.when(F.col("page_count") > 0, F.col("strategy")).otherwise("failed")
    return docs, plain.unionByName(paged.select(*entry, shown.alias("strategy"), "page_count", "text_pages", "ocr_pages", F.length("text").alias("text_chars"), "warnings"))


def collisions(docs: DataFrame, name: str = "canonical_path") -> DataFrame:
    """Names that several documents have."""
    return docs.groupBy(name).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def staged_corpus(docs: DataFrame, words: int = 180) -> DataFrame:
    """One text of a few documents (id, text), repeated until it has so many words."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "text"))), lambda x: x["text"]), "\n\n")
    one = docs.agg(text.alias("text")).withColumn("n", F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")))
    again = F.greatest(F.lit(1), F.ceil(F.lit(words) / F.greatest(F.col("n"), F.lit(1)))).cast("int")
    return one.select(F.array_join(F.array_repeat(F.col("text"), again), "\n\n").alias("text"))


def truthy_title(title: Column, path: Column) -> Column:
    return F.coalesce(truthy(title), stem(path))
