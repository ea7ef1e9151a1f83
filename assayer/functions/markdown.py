"""Markdown: counting, rewriting and passages of tokens as column expressions; chunks by separators in Arrow batches."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator, Sequence
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from assayer.functions.text import is_fence, is_heading, is_table_row, normalise_heading, normalise_newlines, rstrip, split_lines, strip, using

#: Where a text is cut first, and where if pieces stay too long. Fixed values.
MARKDOWN_SEPARATORS = (r"\n#{1,6} ", r"```\n", r"\n\*\*\*+\n", r"\n---+\n", r"\n___+\n", r"\n\n", r"\n", r" ", "")


def counters(text: Column) -> Column:
    """A struct (headings, table_rows) of a text without frontmatter: one pass over its lines, which only carries the open fence and counts."""
    lines = F.transform(split_lines(normalise_newlines(text)), strip)
    start = F.struct(F.lit("").alias("fence"), F.lit(0).alias("headings"), F.lit(0).alias("table_rows"))

    def step(a: Column, line: Column) -> Column:
        fence, code = is_fence(line), a["fence"] != ""
        closes = fence & code & F.startswith(line, a["fence"])
        after = F.when(closes, F.lit("")).when(fence & ~code, F.left(line, F.lit(3))).otherwise(a["fence"])
        plain = ~fence & ~code
        heading = plain & is_heading(line)
        table = plain & ~is_heading(line) & is_table_row(line)
        return F.struct(after.alias("fence"), (a["headings"] + heading.cast("int")).alias("headings"), (a["table_rows"] + table.cast("int")).alias("table_rows"))

    return F.aggregate(lines, start, step, lambda a: F.struct(a["headings"].alias("headings"), a["table_rows"].alias("table_rows")))


#: A code block from its opening line to a line that begins with the same three marks, or to the end; every line ends with a line feed.
_CODE = r"(?Umd)^[\s&&[^\n]]*+(```|~~~)[^\n]*+\n(?s:.*?)(?:^[\s&&[^\n]]*+\1[^\n]*+\n|\z)"


def _ended(lines: Column) -> Column:
    """One text of all lines, each with its line feed."""
    return F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), "")


def _lines(ended: Column) -> Column:
    parts = F.split(ended, "\n")
    return F.slice(parts, 1, F.size(parts) - 1)


def _pairs(lines: Column) -> Column:
    """Keys and values of lines with a colon; a key that comes again has its last value. Comments and quotes around values go."""
    used = F.filter(F.transform(lines, strip), lambda x: ~F.startswith(x, F.lit("#")) & F.contains(x, F.lit(":")))
    colon = lambda x: F.instr(x, ":")
    value = lambda x: F.btrim(F.btrim(strip(F.substr(x, colon(x) + 1)), F.lit('"')), F.lit("'"))
    places = F.transform(used, lambda x, i: F.struct(strip(F.left(x, colon(x) - 1)).alias("key"), (-i).alias("place"), value(x).alias("value")))
    last = using(F.array_sort(places), lambda s: F.filter(s, lambda x, i: (i == 0) | (F.get(s, i - 1)["key"] != x["key"])))
    return F.map_from_entries(F.transform(last, lambda x: F.struct(x["key"], x["value"])))


def _parted(lines: Column) -> Column:
    """The lines of frontmatter, and the text below."""
    bare = F.transform(lines, strip)
    end = F.array_position(F.slice(bare, 2, F.greatest(F.size(bare) - 1, F.lit(0))), "---").cast("int")
    none = F.array().cast("array<string>")
    return using(
        F.when(F.get(bare, F.lit(0)) == "---", end).otherwise(0),
        lambda n: F.struct(F.when(n > 0, F.slice(lines, 2, n - 1)).otherwise(none).alias("meta"), _ended(F.when(n > 0, F.slice(lines, n + 2, F.size(lines))).otherwise(lines)).alias("body")),
    )


def _segments(d: Column) -> Column:
    """Frontmatter as a map, and the lines before, between and after code blocks, and those of the blocks."""
    fenced = F.contains(d["body"], F.lit("```")) | F.contains(d["body"], F.lit("~~~"))  # most texts have no code
    blocks = F.when(fenced, F.regexp_extract_all(d["body"], F.lit(_CODE), F.lit(0))).otherwise(F.array().cast("array<string>"))
    code = F.transform(blocks, lambda x: F.transform(_lines(x), lambda y: F.when(is_fence(strip(y)), strip(y)).otherwise(rstrip(y))))
    rest = F.when(fenced, F.split(d["body"], _CODE)).otherwise(F.array(d["body"]))
    return F.struct(_pairs(d["meta"]).alias("meta"), F.transform(rest, lambda x: F.transform(_lines(x), strip)).alias("plain"), code.alias("code"))


def _told(d: Column) -> Column:
    shown = F.transform(d["plain"], lambda part: F.regexp_replace(_ended(F.transform(part, lambda x: F.when(is_heading(x), normalise_heading(x)).otherwise(x))), r"(\A|\n)\n+", "$1\n"))
    whole = F.array_join(F.zip_with(shown, F.transform(d["code"], _ended), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    lines = F.flatten(d["plain"])
    heads = F.filter(lines, is_heading)
    name = F.get(F.filter(F.transform(heads, lambda x: strip(F.regexp_replace(x, "^#+", ""))), lambda x: x != ""), F.lit(0))
    return F.struct(
        using(strip(whole), lambda b: F.when(b == "", "").otherwise(F.concat(b, F.lit("\n")))).alias("text"),
        F.coalesce(name, F.nullif(strip(F.try_element_at(d["meta"], F.lit("title"))), F.lit(""))).alias("title"),
        d["meta"].alias("frontmatter"),
        F.size(heads).alias("headings"),
        F.size(F.filter(lines, lambda x: ~is_heading(x) & is_table_row(x))).alias("table_rows"),
    )


def rewritten(text: Column | str) -> Column:
    """A struct (text, title, frontmatter, headings, table_rows) of Markdown in a stable form.

    Keys and values between two --- lines at the top are frontmatter; without a second such line there is none. Outside code, lines lose the
    white space at their ends, blank lines in a row become one, and headings have one to six marks and a blank. Lines of code only lose the
    blanks at their ends; a code block that nothing closes goes on to the end. The title is that of the first heading that has one, else
    frontmatter's, else null. Null counts as empty. One regular expression cuts the text at its code blocks and all else goes line by line,
    so time is linear in the text.
    """
    own = F.col(text) if isinstance(text, str) else text
    lines = split_lines(normalise_newlines(F.coalesce(own, F.lit(""))))
    return using(using(using(lines, _parted), _segments), _told)


def _places(text: str, separator: str, start: int, end: int) -> Sequence[int]:
    """Where the pieces of a stretch begin, and its end. The empty separator is at every character."""
    if not separator:
        return range(start, end + 1)
    return [start, *(m.start() for m in re.compile(separator).finditer(text, start, end) if m.start() > start), end]


def _runs(text: str, separators: tuple[str, ...], size: int, start: int, end: int) -> Iterator[Sequence[int]]:
    """The places at which a stretch may be cut, in runs of pieces shorter than ``size``.

    Longer pieces are runs of their own, cut at the separators that follow; what none of them cuts stays whole.
    """
    if end - start < size or not separators:
        yield (start, end)
        return
    at, open_ = _places(text, separators[0], start, end), 0
    for k in range(len(at) - 1):
        if at[k + 1] - at[k] >= size:
            if k > open_:
                yield at[open_ : k + 1]
            yield from _runs(text, separators[1:], size, at[k], at[k + 1])
            open_ = k + 1
    if len(at) - 1 > open_:
        yield at[open_:]


def _spans(at: Sequence[int], size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """The widest spans between places of a run that hold at most ``size`` characters. The next span begins at the first place that shares at
    most ``overlap`` characters with the one before and still has room for the piece behind it."""
    first, end = 0, len(at) - 1
    while True:
        last = max(first + 1, bisect_right(at, at[first] + size) - 1)
        yield at[first], at[last]
        if last == end:
            return
        first = min(last, bisect_left(at, max(at[last] - overlap, at[last + 1] - size)))


def chunks(text: str, size: int = 1000, overlap: int = 200, separators: tuple[str, ...] = MARKDOWN_SEPARATORS) -> list[str]:
    """Stripped chunks of at most ``size`` characters, cut at the coarsest separators that do."""
    if overlap >= size:
        raise ValueError("the overlap must be smaller than the size")
    spans = (span for run in _runs(text, separators, size, 0, len(text)) for span in _spans(run, size, overlap))
    return [c for c in (text[a:b].strip() for a, b in spans) if c]


#: Bytes of chunks, about, in one batch.
CHUNK_BYTES = 4 << 20


def _chunk_rows(batches: Iterator[pa.RecordBatch], size: int, overlap: int) -> Iterator[pa.RecordBatch]:
    """A row for each chunk of the last column, text by text, in batches of their own: a task holds one batch of texts and CHUNK_BYTES of chunks."""
    names = None
    for batch in batches:
        names, texts = [*batch.schema.names[:-1], "at", "chunk"], batch.column(batch.num_columns - 1)
        rows, places, found, held = [], [], [], 0
        for i in range(batch.num_rows):
            for at, chunk in enumerate(chunks(texts[i].as_py() or "", size, overlap)):
                rows.append(i)
                places.append(at)
                found.append(chunk)
                held += 4 * len(chunk) + 64
            if held >= CHUNK_BYTES or found and i + 1 == batch.num_rows:
                others = batch.select(names[:-2]).take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([*others.columns, pa.array(places, pa.int32()), pa.array(found, pa.string())], names)
                rows, places, found, held = [], [], [], 0


def chunk_rows(df: DataFrame, text: str = "text", size: int = 1000, overlap: int = 200) -> DataFrame:
    """The other columns of df, and (at, chunk) for each chunk of a text, from 0; none of a text without any, or of null."""
    if overlap >= size:
        raise ValueError("the overlap must be smaller than the size")
    others = [f for f in df.schema.fields if f.name != text]
    schema = StructType([*others, StructField("at", IntegerType()), StructField("chunk", StringType())])
    return df.select(*(f"`{f.name}`" for f in others), text).mapInArrow(partial(_chunk_rows, size=size, overlap=overlap), schema)


#: A word or a mark, with the white space behind it.
_TOKEN = r"(?U)(?:[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s])\s*"


def token_chunks(text: Column | str, size: int = 600, overlap: int = 100) -> Column:
    """Passages of at most ``size`` words and marks, each beginning with the last ``overlap`` of the one before; none of a text without any, or of null."""
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be smaller than the size")
    own, step = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), size - overlap

    def passages(tokens: Column) -> Column:
        more = F.ceil((F.size(tokens) - size) / F.lit(step))  # passages after the first
        starts = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), more).cast("int")), lambda k: k * step + 1)
        return F.when(F.size(tokens) > 0, F.transform(starts, lambda a: rstrip(F.array_join(F.slice(tokens, a, size), "")))).otherwise(F.array().cast("array<string>"))

    return using(F.regexp_extract_all(own, F.lit(_TOKEN), F.lit(0)), passages)
