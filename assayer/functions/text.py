"""Text expressions. All take and return columns; none needs Python on the executors.

White space is Unicode white space (``(?U)\\s``), as texts come from many sources; Spark's own trim only knows the blank.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Invisible characters that only disturb matching. Fixed values.
ZERO_WIDTH = "\ufeff\u200b\u200c\u200d\u2060"
#: What (?U)\s matches. Fixed values.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: What ends a line in text that wasn't written on one system only. Fixed values.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def using(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(WHITE_SPACE))


def squeeze(text: Column) -> Column:
    """Runs of white space become one blank; none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))  # what is left at the ends are blanks


def text_key(text: Column) -> Column:
    """What two texts must share to count as the same: letters in lower case and single blanks."""
    return F.lower(squeeze(text))


def first_sentence(text: Column) -> Column:
    """Up to the first terminator that white space follows, without it; a lone sentence keeps its own."""
    return strip(F.split(strip(text), r"(?U)[.!?]\s+", 2)[0])


def summary(text: Column, sentences: int) -> Column:
    """The first sentences, with their terminators, one blank apart."""
    parts = F.slice(F.split(strip(text), r"(?U)(?<=[.!?])\s+", sentences + 1), 1, sentences)
    return strip(F.array_join(F.filter(parts, lambda x: x != ""), " "))


def themes(text: Column, most: int = 5) -> Column:
    """The first clauses between full stops and semicolons."""
    parts = F.transform(F.split(text, r"(?U)[.;]\s*"), strip)
    return F.slice(F.filter(parts, lambda x: x != ""), 1, most)


def split_description(text: Column, most: int) -> Column:
    """Pieces of at most ``most`` characters: the text if it is short, else its sentences, cut where they are longer."""
    whole = squeeze(text)
    sentences = F.filter(F.transform(F.split(whole, "[.]"), strip), lambda x: x != "")
    ended = F.when(F.size(sentences) > 0, F.transform(sentences, lambda s: F.concat(s, F.lit(".")))).otherwise(F.array(whole))

    def cut(s: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1)), F.lit(most))
        return F.when(F.length(s) <= most, F.array(s)).otherwise(F.transform(starts, lambda i: strip(F.substring(s, i, F.lit(most)))))

    pieces = F.filter(F.flatten(F.transform(ended, cut)), lambda x: x != "")
    return F.when(F.length(whole) <= most, F.array(whole)).otherwise(pieces)


def truncate(text: Column, most: int) -> Column:
    """At most so many characters, the last an ellipsis if any are missing."""
    return F.when(F.length(text) <= most, text).otherwise(F.concat(rstrip(F.left(text, F.lit(most - 1))), F.lit("…")))


def escape_html(text: Column) -> Column:
    for plain, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    return text


def format_number(value: Column) -> Column:
    """A whole number without decimals; else up to six, without zeros at the end."""
    fixed = F.regexp_replace(F.format_string("%.6f", value), r"\.?0+$", "")
    return F.when(F.abs(value - F.round(value)) < 1e-9, F.format_string("%.0f", value)).otherwise(fixed)


def strip_code_fence(text: Column) -> Column:
    """Without a Markdown fence around the text, whether or not it says json."""
    inner = F.regexp_replace(F.regexp_replace(strip(text), r"(?iU)^```(?:json)?\s*", ""), r"(?U)\s*```$", "")
    return strip(F.when(F.startswith(strip(text), F.lit("```")), inner).otherwise(text))


def safe_token(text: Column) -> Column:
    """For file names: runs of anything but letters, digits, dot, underscore and hyphen become one underscore."""
    return F.coalesce(F.nullif(F.regexp_replace(text, "[^A-Za-z0-9._-]+", "_"), F.lit("")), F.lit("item"))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def suffix(path: Column) -> Column:
    """In lower case, with the dot; empty if there is none."""
    return F.lower(F.regexp_extract(file_name(path), r".(\.[^.]*)$", 1))


def canonical_path(relative: Column, addition: Column | None = None) -> Column:
    """The path with its suffix replaced by .txt, and with an addition before it."""
    folder = F.regexp_extract(relative, r"^(.*/)?[^/]*$", 1)
    return F.concat(folder, stem(relative), addition if addition is not None else F.lit(""), F.lit(".txt"))


def flat_path(relative: Column) -> Column:
    """One name for a path: its parts joined by two underscores."""
    return F.array_join(F.filter(F.split(relative, "/"), lambda x: x != ""), "__")


def path_order(path: Column) -> Column:
    """Sorts paths part by part."""
    return F.split(path, "/")


def normalise_newlines(text: Column) -> Column:
    """Line feeds only, and no invisible characters."""
    return F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), f"[{ZERO_WIDTH}]", "")


def split_lines(text: Column) -> Column:
    """Lines without their ends; a line end at the end of the text begins no line, and an empty text has no lines."""
    cut = using(F.split(text, LINE_END), lambda parts: F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts))
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(cut)


def is_fence(line: Column) -> Column:
    """A line without white space at its ends opens or closes a code block."""
    return F.startswith(line, F.lit("```")) | F.startswith(line, F.lit("~~~"))


def is_heading(line: Column) -> Column:
    return F.startswith(line, F.lit("#"))


def is_table_row(line: Column) -> Column:
    return F.rlike(line, F.lit(r"(?s)^\|.*\|.*\|$"))


def normalise_heading(line: Column) -> Column:
    """One to six number signs, a blank and the title."""
    marks = F.length(F.regexp_extract(line, "^(#*)", 1))
    return rstrip(F.concat(F.repeat(F.lit("#"), F.least(F.lit(6), F.greatest(F.lit(1), marks))), F.lit(" "), strip(F.regexp_replace(line, "^#+", ""))))


def page_text(page: Column, text: Column) -> Column:
    """A page's text below its number."""
    return strip(F.concat(F.lit("[page: "), page.cast("string"), F.lit("]\n"), F.coalesce(text, F.lit(""))))


def block_description(kind: Column, page: Column, bbox: Column, text: Column) -> Column:
    """What stands for a block of a page that nothing could describe."""
    return F.concat(
        F.lit("[block: "),
        F.concat_ws(
            "; ",
            F.concat(kind, F.lit(" on page "), page.cast("string")),
            F.when(bbox.isNotNull(), F.concat(F.lit("bbox="), F.array_join(F.transform(bbox, format_number), ","))),
            F.when(F.coalesce(strip(text), F.lit("")) != "", F.concat(F.lit("text="), strip(text))),
        ),
        F.lit("]"),
    )


def render_contexts(contexts: Column) -> Column:
    """Numbered contexts with their sources, a blank line apart. contexts: array of structs with text and source."""

    def one(c: Column, i: Column) -> Column:
        source = F.when(F.coalesce(c["source"], F.lit("")) != "", F.concat(F.lit(" "), c["source"])).otherwise("")
        return F.concat(F.lit("["), (i + 1).cast("string"), F.lit("]"), source, F.lit("\n"), F.coalesce(c["text"], F.lit("")))

    return F.when(F.coalesce(F.size(contexts), F.lit(0)) > 0, F.array_join(F.transform(contexts, one), "\n\n")).otherwise("(no retrieved contexts)")


def normalise_mode(mode: Column) -> Column:
    """In lower case with hyphens; null for default and all."""
    plain = F.replace(F.lower(strip(mode)), F.lit("_"), F.lit("-"))
    return F.when(~plain.isin("default", "all", ""), plain)
