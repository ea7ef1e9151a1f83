"""From a judge's free text to a verdict of 0 or 1 and a reason."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from assayer.functions.text import strip_code_fence
from assayer.functions.values import binary_text

#: Keys that hold a verdict, the first that is there counts. Fixed values.
VERDICT_KEYS = ("correctness", "evaluation", "score", "value")


def _object(text: Column) -> Column:
    """The text as a JSON object, or null."""
    parsed = F.try_parse_json(text)
    return F.when(F.startswith(F.schema_of_variant(parsed), F.lit("OBJECT")), parsed)


def verdict(raw: Column) -> Column:
    """A struct (value double, reason string).

    The text, without a code fence, is a JSON object, or holds one between its first and last brace; of its verdict keys, the first that
    is there counts, even if it is null. Otherwise the first 0 or 1 that stands alone counts, then a yes without a no. Else it is 0.
    """
    text = strip_code_fence(F.coalesce(raw, F.lit("")))
    found = F.coalesce(_object(text), F.when(F.try_parse_json(text).isNull(), _object(F.regexp_extract(text, r"(?s)(\{.*\})", 1))))
    values = [F.try_variant_get(found, f"$.{k}", "variant") for k in VERDICT_KEYS]
    value, has = F.lit(None).cast("string"), F.lit(False)
    for v in reversed(values):
        value = F.when(v.isNotNull(), F.when(F.is_variant_null(v), F.lit("null")).otherwise(v.try_cast("string"))).otherwise(value)
    for v in values:
        has = has | v.isNotNull()
    reasons = [F.nullif(F.try_variant_get(found, f"$.{k}", "string"), F.lit("")) for k in ("reason", "explanation")]
    digit, low = F.regexp_extract(text, r"\b([01])\b", 1), F.lower(text)
    yes, no = F.contains(low, F.lit("yes")), F.contains(low, F.lit("no"))
    bare = F.when(digit != "", digit.try_cast("double")).when(yes & ~no, 1.0).otherwise(0.0)
    return F.when(has, F.struct(binary_text(value).alias("value"), F.coalesce(*reasons, text).alias("reason"))).otherwise(F.struct(bare.alias("value"), text.alias("reason")))


def rated(raw: Column, low: int, high: int, keys: tuple[str, ...] = ("score", "relevance")) -> Column:
    """A struct (score int, reasoning string): the score of a JSON object, in a fence or in prose or not, rounded down and cut to the range; else the first whole
    number of the range that stands alone; else the lowest score."""
    text = strip_code_fence(F.coalesce(raw, F.lit("")))
    found = F.try_parse_json(F.coalesce(F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit("")), text))
    named = F.coalesce(*(F.try_variant_get(found, f"$.{k}", "string") for k in keys)).try_cast("double")
    numbers = F.transform(F.regexp_extract_all(text, F.lit(r"(?<![\d.])(\d{1,4})(?!\d|\.\d)"), 1), lambda n: n.try_cast("double"))
    bare = F.get(F.filter(numbers, lambda n: (n >= low) & (n <= high)), F.lit(0))
    score = F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(F.floor(F.nanvl(named, F.lit(float(low)))), bare, F.lit(float(low))))).cast("int")
    reasons = [F.nullif(F.try_variant_get(found, f"$.{k}", "string"), F.lit("")) for k in ("reasoning", "rationale", "reason")]
    return F.struct(score.alias("score"), F.coalesce(*reasons, text).alias("reasoning"))


def prompt(question: Column, reference: Column, contexts: Column) -> Column:
    """What the judge is asked about one answer's contexts (see render_contexts)."""
    return F.concat(
        F.lit("Does the context below hold what the reference answer says? Use nothing else.\n\nQuestion:\n"),
        F.coalesce(question, F.lit("")),
        F.lit("\n\nReference answer:\n"),
        F.coalesce(reference, F.lit("")),
        F.lit("\n\nContext:\n"),
        contexts,
        F.lit('\n\nAnswer with a JSON object with the keys "correctness" (1 or 0) and "reason" (short).'),
    )
