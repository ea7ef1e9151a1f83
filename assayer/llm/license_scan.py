"""License scans: MinHash bands over overlapping windows find templates, exact containment of shingles decides."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of letters and digits, lower-cased; a shingle is WIDTH of them.
WIDTH = 3
#: Shingles in a block; a window is two blocks, so windows overlap by half.
BLOCK = 4
#: A template that is found with less probability than this by its bands isn't accepted.
MIN_RECALL = 0.99
#: Up to so many band keys of templates are literals of the plan; more are joined as a table, which gives the same rows.
LITERALS = 4096

#: Short notices as they are printed in works, with the identifiers of the licenses. Fixed values.
NOTICES = {
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "Dedicated to the public domain under CC0 1.0.",
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "MIT-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
}


def notices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(NOTICES.items()), "license string, notice string")


def _masks(bands: int) -> list[int]:
    """A constant for each band: hashes, combined with it by exclusive or, are in another order."""
    return [((k + 1) * 0x9E3779B97F4A7C15 % 2**64) - 2**63 for k in range(bands)]


def _shingles(words: Column) -> Column:
    last = F.greatest(F.lit(0), F.size(words) - (WIDTH - 1))
    return F.transform(F.slice(words, 1, last), lambda w, i: F.xxhash64(w, *(F.get(words, i + k) for k in range(1, WIDTH))))


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _keyed(least: Column, band: int) -> Column:
    """The minimum of a band, with the band's number in its last bits."""
    return least.bitwiseAND(F.lit(-64)).bitwiseOR(F.lit(band).cast("long"))


def held_shingles(shingles: int, missing: int) -> int:
    """At least: how many shingles of a template the best window of a text holds, wherever it starts, if so many were altered where they stand.

    Windows that don't overlap share no shingle, so to leave none with more than h, all that they hold beyond h must be altered.
    """
    window, least = 2 * BLOCK, shingles
    for offset in range(BLOCK):
        best = 0
        for first in (-offset, BLOCK - offset):
            over = [min(s + window, shingles) - max(s, 0) for s in range(first, shingles, window)]
            best = max(best, next(h for h in range(window + 1) if sum(max(0, o - h) for o in over) <= missing))
        least = min(least, best)
    return least


def collision_probability(shingles: int, bands: int, containment: float = 1.0) -> float:
    """At least: that a window of a text shares a band with a template of so many distinct shingles, of which the text holds that share in their places.

    Windows of texts start every BLOCK shingles and those of templates at every shingle, so the best window's shingles are all in one of the template's.
    """
    window = 2 * BLOCK
    held = held_shingles(shingles, shingles - math.ceil(containment * shingles - 1e-9))
    return 1.0 - (1.0 - held / (window + min(shingles, window) - held)) ** bands


def template_keys(templates: DataFrame, bands: int) -> DataFrame:
    """(license, shingles, keys): distinct shingles of each template and the band keys of its windows, which start at every shingle."""
    window = 2 * BLOCK
    # generated rows, as in scan: no filter is pushed into the bodies of array expressions, where it would be evaluated for each element
    rows = templates.select("license", F.explode(F.array(_words(F.col("notice")))).alias("words"))
    rows = rows.select("license", F.explode(F.array(_shingles(F.col("words")))).alias("all")).filter(F.size("all") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("all") - (window - 1)))
    keys = F.flatten(F.transform(starts, lambda s: F.array(*(_keyed(F.array_min(_xored(F.slice("all", s, F.lit(window)), m)), b) for b, m in enumerate(_masks(bands))))))
    return rows.select("license", F.array_distinct("all").alias("shingles"), F.array_distinct(keys).alias("keys"))


def _xored(hashes: Column, mask: int) -> Column:
    return F.transform(hashes, lambda h: h.bitwiseXOR(F.lit(mask)))


def scan(docs: DataFrame, templates: DataFrame, bands: int = 12, min_containment: float = 0.8, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, license, containment, word): the licenses whose notice is in a text, and the word (from 0) at which it starts: at the fullest of several places, the
    first of equals.

    Templates are a table (license, notice). Every text's shingles are taken in blocks, the least hash of a block under each band's order is
    kept, and a window's least is that of its two blocks. Windows that meet no template go; the others are verified: at least
    ``min_containment`` of the template's distinct shingles are among those from a template's length before the window to one after it.
    ``bands`` must find every template that holds so many shingles in their places with probability MIN_RECALL (ValueError otherwise).
    Null, empty and short texts have no window; repeated rows give one result; a license may have several templates, the best counts;
    templates without a shingle are never found. Empty tables give no rows, and no column of ``docs`` but its id and text is read.
    """
    keyed = template_keys(templates, bands).withColumn("template", F.xxhash64("license", "shingles"))
    lengths = keyed.groupBy(F.size("shingles").alias("n")).agg(F.min("license").alias("license"), F.sum(F.size("keys")).alias("keys")).collect()  # one row for each length
    for t in lengths:
        if (found := collision_probability(t["n"], bands, min_containment)) < MIN_RECALL:
            raise ValueError(f"{t['license']}: {bands} bands find it with probability {found:.3f}")
    few = sum(t["keys"] for t in lengths) <= LITERALS
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).withColumn("words", _words(F.col("text"))).withColumn("h", _shingles(F.col("words"))).drop("words")
    hashes, blocks = F.col("h"), F.ceil(F.size("h") / BLOCK).cast("int")
    rows = rows.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), "h", F.when(blocks > 0, F.sequence(F.lit(0), blocks - 1)).otherwise(F.array().cast("array<int>")).alias("at"))
    for b, mask in enumerate(_masks(bands)):
        rows = rows.withColumn(f"b{b}", _block_least(hashes, mask))
    windows = F.array(*(F.transform("at", _window_key(F.col(f"b{b}"), b)) for b in range(bands)))
    # a generated row is a wall that filters aren't pushed through, into the bodies of array expressions
    rows = rows.select("doc_id", "key", F.explode(F.array(F.struct("h", windows.alias("bands")))).alias("s"))
    pairs = (_pairs_by_literals if few else _pairs_by_join)(rows, keyed)
    first, last = F.greatest(F.lit(0), F.col("window") * BLOCK - F.size("shingles")), F.col("window") * BLOCK + 2 * BLOCK + F.size("shingles")
    near = F.slice("h", first + 1, last - first)
    checked = pairs.select("doc_id", "key", "license", "shingles", first.alias("first"), near.alias("near"), (F.size(F.array_intersect("shingles", near)) / F.size("shingles")).alias("containment"))
    # of the template's shingles in the text, the one after which so many places as it has shingles hold most of them; the first of equals
    held = lambda p: F.size(F.array_intersect("shingles", F.slice("near", p + 1, F.size("shingles"))))
    places = F.filter(F.sequence(F.lit(0), F.size("near") - 1), lambda p: F.array_contains("shingles", F.get("near", p)))
    starts = F.array_max(F.transform(places, lambda p: F.struct(held(p).alias("held"), (-(F.col("first") + p)).alias("back"))))
    fullest = F.min_by(F.struct("containment", "first", "near", "shingles"), F.struct(-F.col("containment"), "first"))  # one window is looked at place by place
    found = checked.filter(F.col("containment") >= min_containment).groupBy("doc_id", "key", "license").agg(fullest.alias("w")).select("doc_id", "license", "w.*")
    return found.select("doc_id", "license", "containment", (-starts["back"]).cast("long").alias("word"))


def _keys_of(rows: DataFrame, *carried: str) -> DataFrame:
    """One row (doc_id, key, carried..., window, found) for each window and band."""
    each = rows.select("doc_id", "key", *carried, F.explode(F.arrays_zip("s.bands")).alias("band"))
    return each.select("doc_id", "key", *(c.rpartition(".")[2] for c in carried), F.posexplode("band.bands").alias("window", "found"))


def _pairs_by_literals(rows: DataFrame, keyed: DataFrame) -> DataFrame:
    """(doc_id, key, h, window, license, shingles) of windows that meet a template: texts without one go before a row is made of any window."""
    held = keyed.collect()
    wanted = F.lit(sorted({k for t in held for k in t["keys"]})).cast("array<long>")
    known = rows.sparkSession.createDataFrame([(t["license"], t["shingles"], k) for t in held for k in t["keys"]], "license string, shingles array<long>, found long")
    hit = _keys_of(rows.filter(F.arrays_overlap(F.flatten("s.bands"), wanted)), "s.h").filter(F.array_contains(wanted, F.col("found")))
    return hit.join(F.broadcast(known), "found")  # at most LITERALS rows


def _pairs_by_join(rows: DataFrame, keyed: DataFrame) -> DataFrame:
    """The same rows by joins: keys meet keys, and only texts that meet a template are met with their shingles again."""
    known = keyed.select("license", "template", F.explode("keys").alias("found"))
    met = _keys_of(rows).join(known, "found").select("doc_id", "key", "window", "license", "template").distinct()
    return met.join(keyed.select("license", "template", "shingles"), ["license", "template"]).join(rows.select("key", "s.h"), "key")


def _block_least(hashes: Column, mask: int) -> Column:
    return F.transform("at", lambda j: F.least(*(F.get(hashes, j * BLOCK + k).bitwiseXOR(F.lit(mask)) for k in range(BLOCK))))


def _window_key(blocks: Column, band: int):
    return lambda j: _keyed(F.least(F.get(blocks, j), F.get(blocks, j + 1)), band)


def bands_for(shingles: int, recall: float = MIN_RECALL, containment: float = 1.0) -> int:
    """The fewest bands that find a template of so many shingles with probability ``recall``."""
    miss = 1.0 - collision_probability(shingles, 1, containment)
    return 1 if miss <= 0 else max(1, math.ceil(math.log(1.0 - recall) / math.log(miss)))
