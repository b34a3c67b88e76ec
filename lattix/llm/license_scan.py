"""Licence scan by MinHash bands over overlapping windows, in DataFrame functions only.

Texts and templates become words (lower case, runs of ASCII letters and digits) and
hashed five-word shingles.  A template of n < ``SHORT`` shingles is sought by windows of
one shingle (whose MinHash is that shingle), a longer one by windows of four shingles, of
which texts have one every two shingles and templates one at every shingle.  A window has
a band of one MinHash for each of the two seeds; the MinHash of seed k is the minimum of
``shingle XOR seed_k`` over the window.

These settings give a collision with certainty, not only with high probability, for a
notice that was edited in places: a text with at least 0.8 of a template's n shingles
lacks n / 5 at most, and an edit inside costs at least four, so for n >= 8 there are at
least five consecutive common shingles, hence one aligned text window that equals a
template window.  For n < 8 any common shingle collides.

A template that shares a band key with a text is verified exactly: of the template's
distinct shingles, those found anywhere in the whole text must be at least
``containment`` of all, however far apart they stand.

The templates and their keys are one row, which is broadcast, while a count proves that
they have ``MAX_INLINE_KEYS`` keys at most: texts are then tested in place, and no key of
a text is ever exploded or shuffled.  More keys are joined by a shuffle of narrow rows
(text, key); the shingles of texts with a hit are brought back by the text's hashes.

Edge cases: null, empty and short texts have no shingles and match nothing.  Templates
of fewer than five words match nothing.  Null ids are kept as null.  Rows that repeat
an id count once for each template, at their best text.  Whole texts are read, however
long (a text's shingles are one array).  Other columns are ignored, whatever their
names.  No template, or an empty table, gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh_join, let

SHINGLE, WINDOW, STEP, SHORT = 5, 4, 2, 8
#: Seeds of the two bands of a window: any fixed 64-bit numbers with well spread bits do.
SEEDS = (0, 0x632BE59BD9B4E019)
MAX_INLINE_KEYS = 10_000

#: Licence notices that the scan looks for.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mit": "Released under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+", -1), lambda x: x != "")


def shingle_hashes(ws: Column) -> Column:
    """Hash of each run of five words, from the words' own hashes."""

    def hashes(w: Column) -> Column:
        n = F.size(w) - (SHINGLE - 1)
        at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(SHINGLE)]))

    return let(F.transform(ws, lambda x: F.xxhash64(x)), hashes)


def _min_hashes(h: Column, step: int, seed: int) -> Column:
    """MinHash of each window of four shingles, a window every ``step`` (shorter arrays are one window)."""
    at = F.when(F.size(h) > 0, F.sequence(F.lit(0), F.greatest(F.size(h) - WINDOW, F.lit(0)) + (step - 1), F.lit(step)))
    smallest = lambda i: F.least(*[F.get(h, i + k).bitwiseXOR(F.lit(seed)) for k in range(WINDOW)])
    return F.transform(F.coalesce(at, F.array().cast("array<int>")), smallest)


def template_rows(docs: DataFrame, templates: dict[str, str]) -> DataFrame:
    """One row a template that has shingles: template, t_set (its distinct shingles), t_keys (band keys of its windows)."""
    schema = T.StructType([T.StructField("template", T.StringType()), T.StructField("t_text", T.StringType())])
    rows = docs.sparkSession.createDataFrame(sorted(templates.items()), schema)
    hashed = rows.select("template", shingle_hashes(words(F.col("t_text"))).alias("h")).filter(F.size("h") > 0)
    long = F.concat(*[_min_hashes(F.col("h"), 1, s) for s in SEEDS])
    keys = F.when(F.size("h") < SHORT, F.col("h")).otherwise(long)
    return hashed.select("template", F.array_distinct("h").alias("t_set"), F.array_distinct(keys).alias("t_keys"))


def scan_licenses(
    docs: DataFrame,
    templates: dict[str, str] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    containment: float = 0.8,
) -> DataFrame:
    """One row a (document, template): id, template, n_template, n_found, containment.

    ``n_template`` counts the template's distinct shingles, ``n_found`` those of them in the whole document.
    """
    known = template_rows(docs, TEMPLATES if templates is None else templates)
    n_keys = known.agg(F.coalesce(F.sum(F.size("t_keys")), F.lit(0))).first()[0]  # a number
    if not n_keys:
        known = known.limit(0)
    rows = docs.select(F.col(id_col).alias("id"), shingle_hashes(words(F.col(text_col).cast("string"))).alias("h"))
    # the single shingles, then both bands of the windows
    keyed = rows.select("id", "h", F.concat("h", *[_min_hashes(F.col("h"), STEP, s) for s in SEEDS]).alias("keys"))
    hits = _inline_hits(keyed, known) if n_keys <= MAX_INLINE_KEYS else _joined_hits(keyed, known)
    checked = hits.select("id", "template", F.size("t_set").alias("n_template"), F.size(F.array_intersect("t_set", "h")).alias("n_found"))
    best = checked.groupBy("id", "template", "n_template").agg(F.max("n_found").alias("n_found"))
    good = best.filter(F.col("n_found") / F.col("n_template") >= containment)
    return good.select(F.col("id").alias(id_col), "template", "n_template", "n_found", (F.col("n_found") / F.col("n_template")).alias("containment"))


def _inline_hits(keyed: DataFrame, known: DataFrame) -> DataFrame:
    """(id, h, template, t_set) of templates that share a key with a text; one row holds all templates."""
    one = known.agg(F.flatten(F.collect_list("t_keys")).alias("all_keys"), F.collect_list(F.struct("template", "t_set", "t_keys")).alias("all"))
    # coalesced, for no filter on null keys is then derived, which would be pushed down and repeat the hashing
    some = keyed.crossJoin(F.broadcast(one)).filter(F.coalesce(F.arrays_overlap("keys", "all_keys"), F.lit(False)))
    # outer, for no filter on the array's size is then derived, which would be pushed down and repeat the hashing
    return some.select("id", "h", F.explode_outer(F.filter("all", lambda t: F.arrays_overlap("keys", t["t_keys"]))).alias("t")).select("id", "h", "t.template", "t.t_set")


def _joined_hits(keyed: DataFrame, known: DataFrame) -> DataFrame:
    """The same by an equi-join on keys, for templates of any number."""
    marked = keyed.select("id", "h", "keys", F.xxhash64("h").alias("m1"), F.xxhash64("h", F.lit(1)).alias("m2"))
    probes = marked.select("id", "m1", "m2", F.explode_outer(F.array_distinct("keys")).alias("key"))
    bands = known.select("template", F.explode("t_keys").alias("key"))
    found = fresh_join(probes, bands, ["key"]).select("id", "m1", "m2", "template").distinct()
    texts = marked.select(F.col("id").alias("_id"), F.col("m1").alias("_m1"), F.col("m2").alias("_m2"), "h").dropDuplicates(["_id", "_m1", "_m2"])
    same = (F.col("m1") == F.col("_m1")) & (F.col("m2") == F.col("_m2")) & F.col("id").eqNullSafe(F.col("_id"))
    return found.join(texts, same).join(known.select("template", "t_set"), "template").select("id", "h", "template", "t_set")
