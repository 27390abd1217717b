"""License scans: MinHash bands over text windows, then shingle containment (operator 5).

Documents and templates are cut into overlapping windows of words.  A window's signature has
one minimum for each band over the hashes of its five-word shingles; documents whose
window meets a template's window in a band are verified by the share of the template's shingles
that occur around the window.  Only DataFrame functions are used: the minima of a window are
plain arithmetic on a few columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.columns import with_fields
from quire.operators.staging import settle

SHINGLE = 5

#: Customary notices, by the licence's public short identifier.
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "MIT": "Released under the MIT License.",
    "MIT-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


def notices(spark: SparkSession) -> DataFrame:
    """``template_id, text`` of the customary notices."""
    return spark.createDataFrame(sorted(NOTICES.items()), "template_id string, text string")


def collision_probability(similarity: float, bands: int) -> float:
    """Chance that two windows of this Jaccard similarity meet in at least one band of one minimum."""
    return 1.0 - (1.0 - similarity) ** bands


def _words(text: Column) -> Column:
    """Runs of ASCII letters and digits, in lower case."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), "")


def _shingles(words: Column) -> Column:
    """A hash for each five words in a row; none for fewer words."""
    at = F.sequence(F.lit(1), F.size(words) - (SHINGLE - 1))
    one = lambda i: F.xxhash64(*(F.element_at(words, i + k) for k in range(SHINGLE)))
    return F.when(F.size(words) >= SHINGLE, F.transform(at, one)).otherwise(F.array().cast("array<bigint>"))


def _cut(df: DataFrame, keep: list[str]) -> DataFrame:
    """``keep``, ``_words`` and ``_hashes``, each computed once for a row."""
    words = with_fields(df, keep, F.struct(_words(F.col("_text")).alias("_words")), ["_words"])
    return with_fields(words, [*keep, "_words"], F.struct(_shingles(F.col("_words")).alias("_hashes")), ["_hashes"])


def _starts(df: DataFrame, keep: list[str], stride: int) -> DataFrame:
    """``keep``, ``_hashes`` and ``at``, the first shingle of each window, from 0."""
    last = F.greatest(F.size("_hashes") - 1, F.lit(0))
    starts = F.when(F.size("_hashes") > 0, F.sequence(F.lit(0), last, F.lit(stride))).otherwise(F.array().cast("array<int>"))
    return df.select(*keep, "_hashes", F.explode(starts).alias("at"))


def _starts_near(df: DataFrame, keep: list[str], window: int, stride: int, shingles: DataFrame) -> DataFrame:
    """The same for windows that hold one of ``shingles(_hash)``; a window can come more than once.

    A band's minimum is the hash of a shingle, so windows meet only if they share one: no meeting is lost.
    """
    width = window - SHINGLE + 1
    rows = df.select(*keep, "_hashes", F.posexplode("_hashes").alias("_pos", "_hash")).join(F.broadcast(shingles), "_hash")
    low = F.greatest(F.lit(0), F.ceil((F.col("_pos") - width + 1) / stride).cast("int")) * stride
    high = F.floor(F.col("_pos") / stride).cast("int") * stride
    rows = rows.where(low <= high)
    return rows.select(*keep, "_hashes", F.explode(F.sequence(low, high, F.lit(stride))).alias("at"))


def _bands(rows: DataFrame, keep: list[str], window: int, bands: int) -> DataFrame:
    """``keep``, ``at`` and ``value``, a row for each window and band."""
    names = [f"_hash_{k}" for k in range(window - SHINGLE + 1)]
    rows = rows.select(*keep, "at", *(F.get("_hashes", F.col("at") + k).alias(n) for k, n in enumerate(names)))
    rows = rows.withColumn("_band", F.explode(F.sequence(F.lit(0), F.lit(bands - 1))))
    # The band is part of what is hashed, so a value belongs to one band; nulls, behind a text's end, do not count.
    value = F.least(*(F.when(F.col(n).isNotNull(), F.xxhash64(n, "_band")) for n in names))
    return rows.select(*keep, "at", value.alias("value"))


def scan(
    docs: DataFrame, templates: DataFrame, window: int = 8, stride: int = 4, bands: int = 20, containment: float = 0.75,
    most_templates: int = 10_000,
) -> DataFrame:
    """``doc_id, template_id, containment, at, n_found`` for each document and template found in it.

    ``containment`` is the largest share of the template's distinct shingles that occur around a
    window that met it, ``at`` the word at which the first such window starts, and ``n_found`` the windows that verified.
    A window that starts with a shingle of a template has four shingles, and one of them in common with a template's window of up to four has a
    similarity of 1/7 or more: 20 bands meet with probability 0.95 from one window, and a window that lies within the template surely.

    Only ``doc_id`` and ``text`` are read.  A null text, or one of fewer than five words, has no shingle and no match; so has such a
    template.  Equal rows are one document.  A row without an id is found under a null id.  Empty tables give
    no rows.  Templates are a stated list, not a corpus: more than ``most_templates`` rows are an error.
    """
    known = templates.select("template_id", F.col("text").alias("_text"))
    if known.limit(most_templates + 1).count() > most_templates:
        raise ValueError(f"more than {most_templates} templates")
    known = _cut(known, ["template_id"]).where(F.size("_hashes") > 0)
    # Bounded by the stated list: its windows, one for each word.
    marks = _bands(_starts(known, ["template_id"], 1), ["template_id"], window, bands)
    index = settle(marks.select("template_id", "value").distinct())
    shingles = settle(known.select(F.explode("_hashes").alias("_hash")).distinct())
    longest = known.agg(F.max(F.size("_words"))).first()[0] or 0

    own = _cut(docs.select("doc_id", F.col("text").alias("_text")), ["doc_id", "_text"])
    around = F.slice("_words", F.greatest(F.col("at") - longest, F.lit(0)) + 1, F.lit(2 * longest + window))
    keep = ["doc_id", "_text", "_words"]
    found = _bands(_starts_near(own, keep, window, stride, shingles), keep, window, bands).join(F.broadcast(index), "value")
    met = found.select("doc_id", F.xxhash64("_text").alias("_row"), "at", "template_id", around.alias("_around"))
    met = met.groupBy("doc_id", "_row", "at", "template_id").agg(
        F.first("_around").alias("_around")
    )
    wanted = known.select("template_id", F.array_distinct(_texts(F.col("_words"))).alias("_wanted"))
    checked = met.join(F.broadcast(wanted), "template_id").withColumn(
        "containment", F.size(F.array_intersect("_wanted", _texts(F.col("_around")))) / F.size("_wanted")
    )
    return checked.where(F.col("containment") >= containment).groupBy("doc_id", "_row", "template_id").agg(
        F.max("containment").alias("containment"), F.min("at").cast("long").alias("at"), F.count("*").alias("n_found")
    ).drop("_row")


def _texts(words: Column) -> Column:
    """Shingles as text, for the exact comparison."""
    at = F.sequence(F.lit(1), F.size(words) - (SHINGLE - 1))
    return F.when(
        F.size(words) >= SHINGLE, F.transform(at, lambda i: F.array_join(F.slice(words, i, SHINGLE), " "))
    ).otherwise(F.array().cast("array<string>"))
