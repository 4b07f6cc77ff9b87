"""License scan: MinHash bands over overlapping windows retrieve templates, exact containment verifies.

Native expressions only. Texts and templates are cut into words (lower case, ASCII punctuation and blanks
separate) and shingles of ``SHINGLE`` words. A template of few shingles is looked up shingle by shingle: a
window of one shingle, whose MinHash is the shingle itself. A longer one is looked up by windows of
``WINDOW`` shingles at every ``STEP``-th place of the text and at every place of the template, with ``BANDS``
bands of one MinHash: windows of similarity s collide with probability 1 - (1 - s) ** BANDS (0.998 at 0.8),
and every copy of WINDOW + STEP - 1 shingles holds a whole window. The band keys of the templates are
broadcast after a count; longer lists are joined by a shuffle.

A collision says where the template would begin. The words there, with a margin, are checked for the share
of the template's shingles they hold.

Defined results: null texts match nothing; an empty list of templates finds nothing; copies of a text are checked once and each row gets its results;
templates without words are left out; equal templates both match; of several places in one document the
best and then first is returned; an empty table gives an empty result. Only the id and text are read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.let import let
from quillspark.llm.common import content_key, plain, small, stored

SHINGLE = 5
WINDOW = 8
STEP = 4
BANDS = 4
CONTAINMENT = 0.8

# Short notices and opening passages of well-known licenses.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        'associated documentation files (the "Software"), to deal in the Software without restriction, including '
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version.",
    ),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met",
    ),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
        "was not distributed with this file, You can obtain one at",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted",
    ),
)

SEPARATOR = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(plain(text)), SEPARATOR), lambda w: w != "")


def _hashes(w: Column) -> Column:
    """Hash of every run of SHINGLE words; a shorter text is one shingle."""
    long = F.transform(
        F.slice(w, F.lit(1), F.greatest(F.size(w) - (SHINGLE - 1), F.lit(0))),
        lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, SHINGLE)]),
    )
    return F.when(F.size(w) >= SHINGLE, long).when(F.size(w) > 0, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(
        F.array().cast("array<bigint>")
    )


def _windows(h: Column, step: int) -> Column:
    """(kind, at, band key) of the windows of a shingle array: one row per band."""
    last = F.size(h) - WINDOW
    begins = F.when(last >= 0, F.sequence(F.lit(0), last, F.lit(step))).otherwise(F.array().cast("array<int>"))

    def keys(at: Column) -> Column:
        return let(
            F.slice(h, at + 1, F.lit(WINDOW)),
            lambda s: F.array(
                *[
                    F.struct(
                        at.alias("at"),
                        F.array_min(F.transform(s, lambda x, b=b: F.xxhash64(x, F.lit(b)))).alias("key"),
                    )
                    for b in range(1, BANDS + 1)
                ]
            ),
        )

    return F.flatten(F.transform(begins, keys))


def _single(h: Column) -> Column:
    return F.transform(h, lambda x, i: F.struct(i.alias("at"), x.alias("key")))


def templates(spark: SparkSession, texts: Sequence[tuple[str, str]]) -> DataFrame:
    """(template, license, words, hashes) of the templates that have words."""
    rows = [
        F.struct(F.lit(i).alias("template"), F.lit(name).alias("license"), F.lit(text).cast("string").alias("text"))
        for i, (name, text) in enumerate(texts)
    ]
    listed = F.array(*rows).cast("array<struct<template:int,license:string,text:string>>")
    frame = spark.range(1).select(F.inline(listed))
    frame = frame.select("template", "license", words(F.col("text")).alias("words"))
    return frame.select("*", _hashes(F.col("words")).alias("hashes")).where(F.size("words") > 0)


def _short(h: Column) -> Column:
    return F.size(h) < WINDOW + STEP - 1


def template_keys(known: DataFrame) -> DataFrame:
    """(key, template, place): band keys of all template windows and where in the template they begin."""
    h = F.col("hashes")
    items = F.when(_short(h), _single(h)).otherwise(_windows(h, 1))
    rows = known.select("template", F.inline(items))
    return rows.select("key", "template", F.col("at").alias("place")).distinct()


def retrieved(docs: DataFrame, known: DataFrame, text: str) -> DataFrame:
    """(content, template, begin): where a template may begin in a text, in words."""
    keys = stored(template_keys(known), "templates")
    w = words(F.col(text))
    items = let(w, lambda x: let(_hashes(x), lambda h: F.concat(_single(h), _windows(h, STEP))))
    rows = docs.select(content_key(F.col(text)).alias("content"), items.alias("items"))
    rows = rows.select("content", F.explode_outer("items").alias("item"))
    return (
        rows.select("content", F.col("item.at").alias("at"), F.col("item.key").alias("key"))
        .join(small(keys), "key")
        .select("content", "template", F.greatest(F.col("at") - F.col("place"), F.lit(0)).alias("begin"))
        .distinct()
    )


def _strings(w: Column) -> Column:
    """Shingles as strings, so that the check is exact."""
    many = F.transform(
        F.slice(w, F.lit(1), F.greatest(F.size(w) - (SHINGLE - 1), F.lit(0))),
        lambda x, i: F.array_join(F.slice(w, i + 1, F.lit(SHINGLE)), " "),
    )
    return F.when(F.size(w) >= SHINGLE, many).otherwise(F.array(F.array_join(w, " ")))


def containment(template: Column, region: Column) -> Column:
    """Share of the template's distinct shingles that the region holds."""
    return let(
        F.array_distinct(_strings(template)),
        lambda t: F.size(F.array_intersect(t, _strings(region))) / F.size(t),
    )


def scan(
    docs: DataFrame,
    text: str = "text",
    id: str = "doc_id",
    texts: Sequence[tuple[str, str]] = TEMPLATES,
    least: float = CONTAINMENT,
) -> DataFrame:
    """(id, license, start, containment): the best match of each license in each document."""
    spark = docs.sparkSession
    known = stored(templates(spark, texts), "known")
    hits = stored(retrieved(docs, known, text), "hits")
    spots = hits.groupBy(F.col("content").alias("of")).agg(F.collect_set(F.struct("template", "begin")).alias("spots"))
    rows = docs.select(
        F.col(id).alias("__id"), F.col(text).alias("__text"), content_key(F.col(text)).alias("__content")
    ).join(small(stored(spots, "spots")), F.col("__content") == F.col("of"))
    rows = rows.select("__id", words(F.col("__text")).alias("words"), F.explode("spots").alias("spot"))
    rows = rows.select("__id", "words", "spot.template", "spot.begin").join(
        small(known.select("template", "license", F.col("words").alias("notice"))), "template"
    )
    margin = F.ceil(F.size("notice") / 4).cast("int")
    first = F.greatest(F.col("begin") - margin, F.lit(0))
    region = F.slice("words", first + 1, F.col("begin") - first + F.size("notice") + margin)
    checked = rows.select("__id", "license", "begin", containment(F.col("notice"), region).alias("share"))
    best = F.max(F.struct("share", (-F.col("begin")).alias("back"))).alias("best")
    return (
        checked.where(F.col("share") >= least)
        .groupBy("__id", "license")
        .agg(best)
        .select(
            F.col("__id").alias(id), "license", (-F.col("best.back")).alias("start"), F.col("best.share").alias("containment")
        )
    )
