"""License notices: MinHash bands over overlapping windows retrieve templates, shingle containment verifies them.

Windows are a quarter longer than the longest template of their length class and
step by less than the rest, so a notice lies whole in one of them. A template has
at least nine tenths of its class's length, so a window that holds 80 % of its
shingles has a Jaccard similarity J of at least 4/9 with it (the shortest classes
are the worst: 4 of 5 shingles in a window of 8), and one of BANDS bands of one
row agrees with a chance of 1 - (1 - J) ** BANDS, over 0.999999. Before that, texts and windows without any anchor word of the
templates are passed over; anchors are chosen so that what avoids them all holds
too few shingles of any template, so this loses nothing.

Only DataFrame functions. Words are runs of ASCII letters and digits, lower-cased.
Defined cases: null and empty texts match nothing; very long texts are read whole;
licenses that match the same words equally well all stay; rows that repeat an id
give one row per id and license, the best one, the first of equals; null ids are
one id; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHINGLE, CONTAINED, BANDS = 5, 0.8, 24

#: Notices of public licenses, word for word.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)


def words_of(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def anchors(templates: list[list[str]]) -> list[str]:
    """Words, the longest of each template first, without which less than CONTAINED of its shingles is left."""
    chosen: set[str] = set()
    for words in templates:
        shingles = {tuple(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)}
        for word in sorted(set(words), key=lambda w: (-len(w), w)):
            if sum(not chosen & set(s) for s in shingles) < CONTAINED * len(shingles):
                break
            chosen.add(word)
    return sorted(chosen)


def length_classes(lengths: list[int]) -> list[int]:
    """Window bases: each template's length is at most a base and at least nine tenths of it; up to eight words it is the base."""
    bases: list[int] = []
    for n in sorted(set(lengths), reverse=True):
        if not bases or n < bases[-1] * (0.9 if n > 8 else 1.0):
            bases.append(n)
    return bases


def _shingles(words: Column) -> Column:
    """Distinct shingle hashes of an array of at least SHINGLE words."""
    at = F.sequence(F.lit(1), F.size(words) - SHINGLE + 1)
    return F.array_distinct(F.transform(at, lambda i: F.xxhash64(F.array_join(F.slice(words, i, SHINGLE), " "))))


def _lowest(shingles: Column, band: int) -> Column:
    return F.array_min(F.transform(shingles, lambda x: F.xxhash64(x, F.lit(band))))


def _bands(shingles: Column) -> Column:
    return F.array(*[F.struct(F.lit(b).alias("band"), _lowest(shingles, b).alias("low")) for b in range(BANDS)])


def families(templates: list[list[str]]) -> list[int]:
    """For each template the first of its versions: those that share half of the shorter one's shingles."""
    shingles = [{tuple(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)} for words in templates]
    family = list(range(len(templates)))
    for i, a in enumerate(shingles):
        for j, b in enumerate(shingles[:i]):
            if 2 * len(a & b) >= min(len(a), len(b)) and family[i] != family[j]:
                low, high = sorted((family[i], family[j]))
                family = [low if f == high else f for f in family]
    return family


def _overlap(x: Column, y: Column) -> Column:
    """Words that two matches have in common."""
    return F.least(x["end"], y["end"]) - F.greatest(x["start"], y["start"])


def scan(documents: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """doc_id, license, containment, first_word, n_words: the best window of each license in each document."""
    spark = documents.sparkSession
    parsed = [(name, words_of(text)) for name, text in templates]
    if any(len(w) < SHINGLE for _, w in parsed):
        raise ValueError(f"a template needs {SHINGLE} words")
    bases = length_classes([len(w) for _, w in parsed])
    base_of = {n: min(b for b in bases if b >= n) for n in {len(w) for _, w in parsed}}
    keys = anchors([w for _, w in parsed])
    table = spark.createDataFrame([(i, family, name, base_of[len(w)], w) for i, ((name, w), family) in enumerate(zip(parsed, families([w for _, w in parsed]), strict=True))], "template int, family int, license string, base int, words array<string>")
    table = table.select("template", "family", "license", "base", _shingles(F.col("words")).alias("wanted"))
    table = table.select("*", F.inline(_bands(F.col("wanted"))))  # as many rows as templates times bands

    lower = F.lower("text")
    rows = documents.select("doc_id", "text").where(lower.rlike("|".join(keys)))
    split = F.filter(F.split(F.lower("text"), "[^a-z0-9]+", -1), lambda w: w != "")
    rows = rows.select("doc_id", F.monotonically_increasing_id().alias("row"), split.alias("words")).where(F.size("words") >= SHINGLE)
    # Places of anchors, so that only windows around them are cut.
    hits = F.filter(F.transform("words", lambda w, i: F.when(w.isin(keys), i)), lambda i: i.isNotNull())
    rows = rows.select("doc_id", "row", "words", hits.alias("hits"))
    sizes = F.array(*[F.struct(F.lit(b).alias("base"), F.lit(b + b // 4).alias("size"), F.lit(max(1, b // 4 + 1)).alias("step")) for b in bases])
    rows = rows.select("doc_id", "row", "words", "hits", F.inline(sizes))
    last = F.greatest(F.lit(0), F.size("words") - F.col("size"))
    near = lambda h: F.sequence(F.floor(F.greatest(h - F.col("size") + 1, F.lit(0)) / F.col("step")), F.floor(h / F.col("step")))
    # A window of step k starts at k * step, or where the last whole one does.
    starts = F.array_distinct(F.transform(F.flatten(F.transform("hits", near)), lambda k: F.least(k * F.col("step"), last.cast("bigint"))))
    cuts = rows.select("doc_id", "row", "words", "base", "size", F.explode(starts).alias("first"))
    windows = cuts.select("doc_id", "row", "base", F.col("first").cast("int").alias("first"), F.slice("words", (F.col("first") + 1).cast("int"), F.col("size")).alias("window"))
    windows = windows.select("doc_id", "row", "base", "first", F.size("window").alias("n"), _shingles(F.col("window")).alias("held"))
    banded = windows.select("*", F.inline(_bands(F.col("held"))))
    met = banded.join(F.broadcast(table), ["base", "band", "low"])
    share = F.size(F.array_intersect("wanted", "held")) / F.size("wanted")
    found = met.select("doc_id", "row", "template", "family", "license", share.alias("containment"), "first", "n", "wanted", "held").where(F.col("containment") >= CONTAINED)
    found = found.dropDuplicates(["row", "template", "first", "n"])
    # The stretch of words that matches: from the first to the last of the template's shingles in the window.
    places = F.transform(F.array_intersect("held", "wanted"), lambda x: F.array_position("held", x))
    start = F.col("first") + F.array_min(places) - 1
    match = F.struct("license", "containment", "first", "n", start.alias("start"), (F.col("first") + F.array_max(places) + SHINGLE - 1).alias("end"))
    met = found.groupBy("row", "family").agg(F.first("doc_id").alias("doc_id"), F.collect_list(match).alias("all"))
    # Of one license, what overlaps a better match is a part of it.
    tops = F.filter("all", lambda x: ~F.exists("all", lambda y: (y["license"] == x["license"]) & (y["containment"] > x["containment"]) & (_overlap(x, y) > 0)))
    # Versions of a license differ by a word: a match yields to a better one of another version on the same words, and to no other.
    yields = lambda x: F.exists("tops", lambda y: (y["license"] != x["license"]) & (y["containment"] > x["containment"]) & (2 * _overlap(x, y) >= x["end"] - x["start"]))
    found = met.select("doc_id", tops.alias("tops")).select("doc_id", F.inline(F.filter("tops", lambda x: ~yields(x))))
    best = F.max(F.struct("containment", (-F.col("first")).alias("back"), "n")).alias("best")
    return found.groupBy("doc_id", "license").agg(best).select("doc_id", "license", F.round("best.containment", 6).alias("containment"), (-F.col("best.back")).alias("first_word"), F.col("best.n").alias("n_words"))
