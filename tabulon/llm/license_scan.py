"""License scan: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies them. DataFrame functions only.

Texts are cut into windows of twice a class's length, every length, one class of lengths for each size of templates, so a template lies whole in a
window. A template of one shingle has windows of one shingle. A class has as many bands of one row, BANDS at least, as retrieve a window
that holds just the needed share of any of its templates with a probability of 1 - LOST or more, by the least Jaccard similarity that such a window can
have (bands_needed). A band of one row brings a window and a template together only by a shingle that both have, the least of either; so windows without
any shingle of their class's templates are left out before they are hashed, which changes no result. Windows never leave their document's row.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm.common import documents

WIDTH, PERCENT, BANDS, LOST = 5, 75, 64, 1e-4
#: Words of fewer letters are too common for the gate unless nothing else is left.
GATE_LETTERS = 6
# Notices and openings of public licenses.
TEMPLATES = {
    "mit-notice": "Released under the MIT License.",
    "apache-notice": "Licensed under the Apache License, Version 2.0.",
    "gpl3-notice": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-nc": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "mpl-2": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "apache-2": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "lgpl-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "agpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "boost": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so",
    "epl-2": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
}


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), 1)


def shingles_of(words: Column) -> Column:
    """Hashes of all runs of WIDTH words, in order; words must be a column of its own."""
    n = F.size(words)
    return F.when(n >= WIDTH, F.transform(F.sequence(F.lit(1), n - (WIDTH - 1)), lambda i: F.xxhash64(F.slice(words, i, F.lit(WIDTH))))).otherwise(F.array().cast("array<bigint>"))


def bands_of(shingles: Column, n: int) -> Column:
    """The least hash of each of n bands' own hash function."""
    def least(b: Column) -> Column:
        return F.array_min(F.transform(shingles, lambda h: F.xxhash64(h, b)))

    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), least)


def span(length: int) -> int:
    """Shingles of a class's window."""
    return 1 if length == 1 else 2 * length


def bands_needed(shingles: int, length: int) -> int:
    """Bands that retrieve a template of so many distinct shingles wherever a window of its class holds the needed share of them."""
    held = math.ceil(PERCENT * shingles / 100)
    least = held / (max(span(length), held) + shingles - held)  # all else in the window is foreign
    return 1 if least == 1 else max(BANDS, math.ceil(math.log(LOST) / math.log(1 - least)))


def gate(templates: dict[str, str]) -> str:
    """A pattern that every text matches which holds the needed share of any template's shingles: one of a few words, without which too many shingles are lost.

    Words are chosen by the share of open templates' shingles that they are in, words of GATE_LETTERS letters or more first: shorter ones are in most texts.
    """
    split = {name: re.findall(r"[^\W_]+", text.lower()) for name, text in templates.items()}
    shingles = {name: {tuple(w[i : i + WIDTH]) for i in range(len(w) - WIDTH + 1)} for name, w in split.items()}
    chosen: set[str] = set()
    while True:
        free = {name: [s for s in of if not chosen & set(s)] for name, of in shingles.items()}
        left = [f for name, f in free.items() if f and len(f) >= math.ceil(PERCENT * len(shingles[name]) / 100)]
        if not left and not chosen:
            return r"(?!)"  # no template has a shingle
        if not left:
            return "(?iu)" + "|".join(sorted(chosen))
        score: dict[str, float] = {}
        for f in left:
            for w in (w for s in f for w in set(s)):
                score[w] = score.get(w, 0) + 1 / len(f)
        chosen.add(max(sorted(score), key=lambda w: (len(w) >= GATE_LETTERS, score[w])))


def _known(spark: SparkSession, templates: dict[str, str]) -> dict[int, list]:
    """(license, distinct shingles, least hash of each band) of all templates by their class's length.

    The list of templates is a parameter: what is read here, and travels with the plan, are a few hundred numbers for each.
    """
    table = spark.createDataFrame(list(templates.items()), "license string, text string").select("license", words_of(F.col("text")).alias("words"))
    table = table.select("license", F.size("words").alias("n"), F.array_distinct(shingles_of(F.col("words"))).alias("shingles")).where(F.size("shingles") > 0)
    classes: dict[int, list] = {}
    for r in table.collect():
        length = 1 if len(r["shingles"]) == 1 else max(8, 1 << (r["n"] - 1).bit_length())
        classes.setdefault(length, []).append((r["license"], r["shingles"]))
    for length, of in classes.items():
        n = max(bands_needed(len(shingles), length) for _, shingles in of)
        rows = spark.createDataFrame(of, "license string, shingles array<bigint>").select("license", "shingles", bands_of(F.col("shingles"), n).alias("least"))
        classes[length] = [tuple(r) for r in rows.collect()]
    return classes


def _longs(values) -> Column:
    return F.array(*map(F.lit, values)).cast("array<bigint>")


def matches_of(shingles: Column, common: Column, length: int, templates: list) -> Column:
    """(license, first word, containment) of a class's windows that a band retrieves for a template and whose shingles verify it; common: the class's shingles in the text."""
    places = F.sequence(F.lit(0), F.floor((F.size(shingles) - 1) / length).cast("int"))
    cut = F.transform(places, lambda i: F.struct((i * length).alias("word"), F.slice(shingles, i * length + 1, F.lit(span(length))).alias("window")))
    near = F.filter(cut, lambda w: F.arrays_overlap(w["window"], common))
    banded = F.transform(near, lambda w: F.struct(w["word"], w["window"], bands_of(w["window"], len(templates[0][2])).alias("bands")))
    known = F.array(*(F.struct(F.lit(name).alias("license"), _longs(grams).alias("grams"), _longs(least).alias("least")) for name, grams, least in templates))

    def judged(w: Column) -> Column:
        retrieved = F.filter(known, lambda t: F.exists(F.zip_with(w["bands"], t["least"], lambda x, y: x == y), lambda same: same))
        share = lambda t: F.size(F.array_intersect(w["window"], t["grams"])) * 100.0 / F.size(t["grams"])
        return F.filter(F.transform(retrieved, lambda t: F.struct(t["license"], w["word"].alias("word"), share(t).alias("containment"))), lambda m: m["containment"] >= PERCENT)

    empty = F.array().cast("array<struct<license:string,word:int,containment:double>>")
    return F.when(F.size(common) > 0, F.flatten(F.transform(banded, judged))).otherwise(empty)


def scan_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """doc_id, n_licenses, licenses (names, sorted, comma-joined), best (highest containment, 0 if none) and matches of every row of docs.

    A template matches where a window holds at least PERCENT of its distinct WIDTH-word shingles (letters and digits, lower case).
    matches: array of (license, word, containment), word being the first of the best window. Null or empty text: none. Equal rows get equal
    results, rows without doc_id too. Templates of fewer than WIDTH words match nothing. Other columns are ignored. Empty input: no rows.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("doc_id").cast("long"), text).alias("key"), text.alias("text"))
    classes = _known(docs.sparkSession, templates)
    every = _longs(sorted({h for of in classes.values() for _, grams, _ in of for h in grams}))
    held = rows.where(F.col("text").rlike(gate(templates))).select("doc_id", "key", words_of(F.col("text")).alias("words"))
    # each step is made by a generator: a plain projection would be put into the next one's lambdas and run once per element
    held = held.select("doc_id", "key", F.explode(F.array(shingles_of(F.col("words")))).alias("all")).where(F.arrays_overlap("all", every))
    common = [F.array_intersect("all", _longs(sorted({h for _, grams, _ in of for h in grams}))).alias(f"c{length}") for length, of in classes.items()]
    held = held.select("doc_id", "key", "all", F.explode(F.array(F.struct(*common) if common else F.struct(F.lit(0)))).alias("common"))
    found = [matches_of(F.col("all"), F.col(f"common.c{length}"), length, of) for length, of in classes.items()]
    none = F.array().cast("array<struct<license:string,word:int,containment:double>>")
    found = held.select("doc_id", "key", F.explode(F.concat(none, *found)).alias("m")).select("doc_id", "key", "m.*")
    best = found.groupBy("doc_id", "key", "license").agg(F.max(F.struct("containment", (-F.col("word")).alias("back"))).alias("m"))
    best = best.groupBy("doc_id", "key").agg(F.sort_array(F.collect_list(F.struct("license", (-F.col("m.back")).alias("word"), F.col("m.containment").alias("containment")))).alias("matches"))
    names = F.transform("matches", lambda m: m["license"])
    out = rows.select("doc_id", "key").alias("r").join(best.alias("b"), F.col("r.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("r.key") == F.col("b.key")), "left")
    return out.select("r.doc_id", F.coalesce(F.size("matches"), F.lit(0)).cast("long").alias("n_licenses"), F.coalesce(F.array_join(names, ","), F.lit("")).alias("licenses"), F.coalesce(F.array_max(F.transform("matches", lambda m: m["containment"])), F.lit(0.0)).alias("best"), "matches")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir)).drop("matches")
