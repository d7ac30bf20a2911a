"""License scans: Dice coefficient over word bigrams between licence templates and a text's lines, the text as a whole, and windows of its words.

Text is normalised to lower case with one blank for all that isn't a letter or digit. A template with b distinct bigrams can
reach a Dice coefficient t only with units of t/(2-t) b to (2-t)/t b distinct bigrams, which leaves few templates for a unit before any
bigrams are compared. A notice wrapped over lines or within a longer line is found by windows: where neither the text as a whole nor the line matches,
each run of such lines is a further unit, scored by its best window. Windows begin at a bigram of the template, and only templates of which
the text holds t/(2-t) of the bigrams are tried. Several notices in one run count as one match. All is one projection of Spark's own functions: no shuffle, no Python.

Defined cases: a null, empty or one-word text has no bigrams and no licence (null, score 0, 0 matches); ties go to the earlier template;
repeated rows are alike; a null doc_id is kept; extra columns are ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality import let

THRESHOLD = 0.8

#: (licence, text): usual one-line notices and the full short texts.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    (
        "MIT",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
)


def normalised(text: str) -> list[str]:
    return re.sub(r"[\W_]+", " ", text.lower()).split()


def grams(text: str) -> list[str]:
    words = normalised(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def bigrams(unit: Column) -> Column:
    """The distinct word bigrams of a text, as hashes of their normalised words."""
    bare = F.trim(F.regexp_replace(F.lower(unit), r"[^\p{L}\p{N}]+", " "))
    pairs = lambda w: F.when(F.array_size(w) < 2, F.array().cast("array<bigint>")).otherwise(F.array_distinct(F.transform(F.slice(w, 1, F.array_size(w) - 1), lambda a, i: F.xxhash64(a, F.get(w, i + 1)))))
    return let(F.split(bare, " "), pairs)


def sequence(unit: Column) -> Column:
    """The word bigrams of a text in their order, repeated ones too, as the hashes of ``bigrams``."""
    bare = F.trim(F.regexp_replace(F.lower(unit), r"[^\p{L}\p{N}]+", " "))
    pairs = lambda w: F.when(F.array_size(w) < 2, F.array().cast("array<bigint>")).otherwise(F.transform(F.slice(w, 1, F.array_size(w) - 1), lambda a, i: F.xxhash64(a, F.get(w, i + 1))))
    return let(F.split(bare, " "), pairs)


def widths(text: str, threshold: float) -> list[int]:
    """How many bigrams the windows for a template hold: its own number, and steps of an eighth over all that can reach the threshold."""
    own, distinct = len(normalised(text)) - 1, len(grams(text))
    return sorted({own, *range(math.ceil(threshold / (2 - threshold) * distinct), math.floor((2 - threshold) / threshold * own) + 1, max(1, own // 8))})


def scan(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, the best licence (null if none reaches the threshold), its score and the number of units that match one."""
    fields = lambda i, text, g: (F.lit(i).alias("i"), F.lit(len(g)).alias("n"), F.array(*(F.xxhash64(*(F.lit(w) for w in x.split(" "))) for x in g)).alias("g"), F.array(*map(F.lit, widths(text, threshold))).alias("w"))
    table = F.array(*(F.struct(*fields(i, text, grams(text))) for i, (_, text) in enumerate(templates)))
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold

    def dice(g: Column, t: Column) -> Column:
        return F.struct((2.0 * F.array_size(F.array_intersect(g, t["g"])) / (F.array_size(g) + t["n"])).alias("score"), (-t["i"]).alias("order"))

    def best(g: Column) -> Column:
        n = F.array_size(g)
        fit = F.filter(F.col("_table"), lambda t: (n >= low * t["n"]) & (n <= high * t["n"]))
        return F.array_max(F.filter(F.transform(fit, lambda t: dice(g, t)), lambda d: d["score"] >= threshold))

    def possible(g: Column) -> Column:
        """The templates of which the text holds the share of bigrams that any matching window must hold."""
        return let(F.array_intersect(g, F.col("_known")), lambda k: F.filter(F.col("_table"), lambda t: F.array_size(F.array_intersect(k, t["g"])) >= low * t["n"]))

    def windows(s: Column, t: Column) -> Column:
        """The best window of a bigram sequence that begins at one of the template's bigrams."""
        starts = F.filter(F.sequence(F.lit(1), F.array_size(s)), lambda p: F.array_contains(t["g"], F.get(s, p - 1)))
        at = lambda p: F.array_max(F.transform(t["w"], lambda w: dice(F.array_distinct(F.slice(s, p, w)), t)))
        return F.array_max(F.transform(starts, at))

    def within(run: Column) -> Column:
        found = let(sequence(run), lambda s: F.when(F.array_size(s) > 0, F.array_max(F.transform(F.col("_whole")["left"], lambda t: windows(s, t)))))
        return let(found, lambda d: F.when(d["score"] >= threshold, d))

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    known = F.array_distinct(F.flatten(F.transform("_table", lambda t: t["g"])))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), table.alias("_table")).withColumn("_known", known)
    lines = F.split("text", "\n")
    by_line = let(lines, lambda x: F.when(F.array_size(x) > 1, F.transform(x, lambda u: let(bigrams(u), best))).otherwise(F.array_repeat(best(F.array().cast("array<bigint>")), 0)))
    whole = let(bigrams(F.col("text")), lambda g: F.struct(best(g).alias("hit"), possible(g).alias("left")))
    rows = rows.select("doc_id", "text", by_line.alias("_lines"), whole.alias("_whole"))
    # a mark stands for each line that matches by itself, so that its words aren't found again
    left = F.transform(lines, lambda u, i: F.when(F.get(F.col("_lines"), i).isNotNull(), F.lit("\x01")).otherwise(F.translate(u, "\x01", " ")))
    search = F.col("_whole")["hit"].isNull() & (F.array_size(F.col("_whole")["left"]) > 0)
    runs = F.when(search, F.transform(F.split(F.array_join(left, "\n"), "\x01"), within)).otherwise(F.slice("_lines", 1, 0))
    hits = F.filter(F.concat(F.array_append("_lines", F.col("_whole")["hit"]), runs), lambda h: h.isNotNull())
    found = rows.select("doc_id", hits.alias("hits"))
    top = F.array_max("hits")
    names = F.array(*(F.lit(name) for name, _ in templates))
    return found.select("doc_id", F.get(names, -top["order"]).alias("license"), F.coalesce(top["score"], F.lit(0.0)).alias("score"), F.array_size("hits").cast("long").alias("n_matches"))
