"""Licence scans: MinHash bands over overlapping text windows, then exact shingle containment. DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of a shingle and the share of a template's shingles that a match holds at least.
SHINGLE, CONTAINED = 5, 0.8
#: Shingles of a window, the step between windows, and bands of one MinHash each; windows_for() goes on by the same rule.
#: A template belongs to the shortest window that holds all its shingles, so it fills more than a quarter of it. Some
#: window lies within half a step of a whole copy, so its Jaccard similarity with the template is above 0.2 at the worst
#: and above 0.4 for templates of half a window; the chance that no band agrees is (1 - J) ** bands for each of the
#: windows that overlap the copy.
WINDOWS = ((1, 1, 1), (4, 1, 8), (16, 2, 16), (64, 8, 16), (256, 32, 16))
#: Tables of templates with fewer bands and shingles than this are broadcast, and looked for before anything is joined.
SMALL = 1 << 20

# The wording of common licence statements and notices.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MIT-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    "AGPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL-2.1-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
}

#: A word: letters, digits and what joins them; all else parts words.
_BREAK = r"[^\p{L}\p{N}]+"


def words_of(text: Column) -> Column:
    """Lower-case words of a text."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), _BREAK), lambda w: w != "")


def _shingles(words: Column) -> Column:
    """A hash of every five words in a row; none where there are fewer."""
    size = F.size(words)
    each = F.transform(F.sequence(F.lit(1), F.greatest(size - (SHINGLE - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(words, i, SHINGLE)))
    return F.when(size >= SHINGLE, each).otherwise(F.array().cast("array<bigint>"))


def windows_for(largest: int) -> list[tuple[int, int, int]]:
    """Window kinds up to one that holds ``largest`` shingles, so that a template of any length fits into some window."""
    kinds = list(WINDOWS)
    while kinds[-1][0] < largest:
        width = kinds[-1][0] * 4
        kinds.append((width, width // 8, WINDOWS[-1][2]))
    return kinds


def _shingled(templates: DataFrame) -> DataFrame:
    return templates.select("license", F.array_distinct(_shingles(words_of(F.col("body")))).alias("wanted")).where(F.size("wanted") > 0)


def _bands(shingles: Column, kind: Column, kinds: list[tuple[int, int, int]]) -> Column:
    """The smallest of the shingles under each of the kind's hash functions."""
    count = F.element_at(F.array(*(F.lit(b) for _, _, b in kinds)), kind + 1)
    return F.transform(F.sequence(F.lit(1), count), lambda k: F.array_min(F.transform(shingles, lambda x: F.struct(F.xxhash64(x, k).alias("h"), x.alias("x")))))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | DataFrame | None = None, contained: float = CONTAINED) -> DataFrame:
    """One row for each id and licence found: id, license, containment (the best of any window), n_windows.

    ``templates``: texts by name, or a table (license, body). A band agrees only where the window holds the shingle that
    is the template's smallest under that band's hash, so a text or window without any of these shingles is no candidate
    and is left before its bands are worked out. Windows of the other texts overlap; where a band of a window equals one
    of a template, the share of the template's shingles in the window and the windows around it is taken exactly. Null,
    empty and short texts match nothing; rows that share an id give one row a licence; an empty table, or no template of
    five words, gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    named = templates if isinstance(templates, DataFrame) else spark.createDataFrame(sorted((templates or TEMPLATES).items()), "license string, body string")
    table = _shingled(named)
    largest, held, many = table.agg(F.max(F.size("wanted")), F.sum(F.size("wanted")), F.count("*")).first()
    kinds = windows_for(largest or 1)
    small = (held or 0) + many * kinds[-1][2] < SMALL
    hint = F.broadcast if small else lambda df: df
    kind = reduce(lambda rest, k: F.when(F.size("wanted") <= kinds[k][0], k).otherwise(rest), reversed(range(len(kinds))), F.lit(len(kinds) - 1))
    table = table.select("license", "wanted", kind.alias("kind"))
    bands = table.select("license", "kind", F.posexplode(_bands(F.col("wanted"), F.col("kind"), kinds)).alias("band", "low")).select("license", "kind", "band", "low.h", "low.x")
    used = sorted(r.kind for r in table.select("kind").distinct().collect())  # one number for each kind of window
    anchors = F.array(*(F.lit(r.x) for r in bands.select("x").distinct().orderBy("x").collect())).cast("array<bigint>") if small else None

    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    # Each explode of one array keeps what it computes from being put into later filters, which would repeat it.
    rows = rows.select("id", F.explode(F.array(words_of(F.col("text")))).alias("words"))
    rows = rows.select("id", F.explode(F.array(_shingles(F.col("words")))).alias("shingles"))
    rows = rows.where(F.size("shingles") > 0 if anchors is None else F.arrays_overlap("shingles", anchors))
    size = F.size("shingles")
    of = lambda at: F.element_at(F.array(*(F.lit(k[at]) for k in kinds)), F.col("kind") + 1)
    windows = rows.select("id", "shingles", F.explode(F.array(*map(F.lit, used)).cast("array<int>")).alias("kind")).select("id", "shingles", "kind", of(1).alias("step"), of(0).alias("width"))
    windows = windows.select("id", "shingles", "kind", "width", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), size - F.col("width") + F.col("step")), F.col("step"))).alias("at"))
    around = F.slice("shingles", F.greatest(F.lit(1), F.col("at") - F.col("width")), F.col("width") * 2 + F.least(F.col("at"), F.col("width") + 1) - 1)
    windows = windows.select("id", "kind", "at", F.slice("shingles", F.col("at"), F.col("width")).alias("window"), around.alias("around"))
    if anchors is not None:
        windows = windows.where(F.arrays_overlap("window", anchors))
    found = windows.select("id", "kind", "at", "around", F.posexplode(_bands(F.col("window"), F.col("kind"), kinds)).alias("band", "low"))
    met = found.select("id", "kind", "at", "around", "band", F.col("low.h").alias("h")).join(hint(bands.select("license", "kind", "band", "h")), ["kind", "band", "h"])
    share = F.size(F.array_intersect("wanted", "around")) / F.size("wanted")
    scored = met.join(hint(table.select("license", "wanted")), "license").select("id", "license", "at", share.alias("containment")).where(F.col("containment") >= contained)
    return scored.groupBy("id", "license").agg(F.max("containment").alias("containment"), F.countDistinct("at").alias("n_windows")).withColumnRenamed("id", id_col)
