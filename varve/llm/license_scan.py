"""License scan with DataFrame functions only: min-hash bands over overlapping windows of word shingles retrieve templates,
exact shingle containment verifies them.

Every sub-window of a template is indexed. A template of fewer than LONG shingles uses windows of one shingle, whose only min-hash
is itself, so each shared shingle retrieves it. Longer ones use windows of WINDOW shingles; a text's windows
start at every STRIDE-th shingle, so any verbatim run of WINDOW + STRIDE - 1 shingles holds a whole window and collides
with certainty, and an edited window of similarity s collides with probability 1 - (1 - s)^BANDS (0.94 at one half).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHINGLE = 5
LONG = 16
WINDOW, STRIDE, BANDS = 8, 4, 4
CONTAINMENT = 0.75
#: Templates that one scan takes at most; with it the broadcast index is bounded.
MAX_TEMPLATES = 1000
NOT_WORD = r"[^\p{L}\p{N}]+"

#: Notices of common licenses.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "agpl-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "bsd-2-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-3-clause": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-nc-4.0-long": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc-by-nd-4.0": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "gpl-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "lgpl": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
    "mit": "Released under the MIT License.",
    "mit-licensed": "Licensed under the MIT License.",
    "mit-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD), lambda w: w != "")


def shingles_of(words: Column) -> Column:
    """64-bit hashes of the SHINGLE-word runs, in order."""

    def of(w: Column) -> Column:
        return F.when(F.size(w) >= SHINGLE, F.transform(F.sequence(F.lit(0), F.size(w) - SHINGLE), lambda i: F.xxhash64(*(w[i + k] for k in range(SHINGLE))))).otherwise(F.array().cast("array<bigint>"))

    return F.transform(F.array(words), of)[0]


def window_keys(shingles: Column, stride: int) -> Column:
    """Band keys of the windows of WINDOW shingles that start at every stride-th shingle."""

    def keys(i: Column) -> Column:
        part = F.slice(shingles, i, WINDOW)
        return F.array(*(F.xxhash64(F.array_min(F.transform(part, lambda x, b=b: F.xxhash64(x, F.lit(b)))), F.lit(b)) for b in range(BANDS)))

    return F.when(F.size(shingles) >= WINDOW, F.flatten(F.transform(F.sequence(F.lit(1), F.size(shingles) - WINDOW + 1, F.lit(stride)), keys))).otherwise(F.array().cast("array<bigint>"))


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, license, n_shingles (of the template), n_found, containment, first_word (0-based) per document and template contained.

    Contained: at least the given share of the template's distinct shingles occurs in the text. Null, empty and short texts match nothing; a text that
    repeats a notice is reported once per template; rows that repeat id and text are reported once. An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    long_enough = {k: v for k, v in templates.items() if len(re.findall(r"[^\W_]+", v)) >= SHINGLE}
    if len(templates) > MAX_TEMPLATES or len(long_enough) < len(templates):
        raise ValueError(f"a scan takes at most {MAX_TEMPLATES} templates of {SHINGLE} words or more")
    known = spark.createDataFrame(list(templates.items()), "license string, body string").select("license", F.array_distinct(shingles_of(words_of(F.col("body")))).alias("wanted"))
    keyed = known.select("license", "wanted", F.explode(F.array_distinct(F.when(F.size("wanted") < LONG, F.col("wanted")).otherwise(window_keys(F.col("wanted"), 1)))).alias("key"))
    index = [(r.license, r.key) for r in keyed.select("license", "key").collect()]  # a few keys per template word
    keys = sorted({k for _, k in index})
    hashed = shingles_of(words_of(F.col("text")))

    def hits(s: Column) -> Column:
        return F.array_distinct(F.concat(F.filter(s, lambda x: x.isin(keys)), F.filter(window_keys(s, STRIDE), lambda x: x.isin(keys))))

    owners: dict[int, list[str]] = {}
    for license, key in index:
        owners.setdefault(key, []).append(license)
    lookup = F.create_map(*(x for k, v in sorted(owners.items()) for x in (F.lit(k), F.array(*map(F.lit, sorted(set(v)))))))

    found = docs.select("doc_id", "text", F.transform(F.array(hashed), hits)[0].alias("hits")).filter(F.size("hits") > 0)
    pairs = found.select("doc_id", "text", F.explode(F.array_distinct(F.flatten(F.transform("hits", lambda k: F.element_at(lookup, k))))).alias("license"))
    checked = pairs.join(F.broadcast(known), "license").withColumn("shingles", hashed)
    both = F.size(F.array_intersect("wanted", "shingles"))
    out = checked.select("doc_id", F.xxhash64("text").alias("body"), "license", F.size("wanted").cast("long").alias("n_shingles"), both.cast("long").alias("n_found"), (both / F.size("wanted")).alias("containment"), F.array_min(F.transform("wanted", lambda x: F.nullif(F.array_position("shingles", x), F.lit(0)))).alias("at"))
    out = out.filter(F.col("containment") >= containment).withColumn("first_word", (F.col("at") - 1).cast("long"))
    return out.distinct().select("doc_id", "license", "n_shingles", "n_found", "containment", "first_word")  # repeated rows, told by the text's hash


def oracle(templates: dict[str, str] = TEMPLATES, containment: float = CONTAINMENT) -> str:
    """The same result in DuckDB's SQL, from the shingles themselves."""
    rows = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in templates.items())
    words = "list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
    return f"""
WITH t(license, body) AS (VALUES {rows}),
tw AS (SELECT license, {words.format("body")} AS w FROM t),
ts AS (SELECT DISTINCT license, array_to_string(list_slice(w, i, i + {SHINGLE - 1}), ' ') AS s FROM tw, unnest(range(1, len(w) - {SHINGLE - 2})) AS r(i)),
tn AS (SELECT license, count(*) AS n FROM ts GROUP BY license),
dw AS (SELECT DISTINCT doc_id, text, {words.format("text")} AS w FROM documents),
ds AS (SELECT doc_id, text, i, array_to_string(list_slice(w, i, i + {SHINGLE - 1}), ' ') AS s FROM dw, unnest(range(1, len(w) - {SHINGLE - 2})) AS r(i)),
hit AS (SELECT d.doc_id, d.text, t.license, count(DISTINCT d.s) AS n_found, min(d.i) - 1 AS first_word FROM ds d JOIN ts t ON d.s = t.s GROUP BY ALL)
SELECT doc_id, license, n AS n_shingles, n_found, n_found::DOUBLE / n AS containment, first_word
FROM hit JOIN tn USING (license) WHERE n_found::DOUBLE / n >= {containment}"""
