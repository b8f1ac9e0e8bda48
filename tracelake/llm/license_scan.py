"""License scans: MinHash bands over overlapping text windows, then exact shingle containment.

A text's words (letters and digits, lower-cased) make shingles of five words. A window begins at every shingle and holds `WINDOW` of
them (fewer at the end of the text). Under each of `BANDS` hash orders a window and a template have one least shingle; a window whose
least shingle is a template's retrieves that template. Bands have one row, and windows are short, so that even a
template of one shingle is met: it is the least shingle of one of its windows with probability 2 / (WINDOW + 1), so
all bands miss it with probability (1/2)^12 = 2.4e-4. A copy that holds a share c of a longer template's shingles has
that template's least one under an order with probability c; inside the copy its windows hold template shingles alone, so it is
their least, and at c = 0.8 all bands miss it with probability 0.2^12 = 4e-9. Retrieved templates are verified by the share of their shingles that the text has. Every text is
windowed; all work is done by built-in functions.

Defined cases: a null or empty text, and one of under five words, has no shingle, no window and no license;
templates are reported in order of their names; repeated rows are scanned each; extra columns of any name are
carried along, for the result is one struct column with a free name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm.common import free_name, settle, table

SHINGLE = 5
WINDOW = 3
BANDS = 12
CONTAINMENT = 0.8

#: Wording of license notices by name.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution. "
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, "
        "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS "
        "BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS "
        "OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, "
        "OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution. "
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
        "without specific prior written permission. "
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, "
        "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS "
        "BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS "
        "OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, "
        "OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        "copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO "
        "THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, "
        "OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER "
        "TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "MIT": "Released under the MIT License.",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal "
        "in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice "
        "and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY "
        "KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT "
        "SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING "
        "FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this "
        "software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    ),
    "Zlib": (
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use "
        "of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute "
        "it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original "
        "software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. Altered source "
        "versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any "
        "source distribution."
    ),
}


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _part(a: Column, begin: int, n: Column) -> Column:
    return F.slice(a, F.lit(begin), F.greatest(n, F.lit(0)))


def pairs_of(words: Column) -> Column:
    n = F.size(words)
    return F.zip_with(_part(words, 1, n - 1), _part(words, 2, n - 1), lambda a, b: F.xxhash64(a, b))


def shingles_of(words: Column, pairs: Column) -> Column:
    """Hash of every run of five words; `words` and `pairs` must be columns."""
    n = F.size(words) - (SHINGLE - 1)
    four = F.zip_with(_part(pairs, 1, n), _part(pairs, 3, n), lambda a, b: F.xxhash64(a, b))
    return F.zip_with(four, _part(words, SHINGLE, n), lambda a, b: F.xxhash64(a, b))


def order_of(shingles: Column, band: int) -> Column:
    return F.transform(shingles, lambda h: F.xxhash64(h, F.lit(band)))


def bound(value: Column, use) -> Column:
    """use(value) with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def window_minima(shingles: Column, band: int) -> Column:
    """Least hash of every window under an order; `least` passes over what a window lacks at the text's end."""
    n = F.size(shingles)
    least = lambda a, b: F.zip_with(a, b, lambda x, y: F.least(x, y))

    def of(a: Column) -> Column:
        out = a
        for k in range(2, WINDOW + 1):
            out = least(out, F.slice(a, F.lit(k), n))
        return out

    return bound(order_of(shingles, band), of)


def minima(shingles: Column) -> Column:
    """Least hash of all shingles under each order."""
    return F.array(*(F.array_min(order_of(shingles, j)) for j in range(BANDS)))


def template_table(spark: SparkSession, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """license, shingles and keys of each template; as small as the list of templates."""
    rows = spark.createDataFrame(sorted(templates.items()), "license string, _text string").select("license", words_of(F.col("_text")).alias("w"))
    rows = rows.select("license", "w", pairs_of(F.col("w")).alias("p"))
    rows = rows.select("license", F.array_distinct(shingles_of(F.col("w"), F.col("p"))).alias("shingles"))
    return rows.filter(F.size("shingles") > 0).select("license", "shingles", minima(F.col("shingles")).alias("keys"))


def _constant(values: list[int]) -> Column:
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>") if values else F.array().cast("array<bigint>")


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> tuple[DataFrame, str]:
    """docs with one more struct column, and its name: n_words, n_windows, licenses (name and containment), license."""
    known = template_table(docs.sparkSession, templates).collect()
    names = [free_name(docs, x) for x in ("_license", "_words", "_pairs", "_shingles", "_keys")]
    name, w, p, s, keys = names
    rows = docs.withColumn(w, words_of(F.col("text"))).withColumn(p, pairs_of(F.col(w)))
    rows = rows.withColumn(s, shingles_of(F.col(w), F.col(p)))
    met = [F.array_intersect(window_minima(F.col(s), j), _constant(sorted({t["keys"][j] for t in known}))) for j in range(BANDS)]
    rows = rows.withColumn(keys, F.flatten(F.array(*met)))
    checks = [
        F.when(
            F.arrays_overlap(F.col(keys), _constant(t["keys"])),
            F.struct(F.lit(t["license"]).alias("license"), (F.size(F.array_intersect(F.col(s), _constant(t["shingles"]))) / F.lit(float(len(t["shingles"])))).alias("containment")),
        )
        for t in known
    ]
    kind = "array<struct<license: string, containment: double>>"
    verified = F.filter(F.array_compact(F.array(*checks)), lambda x: x["containment"] >= CONTAINMENT) if checks else F.array()
    none = F.array().cast(kind)
    found = F.when(F.size(keys) > 0, verified.cast(kind)).otherwise(none)
    out = F.struct(F.size(w).cast("long").alias("n_words"), F.size(s).cast("long").alias("n_windows"), found.alias("licenses"))
    return settle(rows, name, out, names[1:]), name


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its words, windows, and the licenses it states."""
    rows, found = scan(table(spark, sf_dir, "documents"))
    x = F.col(found)
    return rows.select(
        "doc_id", x["n_words"].alias("n_words"), x["n_windows"].alias("n_windows"), F.size(x["licenses"]).cast("long").alias("n_licenses"),
        F.array_join(x["licenses"]["license"], ",").alias("licenses"), F.coalesce(F.round(F.array_max(x["licenses"]["containment"]), 6), F.lit(0.0)).alias("containment"),
    )


def oracle(templates: dict[str, str] = TEMPLATES) -> str:
    """DuckDB SQL of op1_license_scan: shingles are looked for as words between blanks, without hashes."""
    import re

    found = []
    for name, text in sorted(templates.items()):
        w = [x for x in re.split(r"[^a-z0-9]+", text.lower()) if x]
        parts = sorted({" ".join(w[k : k + SHINGLE]) for k in range(len(w) - SHINGLE + 1)})
        hits = " + ".join(f"CAST(contains(s, ' {x} ') AS INTEGER)" for x in parts)
        found.append(f"{{'license': '{name}', 'c': ({hits}) / CAST({len(parts)} AS DOUBLE)}}")
    return rf"""
WITH t AS (SELECT doc_id, ' ' || trim(regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) || ' ' AS s FROM documents),
n AS (SELECT doc_id, s, CASE WHEN trim(s) = '' THEN 0 ELSE len(string_split(trim(s), ' ')) END AS n_words FROM t),
f AS (SELECT doc_id, n_words, greatest(n_words - {SHINGLE - 1}, 0) AS k, list_filter([{", ".join(found)}], lambda x: x.c >= {CONTAINMENT}) AS l FROM n)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(k AS BIGINT) AS n_windows, CAST(len(l) AS BIGINT) AS n_licenses,
  array_to_string(list_transform(l, lambda x: x.license), ',') AS licenses, coalesce(round(list_max(list_transform(l, lambda x: x.c)), 6), 0.0) AS containment
FROM f"""
