"""License scans: MinHash bands of text windows retrieve templates, exact containment of shingles confirms them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, documents, without
from .licence_texts import TEXTS

#: Names of licences and passages that state them: short lines, standard notices, and what the full text of
#: each holds; whole texts are in licence_texts. A passage that a kindred licence has with a word more is short, so that this word takes over a fifth of its
#: shingles; notices of the GNU licences name the family, as their version stands too far off.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("Apache-2.0", "\"License\" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document."),
    ("GPL", "under the terms of the GNU General Public License as published"),
    ("GPL", "received a copy of the GNU General Public License along with"),
    ("GPL-3.0", "The GNU General Public License is a free, copyleft license"),
    ("GPL-3.0", "This work is licensed under the GNU GPL v3."),
    ("GPL-2.0", "This License applies to any program or other work which"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL", "under the terms of the GNU Lesser General Public License as published"),
    ("LGPL", "under the terms of the GNU Library General Public License as published"),
    ("LGPL", "received a copy of the GNU Lesser General Public License along with"),
    ("LGPL-3.0", "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License"),
    ("LGPL-2.1", "This license, the Lesser General Public License, applies to some specially designated software packages--typically libraries"),
    ("AGPL", "under the terms of the GNU Affero General Public License as published"),
    ("AGPL", "received a copy of the GNU Affero General Public License along with"),
    ("AGPL-3.0", "The GNU Affero General Public License is a free, copyleft license"),
    ("BSD-2-Clause", "materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("ISC", "Licensed under the ISC License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "dedicated to the public domain under CC0 1.0 Universal."),
    ("CC0-1.0", "elects to apply CC0 to the Work and publicly distribute the Work under its terms"),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary"),
    ("MPL-2.0", "Mozilla Public License Version 2.0 1. Definitions"),
    ("MPL-2.0", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
)
SHINGLE = 3
#: One row a band: a window and a template of Jaccard similarity s meet in one of 24 bands with 1 - (1 - s)^24, which is
#: 0.995 for 0.2, the least that a template has with a window of twice its words that holds it whole.
BANDS = 24


def _words(text: Column) -> Column:
    """Words in lower case, without marks at either end."""
    return F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.lower(F.btrim(w, F.lit(".,;:()[]\"'!?*"))))


def _shingles(words: str) -> Column:
    last = F.size(words) - SHINGLE
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(SHINGLE)]))).otherwise(
        F.array().cast("array<bigint>"))


def _order(band: int):
    """The order of shingles in a band."""
    return lambda h: F.xxhash64(h, F.lit(band))


def _bands(shingles: Column) -> Column:
    """The MinHash of each band, with the band's number hashed in."""
    return F.array(*[F.xxhash64(F.lit(b), F.array_min(F.transform(shingles, _order(b)))) for b in range(BANDS)])


def _firsts(shingles: Column) -> Column:
    """The shingle that gives each band its MinHash."""

    def first(band: int) -> Column:
        return F.array_min(F.transform(shingles, lambda h: F.struct(_order(band)(h).alias("o"), h.alias("h"))))["h"]

    return F.array(*[first(b) for b in range(BANDS)])


def templates(spark: SparkSession, lines: tuple[tuple[str, str], ...] = TEMPLATES + TEXTS) -> DataFrame:
    """(lc_name, lc_line, lc_words, lc_set, lc_bands) of each line; as many rows as lines are given."""
    d = spark.createDataFrame(list(lines), "lc_name string, lc_line string").withColumn("lc_w", _words(F.col("lc_line")))
    d = d.withColumn("lc_set", F.array_distinct(_shingles("lc_w")))
    return d.select("lc_name", "lc_line", F.size("lc_w").alias("lc_words"), "lc_set", _bands(F.col("lc_set")).alias("lc_bands"))


def scan_licences(docs: DataFrame, lines: tuple[tuple[str, str], ...] = TEMPLATES + TEXTS, least: float = 0.8) -> DataFrame:
    """Documents with ``licences``: the sorted names of templates that the text holds.

    A template of k words is sought in windows of 2 k words, k apart, so that any place of it lies whole in one. A window
    retrieves a template if they agree in a MinHash band, and holds it if at least ``least`` of the template's distinct
    three-word shingles are in the window. Two sets agree in a band only where the window has the template's own least
    shingle of that band; windows without any such shingle are passed over, which loses none.

    Templates are a fixed list that goes into the plan; a template under three words is an error. Null text is empty and
    holds none. Rows that repeat are scanned each; extra columns stay, one named like the output is replaced. There is no
    shuffle; an empty table gives an empty table.
    """
    spark = docs.sparkSession
    own = templates(spark, lines)
    rows = own.withColumn("lc_firsts", _firsts(F.col("lc_set"))).collect()  # as many as there are lines
    if short := [r.lc_line for r in rows if r.lc_words < SHINGLE]:
        raise ValueError(f"templates under {SHINGLE} words: {short}")
    longs = lambda x: F.expr(f"array({', '.join(f'{v}L' for v in x)})")
    known = F.array(*[F.struct(F.lit(r.lc_name).alias("name"), F.lit(r.lc_words).alias("words"), longs(r.lc_set).alias("set"),
                               longs(r.lc_bands).alias("bands"), longs(sorted(set(r.lc_firsts))).alias("firsts")) for r in rows])
    seeds = longs(sorted({h for r in rows for h in r.lc_firsts}))
    d = without(docs, "licences").withColumn("lc_w", _words(F.coalesce("text", F.lit(""))))
    d = d.withColumn("lc_sh", _shingles("lc_w")).drop("lc_w")
    d = d.withColumn("lc_any", F.arrays_overlap("lc_sh", seeds))

    def holds(t: Column) -> Column:
        at = F.filter(F.sequence(F.lit(0), F.size("lc_sh") - 1), lambda i: F.array_contains(t["firsts"], F.get("lc_sh", i)))
        start = lambda i: F.floor(i / t["words"]).cast("int") * t["words"]
        begins = F.array_distinct(F.flatten(F.transform(at, lambda i: F.array(start(i), F.greatest(F.lit(0), start(i) - t["words"])))))
        window = lambda s: F.slice(F.col("lc_sh"), s + 1, 2 * t["words"] - SHINGLE + 1)
        return F.exists(begins, lambda s: F.arrays_overlap(_bands(window(s)), t["bands"])
                        & (F.size(F.array_intersect(window(s), t["set"])) >= F.size(t["set"]) * least))

    found = F.when(F.col("lc_any"), F.transform(F.filter(known, holds), lambda t: t["name"])).otherwise(F.array().cast("array<string>"))
    return d.withColumn("licences", F.array_sort(F.array_distinct(found))).drop("lc_sh", "lc_any")


def op8_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_licences(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", F.size("licences").cast("long").alias("n_licences"), F.array_join("licences", ",").alias("licences"))
