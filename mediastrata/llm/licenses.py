"""License scans (native): MinHash bands over overlapping windows retrieve templates, exact containment verifies.

A text's words (runs of letters and digits, lower-cased) give shingles of five words; a template of fewer words is one
shingle of its own length. Windows are runs of shingles that overlap by half, of a length that the template's length chooses
(CLASSES), so that several windows lie wholly in any passage that holds the template. A window's bands are its MinHash sketch: its few least
shingle hashes, one a band. Templates are cut into windows of the same lengths, at every offset or at a few, and their bands are a
broadcast table. An equi-join on the band retrieves (document, template); nothing else of a document is looked at.

What the settings guarantee, for a passage that holds at least 0.8 of a template's shingles: a window that the passage holds unchanged is a
window of the template, and all its bands are equal. Of a template of 24 shingles or more at least four text windows lie inside, which
hold 0.8 of their shingles on average; then the Jaccard similarity is 0.8 / 1.2, and a window's 4 bands all miss with a probability of
(1/3)^4, those of four windows with under 1e-7 if their misses were independent; longer templates have 8 bands. Windows of templates of fewer
shingles are single shingles, and their bands the template's least: as at most a fifth of its k shingles are missing, k / 5 + 1 of them always
retrieve it.

Then each retrieved pair is verified: of all windows as long as the template that begin with one of its shingles, those that hold
0.8 of its distinct shingles are matches, and matches that overlap are one passage.

Only DataFrame expressions run here. The templates are a parameter of bounded size. Of documents without a retrieved template no
row leaves its task; of the others, the shingles' hashes do.

Defined cases: a null, blank or short text has no matches; a text of any length is scanned whole; repeated rows each give their own;
an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mediastrata.llm.common import table

SHINGLE, CONTAINMENT = 5, 0.8
#: By the least number of a template's shingles: the windows' length, the steps from one window to the next in texts and in templates, and a window's bands.
CLASSES = ((1, 1, 1, 1, 1), (24, 8, 4, 1, 4), (96, 32, 16, 4, 8), (384, 128, 64, 16, 8))
# Wording of common licenses' notices.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("all-rights-reserved", "All rights reserved."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0-header", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'),
    ("apache-2.0-disclaimer", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'),
    ("mit", "Released under the MIT License."),
    ("mit-permission", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software'),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
)


def _let(value: str, name: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def _word_hashes(text: str) -> str:
    """SQL: the hashes of a text's words."""
    words = r"filter(split(lower(coalesce({}, '')), r'[^\p{{L}}\p{{N}}]+'), x -> x <> '')".format(text)
    return f"transform({words}, x -> xxhash64(x))"


def _shingles(words: str, n: int) -> str:
    """SQL: the hashes of an array of word hashes' shingles of n words."""
    empty = "cast(array() as array<bigint>)"
    return f"if(size({words}) < {n}, {empty}, transform(sequence(0, size({words}) - {n}), i -> xxhash64({', '.join(f'{words}[i + {k}]' for k in range(n))})))"


def _bands(shingles: str, length: int, step: int, bands: int) -> str:
    """SQL: the bands of all windows of an array of shingle hashes."""
    if length == 1:
        return shingles
    of_window = f"transform(slice(sort_array(slice({shingles}, at + 1, {length})), 1, {bands}), x -> xxhash64({length}, x))"
    every = f"flatten(transform(sequence(0, size({shingles}) - {length}, {step}), at -> {of_window}))"
    return f"if(size({shingles}) < {length}, cast(array() as array<bigint>), {every})"


def template_table(spark: SparkSession, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """(license, n, m, k, g): shingle length, numbers of shingles and of distinct ones, and the shingles in order."""
    words = spark.createDataFrame(list(templates), "license string, text string").select("license", F.expr(_word_hashes("text")).alias("w")).where(F.size("w") > 0)
    n = F.least(F.lit(SHINGLE), F.size("w"))
    cases = "case n " + " ".join(f"when {k} then {_shingles('w', k)}" for k in range(1, SHINGLE + 1)) + " end"
    return words.withColumn("n", n).withColumn("g", F.expr(cases)).select("license", "n", F.size("g").alias("m"), F.size(F.array_distinct("g")).alias("k"), "g")


def _class_of(m: int) -> tuple[int, int, int, int, int]:
    return [c for c in CLASSES if c[0] <= m][-1]


def template_bands(wanted: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """(license, band): single shingles, as many of the least as can't all be missing, and the bands of longer templates' windows."""
    few = F.floor(F.col("k") * F.lit(1 - containment) + F.lit(1e-9)).cast("int") + 1
    parts = [wanted.where(F.col("m") < CLASSES[1][0]).select("license", F.explode(F.slice(F.sort_array(F.array_distinct("g")), F.lit(1), few)).alias("band"))]
    for (least, length, _, step, bands), (beyond, *_) in zip(CLASSES[1:], [*CLASSES[2:], (1 << 31,)], strict=True):
        own = wanted.where((F.col("m") >= least) & (F.col("m") < beyond))
        parts.append(own.select("license", F.explode(F.expr(_bands("g", length, step, bands))).alias("band")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out.distinct()


def retrieve(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, containment: float = CONTAINMENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame | None:
    """(row, id, license, g) for each document and template that share a band; g: the document's shingles of the template's length."""
    wanted = template_table(docs.sparkSession, templates)
    sizes = {(r["n"], _class_of(r["m"])) for r in wanted.select("n", "m").distinct().collect()}  # the templates' lengths: a parameter
    if not sizes:
        return None
    lengths = sorted({n for n, _ in sizes})
    shingles = ", ".join(f"'g{n}', {_shingles('h', n)}" for n in lengths)
    bands = ", ".join(_bands("x.g" + str(n), length, step, count) for n, (_, length, step, _, count) in sorted(sizes))
    both = _let(f"named_struct({shingles})", "x", f"named_struct('s', x, 'bands', array_distinct(concat({bands}, cast(array() as array<bigint>))))")
    # Beside a number that isn't deterministic, so that no filter on the bands' size is pushed below, where it would compute them once more.
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.monotonically_increasing_id().alias("row"), F.expr(_let(_word_hashes(f"`{text_col}`"), "h", both)).alias("x"))
    # The explode's argument is a bare column: so it and the join run in one generated loop, which copies no shingles for bands that match nothing.
    each = rows.select("id", "row", "x.s", "x.bands").select("id", "row", "s", F.explode("bands").alias("band"))
    known = template_bands(wanted, containment).join(wanted.select("license", "n"), "license").select(F.col("band").alias("its"), "license", "n")
    hits = each.join(F.broadcast(known), F.col("band") == F.col("its"))  # broadcast: bands of the templates, which are a parameter
    own = F.expr("case n " + " ".join(f"when {n} then s.g{n}" for n in lengths) + " end")
    return hits.select("row", "id", "license", own.alias("g")).groupBy("row", "license").agg(F.first("id").alias("id"), F.first("g").alias("g"))


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, containment: float = CONTAINMENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per passage: the document's id, license, first_word (from 0), and the containment of its best window."""
    found = retrieve(docs, templates, containment, id_col, text_col)
    if found is None:
        return docs.select(F.col(f"`{id_col}`").alias(id_col)).withColumns({"license": F.lit(""), "first_word": F.lit(0).cast("bigint"), "containment": F.lit(0.0)}).limit(0)
    wanted = template_table(docs.sparkSession, templates)
    own = wanted.select(F.col("license").alias("of"), "m", "k", F.explode(F.array_distinct("g")).alias("its"))
    each = found.select("row", "license", "id", F.posexplode("g").alias("pos", "h"))
    shared = each.join(F.broadcast(own), (F.col("license") == F.col("of")) & (F.col("h") == F.col("its")))  # broadcast: the templates' shingles
    held = shared.groupBy("row", "license", "id", "m", "k").agg(F.sort_array(F.collect_list(F.struct("pos", "h"))).alias("p"))
    need = f"cast(ceil(k * {containment} - 1e-9) as int)"
    inside = "size(array_distinct(transform(filter(slice(q, i + 1, m), y -> y.pos < x.pos + m), y -> y.h))) / k"
    window = f"if(i + {need} <= size(q) and q[i + {need} - 1].pos < x.pos + m, {inside}, 0.0D)"
    windows = _let("transform(p, y -> y)", "q", f"filter(transform(q, (x, i) -> struct(x.pos as start, {window} as containment)), w -> w.containment >= {containment})")
    hits = held.select("row", "license", "id", "m", F.explode(F.expr(windows)).alias("w")).select("row", "license", "id", "m", "w.*")
    along = Window.partitionBy("row", "license").orderBy("start")
    new = F.coalesce((F.col("start") - F.lag("start").over(along) >= F.col("m")).cast("int"), F.lit(0))
    grouped = hits.withColumn("new", new).withColumn("passage", F.sum("new").over(along))
    out = grouped.groupBy("row", "license", "passage").agg(F.first("id").alias("id"), F.min("start").cast("bigint").alias("first_word"), F.max("containment").alias("containment"))
    return out.select(F.col("id").alias(id_col), "license", "first_word", "containment")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _sql() -> str:
    values = ", ".join("('{}', '{}')".format(k, t.replace("'", "''")) for k, t in TEMPLATES)
    return rf"""WITH templates(license, text) AS (VALUES {values}),
tw AS (SELECT license, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM templates),
tn AS (SELECT license, w, least(5, len(w)) AS n, len(w) - least(5, len(w)) + 1 AS m FROM tw),
ts AS (SELECT DISTINCT license, n, m, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT *, unnest(range(1, m + 1)) AS i FROM tn)),
k AS (SELECT license, count(*) AS k FROM ts GROUP BY license),
dw AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+') AS w FROM documents),
ds AS (SELECT doc_id, n, i - 1 AS pos, array_to_string(w[i:i + n - 1], ' ') AS s
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, (SELECT DISTINCT n FROM tn) WHERE len(w) >= n)),
hit AS (SELECT ds.doc_id, ts.license, ts.m, ds.pos, ds.s FROM ds JOIN ts ON ds.n = ts.n AND ds.s = ts.s),
c AS (SELECT a.doc_id, a.license, a.m, a.pos, count(DISTINCT b.s) AS found
      FROM hit a JOIN hit b ON a.doc_id = b.doc_id AND a.license = b.license AND b.pos >= a.pos AND b.pos < a.pos + a.m GROUP BY ALL),
f AS (SELECT c.*, found / k AS containment FROM c JOIN k USING (license) WHERE found / k >= 0.8),
g AS (SELECT *, coalesce(pos - lag(pos) OVER (PARTITION BY doc_id, license ORDER BY pos) >= m, false) AS new FROM f),
p AS (SELECT *, sum(new::int) OVER (PARTITION BY doc_id, license ORDER BY pos) AS passage FROM g)
SELECT doc_id, license, min(pos) AS first_word, max(containment) AS containment FROM p GROUP BY doc_id, license, passage"""


SQL = _sql()
