"""Licence scan: sparse TF-IDF cosine of notices to templates, then inheritance along directories.

Built-in functions only. Every line of every text is held against short licence templates. Document
frequencies of the template terms are counted over all texts; a term outside the templates weighs
as much as a term that no text holds. By the Cauchy-Schwarz bound a line can only reach the threshold
with a template if it holds one of the template's heaviest terms (as many as leave less than
threshold squared of its squared weight), so a line without any of these anchors is left out
without loss. The remaining lines are exploded to terms, joined with the template weights (a fixed
table), and summed by line and template. A text without a notice takes the licence of the nearest
directory above it that holds a licence file, by an equi-join of its ancestor paths.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from pairloom.llm.rows import stored
from pairloom.session import join_bounded

# Common short notices by SPDX-like name.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    ],
    "MIT": [
        "Released under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    ],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted"],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3"],
    "LGPL-3.0": ["This library is licensed under the GNU Lesser General Public License, version 3"],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0"],
    "CC0-1.0": ["Released into the public domain under CC0 1.0"],
    "Unlicense": ["This is free and unencumbered software released into the public domain"],
    "proprietary": ["All rights reserved"],
}
LICENCE_FILE = r"(?i)(^|/)(licen[sc]e|copying|unlicense|notice)([.-][^/]*)?$"


def terms_of(text: Column) -> Column:
    """Lower-case words of letters and digits, in order."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _template_terms() -> list[tuple[str, int, list[str]]]:
    import re

    return [(name, k, re.findall(r"\w+", text.lower())) for name, texts in TEMPLATES.items() for k, text in enumerate(texts)]


def weigh_templates(texts: DataFrame, threshold: float) -> tuple[list[tuple], dict[str, float], float, list[str]]:
    """Unit vectors of the templates, weights of their terms, the weight of other terms, and the anchors."""
    templates = _template_terms()
    vocabulary = sorted({w for _, _, words in templates for w in words})
    known = F.array(*[F.lit(w) for w in vocabulary])
    present = texts.select(F.explode(F.array_intersect(F.array_distinct(terms_of(F.col("_text"))), known)).alias("term"))
    counts = {r["term"]: r["count"] for r in present.groupBy("term").count().collect()}  # at most the vocabulary
    n = texts.count()
    idf = {w: math.log((1 + n) / (1 + counts.get(w, 0))) + 1 for w in vocabulary}
    rows, anchors = [], set()
    for name, k, words in templates:
        weight = {w: words.count(w) * idf[w] for w in set(words)}
        norm = math.sqrt(sum(v * v for v in weight.values()))
        rest = 1.0
        for w in sorted(weight, key=lambda w: (-weight[w], w)):
            if rest < threshold * threshold:
                break
            anchors.add(w)
            rest -= (weight[w] / norm) ** 2
        rows += [(name, k, w, v / norm) for w, v in sorted(weight.items())]
    return rows, idf, math.log(1 + n) + 1, sorted(anchors)


def notices(texts: DataFrame, threshold: float) -> DataFrame:
    """`_key, line, licence, score`: the best template of each line that reaches the threshold.

    `texts` holds `_key` and `_text`.
    """
    spark = texts.sparkSession
    weights, idf, other, anchors = weigh_templates(texts, threshold)
    has_anchor = r"(?i)(?<![\p{L}\p{N}])(" + "|".join(anchors) + r")(?![\p{L}\p{N}])"
    lines = (
        texts.filter(F.col("_text").rlike(has_anchor))
        .select("_key", F.posexplode(F.split("_text", "\n", -1)).alias("line", "_line"))
        .filter(F.col("_line").rlike(has_anchor))
    )
    words = lines.select("_key", "line", F.explode(terms_of(F.col("_line"))).alias("term"))
    counted = words.groupBy("_key", "line", "term").agg(F.count(F.lit(1)).alias("_tf"))
    table = spark.createDataFrame(weights, "licence string, variant int, term string, w double")
    weight_of = spark.createDataFrame(sorted(idf.items()), "term string, idf double")
    weighed = counted.join(F.broadcast(weight_of), "term", "left").withColumn("_w", F.col("_tf") * F.coalesce("idf", F.lit(other)))
    norms = weighed.groupBy("_key", "line").agg(F.sqrt(F.sum(F.col("_w") * F.col("_w"))).alias("_norm"))
    products = weighed.join(F.broadcast(table), "term").groupBy("_key", "line", "licence", "variant").agg(F.sum(F.col("_w") * F.col("w")).alias("_dot"))
    scored = products.join(norms, ["_key", "line"]).withColumn("score", F.round(F.col("_dot") / F.col("_norm"), 9))
    return (
        scored.filter(F.col("score") >= threshold)
        .groupBy("_key", "line")
        .agg(F.min(F.struct((-F.col("score")).alias("_less"), "licence")).alias("_best"))
        .select("_key", "line", F.col("_best.licence").alias("licence"), (-F.col("_best._less")).alias("score"))
    )


def ancestors(path: Column) -> Column:
    """The directories above a path, nearest first; '' is the root."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.size(parts) - 1, F.lit(0), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def scan_licences(
    df: DataFrame,
    path: str = "path",
    text: str = "text",
    file_id: str = "file_id",
    licence_file: Column | None = None,
    threshold: float = 0.6,
    header_line: int | None = None,
) -> DataFrame:
    """`file_id, path, licence, score, origin, directory` for every row of `df`.

    `origin` is `own` (a notice in the text: the best score, then the earlier line, then the name),
    `inherited` (the nearest directory above with a licence file, given in `directory`; of several licence files in one directory
    the best score, then the name) or `none` (licence null). A licence file is a row with a notice
    for which `licence_file` holds (default: its name is LICENSE, COPYING, NOTICE and the like), and
    whose notice is in line `header_line` if that is given. Null texts have no notice, null paths inherit from the
    root only; rows with a null id are returned without a licence of their own; repeated rows are judged alike; an empty table gives an
    empty table; other columns are ignored, whatever their names.
    """
    is_file = F.col(path).rlike(LICENCE_FILE) if licence_file is None else licence_file
    files = df.select(
        F.col(file_id).alias("_id"), F.coalesce(F.col(path), F.lit("")).alias("_path"), F.coalesce(F.col(text), F.lit("")).alias("_text"),
        F.coalesce(is_file, F.lit(False)).alias("_file"),
    )
    # written once: the texts are read for the term counts and for the notices, the rest without them
    keyed = stored(files.withColumn("_key", F.xxhash64(F.lit(41), "_path", "_text")))
    texts = keyed.filter("_text <> ''").select("_key", "_text")
    found = stored(notices(texts, threshold).distinct())
    rank = F.struct((-F.col("score")).alias("_less"), "line", "licence")
    best = found.groupBy("_key").agg(F.min(rank).alias("_own"))
    plain = keyed.drop("_text")
    owned = stored(
        join_bounded(plain, best, ["_key"], "left").select(
            "_id", "_path", "_file", "_key", F.col("_own.licence").alias("_licence"), (-F.col("_own._less")).alias("_score")
        )
    )
    heads = found if header_line is None else found.filter(F.col("line") == header_line)
    covering = owned.filter("_file").select("_key", "_path").distinct().join(heads, "_key")
    directories = covering.groupBy(ancestors(F.col("_path"))[0].alias("_dir")).agg(
        F.min(F.struct((-F.col("score")).alias("_less"), "licence")).alias("_of")
    )
    bare = owned.filter("_licence IS NULL")
    places = bare.select("_path").distinct().select("_path", F.posexplode(ancestors(F.col("_path"))).alias("_up", "_dir"))
    nearest = (
        join_bounded(places, directories, ["_dir"])
        .groupBy("_path")
        .agg(F.min(F.struct("_up", "_dir", F.col("_of.licence").alias("licence"), (-F.col("_of._less")).alias("score"))).alias("_near"))
    )
    given = bare.join(nearest, "_path", "left").select(
        "_id", "_path", F.col("_near.licence").alias("licence"), F.col("_near.score").alias("score"),
        F.when(F.col("_near").isNull(), "none").otherwise("inherited").alias("origin"), F.col("_near._dir").alias("directory"),
    )
    own = owned.filter("_licence IS NOT NULL").select(
        "_id", "_path", F.col("_licence").alias("licence"), F.col("_score").alias("score"), F.lit("own").alias("origin"), F.lit(None).cast("string").alias("directory")
    )
    return own.unionByName(given).select(F.col("_id").alias(file_id), F.col("_path").alias(path), "licence", "score", "origin", "directory")


def page_lines(html: Column) -> Column:
    """The text of a page, one line per run between tags; the title is the first line that is not blank."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    lines = F.regexp_replace(F.regexp_replace(bare, r"\n", " "), r"<[^>]*+>", "\n")
    return F.trim(F.regexp_replace(lines, r"[ \t]*\n\s*", "\n"), F.lit("\n "))


def page_path(url: Column) -> Column:
    """Host and path of a URL as a file path: no scheme, `www.` or `m.`, query or fragment."""
    return F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z]+://(www\.|m\.)?|[?#].*$", ""), r"/+$", "")
