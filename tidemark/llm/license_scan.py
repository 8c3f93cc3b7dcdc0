"""Licence scans: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

Passages (lines, cut after sentences) of every whole text are compared with the templates. A term weighs its count times
ln((1 + files) / (1 + files with it)) + 1; files are counted over the whole table for the terms of the templates, all other terms
weigh 1 each. Only passages that hold an anchor of some template are made into vectors: a template's anchors are its heaviest terms, so
many that its other terms alone stay under the least cosine. Equal passages are compared once.
A file's own licence is its best passage's (ties: the earlier template). A file without one inherits that of the licence file (LICENSE,
LICENCE or COPYING) in its own or the nearest directory above; among several there, the best score, then the smallest path.

Null text: empty, without a licence of its own. Null path: no directory, so nothing to inherit. Rows of one path are one file. An empty
table gives an empty result. Other columns are left out.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import literal_table, written

# Licence names with headers and opening lines of their texts.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Proprietary", "Copyright. All rights reserved."),
)
LEAST_COSINE = 0.7
TERM = "[a-z0-9]+"
LICENCE_FILE = r"(?i)(^|/)(LICEN[CS]E|COPYING)(\.[a-z0-9]+)?$"


def terms(text: str) -> Counter:
    return Counter(re.findall(TERM, text.lower()))


def passages(text: Column) -> Column:
    """Lines of a text, cut after sentence ends followed by blanks."""
    return F.split(F.regexp_replace(text, r"([.!?]) +", "$1\n"), "\n")


def _directory(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def term_weights(files: DataFrame) -> dict[str, float]:
    """Weight of each template term, over all files."""
    vocabulary = sorted({t for _, text in TEMPLATES for t in terms(text)})
    held = F.array_intersect(F.split(F.lower("text"), "[^a-z0-9]+"), F.array(*map(F.lit, vocabulary)))
    counts = {r.term: r.n for r in files.select(F.explode(held).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = files.count()
    return {t: math.log((1 + total) / (1 + counts.get(t, 0))) + 1 for t in vocabulary}


def anchors(weights: dict[str, float], least: float) -> set[str]:
    """Terms without any of which no passage reaches the least cosine with any template."""
    found = set()
    for _, text in TEMPLATES:
        squares = sorted(((n * weights[t]) ** 2, t) for t, n in terms(text).items())
        total, rest = sum(s for s, _ in squares), 0.0
        for square, term in squares:
            rest += square
            if math.sqrt(rest / total) >= least - 1e-6:
                found.add(term)
    return found


def find_licences(files: DataFrame, path: str = "path", text: str = "text", least: float = LEAST_COSINE) -> DataFrame:
    """path, licence, score (cosine to six decimals), origin (own, inherited or null) and licence_path of every file."""
    spark = files.sparkSession
    rows = files.select(F.col(f"`{path}`").alias("path"), F.coalesce(f"`{text}`", F.lit("")).alias("text"))
    weights = term_weights(rows)
    wanted = r"(?<![a-z0-9])(?:" + "|".join(sorted(anchors(weights, least))) + r")(?![a-z0-9])"
    held = F.filter(passages(F.lower("text")), lambda p: p.rlike(wanted))
    lines = written(rows.select("path", F.explode_outer(held).alias("passage")).distinct(), "passages")

    table = []
    for number, (_, template) in enumerate(TEMPLATES):
        counts = terms(template)
        norm = math.sqrt(sum((n * weights[t]) ** 2 for t, n in counts.items()))
        table += [(number, t, n * weights[t] / norm) for t, n in sorted(counts.items())]
    in_templates = literal_table(spark, ["template", "term", "share"], table)
    weight = literal_table(spark, ["term", "weight"], sorted(weights.items()))
    words = lines.filter("passage is not null").select("passage").distinct().select("passage", F.explode(F.split("passage", "[^a-z0-9]+")).alias("term")).filter("term <> ''")
    vectors = words.groupBy("passage", "term").agg(F.count(F.lit(1)).alias("n")).join(weight, "term", "left").withColumn("x", F.col("n") * F.coalesce("weight", F.lit(1.0)))
    norms = vectors.groupBy("passage").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    dots = vectors.join(in_templates, "term").groupBy("passage", "template").agg(F.sum(F.col("x") * F.col("share")).alias("dot"))
    scored = dots.join(norms, "passage").select("passage", "template", F.round(F.col("dot") / F.col("norm"), 6).alias("score")).filter(F.col("score") >= least)
    best = scored.groupBy("passage").agg(F.max(F.struct("score", (-F.col("template")).alias("order"))).alias("best"))
    names = F.array(*[F.lit(name) for name, _ in TEMPLATES])
    held = lines.filter("passage is not null").join(best, "passage").select("path", "best")  # files without a passage would share a null key
    own = held.unionByName(lines.select("path", F.lit(None).cast(held.schema["best"].dataType).alias("best"))).groupBy("path").agg(F.max("best").alias("best"))
    own = own.select("path", F.get(names, -F.col("best.order")).alias("licence"), F.col("best.score").alias("score"))

    given = own.filter(F.col("licence").isNotNull() & F.col("path").rlike(LICENCE_FILE))
    given = given.groupBy(_directory(F.col("path")).alias("above")).agg(F.min_by(F.struct("licence", "score", "path"), F.struct(-F.col("score"), "path")).alias("given"))
    folders = own.filter(F.col("licence").isNull() & F.col("path").isNotNull()).select(_directory(F.col("path")).alias("folder")).distinct()
    parts = F.split("folder", "/")
    above = folders.select("folder", F.explode(F.sequence(F.lit(0), F.size(parts))).alias("depth")).withColumn("above", F.array_join(F.slice(parts, 1, F.col("depth")), "/"))
    above = above.groupBy("folder", "above").agg(F.max("depth").alias("depth"))
    nearest = above.join(given, "above").groupBy("folder").agg(F.max_by("given", "depth").alias("given"))
    joined = own.withColumn("folder", F.when(F.col("licence").isNull(), _directory(F.col("path")))).join(nearest, "folder", "left")
    has = F.col("licence").isNotNull()
    return joined.select(
        "path", F.coalesce("licence", "given.licence").alias("licence"), F.coalesce("score", "given.score").alias("score"),
        F.when(has, F.lit("own")).when(F.col("given").isNotNull(), F.lit("inherited")).alias("origin"), F.when(has, F.col("path")).otherwise(F.col("given.path")).alias("licence_path"),
    )
