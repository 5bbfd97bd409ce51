"""Licence notices: normalised text against licence templates by Dice over word bigrams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

THRESHOLD = 0.9
MAX_TEMPLATE_BYTES = 8 << 20  # larger template tables are joined without a broadcast

# Common public licence notices in their usual wording.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        'associated documentation files (the "Software"), to deal in the Software without restriction, '
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions:",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, "
        "or (at your option) any later version.",
    ),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the "
        "MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met:",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Released under CC0 1.0 Universal."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)


def plain_words(text: Column) -> Column:
    """Lower-cased runs of letters and digits, joined by single spaces."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def word_bigrams(plain: str) -> Column:
    """The bigrams of normalised text as a set that keeps repeats: the k-th time a bigram comes, it is
    marked ``#k``. A single word is its own bigram.

    In sorted order a repeat's number is its distance from the bigram's first place.
    """
    pairs = (
        f"transform(array(split({plain}, ' ')), w -> array_sort(CASE WHEN size(w) < 2 THEN w ELSE "
        "transform(sequence(0, size(w) - 2), i -> concat(w[i], ' ', w[i + 1])) END))"
    )
    marked = f"transform({pairs}, s -> transform(s, (p, i) -> concat(p, '#', i + 1 - array_position(s, p))))[0]"
    return F.expr(marked)


def template_table(
    spark: SparkSession, threshold: float, templates: tuple[tuple[str, str], ...] = TEMPLATES
) -> DataFrame:
    """(``size``, ``template``, ``license``, ``_grams``, ``_size``): each template once for every unit
    size that can reach the threshold. Dice is at most 2 * min / (a + b), so sizes a and b must satisfy
    ``threshold / (2 - threshold) <= a / b <= (2 - threshold) / threshold``."""
    rows = [(number, name, text) for number, (name, text) in enumerate(templates)]
    base = spark.createDataFrame(rows, "template int, license string, text string")
    ratio = (2 - threshold) / threshold
    sized = (
        base.withColumn("_plain", plain_words(F.col("text")))
        .filter("_plain <> ''")
        .withColumn("_grams", word_bigrams("_plain"))
        .withColumn("_size", F.size("_grams"))
    )
    lowest = F.ceil(F.col("_size") / F.lit(ratio) - 1e-9).cast("int")
    highest = F.floor(F.col("_size") * F.lit(ratio) + 1e-9).cast("int")
    return sized.select(
        F.explode(F.sequence(lowest, highest)).alias("size"), "template", "license", "_grams", "_size"
    )


def license_scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = THRESHOLD,
    templates: tuple[tuple[str, str], ...] = TEMPLATES,
) -> DataFrame:
    """(id, ``line_no``, ``template``, ``license``, ``dice``) for every line (from 1) and every whole
    text of several lines (``line_no`` 0) whose Dice coefficient with a template is at least
    ``threshold``.

    A unit's number of bigrams follows from its spaces, so units whose size admits no template are
    gone before a bigram is built; the others meet only the templates that admit their size. There is
    no shuffle: templates are literals of the caller (checked to be under ``MAX_TEMPLATE_BYTES``,
    else they are joined without a broadcast), the documents are read once.

    Nulls and edges: a null text and units without a letter or digit match nothing; repeated rows are
    reported as often as they come; a unit that matches several templates gives a row for each.
    """
    known = template_table(docs.sparkSession, threshold, templates)
    small = sum(len(text.encode()) for _, text in templates) <= MAX_TEMPLATE_BYTES
    lines = F.split(F.col("_text"), "\n")
    units = (
        docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
        .select("_id", F.posexplode(F.concat(F.array("_text"), lines)).alias("line_no", "_unit"), (F.size(lines) == 1).alias("_single"))
        .filter("line_no > 0 or not _single")
        .select("_id", "line_no", plain_words(F.col("_unit")).alias("_plain"))
        .filter("_plain <> ''")
        .withColumn("_spaces", F.length("_plain") - F.length(F.translate("_plain", " ", "")))
        .withColumn("size", F.greatest("_spaces", F.lit(1)))
    )
    met = units.join(F.broadcast(known) if small else known, "size")
    shared = F.size(F.array_intersect(word_bigrams("_plain"), F.col("_grams")))
    return (
        met.withColumn("dice", F.lit(2.0) * shared / (F.col("size") + F.col("_size")))
        .filter(F.col("dice") >= threshold)
        .select(F.col("_id").alias(id_col), "line_no", "template", "license", "dice")
    )
