"""Licence notices in text: passages against templates by the Dice coefficient of their word bigrams, on the JVM without a shuffle.

A passage of a distinct bigrams can reach a coefficient of d with a template of t only if
t * d / (2 - d) <= a <= t * (2 - d) / d; the other templates are never compared with it. The same bounds say how many
bigrams of a template a match can lack: of one more than that, it must hold at least one, and so a word of it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atlasweave.llm.frames import plain

LEAST = 0.8
#: Notices as their licences word them.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "BSD-2-Clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MIT": "Released under the MIT License.",
    "MIT permission": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.',
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


def bigrams(text: Column) -> Column:
    """Distinct word bigrams: words are runs of a-z and 0-9 in the lower-cased text."""
    words = F.split(F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")), " ")
    return F.array_distinct(F.transform(F.slice(F.arrays_zip(words.alias("a"), F.slice(words, 2, F.size(words)).alias("b")), 1, F.size(words) - 1), lambda x: F.concat_ws(" ", x["a"], x["b"])))


def anchors(grams: list[str], least: float) -> set[str]:
    """Words of which every passage that matches the template holds at least one: the longest of one bigram more than it can lack."""
    t = len(grams)
    fewest = math.ceil(t * least / (2 - least) - 1e-9)
    lacking = t - math.ceil(least / 2 * (fewest + t) - 1e-9)
    words = sorted((max(g.split(" "), key=len) for g in grams), key=lambda w: (-len(w), w))
    return set(words[: lacking + 1])


def license_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST, templates: dict[str, str] | None = None) -> DataFrame:
    """(id, kind, nth, license, dice): passages of the whole text whose coefficient with a template is ``least`` or more.

    Passages are the lines, and the paragraphs of several lines between blank lines, counted from 1. Null and empty texts
    have none; rows with a null id and repeated rows give their passages each.
    """
    spark = docs.sparkSession
    known = spark.createDataFrame(list((TEMPLATES if templates is None else templates).items()), "license string, notice string")
    known = known.select("license", bigrams(F.col("notice")).alias("grams")).collect()  # the templates themselves
    sizes = [len(t.grams) for t in known]
    low, high = (min(sizes) * least / (2 - least), max(sizes) * (2 - least) / least) if sizes else (0.0, -1.0)
    # a text without any of these words has no match in it, nor has a passage
    words = "|".join(sorted({w for t in known for w in anchors(t.grams, least)}))
    needed = f"(?<![a-z0-9])(?:{words})(?![a-z0-9])" if words else "$^"
    source = plain(docs, id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit(""))).where(F.lower("text").rlike(needed))
    with_place = lambda kind, parts: F.transform(parts, lambda p, i: F.struct(F.lit(kind).alias("kind"), (i + 1).cast("long").alias("nth"), p.alias("passage")))
    lines = with_place("line", F.split("text", "\n"))
    paragraphs = F.filter(with_place("paragraph", F.split("text", "\n[ \\t\\r]*\n")), lambda p: F.contains(p["passage"], F.lit("\n")))
    passages = source.select("id", F.explode(F.concat(lines, paragraphs)).alias("p")).select("id", "p.*")
    passages = passages.where(F.lower("passage").rlike(needed))
    passages = passages.select("id", "kind", "nth", bigrams(F.col("passage")).alias("grams")).where(F.size("grams").between(low, high))

    def dice(size: int, grams: Column) -> Column:
        fits = (F.size("grams") >= size * least / (2 - least)) & (F.size("grams") <= size * (2 - least) / least)
        return F.when(fits, 2.0 * F.size(F.array_intersect("grams", grams)) / (F.size("grams") + size)).otherwise(F.lit(0.0))

    scored = [F.struct(F.lit(t.license).alias("license"), dice(len(t.grams), F.array(*map(F.lit, t.grams))).alias("dice")) for t in known]
    found = F.filter(F.array(*scored), lambda s: s["dice"] >= least)
    return passages.select("id", "kind", "nth", F.explode(found).alias("m")).select("id", "kind", "nth", "m.license", "m.dice")


def oracle(least: float = LEAST) -> str:
    """The query over ``documents`` as DuckDB SQL."""
    notices = ", ".join("('{}', '{}')".format(*(x.replace("'", "''") for x in pair)) for pair in TEMPLATES.items())
    grams = "list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, len(w))])"
    words = "string_split(trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g')), ' ')"
    return f"""
        WITH t AS (SELECT license, {grams} AS tg FROM (SELECT license, {words.format("notice")} AS w FROM (VALUES {notices}) AS v(license, notice))),
        parts AS (
            SELECT doc_id, 'line' AS kind, i AS nth, l[i] AS passage FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents), unnest(range(1, len(l) + 1)) AS u(i)
            UNION ALL
            SELECT doc_id, 'paragraph' AS kind, i AS nth, l[i] AS passage FROM (SELECT doc_id, regexp_split_to_array(coalesce(text, ''), '\\n[ \\t\\r]*\\n') AS l FROM documents), unnest(range(1, len(l) + 1)) AS u(i)
            WHERE contains(l[i], chr(10))
        ),
        g AS (SELECT doc_id, kind, nth, {grams} AS pg FROM (SELECT doc_id, kind, nth, {words.format("passage")} AS w FROM parts)),
        j AS (SELECT doc_id, kind, nth, license, 2.0::DOUBLE * len(list_intersect(pg, tg)) / (len(pg) + len(tg)) AS dice FROM g, t WHERE len(pg) BETWEEN 1 AND 1000)
        SELECT doc_id, kind, nth, license, dice FROM j WHERE dice >= {least}
    """
