"""License scan: normalised text against licence templates by the Dice coefficient over word bigrams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# The usual notices of common licences.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    ),
    "BSD": (
        "Licensed under the BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met:",
    ),
    "CC-BY-4.0": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "CC-BY-SA-4.0": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the '
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions:",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    ),
}
THRESHOLD = 0.8


def words_of(text: Column) -> Column:
    """Lower case, runs of letters and digits of any script."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def split_words(plain: Column) -> Column:
    """The words of a text in lower case whose other characters are already spaces."""
    return F.filter(F.split(plain, " "), lambda w: w != "")


def bigrams_of(words: Column) -> Column:
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.array_distinct(F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: F.concat(a, F.lit(" "), b)))


def template_table(docs: DataFrame, templates: dict[str, tuple[str, ...]]) -> DataFrame:
    """template, license, bigram, template_size: a few rows for each given template."""
    spark = docs.sparkSession
    texts = [(f"{name}/{i}", name, text) for name, given in sorted(templates.items()) for i, text in enumerate(given)]
    rows = spark.createDataFrame(texts, "template string, license string, text string")
    grams = rows.select("template", "license", bigrams_of(words_of(F.col("text"))).alias("grams"))
    return grams.select("template", "license", F.size("grams").alias("template_size"), F.explode("grams").alias("bigram"))


def scan_licenses(docs: DataFrame, templates: dict[str, tuple[str, ...]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """The units that hold a licence notice: doc_id, line (from 1; 0 is the whole text), license, template, n_bigrams, shared, dice.

    Every line, and every whole text of several lines, is normalised to words and turned into its set of word bigrams. Two
    sets can only reach the threshold t if the smaller has at least t / (2 - t) of the larger one's size, so units are
    compared with templates within these bounds alone. A unit gets its best template (ties: the smaller name).

    A unit without bigrams, a null or an empty text gives no row. Rows that repeat a doc_id and a text count once. An empty
    table gives an empty result. Extra columns are not read; a null doc_id stays null.
    """
    given = F.broadcast(template_table(docs, templates or TEMPLATES))  # bounded by the parameter
    ratio = threshold / (2 - threshold)
    limits = template_table(docs, templates or TEMPLATES).agg(F.min("template_size").alias("low"), F.max("template_size").alias("high")).first()
    low, high = (limits["low"] or 0) * ratio, (limits["high"] or 0) / ratio
    # one pass of the regular expression over a text serves its lines and the whole: no word runs over a line's end
    plain = docs.select("doc_id", "text", F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}\n]+", " ").alias("plain"))
    several = F.col("text").contains("\n")
    parts = [F.concat(F.split(c, "\n"), F.when(several, F.array(w)).otherwise(F.array().cast("array<string>"))).alias(c)
             for c, w in (("text", F.col("text")), ("plain", F.translate("plain", "\n", " ")))]
    units = (plain.select("doc_id", F.when(several, F.size(F.split("text", "\n"))).alias("whole"), F.posexplode(F.arrays_zip(*parts)).alias("place", "u"))
             .select("doc_id", F.when(F.col("place") == F.col("whole"), 0).otherwise(F.col("place") + 1).alias("line"),
                     F.xxhash64("u.text").alias("unit_hash"), F.col("u.plain").alias("plain")))
    # a beginning with more distinct bigrams than any template allows rules its unit out: the rest of it needs no set
    begun = units.withColumn("begin", F.substring_index("plain", " ", 2 * int(high) + 4))
    first = begun.withColumn("begin_words", split_words(F.col("begin"))).withColumn("begin_grams", bigrams_of(F.col("begin_words")))
    whole_set = F.when(F.col("begin") == F.col("plain"), F.col("begin_grams")).otherwise(bigrams_of(split_words(F.col("plain"))))
    grams = first.select("doc_id", "line", "unit_hash", F.when(F.size("begin_grams") <= high, whole_set).alias("grams"))
    # the size bounds sit in the array, not in a filter: a filter would be pushed down and build every set twice
    fitting = F.when((F.size("grams") >= low) & (F.size("grams") <= high), F.col("grams"))
    met = (grams.select("doc_id", "line", "unit_hash", F.size("grams").alias("n_bigrams"), fitting.alias("grams"))
           .select("doc_id", "line", "unit_hash", "n_bigrams", F.explode_outer("grams").alias("bigram"))
           .join(given, "bigram")
           .filter((F.col("n_bigrams") >= F.col("template_size") * ratio) & (F.col("n_bigrams") <= F.col("template_size") / ratio)))
    shared = (met.groupBy("doc_id", "line", "unit_hash", "n_bigrams", "license", "template", "template_size", "bigram").agg(F.lit(1))
              .groupBy("doc_id", "line", "unit_hash", "n_bigrams", "license", "template", "template_size").agg(F.count("*").alias("shared")))
    scored = shared.withColumn("dice", 2.0 * F.col("shared") / (F.col("n_bigrams") + F.col("template_size"))).filter(F.col("dice") >= threshold)
    best = scored.groupBy("doc_id", "line", "unit_hash").agg(
        F.min(F.struct((-F.col("dice")).alias("less"), "template", "license", "n_bigrams", "shared", "dice")).alias("b"))
    return best.select("doc_id", F.col("line").cast("int").alias("line"), "b.license", "b.template",
                       F.col("b.n_bigrams").cast("long").alias("n_bigrams"), "b.shared", F.round("b.dice", 6).alias("dice"))


def scan_sql(templates: dict[str, tuple[str, ...]] | None = None, threshold: float = THRESHOLD) -> str:
    """The same result over a table `documents`, in SQL."""
    def quoted(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    rows = ", ".join(f"({quoted(f'{n}/{i}')}, {quoted(n)}, {quoted(t)})"
                     for n, given in sorted((templates or TEMPLATES).items()) for i, t in enumerate(given))
    words = "list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
    pairs = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    return f"""WITH t AS (SELECT template, license, {words.format('body')} AS w FROM (VALUES {rows}) AS v(template, license, body)),
 tg AS (SELECT template, license, {pairs} AS grams FROM t),
 u AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS unit, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents
  UNION ALL SELECT doc_id, text, 0 FROM documents WHERE contains(text, chr(10))),
 uw AS (SELECT doc_id, line, unit, {words.format('unit')} AS w FROM u),
 ug AS (SELECT DISTINCT doc_id, line, unit, {pairs} AS grams FROM uw WHERE len(w) > 1),
 s AS (SELECT doc_id, line, unit, license, template, len(ug.grams) AS n_bigrams,
  len(list_intersect(ug.grams, tg.grams)) AS shared, len(tg.grams) AS template_size
  FROM ug JOIN tg ON len(ug.grams) BETWEEN len(tg.grams) * {threshold / (2 - threshold)} AND len(tg.grams) / {threshold / (2 - threshold)}),
 d AS (SELECT *, 2.0 * shared / (n_bigrams + template_size) AS dice FROM s),
 r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line, unit ORDER BY dice DESC, template) AS k FROM d WHERE dice >= {threshold})
 SELECT doc_id, CAST(line AS INTEGER) AS line, license, template, CAST(n_bigrams AS BIGINT) AS n_bigrams,
 CAST(shared AS BIGINT) AS shared, round(CAST(dice AS DOUBLE), 6) AS dice FROM r WHERE k = 1"""
