"""License scans by diagonal voting, in DataFrame functions only.

All rolling 3-word grams of a text are hashed and joined to the positions of the same grams in the license templates
(a fixed table of a few hundred rows, broadcast).  A match votes for the diagonal document position - template position;
votes are added up by document, template and diagonal, diagonals at most GAP apart are merged (words inserted or left
out), and a merged group is a finding if its grams cover enough of the template within a span of about its length.  The
gram itself is compared besides its hash, so every vote is exact.  Only votes and one light row a document are shuffled.

The base labels come from phrases whose words stand consecutively; the method adds its labels to them.  score is 1 with a
base label, else the best coverage that any template reached.

Defined results: a null text is empty; repeated rows each get the same row; a null doc_id is kept; without findings the
labels are empty strings, the score 0 and the places null; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlab.llm.common import table, text_of

#: Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Notices of public licenses and their labels.
TEMPLATES = [
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("reserved", "All rights reserved"),
]
GRAM = 3
GAP = 2
#: Share of a template's grams that a finding must cover.
COVERAGE = 0.7
#: The two characters beyond A-Z whose lower case has ASCII letters, and letters without such a lower case.
_NOT_ASCII = {"\u212a": "\u212b", "\u0130": "\u00c4"}
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: str) -> Column:
    """Words in lower case.  Of other letters than A-Z only the case may differ, which no ASCII word meets: lower() is
    several times as fast as a translation of A-Z alone."""
    plain = F.col(text)
    for a, b in _NOT_ASCII.items():
        plain = F.replace(plain, F.lit(a), F.lit(b))
    return F.array_remove(F.split(F.lower(plain), _BETWEEN), "")


def with_grams(df: DataFrame, text: str) -> DataFrame:
    """df with one row per rolling gram: pos, gram."""
    parts = ", ".join(f"get(_w, i + {k})" for k in range(GRAM))
    grams = F.expr(f"CASE WHEN size(_w) >= {GRAM} THEN transform(sequence(0, size(_w) - {GRAM}), i -> concat_ws(' ', {parts})) ELSE array() END")
    others = [c for c in df.columns if c != text]
    return df.withColumn("_w", words(text)).select(*others, F.posexplode(grams).alias("pos", "gram"))


def template_grams(df: DataFrame) -> DataFrame:
    """template, label, tpos, gram, total: the fixed templates' grams, through the same functions."""
    rows = F.array(*(F.struct(F.lit(i).alias("template"), F.lit(label).alias("label"), F.lit(text).alias("notice")) for i, (label, text) in enumerate(TEMPLATES)))
    each = df.sparkSession.range(1).select(F.explode(rows).alias("t")).select("t.*")
    each = each.withColumn("total", F.size(words("notice")) - (GRAM - 1))
    return with_grams(each, "notice").withColumnRenamed("pos", "tpos")


def findings(docs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, method labels (array) and best coverage of the documents (keys, text) with any vote."""
    tmpl = template_grams(docs).withColumn("h", F.xxhash64("gram"))
    grams = with_grams(docs, "text").withColumn("h", F.xxhash64("gram"))
    votes = grams.join(F.broadcast(tmpl.withColumnRenamed("gram", "tgram")), "h").where("gram = tgram")
    group = [*keys, "template"]
    by = votes.groupBy(*group, (F.col("pos") - F.col("tpos")).alias("diagonal")).agg(F.collect_set("tpos").alias("hit"), F.min("pos").alias("first"), F.max("pos").alias("last"), F.first("label").alias("label"), F.first("total").alias("total"))
    along = Window.partitionBy(*group).orderBy("diagonal")
    far = F.when(F.col("diagonal") - F.lag("diagonal").over(along) <= GAP, 0).otherwise(1)
    # a group is a run of neighbouring diagonals, wherever they stand in the text; its span is verified below
    merged = by.withColumn("new", far).withColumn("run", F.sum("new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    spans = merged.groupBy(*group, "run").agg(F.array_distinct(F.flatten(F.collect_list("hit"))).alias("hit"), F.min("first").alias("first"), F.max("last").alias("last"), F.first("label").alias("label"), F.first("total").alias("total"))
    cover = (F.size("hit") / F.col("total")).cast("double")
    fits = F.col("last") - F.col("first") + 1 <= F.col("total") * 1.5 + GAP
    found = spans.select(*keys, "label", F.when(fits, cover).otherwise(0.0).alias("cover"))
    return found.groupBy(*keys).agg(F.collect_set(F.when(F.col("cover") >= COVERAGE, F.col("label"))).alias("method"), F.max("cover").alias("best"))


def base_places(df: DataFrame) -> DataFrame:
    """df (with _w, the words) with n_base, first_word, last_word and base (array of labels)."""
    for i, phrase in enumerate(PHRASES):
        parts = phrase.split()
        same = " AND ".join(f"get(_w, i + {k}) = '{p}'" for k, p in enumerate(parts))
        df = df.withColumn(f"_at{i}", F.expr(f"CASE WHEN has AND size(_w) >= {len(parts)} THEN filter(sequence(0, size(_w) - {len(parts)}), i -> {same}) ELSE array() END"))
    places = [f"_at{i}" for i in range(len(PHRASES))]
    df = df.withColumn("_at", F.concat(*places))
    labels = F.array_compact(F.array(*(F.when(F.size(c) > 0, F.lit(label)) for c, label in zip(places, PHRASES.values(), strict=True))))
    df = df.withColumns({"n_base": F.size("_at").cast("long"), "first_word": F.array_min("_at").cast("long"), "last_word": F.array_max("_at").cast("long"), "base": labels})
    return df.drop("_at", *places)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every document."""
    keys = ["_d", "_null", "_t"]  # a null doc_id joins too
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    rows = rows.select("doc_id", F.coalesce("doc_id", F.lit(0)).alias("_d"), F.col("doc_id").isNull().alias("_null"), F.xxhash64("text").alias("_t"), "text")
    found = findings(rows.drop("doc_id"), keys)
    base = rows.withColumn("_w", words("text")).withColumn("has", F.contains(F.lower("text"), F.lit("license"))).drop("text")
    base = base_places(base.withColumn("n_words", F.size("_w").cast("long"))).drop("_w", "has")
    joined = base.join(found, keys, "left")
    none = F.array().cast("array<string>")
    every = F.sort_array(F.array_union("base", F.coalesce("method", none)))
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0)))
    return joined.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join(F.sort_array("base"), ",").alias("base_labels"), F.array_join(every, ",").alias("labels"), score.alias("score"))


def license_scan(spark, sf_dir: str) -> DataFrame:
    """op10: licenses named in all documents."""
    return scan_licenses(table(spark, sf_dir, "documents"))
