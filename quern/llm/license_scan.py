"""License scan with DataFrame functions only: MinHash bands over overlapping windows, then exact containment.

Words are the lower-cased runs of letters and digits; shingles have ``K`` words. A template with s shingles belongs to the
size class c with 2**c <= s < 2**(c + 1) and S = 2**(c + 1) - 1. Texts are cut into windows of 2*S + 1 shingles that
start every S shingles, so every span of up to S + 1 shingles lies in some window. A window holds a template if it
contains at least ``LEAST`` of the template's distinct shingles. Such a window has a Jaccard similarity to the template
of at least LEAST*s / (2*S + 1 + s - LEAST*s); the number of MinHash bands is the smallest that misses a pair of that
similarity with a probability of at most ``MISS``. Windows and templates that agree in a band are verified on the shingles
themselves.

Two exact filters come first. From each template some words are taken (rarest-looking first) until less than ``LEAST``
of its shingles are free of them: any match contains one, so texts and windows without such words are passed over.

Result: one row per doc_id and template found: the best containment and the first window's start (in words). Defined
results: null and empty texts and texts under K words hold nothing; repeated rows of an id give one row; rows with a null
id count as one document with a null id. An empty table gives an empty result. Only id and text are read. Templates are
a bounded list (``MAX_TEMPLATES``), the only thing that is broadcast; they need K words at least.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

K, LEAST, MISS, ROWS, MAX_TEMPLATES = 5, 0.8, 1e-4, 1, 2_000

#: License notices to look for.
TEMPLATES = {
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "mit": "Released under the MIT License.",
    "apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'
        " You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
    ),
    "mit-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation"
        ' files (the "Software"), to deal in the Software without restriction'
    ),
    "gpl-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"
        " as published by the Free Software Foundation"
    ),
    "bsd-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following"
        " conditions are met"
    ),
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
}


def words_of(text: str) -> list[str]:
    """The template's words, as ``words_column`` gives those of a text (templates are ASCII)."""
    return re.findall(r"[a-z0-9]+", text.lower())


def shingles_of(words: list[str]) -> list[str]:
    return list(dict.fromkeys(" ".join(words[i : i + K]) for i in range(len(words) - K + 1)))


def anchors(words: list[str]) -> set[str]:
    """Words one of which every window with ``LEAST`` of the shingles contains; the longest words are tried first."""
    every, out = shingles_of(words), set()
    for w in sorted(set(words), key=lambda w: (-len(w), w)):
        free = [s for s in every if not out & set(s.split())]
        if len(free) < LEAST * len(every):
            break
        out.add(w)
    return out


def band_count(least_jaccard: float, rows: int = ROWS, miss: float = MISS) -> int:
    return max(1, math.ceil(math.log(miss) / math.log(1 - least_jaccard**rows)))


def classes(templates: dict[str, str]) -> dict[int, dict[str, list[str]]]:
    """size S -> template name -> words."""
    if len(templates) > MAX_TEMPLATES:
        raise ValueError("too many templates to broadcast")
    out: dict[int, dict[str, list[str]]] = {}
    for name, text in templates.items():
        words = words_of(text)
        if len(words) < K:
            raise ValueError(f"template {name} has fewer than {K} words")
        size = 2 ** len(shingles_of(words)).bit_length() - 1
        out.setdefault(size, {})[name] = words
    return out


def least_jaccard(size: int) -> float:
    s = (size + 1) // 2
    return LEAST * s / (2 * size + 1 + s - LEAST * s)


def words_column(text: str) -> F.Column:
    flat = F.trim(F.regexp_replace(F.lower(F.col(text)), r"[^\p{L}\p{N}]+", " "))
    return F.filter(F.split(flat, " "), lambda w: w != "")


def bands(shingles: F.Column, n: F.Column, rows: int) -> F.Column:
    """Array of band keys of a set of shingles (strings): hashes of ``rows`` minimal hashes each."""
    low = lambda seed: F.array_min(F.transform(shingles, lambda s: F.xxhash64(s, seed)))
    return F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda b: F.struct(b.alias("band"), F.xxhash64(F.transform(F.sequence(b * rows, b * rows + rows - 1), low)).alias("key")),
    )


def template_table(spark: SparkSession, groups: dict[int, dict[str, list[str]]], rows: int) -> DataFrame:
    """license, template (shingles), size, band, key."""
    held = [(name, size, band_count(least_jaccard(size), rows), shingles_of(w)) for size, group in groups.items() for name, w in group.items()]
    t = spark.createDataFrame(held, "license string, size int, n int, template array<string>")
    return t.withColumn("b", F.explode(bands(F.col("template"), F.col("n"), rows))).select("license", "template", "size", "b.band", "b.key")


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, rows: int = ROWS, text: str = "text") -> DataFrame:
    """doc_id, license, containment, first_word."""
    spark = docs.sparkSession
    groups = classes(TEMPLATES if templates is None else templates)
    if not groups:
        return spark.createDataFrame([], f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, license string, containment double, first_word int")
    marks = {size: sorted(set().union(*(anchors(w) for w in group.values()))) for size, group in groups.items()}
    pattern = "|".join(re.escape(m) for m in sorted(set().union(*marks.values())))
    kinds = F.array(*[
        F.struct(F.lit(size).alias("size"), F.lit(band_count(least_jaccard(size), rows)).alias("n"), F.array(*[F.lit(m) for m in ms]).alias("marks"))
        for size, ms in sorted(marks.items())
    ])
    held = docs.select("doc_id", F.col(text).alias("text")).where(F.lower("text").rlike(pattern))
    held = held.select("doc_id", words_column("text").alias("words")).where(F.size("words") >= K)
    held = held.select("doc_id", "words", F.explode(kinds).alias("k")).where(F.arrays_overlap("words", "k.marks"))
    last = F.greatest(F.size("words") - (K - 1), F.lit(1)) - 1  # the last shingle's place
    held = held.select("doc_id", "words", "k", F.explode(F.sequence(F.lit(0), last, F.col("k.size"))).alias("first_word"))
    held = held.select("doc_id", "k", "first_word", F.slice("words", F.col("first_word") + 1, 2 * F.col("k.size") + K).alias("words"))
    held = held.where(F.arrays_overlap("words", "k.marks") & (F.size("words") >= K))
    grams = F.transform(F.sequence(F.lit(1), F.size("words") - (K - 1)), lambda i: F.array_join(F.slice("words", i, K), " "))
    held = held.select("doc_id", "first_word", F.col("k.size").alias("size"), F.col("k.n").alias("n"), F.array_distinct(grams).alias("shingles"))
    probe = held.select("doc_id", "first_word", "size", "shingles", F.explode(bands(F.col("shingles"), F.col("n"), rows)).alias("b"))
    probe = probe.select("doc_id", "first_word", "size", "shingles", "b.band", "b.key")
    found = probe.join(F.broadcast(template_table(spark, groups, rows)), ["size", "band", "key"])
    share = F.size(F.array_intersect("shingles", "template")) / F.size("template")
    found = found.select("doc_id", "license", share.alias("containment"), "first_word").where(F.col("containment") >= LEAST)
    return found.groupBy("doc_id", "license").agg(F.max("containment").alias("containment"), F.min("first_word").alias("first_word"))


def op5_license_scan(spark, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def _oracle() -> str:
    """All windows against all templates, without MinHash."""
    parts = []
    for size, group in sorted(classes(TEMPLATES).items()):
        values = ", ".join(f"('{n}', [{', '.join(repr(s) for s in shingles_of(w))}])" for n, w in group.items())
        marks = sorted(set().union(*(anchors(w) for w in group.values())))
        parts.append(f"""
SELECT doc_id, license, len(list_intersect(s, template)) / len(template) AS containment, first_word FROM (
  SELECT doc_id, first_word, list_distinct([array_to_string(w[i:i + {K - 1}], ' ') for i in range(first_word + 1, least(first_word + {2 * size + 2}, len(w) - {K - 2}))]) AS s
  FROM (SELECT doc_id, w, unnest(range(0, len(w) - {K - 1}, {size}))::INT AS first_word FROM (
    SELECT doc_id, list_filter(regexp_split_to_array(trim(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' '), lambda x: x <> '') AS w
    FROM documents WHERE regexp_matches(lower(text), '{"|".join(marks)}'))
  WHERE len(w) >= {K})), (VALUES {values}) t(license, template)
WHERE len(list_intersect(s, template)) >= {LEAST} * len(template)""")
    return f"SELECT doc_id, license, max(containment) AS containment, min(first_word) AS first_word FROM ({' UNION ALL '.join(parts)}) GROUP BY doc_id, license"


ORACLE = _oracle()
