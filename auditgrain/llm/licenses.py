"""License scans in DataFrame functions alone: phrases, and an exact set-similarity join with templates.

Blocks are the lines of a text, sets of words. A block meets a template when it holds the asked share
of the template's words. Template words are ordered by how many blocks of the whole corpus hold them,
rarest first. A block that meets a template must hold one of the template's first words in that order
(prefix), must have as many words as are needed (length), and at each shared prefix word enough words
must be left on both sides (position). What passes is counted exactly.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditgrain.llm.common import LOWER, UPPER

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases and their labels.
PHRASES = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}

# Notices that stand for a license, by label.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "bsd-terms": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-4.0": "Licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3",
    "gpl-terms": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "mit-notice": "Released under the MIT License",
    "mit-terms": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
}
CONTAINMENT = 0.8


def lowered(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SEPARATORS), "")


def _template_words(text: str) -> list[str]:
    out, word = [], ""
    for c in text.lower() + " ":
        if c.isalnum():
            word += c
        elif word:
            out.append(word)
            word = ""
    return sorted(set(out))


def _places(words: Column, phrase: str) -> Column:
    parts = phrase.split(" ")
    last = F.size(words) - len(parts)
    match = lambda i: F.expr("true") if not parts else _all([F.get(words, i + k) == p for k, p in enumerate(parts)])
    return F.when(last >= 0, F.filter(F.sequence(F.lit(0), last), match)).otherwise(F.array().cast("array<int>"))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def phrases(docs: DataFrame, phrases: Mapping[str, str] = PHRASES) -> DataFrame:
    """`doc_id`, `body` (hash of the text), `n_words`, `n_base`, `first_word`, `last_word`, `base` (labels) of each row."""
    text = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("body"), lowered(F.col("text")).alias("low"))
    split = text.select("doc_id", "body", F.inline(F.array(F.struct(words_of(F.col("low")).alias("words"), *[
        # a cheap look at the text first: most texts hold no phrase's last word
        F.contains("low", F.lit(p.split(" ")[-1])).alias(f"may{k}") for k, p in enumerate(phrases)
    ]))))
    none = F.array().cast("array<int>")
    at = split.select("doc_id", "body", F.size("words").cast("long").alias("n_words"), *[
        F.when(F.col(f"may{k}"), _places(F.col("words"), p)).otherwise(none).alias(f"at{k}") for k, p in enumerate(phrases)
    ])
    every = F.concat(*[F.col(f"at{k}") for k in range(len(phrases))])
    labels = F.array_compact(F.array(*[F.when(F.size(f"at{k}") > 0, F.lit(label)) for k, label in enumerate(phrases.values())]))
    return at.select(
        "doc_id", "body", "n_words", F.size(every).cast("long").alias("n_base"), F.array_min(every).cast("long").alias("first_word"),
        F.array_max(every).cast("long").alias("last_word"), labels.alias("base"),
    )


def blocks(docs: DataFrame) -> DataFrame:
    """`doc_id`, `body`, `block` (line number), `words` (distinct) of every line with a word."""
    lines = docs.select(
        "doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("body"), F.posexplode(F.split(lowered(F.col("text")), "\n")).alias("block", "line"),
    )
    # behind a generator the words are split once, not again in every filter on them
    found = F.inline(F.array(F.struct(F.array_distinct(words_of(F.col("line"))).alias("words"))))
    return lines.select("doc_id", "body", "block", found).filter(F.size("words") > 0)


def template_join(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """`doc_id`, `body`, `block`, `template`, `share`: every block that holds the asked share of a template's words."""
    spark = docs.sparkSession
    sets = {name: _template_words(text) for name, text in templates.items()}
    vocabulary = sorted({w for own in sets.values() for w in own})
    literal = lambda items: F.array(*[F.lit(w) for w in items])
    all_blocks = blocks(docs)
    # one row for each template word at most: its size is that of the templates
    counted = all_blocks.select(F.explode(F.array_intersect("words", literal(vocabulary))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    frequency = {r["word"]: r["n"] for r in counted.collect()}
    order = sorted(vocabulary, key=lambda w: (frequency.get(w, 0), w))
    rank = {w: k for k, w in enumerate(order)}
    rows = []
    for name, own in sets.items():
        need = math.ceil(containment * len(own) - 1e-9)
        ordered = sorted(own, key=rank.__getitem__)
        rows += [(w, name, place, len(own), need, ordered) for place, w in enumerate(ordered[: len(own) - need + 1])]
    prefix = spark.createDataFrame(rows, "word string, template string, place int, size int, need int, own array<string>")
    first = sorted({r[0] for r in rows})
    held = all_blocks.select(
        "doc_id", "body", "block", F.size("words").alias("length"), F.inline(F.array(F.struct(F.array_intersect(literal(order), "words").alias("ordered")))),
    ).filter(F.arrays_overlap("ordered", literal(first)))
    probes = held.select("*", F.posexplode("ordered").alias("at", "word"))
    left = lambda size, at: F.col(size) - F.col(at) - 1
    bound = F.least("place", "at") + 1 + F.least(left("size", "place"), F.size("ordered") - F.col("at") - 1)
    met = probes.join(F.broadcast(prefix), "word").filter((F.col("length") >= F.col("need")) & (bound >= F.col("need")))
    shared = F.size(F.array_intersect("ordered", "own"))
    out = met.select("doc_id", "body", "block", "template", "need", shared.alias("shared"), "size").filter("shared >= need")
    return out.select("doc_id", "body", "block", "template", (F.col("shared") / F.col("size")).alias("share")).distinct()


def scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """One row per row of `docs`: `doc_id`, `n_words`, `n_base`, `first_word`, `last_word`, `base_labels`, `labels`, `score`.

    `score` is the largest share of a template in one block, 0 where none meets the threshold. A null
    text is empty: no word, null places, empty labels. Repeated rows give equal rows; rows with a
    null doc_id are scanned like others; an empty table gives an empty one. Other columns are not read.
    """
    found = template_join(docs, templates, containment).groupBy("doc_id", "body").agg(
        F.collect_set("template").alias("templates"), F.max("share").alias("share"),
    ).select(F.col("doc_id").alias("hit_id"), F.col("body").alias("hit_body"), "templates", "share")
    base = phrases(docs)
    joined = base.join(found, base.doc_id.eqNullSafe(found.hit_id) & (base.body == found.hit_body), "left")
    joinup = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return joined.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", joinup(F.col("base")).alias("base_labels"),
        joinup(F.concat("base", F.coalesce("templates", F.array().cast("array<string>")))).alias("labels"),
        F.coalesce("share", F.lit(0.0)).alias("score"),
    )


def oracle() -> str:
    """The scan in DuckDB SQL: every block against every template, without filters."""
    listed = lambda items: "[" + ", ".join(f"'{w}'" for w in items) + "]"
    values = ", ".join(f"('{n}', {listed(_template_words(t))})" for n, t in TEMPLATES.items())
    at = [
        "list_filter(range(0, len(w) - {k} + 1), lambda i: {c})".format(k=len(p.split(" ")), c=" AND ".join(f"w[i + {j + 1}] = '{x}'" for j, x in enumerate(p.split(" "))))
        for p in PHRASES
    ]
    base = " || ".join(f"(CASE WHEN len(a{k}) > 0 THEN ['{label}'] ELSE [] END)" for k, label in enumerate(PHRASES.values()))
    every = " || ".join(f"a{k}" for k in range(len(at)))
    split = lambda x: f"list_filter(string_split_regex({x}, '{SEPARATORS}'), lambda x: x <> '')"
    return f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
w AS (SELECT doc_id, r, t, {split('t')} AS w FROM d),
p AS (SELECT doc_id, r, len(w) AS n_words, {", ".join(f"{x} AS a{k}" for k, x in enumerate(at))} FROM w),
b AS (SELECT doc_id, r, n_words, {every} AS places, {base} AS base FROM p),
l AS (SELECT r, list_distinct({split('line')}) AS words FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d)),
tpl(name, own) AS (VALUES {values}),
m AS (SELECT r, name, len(list_intersect(words, own)) * 1.0::DOUBLE / len(own) AS share FROM l, tpl
      WHERE len(list_intersect(words, own)) >= ceil({CONTAINMENT} * len(own) - 1e-9)),
h AS (SELECT r, list(DISTINCT name) AS names, max(share) AS share FROM m GROUP BY r)
SELECT doc_id, n_words::BIGINT AS n_words, len(places)::BIGINT AS n_base, list_min(places)::BIGINT AS first_word, list_max(places)::BIGINT AS last_word,
  array_to_string(list_sort(list_distinct(base)), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(base || coalesce(names, []))), ',') AS labels, coalesce(share, 0.0)::DOUBLE AS score
FROM b LEFT JOIN h USING (r)"""
