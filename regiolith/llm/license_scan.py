"""License scan: an exact set-similarity join of text blocks with notice templates.

A block is a run of consecutive words, wherever lines end, SLACK times as long as
the template, so wrapped notices are found and words scattered over a long text
are not.  A template matches a block when the block holds at least ``threshold``
of the template's distinct words (containment).  The join is exact and filters
candidates three ways:

* order: template words are ranked by how many documents of the whole corpus
  hold them, rarest first, and both sides are kept in that order;
* prefix: with needed overlap a, a matching pair shares a word among the first
  |T| - a + 1 of the template and the first |B| - a + 1 of the block, where B is
  the block's set within the template vocabulary (other words cannot overlap);
  only blocks about such a word of the template are made;
* length and position: |B| >= a, and the words after the shared one must suffice.

Blocks start at words of the template: any other one loses nothing by being moved
to its first.  Every surviving pair is verified on the full sets.  The template
side is a constant of the code, so its index has a fixed size and is broadcast.

Rows: null and empty texts have no words and no labels; a repeated row gets the
same result as the row it repeats; other columns of the input are not read.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regiolith.llm.common import row_key

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
THRESHOLD = 0.8
#: The length of a block over that of the template.
SLACK = 1.25

# The phrases of the base scan and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Opening sentences of common notices, lower-case words.
TEMPLATES = {
    "apache": "licensed under the apache license version 2 0",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "creative-commons": "this work is licensed under a creative commons attribution 4 0 international license",
    "gpl-notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license",
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software",
    "mit-short": "released under the mit license",
    "mpl": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "public-domain": "this is free and unencumbered software released into the public domain",
    "reserved-notice": "copyright c all rights reserved",
    "cc-by-short": "this text is available under cc by 4 0",
    "boost": "distributed under the boost software license version 1 0",
    "cc0": "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    "epl": "this program and the accompanying materials are made available under the terms of the eclipse public license v 2 0",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "mit-warranty": "the software is provided as is without warranty of any kind express or implied",
    "zlib": "in no event will the authors be held liable for any damages arising from the use of this software",
}


def lowered(text: Column) -> Column:
    """A-Z lower-cased.  lower() also maps other letters, which keeps words and their ASCII letters, but for the Kelvin sign."""
    return F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("ĸ")))


def words_of(low: Column) -> Column:
    return F.filter(F.split(low, NOT_WORD), lambda w: w != "")


def word_count(low: Column) -> Column:
    """The length of words_of() without a pass over the array: only its ends can be empty."""
    cut = F.split(low, NOT_WORD)
    ends = (F.element_at(cut, 1) == "").cast("long") + F.when(F.size(cut) > 1, (F.element_at(cut, -1) == "").cast("long")).otherwise(0)
    return F.size(cut).cast("long") - ends


def places(words: Column, phrase: str) -> Column:
    """Every index from which the phrase's words stand consecutively."""
    need = phrase.split()
    here = lambda i: reduce(lambda a, b: a & b, [F.get(words, i + k) == w for k, w in enumerate(need)])
    return F.filter(F.sequence(F.lit(0), F.greatest(F.size(words) - len(need), F.lit(0))), here)


def phrase_scan(docs: DataFrame, phrases: dict[str, str]) -> DataFrame:
    """doc_id, row, n_words, and where the phrases stand; the word array is only built where all words of a phrase occur."""
    low = docs.select("doc_id", row_key("doc_id", "text").alias("row"), lowered(F.col("text")).alias("low"))
    may = reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [F.contains("low", F.lit(w)) for w in p.split()]) for p in phrases])
    out = low.select("doc_id", "row", word_count(F.col("low")).alias("n_words"), F.when(may, words_of(F.col("low"))).alias("words"))
    found = {p: F.coalesce(places(F.col("words"), p), F.array().cast("array<int>")) for p in phrases}
    out = out.select("doc_id", "row", "n_words", *[v.alias(f"at{i}") for i, v in enumerate(found.values())])
    ats = [F.col(f"at{i}") for i in range(len(phrases))]
    names = [F.when(F.size(a) > 0, F.lit(label)) for a, label in zip(ats, phrases.values())]
    return out.select("doc_id", "row", "n_words", F.concat(*ats).alias("at"), F.array_compact(F.array(*names)).alias("base"))


def token_order(docs: DataFrame, templates: dict[str, str]) -> list[str]:
    """The template vocabulary, rarest first over all documents.  The result has as many rows as the templates have words."""
    vocabulary = sorted({w for t in templates.values() for w in t.split()})
    have = F.array_intersect(F.array(*map(F.lit, vocabulary)), F.split(lowered(F.col("text")), NOT_WORD))
    counted = docs.select(F.explode(have).alias("token")).groupBy("token").count()
    n = {r["token"]: r["count"] for r in counted.collect()}
    return sorted(vocabulary, key=lambda w: (n.get(w, 0), w))


def needed(template: str, threshold: float) -> int:
    return math.ceil(threshold * len(set(template.split())) - 1e-9)


def block_length(template: str) -> int:
    return math.ceil(SLACK * len(template.split()) - 1e-9)


def match_templates(docs: DataFrame, templates: dict[str, str], threshold: float = THRESHOLD) -> DataFrame:
    """(row, label, containment) for every block that meets the threshold; one row for each block and shared prefix word."""
    spark, order = docs.sparkSession, token_order(docs, templates)
    rank = {w: i for i, w in enumerate(order)}
    index = []
    for label, t in templates.items():
        own, need = sorted(set(t.split()), key=rank.get), needed(t, threshold)
        index += [(w, label, i, len(own), need, block_length(t), own) for i, w in enumerate(own[: len(own) - need + 1])]
    prefix = F.array(*map(F.lit, sorted({x[0] for x in index})))
    index = spark.createDataFrame(index, "token string, label string, i int, size int, need int, length int, template array<string>")
    widest = max(block_length(t) for t in templates.values())

    words = docs.select(row_key("doc_id", "text").alias("row"), words_of(lowered(F.col("text"))).alias("words")).filter(F.arrays_overlap("words", prefix))
    at = F.filter(F.transform("words", lambda w, i: F.struct(i.alias("p"), w.alias("token"))), lambda x: F.array_contains(prefix, x["token"]))
    near = words.select("row", "words", F.explode(at).alias("at"))
    first = F.greatest(F.col("at.p") - (widest - 1), F.lit(0))
    near = near.select("row", F.col("at.token").alias("token"), (F.col("at.p") - first).alias("p"), F.slice("words", first + 1, 2 * widest - 1).alias("around"))
    met = near.join(F.broadcast(index), "token")
    starts = F.filter(F.sequence(F.greatest(F.col("p") - F.col("length") + 1, F.lit(0)), F.col("p")), lambda s: F.array_contains("template", F.get("around", s)))
    blocks = met.select("row", "token", "label", "i", "size", "need", "template", F.transform(starts, lambda s: F.slice("around", s + 1, F.col("length"))).alias("blocks"))
    blocks = blocks.select("row", "token", "label", "i", "size", "need", "template", F.explode("blocks").alias("block"))
    have = F.array_intersect(F.array(*map(F.lit, order)), F.col("block"))
    pairs = blocks.select("row", "label", "i", "size", "need", "template", have.alias("have"), (F.array_position(have, F.col("token")) - 1).alias("j"))
    length = F.size("have") >= F.col("need")
    prefixed = F.col("j") <= F.size("have") - F.col("need")
    position = 1 + F.least(F.col("size") - 1 - F.col("i"), F.size("have") - 1 - F.col("j")) >= F.col("need")
    pairs = pairs.filter(length & prefixed & position)
    shared = F.size(F.array_intersect("template", "have"))
    return pairs.select("row", "label", "need", "size", shared.alias("shared")).filter("shared >= need").select("row", "label", (F.col("shared") / F.col("size")).alias("containment"))


def license_scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Labels of every document: phrase places and template matches.

    docs: doc_id, text.  Returns a row per input row: doc_id, n_words, n_base,
    first_word, last_word, base_labels, labels, score, of which score is 1 where
    a phrase stands, else the largest containment of a matching template, else 0.
    """
    found = match_templates(docs, templates, threshold).groupBy("row").agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"))
    joined = phrase_scan(docs, phrases).join(found, "row", "left")
    more = F.coalesce("more", F.array().cast("array<string>"))
    return joined.select(
        "doc_id",
        "n_words",
        F.size("at").cast("long").alias("n_base"),
        F.array_min("at").cast("long").alias("first_word"),
        F.array_max("at").cast("long").alias("last_word"),
        F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", more)), ",").alias("labels"),
        F.when(F.size("at") > 0, F.lit(1.0)).otherwise(F.round(F.coalesce("best", F.lit(0.0)), 6)).alias("score"),
    )


def oracle() -> str:
    """The same by brute force in DuckDB: every block against every template."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    at = []
    for phrase in PHRASES:
        need = phrase.split()
        test = " AND ".join(f"w[i + {k + 1}] = '{x}'" for k, x in enumerate(need))
        at.append(f"list_filter(range(len(w)), lambda i: {test})")
    names = ", ".join(f"CASE WHEN len(at{i}) > 0 THEN '{label}' END" for i, label in enumerate(PHRASES.values()))
    values = ", ".join(f"('{label}', {sorted(set(t.split()))!r}, {needed(t, THRESHOLD)}, {block_length(t)})" for label, t in TEMPLATES.items())
    return f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{upper}', '{upper.lower()}') AS low FROM documents),
w AS (SELECT doc_id, low, regexp_extract_all(low, '{word}') AS w FROM d),
p AS (SELECT doc_id, len(w) AS n_words, {', '.join(f'{a} AS at{i}' for i, a in enumerate(at))} FROM w),
b AS (SELECT doc_id, n_words, list_concat(list_concat(at0, at1), at2) AS pos, list_filter([{names}], lambda x: x IS NOT NULL) AS base FROM p),
t(label, tokens, need, length) AS (VALUES {values}),
k AS (SELECT label, unnest(tokens) AS token FROM t),
i AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS token FROM w),
l AS (SELECT DISTINCT i.doc_id, i, label FROM i JOIN k USING (token)),
m AS (SELECT l.doc_id, l.label, max(len(list_intersect(tokens, w[i : i + length - 1])) / len(tokens)) AS c FROM l JOIN t ON t.label = l.label JOIN w ON w.doc_id = l.doc_id
  WHERE len(list_intersect(tokens, w[i : i + length - 1])) >= need GROUP BY 1, 2),
f AS (SELECT doc_id, list(label) AS more, max(c) AS best FROM m GROUP BY 1)
SELECT b.doc_id, n_words, CAST(len(pos) AS BIGINT) AS n_base, list_min(pos) AS first_word, list_max(pos) AS last_word,
  array_to_string(list_sort(base), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(base, coalesce(more, [])))), ',') AS labels,
  CASE WHEN len(pos) > 0 THEN 1.0::DOUBLE ELSE round(coalesce(best, 0.0::DOUBLE), 6) END AS score
FROM b LEFT JOIN f ON b.doc_id = f.doc_id"""
