"""License scan: an exact set-similarity join of text blocks with license templates, DataFrame functions only.

Tokens are ordered by their frequency over the whole corpus, rarest first. A template T is contained in
a block B when |T and B| >= ceil(threshold |T|). Such a B holds one of the first
|T| - ceil(threshold |T|) + 1 tokens of T (prefix filter), has at least that many tokens (length
filter), and after the first shared token both sides have enough tokens left (positional filter);
what remains is verified exactly, so the join finds every qualifying block. The blocks of T are all
runs of SLACK times as many consecutive words as T has, wherever lines end, so wrapped notices are
found and words scattered over a long text are not. A template may name tokens that a block must hold
besides (what tells its license from its neighbours). The phrases are templates of threshold 1 over
the whole text whose words must stand consecutively.

One pass over the texts cuts them into words and keeps the places of template words; the rest
works on these places.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_key, stable

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
THRESHOLD = 0.8
#: Words of a block for each word of its template.
SLACK = 1.5

# The phrases and labels of the contract.
PHRASES = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]

# Notices and body paragraphs of well-known licenses, each with its label and the words a block must hold.
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2 0", "apache"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", "agreed"),
    ("mit", "released under the mit license", "mit"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "obtaining"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "substantial"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "fee"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", "gnu general 3"),
    ("gpl-2.0", "licensed under the gnu general public license version 2", "gnu general 2"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gnu general redistribute"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose", "hope"),
    ("lgpl", "licensed under the gnu lesser general public license", "gnu lesser"),
    ("agpl", "licensed under the gnu affero general public license", "gnu affero"),
    ("cc-by-4.0", "licensed under cc by 4 0", "cc by"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-nd-4.0", "licensed under cc by nd 4 0", "cc by nd"),
    ("cc0-1.0", "cc0 1 0 universal public domain dedication", "cc0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", "redistributions"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "arising"),
]
_CODES = 1024


def _tokens(text: str) -> list[str]:
    return re.findall(WORD, text)


def block_words(text: str) -> int:
    return math.ceil(SLACK * len(_tokens(text)))


def places(docs: DataFrame, vocabulary: list[str], text_col: str = "text") -> DataFrame:
    """(doc_id, k, th, n_words, kept): kept has word number * 1024 + place in `vocabulary` for each word of it.

    The words are those of the text with A-Z lowered. A lower-cased word of another length in bytes had
    a letter beyond A-Z that became an ASCII one, and is no word of an ASCII vocabulary.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    words = docs.select("doc_id", id_key().alias("k"), F.xxhash64(text).alias("th"), F.regexp_extract_all(text, F.lit(_WORD_ANY_CASE), F.lit(0)).alias("w"))
    order = F.array(*map(F.lit, vocabulary))

    def code(w: Column, i: Column) -> Column:
        low = F.lower(w)
        return F.when(low.isin(vocabulary) & (F.octet_length(low) == F.octet_length(w)), i.cast("long") * _CODES + F.array_position(order, low) - 1)

    return words.select("doc_id", "k", "th", F.size("w").cast("long").alias("n_words"), F.filter(F.transform("w", code), lambda x: x.isNotNull()).alias("kept"))


def scan(docs: DataFrame, threshold: float = THRESHOLD, templates: list[tuple[str, str, str]] | None = None, phrases: list[tuple[str, str]] | None = None, text_col: str = "text") -> DataFrame:
    """License labels of every row of docs.

    Returns doc_id, n_words, n_base (places of the phrases), first_word, last_word (smallest and
    largest start of a phrase, words from 0, else null), base_labels, labels (both distinct, sorted,
    comma-joined), score (highest containment of a template or phrase that was found, else 0).
    Null text counts as empty: no words, no labels. Rows with equal id and text get equal results,
    one row each; a null doc_id is kept; further columns are ignored; an empty table gives none.
    What reaches the driver is one count for each word of the templates.
    """
    templates, phrases = templates or TEMPLATES, phrases or PHRASES
    vocabulary = sorted({t for _, text, _ in templates for t in _tokens(text)} | {t for p, _ in phrases for t in _tokens(p)})
    if len(vocabulary) > _CODES:
        raise ValueError(f"templates have more than {_CODES} words")
    base = stable(places(docs, vocabulary, text_col))
    seen = {r["c"]: r["n"] for r in base.select(F.explode("kept").alias("x")).groupBy((F.col("x") % _CODES).alias("c")).agg(F.count(F.lit(1)).alias("n")).collect()}
    rarest = sorted(range(len(vocabulary)), key=lambda c: (seen.get(c, 0), vocabulary[c]))
    rank = {vocabulary[c]: r for r, c in enumerate(rarest)}
    ranks = F.array(*(F.lit(rank[t]) for t in vocabulary))
    own = base.where(F.size("kept") > 0).select("k", "th", F.transform("kept", lambda x: x - x % _CODES + F.get(ranks, (x % _CODES).cast("int"))).alias("kept"))
    own = own.dropDuplicates(["k", "th"]).withColumn("known", F.array_sort(F.array_distinct(F.transform("kept", lambda x: (x % _CODES).cast("int")))))
    found = _contained(own, templates, rank, threshold).unionByName(_consecutive(own, phrases, rank))
    is_base = F.col("starts").isNotNull()
    found = found.groupBy("k", "th").agg(
        F.sum(F.when(is_base, F.size("starts")).otherwise(0)).alias("n_base"),
        F.min(F.array_min("starts")).alias("first_word"),
        F.max(F.array_max("starts")).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(is_base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("score").alias("score"),
    )
    return base.drop("kept").join(found, ["k", "th"], "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        F.col("first_word").cast("long"),
        F.col("last_word").cast("long"),
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def _met(own: DataFrame, index: list[tuple], schema: str) -> DataFrame:
    """Texts with the templates whose first shared prefix token they hold; index rows begin with (token, at, need, tokens, prefix)."""
    table = own.sparkSession.createDataFrame(index, "token int, at int, need int, tokens array<int>, prefix array<int>, " + schema)
    first = F.array(*(F.lit(t) for t in sorted({row[0] for row in index})))
    met = own.select("*", F.explode(F.array_intersect("known", first)).alias("token")).join(F.broadcast(table), "token")  # a few rows for each template
    left_in_text = F.size("known") - F.array_position("known", F.col("token")) + 1
    left_in_template = F.size("tokens") - F.col("at") + 1
    return met.where(
        (F.element_at(F.array_intersect("prefix", "known"), 1) == F.col("token"))  # its first shared token: each pair once
        & (F.size("known") >= F.col("need"))
        & (F.least(left_in_text, left_in_template) >= F.col("need"))
    )


def _contained(own: DataFrame, templates: list[tuple[str, str, str]], rank: dict[str, int], threshold: float) -> DataFrame:
    """(k, th, label, score, starts null) for each text with a block that contains a template."""
    index = []
    for label, text, must in templates:
        tokens = sorted({rank[t] for t in _tokens(text)})
        need = math.ceil(threshold * len(tokens) - 1e-9)
        prefix = tokens[: len(tokens) - need + 1]
        index += [(t, i + 1, need, tokens, prefix, label, [rank[m] for m in must.split()], block_words(text)) for i, t in enumerate(prefix)]
    met = _met(own, index, "label string, must array<int>, words int")
    met = met.where(F.size(F.array_except("must", "known")) == 0)
    met = met.withColumn("own", F.filter("kept", lambda x: F.array_contains("tokens", (x % _CODES).cast("int"))))
    number = lambda x: F.floor(x / _CODES)

    def shared(x: Column, i: Column) -> Column:
        """Tokens of the template in the block that begins at this word; a block holds at most as many places as words."""
        block = F.filter(F.slice(F.col("own"), i + 1, F.col("words")), lambda y: number(y) < number(x) + F.col("words"))
        held = F.array_distinct(F.transform(block, lambda y: (y % _CODES).cast("int")))
        return F.when(F.size(F.array_except("must", held)) == 0, F.size(held)).otherwise(0)

    # A block that does not begin with a token of the template holds no more of them than one that does.
    best = met.select("k", "th", "label", "need", "tokens", F.array_max(F.transform("own", shared)).alias("shared")).where("shared >= need")
    return best.select("k", "th", "label", (F.col("shared") / F.size("tokens")).alias("score"), F.lit(None).cast("array<bigint>").alias("starts"))


def _consecutive(own: DataFrame, phrases: list[tuple[str, str]], rank: dict[str, int]) -> DataFrame:
    """(k, th, label, score 1, starts) for each text that holds a phrase's words consecutively; starts count words from 0."""
    index = []
    for p, label in phrases:
        words = [rank[t] for t in _tokens(p)]
        tokens = sorted(set(words))
        index.append((tokens[0], 1, len(tokens), tokens, tokens[:1], label, words))
    met = _met(own, index, "label string, words array<int>")
    longest = max(len(_tokens(p)) for p, _ in phrases)
    here = lambda x, i, j: F.coalesce(F.get("kept", i + j) == x - x % _CODES + j * _CODES + F.get("words", F.lit(j)), F.lit(False)) | (F.size("words") <= j)
    at = F.filter("kept", lambda x, i: reduce(lambda a, b: a & b, (here(x, i, j) for j in range(longest))))
    found = met.select("k", "th", "label", F.lit(1.0).alias("score"), F.transform(at, lambda x: F.floor(x / _CODES)).alias("starts"))
    return found.where(F.size("starts") > 0)


def oracle_sql() -> str:
    """The same rows in DuckDB's SQL: every block of every text with every template, no filters."""
    tokens = lambda text: "string_split('" + " ".join(_tokens(text)) + "', ' ')"
    templates = ", ".join(f"('{label}', list_distinct({tokens(text)}), {tokens(must)}, {block_words(text)})" for label, text, must in TEMPLATES)
    phrases = ", ".join(f"('{label}', {tokens(p)})" for p, label in PHRASES)
    return f"""
WITH t(label, tokens, must, words) AS (VALUES {templates}),
p(label, pw) AS (VALUES {phrases}),
d AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents),
w AS (SELECT r, doc_id, regexp_extract_all(low, '{WORD}') AS ws FROM d),
b AS (SELECT r, label, tokens, must, words, ws, unnest(list_filter(range(len(ws)), lambda i: list_contains(tokens, ws[i + 1]))) AS i FROM w, t WHERE list_has_all(ws, must)),
m AS (SELECT r, label, max(len(list_intersect(tokens, ws[i + 1:i + words])) / len(tokens)) AS score FROM b
      WHERE len(list_intersect(tokens, ws[i + 1:i + words])) >= ceil({THRESHOLD} * len(tokens) - 1e-9) AND list_has_all(ws[i + 1:i + words], must) GROUP BY r, label),
q AS (SELECT r, label, list_filter(range(len(ws)), lambda i: w.ws[i + 1:i + len(pw)] = pw) AS starts FROM (SELECT r, ws FROM w WHERE len(ws) > 0) w, p),
f AS (SELECT r, label, starts FROM q WHERE len(starts) > 0),
e AS (SELECT r, label, score, NULL AS starts FROM m UNION ALL SELECT r, label, 1.0, starts FROM f),
g AS (SELECT r, sum(coalesce(len(starts), 0)) AS n_base, min(list_min(starts)) AS first_word, max(list_max(starts)) AS last_word,
      array_to_string(list_sort(list(DISTINCT CASE WHEN starts IS NOT NULL THEN label END) FILTER (WHERE starts IS NOT NULL)), ',') AS base_labels,
      array_to_string(list_sort(list(DISTINCT label)), ',') AS labels, max(score) AS score FROM e GROUP BY r)
SELECT w.doc_id, CAST(len(w.ws) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word,
       CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM w LEFT JOIN g ON w.r = g.r"""
