"""License scan: phrases in place, and an exact set-similarity join of text blocks with license templates.

A block is a window of words, twice as long as a template, wherever its words stand: in one line, or wrapped over several.
A template of fewer than SHORT distinct words must stand in a block whole, a longer one to a `threshold` of its distinct
words, its own identifying words among them; so prose that merely uses words of a notice isn't labelled.

One pass over the texts finds the phrases and the places of words that any template has, which is all that containment
depends on. Over all documents the frequency of each such word is counted; words in order of frequency give every
template a short prefix of its rarest words. A document holds the words of all its blocks, so documents join templates
first: on those prefix words only (the prefix index is bounded by the fixed templates, so it is broadcast), with length
and positional filters. The blocks of the pairs that remain are then verified exactly: a block is returned if and only
if it meets the template's threshold and the block that starts at the template's word before it doesn't. No pair of
documents is ever formed; only matches are shuffled, back to their documents.

Defined results: a null text reads as an empty one, which has no words and no blocks; repeated rows are scanned each;
blocks of one template that overlap are one match, at the first; templates of one label may match the same place; very
long texts are scanned whole; an empty table gives an empty one; input columns named like an output column are replaced.
"""

from __future__ import annotations

import math
import re
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyweave.llm.common import materialize, table, without

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases and their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: License notices, their labels and the words that tell them from others.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", "apache"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at apache.org/licenses/LICENSE-2.0", "apache"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "redistribution"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", "creative commons attribution"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0", "cc nc"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3", "gnu"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "gnu general"),
    ("mit", "Released under the MIT License", "mit"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "permission granted charge"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "mozilla"),
)
THRESHOLD = Fraction(4, 5)
#: Templates of fewer distinct words must stand whole; a block is so many times as long as its template.
SHORT, SPREAD = 15, 2


def _all_words(text: str) -> list[str]:
    return re.sub(SEPARATORS, " ", text.translate(str.maketrans(UPPER, LOWER))).split()


def _words(text: str) -> list[str]:
    return sorted(set(_all_words(text)))


def _need(n: int, threshold: Fraction) -> int:
    """Words that a block must share with a template of n distinct words."""
    return n if n < SHORT else max(1, math.ceil(n * threshold))


def _span(text: str) -> int:
    """Words of a template's blocks."""
    return SPREAD * len(_all_words(text))


def scan(docs: DataFrame, text: str = "text", keep: list[str] | None = None, phrases=PHRASES, templates=TEMPLATES, threshold: Fraction = THRESHOLD) -> DataFrame:
    """The `keep` columns of `docs` (all but the text, if not given: whole texts aren't written again) with n_words, n_base, first_word, last_word, base_labels, labels, score and matches.

    matches holds (word, template, containment) of every block (its first word's place) and template that meet the
    threshold; score is the largest containment, 1.0 where a phrase stands.
    """
    names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches")
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in names and (keep is not None or c != text)]
    read = materialize(_read(without(docs, set(names) - {text}), text, kept, phrases, templates, threshold).withColumn("__row", F.monotonically_increasing_id()), "license-blocks")
    found = _join(read, templates, threshold).groupBy("__row").agg(
        F.array_sort(F.flatten(F.collect_list("blocks"))).alias("matches"), F.collect_set("label").alias("__found"), F.max("best").alias("__best")
    )
    out = read.drop("__spots").join(found, "__row", "left")
    labels = F.array_sort(F.array_union(F.col("__base"), F.coalesce("__found", F.array().cast("array<string>"))))
    score = F.greatest(F.when(F.col("n_base") > 0, 1.0).otherwise(0.0), F.coalesce("__best", F.lit(0.0)))
    out = out.withColumns({"labels": F.concat_ws(",", labels), "score": score, "base_labels": F.concat_ws(",", "__base"), "matches": F.coalesce("matches", F.array().cast("array<struct<word:int,template:int,containment:double>>"))})
    return out.select(*[F.col(f"`{c}`") for c in kept], *names)


def _read(docs: DataFrame, text: str, kept: list[str], phrases, templates, threshold: Fraction) -> DataFrame:
    """The one pass over the texts: phrase places, and the places of templates' words as (word, number in the vocabulary)."""
    low = F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), UPPER, LOWER)
    plain = F.concat(F.lit(" "), F.regexp_replace(F.col("__low"), SEPARATORS, " "), F.lit(" "))
    out = docs.withColumn("__low", low)
    out = out.withColumn("__plain", F.regexp_replace(plain, " {2,}", " "))
    spaces = lambda c: F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))
    any_phrase = " (?:" + "|".join(re.escape(p) for p, _ in phrases) + ")(?= )"
    holds = [F.contains(F.col("__plain"), F.lit(f" {p} ")) for p, _ in phrases]
    some = holds[0]
    for h in holds[1:]:
        some = some | h
    upto = lambda form: spaces(F.regexp_extract("__plain", form, 1)).cast("long") - 1
    labels = sorted({label for _, label in phrases})
    by_label = [F.when(_any([h for h, (_, x) in zip(holds, phrases, strict=True) if x == label]), F.lit(label)) for label in labels]
    vocabulary = sorted({w for _, t, _ in templates for w in _words(t)})
    least = min(_need(len(_words(t)), threshold) for _, t, _ in templates)
    known = F.array(*[F.lit(w) for w in vocabulary])
    every = F.transform(F.split(F.trim("__plain"), " "), lambda w, i: F.struct(i.alias("at"), w.alias("w")))
    spots = F.transform(F.filter(every, lambda x: x["w"].isin(vocabulary)), lambda x: F.struct(x["at"].alias("at"), (F.array_position(known, x["w"]) - 1).cast("int").alias("w")))
    return out.withColumns({
        "n_words": F.greatest(spaces(F.col("__plain")) - 1, F.lit(0)).cast("long"),
        "n_base": F.when(some, sum(F.regexp_count("__plain", F.lit(f" (?={re.escape(p)} )")) for p, _ in phrases)).otherwise(0).cast("long"),
        "first_word": F.when(some, upto("(?s)^(.*? )(?:" + any_phrase[4:])),
        "last_word": F.when(some, upto("(?s)^(.* )(?:" + any_phrase[4:])),
        "__base": F.array_compact(F.array(*by_label)),
        "__spots": spots,
    }).withColumn("__spots", F.when(F.size(F.array_distinct(F.transform("__spots", lambda x: x["w"]))) >= least, F.col("__spots"))).select(*[F.col(f"`{c}`") for c in kept], "n_words", "n_base", "first_word", "last_word", "__base", "__spots")


def _inline(spark: SparkSession, names: tuple[str, ...], rows: list[tuple]) -> DataFrame:
    """A small table of literals."""
    return spark.range(1).select(F.inline(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, r, strict=True)]) for r in rows])))


def _any(conditions: list):
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def _join(read: DataFrame, templates, threshold: Fraction) -> DataFrame:
    """(__row, label, blocks, best) of every document and template with blocks that meet the threshold."""
    vocabulary = sorted({w for _, t, _ in templates for w in _words(t)})
    number = {w: k for k, w in enumerate(vocabulary)}
    docs = read.where(F.col("__spots").isNotNull()).select("__row", F.col("__spots").alias("spots"), F.array_distinct(F.transform("__spots", lambda x: x["w"])).alias("words"))
    # Bounded by the templates' vocabulary, however many documents were counted.
    counted = dict(map(tuple, docs.select(F.explode("words").alias("w")).groupBy("w").count().collect()))
    order = sorted(range(len(vocabulary)), key=lambda w: (counted.get(w, 0), w))
    rank = {w: k for k, w in enumerate(order)}
    index = []
    for k, (label, t, own) in enumerate(templates):
        words = sorted((number[w] for w in _words(t)), key=rank.__getitem__)
        need = _need(len(words), threshold)
        index += [(k, label, w, len(words), need, at, words, [number[x] for x in own.split()], _span(t)) for at, w in enumerate(words[: len(words) - need + 1])]
    names = ("template", "label", "word", "size", "need", "at", "set", "own", "span")
    index = _inline(read.sparkSession, names, index)
    ordered = docs.withColumn("words", F.array_intersect(F.array(*[F.lit(w) for w in order]), "words")).withColumn("n", F.size("words"))
    probes = ordered.select("__row", "spots", "words", "n", F.posexplode("words").alias("i", "word"))
    near = probes.join(F.broadcast(index), "word").where((F.col("n") >= F.col("need")) & (F.col("i") <= F.col("n") - F.col("need")) & (1 + F.least(F.col("n") - F.col("i") - 1, F.col("size") - F.col("at") - 1) >= F.col("need")))
    both = near.withColumn("both", F.array_intersect("words", "set"))
    # A pair is probed once a shared prefix word; only its first shared word counts.
    pairs = both.where((F.size("both") >= F.col("need")) & (F.element_at("both", 1) == F.col("word")))
    places = pairs.select("__row", "template", "label", "size", "need", "own", "span", F.filter("spots", lambda x: F.array_contains("set", x["w"])).alias("spots"))
    window = lambda x, i: F.transform(F.filter(F.slice("spots", i + 1, F.col("span")), lambda y: y["at"] < x["at"] + F.col("span")), lambda y: y["w"])
    held = places.withColumn("held", F.transform("spots", lambda x, i: F.struct(x["at"].alias("word"), F.array_distinct(window(x, i)).alias("ws"))))
    met = lambda x: (F.size(x["ws"]) >= F.col("need")) & (F.size(F.array_intersect(x["ws"], "own")) == F.size("own"))
    rated = held.withColumn("rated", F.transform("held", lambda x: F.struct(x["word"].alias("word"), F.when(met(x), F.size(x["ws"]) / F.col("size")).alias("c"))))
    first = lambda x, i: x["c"].isNotNull() & ((i == 0) | F.get("rated", i - 1)["c"].isNull())
    blocks = rated.select("__row", "label", F.array_max(F.transform("rated", lambda x: x["c"])).alias("best"), F.transform(F.filter("rated", first), lambda x: F.struct(x["word"].alias("word"), F.col("template").alias("template"), x["c"].alias("containment"))).alias("blocks"))
    return blocks.where("best is not null")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scanned."""
    out = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    shown = F.concat_ws(",", F.transform("matches", lambda m: F.concat_ws(":", m["word"].cast("string"), m["template"].cast("string"))))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", shown.alias("matches"))


def _sql() -> str:
    quoted = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
    rows = ", ".join(f"({k}, '{label}', {quoted(ws)}, {_need(len(ws), THRESHOLD)}, {quoted(own.split())}, {_span(t)})" for k, (label, t, own) in enumerate(TEMPLATES) for ws in [_words(t)])
    phrases = ", ".join("('{}', [{}])".format(label, ", ".join(f"'{w}'" for w in p.split())) for p, label in PHRASES)
    fold = f"translate({{}}, '{UPPER}', '{LOWER}')"
    word = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {fold.format("coalesce(text, '')")} AS t FROM documents),
w AS (SELECT rid, doc_id, regexp_extract_all(t, {word}) AS ws FROM d),
u AS (SELECT rid, unnest(ws) AS a, generate_subscripts(ws, 1) - 1 AS i FROM w),
v AS (SELECT rid, i, [a, lead(a) OVER p, lead(a, 2) OVER p] AS g FROM u WINDOW p AS (PARTITION BY rid ORDER BY i)),
b AS (SELECT rid, i, label FROM v JOIN (VALUES {phrases}) p(label, words) ON g[1] = words[1] AND list_slice(g, 1, len(words)) = words),
ba AS (SELECT rid, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list_sort(list_distinct(list(label))) AS base FROM b GROUP BY rid),
t AS (SELECT * FROM (VALUES {rows}) t(k, label, words, need, own, span)),
p AS (SELECT rid, k, i, a FROM u JOIN (SELECT k, unnest(words) AS a FROM t) USING (a)),
c AS (SELECT x.rid, x.k, x.i, list(DISTINCT y.a) AS held FROM p x JOIN t USING (k) JOIN p y ON y.rid = x.rid AND y.k = x.k AND y.i >= x.i AND y.i < x.i + t.span GROUP BY x.rid, x.k, x.i),
m AS (SELECT rid, k, i, label, len(held) / CAST(len(words) AS DOUBLE) AS c, len(held) >= need AND len(list_intersect(held, own)) = len(own) AS met FROM c JOIN t USING (k)),
s AS (SELECT *, NOT coalesce(lag(met) OVER (PARTITION BY rid, k ORDER BY i), false) AS first FROM m),
ma AS (SELECT rid, list_distinct(list(label)) AS found, max(c) AS best, string_agg(i || ':' || k, ',' ORDER BY i, k) FILTER (first) AS matches FROM s WHERE met GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(array_to_string(base, ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(found, [])))), ','), '') AS labels,
       greatest(CASE WHEN n_base > 0 THEN 1e0 ELSE 0e0 END, coalesce(best, 0e0)) AS score, coalesce(matches, '') AS matches
FROM w LEFT JOIN ba USING (rid) LEFT JOIN ma USING (rid)"""


ORACLE_SQL = _sql()
