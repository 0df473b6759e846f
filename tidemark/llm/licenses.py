"""Licence scan: phrases that stand in a text, and an exact set-similarity join of text blocks with licence templates.

DataFrame functions only. A block is a line of a text, as the set of its words; a template matches when the block holds at least
``CONTAINMENT`` of the template's different words. All template words are ordered by how often the whole corpus has them,
rarest first. A block that holds enough of a template must share one of its first ``size - need + 1`` words (prefix filter), must
have ``need`` words at all (length filter), and the words of the template from its first shared one on must still suffice (positional
filter). What passes is verified by counting the shared words, so no match is missed and none is wrong.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.session import local_frame

CONTAINMENT = 0.85

# Phrases and openings of public licences.
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"
            " the software to deal in the software without restriction"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"
            " as published by the free software foundation"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What stands between words, before and after A-Z are lowered.
_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def lowered(text: Column) -> Column:
    """Lower case, the same for words of ASCII as if A-Z alone were lowered: the two other letters that would turn into ASCII are kept apart."""
    return F.lower(F.replace(F.replace(text, F.lit("\u212a"), F.lit("\u0199")), F.lit("\u0130"), F.lit("\u0131")))


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, _BETWEEN), "")


def phrase_hits(ws: Column, phrase: str) -> Column:
    """Start positions (words from 0) of a phrase in an array of words."""
    parts = phrase.split()
    ends = F.filter(F.transform(ws, lambda w, i: F.when(w == parts[-1], i - (len(parts) - 1))), lambda i: i.isNotNull() & (i >= 0))
    return F.filter(ends, lambda i: _same(ws, i, parts))


def _same(ws: Column, at: Column, parts: list[str]) -> Column:
    same = F.lit(True)
    for k, p in enumerate(parts[:-1]):
        same = same & (F.get(ws, at + k) == p)
    return same


def template_words(spark: SparkSession, templates: list[tuple[str, str]], containment: float) -> DataFrame:
    """(template, label, word, size, need): the different words of every template. Its size is the number of templates times theirs."""
    rows = []
    for k, (label, text) in enumerate(templates):
        different = sorted(set(text.split()))
        need = -(-round(containment * 1000) * len(different) // 1000)
        rows += [(k, label, w, len(different), need) for w in different]
    return local_frame(spark, rows, "template int, label string, word string, size int, need int")


def matches(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """(doc_id, text_key, block, template, label, shared, containment): every block that holds enough of a template.

    ``docs`` has doc_id, text_key and text; rows equal in doc_id and text_key give one set of rows. Blocks are lines, from 0.
    """
    spark = docs.sparkSession
    every = template_words(spark, templates, containment)
    vocabulary = sorted({w for _, t in templates for w in t.split()})
    counted = docs.select(F.explode(words(lowered(F.col("text")))).alias("word")).where(F.col("word").isin(vocabulary)).groupBy("word").agg(F.count("*").alias("df"))
    ordered = every.join(counted, "word", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    rank = Window.partitionBy("template").orderBy("df", "word")
    prefixes = ordered.withColumn("place", F.row_number().over(rank)).where(F.col("place") <= F.col("size") - F.col("need") + 1)
    # as many rows as the templates have prefix words, whatever the corpus
    rows = prefixes.select("template", "label", "word", "size", "need", "place").collect()
    prefixes = local_frame(spark, [tuple(r) for r in rows], "template int, label string, word string, size int, need int, place int")
    first_words = F.array(*(F.lit(w) for w in sorted({r.word for r in rows})))
    literal = F.array(*(F.lit(w) for w in vocabulary))
    least = min((r.need for r in rows), default=1)
    blocks = docs.select("doc_id", "text_key", F.posexplode(F.split(lowered(F.col("text")), "\n")).alias("block", "line"))
    # the generator keeps the words from being split again by every condition on them
    split = blocks.select("doc_id", "text_key", "block", F.explode(F.array(words(F.col("line")))).alias("ws"))
    split = split.where((F.size("ws") >= least) & F.arrays_overlap("ws", first_words))
    sets = split.select("doc_id", "text_key", "block", F.explode(F.array(F.array_distinct("ws"))).alias("ws")).select(
        "doc_id", "text_key", "block", F.size("ws").alias("n_words"), F.array_intersect("ws", literal).alias("ws"))
    # shared words in the global order: what comes before a shared word can't be a part of the overlap counted from it
    found = sets.select("*", F.explode("ws").alias("word")).join(F.broadcast(prefixes), "word")
    found = found.where((F.col("n_words") >= F.col("need")) & (F.size("ws") >= F.col("need")))
    found = found.groupBy("doc_id", "text_key", "block", "template", "label", "size", "need").agg(F.min("place").alias("place"), F.first("ws").alias("ws"))
    found = found.where(F.col("size") - F.col("place") + 1 >= F.col("need"))
    full = F.broadcast(every.groupBy("template").agg(F.collect_list("word").alias("all")))
    shared = F.size(F.array_intersect("ws", "all"))
    return (
        found.select("doc_id", "text_key", "block", "template", "label", "size", "need", "ws").join(full, "template")
        .withColumn("shared", shared).where(F.col("shared") >= F.col("need"))
        .select("doc_id", "text_key", "block", "template", "label", "shared", (F.col("shared") / F.col("size")).alias("containment")).distinct()
    )


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score): one row per row of ``docs`` (doc_id, text).

    Null text is empty text: no words, nulls for the places, empty labels, score 0. The score is 1 where a phrase stands, else the
    highest containment of a matching template, else 0. Repeated rows stay repeated; extra columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    keyed = docs.withColumn("text_key", F.xxhash64("text"))
    ending = sorted({p.split()[-1] for p, _ in PHRASES})
    hinted = F.lit(False)
    for w in ending:
        hinted = hinted | F.contains(lowered(F.col("text")), F.lit(w))
    base = keyed.select("doc_id", "text_key", F.size(words(F.col("text"))).cast("long").alias("n_words"),
                        F.when(hinted, words(lowered(F.col("text")))).otherwise(F.array().cast("array<string>")).alias("ws"))
    base = base.select("doc_id", "text_key", "n_words", *(phrase_hits(F.col("ws"), p).alias(f"hits{k}") for k, (p, _) in enumerate(PHRASES)))
    hits = [F.col(f"hits{k}") for k in range(len(PHRASES))]
    every = F.concat(*hits)
    of_phrases = F.array_compact(F.array(*(F.when(F.size(h) > 0, F.lit(label)) for h, (_, label) in zip(hits, PHRASES))))
    base = base.select("doc_id", "text_key", "n_words", F.size(every).cast("long").alias("n_base"), F.array_min(every).cast("long").alias("first_word"),
                       F.array_max(every).cast("long").alias("last_word"), F.array_sort(F.array_distinct(of_phrases)).alias("own"))
    more = matches(keyed, templates, containment).groupBy(F.col("doc_id").alias("id"), F.col("text_key").alias("key")).agg(
        F.collect_set("label").alias("more"), F.max("containment").alias("best"))
    out = base.join(more, base["doc_id"].eqNullSafe(more["id"]) & (base["text_key"] == more["key"]), "left")
    both = F.array_sort(F.array_union("own", F.coalesce("more", F.array().cast("array<string>"))))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("own", ",").alias("base_labels"), F.array_join(both, ",").alias("labels"),
                      F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"))


def scan_sql(templates: list[tuple[str, str]] = TEMPLATES, containment: float = CONTAINMENT) -> str:
    """The scan as DuckDB SQL: every line against every template, without filters."""
    listed = ", ".join(f"({k}, '{label}', {sorted(set(t.split()))})" for k, (label, t) in enumerate(templates))
    low = f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')"
    phrases = ", ".join(f"('{p}', '{label}')" for p, label in PHRASES)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {low} AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '{_WORD}') AS ws FROM d),
p(phrase, label) AS (VALUES {phrases}),
x AS (SELECT r, ws, unnest(range(len(ws))) AS i FROM w WHERE contains(t, 'license')),
h AS (SELECT r, i, label FROM x, p WHERE array_to_string(ws[i + 1 : i + len(string_split(phrase, ' '))], ' ') = phrase),
b AS (SELECT r, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS own FROM h GROUP BY r),
t(k, label, tw) AS (VALUES {listed}),
l AS (SELECT r, list_distinct(regexp_extract_all(unnest(string_split(t, chr(10))), '{_WORD}')) AS s FROM d),
m AS (SELECT r, label, len(list_intersect(s, tw)) / len(tw) AS c FROM l, t WHERE len(list_intersect(s, tw)) >= ceil(len(tw) * {round(containment * 1000)} / 1000)),
g AS (SELECT r, list(DISTINCT label) AS more, max(c) AS best FROM m GROUP BY r)
SELECT doc_id, len(ws) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(array_to_string(list_sort(own), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(own, []), coalesce(more, [])))), ','), '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0)::DOUBLE END AS score
FROM w LEFT JOIN b USING (r) LEFT JOIN g USING (r)"""
