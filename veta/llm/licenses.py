"""License scans: phrases that name a license, and an exact containment join with license templates.

Words are runs of ASCII letters and digits (A-Z in lower case) and of anything beyond ASCII.  A *phrase* is found where its
words stand consecutively.  A *template* is a set of words; a text meets it when a window of it, a run of words over line
ends and all, holds at least ``threshold`` of the template's words, and among them all words and phrases of ``MARKS`` that the template has.  So that each window lies whole in some text block,
blocks are runs of ``STEP`` words and those of one window more.  The join is exact and filtered:

* words are put in order by how often they occur in all texts, rare ones first;
* prefix: of a template of n words that needs a common words, some of the n - a + 1 rarest must be in the block;
* length: the block must hold at least a words that any template has;
* position: after the first common word enough words must be left in both, in that order, to reach a.

What is left is verified by intersecting the word sets of the block, then of its windows.  Everything is DataFrame functions; the table of templates and its
word counts are fixed in size, so they may be broadcast and read by the driver.

Nulls are empty texts: no words, no labels, score 0.  Repeated rows give repeated results; rows are told apart by key and
text, so equal keys with other texts keep their own results.  Null keys and extra columns do no harm; empty tables give
no rows.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veta.llm.common import narrow, query, table
from veta.session import materialise

# Phrases and their labels as asked for.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Sentences of public licenses and customary notices, by label.
TEMPLATES = (
    ("mit-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit-text", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("mit-text", "The software is provided as is, without warranty of any kind, express or implied"),
    ("mit-notice", "Released under the MIT License"),
    ("mit-notice", "This project is licensed under the MIT License"),
    ("apache-text", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License"),
    ("apache-text", "distributed under the License is distributed on an AS IS basis, without warranties or conditions of any kind"),
    ("apache-notice", "Licensed under the Apache License, Version 2.0"),
    ("gpl-text", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("gpl-text", "This program is distributed in the hope that it will be useful, but without any warranty"),
    ("gpl-notice", "This work is licensed under the GNU General Public License, version 3"),
    ("bsd-text", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-notice", "This work is licensed under a Creative Commons Attribution International License"),
    ("cc-by-nc-notice", "Licensed under CC BY-NC 4.0"),
    ("rights-notice", "Copyright all rights reserved"),
)

# Words and phrases that tell a license from others and from prose; a window must hold those of its template.
MARKS = ("mit", "apache", "gnu general public license", "cc by nc", "creative commons", "license", "associated documentation", "substantial portions", "provided", "warranty",
         "kind", "implied", "warranties", "conditions", "program", "hope", "redistribution", "binary", "copyright", "reserved")

THRESHOLD = 0.8
#: Words of a window: ``SLACK`` times those of the template, and ``LEAST_WINDOW`` for short ones; words by which blocks follow each other.
SLACK, LEAST_WINDOW, STEP = 2, 24, 200
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def spaced(text: Column) -> Column:
    """The words of a text in lower case with one space between them."""
    return F.trim(F.regexp_replace(F.translate(text, UPPER, LOWER), NOT_WORD, " "))


def spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def phrase_columns(padded: Column, phrase: str) -> tuple[Column, Column, Column]:
    """Places of a phrase in a text of words with spaces around, its first and its last start as word numbers."""
    mark = f" {phrase} "
    has = F.contains(padded, F.lit(mark))
    count = F.when(has, F.size(F.split(padded, f"(?<= ){phrase}(?= )")) - 1).otherwise(0)
    first = F.locate(mark, padded)
    last = F.length(padded) - F.locate(mark[::-1], F.reverse(padded)) - len(mark) + 2
    return count, *[F.when(has, spaces(F.substring(padded, F.lit(1), at)) - 1) for at in (first, last)]


def phrases(docs: DataFrame, wanted: dict[str, str] = PHRASES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, h, n_words, n_base, first_word, last_word, base array<string>) of every row; h is a hash of the text."""
    frame = narrow(docs, key=key, text=text).select("key", F.xxhash64("text").alias("h"), F.concat(F.lit(" "), spaced(F.coalesce("text", F.lit(""))), F.lit(" ")).alias("p"))
    p = F.col("p")
    found = [(label, *phrase_columns(p, phrase)) for phrase, label in wanted.items()]
    first, last = (F.least(*[f[k] for f in found]) if len(found) > 1 else found[0][k] for k in (2, 3))
    last = F.greatest(*[f[3] for f in found]) if len(found) > 1 else last
    labels = F.filter(F.array_distinct(F.array(*[F.when(f[1] > 0, F.lit(f[0])) for f in found])), lambda x: x.isNotNull())
    return frame.select("key", "h", F.when(p == "  ", 0).otherwise(spaces(p) - 1).cast("long").alias("n_words"),
                        reduce(lambda a, b: a + b, [f[1] for f in found]).cast("long").alias("n_base"),
                        first.cast("long").alias("first_word"), last.cast("long").alias("last_word"), labels.alias("base"))


def spelt(text: str) -> str:
    """As ``spaced``, of a string."""
    kept = "".join(c if c.isascii() and c.isalnum() or not c.isascii() else " " for c in text)
    return " ".join("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in kept.split())


def template_words(text: str) -> list[str]:
    return sorted(set(spelt(text).split()))


def marks_of(text: str) -> list[str]:
    return [m for m in MARKS if f" {m} " in f" {spelt(text)} "]


def frequencies(docs: DataFrame, words: list[str], text: str = "text") -> dict[str, int]:
    """How often each of these words occurs in all texts."""
    each = docs.select(F.explode(F.split(spaced(F.col(f"`{text}`")), " ")).alias("word"))
    found = each.where(F.col("word").isin(words)).groupBy("word").count()
    return dict.fromkeys(words, 0) | {r.word: r["count"] for r in found.collect()}


def local(docs: DataFrame, rows: list[Column]) -> DataFrame:
    return docs.sparkSession.range(1).select(F.inline(F.array(*rows)))


def containment(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, h, block, label, score): every block with a window that meets a template, with the largest share of its words in one window."""
    sets = [(label, template_words(t), max(LEAST_WINDOW, SLACK * len(spelt(t).split())), marks_of(t)) for label, t in templates]
    vocabulary = sorted({w for _, ws, *_ in sets for w in ws})
    often = frequencies(docs, vocabulary, text)
    rank = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (often[w], w)))}
    index, starts = [], set()
    for no, (label, words, window, marks) in enumerate(sets):
        words, need = sorted(words, key=rank.get), math.ceil(threshold * len(words) - 1e-9)
        for at, word in enumerate(words[: len(words) - need + 1]):
            starts.add(word)
            index.append(F.struct(F.lit(word).alias("word"), F.lit(no).alias("no"), F.lit(label).alias("label"), F.array(*map(F.lit, words)).alias("words"),
                                  F.lit(window).alias("window"), F.array(*map(F.lit, marks)).cast("array<string>").alias("marks"), F.lit(len(words) - at).alias("rest"), F.lit(need).alias("need")))
    ranks = F.create_map(*[F.lit(x) for w in vocabulary for x in (w, rank[w])])
    frame = narrow(docs, key=key, text=text)
    size = STEP + max((window for _, _, window, _ in sets), default=0)
    pieces = lambda w: F.transform(F.sequence(F.lit(0), F.floor((F.size(w) - 1) / STEP).cast("int")), lambda i: F.slice(w, i * STEP + 1, size))
    # As a lambda's argument the text is split once, not for each piece.
    runs = frame.select("key", F.xxhash64("text").alias("h"), F.posexplode(F.transform(F.array(F.split(spaced(F.col("text")), " ")), pieces)[0]).alias("block", "run"))
    near = runs.where(F.arrays_overlap("run", F.array(*map(F.lit, sorted(starts)))))
    # In the order of the words' frequencies; words of no template cannot add to an overlap.
    common = F.transform(F.array_sort(F.transform(F.array_intersect("run", F.array(*map(F.lit, vocabulary))), lambda w: F.struct(ranks[w].alias("r"), w.alias("w")))), lambda x: x["w"])
    blocks = near.select("key", "h", "block", "run", common.alias("held"))
    overlap = F.array_intersect("held", "words")
    # Of the words that a block and a template share the first one stands for the pair.
    met = (blocks.select("*", F.posexplode("held").alias("at", "word")).join(F.broadcast(local(docs, index)), "word")
           .where((F.size("held") >= F.col("need")) & (F.least(F.col("rest"), F.size("held") - F.col("at")) >= F.col("need")))
           .where((overlap[0] == F.col("word")) & (F.size(overlap) >= F.col("need"))))
    heads = F.filter(F.sequence(F.lit(1), F.size("run")), lambda i: F.array_contains("words", F.element_at("run", i)))
    marked = lambda run: F.forall("marks", lambda m: F.contains(F.concat(F.lit(" "), F.array_join(run, " "), F.lit(" ")), F.concat(F.lit(" "), m, F.lit(" "))))
    window = lambda i: F.slice("run", i, F.col("window"))
    most = F.array_max(F.transform(heads, lambda i: F.when(marked(window(i)), F.size(F.array_intersect(window(i), F.col("words")))).otherwise(0)))
    return (met.where(marked(F.col("run"))).select("key", "h", "block", "label", "need", "words", most.alias("most")).where(F.col("most") >= F.col("need"))
            .select("key", "h", "block", "label", (F.col("most") / F.size("words")).alias("score")))


def scan(docs: DataFrame, wanted: dict[str, str] = PHRASES, templates=TEMPLATES, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row.

    ``score`` is the largest share of a template found in a block of the text, and 1 where a phrase names the license.
    """
    base = phrases(docs, wanted, key, text)
    met = (containment(docs, templates, threshold, key, text).groupBy("key", "h")
           .agg(F.collect_set("label").alias("more"), F.max("score").alias("best")).withColumnsRenamed({"key": "k", "h": "g"}))
    joined = base.join(materialise(met), F.col("key").eqNullSafe(F.col("k")) & F.col("h").eqNullSafe(F.col("g")), "left")
    every = F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))))
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0)))
    return joined.select(F.col("key").alias(key), "n_words", "n_base", "first_word", "last_word", F.array_join(F.array_sort("base"), ",").alias("base_labels"),
                         F.array_join(every, ",").alias("labels"), score.alias("score"))


def oracle() -> str:
    """The same scan in SQL, phrase by phrase and template by template."""
    low = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
    split = r"list_filter(regexp_split_to_array({}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
    named = ", ".join(f"('{p}', {len(p.split())}, '{label}')" for p, label in PHRASES.items())
    texts = ", ".join(f"({i}, '{label}', {template_words(t)})" for i, (label, t) in enumerate(TEMPLATES))
    return f"""WITH phrase(p, n, label) AS (VALUES {named}), template(no, label, held) AS (VALUES {texts}),
    d AS (SELECT doc_id, {split.format(low)} AS w, string_split({low}, chr(10)) AS lines FROM documents),
    b AS (SELECT doc_id, i - 1 AS place, label FROM d, phrase, range(1, len(w) + 1) r(i) WHERE array_to_string(w[i:i + n - 1], ' ') = p),
    base AS (SELECT doc_id, count(*) AS n, min(place) AS first, max(place) AS last, list(DISTINCT label) AS labels FROM b GROUP BY 1),
    line AS (SELECT doc_id, list_distinct({split.format("line")}) AS held FROM (SELECT doc_id, unnest(lines) AS line FROM d)),
    met AS (SELECT doc_id, label, len(list_intersect(l.held, t.held)) / len(t.held)::DOUBLE AS share FROM line l, template t
      WHERE len(list_intersect(l.held, t.held)) >= ceil({THRESHOLD} * len(t.held) - 1e-9)),
    more AS (SELECT doc_id, list(DISTINCT label) AS labels, max(share) AS best FROM met GROUP BY 1)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, first::BIGINT AS first_word, last::BIGINT AS last_word,
      coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
      array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(more.labels, [])))), ',') AS labels,
      CASE WHEN n > 0 THEN 1.0 ELSE coalesce(best, 0.0) END::DOUBLE AS score FROM d LEFT JOIN base USING (doc_id) LEFT JOIN more USING (doc_id)"""


@query("op7_licenses", oracle())
def op7_licenses(spark, sf):
    return scan(table(spark, sf, "documents"))
