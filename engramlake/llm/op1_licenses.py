"""License scans: an exact set-similarity join of text blocks with license templates.

A block is a line with words, or any number of such lines in a row with at most WRAP words more than the
template, so that a wrapped notice is found however narrow its column. It matches a template when it holds at least THRESHOLD
of the template's distinct words. Tokens are ordered by their frequency in the whole corpus, rarest
first. A match has one of a template's first ``size - need + 1`` tokens (prefix filter), as many
template words as are needed (length filter), and enough tokens of both left after the first shared
one (positional filter); what passes is verified exactly. Texts are read once, to a table of each
line's template words. Templates are a parameter of fixed size, and so are the tokens counted;
nothing else is collected or broadcast.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, once, sums_before, table, text_hash, written

#: Base phrases and their labels (fixed by the contract).
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Short notices of public licenses by label, as words.
TEMPLATES = {
    "apache-2.0": "licensed under the apache license version 2 0",
    "apache-2.0-notice": "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "cc-by": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "cc-by-sa": "licensed under a creative commons attribution sharealike license",
    "cc0": "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    "gpl": "this work is licensed under the gnu general public license version 3",
    "gpl-notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "lgpl": "licensed under the gnu lesser general public license",
    "mit": "released under the mit license",
    "mit-notice": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "unlicense": "this is free and unencumbered software released into the public domain",
}
THRESHOLD = 0.8
#: Words of a block of several lines beyond the template's: what stands before and after a notice in its first and last line.
WRAP = 32
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def count_words(joined: Column) -> Column:
    return F.when(joined == "", 0).otherwise(F.length(joined) - F.length(F.replace(joined, F.lit(" "), F.lit(""))) + 1)


def need(size: int, threshold: float) -> int:
    """The fewest shared tokens of a template with so many."""
    return max(1, math.ceil(threshold * size - 1e-9))


def token_sets(templates: dict[str, str]) -> dict[str, list[str]]:
    """The distinct words of each template that has any."""
    return {k: sorted(set(v.split())) for k, v in templates.items() if v.split()}


def _phrase(p: str) -> Column:
    """The places of a phrase in ``w``, the text's words between spaces: how many, first and last."""
    # between places of the phrase, which share spaces but no words
    gaps = F.split("w", f"(?<= ){p}(?= )", -1)
    count = lambda piece: count_words(F.btrim(piece))
    places = F.struct(
        (F.size(gaps) - 1).cast("long").alias("n"),
        count(F.get(gaps, F.lit(0))).cast("long").alias("first"),
        (F.col("n_words") - count(F.element_at(gaps, -1)) - len(p.split())).cast("long").alias("last"),
        F.lit(PHRASES[p]).alias("label"),
    )
    return F.when(F.contains("w", F.lit(f" {p} ")), places)


def scanned(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """A row for each row of docs: doc_id, text_hash, n_words, ``found`` (places of each base phrase) and ``lines``: for each line with words how many and which distinct ones templates have."""
    vocabulary = sorted({t for s in token_sets(templates).values() for t in s})
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    lines = F.transform(F.split(ascii_lower(F.col("text")), "\n", -1), lambda t: F.btrim(F.regexp_replace(t, _GAP, " ")))
    rows = rows.select("doc_id", text_hash(F.col("text")).alias("text_hash"), F.filter(lines, lambda t: t != "").alias("lines"))
    rows = rows.select("doc_id", "text_hash", "lines", F.array_join("lines", " ").alias("words"))
    rows = rows.select("doc_id", "text_hash", "lines", F.concat(F.lit(" "), "words", F.lit(" ")).alias("w"), count_words(F.col("words")).cast("long").alias("n_words"))
    known = lambda t: F.array_intersect(F.split(t, " "), F.array(*map(F.lit, vocabulary)).cast("array<string>"))
    return rows.select(
        "doc_id",
        "text_hash",
        "n_words",
        F.filter(F.array(*map(_phrase, PHRASES)), lambda x: x.isNotNull()).alias("found"),
        F.transform("lines", lambda t: F.struct(count_words(t).alias("n"), known(t).alias("known"))).alias("lines"),
    )


def template_matches(rows: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD, wrap: int | None = WRAP) -> DataFrame:
    """doc_id, text_hash, line (the block's first, of those with words, from 0), n_lines, label and containment of every block of ``scanned`` rows that meets the threshold.

    Templates without words are left out. A block of several lines has at most ``wrap`` words more than the
    template has distinct ones (null: any number, so that all stretches of lines around a shared token are looked at). Counts the templates' tokens over all lines first, one row a token.
    """
    sets = token_sets(templates)
    spark = rows.sparkSession
    if not sets:
        return spark.createDataFrame([], "doc_id long, text_hash long, line int, n_lines int, label string, containment double")
    seen = rows.select(F.explode(F.flatten(F.transform("lines", lambda x: x["known"]))).alias("token")).groupBy("token").count()
    frequency = {r["token"]: r["count"] for r in seen.collect()}  # at most one row for each token of the templates
    rarest = lambda tokens: sorted(tokens, key=lambda t: (frequency.get(t, 0), t))
    order = {k: rarest(s) for k, s in sets.items()}
    prefixes = [(t, k, i + 1, len(s), need(len(s), threshold)) for k, s in order.items() for i, t in enumerate(s[: len(s) - need(len(s), threshold) + 1])]
    index = F.broadcast(spark.createDataFrame(prefixes, "token string, label string, place int, size int, need int"))
    full = F.broadcast(spark.createDataFrame(list(order.items()), "label string, template array<string>"))
    lead = F.array(*map(F.lit, rarest({p[0] for p in prefixes})))
    every = F.array(*map(F.lit, rarest({t for s in sets.values() for t in s})))
    # lines with a prefix token, with the lines around them that a block can have: each has a word at least
    most = 2**31 - 1 if wrap is None else wrap + max(map(len, sets.values()))
    spots = rows.select("doc_id", "text_hash", "lines").filter(F.exists("lines", lambda x: F.arrays_overlap(x["known"], lead)))
    spots = once(spots, _n=F.transform("lines", lambda x: x["n"].cast("long")))
    spots = once(spots, _before=sums_before("_n"))
    spots = once(spots, _after=F.zip_with("_before", "_n", lambda x, n: x + n))
    top = F.size("lines") - 1
    with_lead = F.filter(F.sequence(F.lit(0), top), lambda i: F.arrays_overlap(F.get("lines", i)["known"], lead))
    words = lambda i, k: F.get("_after", k) - F.get("_before", i)
    first = lambda i: F.array_min(F.filter(F.sequence(F.greatest(i - most, F.lit(0)), i), lambda k: (k == i) | (words(k, i) <= most)))
    last = lambda i: F.array_max(F.filter(F.sequence(i, F.least(F.lit(most).cast("long") + i, top.cast("long")).cast("int")), lambda k: (k == i) | (words(i, k) <= most)))
    spots = spots.select("doc_id", "text_hash", "lines", "_before", "_after", F.explode(F.transform(with_lead, lambda i: F.struct(i.alias("line"), first(i).alias("low"), last(i).alias("high")))).alias("s"))
    near = lambda c: F.transform(F.sequence("s.low", "s.high"), lambda k: F.get(c, k))
    spots = spots.select("doc_id", "text_hash", "s.line", (F.col("s.line") - F.col("s.low")).alias("at"), near("lines").alias("near"), near("_before").alias("before"), near("_after").alias("after"))
    probes = spots.select("*", F.explode(F.array_intersect(lead, F.get("near", F.col("at"))["known"])).alias("token")).join(index, "token")
    # blocks that hold the line, by their first and last line among those near
    fits = lambda i, k: (i == k) | (F.get("after", k) - F.get("before", i) <= (F.lit(2**62) if wrap is None else F.col("size") + wrap))
    ends = lambda i: F.filter(F.sequence(F.col("at"), F.size("near") - 1), lambda k: fits(i, k))
    spans = F.flatten(F.transform(F.sequence(F.lit(0), F.col("at")), lambda i: F.transform(ends(i), lambda k: F.struct(i.alias("first"), k.alias("last")))))
    blocks = probes.select("*", F.inline(spans))
    block = F.transform(F.sequence("first", "last"), lambda k: F.get("near", k))
    blocks = blocks.select("doc_id", "text_hash", (F.col("line") - F.col("at") + F.col("first")).alias("line"), (F.col("last") - F.col("first") + 1).alias("n_lines"), "label", "token", "place", "size", "need", block.alias("block"))
    # the block's tokens, rarest first; length and positional filter, then verification at the first shared token
    tokens = blocks.select("*", F.array_intersect(every, F.flatten(F.transform("block", lambda x: x["known"]))).alias("tokens")).filter(F.size("tokens") >= F.col("need"))
    left = 1 + F.least(F.size("tokens") - F.array_position("tokens", F.col("token")), F.col("size") - F.col("place"))
    shared = tokens.filter(left >= F.col("need")).join(full, "label").select("*", F.array_intersect("template", "tokens").alias("shared"))
    checked = shared.filter((F.get("shared", F.lit(0)) == F.col("token")) & (F.size("shared") >= F.col("need")))
    return checked.select("doc_id", "text_hash", "line", "n_lines", "label", (F.size("shared") / F.col("size")).alias("containment")).distinct()


def scan_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Base phrases are found word by word in the whole text, templates by ``template_matches``. The score
    is 1 with a base phrase, else the highest containment, else 0. Null and empty texts have no words;
    rows that share doc_id and text have equal results, and an empty table gives no rows. Very long texts are
    looked through whole.
    """
    base = written(scanned(docs, templates))
    best = template_matches(base, templates, threshold).groupBy("doc_id", "text_hash").agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"))
    best = best.select(F.col("doc_id").alias("m_id"), F.col("text_hash").alias("m_hash"), "more", "best")
    out = base.drop("lines").join(best, F.col("doc_id").eqNullSafe(F.col("m_id")) & (F.col("text_hash") == F.col("m_hash")), "left")
    labels = F.array_sort(F.array_distinct(F.transform("found", lambda x: x["label"])))
    return out.select(
        "doc_id",
        "n_words",
        F.aggregate("found", F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("n_base"),
        F.array_min(F.transform("found", lambda x: x["first"])).alias("first_word"),
        F.array_max(F.transform("found", lambda x: x["last"])).alias("last_word"),
        F.array_join(labels, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(labels, F.coalesce("more", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(F.size("found") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def _sql() -> str:
    """Phrases by comparing neighbouring words; templates by intersecting every block of lines with every template."""
    gap = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')".format
    split = lambda c: f"list_filter(string_split(regexp_replace({lower(c)}, '{gap}', ' ', 'g'), ' '), lambda x: x <> '')"
    places = []
    for p, label in PHRASES.items():
        words = p.split()
        same = " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(words))
        places.append(f"SELECT doc_id, '{label}' AS label, unnest(list_filter(range(1, len(w) + 1), lambda i: {same})) - 1 AS place FROM w")
    most = WRAP + max(map(len, token_sets(TEMPLATES).values()))
    templates = ", ".join(f"('{k}', string_split('{v}', ' '))" for k, v in TEMPLATES.items())
    return f"""
WITH w AS (SELECT doc_id, {split("coalesce(text, '')")} AS w FROM documents),
p AS ({' UNION ALL '.join(places)}),
b AS (SELECT doc_id, count(*)::BIGINT AS n_base, min(place)::BIGINT AS first_word, max(place)::BIGINT AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM p GROUP BY doc_id),
t AS (SELECT label, list_distinct(tokens) AS tokens FROM (VALUES {templates}) v(label, tokens)),
l AS (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda y: {split('y')}), lambda z: len(z) > 0) AS lines FROM documents),
g AS (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM l),
n AS (SELECT doc_id, lines, i, unnest(range(1, {most} + 1)) AS s FROM g),
k AS (SELECT doc_id, s, flatten(lines[i:i + s - 1]) AS words FROM n WHERE i + s - 1 <= len(lines) AND (s = 1 OR list_sum(list_transform(lines[i:i + s - 1], lambda y: len(y))) <= {most})),
m AS (SELECT doc_id, label, len(list_intersect(tokens, words)) / len(tokens) AS containment, len(list_intersect(tokens, words)) >= ceil({THRESHOLD}::DOUBLE * len(tokens) - 1e-9) AS hit FROM k, t WHERE s = 1 OR len(words) <= len(tokens) + {WRAP}),
h AS (SELECT doc_id, label, containment FROM m WHERE hit),
every AS (SELECT doc_id, label FROM p UNION SELECT doc_id, label FROM h),
a AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM every GROUP BY doc_id),
s AS (SELECT doc_id, max(containment) AS best FROM h GROUP BY doc_id)
SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
  coalesce(labels, '') AS labels, (CASE WHEN n_base > 0 THEN 1 ELSE coalesce(best, 0) END)::DOUBLE AS score
FROM w LEFT JOIN b USING (doc_id) LEFT JOIN a USING (doc_id) LEFT JOIN s USING (doc_id)
"""


SQL = {"op1_license_scan": _sql()}
