"""License scans by Dice coefficient over word bigrams, in DataFrame operations only.

A text's units are itself, its paragraphs (blank lines between), its lines and
its sentences, both those of each line and those that go on over the line breaks
of a paragraph; CRLF and CR are line breaks, too.  A unit is normalised (A-Z lower-cased, runs of other characters
than a-z and 0-9 are one blank) and compared with every licence template: twice
the shared distinct word bigrams over the sum of both counts.  Size bounds prune
first: for a coefficient of t the smaller set has at least t / (2 - t) of the
larger one's bigrams, so other templates can't reach it.  The best template of a
unit counts, from ``least`` on; ties go to the licence that sorts first.

Templates are the notices below and the standard texts and file headers in
``license_texts``, several a licence.

Texts are read once and nothing is shuffled: a text that lacks all anchors is
passed over.  To reach t a unit must share all but a few of a template's bigrams,
so one of any few more occurs in it; these are the anchors of a short template.
A long one's are words that so many of its bigrams hold that a unit without any
of these words lacks too many.

Defined results: a null or empty text has no licence and no row; a unit of one
word has no bigram; rows that repeat an id are scanned each on its own; units
that repeat in a text count once; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import reduce
from importlib.resources import files
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .url_filters import LOWER, UPPER

#: Licence notices as they are commonly written.
TEMPLATES = [
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]


#: Standard texts and file headers, whole: files named by licence and part.
TEXTS = [(f.name.split("--")[0], f.read_text("utf-8")) for f in sorted((files(__package__) / "license_texts").iterdir(), key=lambda f: f.name) if f.name.endswith(".txt")]

#: Templates of more bigrams than this have words as anchors.
LONG = 40
#: Words of any English text, taken as anchors last.
COMMON = frozenset("1 2 a all also an and any are as at be but by can do does each either for from general has have however if in is it its may more must new no not of on one only or other otherwise s see so some such that the their them then these they this those to under used was we when which who will with without you your 0".split())


def words_of(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.translate(str.maketrans(UPPER, LOWER)))


def bigrams_of(text: str) -> list[str]:
    words = words_of(text)
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:])))  # noqa: B905


def anchors(templates: list[tuple[str, str]], least: float) -> list[str]:
    """Bigrams of which every unit that reaches ``least`` with some template has one: of each template one more than a unit may lack, those that are chosen already and long ones first."""
    found: dict[str, None] = {}
    for _, text in templates:
        grams = bigrams_of(text)
        shared = math.ceil(len(grams) * least / (2 - least) - 1e-9)
        found |= dict.fromkeys(sorted(grams, key=lambda g: (g not in found, -len(g), g))[: len(grams) - shared + 1])
    return list(found)


def word_anchors(templates: list[tuple[str, str]], least: float) -> list[str]:
    """Words of which every unit that reaches ``least`` with some template has one: of each template words that together are in one more bigram than a unit may lack, those in many bigrams first, common ones last."""
    found: list[str] = []
    open_ = []  # of each template that needs more words: the bigrams without one, and how many a unit may lack
    for _, text in templates:
        grams = [g.split(" ") for g in bigrams_of(text)]
        open_.append((grams, math.ceil(len(grams) * least / (2 - least) - 1e-9)))
    while open_:
        counts = Counter(w for grams, _ in open_ for g in grams for w in set(g))
        word = min(counts, key=lambda w: (w in COMMON, -counts[w], w))
        found.append(word)
        open_ = [(left, shared) for grams, shared in open_ if len(left := [g for g in grams if word not in g]) >= shared]
    return found


def _plain(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, "[^A-Za-z0-9]+", " "))


def _bigrams(unit: Column) -> Column:
    words = F.split(F.trim(_plain(unit)), " ")
    pairs = lambda w: F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_distinct(F.get(F.transform(F.array(words), pairs), F.lit(0)))


def scan_licenses(docs: DataFrame, *, least: float = 0.8, templates: list[tuple[str, str]] = TEMPLATES + TEXTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, license, dice (the best unit's) and n_units (distinct units) of each text and licence found in it."""
    text = F.col("text")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    short = [t for t in templates if len(bigrams_of(t[1])) <= LONG]
    long = [t for t in templates if len(bigrams_of(t[1])) > LONG]
    pairs = [f" {g} " for g in anchors(short, least)]
    has = lambda words, chosen: F.arrays_overlap(words, F.split(F.lit(" ".join(word_anchors(chosen, least))), " "))
    # lambdas' variables here and below, so that what they stand for is made once and not for each use
    paired = lambda plain: reduce(or_, (plain.contains(p) for p in pairs), F.lit(False))
    worded = lambda plain: F.exists(F.array(F.split(plain, " ")), lambda words: has(words, long) | (has(words, short) & paired(plain)))
    passed = F.exists(F.array(F.concat(F.lit(" "), _plain(text), F.lit(" "))), worded)
    ends = lambda x: F.split(F.regexp_replace(x, r"([.!?;:])[ \t]+", "$1\n"), "\n")
    paragraphs = lambda x: F.split(x, r"\n[ \t]*\n")
    wrapped = lambda x: F.flatten(F.transform(paragraphs(x), lambda p: ends(F.translate(p, "\n", " "))))
    units_of = lambda x: F.array_distinct(F.concat(F.array(x), paragraphs(x), F.split(x, "\n"), ends(x), wrapped(x)))
    units = F.flatten(F.transform(F.array(F.regexp_replace(text, "\r\n?", "\n")), units_of))
    known = F.array(*(F.struct(F.lit(name).alias("license"), F.split(F.lit("|".join(bigrams_of(words))), "[|]").alias("bigrams")) for name, words in sorted(templates)))
    sizes = [len(bigrams_of(words)) for _, words in templates]
    ratio = least / (2 - least) - 1e-9  # a little less, for rounding

    def best(unit: Column) -> Column:
        fitting = F.filter(known, lambda t: (F.size(unit) >= ratio * F.size(t["bigrams"])) & (ratio * F.size(unit) <= F.size(t["bigrams"])))
        scored = F.transform(fitting, lambda t: F.struct((F.lit(2.0) * F.size(F.array_intersect(unit, t["bigrams"])) / (F.size(unit) + F.size(t["bigrams"]))).alias("dice"), t["license"].alias("license")))
        return F.aggregate(scored, F.struct(F.lit(0.0).alias("dice"), F.lit("").alias("license")), lambda a, b: F.when(b["dice"] > a["dice"], b).otherwise(a))

    sized = lambda u: (F.size(u) >= ratio * min(sizes)) & (ratio * F.size(u) <= max(sizes))
    hits = F.filter(F.transform(F.filter(F.transform(units, _bigrams), sized), best), lambda h: h["dice"] >= least)

    def each(found: Column) -> Column:
        one = lambda name: F.filter(found, lambda h: h["license"] == name)
        names = F.array_sort(F.array_distinct(F.transform(found, lambda h: h["license"])))
        return F.transform(names, lambda name: F.struct(name.alias("license"), F.array_max(F.transform(one(name), lambda h: h["dice"])).alias("dice"), F.size(one(name)).cast("long").alias("n_units")))

    found = rows.where(passed).select("doc_id", F.explode(F.flatten(F.transform(F.array(hits), each))).alias("x"))
    return found.select("doc_id", "x.license", F.round("x.dice", 9).alias("dice"), "x.n_units")


def oracle_sql(least: float = 0.8, templates: list[tuple[str, str]] = TEMPLATES + TEXTS) -> str:
    """The same rows in DuckDB, which makes the templates' bigrams itself; only pairs whose sizes can't reach ``least`` are left out."""
    literal = lambda x: "'" + x.replace("'", "''") + "'"
    listed = ", ".join(f"({i}, {literal(name)}, {literal(words)})" for i, (name, words) in enumerate(sorted(templates)))
    words = lambda x: f"string_split(trim(regexp_replace(translate({x}, '{UPPER}', '{LOWER}'), '[^a-z0-9]+', ' ', 'g'), ' '), ' ')"
    grams = "list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]))"
    ends = lambda x: f"string_split(regexp_replace({x}, '([.!?;:])[ \\t]+', '\\1' || chr(10), 'g'), chr(10))"
    paragraphs = "regexp_split_to_array(text, '\\n[ \\t]*\\n')"
    wrapped = f"flatten(list_transform({paragraphs}, lambda p: {ends('translate(p, chr(10), chr(32))')}))"
    ratio = least / (2 - least) - 1e-9
    return f"""
WITH s(k, license, text) AS (VALUES {listed}),
t AS MATERIALIZED (SELECT k, license, {grams} AS bigrams FROM (SELECT k, license, {words('text')} AS words FROM s)),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_replace(text, '\\r\\n?', chr(10), 'g') AS text FROM documents WHERE text IS NOT NULL),
u AS (SELECT r, doc_id, unnest(list_distinct([text] || {paragraphs} || string_split(text, chr(10)) || {ends('text')} || {wrapped})) AS unit FROM d),
w AS (SELECT r, doc_id, unit, {words('unit')} AS words FROM u),
b AS (SELECT r, doc_id, unit, {grams} AS bigrams FROM w WHERE len(words) > 1),
c AS (
  SELECT r, doc_id, unit, license, k, 2.0::DOUBLE * len(list_intersect(b.bigrams, t.bigrams)) / (len(b.bigrams) + len(t.bigrams)) AS dice
  FROM b JOIN t ON len(b.bigrams) >= {ratio!r}::DOUBLE * len(t.bigrams) AND len(t.bigrams) >= {ratio!r}::DOUBLE * len(b.bigrams)
), x AS (SELECT r, doc_id, unit, arg_max(license, dice * 1000 - k * 0.000001) AS license, max(dice) AS dice FROM c GROUP BY ALL HAVING max(dice) >= {least})
SELECT doc_id, license, round(max(dice), 9) AS dice, count(*) AS n_units FROM x GROUP BY r, doc_id, license
"""
