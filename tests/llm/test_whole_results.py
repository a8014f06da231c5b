"""Operators do their whole job: compared with brute force or known answers of this file, not with the twins."""

import math
import random
import textwrap

import pytest

from strideframe.llm import licenses, ngram_join, secrets, url_filters
from tests.llm.test_vectors_and_urls import brute_tree

FILLER = "The quick survey of the valley went on for days, and the notes were kept in a drawer. "
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"""
GPL3 = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."""


def names(docs, rows):
    return {(r["doc_id"], r["license"]) for r in licenses.scan_licenses(docs(rows)).collect()}


def test_standard_license_texts_are_found_whole(docs):
    texts = [(k, name, text) for k, (name, text) in enumerate(licenses.TEXTS)]
    got = names(docs, [(k, text) for k, _, text in texts])
    assert {(k, name) for k, name, _ in texts} <= got


@pytest.mark.parametrize(("name", "text"), [("MIT", MIT), ("GPL-3.0", GPL3)])
def test_original_wording_is_found_inside_a_text(docs, name, text):
    wrapped = textwrap.fill(text, 70)
    commented = "\n".join(f" * {x}" for x in wrapped.split("\n"))
    rows = [(k, f"{FILLER * 3}\n\n{x}\n\n{FILLER * 3}") for k, x in enumerate((text, wrapped, commented))]
    assert names(docs, rows) == {(0, name), (1, name), (2, name)}


def test_word_anchors_miss_no_unit_that_could_pass():
    for least in (0.5, 0.8, 1.0):
        found = set(licenses.word_anchors(licenses.TEXTS, least))
        for _, text in licenses.TEXTS:
            grams = licenses.bigrams_of(text)
            assert sum(not found & set(g.split(" ")) for g in grams) < math.ceil(len(grams) * least / (2 - least) - 1e-9)


def test_wrapped_notices_and_crlf_paragraphs_are_found(docs):
    notice = "This work is licensed under the GNU General\nPublic License, version 3."
    inside = f"{FILLER * 3}\n{FILLER}{notice} {FILLER}\n{FILLER * 3}"
    rows = [(1, inside), (2, inside.replace("\n", "\r\n")), (3, f"{FILLER}\r\n\r\n{textwrap.fill(MIT, 70)}\r\n\r\n{FILLER}".replace("\r\n", "\n").replace("\n", "\r\n"))]
    assert names(docs, rows) == {(1, "GPL-3.0"), (2, "GPL-3.0"), (3, "MIT")}


def test_urls_that_differ_from_the_seventh_segment_on(spark):
    deep = "/a/b/c/d/e/f"
    rows = [(i, f"http://h.com{deep}/spam/{i}", 1) for i in range(60)] + [(100 + i, f"http://h.com{deep}/news/{i}", 0) for i in range(200)] + [(400, f"http://h.com{deep}/spam/9999", None), (401, f"http://h.com{deep}/news/9999", None)]
    frame = spark.createDataFrame(rows, "page_id long, url string, label int")
    got = {r["page_id"]: r for r in url_filters.filter_urls(frame, [], label_col="label").collect()}
    assert (got[400]["verdict"], got[401]["verdict"]) == ("block", "allow") and len(got) == len(rows)
    assert got[400]["template"] == f"{deep}/spam/#"


def test_deep_tree_is_the_brute_force(spark):
    rng = random.Random(7)
    rows = {}
    for _ in range(500):
        form = tuple(rng.choice("xy*" if k % 3 else "ab") for k in range(rng.randrange(1, 12)))
        bad = form[7:8] == ("x",)
        rows[rng.choice(["a.com", "b.org"]), form] = (n := rng.randrange(1, 30), n, n if bad else 0)
    rows["c.net", ("one", "deep", "form", *"abcdefghij")] = (3, 2, 1)
    listed = [(h, list(f), *v) for (h, f), v in rows.items()]
    frame = spark.createDataFrame(listed, "host string, form array<string>, n long, labelled long, bad long")
    got = {(r["host"], tuple(r["form"])): r["template"] for r in url_filters.template_tree(frame, least=20, z=2.6).collect()}
    assert got == brute_tree(listed, None, 20, 2.6)


def test_linked_parts_in_environment_style_and_long_identifiers():
    text = "DB_HOST=10.0.0.5 DB_USER=app DB_PASSWORD=hunter2"
    assert [(secrets.KINDS[k], text[s:e]) for s, k, e in secrets.scan_text(text)] == [("id_part", "USER=app"), ("secret_part", "PASSWORD=hunter2")]
    assert secrets.cut_spans(text, secrets.scan_text(text)) == "DB_HOST=10.0.0.5 DB_[SECRET] DB_[SECRET]"
    text = f"server: x.org user={'u' * 90} password=hunter2"
    assert secrets.cut_spans(text, secrets.scan_text(text)) == "server: x.org [SECRET] [SECRET]"
    text = "user=app password=hunter2 ghost=10.0.0.5"
    assert secrets.scan_text(text) == []


def test_empty_rows_of_repeated_ids_link_with_nothing(docs):
    one, two = "alpha beta gamma delta epsilon zeta eta theta", "one two three four five six seven eight nine"
    rows = [(1, ""), (2, None), (5, ""), (5, one), (6, ""), (6, two), (7, one), (8, " "), (8, two)]
    got = {(r["doc_id"], r["n_shingles"] > 0, r["component_id"]) for r in ngram_join.link_documents(docs(rows)).collect()}
    assert got == {(1, False, 1), (2, False, 2), (5, False, 5), (5, True, 5), (6, False, 6), (6, True, 6), (7, True, 5), (8, False, 8), (8, True, 6)}
    assert {r["doc_id"] for r in ngram_join.drop_near_duplicates(docs([r for r in rows if r[0] != 7])).collect()} == {1, 2, 5, 6, 8}  # the empty row of 8 is no copy
