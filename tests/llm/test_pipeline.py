"""The stages against brute-force versions, each on its own input."""

import random
import re

from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from strideframe.llm import common, decontamination, ngram_join, queries, secrets

from .test_ngram_join import brute
from .test_text_operators import brute_hits
from .test_tokens import whole


def test_stages(spark, small, tokenizer):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    seen = {}
    for name, function in pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = common.stage(function(spark, docs, small), name)
        rows = docs.collect()
        seen[name] = len(rows)
        if name != "packing":
            assert docs.columns == columns
        if name == "language":
            assert {r["doc_id"] for r in rows} == {d for d, t in before.items() if re.search(r"[^\W\d_]", t or "")}
        elif name == "near_copies":
            groups = brute(before.items(), 80, 100, 5)
            assert {r["doc_id"] for r in rows} == {c for _, c in groups.values()} and len(rows) < len(before)
        elif name == "benchmark":
            assert {r["doc_id"] for r in rows} == {d for d, n, hit, _ in brute_hits(before.items(), items) if not (hit and 20 * hit >= n)} and len(rows) < len(before)
        elif name == "secrets":
            assert {r["doc_id"]: r["text"] for r in rows} == {d: secrets.cut_spans(t, secrets.scan_text(t)) for d, t in before.items()}
            assert all(r["n_chars"] == len(r["text"]) for r in rows)
        else:
            whole(rows, before, 4096, 2)
    assert [n for n, _ in pipeline.STAGES] == list(seen)


def test_odd_documents(spark, docs, small):
    rows = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (3, "123", "en", "s", 3), (None, "the and of in that is", "en", "s", 1), (4, "the and of in that is", "en", None, 1), (4, "the and of in that is", "en", None, 1)], "doc_id long, text string, lang string, source string, n_chars long")
    for name, function in pipeline.STAGES:
        rows = common.stage(function(spark, rows, small), name)
    assert sorted(str(r["doc_id"]) for r in rows.collect()) == ["4", "None"]


def test_no_documents(spark, small):
    rows = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, function in pipeline.STAGES:
        rows = common.stage(function(spark, rows, small), name)
    assert rows.count() == 0


def test_planted_texts_of_no_language_go_and_clean_ones_stay(spark, small):
    rng = random.Random(6)
    noise = lambda n: " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(2, 10))) for _ in range(n))
    table = spark.read.parquet(f"{small}/documents.parquet")
    planted = [(10**9 + k, t, lang, "p", 0) for k, (t, lang) in enumerate([("Съешь ещё этих мягких французских булок. " * 9, "en"), (noise(60), "de"), (noise(5000), None), ("漢字仮名交じり文を書くのは難しい" * 4, "fr"), ("?" * 50, "en")])]
    both = common.stage(table.unionByName(spark.createDataFrame(planted, "doc_id long, text string, lang string, source string, n_chars long").select(*(F.col(f.name).cast(f.dataType) for f in table.schema))), "planted")
    kept = {r["doc_id"] for r in pipeline.language(spark, both, small).select("doc_id").collect()}
    assert kept == {r["doc_id"] for r in table.collect() if re.search(r"[^\W\d_]", r["text"] or "")}
