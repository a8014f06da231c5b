import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strideframe.llm import packing, token_files
from strideframe.llm.queries import op3_token_files, op5_packing, tokenizer_path
from strideframe.llm.tokens import Encoder

ENCODER, LIBRARY = Encoder(tokenizer_path()), Tokenizer.from_file(tokenizer_path())
ODD = ["", "  ", None, "It's I'LL we're <|endoftext|>x a<|startoftext|> b", "ﬁ ŉ İstanbul ΑΣ ½ ² x² ª µ × ÷a é e\u0301 \x85y\xa0z ,., 12a3", "a\tb\rc\x0bd\x0ce\x1cf\n", "中文 😀a😀 _a_ <|x|> '''s 's'S", "ẞß ÀÉ.É, \u0300a", "z" * 5000]


def ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(text):
    assert ENCODER.encode(text).tolist() == ids(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n.,'sStTlLéÀß<|>09"))), max_size=4))
def test_any_text(texts):
    found, ends = ENCODER.encode_all(pa.array(texts, pa.string()))
    assert [found[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)] == [ids(t) for t in texts]


def test_other_layouts_go_whole():
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    other = Encoder(path)
    assert not other.by_units and other.encode("It's  so").tolist() == Tokenizer.from_file(path).encode("It's  so", add_special_tokens=False).ids


def crc(values):
    return zlib.crc32(np.array(values, "<u4").tobytes())


def test_files_give_back_all_ids(spark, small):
    documents = spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").collect()
    found = {r["doc_id"]: r for r in op3_token_files(spark, small).collect()}
    at = 0
    for d in documents:
        own = [*ids(d["text"]), 1]
        assert tuple(found[d["doc_id"]]) == (d["doc_id"], at, len(own), crc(own))
        at += len(own)
    assert len(found) == len(documents)


def test_files_of_odd_rows(spark, docs, tokenizer):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(3, "b b"), (3, "a"), (3, "a"), (None, "none")]
    index = token_files.write_token_files(docs(rows), tokenizer, 1, length=8, per_batch=2)
    found = token_files.read_token_files(token_files.with_starts(index)).orderBy("start").collect()
    assert [r["doc_id"] for r in found] == [None, 0, 1, 2, 3, 3, 3, 3, *range(4, len(ODD))]
    expected = [crc([*ids(t), 1]) for _, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))]
    assert [r["ids_crc32"] for r in found] == expected
    assert [r["start"] for r in found] == [0, *np.cumsum([r["n_tokens"] for r in found]).tolist()[:-1]]
    file = token_files.SequenceFile(found[0]["file"])
    batch = file.reader.get_batch(file.reader.num_record_batches - 1)
    assert batch.schema.field("tokens").type == pa.list_(pa.uint16(), 8) and batch.schema.field("mask").type.list_size == 8
    total = {f: sum(r["n_tokens"] for r in found if r["file"] == f) for f in {r["file"] for r in found}}
    for f, n in total.items():
        reader = token_files.SequenceFile(f).reader
        assert sum(int(np.sum(reader.get_batch(k).column("mask").flatten().to_numpy(zero_copy_only=False))) for k in range(reader.num_record_batches)) == n


def test_sequences_by_number(docs, tokenizer):
    index = token_files.write_token_files(docs([(k, f"word{k} and more") for k in range(40)]), tokenizer, 1, length=8, per_batch=3)
    for uri in {r["file"] for r in index.collect()}:
        file, n = token_files.SequenceFile(uri), sum(r["n_tokens"] for r in index.collect() if r["file"] == uri)
        found = [file.sequence(k) for k in reversed(range(-(-n // 8)))][::-1]
        assert all(len(i) == len(m) == 8 for i, m in found)
        kept = np.concatenate([i[m.to_numpy(zero_copy_only=False)] for i, m in found])
        assert kept.tolist() == np.concatenate(list(file.ids(0, n))).tolist() and not found[0][0].flags.owndata
        with pytest.raises(ValueError):
            list(file.ids(0, n + 1))


def test_no_documents(docs, tokenizer):
    assert token_files.read_token_files(token_files.with_starts(token_files.write_token_files(docs([]), tokenizer, 1))).count() == 0
    assert packing.pack_documents(docs([]), tokenizer, 2).count() == 0


def whole(pieces, texts, capacity, end):
    """Each id lies in one piece, each sequence is gapless and within capacity."""
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_sequence.setdefault(p["sequence_id"], []).append(p)
    for doc, text in texts.items():
        own = sorted(by_doc[doc], key=lambda p: p["start"])
        expected = [*ids(text), end]
        assert np.concatenate([np.frombuffer(p["ids"], "<u4") for p in own]).tolist() == expected
        assert [p["start"] for p in own] == [0, *np.cumsum([p["length"] for p in own]).tolist()[:-1]] and {p["doc_tokens"] for p in own} == {len(expected)}
    for own in by_sequence.values():
        own.sort(key=lambda p: p["offset"])
        assert [p["offset"] for p in own] == [0, *np.cumsum([p["length"] for p in own]).tolist()[:-1]] and sum(p["length"] for p in own) <= capacity
    return by_sequence


def test_packs_all_documents(spark, small, tokenizer):
    documents = spark.read.parquet(f"{small}/documents.parquet")
    pieces = packing.pack_documents(documents, tokenizer, 2).collect()
    used = whole(pieces, {r["doc_id"]: r["text"] for r in documents.collect()}, 4096, 2)
    tokens = sum(p["length"] for p in pieces)
    assert len(used) * 4096 < tokens * 1.06
    digests = sorted((r["doc_id"], r["start"], r["ids_crc32"]) for r in op5_packing(spark, small).collect())
    assert digests == sorted((p["doc_id"], p["start"], zlib.crc32(p["ids"])) for p in pieces)


def test_packs_odd_rows(docs, tokenizer):
    rows = [*enumerate(ODD), (50, "a b c d e f g h i j")]
    whole(packing.pack_documents(docs(rows), tokenizer, 2, capacity=8, windows=4).collect(), dict(rows), 8, 2)
    repeated = packing.pack_documents(docs([(1, "a"), (1, "a"), (None, "b")]), tokenizer, 2).collect()
    assert sorted(str(p["doc_id"]) for p in repeated) == ["1", "1", "None"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), min_size=1, max_size=60))
def test_windows_hold(sizes):
    window = packing.near_equal_windows(sizes, 100)
    assert np.bincount(window, weights=sizes).max() <= 100 and len(window) == len(sizes)


def test_differencing_known_case():
    window, sums = packing.differencing([8, 7, 6, 5, 4], 2)
    assert sorted(sums.tolist()) == [14, 16] and np.bincount(window, weights=[8, 7, 6, 5, 4]).tolist() == sums.tolist()


def test_buckets_of_very_many_small_items_stay_small():
    import tracemalloc

    for sizes in ([1] * 131_072, [7] * 60_000, [4000] * 50 + [1] * 30_000):
        tracemalloc.start()
        window = packing.near_equal_windows(sizes, 4096)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        sums = np.bincount(window, weights=sizes)
        assert sums.max() <= 4096 and len(sums) <= -(-sum(sizes) // 4096) * 1.05 + 1 and peak < 100e6


def test_very_many_empty_documents(spark, tokenizer):
    frame = spark.range(300_000).select(F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("text")).coalesce(1)
    got = packing.pack_documents(frame, tokenizer, 2).groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.sum("n"), F.max("n"), F.count("*")).first()
    assert got[0] == 300_000 and got[1] <= 4096 and got[2] <= 300_000 / 4096 * 1.05 + 1
