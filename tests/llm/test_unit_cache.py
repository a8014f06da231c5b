"""Units of the batches before aren't encoded again, and what the encoder keeps of them is bounded."""

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from strideframe.llm.queries import tokenizer_path
from strideframe.llm.tokens import Encoder

ENCODERS, LIBRARY = {most: Encoder(tokenizer_path(), unit_bytes=most) for most in (0, 200, 2000, 1 << 20)}, Tokenizer.from_file(tokenizer_path())


def encoded(encoder, texts):
    found, ends = encoder.encode_all(pa.array(texts, pa.string()))
    return [found[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)]


def expected(texts):
    return [LIBRARY.encode(t or "", add_special_tokens=False).ids for t in texts]


def held(encoder):
    return encoder.units.nbytes + encoder.unit_ids.nbytes + encoder.unit_ends.nbytes


def test_units_are_encoded_once_over_all_batches(monkeypatch):
    calls, unit = [], Encoder._unit
    monkeypatch.setattr(Encoder, "_unit", lambda self, x: calls.append(x) or unit(self, x))
    encoder = Encoder(tokenizer_path())
    batches = [["one two, three", "Two! one"], ["three one", None, "four one"], ["", "two, Two! four"]]
    assert [encoded(encoder, b) for b in batches] == [expected(b) for b in batches]
    assert sorted(calls) == ["", "Two!", "four", "one", "three", "two,"]


@pytest.mark.parametrize("most", ENCODERS)
@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.one_of(st.none(), st.text(alphabet="ab,É <|\n9", max_size=30)), max_size=4), max_size=6))
def test_any_batches(most, batches):
    encoder = ENCODERS[most]
    for texts in batches:
        assert encoded(encoder, texts) == expected(texts)
        assert held(encoder) <= max(most, 8)


def test_a_full_cache_goes_on_with_the_last_batch():
    encoder = Encoder(tokenizer_path(), unit_bytes=2000)
    for k in range(40):
        texts = [f"some words {'x' * k}y", "and others"]
        assert encoded(encoder, texts) == expected(texts)
        assert {"some", "words", "and", "others"} <= set(encoder.units.to_pylist()) and held(encoder) <= 2000
    texts = ["z" * 3000, "some"]
    assert encoded(encoder, texts) == expected(texts) and len(encoder.units) == 0
    assert encoded(encoder, ["some"]) == expected(["some"])
