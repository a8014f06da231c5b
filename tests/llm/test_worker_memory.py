"""Workers are used again: what a task has freed goes back to the system, and an encoder goes with its task."""

import gc
import weakref

import pyarrow as pa

from strideframe.llm import common, queries
from strideframe.llm.tokens import Encoder


def test_an_encoder_goes_without_the_garbage_collector():
    gc.disable()
    try:
        encoder = Encoder(queries.tokenizer_path())
        encoder.encode("some words")
        gone = weakref.ref(encoder)
        del encoder
        assert gone() is None
    finally:
        gc.enable()


def test_a_task_gives_memory_back_at_its_end(monkeypatch):
    calls = []
    monkeypatch.setattr(common, "give_back", lambda: calls.append(1))
    batches = [pa.RecordBatch.from_pydict({"x": [i]}) for i in range(3)]
    assert list(common.released(iter)(batches)) == batches and calls == [1]
    part = common.released(iter)(batches)
    next(part)
    part.close()
    assert calls == [1, 1]


def test_memory_is_given_back():
    common.give_back()
