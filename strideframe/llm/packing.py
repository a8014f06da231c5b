"""Packing into fixed windows by Karmarkar-Karp multiway differencing.

Every document's ids (with an end id) are cut into whole windows and a rest.
Rests gather in buckets of about ``windows`` windows; in a bucket the largest
differencing method merges partial partitions: the two with the largest spread
are joined with opposing order, so that large sums meet small ones.  The result
is near-equal windows; whenever one exceeds the capacity, the number of windows
rises by one and the bucket is solved anew.  To close a bucket at nearly whole
windows, its last document may be cut.

Each task packs its own stream of rows in one pass: no shuffle, and one bucket
in memory.  A bucket is bounded in tokens and in rests (``most``), rests of less
than a sixty-fourth of a window are put together before the differencing, and a
partial partition holds the sums of its filled windows only, so a bucket of any
documents is some MB.  Input splits decide the buckets, so a task that is run
again gives the same sequences.

Defined results: a null text is empty (one window piece with the end id); rows
that repeat an id are packed each on its own; a null id stays null; a very long
text is cut into whole windows and a rest; an empty table gives no piece; other
columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released, small_batches, split_batch
from .tokens import Encoder

PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
_PIECES = pa.schema([*((n, pa.int64()) for n in ("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset")), ("ids", pa.binary())])


def differencing(sizes: list[int], m: int) -> tuple[np.ndarray, np.ndarray]:
    """The window of each item, and the windows' sums, by multiway differencing of ``sizes`` into ``m`` windows.

    A partial partition is an array of its sums in descending order, less the least of all ``m``; sums that aren't
    in the array are 0.  A merge keeps where the sums of both parts have gone, in as few bytes as ``m`` needs.
    """
    kind = np.min_scalar_type(m)
    merges: list[tuple[int, int, np.ndarray, np.ndarray]] = []  # the two parts, and the places of their sums
    heap = [(-int(v), i, np.array([v], np.int64)) for i, v in enumerate(sizes)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a, x = heapq.heappop(heap)
        _, b, y = heapq.heappop(heap)
        # the largest sums of one meet the smallest of the other: y's k-th stands in the k-th window from the end
        apart = len(x) + len(y) <= m
        first = len(x) if apart else m - len(y)
        joined = np.zeros(len(x) + len(y) if apart else m, np.int64)
        joined[: len(x)] = x
        joined[first:] += y[::-1]
        order = np.argsort(-joined, kind="stable")
        place = np.empty(len(joined), kind)
        place[order] = np.arange(len(joined))
        joined = joined[order]
        least = joined[-1] if len(joined) == m else 0
        merges.append((a, b, place[: len(x)].copy(), place[first:][::-1].copy()))
        heapq.heappush(heap, (int(least - joined[0]), len(sizes) + len(merges) - 1, joined - least))
    window = np.zeros(len(sizes), np.int64)
    # the windows of a partition's sums, from the last merge back; sums that aren't in the array take the windows left over
    stack = [(heap[0][1], np.arange(m))]
    while stack:
        k, to = stack.pop()
        if k < len(sizes):
            window[k] = to[0]
        else:
            a, b, of_a, of_b = merges[k - len(sizes)]
            stack += [(a, to[of_a]), (b, to[of_b])]
    return window, np.bincount(window, weights=sizes, minlength=m).astype(np.int64)


def near_equal_windows(sizes: list[int], capacity: int) -> np.ndarray:
    """Windows of sums up to ``capacity`` (no item may be larger): as many as the total needs, and one more whenever the capacity is exceeded.  Neighbours among the items of less than a sixty-fourth of it go together."""
    sizes = np.asarray(sizes, np.int64)
    grain = max(1, capacity // 64)
    small = np.flatnonzero(sizes < grain)
    lot = np.empty(len(sizes), np.int64)
    lot[small] = (np.cumsum(sizes[small]) - sizes[small]) // grain
    lots = int(lot[small[-1]]) + 1 if len(small) else 0
    lot[sizes >= grain] = lots + np.arange(len(sizes) - len(small))
    used, lot = np.unique(lot, return_inverse=True)
    sums = np.bincount(lot, weights=sizes, minlength=len(used)).astype(np.int64)
    m = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        window, filled = differencing(sums.tolist(), m)
        if filled.max() <= capacity:
            return window[lot]
        m += 1


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, *, capacity: int = 4096, windows: int = 192, spare: float = 0.004, most: int = 1 << 17, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces (``PIECES``; ids as little-endian unsigned 32-bit integers).  ``windows``: of a bucket; ``spare``: the share of a bucket that is left free for the windows to differ; ``most``: rests of a bucket."""
    small_batches(docs.sparkSession)
    full = int(windows * capacity * (1 - spare))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer)
        sequence = TaskContext.get().partitionId() << 33
        rests: list[tuple] = []  # doc_id, start, doc_tokens, ids
        held = 0
        rows: list[tuple] = []

        def close() -> None:
            nonlocal sequence, held
            if rests:
                window = near_equal_windows([len(r[3]) for r in rests], capacity)
                used: dict[int, tuple[int, int]] = {}
                for w, (doc, start, total, ids) in zip(window.tolist(), rests, strict=True):
                    number, offset = used.get(w, (sequence + len(used), 0))
                    rows.append((doc, start, len(ids), total, number, offset, ids.tobytes()))
                    used[w] = (number, offset + len(ids))
                sequence += len(used)
                rests.clear()
                held = 0

        def add(doc: int | None, ids: np.ndarray) -> None:
            nonlocal sequence, held
            total = len(ids)
            cut = total // capacity * capacity
            for start in range(0, cut, capacity):
                rows.append((doc, start, capacity, total, sequence, 0, ids[start : start + capacity].tobytes()))
                sequence += 1
            if cut < total:
                if held + total - cut >= full:
                    first = cut + full - held
                    if first > cut:
                        rests.append((doc, cut, total, ids[cut:first]))
                    close()
                    cut = first
                if cut < total:
                    rests.append((doc, cut, total, ids[cut:].copy()))
                    held += total - cut
                    if len(rests) == most:
                        close()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _PIECES.types, strict=True)], schema=_PIECES)
            rows.clear()
            return batch

        for batch in batches:
            for part in split_batch(batch, 3 << 20):
                ids, ends = encoder.encode_all(part.column(1))
                ids = np.insert(ids, ends[1:], end_id).astype("<u4")
                ends = ends + np.arange(len(ends))
                for doc, i, j in zip(part.column(0).to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                    add(doc, ids[i:j])
                    if len(rows) >= 512:
                        yield out()
        close()
        if rows:
            yield out()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(released(run), PIECES)
