"""Benchmark decontamination by word n-grams.

The benchmark's windows (``n`` consecutive normalised words; the whole item
where it has fewer) go to every task as a hash set: 64-bit hashes of word
numbers and, for verification, the windows themselves.  A task numbers a
document's words by the benchmark's vocabulary (0: not in it), hashes all
windows without a 0, looks them up and verifies each hit word by word.

The benchmark is broadcast in shards of at most ``shard_words`` words each (one
item at least).  With more than one shard each is a pass of its own over the
documents: its hits are merged with those before, the rows are written to the
shared folder, and the shard is taken back before the next is made.  So driver
and tasks hold one bounded shard at a time whatever the benchmark's size.

Words: A-Z lower-cased, then runs of characters other than ``\\x00-\\x2F``,
``\\x3A-\\x60`` and ``\\x7B-\\x7F``.

Defined results: a null or empty text has no words and isn't contaminated; a
very long text is scanned whole; a null or empty item has no window; repeated
items count each by its id; items with a null id hit like others and are one
null in ``items`` (first there); rows that repeat a document id are judged each
on its own; an empty benchmark hits nothing; other columns pass through
``remove_contaminated`` untouched.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import released, small_batches, split_batch, stage, with_fields

#: Bytes that aren't part of a word, and the letters that are lower-cased.
_OUTSIDE = [*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]
_FOLD = bytes(b + 32 if 65 <= b <= 90 else 32 if b in _OUTSIDE else b for b in range(256))
_STEP = np.uint64(0x9E3779B97F4A7C15)

HITS = "n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>"


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_FOLD).split() if text else []


def _rolling(ids: np.ndarray, n: int) -> np.ndarray:
    """A hash of each window of n word numbers; 0 for windows with a word that no item has."""
    total = np.zeros(len(ids) - n + 1, np.uint64)
    for k in range(n):
        total = (total + ids[k : k + len(total)]) * _STEP
        total ^= total >> np.uint64(29)
    absent = np.concatenate(([0], np.cumsum(ids == 0)))
    total[absent[n:] != absent[:-n]] = 0
    return total


class WindowSet:
    """The windows of one shard of items."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], n: int):
        self.vocabulary: dict[bytes, int] = {}
        self.by_length: dict[int, dict[int, list[tuple[tuple, set]]]] = defaultdict(dict)
        for item, words in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]
            size = min(n, len(ids))
            if not size:
                continue
            array = np.array(ids, np.uint64)
            for at, key in enumerate(_rolling(array, size).tolist()):
                window = tuple(ids[at : at + size])
                for known, owners in self.by_length[size].setdefault(key, []):
                    if known == window:
                        owners.add(item)
                        break
                else:
                    self.by_length[size][key].append((window, {item}))
        self.keys = {size: np.array(sorted(found), np.uint64) for size, found in self.by_length.items()}

    def hits(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Which words lie inside a window's occurrence, and the items whose windows occur."""
        ids = np.fromiter(map(self.vocabulary.get, words, [0] * len(words)), np.uint64, len(words))
        edge, items = np.zeros(len(words) + 1, np.int64), set()
        for size, keys in self.keys.items():
            if len(words) < size:
                continue
            found = _rolling(ids, size)
            place = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
            for at in np.flatnonzero((keys[place] == found) & (found != 0)).tolist():
                window = tuple(ids[at : at + size].tolist())
                for known, owners in self.by_length[size][int(found[at])]:
                    if known == window:
                        items |= owners
                        edge[at] += 1
                        edge[at + size] -= 1
                        break
        return np.cumsum(edge)[:-1] > 0, items


def _spans(hit: np.ndarray) -> list[tuple[int, int]]:
    change = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).astype(np.int8)))
    return list(zip(change[::2].tolist(), change[1::2].tolist(), strict=True))


def _shards(benchmark: DataFrame, n: int, item_col: str, text_col: str, shard_words: int) -> Iterator[WindowSet]:
    held, size = [], 0
    for row in benchmark.select(F.col(item_col).cast("string"), text_col).orderBy(item_col).toLocalIterator():
        words = words_of(row[1])
        if held and size + len(words) > shard_words:
            yield WindowSet(held, n)
            held, size = [], 0
        held.append((row[0], words))
        size += len(words)
    yield WindowSet(held, n)


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, *, n: int = 13, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", shard_words: int = 2_000_000) -> DataFrame:
    """``docs`` with the columns of ``HITS``, which take the place of columns of these names: word counts, items with occurring windows (sorted as strings), and hit spans in words."""
    small_batches(docs.sparkSession)
    docs = docs.drop(*(f.name for f in StructType.fromDDL(HITS) if f.name != text_col))
    spark, out, schema = docs.sparkSession, docs, with_fields(docs, HITS)
    arrow = pa.schema([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
    where = docs.columns.index(text_col)
    shards = _shards(benchmark, n, item_col, item_text_col, shard_words)
    shard, first = next(shards), True
    while shard is not None:
        sent = spark.sparkContext.broadcast(shard)

        def run(batches: Iterator[pa.RecordBatch], sent=sent, first=first) -> Iterator[pa.RecordBatch]:
            windows = sent.value
            for batch in batches:
                for part in split_batch(batch):
                    rows = []
                    before = part.columns[-4:] if not first else [[None] * part.num_rows] * 4
                    for text, items, spans in zip(part.column(where), before[2], before[3], strict=True):
                        words = words_of(text.as_py())
                        hit, found = windows.hits(words)
                        for span in spans.as_py() if spans is not None else ():
                            hit[span["start"] : span["end"]] = True
                        if items is not None:
                            found |= set(items.as_py())
                        rows.append((len(words), int(hit.sum()), sorted(found, key=lambda x: (x is not None, x or "")), [{"start": a, "end": b} for a, b in _spans(hit)]))
                    own = part.columns if first else part.columns[:-4]
                    made = [pa.array([r[i] for r in rows], t) for i, t in enumerate(arrow.types)]
                    yield pa.RecordBatch.from_arrays([*own, *made], names=[*(f"c{i}" for i in range(len(own))), *arrow.names])

        out = out.mapInArrow(released(run), schema)
        shard, first = next(shards, None), False
        if shard is not None:
            out = stage(out, "shard-hits")
            sent.destroy()
    return out


def contaminated() -> F.Column:
    """The rule: a hit, and at least a twentieth of the words."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", **options) -> DataFrame:
    """The documents that aren't contaminated, with their own columns."""
    plain = docs.select([F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    judged = benchmark_hits(plain, benchmark, text_col=f"c{docs.columns.index(text_col)}", **options).where(~contaminated())
    return judged.select([F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
