"""N-gram Jaccard join: size-aware heavy-light, exact, down to components.

A document's set holds its distinct word shingles.  Two documents link when
``den * |A & B| >= num * |A | B|``.  The result is each document's component.

Candidates come from two signature schemes that share one posting pass:

* light pairs (the larger set has at most ``boundary`` shingles): both sets
  enumerate their subsets of the fixed size ``ceil(num / den * larger)``, which
  any link of that size must share;
* heavy pairs: inverted lists.  Shingles are dealt by hash to blocks; a link
  differs in at most ``h`` shingles, so of ``h + 1 + spare`` blocks more than
  ``spare`` agree whole.  A list's key is a block's number and content, and a
  set enters the lists of all size bands in which a partner can lie.  Sets of
  more than three quarters of ``spare`` empty blocks, which are few, also enter
  the lists of these; so any link shares some lists at least (``shared_lists``).

``boundary`` is where enumerating subsets starts to cost more postings than the
lists, by the signature counts of the two schemes (``choose_boundary``).

Keys of whole blocks (about five shingles) rather than single shingles keep
lists short where many documents share a passage or a line.  From the lists that
are long nonetheless a document leaves if it has fewer of them than a link
shares: its links all show in short lists, and what a common passage lines up
falls apart.  Copies that are the same text are one representative beforehand, so
a hot copy is one row.

Nothing lists all pairs of a group.  A list is cut into bounded parts, long lists
in one of three orders, so that the parts of a group's lists overlap.  A part's
sets are compared by parity sketches (the popcount of two sketches' difference
never exceeds the sets' difference, so no link is lost) and give a spanning
forest.  What the forests of all lists leave apart within a long list is then
compared across its parts (``cross_parts``), and forests join to candidate
components, which contain every link.  Small components are compared exactly,
whole.  In a large one the forests' edges are verified first and what they
confirm is contracted: only sets that stay apart are compared, chunk by chunk.
So a group of N near copies costs work in proportion to N.

Defined results: a null or empty text has an empty set and links with nothing;
a text of fewer words than ``n`` is one shingle, its whole sequence; a very long
text is one set of all its shingles; rows that repeat an id with different texts
are linked through that id; a null id is dropped; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations, islice
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released, small_batches, split_batch, stage

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_ALL = (1 << 64) - 1
#: The low bits of a key say which band it belongs to (0: a light pair's subset).
NUMBERS = 64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX
    return (x ^ (x >> np.uint64(29))) * _ODD


class Shingler:
    """Distinct shingles of a text as sorted 64-bit hashes.  Words: A-Z lower-cased, white space is ``\\x20\\x09-\\x0D``."""

    def __init__(self, n: int, keep: int = 100_000):
        self.n, self.keep, self.words = n, keep, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = text.encode().lower().split() if text else []
        if not words:
            return np.empty(0, np.uint64)
        known = self.words
        try:
            hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        except KeyError:
            if len(known) > self.keep:
                known.clear()
            for w in set(words).difference(known):
                known[w] = xxhash.xxh3_64_intdigest(w)
            hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = min(self.n, len(words))
        total = np.full(len(words) - n + 1, len(words) if n < self.n else self.n, np.uint64)
        for k in range(n):
            total = _mix(total + hashes[k : k + len(total)])
        return np.unique(total)


class Signatures:
    """The posting keys of a set, for a threshold num / den and a light-heavy boundary."""

    def __init__(self, num: int, den: int, boundary: int):
        self.num, self.den, self.boundary = num, den, boundary

    def largest(self, size: int) -> int:
        """The largest partner of a set of this size."""
        return size * self.den // self.num

    def overlap(self, larger: int) -> int:
        """What a link whose larger set has this size shares at least."""
        return -(-self.num * larger // self.den)

    def bands(self, size: int) -> Iterator[tuple[int, int, int]]:
        """Number (from 1), first and last size of the bands of larger sets in which a heavy pair of this set can lie."""
        low, number = self.boundary + 1, 1
        while low <= self.largest(size):
            high = max(low, low * 7 // 5)
            if high >= size:
                yield number, low, high
            low, number = high + 1, number + 1

    def blocks(self, high: int) -> tuple[int, int, int]:
        """Blocks of a band, how many may be empty, and how many lists a link shares at least."""
        differ = 2 * high * (self.den - self.num) // (self.den + self.num)
        spare = 3 + differ // 8
        empty = spare * 3 // 4
        return differ + 1 + spare, empty, 1 + spare - empty

    def shared_lists(self) -> list[int]:
        """By band number what a link shares at least; 1 for light keys (number 0)."""
        return [1, *(self.blocks(high)[2] for _, _, high in islice(self.all_bands(), NUMBERS - 1))]

    def all_bands(self) -> Iterator[tuple[int, int, int]]:
        low, number = self.boundary + 1, 1
        while True:
            high = max(low, low * 7 // 5)
            yield number, low, high
            low, number = high + 1, number + 1

    def light(self, shingles: np.ndarray) -> list[int]:
        size, out = len(shingles), []
        if size > self.boundary:
            return out
        listed = shingles.tolist()
        for c in sorted({self.overlap(b) for b in range(size, min(self.boundary, self.largest(size)) + 1)}):
            if c <= size:
                out += [xxhash.xxh3_64_intdigest(np.array(s, "<u8").tobytes(), seed=c) & ~(NUMBERS - 1) for s in combinations(listed, c)]
        return out

    def heavy(self, shingles: np.ndarray) -> list[np.ndarray]:
        out = []
        for band, low, high in self.bands(len(shingles)):
            m, empty, _ = self.blocks(high)
            at = (_mix(shingles + np.uint64(low)) % np.uint64(m)).astype(np.int64)
            content = np.zeros(m, np.uint64)
            np.add.at(content, at, _mix(shingles ^ _ODD))
            full = np.bincount(at, minlength=m) > 0
            keep = full if m - int(full.sum()) <= empty else np.ones(m, bool)
            block = np.arange(m, dtype=np.uint64) + np.uint64((low << 32) & _ALL)
            out.append(_mix(_mix(block) + content)[keep] & np.uint64(_ALL ^ (NUMBERS - 1)) | np.uint64(min(band, NUMBERS - 1)))
        return out

    def __call__(self, shingles: np.ndarray) -> np.ndarray:
        if not len(shingles):
            return np.empty(0, np.uint64)
        light = self.light(shingles)
        parts = ([np.array(light, np.uint64)] if light else []) + self.heavy(shingles)
        return np.unique(np.concatenate(parts)) if parts else np.empty(0, np.uint64)


def choose_boundary(num: int, den: int, most: int = 32) -> int:
    """The largest size whose subsets are no more postings than its inverted lists would be, weighed by their lengths: a list of a small set's block (a shingle or two) is long, a shared subset is nearly a link, so a posting of a list counts ``weight`` times."""
    weight, best = 4, 0
    for size in range(1, most + 1):
        rule = Signatures(num, den, size)
        subsets = sum(comb(size, c) for c in {rule.overlap(b) for b in range(size, rule.largest(size) + 1)} if c <= size)
        lists = sum(Signatures(num, den, size - 1).blocks(high)[0] for *_, high in Signatures(num, den, size - 1).bands(size))
        if subsets <= weight * lists:
            best = size
        else:
            break
    return best


def _sketch(shingles: np.ndarray, bits: int) -> bytes:
    odd = np.bincount((_mix(shingles ^ _MIX) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def sketch_bits(size: int) -> int:
    """Sketch sizes are powers of two of 64 bits on, the same for sets up to about a third apart: folded when two differ."""
    return max(64, 1 << (2 * max(1, size) - 1).bit_length())


def _fold(sketches: np.ndarray, width: int) -> np.ndarray:
    """Parity sketches of fewer bits: positions modulo a power of two are the exclusive or of the parts."""
    while sketches.shape[1] > width:
        half = sketches.shape[1] // 2
        sketches = sketches[:, :half] ^ sketches[:, half:]
    return sketches


class Forest:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
        return a != b


def sketch_forest(ids: list[int], sizes: np.ndarray, sketches: list[bytes], cut: int, num: int, den: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs that sketches and sizes can't rule out.  ``cut`` > 0: only pairs across that position."""
    n = len(ids)
    forest, edges = Forest(n), []
    width = min(map(len, sketches))
    folded = np.concatenate([_fold(np.frombuffer(s, np.uint8)[None, :], width) for s in sketches])
    words = folded.view(np.uint64) if width % 8 == 0 else folded
    for i in range(cut or n):
        first = cut or i + 1
        if first >= n:
            break
        differ = np.bitwise_count(words[first:] ^ words[i]).sum(axis=1, dtype=np.int64)
        both = sizes[first:] + sizes[i]
        small, large = np.minimum(sizes[first:], sizes[i]), np.maximum(sizes[first:], sizes[i])
        passed = ((den + num) * differ <= (den - num) * both) & (den * small >= num * large)
        for j in (np.flatnonzero(passed) + first).tolist():
            if forest.join(i, j):
                edges.append((ids[i], ids[j]))
    return edges


def exact_forest(ids: list[int], sets: list[np.ndarray], cut: int, num: int, den: int) -> list[tuple[int, int]]:
    """A spanning forest of the exact links, by scanning the inverted lists of each set's shingles.  ``cut`` > 0: only links across that position."""
    n = len(ids)
    forest, edges = Forest(n), []
    sizes = np.array([len(s) for s in sets])
    keys, at = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(at, kind="stable")
    listed = np.repeat(np.arange(n), sizes)[order]
    starts = np.searchsorted(at[order], np.arange(len(keys) + 1))
    ends = np.cumsum(sizes)
    for i in range(cut or n):
        own = at[ends[i] - sizes[i] : ends[i]]
        first, length = starts[own], starts[own + 1] - starts[own]
        place = np.arange(length.sum()) + np.repeat(first - (np.cumsum(length) - length), length)
        shared = np.bincount(listed[place], minlength=n)
        linked = den * shared >= num * (sizes + sizes[i] - shared)
        for j in np.flatnonzero(linked).tolist():
            if j >= (cut or i + 1) and forest.join(i, j):
                edges.append((ids[i], ids[j]))
    return edges


EDGES = "a long, b long"
_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _stars(batches: Iterator[pa.RecordBatch], most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) of a task as stars: each id with the smallest one that the task's edges, up to ``most`` at once, reach."""

    def out(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        ends = [np.concatenate([x.column(k).to_numpy() for x in held]) for k in (0, 1)]
        ids, at = np.unique(np.concatenate(ends), return_inverse=True)
        forest = Forest(len(ids))
        for x, y in zip(at[: len(ends[0])].tolist(), at[len(ends[0]) :].tolist(), strict=True):
            forest.join(x, y)
        root = np.fromiter(map(forest.find, range(len(ids))), np.int64, len(ids))
        leaf = np.flatnonzero(root != np.arange(len(ids)))
        return pa.RecordBatch.from_arrays([pa.array(ids[leaf]), pa.array(ids[root[leaf]])], schema=_EDGES)

    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= most:
            yield out(held)
            held, size = [], 0
    if held:
        yield out(held)


def components(edges: DataFrame, *, plain: int = 1_000_000) -> DataFrame:
    """(id, component) of the ids in ``edges`` (a, b): the smallest id that edges reach.

    Tasks contract their own edges to stars first; alternating large-star and
    small-star rounds join these, until every id has one edge and none of its
    own star's centre.  Each round is written to the shared folder.  Beyond
    ``plain`` edges the least neighbours are written, too: a hub's edges then
    meet a plain table, and skew handling can split them.  Up to it, a round's
    edges go on in eight parts, which contract again.
    """

    def settled(df: DataFrame) -> bool:
        ends = df.select(F.col("a").alias("id"), F.col("b").alias("to")).unionByName(df.select(F.col("b").alias("id"), F.lit(None).cast("long").alias("to")))
        return ends.groupBy("id").agg(F.min("to").alias("low"), F.max("to").alias("high"), F.max(F.col("to").isNull()).alias("into")).where((F.col("low") != F.col("high")) | (F.col("low").isNotNull() & F.col("into"))).isEmpty()

    now = stage(edges.select("a", "b").mapInArrow(released(_stars), EDGES).distinct(), "edges")
    large_table = now.limit(plain + 1).count() > plain
    least = lambda df: stage(df, "least") if large_table else df
    fewer = lambda df: df.distinct() if large_table else df.coalesce(8).mapInArrow(released(_stars), EDGES)
    if not large_table:
        now = stage(fewer(now), "stars")
    while not settled(now):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = least(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = stage(fewer(both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))), "large-star")
        low = least(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = stage(fewer(small.unionByName(low.toDF("a", "b"))), "small-star")
    return now.distinct().select(F.col("a").alias("id"), F.col("b").alias("component"))


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows of neighbours with an equal first value."""
    held: list[tuple] = []
    for batch in batches:
        for part in split_batch(batch):
            for row in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if held and row[0] != held[0][0]:
                    yield held
                    held = []
                held.append(row)
    if held:
        yield held


def _edge_batches(found: Iterator[list[tuple[int, int]]]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[int, int]] = []
    for edges in found:
        held += edges
        if len(held) >= 8192:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*held, strict=True)], schema=_EDGES)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*held, strict=True)], schema=_EDGES)


_POSTINGS = pa.schema([("key", pa.int64()), ("node", pa.int64()), ("sketch", pa.binary())])
LISTS = "key long, part int, members array<long>, node long, size long, sketch binary"
_LISTS = pa.schema([("key", pa.int64()), ("part", pa.int32()), ("members", pa.list_(pa.int64())), ("node", pa.int64()), ("size", pa.int64()), ("sketch", pa.binary())])


def _postings(rule: Signatures, n: int):
    """(node, text) to rows (key, node, null), and for each node a row (a hash of it, node, its set's size and sketch)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(n)
        for batch in batches:
            for part in split_batch(batch, 4 << 20):
                own = part.column(0).to_numpy()
                keys, nodes, sketches = [], [], []
                for node, text in zip(own.tolist(), part.column(1).to_pylist(), strict=True):
                    found = shingles(text)
                    posted = rule(found)
                    keys.append(posted.view(np.int64))
                    nodes.append(np.full(len(posted), node, np.int64))
                    sketches.append(len(found).to_bytes(8, "little") + _sketch(found, sketch_bits(len(found))))
                key = np.concatenate([*keys, _mix(own.astype(np.uint64)).view(np.int64)])
                node = np.concatenate([*nodes, own])
                sketch = pa.concat_arrays([pa.nulls(len(key) - len(own), pa.binary()), pa.array(sketches, pa.binary())])
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(node), sketch], schema=_POSTINGS)

    return run


def _lists(most: int):
    """Postings sorted by key (equal rows are neighbours) to lists of several nodes, in parts of up to ``most``, and the nodes' own rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, open_nodes, open_part, last = None, [], 0, None
        rows: list[tuple] = []

        def close() -> None:
            if open_part or len(open_nodes) > 1:
                rows.append((open_key, open_part, open_nodes, None, None, None))

        for batch in batches:
            key, node = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            posted = batch.column(2).is_null().to_numpy(zero_copy_only=False)
            own = np.flatnonzero(~posted)
            for v, s in zip(node[own].tolist(), batch.column(2).take(pa.array(own)).to_pylist(), strict=True):
                if v != last:  # a row that repeats
                    rows.append((None, None, None, v, int.from_bytes(s[:8], "little"), s[8:]))
                last = v
            key, node = key[posted], node[posted]
            if len(key):
                # only runs of a key matter, and the first and last key, which may go on in other batches
                edge = np.flatnonzero(np.diff(key)) + 1
                starts, ends = np.concatenate(([0], edge)), np.concatenate((edge, [len(key)]))
                wanted = np.flatnonzero(ends - starts > 1)
                for r in sorted({0, len(starts) - 1, *wanted.tolist()}):
                    k, run_ = int(key[starts[r]]), node[starts[r] : ends[r]]
                    found = run_[np.concatenate(([True], run_[1:] != run_[:-1]))].tolist()
                    if k != open_key:
                        close()
                        open_key, open_nodes, open_part = k, [], 0
                    open_nodes += found if not open_nodes or open_nodes[-1] != found[0] else found[1:]
                    while len(open_nodes) > most:
                        rows.append((open_key, open_part, open_nodes[:most], None, None, None))
                        open_nodes, open_part = open_nodes[most:], open_part + 1
            if len(rows) >= 2048:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _LISTS.types, strict=True)], schema=_LISTS)
                rows.clear()
        close()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _LISTS.types, strict=True)], schema=_LISTS)

    return run


def cross_parts(groups: DataFrame, most: int) -> DataFrame:
    """(item, side, id): what has to be compared so that within each group (rows: group, sub, id) all ids of different subs meet.

    A sub of more than ``most`` ids fills parts of its own; smaller ones share parts, each whole in one.  An item is a
    pair of parts, or one shared part in itself; two parts of one sub don't meet, so a group of one sub has no item.
    """
    counted = stage(groups.groupBy("group", "sub").agg(F.count("*").alias("n")), "subs")
    several = counted.groupBy("group").agg(F.count("*").alias("subs"), F.sum(F.when(F.col("n") <= most, F.col("n"))).alias("small")).where("subs > 1")
    # whole: the sub that fills a part, -1 for shared parts
    large = F.col("n") > most
    parted = counted.join(several, "group").select("group", "sub", F.when(large, F.col("sub")).otherwise(-1).alias("whole"), F.ceil(F.when(large, F.col("n")).otherwise(F.col("small")) / F.lit(most)).alias("parts"))
    number = F.pmod(F.when(F.col("whole") < 0, F.xxhash64("sub")).otherwise(F.xxhash64("id")), F.col("parts"))
    dealt = stage(groups.join(parted, ["group", "sub"]).select("group", "whole", number.alias("number"), "id"), "dealt")
    parts = stage(dealt.select("group", "whole", "number").distinct(), "parts")
    first, second = F.struct("whole", "number"), F.struct("other_whole", "other_number")
    apart = (F.col("whole") < 0) | (F.col("whole") != F.col("other_whole"))
    pairs = parts.join(parts.toDF("group", "other_whole", "other_number"), "group").where((first < second) & apart)
    alone = parts.where("whole < 0").withColumns({"other_whole": F.lit(None).cast("long"), "other_number": F.lit(None).cast("long")})
    items = stage(pairs.unionByName(alone).withColumn("item", F.monotonically_increasing_id()), "cross")
    sides = items.select("item", F.lit(0).alias("side"), "group", "whole", "number").unionByName(items.where("other_whole is not null").select("item", F.lit(1).alias("side"), "group", F.col("other_whole").alias("whole"), F.col("other_number").alias("number")))
    return sides.join(dealt, ["group", "whole", "number"]).select("item", "side", "id")


def _likely(num: int, den: int):
    """Rows (item, side, id, size, sketch) sorted by item and side to forests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(group: list[tuple]) -> list[tuple[int, int]]:
            _, sides, ids, sizes, sketches = zip(*group, strict=True)
            return sketch_forest(list(ids), np.array(sizes, np.int64), list(sketches), sides.index(1) if 1 in sides else 0, num, den)

        yield from _edge_batches(found(g) for g in _groups(batches))

    return run


def _exact(num: int, den: int):
    """Rows (item, side, id, shingles) sorted by item and side to forests of exact links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(group: list[tuple]) -> list[tuple[int, int]]:
            _, sides, ids, shingles = zip(*group, strict=True)
            return exact_forest(list(ids), [np.frombuffer(x, "<u8") for x in shingles], sides.index(1) if 1 in sides else 0, num, den) if len(ids) > 1 else []

        yield from _edge_batches(found(g) for g in _groups(batches))

    return run


def _verified(num: int, den: int):
    """Rows (a, b, set of a, set of b): those that link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(den * shared >= num * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], schema=_EDGES).filter(pa.array(keep, pa.bool_()))

    return run


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(n)
        for batch in batches:
            for part in split_batch(batch):
                made = [shingles(x).astype("<u8").tobytes() for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(made, pa.binary())], names=["id", "shingles"])

    return run


@dataclass
class TextLinks:
    """keys: doc_id, text_key, words (whether it has any) of each row; texts: text_key, node, first (its smallest id), size of each different text with words; edges: a forest of the links between nodes."""

    keys: DataFrame
    texts: DataFrame
    edges: DataFrame


def link_texts(rows: DataFrame, *, num: int, den: int, n: int, chunk: int = 512, broadcast_ids: int = 200_000) -> TextLinks:
    """The links between the different texts of ``rows`` (doc_id, text).  ``chunk``: sets compared at once; ``broadcast_ids``: up to so many texts, those to read again are picked by a broadcast, beyond by a shuffle."""
    small_batches(rows.sparkSession)
    rule = Signatures(num, den, choose_boundary(num, den))
    rows = rows.withColumns({"text_key": F.unhex(F.md5(F.col("text").cast("binary"))), "words": F.col("text").rlike(r"[^\x20\x09-\x0D]")})

    # one node for each different text, read at the smallest of its ids
    keys = stage(rows.select("doc_id", "text_key", "words"), "keys")
    nodes = stage(keys.where("words").groupBy("text_key").agg(F.min("doc_id").alias("first")).withColumn("node", F.monotonically_increasing_id()), "nodes")
    read_at = lambda chosen: rows.join(chosen.withColumnRenamed("first", "doc_id"), ["text_key", "doc_id"]).select("node", "text")

    # postings, lists, and each node's size and sketch
    posted = read_at(nodes).mapInArrow(released(_postings(rule, n)), "key long, node long, sketch binary")
    lists = stage(posted.repartition(F.col("key")).sortWithinPartitions("key", "node").mapInArrow(released(_lists(chunk)), LISTS), "lists")
    features = lists.where("node is not null").select(F.col("node").alias("id"), "size", "sketch")
    parts = lists.where("members is not null").select("key", "part", "members")

    # long lists: only nodes with as many of a band's as a link shares stay, in one of three orders
    hot = parts.where("part > 0").select("key").distinct()
    long = hot.join(parts, "key").select("key", F.explode("members").alias("node")).withColumn("band", F.pmod("key", F.lit(NUMBERS)).cast("int"))
    least = F.element_at(F.array(*map(F.lit, rule.shared_lists())), F.col("band") + 1)
    enough = long.groupBy("node", "band").agg(F.count("*").alias("lists")).where(F.col("lists") >= least).select("node", "band")
    left = long.join(enough, ["node", "band"]).select("key", "node", F.lit(None).cast("binary").alias("sketch"))
    order = F.xxhash64("node", F.pmod(F.shiftright("key", 6), F.lit(3)))
    again = stage(left.repartition(F.col("key")).sortWithinPartitions("key", order, "node").mapInArrow(released(_lists(chunk)), LISTS), "long-lists").select("key", "part", "members")

    def compared(placed: DataFrame) -> DataFrame:
        described = placed.join(features, "id").select("item", "side", "id", "size", "sketch")
        return described.repartition(F.col("item")).sortWithinPartitions("item", "side", "id").mapInArrow(released(_likely(num, den)), EDGES)

    # each different part in itself
    short = parts.join(hot, "key", "left_anti")
    one = stage(short.unionByName(again).select("members").where("size(members) > 1").distinct().withColumn("item", F.monotonically_increasing_id()), "items")
    likely = stage(compared(one.select("item", F.lit(0).alias("side"), F.explode("members").alias("id"))), "likely")
    candidates = components(likely)

    # across the parts of lists that are still long, what isn't together yet
    if not again.where("part > 0").isEmpty():
        still = again.where("part > 0").select("key").distinct().join(again, "key").select(F.col("key").alias("group"), F.explode("members").alias("id"))
        apart = still.join(candidates, "id", "left").select("group", F.coalesce("component", "id").alias("sub"), "id")
        across = stage(compared(cross_parts(apart, chunk // 2)), "across")
        if not across.isEmpty():
            likely = likely.unionByName(across)
            candidates = components(likely)

    # exact links: small components whole
    whole = max(2, chunk // 4)
    both = stage(candidates.unionByName(candidates.select(F.col("component").alias("id"), "component")).distinct(), "candidates")
    sizes = both.groupBy("component").agg(F.count("*").alias("n"))
    few = both.limit(broadcast_ids + 1).count() <= broadcast_ids

    def sets_of(ids: DataFrame) -> DataFrame:
        wanted = nodes.join(ids.select(F.col("id").alias("node")), "node")
        return read_at(F.broadcast(wanted) if few else wanted).mapInArrow(released(_sets(n)), "id long, shingles binary").dropDuplicates(["id"])

    def linked(work: DataFrame) -> DataFrame:
        return work.repartition(F.col("item")).sortWithinPartitions("item", "side", "id").mapInArrow(released(_exact(num, den)), EDGES)

    small = both.join(sizes.where(F.col("n") <= whole), "component").select(F.col("component").alias("item"), F.lit(0).alias("side"), "id")
    edges = linked(small.join(sets_of(small), "id").select("item", "side", "id", "shingles"))

    # large ones: forests' edges first, then only what stays apart
    large = both.join(sizes.where(F.col("n") > whole), "component").select("component", "id")
    if not large.isEmpty():
        large = stage(large, "large")
        own = stage(sets_of(large), "large-sets")
        # of each id's edges to smaller ones the first and the last
        down = likely.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).join(large.select(F.col("id").alias("a")), "a")
        asked = down.groupBy("a").agg(F.min("b").alias("p"), F.max("b").alias("q")).select("a", F.explode(F.array_distinct(F.array("p", "q"))).alias("b"))
        pairs = asked.join(own.toDF("a", "x"), "a").join(own.toDF("b", "y"), "b").select("a", "b", "x", "y")
        sure = stage(pairs.mapInArrow(released(_verified(num, den)), EDGES), "verified")
        apart = large.join(components(sure).toDF("id", "sub"), "id", "left").select(F.col("component").alias("group"), F.coalesce("sub", "id").alias("sub"), "id")
        met = cross_parts(apart, max(1, chunk // 8)).join(own, "id").select("item", "side", "id", "shingles")
        edges = edges.unionByName(sure).unionByName(linked(met))
    texts = nodes.join(features.select(F.col("id").alias("node"), "size"), "node")
    return TextLinks(keys, texts, stage(edges, "links"))


def link_documents(docs: DataFrame, *, num: int = 85, den: int = 100, n: int = 4, id_col: str = "doc_id", text_col: str = "text", chunk: int = 512, broadcast_ids: int = 200_000) -> DataFrame:
    """A row for each row with an id: doc_id, n_shingles, component_id (the smallest id reachable by links, itself included)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where("doc_id is not null")
    found = link_texts(rows, num=num, den=den, n=n, chunk=chunk, broadcast_ids=broadcast_ids)
    # links between texts as links between their smallest ids, and ids with several texts: a component's name needs no search then
    named = found.texts.select("node", "first")
    links = found.edges.join(named.toDF("a", "x"), "a").join(named.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    filled = found.keys.where("words")
    repeated = filled.groupBy("doc_id").agg(F.min("text_key").alias("p"), F.max("text_key").alias("q")).where("p <> q").select("doc_id")
    through = filled.join(repeated, "doc_id").join(found.texts.select("text_key", "first"), "text_key").select(F.col("doc_id").alias("a"), F.col("first").alias("b"))
    joined = components(links.unionByName(through))
    told = stage(found.texts.join(joined.select(F.col("id").alias("first"), "component"), "first", "left").select("text_key", F.col("size").alias("n_shingles"), F.coalesce("component", "first").alias("component_id")), "told")
    empty = found.keys.where(~F.col("words")).select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return filled.join(told, "text_key").select("doc_id", "n_shingles", "component_id").unionByName(empty)


def drop_near_duplicates(docs: DataFrame, *, num: int = 85, den: int = 100, n: int = 4, id_col: str = "doc_id", text_col: str = "text", broadcast_ids: int = 200_000, **options) -> DataFrame:
    """One row of each component of linked texts stays: that of the smallest id, and of texts with that id the one of the smallest digest.

    Rows count by their texts, so rows that repeat an id with texts that have nothing in common all stay.  Of rows equal
    in id and text one stays, the least in its other columns where these can be ordered.  Rows without an id and texts
    without words stay all.  Up to ``broadcast_ids`` texts that go or repeat meet the rows by a broadcast, so that no whole
    text is shuffled for it; more do by a shuffle.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    id_, text = (names[docs.columns.index(c)] for c in (id_col, text_col))
    plain = docs.toDF(*names).withColumns({"doc_id": F.col(id_).cast("long"), "text": F.coalesce(F.col(text), F.lit(""))})
    found = link_texts(plain.select("doc_id", "text").where("doc_id is not null"), num=num, den=den, n=n, broadcast_ids=broadcast_ids, **options)
    linked = components(found.edges)
    linked = stage(linked.unionByName(linked.select(F.col("component").alias("id"), "component")).distinct().join(found.texts.select(F.col("node").alias("id"), "first", "text_key"), "id"), "linked")
    stays = linked.groupBy("component").agg(F.min(F.struct("first", "text_key"))["text_key"].alias("text_key")).select("text_key")
    gone = linked.select("text_key").join(stays, "text_key", "left_anti").select("text_key", F.lit(None).cast("long").alias("first"), F.lit(0).cast("long").alias("n"))
    # texts of several rows: the row of the smallest id stays
    copies = found.keys.where("words").groupBy("text_key", "doc_id").agg(F.count("*").alias("n")).groupBy("text_key").agg(F.min(F.struct("doc_id", "n")).alias("least"), F.sum("n").alias("rows")).where("rows > 1")
    copies = copies.join(gone, "text_key", "left_anti").select("text_key", F.col("least.doc_id").alias("first"), F.col("least.n").alias("n"))
    fate = stage(gone.unionByName(copies), "fates")
    few = fate.limit(broadcast_ids + 1).count() <= broadcast_ids
    judged = plain.withColumn("text_key", F.unhex(F.md5(F.col("text").cast("binary")))).join(F.broadcast(fate) if few else fate, "text_key", "left")
    kept = judged.where(F.col("n").isNull() | F.col("doc_id").isNull() | (F.col("doc_id") == F.col("first")))
    several = (F.col("n") > 1) & F.col("doc_id").isNotNull()
    out = kept.where(~F.coalesce(several, F.lit(False))).select(names)
    if not fate.where("n > 1").isEmpty():
        again = kept.where(several)
        try:
            again = again.groupBy("text_key").agg(F.min(F.struct(*names)).alias("row")).select("row.*")
        except AnalysisException:  # columns without an order
            again = again.dropDuplicates(["text_key"]).select(names)
        out = out.unionByName(again)
    return out.toDF(*docs.columns)
