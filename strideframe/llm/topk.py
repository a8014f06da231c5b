"""Exact top-k search by columnar branch and bound.

Vectors lie in vertical layout: a block holds one row per dimension, so a step
reads the same dimensions of all candidates.  For a query block the dimensions
are taken in order of their share of its mass; partial inner products grow
dimension block by dimension block.  After each, the mass that remains bounds
every candidate from both sides (Cauchy-Schwarz on the remaining norms): the
k-th best lower bound is the threshold, and candidates whose upper bound is
below it are compacted away.  The first step runs for all queries of a block at
once; after that each query follows its own survivors.

Queries and candidates are packed into bounded blocks.  Candidate blocks are
dealt to groups of about ``group`` blocks once and stay there; the far fewer
query blocks are copied to every group and stream past its candidates, one at a
time.  A task so holds one group's candidates and one query block.  From block
to block each query carries its k-th best score, which later blocks prune with.
The groups' winners (k a query) meet in a window per query.  Nothing is
broadcast or collected.

Components are floor(scale * x).  Scores are integers: sums run in doubles
where every partial sum is below 2^53, else in Python integers, which stay
exact; a score beyond 64 bits counts as the nearest 64-bit value.

Defined results: vectors that are null or hold a null or non-finite component
take no part, nor do those with an empty list or a null id; ties go to the
smaller id, and rows that repeat an id are candidates of their own except that
no row is a candidate for a query of its own id; lists of different lengths
only meet their like; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

FOUND = "query_id long, vec_id long, score long"
_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
BLOCK = "block long, dims int, kind string, ids binary, columns binary"
_BLOCK = pa.schema([("block", pa.int64()), ("dims", pa.int32()), ("kind", pa.string()), ("ids", pa.binary()), ("columns", pa.binary())])


def _blocks(vectors: DataFrame, scale: float, size: int) -> DataFrame:
    """Blocks of up to ``size`` vectors of one length, a row per dimension, as 16-bit integers where they fit, else as doubles."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        held: dict[int, list] = {}

        def out(dims: int) -> pa.RecordBatch:
            nonlocal number
            ids, rows = zip(*held.pop(dims), strict=True)
            number += 1
            columns = np.ascontiguousarray(np.floor(scale * np.array(rows, np.float64)).T)
            kind = "<i2" if np.abs(columns).max() < 1 << 15 else "<f8"
            values = (number, dims, kind, np.array(ids, "<i8").tobytes(), columns.astype(kind).tobytes())
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(values, _BLOCK.types, strict=True)], schema=_BLOCK)

        for batch in batches:
            flat, ends = batch.column(1).flatten().to_numpy(zero_copy_only=False), batch.column(1).offsets.to_numpy()
            ends = ends - ends[0]
            for vec, i, j in zip(batch.column(0).to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                group = held.setdefault(j - i, [])
                group.append((vec, flat[i:j]))
                if len(group) == size:
                    yield out(j - i)
        for dims in list(held):
            yield out(dims)

    return vectors.mapInArrow(pack, BLOCK)


def _remaining(columns: np.ndarray, steps: list[slice]) -> list[np.ndarray]:
    """For each step the norms of what comes after it, a little enlarged for rounding."""
    mass = np.stack([(columns[s] ** 2).sum(axis=0) for s in steps])
    rest = mass[::-1].cumsum(axis=0)[::-1]
    return [np.sqrt(np.maximum(rest[k + 1], 0)) * (1 + 1e-9) if k + 1 < len(steps) else np.zeros(columns.shape[1]) for k in range(len(steps))]


def search_block(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, columns: np.ndarray, k: int, step: int = 8, floor: np.ndarray | None = None) -> Iterator[tuple[int, int, int]]:
    """(query's place, candidate, score) of each query's k best in a block; both blocks have a row per dimension.  ``floor``: for each query a score below which none is wanted."""
    biggest = float(np.abs(queries).max(initial=0)) * float(np.abs(columns).max(initial=0)) * max(1, len(columns))
    if not biggest < 2**53:
        yield from _search_large(query_ids, queries, ids, columns, k)
        return
    order = np.argsort(-(queries**2).sum(axis=1), kind="stable")
    queries, columns = queries[order], columns[order]
    steps = [slice(i, i + step) for i in range(0, len(order), step)]
    rest_c, rest_q = _remaining(columns, steps), _remaining(queries, steps)
    by_id = np.argsort(ids, kind="stable")
    ids, columns, rest_c = ids[by_id], columns[:, by_id], [r[by_id] for r in rest_c]
    for first in range(0, len(query_ids), 64):  # a bounded table of partial sums
        part = slice(first, first + 64)
        start = queries[steps[0], part].T @ columns[steps[0]]
        for at, query in enumerate(query_ids[part].tolist()):
            q, alive, score = queries[:, first + at], np.flatnonzero(ids != query), None
            score = start[at][alive]
            least = -np.inf if floor is None else floor[first + at]
            for n, s in enumerate(steps):
                if not len(alive):
                    break
                if n:
                    score = score + q[s] @ columns[s][:, alive]
                slack = rest_q[n][first + at] * rest_c[n][alive]
                if len(alive) > k or least > -np.inf:
                    low = score - slack
                    bound = max(least, np.partition(low, len(low) - k)[len(low) - k]) if len(alive) > k else least
                    keep = score + slack >= bound
                    if n + 1 < len(steps) and keep.mean() > 0.9:
                        continue  # too few to compact
                    alive, score = alive[keep], score[keep]
            best = np.lexsort((ids[alive], -score))[:k]
            yield from ((first + at, int(ids[alive[b]]), int(score[b])) for b in best)


def _search_large(query_ids, queries, ids, columns, k):
    most = 2**63 - 1
    rows = [[int(x) for x in c] for c in columns.T.tolist()]
    for place, (query, q) in enumerate(zip(query_ids.tolist(), queries.T.tolist(), strict=True)):
        q = [int(x) for x in q]
        scores = sorted((-max(-most - 1, min(most, sum(a * b for a, b in zip(q, r, strict=True)))), int(i)) for i, r in zip(ids.tolist(), rows, strict=True) if i != query)
        yield from ((place, i, -s) for s, i in scores[:k])


def top_k(vectors: DataFrame, is_query: F.Column, *, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding", query_block: int = 2048, block: int = 8192, group: int = 64) -> DataFrame:
    """The k candidates of highest inner product for each query: query_id, rank (from 1), vec_id, score."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"), is_query.alias("is_query"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~bad)
    total, n_queries = rows.agg(F.count("*"), F.count_if("is_query")).first()
    asked = rows.where("is_query").select("vec_id", "embedding")
    queries = stage(_blocks(asked.repartition(max(1, -(-n_queries // query_block))), scale, query_block), "query-blocks")
    blocks = max(1, -(-total // block))
    groups = max(-(-blocks // group), min(blocks, 2 * vectors.sparkSession.sparkContext.defaultParallelism))
    left = _blocks(rows.select("vec_id", "embedding"), scale, block).withColumns({"group": F.pmod(F.xxhash64("block"), F.lit(groups)), "side": F.lit(0)})
    right = queries.withColumns({"group": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))), "side": F.lit(1)})
    names = ["group", "side", "dims", "kind", "ids", "columns"]
    met = left.select(names).unionByName(right.select(names)).repartition(F.col("group")).sortWithinPartitions("group", "side", "dims")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []  # the group's candidates: dims, kind, ids, columns
        for batch in batches:
            for i in range(batch.num_rows):
                number, side, dims, kind, ids, columns = (batch.column(j)[i].as_py() for j in range(6))
                if number != now:
                    now, held = number, []
                ids = np.frombuffer(ids, "<i8")
                matrix = np.frombuffer(columns, kind).reshape(dims, -1)
                if side == 0:
                    held.append((dims, ids, matrix))
                    continue
                asked_, best = matrix.astype(np.float64), {}
                floor = np.full(len(ids), -np.inf)
                # winners go by place, as rows that repeat a query's id may ask other questions
                for own, candidates, held_matrix in held:
                    if own != dims:
                        continue
                    for place, vec, score in search_block(ids, asked_, candidates, held_matrix.astype(np.float64), k, floor=floor):
                        best.setdefault(place, []).append((-score, vec))
                    for place, found in best.items():
                        if len(found) > k:
                            best[place] = found = sorted(found)[:k]
                        if len(found) == k:
                            floor[place] = -max(found)[0]
                rows_ = [(int(ids[place]), vec, -score) for place, found in best.items() for score, vec in sorted(found)[:k]]
                for at in range(0, len(rows_), 65_536):
                    yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows_[at : at + 65_536]], pa.int64()) for c in range(3)], schema=_FOUND)

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return met.mapInArrow(search, FOUND).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
