"""Token-id output: Arrow files of equal-length sequences and masks.

``write_token_files`` deals the documents out by ranges of their id, encodes
each range in ascending id order and writes it as one Arrow IPC file whose
record batches hold two fixed-size-list columns: ``tokens`` (unsigned 16-bit
integers where the vocabulary allows, else 32-bit) and ``mask`` (a bit: 1 for a
token, 0 for the padding of the file's last sequence).  Every sequence has the same
length, so sequence k of a file is a zero-copy slice of batch ``k //
sequences_per_batch`` when the file is mapped into memory.  The index that is
returned (a written table in the shared folder) has for each document its
file, offset in that file's ids and length.

A task writes to a file name of its own and the index names only files of tasks
that ended well, so a lost executor or a second attempt does no harm.  Files go
to a URI through ``pyarrow.fs``: any store that it reaches from the executors.

Defined results: a null text is empty (only the end id); a null id sorts first;
rows that repeat an id are documents of their own, ordered by text; an empty
table gives an empty index; other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, split_batch, stage, work_path
from .tokens import Encoder

INDEX = "doc_id long, shard int, file string, at long, n_tokens long"
_INDEX = pa.schema([("doc_id", pa.int64()), ("shard", pa.int32()), ("file", pa.string()), ("at", pa.int64()), ("n_tokens", pa.int64())])


class _Writer:
    """Buffers ids and writes whole record batches of ``per_batch`` sequences."""

    def __init__(self, uri: str, kind: pa.DataType, length: int, per_batch: int):
        self.store, path = fs.FileSystem.from_uri(uri)
        self.sink = self.store.open_output_stream(path)
        self.kind, self.length, self.size = kind, length, length * per_batch
        self.schema = pa.schema([("tokens", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.out = pa.ipc.new_file(self.sink, self.schema)
        self.held: list[np.ndarray] = []
        self.n = 0

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.n += len(ids)
        if self.n >= self.size:
            ids = np.concatenate(self.held)
            whole = len(ids) // self.size * self.size
            for i in range(0, whole, self.size):
                self._batch(ids[i : i + self.size], self.size)
            self.held, self.n = [ids[whole:].copy()], len(ids) - whole

    def _batch(self, ids: np.ndarray, n: int) -> None:
        mask = np.arange(len(ids)) < n
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(x, t), self.length) for x, t in ((ids, self.kind), (mask, pa.bool_()))]
        self.out.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))

    def close(self) -> None:
        if self.n:
            ids = np.concatenate(self.held)
            self._batch(np.pad(ids, (0, -len(ids) % self.length)), len(ids))
        self.out.close()
        self.sink.close()


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, *, out: str | None = None, id_col: str = "doc_id", text_col: str = "text", length: int = 2048, per_batch: int = 64) -> DataFrame:
    """Write the ids of all texts, each followed by ``end_id``, and return the index, ordered within files.  ``out``: a folder's URI; None is a new one in the shared folder."""
    small_batches(docs.sparkSession)
    folder = out or work_path(docs.sparkSession, "token-files")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer)
        kind = pa.uint16() if max(encoder.vocab_size, end_id + 1) <= 1 << 16 else pa.uint32()
        shard, done, writer = TaskContext.get().partitionId(), 0, None
        uri = f"{folder}/shard-{shard:06d}-{uuid.uuid4().hex}.arrow"
        for batch in batches:
            for part in split_batch(batch, 6 << 20):
                if writer is None:
                    store, path = fs.FileSystem.from_uri(folder)
                    store.create_dir(path, recursive=True)
                    writer = _Writer(uri, kind, length, per_batch)
                ids, ends = encoder.encode_all(part.column(1))
                ids = np.insert(ids.astype(kind.to_pandas_dtype()), ends[1:], end_id)
                ends = ends + np.arange(len(ends))
                writer.add(ids)
                n = part.num_rows
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.full(n, shard), pa.int32()), pa.array([uri] * n), pa.array(done + ends[:-1]), pa.array(np.diff(ends))], schema=_INDEX)
                done += len(ids)
        if writer is not None:
            writer.close()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return stage(rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text").mapInArrow(run, INDEX), "token-index")


def with_starts(index: DataFrame) -> DataFrame:
    """The index with ``start``: the ids of all documents before, over all files.  Only a row a file goes through the unpartitioned window."""
    files = index.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return index.join(files.select("shard", before.alias("before")), "shard").withColumn("start", F.col("before") + F.col("at")).drop("before")


class SequenceFile:
    """Random access to one file, by views of mapped batches: ``sequence(k)`` is sequence k and its mask, ``ids(at, n)`` are ids in parts, one a batch."""

    def __init__(self, uri: str):
        store, path = fs.FileSystem.from_uri(uri)
        self.reader = pa.ipc.open_file(pa.memory_map(path) if isinstance(store, fs.LocalFileSystem) else store.open_input_file(path))
        self.length = self.reader.schema.field("tokens").type.list_size
        self.kept: OrderedDict[int, tuple[np.ndarray, pa.BooleanArray]] = OrderedDict()
        self.size = len(self.batch(0)[0])

    def batch(self, k: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """Ids and mask bits of a batch's sequences one after another."""
        if k not in self.kept:
            found = self.reader.get_batch(k)
            self.kept[k] = found.column(0).flatten().to_numpy(), found.column(1).flatten()
            if len(self.kept) > 2:
                self.kept.popitem(last=False)
        return self.kept[k]

    def sequence(self, k: int) -> tuple[np.ndarray, pa.BooleanArray]:
        number, at = divmod(k * self.length, self.size)
        ids, mask = self.batch(number)
        return ids[at : at + self.length], mask.slice(at, self.length)

    def ids(self, at: int, n: int) -> Iterator[np.ndarray]:
        """Raises where the mask says that an id is padding."""
        while n:
            k, i = divmod(at, self.size)
            ids, mask = self.batch(k)
            part = ids[i : i + n]
            if len(part) == 0 or not pc.all(mask.slice(i, len(part))).as_py():
                raise ValueError(f"no token at {at}")
            yield part
            at, n = at + len(part), n - len(part)


def read_token_files(index: DataFrame) -> DataFrame:
    """The index's rows with ``ids_crc32``, the unsigned crc32 of each document's ids as little-endian unsigned 32-bit integers, read from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri, file = None, None
        for batch in batches:
            found = []
            for name, at, n in zip(*(batch.column(c).to_pylist() for c in ("file", "at", "n_tokens")), strict=True):
                if name != uri:
                    uri, file = name, SequenceFile(name)
                crc = 0
                for part in file.ids(at, n):
                    crc = zlib.crc32(part.astype("<u4").tobytes(), crc)
                found.append(crc)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int64())], names=[*batch.schema.names, "ids_crc32"])

    return index.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in index.schema.fields) + ", ids_crc32 long")
