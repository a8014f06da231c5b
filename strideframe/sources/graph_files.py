"""The walking graph as files: Parquet tables with a meta file written last, and plain little-endian arrays for exchange."""

from __future__ import annotations

import json
from datetime import datetime, timezone
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strideframe.config import same_box

VERSION = 3
NODES = "node_id long, lat float, lon float"
EDGES = "src long, dst long, length_m float"


def save_graph(nodes: DataFrame, edges: DataFrame, folder: str, **meta) -> dict:
    """Writes nodes and edges, then the meta row, whose presence says that the rest is whole."""
    spark = nodes.sparkSession
    nodes.select("node_id", "lat", "lon").write.mode("overwrite").parquet(f"{folder}/nodes")
    edges.select("src", "dst", "length_m").write.mode("overwrite").parquet(f"{folder}/edges")
    found = {"format_version": VERSION, "node_count": spark.read.parquet(f"{folder}/nodes").count(), "edge_count": spark.read.parquet(f"{folder}/edges").count(), "created_utc": datetime.now(timezone.utc).isoformat(), **meta}
    spark.createDataFrame([(json.dumps(found),)], "meta string").coalesce(1).write.mode("overwrite").text(f"{folder}/meta")
    return found


def load_graph(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, dict]:
    """Nodes, edges and meta; raises where the version or a count differs."""
    meta = json.loads(spark.read.text(f"{folder}/meta").first()[0])
    if meta["format_version"] != VERSION:
        raise ValueError(f"graph format {meta['format_version']}, not {VERSION}")
    nodes, edges = spark.read.schema(NODES).parquet(f"{folder}/nodes"), spark.read.schema(EDGES).parquet(f"{folder}/edges")
    if (nodes.count(), edges.count()) != (meta["node_count"], meta["edge_count"]):
        raise ValueError(f"{folder}: rows and meta differ")
    return nodes, edges, meta


def matches(meta: dict, *, extract_fingerprint: str, bbox: tuple | None, padding_m: float) -> bool:
    """Whether a saved graph is that of an extract, box and padding."""
    return meta.get("format_version") == VERSION and meta.get("extract_fingerprint") == extract_fingerprint and same_box(meta.get("bbox") and tuple(meta["bbox"]), bbox) and abs(round(meta.get("bbox_padding_m", 0.0), 6) - round(padding_m, 6)) <= 1e-9


def read_array(path: str | Path, kind: str, count: int | None = None) -> np.ndarray:
    """A plain array file; raises where its size is no multiple of the kind's or not the count's."""
    data = Path(path).read_bytes()
    if len(data) % np.dtype(kind).itemsize:
        raise ValueError(f"{path}: {len(data)} bytes are no whole {kind} values")
    found = np.frombuffer(data, kind)
    if count is not None and len(found) != count:
        raise ValueError(f"{path}: {len(found)} values, not {count}")
    return found


def read_csr(folder: str | Path, nodes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """offsets.u64, targets.u32, lengths.f32 of a graph of ``nodes`` nodes."""
    offsets = read_array(Path(folder, "offsets.u64"), "<u8", nodes + 1)
    return offsets, read_array(Path(folder, "targets.u32"), "<u4", int(offsets[-1])), read_array(Path(folder, "lengths.f32"), "<f4", int(offsets[-1]))


def csr_edges(spark: SparkSession, offsets: np.ndarray, targets: np.ndarray, lengths: np.ndarray) -> DataFrame:
    import pandas as pd

    src = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets.astype(np.int64)))
    return spark.createDataFrame(pd.DataFrame({"src": src, "dst": targets.astype(np.int64), "length_m": lengths}), EDGES).select("src", "dst", F.col("length_m"))


def read_weights(spark: SparkSession, path: str | Path, categories: tuple[str, ...]) -> DataFrame:
    """node_id, category, n from a file of fixed-width records: a node's number and a count for each category, all little-endian unsigned 32-bit integers."""
    import pandas as pd

    values = read_array(path, "<u4")
    width = len(categories) + 1
    if len(values) % width:
        raise ValueError(f"{path}: {len(values)} values are no whole records of {width}")
    table = pd.DataFrame(values.reshape(-1, width).astype(np.int64), columns=["node_id", *categories])
    wide = spark.createDataFrame(table) if len(table) else spark.createDataFrame([], ", ".join(f"`{c}` long" for c in table.columns))
    return wide.unpivot("node_id", list(categories), "category", "n").where("n > 0")
