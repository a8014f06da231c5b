"""Tables and small files in folders that the driver and all executors see."""

from __future__ import annotations

import atexit
import re
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

#: Used only in local sessions that name no checkpoint folder (tests, trials).
LOCAL_DIR = "file:///tmp/checkpoints/strideframe"


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; in a local session without it a folder that is set here, on a cluster an error, as machines don't share their own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(LOCAL_DIR)
        found = LOCAL_DIR
    return found.rstrip("/")


def _at(spark: SparkSession, path: str) -> tuple:
    """The store of a path and the path in it."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(str(path))
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    store, target = _at(spark, path)
    return store.exists(target)


def delete(spark: SparkSession, path: str) -> None:
    store, target = _at(spark, path)
    store.delete(target, True)


def rename(spark: SparkSession, path: str, to: str) -> None:
    """Moves a file or folder, over another of that name."""
    store, target = _at(spark, path)
    delete(spark, to)
    store.rename(target, _at(spark, to)[1])


def listed(spark: SparkSession, path: str) -> list[str]:
    """The folders' names in a folder, sorted; none where there is no folder."""
    store, target = _at(spark, path)
    return sorted(s.getPath().getName() for s in store.listStatus(target) if s.isDirectory()) if store.exists(target) else []


def file_state(spark: SparkSession, path: str) -> dict | None:
    """path, size and mtime_ms of a file in any store; None where there is none."""
    store, target = _at(spark, path)
    if not store.exists(target):
        return None
    found = store.getFileStatus(target)
    return {"path": found.getPath().toString(), "size": found.getLen(), "mtime_ms": found.getModificationTime()}


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text; None where there is none or it doesn't match its checksum."""
    store, target = _at(spark, path)
    if not store.exists(target):
        return None
    stream = store.open(target)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8", "replace")
    except Py4JJavaError as e:
        if "ChecksumException" in str(e):
            return None
        raise
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, whole or not at all."""
    store, target = _at(spark, f"{path}.part")
    stream = store.create(target, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    rename(spark, f"{path}.part", path)


def _forget(spark: SparkSession, path: str) -> None:
    try:
        delete(spark, path)
    except Exception:  # the session has ended: the cluster's own clean-up of the folder applies
        return


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is there is deleted when the driver's Python ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_forget, spark, path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts lineage, survives lost executors, and runs ``df`` once."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
