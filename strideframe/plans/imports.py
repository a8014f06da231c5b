"""Imports of extracts: their elements, a manifest each, and when one has to run again.

Below ``folder``: ``elements/import_fingerprint=...`` and ``manifests/import_fingerprint=...``.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strideframe import storage
from strideframe.config import hash_of
from strideframe.plans.publishing import refresh_needed
from strideframe.sources import osm_pbf
from strideframe.sources.features import categorised

MANIFEST = "import_fingerprint string, extract_path string, extract_fingerprint string, importer_version string, rules_hash string, scope_hash string, status string, created_at timestamp, completed_at timestamp"


def fingerprint(spark: SparkSession, extract: str) -> str:
    """An extract's path, size and time in whatever store it is in; raises where there is none."""
    state = storage.file_state(spark, extract)
    if state is None:
        raise FileNotFoundError(extract)
    return hash_of(state)


def _put(spark: SparkSession, folder: str, values: dict) -> None:
    """A manifest in place of any of its fingerprint."""
    names = [c.split()[0] for c in MANIFEST.split(", ")]
    row = spark.createDataFrame([tuple(values.get(n) for n in names)], MANIFEST).coalesce(1)
    row.drop("import_fingerprint").write.mode("overwrite").parquet(f"{folder}/manifests/import_fingerprint={values['import_fingerprint']}")


def manifest(spark: SparkSession, folder: str, import_fingerprint: str) -> dict | None:
    path = f"{folder}/manifests/import_fingerprint={import_fingerprint}"
    if not storage.exists(spark, f"{path}/_SUCCESS"):
        return None
    row = spark.read.parquet(path).first()
    return row.asDict() | {"import_fingerprint": import_fingerprint} if row else None


def is_complete(found: dict | None, scope_hash: str | None = None) -> bool:
    """Whether a manifest says so, and, if asked, of this scope."""
    return found is not None and found["status"] == "complete" and scope_hash in (None, found["scope_hash"])


def begin(spark: SparkSession, folder: str, **values: str) -> dict:
    """Puts a manifest of status ``building``."""
    row = values | {"status": "building", "created_at": datetime.now(timezone.utc).replace(tzinfo=None), "completed_at": None}
    _put(spark, folder, row)
    return row


def complete(spark: SparkSession, folder: str, row: dict) -> None:
    _put(spark, folder, row | {"status": "complete", "completed_at": datetime.now(timezone.utc).replace(tzinfo=None)})


def clear(spark: SparkSession, folder: str, import_fingerprint: str) -> None:
    """Drops an import, its manifest first."""
    for name in ("manifests", "elements"):
        storage.delete(spark, f"{folder}/{name}/import_fingerprint={import_fingerprint}")


def elements(spark: SparkSession, folder: str, import_fingerprint: str) -> DataFrame | None:
    path = f"{folder}/elements/import_fingerprint={import_fingerprint}"
    return spark.read.schema(osm_pbf.SCHEMA).parquet(path) if storage.exists(spark, f"{path}/_SUCCESS") else None


def ensure(spark: SparkSession, folder: str, extract: str, import_fingerprint: str, *, scope_hash: str, version: str, force: bool = False, allowed: bool = True) -> DataFrame:
    """The import's elements.  One that is ready (its manifest complete, with a categorised element) stays; else it is made anew, or, where that isn't ``allowed``, an error.  A failure leaves nothing behind."""
    known = elements(spark, folder, import_fingerprint)
    ready = known is not None and not categorised(known).limit(1).isEmpty()
    if not refresh_needed(ready, is_complete(manifest(spark, folder, import_fingerprint)), force, allowed):
        return known
    clear(spark, folder, import_fingerprint)
    osm_pbf.register(spark)
    try:
        row = begin(spark, folder, import_fingerprint=import_fingerprint, extract_path=extract, extract_fingerprint=fingerprint(spark, extract), importer_version=version, rules_hash=import_fingerprint, scope_hash=scope_hash)
        spark.read.format("osm_pbf").load(extract).write.parquet(f"{folder}/elements/import_fingerprint={import_fingerprint}")
        complete(spark, folder, row)
    except Exception:
        clear(spark, folder, import_fingerprint)
        raise
    return elements(spark, folder, import_fingerprint)


def readiness(manifests: DataFrame) -> DataFrame:
    """Of each extract the number of imports and whether one is complete."""
    return manifests.groupBy("extract_path").agg(F.count("*").alias("builds"), (F.count_if(F.col("status") == "complete") > 0).alias("ready"))
