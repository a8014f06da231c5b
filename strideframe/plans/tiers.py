"""Result tiers (geo, reach, score): tables named by content hashes, with a manifest each."""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from strideframe import storage
from strideframe.config import ScoringConfig, environment

ORDER = ("geo", "reach", "score")


class Tier:
    """One tier's folder, in any store that Spark reaches: ``manifest.json`` and Parquet tables."""

    def __init__(self, folder: str | Path, name: str, expected: str, config: ScoringConfig | None = None):
        self.uri, self.name, self.expected, self.config = f"{folder}/{name}/{expected}", name, expected, config or ScoringConfig()
        self.started = False

    @property
    def path(self) -> Path:
        """The folder, where it is on this machine."""
        return Path(self.uri)

    @property
    def _spark(self) -> SparkSession:
        return SparkSession.active()

    def manifest(self) -> dict | None:
        try:
            return json.loads(storage.read_text(self._spark, f"{self.uri}/manifest.json") or "")
        except ValueError:
            return None

    def _write(self, status: str, phase: str) -> None:
        body = {"tier": self.name, "hash": self.expected, "status": status, "last_phase": phase, "cache_version": self.config.cache_version, "environment": environment(), "updated_utc": datetime.now(timezone.utc).isoformat()}
        storage.write_text(self._spark, f"{self.uri}/manifest.json", json.dumps(body, indent=1, sort_keys=True))

    def mark_building(self, phase: str) -> None:
        self.started = True
        self._write("building", phase)

    def mark_complete(self, phase: str) -> bool:
        """Only a tier that this run marked as building becomes complete."""
        if self.started:
            self._write("complete", phase)
        return self.started

    def current(self) -> bool:
        """Whether the manifest is of this hash, cache version and major package versions."""
        found = self.manifest()
        if not found or found["hash"] != self.expected or found["cache_version"] != self.config.cache_version:
            return False
        major = lambda versions: {k: v.split(".")[0] for k, v in versions.items()}
        return major(found["environment"]) == major(environment())

    def has(self, name: str) -> bool:
        """Whether a table has been written whole."""
        return storage.exists(self._spark, f"{self.uri}/{name}/_SUCCESS")

    def valid(self, needed: tuple[str, ...] = ()) -> bool:
        """Current and complete; or building with all needed tables whole."""
        if not self.current():
            return False
        return self.manifest()["status"] == "complete" or bool(needed) and all(map(self.has, needed))

    def prepare(self, phase: str, *, force: bool = False) -> None:
        """Starts the tier: what an earlier run left whole stays, unless it is of other versions or ``force``."""
        if force or not self.current():
            storage.delete(self._spark, self.uri)
        self.mark_building(phase)

    def save(self, name: str, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(f"{self.uri}/{name}")

    def load(self, spark: SparkSession, name: str) -> DataFrame | None:
        """A table, or None; one that can't be read is set aside as ``.bad``."""
        if not self.has(name):
            return None
        try:
            found = spark.read.parquet(f"{self.uri}/{name}")
            found.limit(1).count()
            return found
        except Exception:  # any reader's failure: the table is made anew
            storage.rename(spark, f"{self.uri}/{name}", f"{self.uri}/{name}.bad")
            return None

    def kept(self, spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """The table of an earlier run, or ``make()`` written now."""
        found = self.load(spark, name)
        if found is None:
            self.save(name, make())
            found = spark.read.parquet(f"{self.uri}/{name}")
        return found


def valid_tiers(tiers: dict[str, Tier], *, force: bool = False, needed: dict[str, tuple[str, ...]] | None = None) -> dict[str, bool]:
    """Validity in order; a tier behind an invalid one is invalid."""
    out, good = {}, not force
    for name in ORDER:
        good = good and tiers[name].valid((needed or {}).get(name, ()))
        out[name] = good
    return out


def status_lines(folder: str | Path, current: dict[str, str]) -> list[str]:
    """A line for each tier, and one for each folder of another hash."""
    lines = []
    for name in ORDER:
        tier = Tier(folder, name, current[name])
        lines.append(f"{name} {current[name]}: {(tier.manifest() or {}).get('status', 'missing')}")
        lines += [f"{name} {other}: stale" for other in storage.listed(SparkSession.active(), f"{folder}/{name}") if other != current[name]]
    return lines
