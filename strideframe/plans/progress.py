"""Progress of phases and the time that is left."""

from __future__ import annotations

import json
import time
from collections import defaultdict
from collections.abc import Callable
from pathlib import Path

from strideframe.config import hms

#: The phases in their order.
PHASES = ("geometry", "import", "amenities", "networks", "reachability", "grids", "publish")


class Progress:
    def __init__(self, history: dict[str, float] | None = None, clock: Callable[[], float] = time.monotonic, expected: tuple[str, ...] = PHASES):
        self.history, self.clock, self.expected = history or {}, clock, expected
        self.seconds: dict[str, float] = {}
        self.parts: dict[tuple[str, str], float] = defaultdict(float)
        self.phase, self.began, self.done, self.total = None, 0.0, 0, 0

    def start(self, phase: str) -> None:
        self.finish()
        self.phase, self.began, self.done, self.total = phase, self.clock(), 0, 0

    def finish(self) -> None:
        if self.phase:
            self.seconds[self.phase] = self.clock() - self.began
        self.phase = None

    def update(self, done: int, total: int) -> None:
        self.done, self.total = done, total

    def part(self, name: str, seconds: float) -> None:
        self.parts[self.phase or "", name] += max(0.0, seconds)

    def _left_here(self) -> float | None:
        """This phase by its own rate after 10 s or a twentieth, else by its history: the part that isn't done, or, without a count of units, what is left of it."""
        if not self.phase:
            return 0.0
        spent, usual = self.clock() - self.began, self.history.get(self.phase)
        if not self.total:
            return None if usual is None else max(0.0, usual - spent)
        share = min(1.0, self.done / self.total)
        if share and (spent >= 10 or share >= 0.05):
            return spent / share - spent
        return 0.0 if share == 1 else None if usual is None else usual * (1 - share)

    def left(self) -> float | None:
        """Seconds that are left of this phase and, by history, of the expected ones behind it; None where one of them is unknown."""
        later = PHASES[PHASES.index(self.phase) + 1 :] if self.phase else [p for p in PHASES if p not in self.seconds]
        parts = [self._left_here(), *(self.history.get(p) for p in later if p in self.expected)]
        return None if None in parts else sum(parts)

    def line(self) -> str:
        left = self.left()
        return f"{self.phase}: {self.done}/{self.total}, {'unknown' if left is None else hms(left)} left"

    def timings(self) -> str:
        self.finish()
        return json.dumps({"seconds": self.seconds, "parts": {f"{a}/{b}": s for (a, b), s in self.parts.items()}})

    def save(self, path: str | Path) -> None:
        Path(path).write_text(self.timings())


def history_of(timings: str | None) -> dict[str, float]:
    """Seconds by phase from an earlier run's timings; nothing for missing or broken ones, negative or unknown entries."""
    try:
        found = json.loads(timings or "")["seconds"]
        return {k: float(v) for k, v in found.items() if k in PHASES and isinstance(v, (int, float)) and v >= 0}
    except (ValueError, KeyError, TypeError, AttributeError):
        return {}


def load_history(path: str | Path) -> dict[str, float]:
    try:
        return history_of(Path(path).read_text())
    except OSError:
        return {}
