"""Secret scans with multipart credential linking.

Strong spans come from three patterns.  Multipart linking then looks at weaker
candidates: identifiers (client or account ids, user names), endpoints (URLs,
hosts, mail addresses) and secrets (long mixed tokens, short assignments, hex
runs below the strong length).  Each part's interval, widened by ``scope`` code
points on both sides, is joined with the intervals of the complementary kinds
in the same text; a weak secret is reported only if an identifier (weak or an
access id) and an endpoint meet it, a weak identifier only if a secret (strong
or weak) and an endpoint do.  The join is a sweep over sorted intervals that
asks for existence, so no pair is ever listed and a text of many parts costs
n log n.  All positions are code points, ends exclusive.

Defined results: a null or empty text has no span; a very long text is scanned
whole, in time that grows with its length; overlapping spans of different kinds
all stay; rows that repeat an id are scanned each on its own; an empty table
gives an empty result; other columns pass through.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released, small_batches, split_batch, with_fields

#: The kinds in their order, and the patterns of the strong spans.
KINDS = ("assign", "access", "hex", "secret_part", "id_part")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
#: Any text with an assignment has one of these, in lower case.
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

WEAK_ID = re.compile(r"""(client_?id|account_?id|key_?id|user(?:name)?|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{3,})""", re.ASCII | re.IGNORECASE)
#: Kinds of endpoints, each without overlaps.  Every pattern starts at the start of a run of its characters only and never gives any back, so a scan's time grows with the text.
ENDPOINTS = (
    re.compile(r"https?://[^\s\"'<>]++", re.ASCII | re.IGNORECASE),
    re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", re.ASCII),
    re.compile(r"(?<![A-Za-z0-9])(?:host|server|endpoint)[\"']?\x20*+[:=]\x20*+[\"']?[A-Za-z0-9.-]++", re.ASCII | re.IGNORECASE),
)
#: What a text with an endpoint of each kind holds, in lower case.
ENDPOINT_MARKS = (("://",), ("@",), ("host", "server", "endpoint"))
#: Runs of a token's characters; a weak token has a digit, a small and a capital letter among them.
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+", re.ASCII)
CLASSES = tuple(re.compile(x, re.ASCII) for x in ("[0-9]", "[a-z]", "[A-Z]"))

SPANS = "array<struct<kind:string,start:long,end:long>>"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the strong spans."""
    found = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return found


class _Intervals:
    """Sorted intervals that answer whether one meets a range."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts = sorted(s for s, _ in spans)
        self.ends = sorted(e for _, e in spans)

    def meets(self, start: int, end: int) -> bool:
        """Those that begin before ``end``, less those that ended at or before ``start``."""
        return bisect_left(self.starts, end) > bisect_right(self.ends, start)


def linked_spans(text: str, base: list[tuple[int, int, int]], scope: int) -> list[tuple[int, int, int]]:
    """Weak parts whose complementary parts lie within ``scope`` code points."""
    low = text.lower()
    ends = [m.span() for kind, marks in zip(ENDPOINTS, ENDPOINT_MARKS, strict=True) if any(x in low for x in marks) for m in kind.finditer(text)]
    if not ends:
        return []
    weak_ids = [m.span() for m in WEAK_ID.finditer(text)]
    ids = weak_ids + [(s, e) for s, k, e in base if k == 1]
    if not ids:
        return []
    taken = _Intervals([(s, e) for s, _, e in base] + ends)
    weak = [m.span() for m in TOKEN.finditer(text) if all(c.search(m[0]) for c in CLASSES)]
    if any(w in low for w in ASSIGN_WORDS):
        weak += [m.span() for m in ASSIGN.finditer(text) if len(m[2]) < 8]
    weak = [x for x in weak if not taken.meets(*x)]
    secrets = weak + [(s, e) for s, k, e in base if k != 1]
    by_id, by_end, by_secret = _Intervals(ids), _Intervals(ends), _Intervals(secrets)
    near = lambda found, s, e: found.meets(s - scope, e + scope)
    return [(s, 3, e) for s, e in weak if near(by_id, s, e) and near(by_end, s, e)] + [(s, 4, e) for s, e in weak_ids if near(by_secret, s, e) and near(by_end, s, e)]


def scan_text(text: str | None, scope: int = 400) -> list[tuple[int, int, int]]:
    """All spans of a text as (start, kind's number, end), by start, then kind."""
    if not text:
        return []
    base = base_spans(text)
    return sorted(base + linked_spans(text, base, scope))


def scan_secrets(docs: DataFrame, *, text_col: str = "text", out_col: str = "secret_spans", scope: int = 400) -> DataFrame:
    """``docs`` with the spans of each whole text, by start, then kind, in ``out_col``, which takes the place of a column of that name."""
    small_batches(docs.sparkSession)
    docs = docs.drop(out_col)
    where = docs.columns.index(text_col)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in split_batch(batch):
                spans = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in scan_text(x, scope)] for x in part.column(where).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(spans, kind)], names=[*(f"c{i}" for i in range(part.num_columns)), "spans"])

    return docs.mapInArrow(released(run), with_fields(docs, f"`{out_col}` {SPANS}"))


def cut_spans(text: str | None, spans: list[tuple[int, int, int]], mask: str = "[SECRET]") -> str | None:
    """The text with each union of overlapping spans replaced by ``mask``."""
    if not text or not spans:
        return text
    merged: list[list[int]] = []
    for s, _, e in spans:
        if merged and s <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    parts = [text[: merged[0][0]]] + [text[a[1] : b[0]] for a, b in pairwise(merged)] + [text[merged[-1][1] :]]
    return mask.join(parts)


def mask_secrets(docs: DataFrame, *, text_col: str = "text", mask: str = "[SECRET]", scope: int = 400) -> DataFrame:
    """``docs`` with all spans of the text column masked; other columns stay."""
    small_batches(docs.sparkSession)
    where = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in split_batch(batch):
                texts = [cut_spans(x, scan_text(x, scope), mask) for x in part.column(where).to_pylist()]
                columns = list(part.columns)
                columns[where] = pa.array(texts, columns[where].type)
                yield pa.RecordBatch.from_arrays(columns, names=[f"c{i}" for i in range(part.num_columns)])

    return docs.mapInArrow(released(run), docs.schema)


def span_text(spans: str | F.Column, kinds: tuple[str, ...] | None = None) -> F.Column:
    """``kind:start:end`` of the spans, comma-joined; ``kinds`` keeps only these."""
    spans = F.col(spans) if isinstance(spans, str) else spans
    kept = F.filter(spans, lambda s: s["kind"].isin(*kinds)) if kinds else spans
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
