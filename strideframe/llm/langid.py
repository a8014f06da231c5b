"""Language identification by language-bitmask n-gram filters.

Training counts character n-grams of each language (runs of letters, with a
blank at word borders) and keeps for each language those that are typical of
it: frequent, and not far rarer there than in the language that has them most.
The filter is a bit-sliced Bloom filter: one bitmask of languages at each
position; an n-gram sets its language's bit at ``hashes`` positions.  A lookup
is the AND of the masks at an n-gram's positions: all languages that contain it,
at once.

Prediction counts, for each language, the n-grams of the whole text whose mask
has its bit, and corrects the count for the share of foreign n-grams that the
filter lets pass (its bit slice's fill to the power ``hashes``).  The language
with the highest corrected share wins; that share is the score.

The model is fitted on a bounded sample of rows: about ``sample`` training
documents a language (an id's hash decides), their whole texts.  All typical
n-grams of these are kept and the filter has as many positions as they need, so
what is collected and broadcast is bounded by the sample.  Prediction reads
whole texts.

``is_rejected`` is the decision of a filtering stage: a text is rejected if it
has no letter, or if even the upper end of the interval around its share (Wilson's,
which widens as n-grams get fewer) lies below ``floor``.  The rule is the same
for texts of every length.

Defined results: a text that is null or has no letter is ``und`` with score 0;
rows without a language or text teach nothing; with no training row at all
every text is ``und``; ties go to the language that sorts first; rows that
repeat an id are predicted each on its own; a very long text is read whole;
more than ``most_languages`` different languages are an error, as a filter of
them would no longer be small; other columns pass through.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import released, small_batches, split_batch, with_fields

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


@cache
def _letters() -> np.ndarray:
    """Which characters are letters, by code point."""
    return np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), bool, 0x110000)


class Grams:
    """Hashes of a text's character n-grams: lower case, other characters than letters as one blank, n-grams of letters with a blank at most at the borders."""

    def __init__(self, n: int):
        self.n, self.letters = n, _letters()

    def of(self, text: str | None) -> np.ndarray:
        codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4")
        codes = np.concatenate(([0], np.where(self.letters[codes], codes, 0), [0])).astype(np.uint64)
        blank = codes == 0
        if blank.all():
            return np.empty(0, np.uint64)
        kept = ~(blank & np.concatenate(([False], blank[:-1])))
        codes, blank = codes[kept], blank[kept]
        total = np.zeros(max(0, len(codes) - self.n + 1), np.uint64)
        inner = np.zeros(len(total), np.int64)
        for k in range(self.n):
            total = (total + codes[k : k + len(total)] + np.uint64(1)) * _ODD
            if 0 < k < self.n - 1:
                inner += blank[k : k + len(total)]
        total ^= total >> np.uint64(32)
        found = total[inner == 0]
        if not len(found):  # words shorter than an n-gram: the whole text counts as one
            found = np.array([int(((codes + np.uint64(1)) * _ODD ** np.arange(1, len(codes) + 1, dtype=np.uint64)).sum()) & (2**64 - 1)], np.uint64)
        return found


@dataclass
class LanguageFilter:
    """languages: in order; masks: positions x words of 64 bits; hashes: positions of an n-gram; passes: each language's false positive rate."""

    languages: list[str]
    masks: np.ndarray
    hashes: int
    passes: np.ndarray

    @classmethod
    def build(cls, grams: dict[str, np.ndarray], hashes: int, room: int = 8) -> LanguageFilter:
        """At least ``room`` positions for each n-gram of the language with the most, a power of two."""
        languages = sorted(grams)
        bits = max(10, (room * max(map(len, grams.values()), default=1) - 1).bit_length())
        masks = np.zeros((1 << bits, max(1, -(-len(languages) // 64))), np.uint64)
        for i, name in enumerate(languages):
            for at in cls.positions(grams[name], hashes, bits):
                masks[at, i // 64] |= np.uint64(1) << np.uint64(i % 64)
        fill = np.array([((masks[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(languages))])
        return cls(languages, masks, hashes, fill**hashes)

    @staticmethod
    def positions(grams: np.ndarray, hashes: int, bits: int) -> list[np.ndarray]:
        out = []
        for k in range(hashes):
            x = (grams + np.uint64((k * 0xD1342543DE82EF95) & (2**64 - 1))) * _MIX
            out.append(((x ^ (x >> np.uint64(31))) * _ODD >> np.uint64(64 - bits)).astype(np.int64))
        return out

    def shares(self, grams: np.ndarray) -> np.ndarray:
        """For each language the corrected share of n-grams that it contains, from 0 to 1."""
        bits = len(self.masks).bit_length() - 1
        found = None
        for at in self.positions(grams, self.hashes, bits):
            found = self.masks[at] if found is None else found & self.masks[at]
        hits = np.array([int(((found[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).sum()) for i in range(len(self.languages))])
        return np.clip((hits / len(grams) - self.passes) / (1 - np.minimum(self.passes, 0.999)), 0, 1)

    def predict(self, grams: np.ndarray) -> tuple[str, float]:
        if not len(grams) or not self.languages:
            return "und", 0.0
        shares = self.shares(grams)
        best = int(np.argmax(shares))
        return self.languages[best], float(shares[best])


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", n: int = 4, sample: int = 2000, grams: int | None = None, least: int = 1, typical: float = 0.2, hashes: int = 3, most_languages: int = 2048) -> LanguageFilter:
    """A filter from labelled rows.  ``sample`` bounds the rows that are read of a language; ``grams`` (None: all) what is kept of it, the most frequent; ``least``: in how many documents of a language an n-gram must occur (2 keeps a single mislabelled document from teaching)."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text is not null and lang is not null")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().limit(most_languages + 1).collect()}
    if len(sizes) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    if not sizes:
        return LanguageFilter([], np.zeros((1, 1), np.uint64), hashes, np.zeros(0))
    share = F.element_at(F.create_map(*(x for k, v in sizes.items() for x in (F.lit(k), F.lit(min(1.0, sample / v))))), F.col("lang"))
    taken = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < share * (1 << 20)).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Grams(n)
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, arrays in held.items():
                keys, at = np.unique(np.concatenate([k for k, _ in arrays]), return_inverse=True)
                times = np.bincount(at, weights=np.concatenate([c for _, c in arrays]), minlength=len(keys)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array(keys.view(np.int64)), pa.array(times), pa.array(np.bincount(at, minlength=len(keys)))], names=["lang", "gram", "n", "docs"])
            held.clear()

        size = 0
        for batch in batches:
            for part in split_batch(batch):
                for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    found = np.unique(made.of(text), return_counts=True)
                    held.setdefault(lang, []).append(found)
                    size += len(found[0])
                if size > 2_000_000:
                    yield from out()
                    size = 0
        yield from out()

    counts = taken.mapInArrow(released(count), "lang string, gram long, n long, docs long").groupBy("lang", "gram").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    total = counts.withColumn("rate", F.col("n") / F.sum("n").over(Window.partitionBy("lang")))
    kept = total.withColumn("most", F.max("rate").over(Window.partitionBy("gram"))).where((F.col("docs") >= least) & (F.col("rate") >= typical * F.col("most")))
    if grams is not None:
        kept = kept.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("rate"), F.asc("gram")))).where(F.col("k") <= grams)
    found = kept.groupBy("lang").agg(F.collect_list("gram").alias("grams")).collect()  # at most the n-grams of the sample
    return LanguageFilter.build({r["lang"]: np.array(r["grams"], np.int64).view(np.uint64) for r in found}, hashes)


PREDICTED = "lang_pred string, score double, n_grams long"


def identify(docs: DataFrame, model: LanguageFilter, *, n: int = 4, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``n_grams`` (how many the score rests on) of each whole text; they take the place of columns of these names."""
    small_batches(docs.sparkSession)
    docs = docs.drop("lang_pred", "score", "n_grams")
    sent = docs.sparkSession.sparkContext.broadcast(model)
    where = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, filter_ = Grams(n), sent.value
        for batch in batches:
            for part in split_batch(batch):
                grams = [made.of(x) for x in part.column(where).to_pylist()]
                found = [filter_.predict(x) for x in grams]
                columns = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), pa.array(list(map(len, grams)), pa.int64())]
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], names=[*(f"c{i}" for i in range(part.num_columns)), "lang_pred", "score", "n_grams"])

    return docs.mapInArrow(released(run), with_fields(docs, PREDICTED))


def is_rejected(floor: float, z: float = 3.0) -> F.Column:
    """Whether a row of ``identify`` is in none of the languages: without a letter, or with a share that is below ``floor`` by more than chance explains."""
    share, n = F.col("score"), F.col("n_grams")
    upper = (share + z * z / (2 * n) + z * F.sqrt(share * (1 - share) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    return (F.col("lang_pred") == "und") | (upper < floor)


def held_out(id_col: str = "doc_id") -> F.Column:
    """crc32 of the id as text leaves remainder 2 by 4; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2
