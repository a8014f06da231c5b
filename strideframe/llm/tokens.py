"""Exact, memoised token ids from a file of the ``tokenizers`` library.

For the layout "NFC, white space to one blank, lower case; split into letter
runs, single digits and other runs; byte level" a text's ids are those of its
blank-separated units in order, as no pre-token and no merge crosses white
space.  A batch's distinct units are encoded once: a unit made of printable
ASCII and Latin-1 letters is cut into its words here and each word goes to the
library's BPE model (words repeat, so a bounded cache keeps theirs); any other
unit goes to the whole library.
Files with another layout are encoded text by text.
"""

from __future__ import annotations

import json
import re
import struct
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

#: The word pattern of the layout that is cut into units.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_PLAIN_UNIT = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
_PLAIN_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")


def _byte_characters() -> dict[int, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for characters from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = count(256)
    return {b: b if b in printable else next(rest) for b in range(256)}


def _splits_at_blanks(path: str) -> bool:
    with open(path, encoding="utf-8") as f:
        layout = json.load(f)
    steps = [x["type"] for x in (layout.get("normalizer") or {}).get("normalizers", [])]
    pre = (layout.get("pre_tokenizer") or {}).get("pretokenizers", [])
    return (
        steps == ["NFC", "Replace", "Lowercase"]
        and [x["type"] for x in pre] == ["Split", "ByteLevel"]
        and pre[0]["pattern"] == {"Regex": WORD_PATTERN}
        and pre[0]["invert"]
        and not pre[1]["add_prefix_space"]
        and layout["model"]["type"] == "BPE"
        and not layout["model"]["dropout"]
        and not any(re.search(r"\s", x["content"]) or x["lstrip"] or x["rstrip"] or "<|" not in x["content"] for x in layout["added_tokens"])
    )


class _Words(dict):
    """Words' ids, a bounded cache: it starts anew when full.  Nothing here refers to the encoder, so that both go when that does."""

    def __init__(self, model, most: int):
        self.model, self.characters, self.most = model, _byte_characters(), most

    def __missing__(self, key: str) -> bytes:
        ids = [t.id for t in self.model.tokenize(key if key.isascii() else key.encode().decode("latin-1").translate(self.characters))]
        value = struct.pack(f"<{len(ids)}I", *ids)
        if len(self) >= self.most:
            self.clear()
        if len(key) <= 64:
            self[key] = value
        return value


class Encoder:
    """Ids of whole texts, as little-endian unsigned 32-bit integers; None counts as an empty text.  ``keep`` words and ``unit_bytes`` of units and their ids are cached."""

    def __init__(self, path: str, keep: int = 150_000, unit_bytes: int = 24 << 20):
        self.tokenizer = Tokenizer.from_file(path)
        self.vocab_size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.by_units = _splits_at_blanks(path)
        self.words = _Words(self.tokenizer.model, keep)
        self.unit_bytes = unit_bytes
        self._forget()

    def _forget(self) -> None:
        self.units, self.unit_ids, self.unit_ends = pa.array([], pa.large_string()), np.zeros(0, "<u4"), np.zeros(1, np.int64)

    def _whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _unit(self, unit: str) -> bytes:
        low = unit.lower()
        if low.isalpha() and low.isascii():
            return self.words[low]
        if low[-1:] in (".", ",") and low[:-1].isalpha() and low.isascii():
            return self.words[low[:-1]] + self.words[low[-1]]
        if not unit:
            return b""
        if "<|" in unit or not _PLAIN_UNIT.fullmatch(unit):
            return self._whole(unit)
        return b"".join(map(self.words.__getitem__, _PLAIN_WORDS.findall(low)))

    def _find(self, units: pa.Array) -> np.ndarray:
        """The places of distinct units in the cache, which takes up the new ones."""
        found = pc.index_in(units, value_set=self.units)
        if not found.null_count:
            return found.to_numpy()
        new = units.filter(found.is_null())
        made = [self._unit(x) for x in new.to_numpy(zero_copy_only=False).tolist()]  # a third of the time of to_pylist
        places = found.fill_null(0).to_numpy(zero_copy_only=False).copy()
        places[found.is_null().to_numpy(zero_copy_only=False)] = len(self.units) + np.arange(len(new))
        self.units = pa.concat_arrays([self.units, new])
        self.unit_ids = np.concatenate([self.unit_ids, np.frombuffer(b"".join(made), "<u4")])
        self.unit_ends = np.concatenate([self.unit_ends, self.unit_ends[-1] + np.cumsum(np.fromiter(map(len, made), np.int64, len(made)) >> 2)])
        return places

    def _bound(self, units: pa.Array, places: np.ndarray) -> None:
        """A full cache goes on with the units of the last batch, or anew if they alone fill half of it."""
        held = lambda: self.units.nbytes + self.unit_ids.nbytes + self.unit_ends.nbytes
        if held() > self.unit_bytes:
            first, size = self.unit_ends[places], np.diff(self.unit_ends)[places]
            ends = np.concatenate([[0], np.cumsum(size)])
            self.units, self.unit_ids, self.unit_ends = units, self.unit_ids[np.repeat(first - ends[:-1], size) + np.arange(ends[-1])], ends
            if held() > self.unit_bytes // 2:
                self._forget()

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts one after another, and where each text's begin (one more than texts)."""
        texts = texts.cast(pa.large_string()).fill_null("")
        if not self.by_units:
            made = [self._whole(x) for x in texts.to_pylist()]
            return np.frombuffer(b"".join(made), "<u4"), np.cumsum([0, *(len(x) >> 2 for x in made)])
        split = pc.ascii_split_whitespace(texts)
        ends = split.offsets.to_numpy()
        kinds = split.values.slice(ends[0], ends[-1] - ends[0]).dictionary_encode()
        places = self._find(kinds.dictionary)
        flat = places[kinds.indices.to_numpy()]
        first = self.unit_ends[flat]
        each = self.unit_ends[flat + 1] - first
        at = np.zeros(len(flat) + 1, np.int64)
        np.cumsum(each, out=at[1:])
        first -= at[:-1]
        kind = np.int32 if max(at[-1], len(self.unit_ids)) < 1 << 31 else np.int64  # half the memory of the longest arrays here
        place = np.repeat(first.astype(kind), each)
        place += np.arange(at[-1], dtype=kind)
        ids = self.unit_ids[place]
        self._bound(kinds.dictionary, places)
        return ids, at[ends - ends[0]]

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_all(pa.array([text], pa.large_string()))[0]
