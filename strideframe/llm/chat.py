"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all preceding turns of the
conversation as context, and only that reply trainable (``loss_start`` to
``loss_end``, code points).  A conversation whose last turns aren't the
assistant's gets one more example without a trainable part, so that the output
holds every turn.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n``.  Control strings inside a
role or a text are escaped reversibly: a backslash becomes two, ``<|`` becomes
``<\\|``, and a line break in a role becomes ``\\n``, so that no text can open or
close a turn and no role can end early.

Conversations are dealt out by id and sorted by turn within tasks; a task
streams over its rows and holds one conversation's prefix, which its examples
hold anyway.

Defined results: a null text is empty; a null role is the empty role; turns
that repeat a number are ordered by role, then text; a null conversation id is
a conversation; very long texts stay whole, in batches of one row; an empty table gives no example; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: The template's control strings.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"

EXAMPLES = "conv_id long, example int, n_turns int, text string, loss_start long, loss_end long"
_EXAMPLES = pa.schema([("conv_id", pa.int64()), ("example", pa.int32()), ("n_turns", pa.int32()), ("text", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64())])


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape(text: str) -> str:
    return re.sub(r"\\([\\|n])", lambda m: "\n" if m[1] == "n" else m[1], text)


def format_turn(role: str | None, text: str | None) -> tuple[str, int, int]:
    """A formatted turn, and where its text begins and ends."""
    head, body = f"{OPEN}{escape_role(role or '')}\n", escape(text or "")
    return head + body + CLOSE, len(head), len(head) + len(body)


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) of each turn of a formatted text."""
    out = []
    for part in formatted.split(OPEN)[1:]:
        role, _, body = part.partition("\n")
        out.append((unescape(role), unescape(body[: -len(CLOSE)])))
    return out


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Record batches of about ``most`` characters."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 64 + sum(len(x) for x in row if isinstance(x, str))
        if size >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


def _values(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            yield from zip(*(c.to_pylist() for c in batch.slice(at, 1024).columns), strict=True)


def chat_examples(conversations: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", assistant: str = "assistant") -> DataFrame:
    """The examples (``EXAMPLES``); those of a conversation are neighbours in a task, in order."""
    small_batches(conversations.sparkSession)
    rows = conversations.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def expand(values: Iterator[tuple]) -> Iterator[tuple]:
        no_conversation = object()
        now, prefix, example, turns, open_turns = no_conversation, "", 0, 0, False
        for conv, _, role, text in values:
            if now is no_conversation or conv != now:
                if open_turns:
                    yield now, example, turns, prefix, len(prefix), len(prefix)
                now, prefix, example, turns, open_turns = conv, "", 0, 0, False
            turn, start, end = format_turn(role, text)
            before, prefix, turns = len(prefix), prefix + turn, turns + 1
            open_turns = role != assistant
            if not open_turns:
                yield conv, example, turns, prefix, before + start, before + end
                example += 1
        if open_turns:
            yield now, example, turns, prefix, len(prefix), len(prefix)

    ordered = rows.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(lambda batches: _batches(expand(_values(batches)), _EXAMPLES), EXAMPLES)


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_DIGESTS = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def read_back(examples: DataFrame) -> DataFrame:
    """A row of digests for each conversation, from the examples' texts and loss ranges alone; ``formatted_chars`` is the sum over its examples.  Takes the examples as ``chat_examples`` orders them."""

    def read(values: Iterator[tuple]) -> Iterator[tuple]:
        held = None  # conv, hash of the loss, its length, formatted length, longest text

        def close() -> tuple:
            conv, loss, n, chars, text = held
            turns = parse_turns(text)
            whole = hashlib.sha256()
            for role, body in turns:
                whole.update(f"{role}\n{body}\n".encode())
            return conv, len(turns), whole.hexdigest(), n, loss.hexdigest(), chars

        for conv, example, _, text, start, end in values:
            if held is None or example == 0:
                if held:
                    yield close()
                held = [conv, hashlib.sha256(), 0, 0, ""]
            reply = unescape(text[start:end])
            held[1].update(reply.encode())
            held[2] += len(reply)
            held[3] += len(text)
            held[4] = text
        if held:
            yield close()

    return examples.mapInArrow(lambda batches: _batches(read(_values(batches)), _DIGESTS), DIGESTS)
