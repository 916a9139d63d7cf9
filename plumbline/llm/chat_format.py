"""Chat formatting by columnar byte assembly.

A conversation becomes one string. Each turn is a header ``### Role: `` (the role escaped), the escaped text and the
end mark `` </turn>`` with a line feed. Inside texts and roles a backslash goes before every backslash and before each
control string, and roles also have their colon and line feed escaped; so marks are unmistakable and reading back is
exact. Assistant texts are under the loss mask, given as byte ranges of the formatted string.

Rows of a conversation are ordered by turn, then role and text, nulls first. A null role or text counts as empty; rows
with a null conv_id form one conversation, as rows with any other id. Repeated rows are repeated turns. An empty table
gives an empty result; other columns are left out.

The shuffle brings a conversation's rows together and Spark sorts them (spilling to disk); a task then streams over
them and holds one batch and one unfinished conversation at a time. A formatted conversation is one value of the
result, so it has to fit in a task, like any value.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.shared import columns

HEADER, HEADER_END = b"### ", b": "
TURN_END = b" </turn>\n"
LOSS_ROLE = b"assistant"
#: Bytes that a task assembles at once, about.
BLOCK_BYTES = 4 << 20

_OUT = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("n_turns", pa.int64()),
        ("formatted", pa.string()),
        ("loss_starts", pa.list_(pa.int64())),
        ("loss_ends", pa.list_(pa.int64())),
    ]
)
OUT_TYPE = "conv_id long, n_turns long, formatted string, loss_starts array<long>, loss_ends array<long>"


def escape_texts(texts: pa.Array) -> pa.Array:
    for mark in ("\\", "###", "</turn>"):
        texts = pc.replace_substring(texts, mark, "\\" + mark)
    return texts


def escape_roles(roles: pa.Array) -> pa.Array:
    roles = escape_texts(roles)
    for mark in (":", "\n"):
        roles = pc.replace_substring(roles, mark, "\\" + mark)
    return roles


def unescape(text: bytes) -> bytes:
    """Drops each backslash that stands before another byte, which it protects."""
    if b"\\" not in text:
        return text
    parts = text.split(b"\\")
    out, i = [parts[0]], 1
    while i < len(parts):
        if parts[i] == b"" and i + 1 < len(parts):  # a protected backslash
            out += [b"\\", parts[i + 1]]
            i += 2
        else:
            out.append(parts[i])
            i += 1
    return b"".join(out)


def _raw(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (64 bit) of a large_binary array without nulls."""
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    data = array.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def scatter(out: np.ndarray, to: np.ndarray, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> None:
    """Copies data[start[i] : start[i] + length[i]] to out[to[i] :] for all i at once."""
    total = int(length.sum())
    if total:
        within = np.arange(total) - np.repeat(np.cumsum(length) - length, length)
        out[np.repeat(to, length) + within] = data[np.repeat(start, length) + within]


def assemble(table: pa.Table) -> pa.RecordBatch:
    """Formats whole conversations: rows (conv_id, role, text) in order.

    Segments of a turn: header, role, header end, text, turn end. Their lengths give the offsets of all turns by one
    cumulative sum; constant and variable segments are then scattered into one buffer.
    """
    table = table.combine_chunks()
    conv = table.column("conv_id").combine_chunks()
    raw_roles = pc.fill_null(table.column("role").combine_chunks(), "")
    texts = pc.fill_null(table.column("text").combine_chunks(), "")
    role_data, role_at = _raw(escape_roles(raw_roles).cast(pa.large_binary()))
    text_data, text_at = _raw(escape_texts(texts).cast(pa.large_binary()))
    role_len, text_len = np.diff(role_at), np.diff(text_at)
    n = len(conv)
    lengths = np.stack(
        [np.full(n, len(HEADER)), role_len, np.full(n, len(HEADER_END)), text_len, np.full(n, len(TURN_END))], axis=1
    )
    ends = np.cumsum(lengths.ravel())
    starts = (ends - lengths.ravel()).reshape(n, 5)
    out = np.empty(int(ends[-1]) if n else 0, np.uint8)
    for at, constant in ((0, HEADER), (2, HEADER_END), (4, TURN_END)):
        out[starts[:, at, None] + np.arange(len(constant))] = np.frombuffer(constant, np.uint8)
    scatter(out, starts[:, 1], role_data, role_at[:-1], role_len)
    scatter(out, starts[:, 3], text_data, text_at[:-1], text_len)

    first = conversation_starts(conv)
    sizes = np.diff(np.append(first, n))
    row_end = np.append(starts[:, 0], len(out))
    conv_at = np.append(row_end[first], len(out)).astype(np.int64)
    formatted = pa.Array.from_buffers(
        pa.large_utf8(), len(first), [None, pa.py_buffer(conv_at), pa.py_buffer(out)]
    ).cast(pa.string())
    loss = np.asarray(pc.equal(raw_roles.cast(pa.large_binary()), LOSS_ROLE))
    base = np.repeat(conv_at[:-1], sizes)
    loss_count = np.add.reduceat(loss.astype(np.int32), first)
    loss_at = pa.array(np.append(0, np.cumsum(loss_count)).astype(np.int32))
    loss_start, loss_end = (starts[:, 3] - base)[loss], (starts[:, 3] + text_len - base)[loss]
    return pa.RecordBatch.from_arrays(
        [
            conv.take(pa.array(first)),
            pa.array(sizes.astype(np.int64)),
            formatted,
            pa.ListArray.from_arrays(loss_at, pa.array(loss_start.astype(np.int64))),
            pa.ListArray.from_arrays(loss_at, pa.array(loss_end.astype(np.int64))),
        ],
        schema=_OUT,
    )


def conversation_starts(conv: pa.Array) -> np.ndarray:
    ids = pc.fill_null(conv, 0).to_numpy(zero_copy_only=False)
    null = conv.is_null().to_numpy(zero_copy_only=False)
    return np.flatnonzero(np.append(True, (ids[1:] != ids[:-1]) | (null[1:] != null[:-1])))


def format_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, the formatted string and the byte ranges under the loss mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                held.append(part)
                size += part.nbytes
                if size >= BLOCK_BYTES:
                    table = pa.Table.from_batches(held).combine_chunks()
                    last = int(conversation_starts(table.column("conv_id").combine_chunks())[-1])
                    if last:
                        yield assemble(table.slice(0, last))
                        held = table.slice(last).combine_chunks().to_batches()
                        size = sum(b.nbytes for b in held)
        if held and sum(b.num_rows for b in held):
            yield assemble(pa.Table.from_batches(held))

    rows = columns(conversations, conv_id="long", turn="long", role="string", text="string")
    return (
        rows.repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
        .select("conv_id", "role", "text")
        .mapInArrow(run, OUT_TYPE)
    )


def parse(formatted: bytes) -> list[tuple[bytes, bytes]]:
    """(role, text) of each turn, read from the formatted string alone."""
    turns, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(HEADER, at):
            raise ValueError(f"no header at byte {at}")
        colon = _unescaped(formatted, b":", at + len(HEADER))
        begin = colon + len(HEADER_END)
        end = _unescaped(formatted, b"</turn>", begin) - 1
        turns.append((unescape(formatted[at + len(HEADER) : colon]), unescape(formatted[begin:end])))
        at = end + len(TURN_END)
    return turns


def _unescaped(data: bytes, mark: bytes, at: int) -> int:
    while True:
        at = data.index(mark, at)
        before = at
        while before and data[before - 1 : before] == b"\\":
            before -= 1
        if (at - before) % 2 == 0:
            return at
        at += 1


def read_back(formatted: DataFrame) -> DataFrame:
    """What the formatted strings hold: turns by parsing, loss text by the mask's byte ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                data = r["formatted"].encode()
                turns = parse(data)
                turn_hash, loss_hash, loss_chars = hashlib.sha256(), hashlib.sha256(), 0
                for role, text in turns:
                    turn_hash.update(role + b"\n" + text + b"\n")
                for start, end in zip(r["loss_starts"], r["loss_ends"], strict=True):
                    text = unescape(data[start:end])
                    loss_hash.update(text)
                    loss_chars += len(text.decode())
                rows.append(
                    {
                        "conv_id": r["conv_id"],
                        "n_turns": len(turns),
                        "turns_sha256": turn_hash.hexdigest(),
                        "loss_chars": loss_chars,
                        "loss_sha256": loss_hash.hexdigest(),
                        "formatted_chars": len(r["formatted"]),
                    }
                )
            yield pa.RecordBatch.from_pylist(rows, schema=_DIGEST)

    return formatted.mapInArrow(
        run,
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
    )


_DIGEST = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("n_turns", pa.int64()),
        ("turns_sha256", pa.string()),
        ("loss_chars", pa.int64()),
        ("loss_sha256", pa.string()),
        ("formatted_chars", pa.int64()),
    ]
)


def with_control_conversation(conversations: DataFrame) -> DataFrame:
    """The rows plus conversation -7, whose texts consist of control strings."""
    text = "\\### Assistant: </turn> ok"
    rows = columns(conversations, conv_id="long", turn="long", role="string", text="string")
    extra = rows.sparkSession.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(text).alias("text"),
    )
    return rows.unionByName(extra)
