"""Best-fit packing of token sequences by minimum bin slack.

Per bin, the longest open length is taken and a bitset subset-sum program over the open lengths finds the fullest
combination that goes with it; that combination is removed. Whatever the corpus, there are at most ``capacity``
different lengths, so the search runs over the histogram of lengths, and a combination is removed as often as its
lengths allow. Spark counts the histogram, numbers the pieces of each length, looks up their places and brings the ids
of each sequence together; only the histogram (``capacity`` rows at most) and the plan reach the driver.

The result is the table of sequences with their ids. What is reported of a piece is read from it.

Only documents longer than the capacity are cut, into pieces of ``capacity`` tokens and a last shorter one.

Nulls and edge cases: a null or empty text is one piece that holds the end id only; a null doc_id stays null; each
repeated row is a document of its own; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.llm.shared import columns, stored
from plumbline.llm.tokens import default_path, encoder, token_blocks

CAPACITY = 2048
END_ID = 0
PLAN_TYPE = [("length", np.int64), ("rank", np.int64), ("times", np.int64), ("sequence", np.int64), ("offset", np.int64)]


def cut(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """The pieces of all documents: doc_id, piece, start, length, the number of the task that cut them, ``within`` (the
    piece's number among those of its length in that task), and ids_crc32, or with ``keep_ids`` their ids instead: in
    two bytes each if all ids of the tokenizer fit, otherwise in four."""
    path = path or default_path()
    kinds = {"doc_id": "long", "piece": "int", "start": "long", "length": "long", "task": "int", "within": "long"}
    kinds |= {"ids": "binary"} if keep_ids else {"ids_crc32": "long"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(path)
        narrow = keep_ids and max(words.library.get_vocab().values(), default=0) < 1 << 16
        task = TaskContext.get().partitionId()
        numbers = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for block in token_blocks(words, batch.column("text"), END_ID):
                # The pieces of all texts lie one behind the other.
                pieces = -(-block.counts // capacity)
                text = np.repeat(np.arange(len(pieces)), pieces)
                piece = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                length = np.minimum(capacity, block.counts[text] - piece * capacity)
                order = np.argsort(length, kind="stable")
                sizes = np.bincount(length, minlength=capacity + 1)
                within = np.empty(len(text), np.int64)
                within[order] = np.arange(len(text)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                within += numbers[length]
                numbers += sizes
                ids = block.ids.astype("<u2" if narrow else "<u4")
                ends = np.append(0, np.cumsum(length * ids.itemsize))
                values = pa.Array.from_buffers(
                    pa.large_binary(), len(text), [None, pa.py_buffer(ends), pa.py_buffer(ids.view(np.uint8))]
                ).cast(pa.binary())
                if not keep_ids:
                    values = pa.array([zlib.crc32(v.as_buffer()) for v in values], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(pa.array(block.first + text)),
                        pa.array(piece.astype(np.int32)),
                        pa.array(piece * capacity),
                        pa.array(length),
                        pa.array(np.full(len(text), task, np.int32)),
                        pa.array(within),
                        values,
                    ],
                    names=list(kinds),
                )

    return columns(docs, doc_id="long", text="string").mapInArrow(run, ", ".join(f"{k} {v}" for k, v in kinds.items()))


def fullest(room: int, lengths: list[int], counts: list[int]) -> list[tuple[int, int]]:
    """The combination of lengths (with how often each) whose sum comes closest to ``room`` from below.

    Bit s of the set says that some combination sums to s. Lengths enter from the longest; the search ends early when
    the room is filled exactly. Each length enters in doublings of its count, so the number of steps is small.
    """
    full, goal = (1 << (room + 1)) - 1, 1 << room
    sums, steps = 1, []
    for length, count in zip(lengths, counts, strict=True):
        left, part = min(count, room // length), 1
        while left:
            part = min(part, left)
            steps.append((length, part, sums))
            sums |= (sums << (length * part)) & full
            if sums & goal:
                left = 0
                break
            left -= part
            part *= 2
        if sums & goal:
            break
    best, taken = sums.bit_length() - 1, {}
    for length, part, before in reversed(steps):
        if not before >> best & 1:
            best -= length * part
            taken[length] = taken.get(length, 0) + part
    return sorted(taken.items(), reverse=True)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Places for all pieces: those of ``length`` numbered ``rank`` … ``rank + times - 1`` go to the sequences from
    ``sequence`` on, one each, at ``offset``. Sorted by length and rank."""
    left = {k: n for k, n in histogram.items() if n}
    order = sorted(left)
    used = dict.fromkeys(left, 0)
    rows, sequence = [], 0
    while order:
        longest = order[-1]
        left[longest] -= 1
        below = order[: bisect_right(order, capacity - longest)][::-1]
        below = [k for k in below if left[k]]
        parts = fullest(capacity - longest, below, [left[k] for k in below]) if below else []
        left[longest] += 1
        need: dict[int, int] = {longest: 1}
        for k, n in parts:
            need[k] = need.get(k, 0) + n
        times = min(left[k] // n for k, n in need.items())
        offset = 0
        for k, n in need.items():
            for _ in range(n):
                rows.append((k, used[k], times, sequence, offset))
                used[k] += times
                offset += k
            left[k] -= n * times
        order = [k for k in order if left[k]]
        sequence += times
    return np.array(sorted(rows), dtype=PLAN_TYPE)


def numbered(pieces: DataFrame) -> DataFrame:
    """Adds ``rank``, the number of a piece among those of its length, from 0, to stored pieces.

    Each task that cut pieces has numbered its own; the counts by length and task, ``capacity`` rows a task at most,
    give where each task starts. They are stored so that Spark knows their size when it plans the join: while they are
    small, no ids are shuffled here.
    """
    sizes = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1))
    starts = stored(sizes.select("length", "task", F.coalesce(before, F.lit(0)).alias("first")), "piece-numbers")
    return (
        pieces.join(starts, ["length", "task"])
        .withColumn("rank", F.col("first") + F.col("within"))
        .drop("task", "first", "within")
    )


def place(ranked: DataFrame, places: np.ndarray) -> DataFrame:
    """Adds sequence_id and offset to numbered pieces. The plan's size is bounded by the capacity, not by the rows."""
    fields = ranked.drop("rank").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # One sorted key for (length, rank): ranks stay far below the factor.
        factor = np.int64(1 << 48)
        keys = places["length"] * factor + places["rank"]
        for batch in batches:
            rank = batch.column("rank").to_numpy()
            at = np.searchsorted(keys, batch.column("length").to_numpy() * factor + rank, side="right") - 1
            found = places[at]
            names = [f.name for f in fields]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(found["sequence"] + rank - found["rank"]),
                 pa.array(np.ascontiguousarray(found["offset"]))],
                names=[*names, "sequence_id", "offset"],
            )

    return ranked.mapInArrow(run, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in fields)}, sequence_id long, offset long")


def pack(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """All pieces with their places: doc_id, piece, start, length, ids_crc32 (or ids), sequence_id, offset."""
    pieces = stored(cut(docs, capacity, path, keep_ids), "pieces")
    # At most one row for each length up to the capacity.
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = plan(histogram, capacity)
    return place(numbered(pieces), places)


def sequences(packed: DataFrame) -> DataFrame:
    """One row for each sequence: its documents, pieces, starts, offsets, lengths and joined ids in four bytes each
    (``pack`` with ``keep_ids``).

    One shuffle brings the ids of a sequence together. Its rows are sorted by offset, so their bytes already lie one
    behind the other; a task holds one batch and one unfinished sequence, which has ``capacity`` tokens at most.
    """
    lists = {"doc_id": "long", "piece": "int", "start": "long", "offset": "long", "length": "long"}

    def joined(rows: pa.RecordBatch, first: np.ndarray) -> pa.RecordBatch:
        at = pa.array(np.append(first, rows.num_rows).astype(np.int32))
        ids = rows.column("ids").cast(pa.large_binary())
        ends = np.frombuffer(ids.buffers()[1], np.int64)[ids.offset : ids.offset + len(ids) + 1]
        cuts = ends[np.append(first, rows.num_rows)] - ends[0]
        data = np.frombuffer(ids.buffers()[2], np.uint8)[ends[0] : ends[-1]]
        if len(data) < 4 * pc.sum(rows.column("length")).as_py():
            data, cuts = data.view("<u2").astype("<u4"), 2 * cuts
        values = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(cuts), pa.py_buffer(data)])
        return pa.RecordBatch.from_arrays(
            [
                rows.column("sequence_id").take(pa.array(first)),
                *(pa.ListArray.from_arrays(at, rows.column(c)) for c in lists),
                values.cast(pa.binary()),
            ],
            names=["sequence_id", *(f"{c}s" for c in lists), "ids"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows:
                rows = pa.Table.from_batches([*held, batch]).combine_chunks().to_batches()[0]
                key = rows.column("sequence_id").to_numpy()
                first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
                last = int(first[-1])
                if last:
                    yield joined(rows.slice(0, last), first[:-1])
                # A copy, so that the batch is not held with it.
                held = [rows.take(pa.array(np.arange(last, rows.num_rows)))]
        if held:
            yield joined(held[0], np.zeros(1, np.int64))

    ordered = (
        packed.select("sequence_id", *lists, "ids")
        .repartition("sequence_id")
        .sortWithinPartitions("sequence_id", "offset")
    )
    kinds = ", ".join(f"{c}s array<{kind}>" for c, kind in lists.items())
    return ordered.mapInArrow(run, f"sequence_id long, {kinds}, ids binary")


def written(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """The sequences of all documents, stored in a new folder ``sequences-…`` in the shared place."""
    return stored(sequences(pack(docs, capacity, path, keep_ids=True)), "sequences", "zstd")


def digest(packed: DataFrame) -> DataFrame:
    """What the bytes of stored sequences hold at the place of each piece."""
    names = ("doc_id", "piece", "start", "offset", "length")
    parts = packed.select(
        "sequence_id", "ids", F.explode(F.arrays_zip(*(F.col(f"{c}s").alias(c) for c in names))).alias("p")
    ).select(
        "sequence_id",
        *(f"p.{c}" for c in names),
        F.expr("substring(ids, cast(4 * p.offset + 1 as int), cast(4 * p.length as int))").alias("ids"),
    )
    return parts.select(
        "doc_id",
        "piece",
        "start",
        F.expr("cast(length(ids) div 4 as bigint)").alias("length"),
        F.crc32("ids").alias("ids_crc32"),
        "sequence_id",
        "offset",
    )


def packed_lengths(places: np.ndarray) -> list[int]:
    """Tokens in each sequence of a plan, for tests and reports."""
    total = int((places["sequence"] + places["times"]).max()) if len(places) else 0
    change = np.zeros(total + 1, np.int64)
    np.add.at(change, places["sequence"], places["length"])
    np.add.at(change, places["sequence"] + places["times"], -places["length"])
    return list(accumulate(change[:-1].tolist()))
