"""Repeated passages by a sampled suffix array, sorted by a common-prefix-aware distributed merge sort.

Every byte covered by a string of ``LENGTH`` (100) bytes that also starts earlier (smaller doc_id, or the same document
further left) is removed; strings never cross documents.

* Suffixes. Of the 69 grams of 32 bytes in a 100-byte window, the one with the smallest hash (leftmost if equal) is the
  window's anchor. Equal windows have equal anchors at equal places, so comparing the suffixes that start at anchors,
  with what stands before them, finds all equal windows; there is one anchor in 35 bytes.
* Filter. An anchor whose gram occurs nowhere else can't be part of a repeat. Chunks of documents send the hashes of
  their grams, each once, and get a bit back for each.
* Runs. The rest are written as records of fixed width: the gram's hash, the suffix up to the end of the anchor's last
  window, and, reversed, what stands before it back to the start of its first window. A task sorts the records of a
  chunk; of equal ones the earliest stands for all and the others are repeats already. The run is front-coded (length of
  the prefix shared with the record before, and the rest) and dealt out by ranges of the hash, which are even without
  any sampling. So the order of the suffix array is that of its first gram's hash, then of the suffix.
* Merge. For each range a loser tree joins the runs. It knows how long a prefix each candidate shares with the last
  winner; the longer one wins without looking at the strings, and only equal lengths are compared, from there on.
* Repeats. Equal records that meet are repeats but for the earliest. Records of the same gram that differ are held
  against each other window by window, as far as the prefixes shared with their neighbours reach.
* A gram that occurs very many times would send all its contexts to one range. Its records are dealt out window by
  window instead, by the hash of the whole window, so a hot phrase spreads out. Occurrences are counted for this, not
  chunks: in a large table common phrases are in all chunks, and window by window each takes 35 times the work.

Texts are shuffled once, into a table bucketed by chunk, which the later steps join without moving it again.

Nulls and edge cases: a null text is empty (no bytes, the digest of nothing). A null doc_id counts as smaller than all
others. Rows with equal doc_id are ordered by their place in the chunks. Texts are taken as UTF-8 bytes, and what is
kept may cut a character; ``kept`` is binary. An empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.shared import columns, scratch
from plumbline.llm.text_bytes import blocks, mixed

LENGTH, GRAM = 100, 32
SPAN = LENGTH - GRAM + 1
#: Text bytes of a chunk (more in large tables, where every chunk sends to more ranges), records sorted at once, and text
#: bytes for each range of hashes and each bucket. They bound memory only.
MOST_CHUNK_BYTES, CHUNKS = 8 << 20, 2_000
CHUNK_BYTES, SLICE, RANGE_BYTES, BUCKET_BYTES = 1 << 20, 50_000, 16 << 20, 64 << 20
#: Window starts that are hashed at once.
STEP = 1 << 19
#: A gram with more records than this is dealt out by windows: a record then stands for one window instead of 35 or so, and
#: a range that takes the records of a gram as they are holds about a kilobyte for each.
HOT_RECORDS = 1 << 16
#: Record: hash, suffix, its length, reversed context before it, its length.
_HASH, _RIGHT, _LEFT = 8, LENGTH, LENGTH - GRAM
WIDTH = _HASH + _RIGHT + 1 + _LEFT + 1
_AT_RL, _AT_LEFT, _AT_LL = _HASH + _RIGHT, _HASH + _RIGHT + 1, WIDTH - 1

_TABLE = mixed(np.arange(1, 257, dtype=np.uint64))
_STEP = 0x9E3779B97F4A7C15
_WORD = (1 << 64) - 1

_CHUNK_TYPE = "chunk long, doc_ids binary, nulls binary, ends binary, data binary"


def gather(docs: DataFrame, chunk_bytes: int) -> DataFrame:
    """Documents in chunks: ids, null flags, ends (bytes) and joined texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        ids: list[int | None] = []
        ends: list[np.ndarray] = []
        parts: list[bytes] = []
        size = 0

        def closed() -> pa.RecordBatch:
            row = {
                "chunk": task << 32 | number,
                "doc_ids": np.array([i or 0 for i in ids], np.int64).tobytes(),
                "nulls": bytes(i is None for i in ids),
                "ends": np.concatenate(ends).astype(np.int64).tobytes(),
                "data": b"".join(parts),
            }
            return pa.RecordBatch.from_pylist([row], schema=_CHUNK)

        for batch in batches:
            keys = batch.column("doc_id").to_pylist()
            for block in blocks(batch.column("text"), chunk_bytes):
                ids += keys[block.first : block.first + block.size]
                ends.append(block.ends + size)
                parts.append(block.data.tobytes())
                size += len(block.data)
                if size >= chunk_bytes:
                    yield closed()
                    number, ids, ends, parts, size = number + 1, [], [], [], 0
        if ids:
            yield closed()

    return columns(docs, doc_id="long", text="string").mapInArrow(run, _CHUNK_TYPE)


_CHUNK = pa.schema(
    [("chunk", pa.int64()), ("doc_ids", pa.binary()), ("nulls", pa.binary()), ("ends", pa.binary()), ("data", pa.binary())]
)


def bucketed(chunks: DataFrame, buckets: int) -> DataFrame:
    """The chunks as a table bucketed by chunk in the shared folder: one file a bucket, joined later without a shuffle."""
    path = scratch(chunks.sparkSession, "chunks")
    name = "plumbline_" + path.rsplit("-", 1)[1]
    (
        chunks.repartition(buckets, "chunk")
        .write.bucketBy(buckets, "chunk")
        .option("path", path)
        .option("compression", "zstd")
        .saveAsTable(name)
    )
    return chunks.sparkSession.table(name)


@dataclass
class Chunk:
    id: int
    doc_ids: np.ndarray
    nulls: np.ndarray
    ends: np.ndarray
    data: np.ndarray

    @classmethod
    def of(cls, row: dict) -> Chunk:
        return cls(
            row["chunk"],
            np.frombuffer(row["doc_ids"], np.int64),
            np.frombuffer(row["nulls"], np.uint8).astype(bool),
            np.frombuffer(row["ends"], np.int64),
            np.frombuffer(row["data"], np.uint8),
        )

    @property
    def starts(self) -> np.ndarray:
        return np.append(0, self.ends[:-1])


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the gram at each byte, by doubling: hashes of 1, 2, 4 … bytes."""
    h, n = _TABLE[data], 1
    while n < GRAM:
        h = h[:-n] * np.uint64(pow(_STEP, n, 1 << 64)) + h[n:]
        n *= 2
    return mixed(h)


def _sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    width = 1
    while 2 * width <= n:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    rest = n - width
    return np.minimum(x[:-rest], x[rest:]) if rest else x


@dataclass
class Anchors:
    """Anchor place, its hash, first and last window start, and document, of each anchor of a chunk."""

    at: np.ndarray
    hash: np.ndarray
    first: np.ndarray
    last: np.ndarray
    doc: np.ndarray


def anchors(chunk: Chunk) -> Anchors:
    """All anchors, window starts taken some at a time. An anchor whose windows are cut there is listed in parts."""
    n = len(chunk.data) - LENGTH + 1
    parts = [_anchors(chunk, s, min(s + STEP, n)) for s in range(0, n, STEP)]
    if not parts:
        none = np.zeros(0, np.int64)
        return Anchors(none, none.astype(np.uint64), none, none, none)
    return Anchors(*(np.concatenate([getattr(p, f) for p in parts]) for f in ("at", "hash", "first", "last", "doc")))


def _anchors(chunk: Chunk, begin: int, end: int) -> Anchors:
    """Anchors of the windows that start in ``begin`` … ``end - 1``."""
    n = end - begin
    g = _gram_hashes(chunk.data[begin : end + LENGTH - 1])
    m = _sliding_min(g, SPAN)  # of the window at each byte; those that cross documents are left out below
    low, high = np.searchsorted(chunk.ends, begin, side="right"), np.searchsorted(chunk.starts, end)
    starts, ends = np.maximum(chunk.starts[low:high], begin), np.minimum(chunk.ends[low:high] - LENGTH + 1, end)
    holds = ends > starts
    starts, ends = starts[holds] - begin, ends[holds] - begin
    change = np.zeros(n + 1, np.int32)
    np.add.at(change, starts, 1)
    np.add.at(change, ends, -1)
    # A window has another anchor than the one before it if the minimum changes or its place has just been left.
    opens = np.ones(n, bool)
    opens[1:] = (m[1:] != m[:-1]) | (g[: n - 1] == m[:-1])
    opens[starts] = True
    first = np.flatnonzero(opens & (np.cumsum(change[:n]) > 0))
    at = np.empty(len(first), np.int64)
    span = np.arange(SPAN)
    for k in range(0, len(first), 1 << 13):
        part = first[k : k + (1 << 13)]
        at[k : k + (1 << 13)] = part + (g[part[:, None] + span] == m[part, None]).argmax(axis=1)
    doc = np.searchsorted(chunk.ends, first + begin, side="right")
    last = np.minimum(np.append(first[1:] - 1, n - 1) + begin, chunk.ends[doc] - LENGTH)
    # Anchors have small hashes; mixed again they are even, as dealing them out by ranges needs.
    return Anchors(at + begin, mixed(g[at]), first + begin, last, doc)


def _ranges(hashes: np.ndarray, ranges: int) -> np.ndarray:
    """The range of each hash, by its leading 32 bits."""
    return ((hashes >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


_HASHES = pa.schema([("range", pa.int64()), ("chunk", pa.int64()), ("hashes", pa.binary()), ("counts", pa.binary())])
_BITS = pa.schema([("chunk", pa.int64()), ("range", pa.int64()), ("seen", pa.binary())])


def gram_hashes(chunks: DataFrame, ranges: int) -> DataFrame:
    """The distinct gram hashes of each chunk, sorted, and how often each occurs there, in one row for each range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                (row,) = batch.slice(i, 1).to_pylist()
                own, count = np.unique(anchors(Chunk.of(row)).hash, return_counts=True)
                count = np.minimum(count, np.iinfo(np.uint16).max).astype(np.uint16)
                cut = np.searchsorted(_ranges(own, ranges), np.arange(ranges + 1))
                rows = [
                    {
                        "range": r,
                        "chunk": row["chunk"],
                        "hashes": own[cut[r] : cut[r + 1]].tobytes(),
                        "counts": count[cut[r] : cut[r + 1]].tobytes(),
                    }
                    for r in np.flatnonzero(np.diff(cut)).tolist()
                ]
                yield pa.RecordBatch.from_pylist(rows, schema=_HASHES)

    return chunks.mapInArrow(run, "range long, chunk long, hashes binary, counts binary")


def shared_grams(hashes: DataFrame, hot_records: int, hot_chunks: int | None = None) -> DataFrame:
    """For each row of ``gram_hashes`` a byte for each hash: in this chunk only (0), in others (1), very often (2).

    The last are in others, too, and have more records than ``hot_records`` or are in more chunks than ``hot_chunks``.
    """

    def meet(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()]
        _, where, count = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        records = np.concatenate([np.frombuffer(x, np.uint16) for x in table.column("counts").to_pylist()])
        hot = (np.bincount(where, weights=records) > hot_records) & (count > 1)
        if hot_chunks is not None:
            hot |= count > hot_chunks
        level = (count > 1).astype(np.uint8) + hot
        seen = np.split(level[where], np.cumsum([len(p) for p in parts])[:-1])
        return pa.table(
            [table.column("chunk"), table.column("range"), pa.array([s.tobytes() for s in seen], pa.binary())],
            schema=_BITS,
        )

    return hashes.groupBy("range").applyInArrow(meet, "chunk long, range long, seen binary")


def records(chunk: Chunk, at: np.ndarray, first: np.ndarray, last: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """(n, WIDTH) bytes. Equal records have equal windows, and the order of records is that of the suffixes of a gram."""
    out = np.zeros((len(at), WIDTH), np.uint8)
    out[:, :_HASH] = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)
    right, left = last + LENGTH - at, at - first
    out[:, _AT_RL], out[:, _AT_LL] = right, left
    padded = np.concatenate([np.zeros(_LEFT, np.uint8), chunk.data, np.zeros(_RIGHT, np.uint8)])
    step, back = np.arange(_RIGHT), np.arange(1, _LEFT + 1)
    for k in range(0, len(at), 1 << 13):
        s = slice(k, k + (1 << 13))
        place = (at[s] + _LEFT)[:, None]
        out[s, _HASH:_AT_RL] = padded[place + step] * (step < right[s, None])
        out[s, _AT_LEFT:_AT_LL] = padded[place - back] * (back <= left[s, None])
    return out


def shared_prefixes(rows: np.ndarray) -> np.ndarray:
    """Of sorted records, how many leading bytes each shares with the one before (0 for the first)."""
    if len(rows) < 2:
        return np.zeros(len(rows), np.uint8)
    differs = rows[1:] != rows[:-1]
    return np.append(0, np.where(differs.any(axis=1), differs.argmax(axis=1), WIDTH)).astype(np.uint8)


def _window_records(chunk: Chunk, first: np.ndarray, last: np.ndarray):
    """Records of single windows, for anchors whose windows are ``first`` … ``last``: place, windows, hash."""
    count = last - first + 1
    at = np.repeat(first, count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    h = np.zeros(len(at), np.uint64)
    for k in range(LENGTH):
        h = h * np.uint64(_STEP) + _TABLE[chunk.data[at + k]]
    return at, mixed(h)


_RUNS = pa.schema(
    [
        ("part", pa.int64()),
        ("chunk", pa.int64()),
        ("shared", pa.binary()),
        ("rest", pa.binary()),
        ("doc", pa.binary()),
        ("doc_id", pa.binary()),
        ("start", pa.binary()),
        ("end", pa.binary()),
    ]
)
_RUNS_TYPE = "part long, chunk long, shared binary, rest binary, doc binary, doc_id binary, start binary, end binary"
_GONE = pa.schema([("chunk", pa.int64()), ("doc", pa.binary()), ("start", pa.binary()), ("end", pa.binary())])
_GONE_TYPE = "chunk long, doc binary, start binary, end binary"
#: Stands for a null doc_id, below all others.
_NULL_ID = np.iinfo(np.int64).min


def _local_runs(chunk: Chunk, seen: list[tuple[int, bytes]], ranges: int) -> list[dict]:
    """Sorted, front-coded runs of a chunk's records, one row for each range, and what repeats inside the chunk.

    Rows with repeats have a negative part and no records.
    """
    a = anchors(chunk)
    distinct, where, count = np.unique(a.hash, return_inverse=True, return_counts=True)
    level = np.frombuffer(b"".join(s for _, s in sorted(seen)), np.uint8)
    level = np.maximum(level, count > 1)[where] if len(distinct) else np.zeros(0, np.uint8)
    rank = np.empty(len(chunk.ends), np.int64)
    rank[np.lexsort((np.arange(len(rank)), chunk.doc_ids, ~chunk.nulls))] = np.arange(len(rank))
    base = chunk.starts
    rows: list[dict] = []
    gone: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(at, first, last, hashes, doc):
        for k in range(0, len(at), SLICE):
            s = slice(k, k + SLICE)
            keys = records(chunk, at[s], first[s], last[s], hashes[s])
            text = keys.view(f"S{WIDTH}").ravel()
            order = np.lexsort((first[s], rank[doc[s]], text))
            keys = keys[order]
            shared = shared_prefixes(keys)
            kept = shared < WIDTH
            f, l, d = first[s][order], last[s][order], doc[s][order]  # noqa: E741
            gone.append((d[~kept], f[~kept] - base[d[~kept]], l[~kept] + LENGTH - base[d[~kept]]))
            keys, f, l, d = keys[kept], f[kept], l[kept], d[kept]  # noqa: E741
            shared = shared_prefixes(keys)
            part = _ranges(keys[:, :_HASH].copy().view(">u8").ravel().astype(np.uint64), ranges)
            cut = np.searchsorted(part, np.arange(ranges + 1))
            for p in np.flatnonzero(np.diff(cut)).tolist():
                r = slice(cut[p], cut[p + 1])
                own = shared[r].copy()
                own[0] = 0
                rest = keys[r][np.arange(WIDTH) >= own[:, None]].tobytes()
                doc_id = np.where(chunk.nulls[d[r]], _NULL_ID, chunk.doc_ids[d[r]])
                rows.append(
                    {
                        "part": p,
                        "chunk": chunk.id,
                        "shared": own.tobytes(),
                        "rest": pa.compress(rest, "zstd", asbytes=True),
                        "doc": d[r].astype(np.int32).tobytes(),
                        "doc_id": doc_id.tobytes(),
                        "start": (f[r] - base[d[r]]).tobytes(),
                        "end": (l[r] + LENGTH - base[d[r]]).tobytes(),
                    }
                )

    plain = level == 1
    add(a.at[plain], a.first[plain], a.last[plain], a.hash[plain], a.doc[plain])
    hot = np.flatnonzero(level == 2)
    for k in range(0, len(hot), SLICE // SPAN):
        some = hot[k : k + SLICE // SPAN]
        at, h = _window_records(chunk, a.first[some], a.last[some])
        add(at, at, at, h, np.searchsorted(chunk.ends, at, side="right"))
    if gone and (d := np.concatenate([g[0] for g in gone])).size:
        rows.append(
            {"part": -1 - chunk.id % ranges, "chunk": chunk.id, "doc": d.astype(np.int32).tobytes()}
            | {c: np.concatenate([g[k] for g in gone]).astype(np.int64).tobytes() for k, c in ((1, "start"), (2, "end"))}
        )
    return rows


def sorted_runs(chunks: DataFrame, seen: DataFrame, ranges: int) -> DataFrame:
    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        found = list(zip(right.column("range").to_pylist(), right.column("seen").to_pylist(), strict=True))
        rows: list[dict] = []
        for row in left.to_pylist():
            rows += _local_runs(Chunk.of(row), found, ranges)
        return pa.Table.from_pylist(rows, schema=_RUNS)

    return chunks.groupBy("chunk").cogroup(seen.groupBy("chunk")).applyInArrow(run, _RUNS_TYPE)


class Run:
    """A front-coded run, read record by record."""

    def __init__(self, row: dict) -> None:
        self.shared = row["shared"]
        size = WIDTH * len(self.shared) - sum(self.shared)
        self.rest = pa.decompress(row["rest"], size, "zstd", asbytes=True)
        self.key = b""
        self.at = -1
        self.byte = 0
        self.step()

    def step(self) -> None:
        """Goes to the next record; the key is None behind the last."""
        self.at += 1
        if self.at == len(self.shared):
            self.key = None
            return
        n = self.shared[self.at]
        end = self.byte + WIDTH - n
        self.key = self.key[:n] + self.rest[self.byte : end]
        self.byte = end


def merge(runs: list[Run]) -> Iterator[tuple[int, int, int]]:
    """Loser tree over the runs: (run, place in it, bytes shared with the record before) in order.

    ``known[r]`` is the length of the prefix that the head of run r shares with the last winner. Of two heads the one
    that shares more comes first, and the other's length holds for the new winner too; equal lengths are compared from
    that byte on only.
    """
    size = 1
    while size < len(runs):
        size *= 2
    known = [0] * size
    heads = [r.key for r in runs] + [None] * (size - len(runs))

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser."""
        x, y = heads[a], heads[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        n = known[a]
        if n == WIDTH:
            return (a, b) if a < b else (b, a)
        left = int.from_bytes(x[n:], "big")
        right = int.from_bytes(y[n:], "big")
        if left == right:
            first, second, n = (a, b, WIDTH) if a < b else (b, a, WIDTH)
        else:
            n = WIDTH - ((left ^ right).bit_length() + 7) // 8
            first, second = (a, b) if left < right else (b, a)
        known[second] = n
        return first, second

    losers = [0] * size
    winners = [0] * size + list(range(size))
    for node in range(size - 1, 0, -1):
        winners[node], losers[node] = play(winners[2 * node], winners[2 * node + 1])
    top = winners[1] if size > 1 else 0
    while heads[top] is not None:
        run = runs[top]
        yield top, run.at, known[top]
        run.step()
        heads[top] = run.key
        if run.key is not None:
            known[top] = run.shared[run.at]
        node = (top + size) // 2
        while node:
            top, losers[node] = play(top, losers[node])
            node //= 2


def repeats(rows: list[dict]) -> Iterator[tuple[int, int, int, int]]:
    """(chunk, doc, start, end) of all that repeats something earlier, from the runs of one range."""
    runs = [Run(r) for r in rows]
    chunk = [r["chunk"] for r in rows]
    doc = [np.frombuffer(r["doc"], np.int32).tolist() for r in rows]
    doc_id = [np.frombuffer(r["doc_id"], np.int64).tolist() for r in rows]
    start = [np.frombuffer(r["start"], np.int64).tolist() for r in rows]
    end = [np.frombuffer(r["end"], np.int64).tolist() for r in rows]
    # Records of the gram at hand: key, bytes shared with the one before, and the earliest place of its windows.
    group: list[tuple[bytes, int, tuple]] = []
    for r, k, shared in merge(runs):
        place = (doc_id[r][k], chunk[r], doc[r][k], start[r][k], end[r][k])
        if shared == WIDTH:
            key, before, first = group[-1]
            if place < first:
                group[-1] = key, before, place
                place = first
            yield place[1:]
            continue
        if shared < _HASH + GRAM and group:
            if len(group) > 1:
                yield from _windows(group)
            group = []
        group.append((runs[r].key, shared, place))
    if len(group) > 1:
        yield from _windows(group)


def _common(a: bytes, b: bytes) -> int:
    """Bytes that two strings of equal length share from the start."""
    return len(a) - ((int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_length() + 7) // 8


def _windows(group: list[tuple[bytes, int, tuple]]) -> Iterator[tuple[int, int, int, int]]:
    """Equal windows of different records of a gram.

    A window with d bytes before the anchor can only occur again if some other record shares these d bytes, and some
    other the LENGTH - d bytes from the anchor on. The longest that a record shares with any other is what it shares
    with a neighbour: in the order of the suffixes, known from the merge, and in the order of the contexts before.
    """
    lefts = [key[_AT_LEFT:_AT_LL] for key, _, _ in group]
    order = sorted(range(len(group)), key=lefts.__getitem__)
    before = [0] * len(group)
    for a, b in zip(order, order[1:], strict=False):
        n = _common(lefts[a], lefts[b])
        before[a], before[b] = max(before[a], n), n
    spans = []
    for i, (key, shared, _) in enumerate(group):
        after = group[i + 1][1] if i + 1 < len(group) else 0
        reach = min(_RIGHT, max(shared if i else 0, after) - _HASH)
        spans.append(range(LENGTH - min(key[_AT_RL], reach), min(key[_AT_LL], before[i]) + 1))

    def each() -> Iterator[tuple[tuple[int, bytes, bytes], tuple]]:
        for (key, _, (doc_id, chunk, doc, start, _)), span in zip(group, spans, strict=True):
            for d in span:
                window = (d, key[_AT_LEFT : _AT_LEFT + d], key[_HASH : _HASH + LENGTH - d])
                yield window, (doc_id, chunk, doc, start + key[_AT_LL] - d)

    earliest: dict[tuple[int, bytes, bytes], tuple] = {}
    for window, at in each():
        if window not in earliest or at < earliest[window]:
            earliest[window] = at
    for window, at in each():
        if earliest[window] != at:
            yield at[1], at[2], at[3], at[3] + LENGTH


def merged_repeats(runs: DataFrame) -> DataFrame:
    """All repeats, by chunk: those found inside chunks as they are, the others from merging each range."""

    def run(table: pa.Table) -> pa.Table:
        if table.column("part")[0].as_py() < 0:
            return table.select(_GONE.names)
        by_chunk: dict[int, list[tuple[int, int, int]]] = {}
        for chunk, doc, start, end in repeats(table.to_pylist()):
            own = by_chunk.setdefault(chunk, [])
            if own and own[-1][0] == doc and own[-1][1] <= start <= own[-1][2]:
                own[-1] = (doc, own[-1][1], max(end, own[-1][2]))
            else:
                own.append((doc, start, end))
        rows = []
        for chunk, own in by_chunk.items():
            d, s, e = zip(*own, strict=True)
            rows.append(
                {
                    "chunk": chunk,
                    "doc": np.array(d, np.int32).tobytes(),
                    "start": np.array(s, np.int64).tobytes(),
                    "end": np.array(e, np.int64).tobytes(),
                }
            )
        return pa.Table.from_pylist(rows, schema=_GONE)

    return runs.groupBy("part").applyInArrow(run, _GONE_TYPE)


_RESULT = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_bytes", pa.int64()),
        ("n_removed", pa.int64()),
        ("n_spans", pa.int64()),
        ("kept_sha256", pa.string()),
        ("kept", pa.binary()),
    ]
)
_RESULT_TYPE = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _cut_out(chunk: Chunk, gone: pa.Table, keep: bool) -> pa.Table:
    n = len(chunk.data)
    change = np.zeros(n + 1, np.int32)
    for row in gone.to_pylist():
        base = chunk.starts[np.frombuffer(row["doc"], np.int32)]
        np.add.at(change, base + np.frombuffer(row["start"], np.int64), 1)
        np.add.at(change, base + np.frombuffer(row["end"], np.int64), -1)
    removed = np.cumsum(change[:n]) > 0
    opens = removed.copy()
    opens[1:] &= ~removed[:-1]
    edges = chunk.starts[chunk.ends > chunk.starts]
    opens[edges] = removed[edges]
    total, spans = np.append(0, np.cumsum(removed)), np.append(0, np.cumsum(opens))
    rows = []
    for i, (s, e) in enumerate(zip(chunk.starts.tolist(), chunk.ends.tolist(), strict=True)):
        kept = chunk.data[s:e]
        if total[e] > total[s]:
            kept = kept[~removed[s:e]]
        kept = kept.tobytes()
        rows.append(
            {
                "doc_id": None if chunk.nulls[i] else int(chunk.doc_ids[i]),
                "n_bytes": e - s,
                "n_removed": int(total[e] - total[s]),
                "n_spans": int(spans[e] - spans[s]),
                "kept_sha256": hashlib.sha256(kept).hexdigest(),
                "kept": kept if keep else None,
            }
        )
    return pa.Table.from_pylist(rows, schema=_RESULT)


def remove_repeats(docs: DataFrame, keep: bool = True, hot_chunks: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with ``keep``, the kept bytes of every document.

    With ``hot_chunks`` a gram in more chunks than that is dealt out by windows, however few its records are.
    """
    spark = docs.sparkSession
    size = columns(docs, text="string").agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # Not fewer than other shuffles have, or Spark would deal the table out again.
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // BUCKET_BYTES + 1)
    ranges = size // RANGE_BYTES + 1
    chunk_bytes = min(MOST_CHUNK_BYTES, max(CHUNK_BYTES, size // CHUNKS))
    chunks = bucketed(gather(docs, chunk_bytes), buckets)
    seen = shared_grams(gram_hashes(chunks, ranges), HOT_RECORDS, hot_chunks)
    gone = merged_repeats(sorted_runs(chunks, seen, ranges))

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        return pa.concat_tables([_cut_out(Chunk.of(row), right, keep) for row in left.to_pylist()] or [_RESULT.empty_table()])

    return chunks.groupBy("chunk").cogroup(gone.groupBy("chunk")).applyInArrow(run, _RESULT_TYPE)


def digest(found: DataFrame) -> DataFrame:
    return found.drop("kept")
