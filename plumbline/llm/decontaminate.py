"""Benchmark decontamination by greedy string tiling.

A document is contaminated by a benchmark item if non-overlapping matches of at least ``LEAST`` words between the two
cover ``COVERAGE`` of the item's words, in whatever order they stand.

* Seeds: all five-word windows of the items, as hashes. A bit table of fixed size (8 MB, whatever the benchmark) lets
  through the windows of documents that may be seeds; only words in such windows can be part of a match. A document
  shrinks to its segments, the runs of such words.
* Documents with equal segments are one class from there on, so a passage that a third of all documents hold is looked
  at once. Classes join the items' seeds on the hash; a pair whose shared seeds can't cover enough of the item goes.
* Each remaining pair is tiled: running Karp-Rabin finds the longest matches among unmarked words, they are marked, and
  the search goes on with shorter ones, down to ``LEAST`` words. Matches compare the words themselves.

Words are runs of letters, digits and non-ASCII characters of the lower-cased text.

Nulls and edge cases: a null or empty text has no words; items of fewer than ``LEAST`` words match nothing; items that
repeat an item_id are items of their own; a null doc_id or item_id is returned as null. Repeated rows give one result
for each doc_id, item and text. Empty tables give an empty result; other columns are left out (``contaminated``) or
kept as they are (``keep_clean``).
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.shared import columns, stored
from plumbline.llm.text_bytes import blocks, chained, words

LEAST, COVERAGE = 5, 0.8
#: Bits of the seed table: 2 ** 26, which is 8 MB.
TABLE_BITS = 26
_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(ord("a"), ord("z") + 1), *range(ord("0"), ord("9") + 1), *range(0x80, 0x100)]] = True
#: Length at which the search for matches starts.
START = 20
_PRIME, _BASE = (1 << 61) - 1, 1_000_003


def seeds(items: DataFrame) -> DataFrame:
    """key, item_id, n_words, words, and pos and h of every window of the items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for block in blocks(batch.column("text")):
                w = words(block, _IS_WORD)
                data = block.data.tobytes()
                for i in range(block.size):
                    own = np.flatnonzero(w.owner == i)
                    text = [data[s:e].decode() for s, e in zip(w.starts[own].tolist(), w.ends[own].tolist(), strict=True)]
                    h = chained(w.hashes[own], LEAST).view(np.int64).tolist()
                    at = block.first + i
                    rows.append((batch.column("item_id")[at].as_py(), batch.column("key")[at].as_py(), text, h))
            yield pa.RecordBatch.from_pylist(
                [{"item_id": i, "key": k, "words": t, "hashes": h} for i, k, t, h in rows], schema=_ITEM
            )

    rows = columns(items, item_id="long", text="string").select(
        "item_id", F.xxhash64("item_id", "text").alias("key"), F.lower("text").alias("text")
    )
    return rows.distinct().mapInArrow(run, "item_id long, key long, words array<string>, hashes array<long>")


_ITEM = pa.schema(
    [
        ("item_id", pa.int64()),
        ("key", pa.int64()),
        ("words", pa.list_(pa.string())),
        ("hashes", pa.list_(pa.int64())),
    ]
)
_SEGMENTS = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("segments", pa.list_(pa.list_(pa.string()))),
        ("hashes", pa.list_(pa.int64())),
    ]
)


def seed_table(items: DataFrame) -> np.ndarray:
    """A bit for each value of the leading bits of the seeds, as bytes. At most 2 ** (TABLE_BITS - 6) words are sent."""
    lead = F.shiftrightunsigned("h", 64 - TABLE_BITS)
    bits = (
        items.select(F.explode("hashes").alias("h"))
        .select(F.shiftrightunsigned(lead, 6).alias("word"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {64 - TABLE_BITS}) & 63 as int))").alias("bit"))
        .groupBy("word")
        .agg(F.bit_or("bit").alias("bits"))
        .toArrow()
    )
    table = np.zeros(1 << (TABLE_BITS - 6), np.int64)
    table[bits.column("word").to_numpy()] = bits.column("bits").to_numpy()
    return table.view(np.uint8)


def suspicious(docs: DataFrame, table: np.ndarray) -> DataFrame:
    """doc_id and segments (lists of words) of documents with windows that the table knows, and those windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for block in blocks(batch.column("text")):
                w = words(block, _IS_WORD)
                h = chained(w.hashes, LEAST)
                if not len(h):
                    continue
                lead = h >> np.uint64(64 - TABLE_BITS)
                hit = (table[lead >> np.uint64(3)] >> (lead & np.uint64(7)).astype(np.uint8)) & 1 > 0
                hit &= w.owner[: len(h)] == w.owner[LEAST - 1 :]
                at = np.flatnonzero(hit)
                if not len(at):
                    continue
                data = block.data.tobytes()
                # A segment goes on as long as the next window overlaps or touches it in the same text.
                new = np.append(True, (np.diff(at) > LEAST) | (w.owner[at[1:]] != w.owner[at[:-1]]))
                first = np.flatnonzero(new)
                last = np.append(first[1:], len(at)) - 1
                rows: dict[int, dict] = {}
                for f, l in zip(first.tolist(), last.tolist(), strict=True):  # noqa: E741
                    owner = int(w.owner[at[f]])
                    row = rows.setdefault(owner, {"segments": [], "hashes": []})
                    s, e = w.starts[at[f] : at[l] + LEAST], w.ends[at[f] : at[l] + LEAST]
                    row["segments"].append([data[x:y].decode() for x, y in zip(s.tolist(), e.tolist(), strict=True)])
                    row["hashes"] += h[at[f : l + 1]].view(np.int64).tolist()
                yield pa.RecordBatch.from_pylist(
                    [{"doc_id": ids[block.first + o].as_py()} | r for o, r in rows.items()], schema=_SEGMENTS
                )

    rows = columns(docs, doc_id="long", text="string").select("doc_id", F.lower("text").alias("text"))
    return rows.mapInArrow(run, "doc_id long, segments array<array<string>>, hashes array<long>")


def tiles(item: list[str], segments: list[list[str]], least: int = LEAST) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (place in the item, place in the joined segments, length) of each tile.

    Longest matches first; of equal ones the first in the item, then in the segments. No match runs across segments.
    """
    numbers: dict[str, int] = {}
    p = [numbers.setdefault(x, len(numbers)) for x in item]
    t: list[int] = []
    for segment in segments:
        t += [numbers.get(x, -1) for x in segment]
        t.append(-1)
    free_p, free_t = [True] * len(p), [x >= 0 for x in t]
    found: list[tuple[int, int, int]] = []
    length = max(least, min(START, len(p)))
    while len(p) >= least:
        matches = _matches(p, t, free_p, free_t, length)
        longest = max((m[2] for m in matches), default=0)
        if longest > 2 * length:
            length = longest
            continue
        queue = [(-n, i, j) for i, j, n in matches]
        heapify(queue)
        while queue:
            n, i, j = heappop(queue)
            open_ = [a and b for a, b in zip(free_p[i : i - n], free_t[j : j - n], strict=True)]
            if all(open_):
                free_p[i : i - n] = free_t[j : j - n] = [False] * -n
                found.append((i, j, -n))
                continue
            # What is left of it waits for its turn among the shorter ones.
            at = 0
            for free, run in groupby(open_):
                size = len(list(run))
                if free and size >= length:
                    heappush(queue, (-size, i + at, j + at))
                at += size
        if length == least:
            break
        length = max(least, length // 2)
    return sorted(found)


def _matches(p: list[int], t: list[int], free_p: list[bool], free_t: list[bool], n: int) -> list[tuple[int, int, int]]:
    """All matches of unmarked words of at least ``n`` that can't be extended to the left, as long as they go."""
    where: dict[int, list[int]] = {}
    for j, h in _windows(t, free_t, n):
        where.setdefault(h, []).append(j)
    out = []
    for i, h in _windows(p, free_p, n):
        for j in where.get(h, ()):
            if i and j and free_p[i - 1] and free_t[j - 1] and p[i - 1] == t[j - 1]:
                continue
            if p[i : i + n] != t[j : j + n]:
                continue
            k = n
            while i + k < len(p) and j + k < len(t) and free_p[i + k] and free_t[j + k] and p[i + k] == t[j + k]:
                k += 1
            out.append((i, j, k))
    return out


def _windows(x: list[int], free: list[bool], n: int) -> Iterator[tuple[int, int]]:
    """Running Karp-Rabin hashes of the windows of ``n`` unmarked words."""
    top = pow(_BASE, n - 1, _PRIME)
    h = size = 0
    for at, (value, ok) in enumerate(zip(x, free, strict=True)):
        if not ok:
            h = size = 0
            continue
        if size == n:
            h = (h - (x[at - n] + 2) * top) % _PRIME
            size -= 1
        h = (h * _BASE + value + 2) % _PRIME
        size += 1
        if size == n:
            yield at - n + 1, h


_TILED = pa.schema([("class", pa.string()), ("key", pa.int64()), ("matched", pa.int64()), ("n_tiles", pa.int64())])


def _tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            found = tiles(r["words"], r["segments"])
            matched = sum(n for _, _, n in found)
            rows.append({"class": r["class"], "key": r["key"], "matched": matched, "n_tiles": len(found)})
        yield pa.RecordBatch.from_pylist(rows, schema=_TILED)


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, item_id, n_words (of the item), matched, n_tiles and coverage of each contaminated pair."""
    items = stored(seeds(benchmark), "items")
    found = suspicious(docs, seed_table(items)).select(
        "doc_id", "segments", "hashes", F.sha2(F.to_json("segments").cast("binary"), 256).alias("class")
    )
    found = stored(found, "suspicious")
    classes = stored(
        found.groupBy("class").agg(F.first("segments").alias("segments"), F.first("hashes").alias("hashes")), "classes"
    )
    at = items.select("key", F.size("words").alias("n_words"), F.posexplode("hashes").alias("pos", "h"))
    hits = classes.select("class", F.explode(F.array_distinct("hashes")).alias("h"))
    # Places of the item that shared seeds cover: no tile reaches beyond them.
    places = F.sort_array(F.collect_set("pos"))
    reach = F.aggregate(
        F.transform("places", lambda x, k: F.least(F.lit(LEAST), F.coalesce(F.get("places", k + 1) - x, F.lit(LEAST)))),
        F.lit(0),
        lambda a, x: a + x,
    )
    pairs = (
        hits.join(at, "h")
        .groupBy("class", "key")
        .agg(F.first("n_words").alias("n_words"), places.alias("places"))
        .where(reach >= coverage * F.col("n_words"))
        .select("class", "key")
    )
    tiled = (
        pairs.join(classes.select("class", "segments"), "class")
        .join(items.select("key", "words"), "key")
        .mapInArrow(_tile, "class string, key long, matched long, n_tiles long")
    )
    named = items.select("key", "item_id", F.size("words").cast("long").alias("n_words"))
    share = (F.col("matched") / F.col("n_words")).alias("coverage")
    judged = tiled.join(named, "key").select("class", "item_id", "n_words", "matched", "n_tiles", share)
    bad = stored(judged.where(F.col("coverage") >= coverage), "contaminated")
    return (
        found.select("doc_id", "class")
        .join(bad, "class")
        .select("doc_id", "item_id", "n_words", "matched", "n_tiles", "coverage")
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """The rows that aren't contaminated. Each is judged by its own text, whatever other rows have its doc_id or none: rows
    are numbered by a hash of both."""
    numbered = F.xxhash64(F.col("doc_id").cast("long"), "text")
    named = docs.select(numbered.alias("doc_id"), F.col("text"))
    bad = stored(contaminated(named, benchmark, coverage).select(F.col("doc_id").alias("_bad_id")).distinct(), "bad")
    return docs.join(bad, numbered == F.col("_bad_id"), "left_anti")
