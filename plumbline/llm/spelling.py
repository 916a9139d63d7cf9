"""Spelling variants: words one edit apart, found by a frontier that walks a relational trie level by level.

The trie is a table of edges (node, label, child) with chains of single children joined into one label, so its depth is
the number of branchings on a path and not the length of the longest word. It holds every word twice: as it is, and
backwards behind a mark. Each of the two starts as the state (word, 0, root, no edit). At each level the states join the
edges of their node; a state may follow an edge whose label stands next in the word, or, once, one whose label differs by
one replaced, missing or additional character. States that have used their edit and stand at the end of the word and of
another word are neighbours. The last character of a word may also go where its beginning is a word.

An edit lies in the second half of the word or of the word read backwards, so none is tried before the middle: near the
root, where nodes have very many edges, states only follow their own word. Edges tell which first characters follow their
child and how far it is to ends of words below; states that cannot end are dropped when they are made, before the next
join. Nodes are hashes of their prefixes; neighbours are looked up by hash and then compared as strings, so a collision
can add no neighbour.

The trie is built from sorted ranges of words. A range is cut between words that differ in their first ``SHARED``
characters, and each task lists the beginnings of its first and last word up to that length as nodes: all nodes that
ranges share are among them, so every task finds the same parents.

Nulls and edge cases: a null or empty text has no word; a null doc_id counts as the empty string; repeated rows all count;
an empty table gives an empty result; other columns are left out. Long words are labels of long edges.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.shared import columns, stored
from plumbline.llm.text_bytes import blocks

LEAST_LENGTH, LEAST_COUNT = 5, 3
#: One run in this many, by its checksum, loses a character.
SPOILED = 97
#: A form occurs at least so many times as often as its variant.
TIMES = 2
SHARED = 12
#: Distances to ends of words are bits; the last one stands for itself and beyond.
FAR = 62
#: What words start with that are read backwards; no letter.
MARK = "\x01"
#: Edges of nodes up to this depth in letters go to every task: with 90 letters there are at most 1 + 2 * (90 + 8,100) of
#: them. All words pass these few nodes, deeper ones are met by a shuffle.
SMALL_DEPTH = 1

#: Bytes of text whose runs are counted together.
BLOCK_BYTES = 4 << 20
# Runs are of A-Z, a-z and the letters from U+00C0 to U+00FF, which are C3 80 to C3 BF in UTF-8.
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_SECOND = np.zeros(256, bool)
_SECOND[0x80:0xC0] = True
_LOWERED = np.arange(256, dtype=np.uint8)
_LOWERED[0x41:0x5B] += 0x20

EDGE_TYPE = "depth int, node long, label string, child long, ends long, follows long"


def counted_runs(keys: list[int | None], texts: pa.Array, least_length: int, spoiled: int) -> pa.RecordBatch:
    """word and n of the runs of letters in texts, lower-cased and some of them spoiled, that are long enough."""
    (block,) = blocks(texts, 1 << 62)
    data = block.data
    # The two-byte letters are C3 and a second byte.
    second = np.append(False, (data[:-1] == 0xC3) & _SECOND[data[1:]]) if len(data) else np.zeros(0, bool)
    first = np.append(second[1:], False)
    inside = _LETTER[data] | second | first
    before, after = np.append(False, inside[:-1]), np.append(inside[1:], False)
    filled = block.ends > block.starts
    before[block.starts[filled]] = False
    after[block.ends[filled] - 1] = False
    starts, stops = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    pairs = np.flatnonzero(first)
    wide = np.searchsorted(pairs, stops) - np.searchsorted(pairs, starts)
    # Runs that are too short stay so, whether they lose a character or not.
    long = stops - starts - wide >= least_length
    starts, stops = starts[long], stops[long]
    owner = np.searchsorted(block.ends, starts, side="right")
    low = _LOWERED[data]
    view = memoryview(low.tobytes())
    sums = [zlib.crc32(f"{'' if k is None else k}:".encode()) for k in keys]
    h = np.array(
        [
            zlib.crc32(view[a:b], sums[i])
            for a, b, i in zip(starts.tolist(), stops.tolist(), owner.tolist(), strict=True)
        ],
        np.int64,
    )
    hit = h % spoiled == 0
    runs = [bytes(view[a:b]).decode() for a, b in zip(starts[hit].tolist(), stops[hit].tolist(), strict=True)]
    cut = [r[: k % len(r)] + r[k % len(r) + 1 :] for r, k in zip(runs, h[hit].tolist(), strict=True)]
    starts, stops = starts[~hit], stops[~hit]
    marks = np.zeros(len(data) + 1, np.int8)
    marks[starts] = 1
    marks[stops] -= 1
    kept = low[np.cumsum(marks[:-1], dtype=np.int8).astype(bool)]
    ends = np.append(0, np.cumsum(stops - starts))
    whole = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(kept)])
    lost = pa.array([w for w in cut if len(w) >= least_length], pa.large_string())
    counted = pa.concat_arrays([whole, lost]).value_counts()
    return pa.RecordBatch.from_arrays(
        [counted.field("values").cast(pa.string()), counted.field("counts")], names=["word", "n"]
    )


def _parts(texts: pa.Array) -> Iterator[tuple[int, int, pa.Array]]:
    """Texts in blocks, with the numbers of the first one and the one behind; a long one is cut where no letter stands."""
    for block in blocks(texts, BLOCK_BYTES):
        here = (block.first, block.first + block.size)
        if len(block.data) <= BLOCK_BYTES:
            yield *here, texts[slice(*here)]
            continue
        at = 0
        # ASCII characters that are no letters; there is no cut inside a character.
        gaps = np.flatnonzero(~_LETTER[block.data] & (block.data < 0x80))
        while at < len(block.data):
            k = int(np.searchsorted(gaps, at + BLOCK_BYTES))
            till = int(gaps[k]) + 1 if k < len(gaps) else len(block.data)
            yield *here, pa.array([block.data[at:till].tobytes().decode()], pa.large_string())
            at = till


def words(docs: DataFrame, least_length: int = LEAST_LENGTH, least: int = LEAST_COUNT, spoiled: int = SPOILED) -> DataFrame:
    """word and n, its occurrences, of all words long and frequent enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").fill_null("").cast(pa.large_string())
            keys = batch.column("doc_id").to_pylist()
            for first, behind, part in _parts(texts):
                yield counted_runs(keys[first:behind], part, least_length, spoiled)

    rows = columns(docs, doc_id="long", text="string").mapInArrow(run, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def node_of(prefix: str) -> int:
    """The node of a prefix: a signed 64-bit hash, as Spark's ``xxhash64`` gives it."""
    h = xxhash.xxh64_intdigest(prefix.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def _bit(character: str) -> int:
    return 1 << ord(character) % FAR


def _farther(ends: int, steps: int) -> int:
    moved = ends << min(steps, FAR)
    return moved & ((1 << FAR) - 1) | (1 << FAR if moved >> FAR else 0)


class _Path:
    """The nodes from the root to the word read last: depth, distances to ends below, first characters that follow, and
    the node itself once it is known."""

    def __init__(self) -> None:
        self.word = ""
        self.nodes: list[list] = [[0, 0, 0, node_of("")]]

    def _close(self) -> tuple:
        """Takes the deepest node off; the edge that leads to it."""
        depth, ends, follows, node = self.nodes.pop()
        parent = self.nodes[-1]
        label = self.word[parent[0] : depth]
        parent[1] |= _farther(ends, len(label))
        parent[2] |= _bit(label[0])
        if parent[3] is None:
            parent[3] = node_of(self.word[: parent[0]])
        letters = parent[0] - (parent[0] > 0 and self.word[0] == MARK)
        return letters, parent[3], label, node_of(self.word[:depth]) if node is None else node, ends, follows

    def go(self, word: str) -> Iterator[tuple]:
        """Edges that are complete as the next word of the sorted range turns off."""
        common = len(os.path.commonprefix((self.word, word)))
        while self.nodes[-1][0] > common:
            if self.nodes[-2][0] < common:
                self.nodes.insert(-1, [common, 0, 0, None])
            yield self._close()
        first = self.word == ""
        self.word = word
        if first:
            self.nodes += [[d, 0, 0, None] for d in range(1, min(SHARED, len(word) - 1) + 1)]
        self.nodes.append([len(word), 1, 0, None])

    def end(self) -> Iterator[tuple]:
        """All edges that are left, with a node for each beginning of the last word."""
        have = {n[0] for n in self.nodes}
        self.nodes += [[d, 0, 0, None] for d in range(1, min(SHARED, len(self.word) - 1) + 1) if d not in have]
        self.nodes.sort(key=lambda n: n[0])
        while len(self.nodes) > 1:
            yield self._close()


def trie(words: DataFrame) -> DataFrame:
    """The edges of the trie of distinct words.

    ``depth`` is the number of letters in the node's prefix; ``ends`` has a bit for each distance from the child to an end of a word
    below, ``follows`` one for each first character of a label that goes on from it (some characters share a bit).
    """
    names = [part.split()[0] for part in EDGE_TYPE.split(", ")]
    kinds = [pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, rows = _Path(), []
        for part in batches:
            for word in part.column("word").to_pylist():
                rows += path.go(word)
                if len(rows) >= 10_000:
                    yield batch(rows)
                    rows = []
        rows += path.end()
        if rows:
            yield batch(rows)

    ranges = words.select("word").repartitionByRange(F.substring("word", 1, SHARED)).sortWithinPartitions("word")
    # Ranges list the nodes that they share each; what lies below is put together.
    return (
        ranges.mapInArrow(run, EDGE_TYPE)
        .groupBy("depth", "node", "label", "child")
        .agg(F.bit_or("ends").alias("ends"), F.bit_or("follows").alias("follows"))
    )


def both_ways(words: DataFrame) -> DataFrame:
    """word and since of all words, and of all words backwards: no edit is tried before the character ``since``."""
    half = F.floor(F.length("word") / 2).cast("int")
    ahead = words.select("word", half.alias("since"))
    back = words.select(F.concat(F.lit(MARK), F.reverse("word")).alias("word"), (1 + F.length("word") - half).alias("since"))
    return ahead.unionByName(back)


def step(states: DataFrame, edges: DataFrame, level: int) -> DataFrame:
    """All states that follow along one edge each, without those that cannot come to an end. ``level`` is the number of
    edges that the states have followed."""
    size, position, word = F.length("label"), F.col("position"), F.col("word")
    # The mark is no letter.
    letters = size - F.startswith("label", F.lit(MARK)).cast("int")

    def ahead(n: Column) -> Column:
        """The next ``n`` characters of the word, or what is left of it."""
        return word.substr(position + 1, n)

    same = ahead(size) == F.col("label")
    may = (F.col("edits") == 0) & ~same & (position + size > F.col("since"))
    single = size == 1

    def near(n: Column) -> Column:
        return (F.length(ahead(n)) == n) & (F.levenshtein(ahead(n), F.col("label"), 1) == 1)

    # How many characters of the word a label can stand for with the edit inside it. Most labels are single letters.
    replaced = F.when(single, position < F.length("word")).otherwise(near(size))
    added = F.when(single, F.lit(True)).otherwise(near(size - 1))
    missing = F.when(single, word.substr(position + 2, F.lit(1)) == F.col("label")).otherwise(near(size + 1))

    def to(n: Column, edits: Column) -> Column:
        return F.struct((position + n).alias("position"), edits.alias("edits"))

    one = F.lit(1)
    ways = F.array(
        F.when(same, to(size, F.col("edits"))),
        F.when(may & replaced, to(size, one)),
        F.when(may & added, to(size - 1, one)),
        F.when(may & missing, to(size + 1, one)),
    )
    small = F.col("depth") <= SMALL_DEPTH
    parts = []
    if level <= SMALL_DEPTH + 1:
        parts.append(states.where(small).join(F.broadcast(edges.where(small).drop("depth")), "node"))
    if level:
        # A node is as deep as the edges before it, but for that of the mark.
        # Nodes have few edges each, so a task's share of the edges is even and fits a hash table.
        deep = edges.where(~small & (F.col("depth") >= level - 1)).drop("depth").hint("shuffle_hash")
        parts.append(states.where(~small).join(deep, "node"))
    met = reduce(DataFrame.unionByName, parts).where(same | may)
    after = (
        met.select(
            "word", "since", F.col("child").alias("node"), (F.col("depth") + letters).alias("depth"), "ends", "follows",
            F.explode(ways).alias("way"),
        )
        .where("way IS NOT NULL")
        .select("word", "since", "node", "depth", "ends", "follows", "way.position", "way.edits")
    )
    left = F.length("word") - position
    following = F.ascii(word.substr(position + 1, one)) % FAR
    going = (F.getbit("ends", F.least(left, F.lit(FAR))) == 1) & ((left == 0) | (F.getbit("follows", following) == 1))
    end = F.when(F.col("edits") == 1, left == 0).otherwise((left == 1) & (F.getbit("ends", F.lit(0)) == 1))
    return after.where((F.col("edits") == 0) | going).select(
        "word", "since", "position", "node", "depth", "edits", end.alias("found")
    )


def neighbours(words: DataFrame) -> DataFrame:
    """word, near, near_n: each pair of words that are one edit apart, from both sides. ``words`` are stored."""
    entries = both_ways(words)
    edges = stored(trie(entries), "spelling-edges")
    zero = F.lit(0)
    states = entries.select(
        "word", "since", zero.alias("position"), F.lit(node_of("")).alias("node"), zero.alias("depth"), zero.alias("edits")
    )
    found: list[DataFrame] = []
    for level in count():
        after = stored(step(states, edges, level), "spelling-states")
        if after.isEmpty():
            break
        found.append(after.where("found").select("word", "node"))
        states = after.where("edits = 0 OR NOT found").drop("found")
    if not found:
        return words.selectExpr("word", "word AS near", "n AS near_n").where("false")
    back = F.col("word").startswith(MARK)
    starts = reduce(DataFrame.unionByName, found).select(
        F.when(back, F.reverse(F.expr("substring(word, 2)"))).otherwise(F.col("word")).alias("word"), "node"
    )
    nodes = F.array(F.xxhash64("word"), F.xxhash64(F.concat(F.lit(MARK), F.reverse("word"))))
    ends = words.select(F.explode(nodes).alias("node"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    pairs = starts.join(ends, "node").where(F.levenshtein("word", "near", 1) == 1)
    return pairs.select("word", "near", "near_n").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """word and root: where the forms of a word lead to. ``forms`` has word, n and form, stored.

    A form occurs ``TIMES`` times as often as its variant, so a path is no longer than the doublings of the largest
    count; each round of joins doubles what is known of it.
    """
    most = forms.agg(F.max("n")).first()[0] or 1
    known = forms.select("word", F.coalesce("form", "word").alias("root"))
    length = 1
    while length < most.bit_length():
        further = known.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        known = stored(known.join(further, "root").select("word", F.col("beyond").alias("root")), "spelling-roots")
        length *= 2
    return known


def variants(
    docs: DataFrame, least_length: int = LEAST_LENGTH, least: int = LEAST_COUNT, spoiled: int = SPOILED
) -> DataFrame:
    """word, form, root, n, n_near, form_n of all words: how many words are near, and the most frequent of these if it
    occurs ``TIMES`` times as often."""
    counted = stored(words(docs, least_length, least, spoiled), "spelling-words")
    first = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("near"))).alias("first")
    best = neighbours(counted).groupBy("word").agg(F.count("*").alias("n_near"), first)
    often = -F.col("first.n") >= TIMES * F.col("n")
    forms = stored(
        counted.join(best, "word", "left").select(
            "word",
            "n",
            F.when(often, F.col("first.near")).alias("form"),
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(often, -F.col("first.n")).alias("form_n"),
        ),
        "spelling-forms",
    )
    return forms.join(roots(forms), "word").select("word", "form", "root", "n", "n_near", "form_n")
