"""SimHash near-duplicates through a Gray-order hierarchical index.

A fingerprint has 64 bits; two are linked when at most ``max_bits`` differ. The search:

* Copies of a fingerprint are one row from the start (smallest doc_id).
* Two fingerprints within d bits agree in at least one of d + 1 blocks of bits. So each is listed d + 1 times, rotated
  until one block leads, and sorted by Gray rank: rows that may be linked share a *cell*, the leading block.
* Tasks read their stretch of that order in chunks. Over each chunk stands a hierarchical index: the bits in which all
  members of a node agree are factored into the node as a mask and a pattern. Pairs of nodes are followed from the top;
  the differences in commonly fixed bits accumulate on the way down, and a pair of groups beyond d is dropped whole.
* A cell that lies in several chunks, as a hot one does, leaves its pieces with their masks and patterns. Pieces of a
  cell meet two by two in tasks of their own, if their patterns allow a link; nothing gathers a whole cell.
* From the links found in a chunk only a spanning forest is kept. Forests are joined to components by alternating
  large-star and small-star rounds, each of which is written down, so lost executors cost a stage retry.

Nulls and edge cases: a null or empty text, or one without words, has fingerprint zero, linked like any other. Rows
without a doc_id keep their fingerprint but can't be named: they link nothing and their component_id is null. Repeated
rows are copies. An empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import accumulate
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.shared import columns, stored

SHINGLE, SEED, MAX_BITS = 3, 42, 3
#: Rows of a chunk, members of a leaf and children of a node. They bound memory only.
CHUNK, LEAF, FANOUT = 8192, 16, 8
#: Pairs of leaves that are compared at once.
LEAF_PAIRS = 1024


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """A bit is 1 if it is set in over half the hashes of the shingles, repeats included."""
    import xxhash

    # bytes.lower and bytes.split know ASCII only: A-Z, and the six white space characters.
    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = [at - 1 for at in accumulate(len(w) + 1 for w in words)]
    starts = [0, *(e + 1 for e in ends[:-1])]
    hashed = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [hashed(joined, SEED)]
    else:
        hashes = [hashed(joined[s:e], SEED) for s, e in zip(starts, ends[shingle - 1 :], strict=False)]
    counts = np.zeros(64, np.int64)
    data = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
    for at in range(0, len(data), 1 << 16):
        counts += np.unpackbits(data[at : at + (1 << 16)], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(data), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed number, with the columns of long numbers named in ``carry``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t, shingle) if t else 0 for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", *carry)), pa.array(np.array(found, np.uint64).view(np.int64))],
                names=["doc_id", *carry, "fp"],
            )

    rows = columns(docs, doc_id="long", text="string", **dict.fromkeys(carry, "long"))
    return rows.mapInArrow(run, ", ".join(f"{c} long" for c in ("doc_id", *carry, "fp")))


class GrayIndex:
    """Hierarchical index over fingerprints in Gray order: levels of (mask, pattern), leaves first."""

    def __init__(self, members: np.ndarray) -> None:
        self.members = members
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        starts = np.arange(0, len(members), LEAF)
        ones = np.bitwise_and.reduceat(members, starts)
        zeros = ~np.bitwise_or.reduceat(members, starts)
        while True:
            self.levels.append((ones | zeros, ones))
            if len(ones) <= FANOUT:
                break
            starts = np.arange(0, len(ones), FANOUT)
            ones, zeros = np.bitwise_and.reduceat(ones, starts), np.bitwise_and.reduceat(zeros, starts)

    def top(self) -> tuple[int, int]:
        """Mask and pattern of all members together."""
        mask, ones = self.levels[-1]
        every = np.bitwise_and.reduce(ones)
        none = np.bitwise_and.reduce(mask & ~ones)
        return int(every | none), int(every)


def leaf_pairs(a: GrayIndex, b: GrayIndex, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of leaves whose commonly fixed bits differ in ``max_bits`` places at most; each pair once if a is b."""
    # The lower index is given as many levels as the other by starting from a common number of levels.
    depth = min(len(a.levels), len(b.levels))
    i = np.repeat(np.arange(len(a.levels[depth - 1][0])), len(b.levels[depth - 1][0]))
    j = np.tile(np.arange(len(b.levels[depth - 1][0])), len(a.levels[depth - 1][0]))
    known = np.zeros(len(i), np.uint64)
    so_far = np.zeros(len(i), np.uint8)
    for level in range(depth - 1, -1, -1):
        (mask_a, ones_a), (mask_b, ones_b) = a.levels[level], b.levels[level]
        if a is b:
            keep = i <= j
            i, j, known, so_far = i[keep], j[keep], known[keep], so_far[keep]
        both = mask_a[i] & mask_b[j]
        # Bits that an ancestor pair has fixed are counted already.
        so_far = so_far + np.bitwise_count((ones_a[i] ^ ones_b[j]) & both & ~known)
        keep = so_far <= max_bits
        i, j, known, so_far = i[keep], j[keep], both[keep], so_far[keep]
        if level:
            (i, j), (known, so_far) = _children(i, j, len(a.levels[level - 1][0]), len(b.levels[level - 1][0]), known, so_far)
    return i, j


def _children(i, j, size_a, size_b, *carried):
    n = FANOUT
    ci = (i[:, None] * n + np.repeat(np.arange(n), n)).ravel()
    cj = (j[:, None] * n + np.tile(np.arange(n), n)).ravel()
    keep = (ci < size_a) & (cj < size_b)
    return (ci[keep], cj[keep]), tuple(np.repeat(c, n * n)[keep] for c in carried)


class Forest:
    """Union-find over numbered members; only links that join two trees cost a step."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def link(self, x: np.ndarray, y: np.ndarray) -> None:
        rx, ry = self.root[x], self.root[y]
        new = rx != ry
        if not new.any():
            return
        pairs = np.unique(np.stack([rx[new], ry[new]], axis=1), axis=0)
        parent: dict[int, int] = {}

        def find(v: int) -> int:
            top = v
            while (up := parent.get(top, top)) != top:
                top = up
            while v != top:
                parent[v], v = top, parent.get(v, v)
            return top

        for p, q in pairs.tolist():
            p, q = find(p), find(q)
            if p != q:
                parent[max(p, q)] = min(p, q)
        change = np.arange(len(self.root))
        for v in list(parent):
            change[v] = find(v)
        self.root = change[self.root]


def search(a: GrayIndex, b: GrayIndex, forest: Forest, shift: int, max_bits: int) -> None:
    """Links all members of a and b within ``max_bits``; members of b are numbered from ``shift``."""
    li, lj = leaf_pairs(a, b, max_bits)
    within = np.arange(LEAF)
    for at in range(0, len(li), LEAF_PAIRS):
        x = (li[at : at + LEAF_PAIRS, None, None] * LEAF + within[:, None]).repeat(LEAF, axis=2)
        y = (lj[at : at + LEAF_PAIRS, None, None] * LEAF + within[None, :]).repeat(LEAF, axis=1)
        x, y = x.ravel(), y.ravel()
        keep = (x < len(a.members)) & (y < len(b.members))
        if a is b:
            keep &= x < y
        x, y = x[keep], y[keep]
        near = np.bitwise_count(a.members[x] ^ b.members[y]) <= max_bits
        forest.link(x[near], y[near] + shift)


def edges_of(forest: Forest, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each linked member with the smallest id of its tree."""
    order = np.argsort(ids, kind="stable")
    least = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(least, forest.root[order], ids[order])
    low = least[forest.root]
    linked = ids != low
    return ids[linked], low[linked]


def gray_rank(v: np.ndarray) -> np.ndarray:
    """Place of the code word v in the reflected Gray code."""
    for s in (1, 2, 4, 8, 16, 32):
        v = v ^ (v >> np.uint64(s))
    return v


def gray_word(rank: np.ndarray) -> np.ndarray:
    return rank ^ (rank >> np.uint64(1))


_SIGN = np.uint64(1 << 63)
_FOUND = pa.schema(
    [
        ("a", pa.int64()),
        ("b", pa.int64()),
        ("turn", pa.int32()),
        ("cell", pa.int64()),
        ("piece", pa.int64()),
        ("mask", pa.int64()),
        ("pattern", pa.int64()),
        ("ranks", pa.binary()),
        ("ids", pa.binary()),
    ]
)
_FOUND_TYPE = "a long, b long, turn int, cell long, piece long, mask long, pattern long, ranks binary, ids binary"


def _edge_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    empty = [pa.nulls(len(a), f.type) for f in list(_FOUND)[2:]]
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), *empty], schema=_FOUND)


def _piece_batch(turn: int, cell: int, piece: int, ranks: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    mask, pattern = (np.array([x], np.uint64).view(np.int64)[0] for x in GrayIndex(gray_word(ranks)).top())
    row = {"turn": turn, "cell": cell, "piece": piece, "mask": int(mask), "pattern": int(pattern)}
    return pa.RecordBatch.from_pylist([row | {"ranks": ranks.tobytes(), "ids": ids.tobytes()}], schema=_FOUND)


def _search_sorted(block: int, max_bits: int, chunk: int):
    """Task function over rows (turn, rank, id) in order: edges of each chunk, and pieces of cells that go on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        number = 0
        shift = np.uint64(64 - block)

        def done(turn: int, ranks: np.ndarray, ids: np.ndarray, first: bool, last: bool, cut: tuple[bool, bool]):
            """A chunk: its edges; its outer cells are pieces if they may go on beyond it."""
            nonlocal number
            index, forest = GrayIndex(gray_word(ranks)), Forest(len(ranks))
            search(index, index, forest, 0, max_bits)
            yield _edge_batch(*edges_of(forest, ids))
            cells = ranks >> shift
            edges = {int(cells[0])} if first or cut[0] else set()
            edges |= {int(cells[-1])} if last or cut[1] else set()
            for cell in sorted(edges):
                own = cells == np.uint64(cell)
                yield _piece_batch(turn, cell, task << 32 | number, ranks[own], ids[own])
                number += 1

        def of_turn(turn: int, ranks: np.ndarray, ids: np.ndarray, state: dict, last: bool):
            """As many whole chunks as there are, cut between cells where possible; the rest stays."""
            while len(ranks) > chunk or last and len(ranks):
                take = min(len(ranks), chunk)
                goes_on = False
                if take < len(ranks):
                    cells = ranks[: take + 1] >> shift
                    if cells[take] == cells[take - 1]:
                        at = int(np.searchsorted(cells, cells[take]))
                        goes_on = at == 0
                        take = at or take
                end = last and take == len(ranks)
                yield from done(turn, ranks[:take], ids[:take], state["first"], end, (state["cut"], goes_on))
                state["first"], state["cut"] = False, goes_on
                ranks, ids = ranks[take:], ids[take:]
            state["held"] = (ranks, ids)

        now, state = None, {}
        for batch in batches:
            turns = batch.column("turn").to_numpy()
            ranks = batch.column("rank").to_numpy().view(np.uint64) ^ _SIGN
            ids = batch.column("id").to_numpy()
            for turn in np.unique(turns).tolist():
                own = turns == turn
                if turn != now:
                    if now is not None:
                        yield from of_turn(now, *state["held"], state, True)
                    now, state = turn, {"first": True, "cut": False, "held": (ranks[:0], ids[:0])}
                held = state["held"]
                joined = np.concatenate([held[0], ranks[own]]), np.concatenate([held[1], ids[own]])
                yield from of_turn(turn, *joined, state, False)
        if now is not None:
            yield from of_turn(now, *state["held"], state, True)

    return run


def _search_pieces(max_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                a, b = (GrayIndex(gray_word(np.frombuffer(r[x], np.uint64))) for x in ("ranks_a", "ranks_b"))
                ids = np.frombuffer(r["ids_a"] + r["ids_b"], np.int64)
                forest = Forest(len(ids))
                search(a, b, forest, len(a.members), max_bits)
                found = edges_of(forest, ids)
                yield pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], names=["a", "b"])

    return run


def links(nodes: DataFrame, max_bits: int = MAX_BITS, chunk: int = CHUNK) -> DataFrame:
    """A spanning forest of all links, per place where they were found: a > b, ids of ``nodes`` (id, fp)."""
    block = 64 // (max_bits + 1)

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column("fp").to_numpy().view(np.uint64)
            for turn in range(max_bits + 1):
                by = np.uint64(turn * block)
                turned = (fps << by | fps >> (np.uint64(64) - by)) if turn else fps
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(fps), turn, np.int32)), pa.array((gray_rank(turned) ^ _SIGN).view(np.int64)),
                     batch.column("id")], names=["turn", "rank", "id"],
                )

    order = nodes.select("id", "fp").mapInArrow(ranked, "turn int, rank long, id long")
    runs = order.repartitionByRange("turn", "rank").sortWithinPartitions("turn", "rank")
    found = stored(runs.mapInArrow(_search_sorted(block, max_bits, chunk), _FOUND_TYPE), "links")
    inside = found.where("piece is null").select("a", "b")

    pieces = found.where("piece is not null")
    heads = pieces.select("turn", "cell", "piece", "mask", "pattern")

    def side(frame: DataFrame, suffix: str, *keys: str) -> DataFrame:
        return frame.select(*keys, *(F.col(c).alias(f"{c}_{suffix}") for c in frame.columns if c not in keys))

    differing = F.expr("bit_count((pattern_a ^ pattern_b) & mask_a & mask_b)")
    pairs = (
        side(heads, "a", "turn", "cell")
        .join(side(heads, "b", "turn", "cell"), ["turn", "cell"])
        .where((F.col("piece_a") < F.col("piece_b")) & (differing <= max_bits))
        .select("piece_a", "piece_b")
    )
    loads = pieces.select("piece", "ranks", "ids")
    met = (
        pairs.join(side(loads, "a"), "piece_a")
        .join(side(loads, "b"), "piece_b")
        .select("ranks_a", "ids_a", "ranks_b", "ids_b")
        .mapInArrow(_search_pieces(max_bits), "a long, b long")
    )
    return inside.unionByName(met)


def components(edges: DataFrame) -> DataFrame:
    """node and root (smallest node that it reaches) for all nodes of the edges (a > b).

    Large-star and small-star rounds, until a round changes nothing. Smallest neighbours are written down before they
    meet the edges again, so both sides of each join are plain shuffles and a hub's edges can be split.
    """

    def check(frame: DataFrame) -> tuple:
        return tuple(frame.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())

    def clean(frame: DataFrame) -> DataFrame:
        return stored(frame.where("a > b").distinct(), "stars")

    now = clean(edges)
    before = check(now)
    while before[0]:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            now.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        low = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "lowest")
        large = clean(both.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")))
        low = stored(large.groupBy("a").agg(F.min("b").alias("m")), "lowest")
        met = large.join(low, "a")
        now = clean(
            met.select("a", F.col("m").alias("b")).unionByName(met.select(F.col("b").alias("a"), F.col("m").alias("b")))
        )
        after = check(now)
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fp and component_id of every document."""
    prints = stored(fingerprints(docs, shingle), "fingerprints")
    nodes = stored(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("id")), "nodes")
    roots = components(links(nodes, max_bits))
    known = stored(
        nodes.join(roots, nodes.id == roots.node, "left").select("fp", F.coalesce("root", "id").alias("component_id")),
        "components",
    )
    joined = prints.join(known, "fp", "left")
    named = F.when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return joined.select("doc_id", "fp", named.alias("component_id"))


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """The documents with one row of each group: that of the smallest doc_id (none comes last), and of equal ones the
    smallest row. Rows are told apart by doc_id and two checksums of the text, so unlike texts under one doc_id, or without
    one, are documents of their own, and copies without a doc_id are copies."""
    names = docs.columns
    key = ["_id", "_hash", "_crc"]
    keyed = docs.select(
        F.struct(*(F.col(c) for c in names)).alias("_row"),
        F.col("doc_id").cast("long").alias("_id"),
        F.xxhash64("text").alias("_hash"),
        F.crc32(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")).alias("_crc"),
    )
    rows = keyed.select(F.col("_id").alias("doc_id"), F.col("_row.text").alias("text"), "_hash", "_crc")
    prints = stored(fingerprints(rows, shingle, ("_hash", "_crc")), "fingerprints")
    # A fingerprint is its own number here; groups are told by the smallest one.
    nodes = stored(prints.select("fp", F.col("fp").alias("id")).distinct(), "nodes")
    roots = components(links(nodes, max_bits))
    grouped = prints.join(roots, prints.fp == roots.node, "left").withColumn("_group", F.coalesce("root", "fp"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("_id"), "_hash", "_crc"))
    kept = stored(grouped.groupBy("_group").agg(first.alias("k")).select(*(f"k.{c}" for c in key)), "kept")
    same = reduce(and_, [keyed[c].eqNullSafe(kept[c]) for c in key])
    chosen = keyed.join(kept, same, "left_semi")
    return chosen.groupBy(*key).agg(F.min("_row").alias("_row")).select("_row.*")
