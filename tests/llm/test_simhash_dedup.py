import random
import re

import numpy as np
import pytest
import xxhash
from llm_data import ODD_TEXTS, documents, sorted_rows  # noqa: F401

from plumbline.llm import simhash_dedup as s


def fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(prints, ids, bits=3):
    """Smallest id that each reaches, from all pairs."""
    v = np.array(prints, np.uint64)
    near = np.bitwise_count(v[:, None] ^ v[None, :]) <= bits
    order = np.argsort(ids, kind="stable")
    label = np.empty(len(ids), np.int64)
    label[order] = np.arange(len(ids))
    while True:
        new = np.where(near, label[None, :], len(ids)).min(axis=1)
        if (new == label).all():
            return [ids[order[x]] for x in label]
        label = new


def clouds(rnd, centres, size, flips):
    out = set()
    for _ in range(centres):
        c = rnd.getrandbits(64)
        for _ in range(size):
            v = c
            for _ in range(rnd.randrange(flips + 1)):
                v ^= 1 << rnd.randrange(64)
            out.add(v)
    return sorted(out)


@pytest.mark.parametrize("shape", [(1, 900, 5), (40, 20, 4), (500, 1, 0)])
def test_index_finds_all_links(shape):
    values = np.array(clouds(random.Random(3), *shape), np.uint64)
    values = values[np.argsort(s.gray_rank(values))]
    assert (s.gray_word(s.gray_rank(values)) == values).all()
    forest, index = s.Forest(len(values)), s.GrayIndex(values)
    s.search(index, index, forest, 0, 3)
    ids = list(range(len(values)))
    assert [ids[x] for x in roots(values, ids)] == [min(np.flatnonzero(forest.root == r)) for r in forest.root]


def test_pruning_drops_pairs_of_groups():
    rng = np.random.default_rng(1)
    values = np.unique(rng.integers(0, 1 << 64, 20_000, dtype=np.uint64))
    values = values[np.argsort(s.gray_rank(values))]
    index = s.GrayIndex(values)
    leaves = len(index.levels[0][0])
    assert len(s.leaf_pairs(index, index, 3)[0]) < 0.4 * leaves * (leaves + 1) / 2


@pytest.mark.parametrize("chunk", [8192, 64, 7])
def test_links_over_partitions_and_pieces(spark, chunk):
    """Small chunks cut hot cells into pieces that meet in tasks of their own."""
    rnd = random.Random(4)
    values = sorted({*clouds(rnd, 3, 120, 5), *clouds(rnd, 60, 3, 3), *range(40)})
    rnd.shuffle(values)
    ids = rnd.sample(range(10_000), len(values))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    nodes = spark.createDataFrame(list(zip(ids, signed, strict=True)), "id long, fp long")
    found = dict(s.components(s.links(nodes, 3, chunk)).collect())
    assert [found.get(i, i) for i in ids] == roots(values, ids)


def test_documents(documents):
    rnd = random.Random(5)
    vocabulary = [f"w{k}" for k in range(200)]
    rows = list(ODD_TEXTS)
    for k in range(60):
        words = [rnd.choice(vocabulary) for _ in range(rnd.choice([1, 2, 3, 60, 400]))]
        rows.append((1000 + 3 * k, " ".join(words)))
        words[rnd.randrange(len(words))] = "changed"
        rows.append((1001 + 3 * k, "\t".join(words).upper()))
    got = s.digest(s.near_duplicates(documents(rows))).collect()
    known = [(i, fingerprint(t)) for i, t in rows if i is not None]
    by_id = dict(zip([i for i, _ in known], roots([f for _, f in known], [i for i, _ in known]), strict=True))
    expected = [(i, f"{fingerprint(t):016x}", by_id.get(i) if i is not None else None) for i, t in rows]
    # An id with two texts may have two components; all its rows are compared by their own.
    twice = {12}
    assert sorted_rows(r for r in got if r[0] not in twice) == sorted_rows(e for e in expected if e[0] not in twice)
    assert {r[1] for r in got if r[0] in (1, 2, 3)} == {"0" * 16}
    assert len({r[2] for r in got if r[0] in (1, 2, 3)}) == 1


def test_one_of_each_group_stays(documents):
    docs = documents(ODD_TEXTS)
    out = s.keep_one(docs)
    assert out.columns == docs.columns
    kept = [(r["doc_id"], r["text"]) for r in out.collect()]
    assert sorted(k for k, _ in kept if k in (1, 2, 3)) == [1]
    assert sorted(k for k, _ in kept if k in (10, 11)) == [10]
    # A null text without an id is a copy of the empty ones.
    assert [t for k, t in kept if k is None] == ["a text without an id"]
    assert sorted(t for k, t in kept if k == 12) == ["one id", "two texts"]


def test_rows_are_told_apart_by_their_texts(documents):
    """Unlike texts under one id all stay; copies go whether they have an id or not; so do repeated rows."""
    long = "some words of a text that is long enough to have a fingerprint of its own " * 5
    rows = [(7, "first text under an id"), (7, "something quite unlike the other one")] * 2
    rows += [(None, "nobody's text"), (None, "nobody's text"), (None, "nobody's other and unlike text")]
    rows += [(9, long), (8, long), (None, long), (8, long)]
    got = sorted(((r["doc_id"], r["text"]) for r in s.keep_one(documents(rows)).collect()), key=str)
    expected = {*rows[:2], rows[4], rows[6], (8, long)}
    assert got == sorted(expected, key=str)


def test_empty_table(documents):
    empty = documents([(1, "a")]).where("false")
    assert s.near_duplicates(empty).collect() == []
    assert s.keep_one(empty).collect() == []
