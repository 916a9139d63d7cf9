import random

import pytest
from llm_data import ODD_TEXTS, documents, sha, sorted_rows  # noqa: F401

from plumbline.llm import suffix_dedup as s


def plain(rows):
    """All 100-byte strings in order of doc_id (nulls first); of equal ids in the order of the list."""
    first, out = set(), []
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for x in range(len(data) - 99):
            w = data[x : x + 100]
            if w in first:
                gone[x : x + 100] = b"\1" * 100
            else:
                first.add(w)
        kept = bytes(c for c, g in zip(data, gone, strict=True) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(data), sum(gone), spans, sha(kept)))
    return out


def prose(rnd, words, n):
    return " ".join(rnd.choice(words) for _ in range(n))


def corpus(seed, n):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randrange(1, 9))) for _ in range(300)]
    passages = [prose(rnd, words, rnd.randrange(10, 60)) for _ in range(12)]
    phrase = prose(rnd, words, 12)[:60]
    rows = []
    for k in range(n):
        text = prose(rnd, words, rnd.randrange(0, 80))
        for _ in range(rnd.randrange(0, 3)):
            p = rnd.choice(passages)
            text += f" {p[rnd.randrange(len(p)) :]} {prose(rnd, words, rnd.randrange(0, 20))}"
        if rnd.random() < 0.5:
            text += phrase + prose(rnd, words, 5)
        if rnd.random() < 0.2 and rows:
            text = rows[rnd.randrange(len(rows))][1] or ""
        if rnd.random() < 0.1:
            text = "a" * rnd.randrange(90, 400)
        if rnd.random() < 0.1:
            text = "ab\x00" * rnd.randrange(30, 90)
        rows.append((rnd.randrange(10**6) * 1000 + k, text if rnd.random() > 0.05 else None))
    return rows


@pytest.mark.parametrize("hot", [512, 1, 0])
def test_documents(documents, monkeypatch, hot):
    """Small slices and ranges; from 0 on every shared gram is dealt out by windows."""
    monkeypatch.setattr(s, "SLICE", 500)
    monkeypatch.setattr(s, "RANGE_BYTES", 5_000)
    monkeypatch.setattr(s, "STEP", 700)
    rows = corpus(3, 150)
    got = s.digest(s.remove_repeats(documents(rows).repartition(5), keep=False, hot_chunks=hot)).collect()
    expected = plain(rows)
    assert sum(e[2] for e in expected) > 10_000
    assert sorted_rows(got) == sorted_rows(expected)


def test_odd_texts_and_kept_bytes(documents):
    rows = [r for r in ODD_TEXTS if r[0] != 12] + [(12, "one text"), (13, "é" * 80), (14, "xé" + "é" * 79)]
    got = s.remove_repeats(documents(rows)).collect()
    assert sorted_rows(tuple(r)[:5] for r in got) == sorted_rows(plain(rows))
    assert all(sha(bytes(r["kept"])) == r["kept_sha256"] for r in got)


def test_repeated_rows_lose_all_but_one(documents):
    text = "".join(random.Random(1).choices("abcdefghij", k=150))
    got = s.remove_repeats(documents([(1, text)] * 3 + [(None, text)])).collect()
    assert sorted(r["n_removed"] for r in got) == [0, 150, 150, 150]
    assert [r["doc_id"] for r in got if not r["n_removed"]] == [None]


def test_ranges_are_even():
    """The hashes that pick anchors are small ones; those that deal records out must not be."""
    import numpy as np

    rng = np.random.default_rng(1)
    data = rng.integers(97, 123, 400_000, dtype=np.uint8)
    chunk = s.Chunk(0, np.zeros(1, np.int64), np.zeros(1, bool), np.array([len(data)]), data)
    a = s.anchors(chunk)
    counts = np.bincount(s._ranges(a.hash, 16), minlength=16)
    assert 20 < len(data) / len(a.at) < 40 and counts.max() < 1.2 * counts.mean()


def test_empty_table(documents):
    assert s.remove_repeats(documents([(1, "a")]).where("false")).collect() == []


def test_loser_tree_never_compares_known_prefixes():
    """Merged order and shared lengths equal those of one sorted list, for any number of runs."""
    rnd = random.Random(5)
    for n in (1, 2, 3, 5, 8):
        lists = [
            sorted(
                {
                    bytes(rnd.choice(b"ab") for _ in range(12)) + bytes(s.WIDTH - 12)
                    for _ in range(rnd.randrange(1, 30))
                }
            )
            for _ in range(n)
        ]
        runs = []
        for keys in lists:
            shared, rest, last = [], [], b""
            for key in keys:
                k = next((i for i, (x, y) in enumerate(zip(key, last, strict=False)) if x != y), 0)
                shared.append(k)
                rest.append(key[k:])
                last = key
            packed = s.pa.compress(b"".join(rest), "zstd", asbytes=True)
            runs.append(s.Run({"shared": bytes(shared), "rest": packed}))
        out, lengths = [], []
        for r, k, shared in s.merge(runs):
            assert runs[r].at == k
            out.append(runs[r].key)
            lengths.append(shared)
        assert out == sorted(x for keys in lists for x in keys)
        for a, b, k in zip(out, out[1:], lengths[1:], strict=False):
            assert k == next((i for i, (x, y) in enumerate(zip(a, b, strict=True)) if x != y), s.WIDTH)


@pytest.mark.parametrize("records, level", [(5_000, 1), (1_000, 2)])
def test_grams_are_hot_by_their_records(spark, records, level):
    """A phrase in 600 chunks, twice in each, is dealt out by windows only if its records are too many for one range."""
    import numpy as np

    def packed(values, kind):
        return np.array(values, kind).tobytes()

    rows = [(0, chunk, packed([7, 1000 + chunk], np.uint64), packed([2, 1], np.uint16)) for chunk in range(600)]
    hashes = spark.createDataFrame(rows, "range long, chunk long, hashes binary, counts binary")
    assert {bytes(r["seen"]) for r in s.shared_grams(hashes, records).collect()} == {bytes([level, 0])}


def test_hot_records_leave_the_result(documents, monkeypatch):
    monkeypatch.setattr(s, "SLICE", 500)
    monkeypatch.setattr(s, "HOT_RECORDS", 5)
    rows = corpus(4, 60)
    got = s.digest(s.remove_repeats(documents(rows).repartition(5), keep=False)).collect()
    assert sorted_rows(got) == sorted_rows(plain(rows))
