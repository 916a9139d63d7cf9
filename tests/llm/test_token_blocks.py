import random
import zlib

import numpy as np
import pytest
from llm_data import ODD_TEXTS, documents  # noqa: F401
from test_packing import ids_of

from plumbline.llm import token_blocks as b


@pytest.mark.parametrize("width", [0, 1, 7, 16, 17, 31, 32])
def test_bits_round_trip(width):
    rng = np.random.default_rng(width)
    values = rng.integers(0, 1 << width, (3, b.BLOCK), dtype=np.uint64)
    assert (b.unpack_bits(b.pack_bits(values, width), width) == values).all()


def test_segment_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 1023, 1024, 1025, 5000):
        for top in (1, 2, 300, 50_000, 1 << 32):
            ids = rng.integers(0, top, n, dtype=np.uint64).astype(np.uint32)
            if n > 100:
                ids[rng.integers(0, n, 9)] = np.iinfo(np.uint32).max  # exceptions
            counts = [n] if n else []
            data = b.encode_segment(ids, [None] * len(counts), counts)
            got, keys, sizes = b.decode_segment(data)
            assert (got == ids).all() and keys == [None] * len(counts) and sizes.tolist() == counts


def test_outliers_cost_little():
    ids = np.arange(1024, dtype=np.uint32) % 16
    narrow = len(b.encode_segment(ids, [1], [1024]))
    ids[:20] = 1 << 30
    assert len(b.encode_segment(ids, [1], [1024])) == narrow + 20 * 6


def test_documents(documents):
    rnd = random.Random(2)
    texts = ODD_TEXTS + [(100 + k, "word text " * rnd.randrange(0, 300)) for k in rnd.sample(range(500), 60)]
    docs = documents(texts).repartition(5)
    folder = b.written(docs)
    rows = b.digest(b.read_tokens(docs.sparkSession, folder)).collect()
    # Equal ids may come in any order; each run of them is compared as a whole.
    left = [(i, [*ids_of(t), b.END_ID]) for i, t in texts]
    at = 0
    for r in sorted(rows, key=lambda r: r["start"]):
        assert r["start"] == at
        least = min((i for i, _ in left), key=lambda i: (i is not None, i or 0))
        crc = {zlib.crc32(np.array(ids, "<u4").tobytes()): k for k, (i, ids) in enumerate(left) if i == least}
        assert r["doc_id"] == least
        _, ids = left.pop(crc[r["ids_crc32"]])
        assert r["n_tokens"] == len(ids)
        at += len(ids)
    assert not left


def test_small_segments(documents, tmp_path):
    texts = [(k, "some words " * k) for k in range(40)]
    docs = documents(texts)
    b.write_tokens(docs, str(tmp_path / "t"), segment_ids=50)
    rows = b.read_tokens(docs.sparkSession, str(tmp_path / "t")).collect()
    at = 0
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        ids = [*ids_of(texts[r["doc_id"]][1]), b.END_ID]
        assert (r["start"], np.frombuffer(r["ids"], "<u4").tolist()) == (at, ids)
        at += len(ids)


def test_empty_table(documents):
    docs = documents([(1, "a")]).where("false")
    assert b.digest(b.read_tokens(docs.sparkSession, b.written(docs))).collect() == []
