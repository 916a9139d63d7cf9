import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from llm_data import DATA, ODD_TEXTS, documents  # noqa: F401
from tokenizers import Tokenizer

import corpus_pipeline
from plumbline.llm import packing as p
from plumbline.llm import queries, tokens
from plumbline.llm.tokens import WordEncoder, default_path

LIBRARY = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def test_remembered_words_equal_the_library():
    encoder = WordEncoder(default_path())
    rnd = random.Random(1)
    parts = [
        "The", "word,", "É", "é", " ́", "it's", "'s", "don't", "x1y22", "<|endoftext|>", "a<|startoftext|>b", " ",
        " ", "\x1c", "ΑΣ", "Σ", "İ", "ﬁ", "漢字", "\U0001f600", "...", "|", "***", "ß", "ǅ", "_", "\t", "\r\n", "÷×", "ÿ", "Ÿ",
    ]
    for _ in range(600):
        text = "".join(rnd.choice(parts) + rnd.choice(["", " ", "\n", "  "]) for _ in range(rnd.randrange(0, 12)))
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == ids_of(text), repr(text)
    assert encoder.plain


def test_blocks_of_texts_equal_the_library(monkeypatch):
    rnd = random.Random(7)
    parts = ["The", "word,", "É", "it's", "<|endoftext|>", " ", " ", "漢字", "\U0001f600", "\t", "\r\n", "x" * 300, "\n", "  "]
    texts = [None, "", " ", "\n\n"] + ["".join(rnd.choice(parts) for _ in range(rnd.randrange(0, 30))) for _ in range(400)]
    texts += [None, "", "last"]
    for size in (1, 50, 5_000, 1 << 21):
        monkeypatch.setattr(tokens, "BLOCK_BYTES", size)
        at = 0
        for block in tokens.token_blocks(WordEncoder(default_path()), pa.array(texts), 9):
            assert block.first == at
            ends = np.cumsum(block.counts)
            for n, end in zip(block.counts.tolist(), ends.tolist(), strict=True):
                assert block.ids[end - n : end].tolist() == [*ids_of(texts[at]), 9]
                at += 1
            assert len(block.ids) == ends[-1]
        assert at == len(texts)


@pytest.mark.parametrize("seed", range(6))
def test_fullest_combination(seed):
    rnd = random.Random(seed)
    lengths = sorted(rnd.sample(range(1, 30), 6), reverse=True)
    counts = [rnd.randrange(1, 4) for _ in lengths]
    room = rnd.randrange(1, 70)
    sums = {0}
    for length, count in zip(lengths, counts, strict=True):
        sums = {s + k * length for s in sums for k in range(count + 1) if s + k * length <= room}
    found = p.fullest(room, lengths, counts)
    assert sum(k * n for k, n in found) == max(sums)
    have = dict(zip(lengths, counts, strict=True))
    assert all(n <= have[k] for k, n in found)


def test_plan_places_every_piece_once():
    rnd = random.Random(2)
    for _ in range(30):
        histogram = {rnd.randrange(1, 65): rnd.randrange(1, 40) for _ in range(rnd.randrange(1, 30))}
        rows = p.plan(histogram, 64)
        for length, count in histogram.items():
            own = rows[rows["length"] == length]
            assert own["rank"].tolist() == [0, *np.cumsum(own["times"])[:-1].tolist()]
            assert own["times"].sum() == count
        lengths = p.packed_lengths(rows)
        assert all(0 < n <= 64 for n in lengths)
        assert sum(lengths) == sum(k * n for k, n in histogram.items())


def test_plan_is_near_the_least_number():
    rnd = np.random.default_rng(3)
    lengths = np.minimum(2048, rnd.lognormal(6, 1, 50_000).astype(int) + 1)
    values, counts = np.unique(lengths, return_counts=True)
    n = len(p.packed_lengths(p.plan(dict(zip(values.tolist(), counts.tolist(), strict=True)))))
    assert n <= -(-lengths.sum() // 2048) + 1


def check(rows, texts, capacity):
    expected = defaultdict(int)
    for i, t in texts:
        ids = [*ids_of(t), p.END_ID]
        for piece, start in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[start : start + capacity], "<u4").tobytes()
            expected[i, piece, start, len(part) // 4, zlib.crc32(part)] += 1
    got, sequences = defaultdict(int), defaultdict(list)
    for r in rows:
        got[r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]] += 1
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert got == expected
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return sequences


def test_documents(documents):
    rnd = random.Random(4)
    texts = ODD_TEXTS + [(100 + k, "word " * rnd.randrange(0, 200)) for k in range(80)]
    texts += [(300, "equal length text")] * 30
    sequences = check(p.pack(documents(texts), 64).collect(), texts, 64)
    total = sum(len(ids_of(t)) + 1 for _, t in texts)
    assert len(sequences) <= -(-total // 64) + 2


def test_sequences_hold_the_ids(documents):
    texts = [*ODD_TEXTS[:7], (50, "one more text of some words")]
    rows = p.sequences(p.pack(documents(texts), 32, keep_ids=True)).collect()
    by_id = {i: [*ids_of(t), p.END_ID] for i, t in texts if i is not None}
    seen = 0
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(ids) == sum(r["lengths"]) <= 32
        for i, piece, offset, length in zip(r["doc_ids"], r["pieces"], r["offsets"], r["lengths"], strict=True):
            seen += 1
            if i is not None:
                assert ids[offset : offset + length] == by_id[i][32 * piece : 32 * piece + length]
    assert seen == sum(-(-(len(ids_of(t)) + 1) // 32) for _, t in texts)


def test_query_reads_stored_sequences(documents):
    """The digest follows the stored bytes: other bytes in their place give other checksums."""
    texts = ODD_TEXTS + [(100 + k, "word " * (k % 90)) for k in range(200)]
    table = p.written(documents(texts), 64)
    check(p.digest(table).collect(), texts, 64)
    other = table.withColumn("ids", p.F.expr("cast(repeat('x', length(ids)) as binary)"))
    assert all(r["ids_crc32"] == zlib.crc32(b"x" * 4 * r["length"]) for r in p.digest(other).collect())
    total = sum(len(r["ids"]) for r in table.collect())
    assert total == 4 * sum(len(ids_of(t)) + 1 for _, t in texts)


def test_query_and_pipeline_keep_the_ids(spark, monkeypatch):
    """Both store a table of sequences that holds every token, each sequence once."""
    kept = []
    monkeypatch.setattr(p, "stored", lambda *a, real=p.stored: kept.append((a[1], real(*a))) or kept[-1][1])
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for rows in (queries.op4_best_fit_packing(spark, DATA), corpus_pipeline.packing_stage(spark, docs, DATA)):
        pieces = rows.collect()
        table = [f for name, f in kept if name == "sequences"][-1].collect()
        held = {r["sequence_id"]: r["ids"] for r in table}
        assert len(held) == len(table)
        assert sum(map(len, held.values())) == 4 * sum(r["length"] for r in pieces)
        for r in pieces:
            part = held[r["sequence_id"]][4 * r["offset"] :][: 4 * r["length"]]
            assert zlib.crc32(part) == r["ids_crc32"]


def test_sequences_across_batches(documents, spark):
    """Sequences that a batch's end cuts come out whole."""
    texts = [(k, "word " * (k % 40)) for k in range(300)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        check(p.digest(p.sequences(p.pack(documents(texts), 64, keep_ids=True))).collect(), texts, 64)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_empty_table(documents):
    assert p.pack(documents([(1, "a")]).where("false")).collect() == []
