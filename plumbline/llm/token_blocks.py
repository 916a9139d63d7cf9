"""Token ids in patched frame-of-reference blocks.

Ids are cut into blocks of 1,024. From each id of a block its minimum is subtracted; the rest is packed at a width that
holds a chosen share of the block (a percentile), and the high bits of the few larger ones go to an exception list. A
segment is one file image: header, document index, block index (byte starts), blocks. Segments are rows of a Parquet
table, since only Spark's writers reach every store, commit whole task results and survive lost executors; ``shard``
and ``segment`` order them.

Layout of a segment, little-endian: ``PFR1``; documents, ids, blocks (uint64 each); doc_ids (int64), null flags
(uint8), id counts (uint64); block starts (uint64, from the first block, one more than blocks); then per block: minimum
(uint32), width (uint8), exceptions (uint16), packed ids (16 * width uint64), positions (uint16), high bits (uint32).

Nulls and edge cases: a null or empty text has the end id only; a null doc_id sorts first and stays null; each repeated
row is written; documents with equal doc_id are ordered by a hash of their text; an empty table gives an empty result;
other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.shared import columns, scratch
from plumbline.llm.tokens import default_path, encoder, token_blocks

BLOCK = 1024
LANES = 64
SHARE = 0.95
END_ID = 1
#: A segment is closed when it holds this many ids.
SEGMENT_IDS = 1 << 20
MAGIC = b"PFR1"


def pack_bits(values: np.ndarray, width: int) -> np.ndarray:
    """(n, BLOCK) numbers below 2**width as (n, 16 * width) words: bit streams of 64 numbers in ``width`` words each."""
    rows = values.astype(np.uint64).reshape(-1, LANES)
    out = np.zeros((len(rows), width), np.uint64)
    for i in range(LANES if width else 0):
        word, shift = divmod(i * width, 64)
        out[:, word] |= rows[:, i] << np.uint64(shift)
        if shift + width > 64:
            out[:, word + 1] |= rows[:, i] >> np.uint64(64 - shift)
    return out.reshape(len(values), -1)


def unpack_bits(words: np.ndarray, width: int) -> np.ndarray:
    n = len(words)
    out = np.zeros((n * BLOCK // LANES, LANES), np.uint64)
    rows = words.reshape(-1, width) if width else words
    mask = np.uint64((1 << width) - 1)
    for i in range(LANES if width else 0):
        word, shift = divmod(i * width, 64)
        value = rows[:, word] >> np.uint64(shift)
        if shift + width > 64:
            value |= rows[:, word + 1] << np.uint64(64 - shift)
        out[:, i] = value & mask
    return out.reshape(n, BLOCK)


def bit_lengths(values: np.ndarray) -> np.ndarray:
    """Bits of numbers below 2**32."""
    return np.frexp(values.astype(np.float64))[1]


def encode_segment(ids: np.ndarray, doc_ids: list[int | None], counts: list[int], share: float = SHARE) -> bytes:
    blocks = -(-len(ids) // BLOCK)
    padded = np.zeros(blocks * BLOCK, np.uint32)
    padded[: len(ids)] = ids
    padded[len(ids) :] = ids[(blocks - 1) * BLOCK :].min() if len(ids) else 0
    rows = padded.reshape(blocks, BLOCK)
    least = rows.min(axis=1, initial=np.iinfo(np.uint32).max) if blocks else np.zeros(0, np.uint32)
    rest = rows - least[:, None]
    at = min(BLOCK - 1, int(share * BLOCK))
    widths = bit_lengths(np.partition(rest, at, axis=1)[:, at]) if blocks else np.zeros(0, int)
    bodies: list[bytes] = [b""] * blocks
    for width in np.unique(widths).tolist():
        here = np.flatnonzero(widths == width)
        low = rest[here] & np.uint32((1 << width) - 1)
        packed = pack_bits(low, width)
        high = (rest[here].astype(np.uint64) >> np.uint64(width)).astype(np.uint32)
        large = high > 0
        for k, block in enumerate(here.tolist()):
            places = np.flatnonzero(large[k])
            bodies[block] = b"".join(
                (
                    int(least[block]).to_bytes(4, "little"),
                    width.to_bytes(1, "little"),
                    len(places).to_bytes(2, "little"),
                    packed[k].tobytes(),
                    places.astype("<u2").tobytes(),
                    high[k][places].astype("<u4").tobytes(),
                )
            )
    starts = np.zeros(blocks + 1, "<u8")
    np.cumsum([len(b) for b in bodies], out=starts[1:])
    head = np.array([len(doc_ids), len(ids), blocks], "<u8")
    return b"".join(
        (
            MAGIC,
            head.tobytes(),
            np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
            bytes(d is None for d in doc_ids),
            np.array(counts, "<u8").tobytes(),
            starts.tobytes(),
            *bodies,
        )
    )


def decode_segment(data: bytes) -> tuple[np.ndarray, list[int | None], np.ndarray]:
    """Ids, doc_ids and id counts of a segment."""
    if data[:4] != MAGIC:
        raise ValueError("not a segment")
    docs, n, blocks = (int(x) for x in np.frombuffer(data, "<u8", 3, 4))
    at = 28
    keys = np.frombuffer(data, "<i8", docs, at).tolist()
    nulls = data[at + 8 * docs : at + 9 * docs]
    counts = np.frombuffer(data, "<u8", docs, at + 9 * docs).astype(np.int64)
    at += 17 * docs
    starts = np.frombuffer(data, "<u8", blocks + 1, at).astype(np.int64)
    at += 8 * (blocks + 1)
    raw = np.frombuffer(data, np.uint8, offset=at)
    first = starts[:-1]
    least = raw[first[:, None] + np.arange(4)].copy().view("<u4").ravel().astype(np.uint64)
    widths = raw[first + 4]
    exceptions = raw[first[:, None] + np.arange(5, 7)].copy().view("<u2").ravel().astype(np.int64)
    out = np.zeros((blocks, BLOCK), np.uint64)
    for width in np.unique(widths).tolist():
        here = np.flatnonzero(widths == width)
        size = BLOCK * width // 8
        words = raw[first[here][:, None] + 7 + np.arange(size)].copy().view("<u8")
        values = unpack_bits(words, width)
        for k in np.flatnonzero(exceptions[here]).tolist():
            begin, count = int(first[here[k]]) + 7 + size, int(exceptions[here[k]])
            places = np.frombuffer(data, "<u2", count, at + begin)
            high = np.frombuffer(data, "<u4", count, at + begin + 2 * count).astype(np.uint64)
            values[k, places] |= high << np.uint64(width)
        out[here] = values
    ids = (out + least[:, None]).ravel()[:n].astype("<u4")
    return ids, [None if z else k for k, z in zip(keys, nulls, strict=True)], counts


def write_tokens(docs: DataFrame, folder: str, path: str | None = None, segment_ids: int = SEGMENT_IDS) -> None:
    """Encodes all texts, appends the end id to each and writes the segments in ascending doc_id order to ``folder``."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(path)
        shard = TaskContext.get().partitionId()
        segment = before = size = 0
        parts: list[np.ndarray] = []
        keys: list[int | None] = []
        counts: list[int] = []

        def closed() -> pa.RecordBatch:
            ids = np.concatenate(parts)
            payload = encode_segment(ids, keys, counts)
            row = {"shard": shard, "segment": segment, "n_docs": len(keys), "n_ids": len(ids), "before": before}
            return pa.RecordBatch.from_pylist([row | {"payload": payload}], schema=_SEGMENT)

        for batch in batches:
            for block in token_blocks(words, batch.column("text"), END_ID):
                ids = batch.column("doc_id").slice(block.first, len(block.counts)).to_pylist()
                ends = np.cumsum(block.counts)
                at = done = 0
                while at < len(ids):
                    # Up to the text that fills the segment.
                    till = min(len(ids), int(np.searchsorted(ends, done + segment_ids - size)) + 1)
                    parts.append(block.ids[done : ends[till - 1]])
                    keys += ids[at:till]
                    counts += block.counts[at:till].tolist()
                    size += int(ends[till - 1]) - done
                    at, done = till, int(ends[till - 1])
                    if size >= segment_ids:
                        yield closed()
                        segment, before, size, parts, keys, counts = segment + 1, before + size, 0, [], [], []
        if parts:
            yield closed()

    rows = columns(docs, doc_id="long", text="string")
    ordered = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    ordered.mapInArrow(
        run, "shard int, segment int, n_docs long, n_ids long, before long, payload binary"
    ).write.option("compression", "none").parquet(folder)


_SEGMENT = pa.schema(
    [
        ("shard", pa.int32()),
        ("segment", pa.int32()),
        ("n_docs", pa.int64()),
        ("n_ids", pa.int64()),
        ("before", pa.int64()),
        ("payload", pa.binary()),
    ]
)


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids before the document) and ids (little-endian 32 bit) of all documents in the files.

    Only the shards' sizes, one number for each writing task, come to the driver.
    """
    segments = spark.read.parquet(folder)
    sizes = {r["shard"]: r["n"] for r in segments.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect()}
    starts, total = {}, 0
    for shard in sorted(sizes):
        starts[shard] = total
        total += sizes[shard]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, keys, counts = decode_segment(batch.column("payload")[i].as_py())
                begin = starts[batch.column("shard")[i].as_py()] + batch.column("before")[i].as_py()
                ends = np.cumsum(counts)
                for at in range(0, len(keys), 1000):
                    till = ends[at : at + 1000]
                    own = counts[at : at + 1000]
                    parts = [ids[e - c : e].tobytes() for e, c in zip(till.tolist(), own.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys[at : at + 1000], pa.int64()), pa.array(begin + till - own), pa.array(parts, pa.binary())],
                        names=["doc_id", "start", "ids"],
                    )

    return segments.select("shard", "before", "payload").mapInArrow(run, "doc_id long, start long, ids binary")


def digest(tokens: DataFrame) -> DataFrame:
    """Counts and checksums of the ids that were read."""
    return tokens.select(
        "doc_id",
        "start",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"),
    )


def written(docs: DataFrame, path: str | None = None) -> str:
    """Writes to a new folder in the shared place and returns it."""
    folder = scratch(docs.sparkSession, "tokens")
    write_tokens(docs, folder, path)
    return folder


