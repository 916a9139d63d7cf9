"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are computed from the bytes of whole texts, many texts at once. Trees are grown on the driver from a sample
of labelled documents whose size, about, is a parameter (``max_labelled``; picked by a hash of doc_id, so the choice
doesn't depend on order): features fall into 64 bins, and each split is read off histograms of gradients. The trees are complete
to their depth and flattened into arrays, and all documents of a batch walk down a tree at once.

Labels come from rows whose crc32(doc_id as text) mod 3 is not 1. Several labels of a document count by their mean.

Nulls and edge cases: a null or empty text has statistics of zero and is scored like any other; a null doc_id is scored,
never held out and never learnt from; null labels don't count; without labels every score is 0.5, with labels of one
kind it is near that kind. Repeated rows are scored each. An empty table gives an empty result; other columns are left
out (``score_documents``) or kept as they are (``keep_good``).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.shared import columns, stored
from plumbline.llm.text_bytes import Block, blocks, chained, words

MAX_LABELLED = 20_000
TREES, DEPTH, RATE, BINS, REGULAR, LEAST_WEIGHT = 100, 4, 0.15, 64, 1.0, 2.0

_SPACES = [0x20, *range(0x09, 0x0E)]
_IS_WORD = np.ones(256, bool)
_IS_WORD[_SPACES] = False
#: Kinds of bytes whose shares are features.
KINDS = ("lower", "upper", "digit", "space", "line", "stop", "comma", "shout", "mark", "high")


def _kinds() -> np.ndarray:
    kind = np.full(256, KINDS.index("mark"), np.uint8)
    for name, values in (
        ("lower", range(ord("a"), ord("z") + 1)),
        ("upper", range(ord("A"), ord("Z") + 1)),
        ("digit", range(ord("0"), ord("9") + 1)),
        ("space", _SPACES),
        ("line", [0x0A]),
        ("stop", [ord(".")]),
        ("comma", [ord(c) for c in ",;:'\"()-"]),
        ("shout", [ord("!"), ord("?")]),
        ("high", range(0x80, 0x100)),
    ):
        kind[list(values)] = KINDS.index(name)
    return kind


_KIND = _kinds()
FEATURES = (
    "log_bytes", "log_words", *(f"{k}_share" for k in KINDS), "word_length", "word_length_spread", "longest_word",
    "distinct_words", "top_word", "repeated_pairs", "doubled_words", "lines_per_word", "capital_words",
)


def statistics(block: Block) -> np.ndarray:
    """A row of features for each text of the block."""
    n = block.size
    size = (block.ends - block.starts).astype(np.float64)
    owner = block.owners()
    kinds = _KIND[block.data]
    counts = np.bincount(owner * len(KINDS) + kinds, minlength=n * len(KINDS)).reshape(n, len(KINDS))
    w = words(block, _IS_WORD)
    number = np.bincount(w.owner, minlength=n).astype(np.float64)
    length = (w.ends - w.starts).astype(np.float64)
    mean = _per(np.bincount(w.owner, length, n), number)
    spread = np.sqrt(np.maximum(0, _per(np.bincount(w.owner, length**2, n), number) - mean**2))
    longest = np.zeros(n)
    np.maximum.at(longest, w.owner, length)
    distinct, top = _repeats(w.owner, w.hashes, n)
    same = w.owner[1:] == w.owner[:-1]
    pairs = chained(w.hashes, 2)[same] if len(w.hashes) > 1 else w.hashes[:0]
    pair_owner = w.owner[:-1][same] if len(w.hashes) > 1 else w.owner[:0]
    distinct_pairs, _ = _repeats(pair_owner, pairs, n)
    n_pairs = np.bincount(pair_owner, minlength=n)
    doubled = np.bincount(pair_owner[(w.hashes[1:] == w.hashes[:-1])[same]], minlength=n) if len(same) else np.zeros(n)
    capital = np.bincount(w.owner[kinds[w.starts] == KINDS.index("upper")], minlength=n)
    return np.stack(
        [
            np.log1p(size), np.log1p(number), *(_per(counts[:, k], size) for k in range(len(KINDS))),
            mean, spread, np.log1p(longest), _per(distinct, number), _per(top, number),
            1 - _per(distinct_pairs, np.maximum(n_pairs, 1)), _per(doubled, number),
            _per(counts[:, KINDS.index("line")], number), _per(capital, number),
        ],
        axis=1,
    ).astype(np.float32)


def _per(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.divide(part, whole, out=np.zeros(len(part)), where=whole > 0)


def _repeats(owner: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each owner, and how often its most frequent one occurs."""
    if not len(hashes):
        return np.zeros(n), np.zeros(n)
    # Owner in the high bits: one sort groups by owner and hash.
    key = np.sort((owner.astype(np.uint64) << np.uint64(40)) | (hashes >> np.uint64(24)))
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    who = (key[first] >> np.uint64(40)).astype(np.int64)
    times = np.diff(np.append(first, len(key)))
    top = np.zeros(n)
    np.maximum.at(top, who, times)
    return np.bincount(who, minlength=n), top


@dataclass
class Trees:
    """Complete trees: node k of a tree has the children 2k + 1 and 2k + 2; larger values go to the second."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        depth = int(np.log2(self.leaf.shape[1])) if len(self.leaf) else 0
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - (len(leaf) - 1)]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Trees:
    """Boosted trees for the logistic loss."""
    nodes, leaves = 2**depth - 1, 2**depth
    if not len(y):
        return Trees(0.0, np.zeros((0, nodes), int), np.zeros((0, nodes), np.float32), np.zeros((0, leaves)))
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS)[1:-1])).astype(np.float32) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    total = np.full(len(y), base)
    features = np.zeros((trees, nodes), np.int64)
    thresholds = np.full((trees, nodes), np.inf, np.float32)
    values = np.zeros((trees, leaves))
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        gradient, weight = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, many = 2**level - 1, 2**level
            local = node - first
            best = np.full(many, 1e-6)
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                key = local * BINS + binned[:, f]
                g = np.bincount(key, gradient, many * BINS).reshape(many, BINS).cumsum(axis=1)
                h = np.bincount(key, weight, many * BINS).reshape(many, BINS).cumsum(axis=1)
                ga, ha = g[:, -1:], h[:, -1:]
                gain = g**2 / (h + REGULAR) + (ga - g) ** 2 / (ha - h + REGULAR) - ga**2 / (ha + REGULAR)
                gain[(h < LEAST_WEIGHT) | (ha - h < LEAST_WEIGHT)] = 0
                gain = gain[:, : len(e)]
                at = gain.argmax(axis=1)
                value = gain[np.arange(many), at]
                better = value > best
                best[better] = value[better]
                features[t, first : first + many][better] = f
                thresholds[t, first : first + many][better] = e[at[better]]
            node = 2 * node + 1 + (x[np.arange(len(y)), features[t, node]] > thresholds[t, node])
        leaf = node - nodes
        g, h = np.bincount(leaf, gradient, leaves), np.bincount(leaf, weight, leaves)
        values[t] = -RATE * g / (h + REGULAR)
        total += values[t][leaf]
    return Trees(base, features, thresholds, values)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and its features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text")):
                x = statistics(block)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(block.first, block.size),
                     pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float32()))],
                    names=["doc_id", "x"],
                )

    return columns(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, x array<float>")


def learn(features: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Trees:
    """Trees from about ``max_labelled`` labelled documents, or all if there are fewer, outside the held-out third."""
    known = (
        columns(labels, doc_id="long", quality="double")
        .where("doc_id is not null and quality is not null")
        .groupBy("doc_id")
        .agg((F.avg("quality") >= 0.5).cast("double").alias("y"))
    )
    rows = features.where(~held_out()).join(known.withColumnRenamed("doc_id", "known_id"), F.col("doc_id") == F.col("known_id"))
    # A share by hash instead of the smallest hashes: each task sends its part of the sample only.
    share = min(1.0, max_labelled / max(1, rows.count()))
    picked = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32)) < int(share * (1 << 32))
    taken = rows.where(picked).select("doc_id", "x", "y").toPandas().sort_values("doc_id", kind="stable")
    width = len(FEATURES)
    x = np.stack(taken["x"].to_list()).astype(np.float32) if len(taken) else np.zeros((0, width), np.float32)
    return grow(x, taken["y"].to_numpy(np.float64))


def score_documents(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    features = stored(document_statistics(docs), "statistics")
    trees = learn(features, labels, max_labelled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)
            score = trees.scores(x)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    return features.select("doc_id", held_out().alias("held_out"), "x").mapInArrow(
        run, "doc_id long, held_out boolean, score double, predicted int"
    )


def keep_good(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """The rows, with all their columns, that score 0.5 or more."""
    trees = learn(stored(document_statistics(docs), "statistics"), labels, max_labelled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [trees.scores(statistics(block)) for block in blocks(batch.column("text"))]
            yield batch.filter(pa.array(np.concatenate([np.zeros(0), *parts]) >= 0.5))

    return docs.mapInArrow(run, docs.schema)
