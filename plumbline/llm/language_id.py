"""Language identification by prediction by partial matching.

For each language a tree of byte contexts of up to three bytes holds how often each byte followed. A byte costs
-log2(n / (T + D)) bits in the longest context that knows it, with T bytes seen after that context and D different
ones; each longer context that doesn't know it charges its escape, -log2(D / (T + D)); behind the empty context all
256 bytes are equally likely. Statistics are frozen: the code length of a text is the exact sum of its bytes' costs, and
the language with the shortest code wins. The score is that language's posterior from the code lengths.

Counts come from all training texts (lower case), in Spark: tasks count four-byte strings, partial counts are added up.
The trees follow from the strings and their counts. ``max_strings`` bounds a language's tree: if it has more strings,
those with the smallest counts are left out of the frozen tree, by powers of 2 ** (1/8) of the count.

Learnt from rows with a language whose crc32(doc_id as text) mod 3 is not 1.

Nulls and edge cases: a null text, or one without a letter, is ``und`` with score 0; so is all if nothing can be learnt.
A null doc_id is predicted, never held out and never learnt from. Equal code lengths go to the first language by name.
Repeated rows are predicted each. An empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.quality_classifier import held_out
from plumbline.llm.shared import columns, stored
from plumbline.llm.text_bytes import Block, blocks

ORDER = 3
MAX_STRINGS, MAX_LANGUAGES = 200_000, 256
#: Counted strings a task holds before it passes them on.
HELD_STRINGS = 1 << 20
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")


def strings(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """For each byte the number made of it and the three bytes before it in its text (zeros before the start); and
    where each text starts among them."""
    data = block.data.astype(np.uint32)
    code = data.copy()
    place = np.arange(len(data)) - np.repeat(block.starts, block.ends - block.starts)
    for back in range(1, ORDER + 1):
        earlier = np.zeros(len(data), np.uint32)
        earlier[back:] = data[:-back]
        earlier[place < back] = 0
        code |= earlier << np.uint32(8 * back)
    return code, block.starts


@dataclass
class ContextTree:
    """Strings with their costs by order, longest first, and the escape costs of contexts."""

    codes: list[np.ndarray]
    bits: list[np.ndarray]
    contexts: list[np.ndarray]
    escapes: list[np.ndarray]

    @classmethod
    def grown(cls, code: np.ndarray, n: np.ndarray) -> ContextTree:
        """From counted four-byte strings; shorter strings are their ends."""
        tree = cls([], [], [], [])
        for order in range(ORDER, -1, -1):
            known, where = np.unique(code & np.uint32((1 << 8 * (order + 1)) - 1), return_inverse=True)
            count = np.bincount(where, n)
            contexts, of = np.unique(known >> np.uint32(8), return_inverse=True)
            total, different = np.bincount(of, count), np.bincount(of)
            tree.codes.append(known)
            tree.bits.append(-np.log2(count / (total + different)[of]))
            tree.contexts.append(contexts)
            tree.escapes.append(-np.log2(different / (total + different)))
        return tree

    def cost(self, code: np.ndarray) -> np.ndarray:
        """Bits of the last byte of each string after the ones before it."""
        out = np.zeros(len(code))
        open_ = np.arange(len(code))
        for order, known, bits, contexts, escapes in zip(
            range(ORDER, -1, -1), self.codes, self.bits, self.contexts, self.escapes, strict=True
        ):
            part = code[open_] & np.uint32(0xFFFFFFFF >> (8 * (ORDER - order)))
            at, found = _look_up(known, part)
            out[open_[found]] += bits[at[found]]
            open_, part = open_[~found], part[~found]
            at, seen = _look_up(contexts, part >> np.uint32(8))
            out[open_[seen]] += escapes[at[seen]]
        out[open_] += 8
        return out


def _look_up(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def count_strings(rows: DataFrame) -> DataFrame:
    """lang, code and n over all rows (lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def passed() -> Iterator[pa.RecordBatch]:
            for lang, (code, n) in held.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(code)), pa.array(code.astype(np.int64)), pa.array(n)], names=["lang", "code", "n"]
                )

        for batch in batches:
            langs = batch.column("lang")
            for lang in langs.unique().to_pylist():
                own = batch.filter(pc.equal(langs, lang))
                for block in blocks(own.column("text")):
                    code, n = np.unique(strings(block)[0], return_counts=True)
                    if lang in held:
                        code = np.concatenate([held[lang][0], code])
                        n = np.concatenate([held[lang][1], n])
                        code, where = np.unique(code, return_inverse=True)
                        n = np.bincount(where, n).astype(np.int64)
                    held[lang] = code, n
            if sum(len(c) for c, _ in held.values()) > HELD_STRINGS:
                yield from passed()
                held = {}
        yield from passed()

    counted = rows.mapInArrow(run, "lang string, code long, n long")
    return counted.groupBy("lang", "code").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame, max_strings: int = MAX_STRINGS) -> dict[str, ContextTree]:
    """A tree for each language. At most ``max_strings`` rows for each of ``MAX_LANGUAGES`` reach the driver."""
    rows = columns(docs, doc_id="long", text="string", lang="string").where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()
    )
    counted = stored(count_strings(rows.select("lang", F.lower("text").alias("text"))), "strings")
    size = F.floor(F.log2("n") * 8).cast("int")
    sizes = counted.groupBy("lang", size.alias("size")).agg(F.count("*").alias("n")).collect()
    by_lang: dict[str, dict[int, int]] = {}
    for r in sizes:
        by_lang.setdefault(r["lang"], {})[r["size"]] = r["n"]
    if len(by_lang) > MAX_LANGUAGES:
        raise ValueError(f"{len(by_lang)} languages; {MAX_LANGUAGES} are possible")
    least = F.lit(0)
    for lang, found in by_lang.items():
        kept, cut = 0, 0
        for s in sorted(found, reverse=True):
            kept += found[s]
            if kept > max_strings:
                cut = s + 1
                break
        least = F.when(F.col("lang") == lang, cut).otherwise(least)
    table = counted.where(size >= least).toArrow()
    trees = {}
    for lang in sorted(by_lang):
        own = table.filter(pc.equal(table.column("lang"), lang))
        if own.num_rows:
            code = own.column("code").to_numpy().astype(np.uint32)
            trees[lang] = ContextTree.grown(code, own.column("n").to_numpy().astype(np.float64))
    return trees


def code_lengths(block: Block, trees: list[ContextTree]) -> np.ndarray:
    """Bits of each text (row) under each tree (column)."""
    code, starts = strings(block)
    out = np.zeros((block.size, len(trees)))
    filled = block.ends > block.starts
    if filled.any():
        # Each different string is priced once.
        different, where = np.unique(code, return_inverse=True)
        for k, tree in enumerate(trees):
            out[filled, k] = np.add.reduceat(tree.cost(different)[where], starts[filled])
    return out


def predict(docs: DataFrame, trees: dict[str, ContextTree]) -> DataFrame:
    """doc_id, held_out, lang_pred, score and bits_per_byte of every document."""
    names, models = list(trees), list(trees.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text")):
                texts = batch.column("text").slice(block.first, block.size).to_pylist()
                found, score, rate = [UNKNOWN] * block.size, np.zeros(block.size), np.zeros(block.size)
                if models:
                    bits = code_lengths(block, models)
                    best = bits.argmin(axis=1)
                    least = bits[np.arange(block.size), best]
                    posterior = 1 / np.exp2(-np.minimum(bits - least[:, None], 1000)).sum(axis=1)
                    for i, text in enumerate(texts):
                        if text and _LETTER.search(text):
                            found[i], score[i] = names[best[i]], posterior[i]
                            rate[i] = least[i] / (block.ends[i] - block.starts[i])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(block.first, block.size),
                        batch.column("held_out").slice(block.first, block.size),
                        pa.array(found, pa.string()),
                        pa.array(score),
                        pa.array(rate),
                    ],
                    names=["doc_id", "held_out", "lang_pred", "score", "bits_per_byte"],
                )

    rows = columns(docs, doc_id="long", text="string").select(
        "doc_id", held_out().alias("held_out"), F.lower("text").alias("text")
    )
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, bits_per_byte double")


def identify(docs: DataFrame, max_strings: int = MAX_STRINGS) -> DataFrame:
    """Learns from the table and predicts all of it."""
    return predict(docs, learn(docs, max_strings))
