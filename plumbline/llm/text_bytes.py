"""Vectorised views of the UTF-8 bytes of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes that are handled at once, about; one text may be longer.
BLOCK = 1 << 20


@dataclass
class Block:
    """Texts as one byte array; text i is data[starts[i] : ends[i]]. ``first`` is the number of text 0 in its batch."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: int

    @property
    def size(self) -> int:
        return len(self.starts)

    def owners(self) -> np.ndarray:
        """The text of each byte."""
        return np.repeat(np.arange(self.size), self.ends - self.starts)


def blocks(texts: pa.Array, size: int = BLOCK) -> Iterator[Block]:
    """Texts (nulls as empty) in blocks of ``size`` bytes or one text."""
    texts = texts.fill_null("").cast(pa.large_binary())
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        till = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
        base = offsets[at]
        yield Block(data[base : offsets[till]], offsets[at:till] - base, offsets[at + 1 : till + 1] - base, at)
        at = till


#: Odd multipliers of the word hashes.
_STEP = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.full(256, _STEP))


@dataclass
class Words:
    """Maximal runs of word bytes: byte ranges, owning text and a 64-bit hash of each."""

    starts: np.ndarray
    ends: np.ndarray
    owner: np.ndarray
    hashes: np.ndarray


def words(block: Block, is_word: np.ndarray) -> Words:
    """The words of a block; ``is_word`` says for each byte value whether it belongs to words. Texts don't join."""
    inside = is_word[block.data]
    opens = np.append(True, ~inside[:-1]) & inside if len(inside) else inside
    closes = np.append(~inside[1:], True) & inside if len(inside) else inside
    edges = block.starts[block.ends > block.starts]
    opens[edges] = inside[edges]
    before = edges[edges > 0] - 1
    closes[before] = inside[before]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    if not len(starts):
        none = np.zeros(0, np.int64)
        return Words(none, none, none, np.zeros(0, np.uint64))
    lengths = ends - starts
    at = np.flatnonzero(inside)
    place = np.arange(len(at)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    value = (block.data[at].astype(np.uint64) + np.uint64(1)) * _POWERS[place & 255]
    hashes = mixed(np.add.reduceat(value, np.cumsum(lengths) - lengths) + lengths.astype(np.uint64))
    owner = np.searchsorted(block.ends, starts, side="right")
    return Words(starts, ends, owner, hashes)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads each bit over all 64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chained(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all windows of ``n`` words (of the block, across texts too)."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for k in range(n):
        out = out * _STEP + hashes[k : len(hashes) - n + 1 + k]
    return mixed(out)
