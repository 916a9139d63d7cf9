"""Token ids of whole texts by the tokenizers library, with ids of frequent words remembered."""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from plumbline.llm.shared import per_process
from plumbline.llm.text_bytes import blocks

#: Entries a worker keeps at most in each of two generations; what is not asked for in one is forgotten with the next,
#: which changes no result.
MAX_CHUNKS, MAX_WORDS = 50_000, 300_000
#: A chunk of Latin letters and then ASCII punctuation is one word and one mark for the tokenizer's splitter, which
#: only lowers their case. Apostrophes (contractions), digits and all else go through the library as they are.
_PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\\[-`{-~]*)")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Memory:
    """Values by text, in two generations: a full one becomes the old one, and what is found there moves on."""

    def __init__(self, size: int, make: Callable[[str], bytes]) -> None:
        self.size, self.make = size, make
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def __call__(self, text: str) -> bytes:
        found = self.new.get(text)
        if found is None:
            found = self.old.get(text)
            if found is None:
                found = self.make(text)
            if len(text) > LONG_CHUNK:
                return found
            if len(self.new) >= self.size:
                self.old, self.new = self.new, {}
            self.new[text] = found
        return found

    def all(self, texts: list[str]) -> list[bytes]:
        found = list(map(self.new.get, texts))
        if None in found:
            found = [self(t) if x is None else x for t, x in zip(texts, found, strict=True)]
        return found


class WordEncoder:
    """Ids of texts as little-endian 32-bit bytes.

    The tokenizer drops white space and never joins across it, so a text's ids are those of its chunks between
    spaces and line feeds. A chunk of Latin letters and then ASCII punctuation is one word and one mark for the model.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.words = Memory(MAX_WORDS, self._word)
        self.chunks = Memory(MAX_CHUNKS, self._chunk)
        self.plain = self._is_plain()

    def _is_plain(self) -> bool:
        """Whether the file is of the kind whose words may be handed to the model directly; checked on samples."""
        samples = ["Then", "thing,", "ÉÈÀ", "straße.", "word***", "a|", "Ünd-", "x_", "THE!!", "ñandú@#"]
        return all(self._direct(s) == self._chunk(s) for s in samples)

    @staticmethod
    def _ids(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def _word(self, word: str) -> bytes:
        mapped = word if word.isascii() else "".join(map(chr, _byte_letters(word)))
        return self._ids([t.id for t in self.library.model.tokenize(mapped)])

    def _direct(self, chunk: str) -> bytes | None:
        m = _PLAIN.fullmatch(chunk)
        return m and self._word(m[1].lower()) + (self._word(m[2]) if m[2] else b"")

    def _chunk(self, chunk: str) -> bytes:
        return self._ids(self.library.encode(chunk, add_special_tokens=False).ids)

    def encode(self, text: str) -> bytes:
        """Ids of one text."""
        (block,) = token_blocks(self, pa.array([text], pa.large_string()), 0, 1 << 62)
        return block.ids[:-1].tobytes()


@dataclass
class TokenBlock:
    """Ids of consecutive texts, one behind the other, and how many each text has. ``first`` is the number of the first
    text in its batch."""

    ids: np.ndarray
    counts: np.ndarray
    first: int


#: Bytes of text that are cut and gathered at once, about.
BLOCK_BYTES = 2 << 20
#: Longer chunks are left to the library, and not remembered.
LONG_CHUNK = 200


def _byte_set(ranges: list[tuple[int, int]]) -> np.ndarray:
    table = np.zeros(256, bool)
    for a, b in ranges:
        table[a : b + 1] = True
    return table


_INSIDE = ~_byte_set([(0x20, 0x20), (0x0A, 0x0A)])
# As in _PLAIN: letters in one byte, second bytes of the two-byte ones that follow C3, and punctuation.
_LETTER = _byte_set([(0x41, 0x5A), (0x61, 0x7A)])
_SECOND = _byte_set([(0x80, 0x96), (0x98, 0xB6), (0xB8, 0xBF)])
_MARK = _byte_set([(0x21, 0x26), (0x28, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E)])
_LOWERED = np.arange(256, dtype=np.uint8)
_LOWERED[0x41:0x5B] += 0x20


@dataclass
class _Coded:
    """Texts in the order in which they occur, as numbers of the different ones."""

    codes: np.ndarray
    texts: list[str]


def _coded(data: np.ndarray, lengths: np.ndarray) -> _Coded:
    ends = np.append(0, np.cumsum(lengths))
    texts = pa.Array.from_buffers(pa.large_string(), len(lengths), [None, pa.py_buffer(ends), pa.py_buffer(data)])
    coded = texts.dictionary_encode()
    return _Coded(coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist())


def token_blocks(encoder: WordEncoder, texts: pa.Array, end: int, block_bytes: int | None = None) -> Iterator[TokenBlock]:
    """Ids of many texts (nulls as empty), each with the end id behind.

    Words, marks and all other chunks of a block are numbered by Arrow, each different one is encoded once, and its ids
    are gathered into place.
    """
    for block in blocks(texts, block_bytes or BLOCK_BYTES):
        data = block.data
        inside = _INSIDE[data]
        before, after = np.append(False, inside[:-1]), np.append(inside[1:], False)
        filled = block.ends > block.starts
        before[block.starts[filled]] = False
        after[block.ends[filled] - 1] = False
        starts, stops = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        lengths = stops - starts

        second = np.append(False, (data[:-1] == 0xC3) & _SECOND[data[1:]]) if len(data) else inside
        letter = _LETTER[data] | second | np.append(second[1:], False)
        mark = _MARK[data] & inside

        def chunk_of(where: np.ndarray) -> np.ndarray:
            return np.searchsorted(starts, np.flatnonzero(where), side="right") - 1  # noqa: B023

        plain = letter[starts] & (lengths <= LONG_CHUNK) & encoder.plain
        plain[chunk_of(inside & ~letter & ~mark)] = False
        # A letter behind a mark; that of another chunk has a separator before it.
        plain[chunk_of(np.append(False, mark[:-1]) & letter & before)] = False
        marks = np.bincount(chunk_of(mark), minlength=len(starts)) * plain
        own = np.zeros(len(data), bool)
        own[inside] = np.repeat(plain, lengths)

        low = _LOWERED[data]
        low[second & (data < 0x9F)] += 0x20
        parts = (
            (_coded(low[own & letter], (lengths - marks)[plain]), encoder.words),
            (_coded(data[own & mark], marks[marks > 0]), encoder.words),
            (_coded(data[inside & ~own], lengths[~plain]), encoder.chunks),
        )
        found = [x for part, memory in parts for x in memory.all(part.texts)]
        sizes = np.array([*map(len, found), 4], np.int64) // 4
        table = np.frombuffer(b"".join([*found, end.to_bytes(4, "little")]), "<u4")

        # A chunk is one unit or, with marks, two; the end id is one more, behind the last one of each text.
        units = 1 + (marks > 0)
        place = np.cumsum(units) - units
        until = np.append(place, units.sum())[np.searchsorted(starts, block.ends)]
        codes = np.empty(units.sum(), np.int64)
        words, signs, others = (part.codes for part, _ in parts)
        codes[place[plain]] = words
        codes[place[marks > 0] + 1] = signs + len(parts[0][0].texts)
        codes[place[~plain]] = others + len(parts[0][0].texts) + len(parts[1][0].texts)
        codes = np.insert(codes, until, len(found))
        counts = sizes[codes]
        ends = np.cumsum(counts)
        first = np.cumsum(sizes) - sizes
        ids = table[np.arange(ends[-1]) + np.repeat(first[codes] - ends + counts, counts)]
        totals = ends[until + np.arange(block.size)]
        yield TokenBlock(ids, np.diff(totals, prepend=0), block.first)


def _byte_letters(word: str) -> list[int]:
    """Code points that stand for a word's UTF-8 bytes in byte-level vocabularies: printable Latin-1 letters stand for
    themselves, the others follow from 256 on, in order."""
    table = per_process(("byte letters",), _byte_table)
    return [table[b] for b in word.encode()]


def _byte_table() -> list[int]:
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return [b if b in own else next(rest) for b in range(256)]


def encoder(path: str) -> WordEncoder:
    return per_process(("encoder", path), lambda: WordEncoder(path))
