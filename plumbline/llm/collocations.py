"""Phrase collocations per language, by top-order marginalisation.

Only the longest windows are counted: each word with the words that follow it in its piece, as lead columns that are
padded past the piece's end. A task counts the windows of a block of texts at once and sends each distinct one with its
count, packed by the hash of its first two words. What starts alike therefore meets in one task: windows are summed
there, those too rare to matter give up their last words, and ROLLUP over the leading columns adds all up prefix by
prefix, as a phrase starts as many windows as it has occurrences. No shorter n-gram is ever listed.

A phrase's score is the least, over its cuts in two, of ``scale * a * a / (l * r)`` (a: its count, l and r: those of the
parts), in exact decimals. A phrase that lies inside a longer candidate which holds half of its occurrences is dropped.

Nulls and edge cases: a null or empty text has no words; a null language is ``und``, together with rows that say
``und``; repeated rows all count; an empty table gives an empty result; doc_id and other columns are not read. Texts
longer than a block are counted in parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.llm.shared import LOWER, UPPER, columns, stored
from plumbline.llm.text_bytes import Block, blocks, mixed

PIECE_ENDS, WORD_ENDS = b".,;:!?\x0a\x0b\x0c\x0d", b" \t"
UNKNOWN = "und"
MOST_WORDS, LEAST_COUNT, TOP = 3, 10, 2000
SCALE = 1_000_000
#: A longer candidate with this share of a phrase's occurrences, in hundredths, replaces it.
COVERED = 50
#: Bytes of text whose windows are counted together.
BLOCK_BYTES = 4 << 20
#: Windows meet by a hash of their first two words; a task sends one row for each value of it, language and block.
BUCKETS = 1 << 14

_PACKED = pa.schema([("bucket", pa.int32()), ("lang", pa.string()), ("windows", pa.string()), ("n", pa.list_(pa.int32()))])


def _byte_set(members: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(members)] = True
    return table


_BREAKS = _byte_set(PIECE_ENDS)
_INSIDE = ~_byte_set(PIECE_ENDS + WORD_ENDS)
_LOWERED = np.arange(256, dtype=np.uint8)
_LOWERED[list(UPPER.encode())] += 32


def _parts(text: pa.Scalar, most_words: int, size: int) -> Iterator[tuple[str, int]]:
    """A long text cut behind spaces, each part followed by the words that its last windows reach into; with the bytes
    of the part itself."""
    data = np.frombuffer(text.as_buffer(), np.uint8)
    ends = np.flatnonzero(~_INSIDE[data])
    at = 0
    while at < len(data):
        k = int(np.searchsorted(ends, at + size))
        till = int(ends[k]) + 1 if k < len(ends) else len(data)
        # The following words end at separators behind which the next byte is inside again.
        reach = till
        for _ in range(most_words - 1):
            rest = data[reach:]
            begin = int(np.argmax(_INSIDE[rest])) if len(rest) else 0
            k = int(np.searchsorted(ends, reach + begin + 1))
            reach = int(ends[k]) + 1 if k < len(ends) else len(data)
        yield data[at:reach].tobytes().decode(), till - at
        at = till


def _words(block: Block, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of inside bytes start and end; texts don't join."""
    before, after = np.append(False, inside[:-1]), np.append(inside[1:], False)
    filled = block.ends > block.starts
    before[block.starts[filled]] = False
    after[block.ends[filled] - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def counted_windows(langs: pa.Array, texts: pa.Array, most_words: int, limits: list[int] | None = None) -> pa.RecordBatch:
    """The distinct windows of texts with their counts, packed by bucket and language.

    ``windows`` has those of a row in order, with tabs between; a window shorter than ``most_words`` has met the end of
    its piece. Windows that start at ``limits`` (bytes of each text) or later don't count.
    """
    (block,) = blocks(texts, 1 << 62)
    block.data = _LOWERED[block.data]
    inside = _INSIDE[block.data]
    starts, word_ends = _words(block, inside)
    if not len(starts):
        return pa.RecordBatch.from_pylist([], schema=_PACKED)
    owner = np.searchsorted(block.ends, starts, side="right")
    ends = np.append(0, np.cumsum(word_ends - starts))
    text = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(block.data[inside])])
    coded = text.dictionary_encode()
    order = pc.sort_indices(coded.dictionary)
    listed = coded.dictionary.take(order)
    # Codes in the order of the words, from 1; 0 is padding.
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(1, len(order) + 1)
    code = rank[coded.indices.to_numpy()]

    piece = np.searchsorted(np.flatnonzero(_BREAKS[block.data]), starts)
    joined = np.append((piece[1:] == piece[:-1]) & (owner[1:] == owner[:-1]), False)
    languages = langs.dictionary_encode()
    lang = languages.indices.to_numpy()[owner].astype(np.int64)
    leads, open_ = [code], np.ones(len(code), bool)
    for _ in range(1, most_words):
        open_ = open_ & joined
        leads.append(np.where(open_, np.append(leads[-1][1:], 0), 0))
        joined = np.append(joined[1:], False)
    if limits is not None:
        own = starts - block.starts[owner] < np.array(limits)[owner]
        lang, leads = lang[own], [c[own] for c in leads]
        if not len(lang):
            return pa.RecordBatch.from_pylist([], schema=_PACKED)

    # One number for each window, in order; renumbered before it outgrows 64 bits.
    size = len(listed) + 1
    key, top = lang, len(languages.dictionary)
    for lead in leads:
        if top * size >= 1 << 62:
            _, key = np.unique(key, return_inverse=True)
            top = int(key.max()) + 1
        key, top = key * size + lead, top * size
    _, first, n = np.unique(key, return_index=True, return_counts=True)
    lang, leads = lang[first], [c[first] for c in leads]

    hashes = np.append(np.uint64(0), word_hashes(listed))
    bucket = (mixed(hashes[leads[0]] * np.uint64(3) + hashes[leads[min(1, most_words - 1)]]) % np.uint64(BUCKETS)).astype(np.int64)
    row = bucket * len(languages.dictionary) + lang
    at = np.argsort(row, kind="stable")
    row, lang, n, leads = row[at], lang[at], n[at], [c[at] for c in leads]
    padded = pa.concat_arrays([pa.nulls(1, listed.type), listed])
    parts = [padded.take(pa.array(c)) for c in leads]
    windows = pc.binary_join_element_wise(*parts, pa.scalar(" ", listed.type), null_handling="skip")
    begin = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    offsets = pa.array(np.append(begin, len(row)).astype(np.int64))
    together = pc.binary_join(pa.LargeListArray.from_arrays(offsets, windows), pa.scalar("\t", listed.type))
    return pa.RecordBatch.from_arrays(
        [
            pa.array((row[begin] // len(languages.dictionary)).astype(np.int32)),
            languages.dictionary.take(pa.array(lang[begin])),
            together.cast(pa.string()),
            pa.ListArray.from_arrays(offsets.cast(pa.int32()), pa.array(n.astype(np.int32))),
        ],
        schema=_PACKED,
    )


def word_hashes(listed: pa.Array) -> np.ndarray:
    """A hash of each word, the same in all tasks."""
    (block,) = blocks(listed, 1 << 62)
    lengths = block.ends - block.starts
    place = np.arange(len(block.data)) - np.repeat(block.starts, lengths)
    value = mixed((block.data.astype(np.uint64) + np.uint64(1)) * mixed(place.astype(np.uint64) + np.uint64(1)))
    return mixed(np.add.reduceat(value, block.starts) + lengths.astype(np.uint64))


def top_windows(docs: DataFrame, most_words: int = MOST_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """bucket, lang, windows, n: the distinct windows of each block of texts, packed (``counted_windows``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").fill_null("").cast(pa.large_string())
            langs = batch.column("lang").fill_null(UNKNOWN)
            for block in blocks(texts, block_bytes):
                here = slice(block.first, block.first + block.size)
                if len(block.data) > block_bytes:
                    for part, own in _parts(texts[block.first], most_words, block_bytes):
                        yield counted_windows(langs[here], pa.array([part], pa.large_string()), most_words, [own])
                else:
                    yield counted_windows(langs[here], texts[here], most_words)

    return columns(docs, lang="string", text="string").mapInArrow(
        run, "bucket int, lang string, windows string, n array<int>"
    )


def phrase_counts(docs: DataFrame, most_words: int = MOST_WORDS, least: int = LEAST_COUNT) -> DataFrame:
    """lang, words, phrase, f of all phrases of up to ``most_words`` words with ``least`` occurrences or more, and the
    number of all words of a language as the phrase of no words."""
    names = [f"w{k}" for k in range(most_words)]
    cut = F.split("window", " ")
    packed = top_windows(docs, most_words).repartition("bucket")
    windows = packed.select(
        "bucket", "lang", F.inline(F.arrays_zip(F.split("windows", "\t").alias("window"), F.col("n").alias("n")))
    ).select("bucket", "lang", *(F.get(cut, F.lit(k)).alias(w) for k, w in enumerate(names)), "n")
    top = windows.groupBy("bucket", "lang", *names).agg(F.sum("n").alias("f"))
    # From the longest down: the words after the first two are taken from windows whose beginning is too rare.
    kept = top
    for k in range(most_words, 1, -1):
        own = W.partitionBy("bucket", "lang", *names[:k])
        often = (F.col("f") if k == most_words else F.sum("f").over(own)) >= least
        kept = kept.withColumn(names[k - 1], F.when(often, F.col(names[k - 1])))
    sums = kept.rollup("lang", *names).agg(F.grouping_id().alias("gone"), F.sum("f").alias("f"))
    # Bits of grouping_id: the last columns are summed away. A phrase that ends in padding or in words taken away is none.
    length = F.coalesce(*(F.when(F.col("gone") == (1 << most_words - m) - 1, m) for m in range(most_words + 1)))
    last = F.element_at(F.array(F.lit(""), *names), F.col("words") + 1)
    return (
        sums.withColumn("words", length)
        .where(F.col("words").isNotNull() & last.isNotNull() & ((F.col("f") >= least) | (F.col("words") == 0)))
        .select("lang", "words", F.concat_ws(" ", *names).alias("phrase"), "f")
    )


def scored(counts: DataFrame, scale: int = SCALE) -> DataFrame:
    """lang, phrase, words, a, l, r, score of all phrases of two words and more, by their lowest-scoring cut."""
    phrases = counts.where("words >= 2").select("lang", "phrase", "words", F.col("f").alias("a"))
    cut = F.split("phrase", " ")
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1))).select(
        "*",
        F.array_join(F.slice(cut, F.lit(1), F.col("k")), " ").alias("first"),
        F.array_join(F.slice(cut, F.col("k") + 1, F.col("words")), " ").alias("rest"),
    )
    part = counts.where("words >= 1")
    firsts = part.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    rests = part.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    # A part occurs at least as often as the whole, so no cut lacks its counts.
    both = cuts.join(firsts, ["lang", "first"]).join(rests, ["lang", "rest"])
    a, left, right = (F.col(c).cast("decimal(18,0)") for c in ("a", "l", "r"))
    score = F.call_function("div", (F.lit(scale).cast("decimal(38,0)") * a * a).cast("decimal(38,0)"), left * right)
    lowest = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")
    return both.groupBy("lang", "phrase", "words", "a").agg(lowest).select(
        "lang", "phrase", "words", "a", "cut.l", "cut.r", "cut.score"
    )


def uncovered(phrases: DataFrame, most_words: int = MOST_WORDS, covered: int = COVERED) -> DataFrame:
    """Phrases of which no longer candidate that holds them has ``covered`` hundredths of their occurrences."""
    cut = F.split("phrase", " ")
    inside = [
        F.when(
            F.col("words") >= start + size, F.array_join(F.slice(cut, start + 1, size), " ")
        )
        for size in range(2, most_words)
        for start in range(most_words - size + 1)
    ]
    if not inside:
        return phrases
    longer = phrases.select("lang", F.col("phrase").alias("whole"), F.col("a").alias("f"), F.explode(F.array(*inside)).alias("phrase"))
    most = longer.where("phrase IS NOT NULL AND phrase <> whole").groupBy("lang", "phrase").agg(F.max("f").alias("f"))
    held = F.coalesce(100 * F.col("f").cast("decimal(20,0)") >= covered * F.col("a"), F.lit(False))
    return phrases.join(most, ["lang", "phrase"], "left").where(~held).drop("f")


def collocations(
    docs: DataFrame, most_words: int = MOST_WORDS, least: int = LEAST_COUNT, top: int = TOP, scale: int = SCALE
) -> DataFrame:
    """The first ``top`` phrases of each language by score, count and text: lang, rank, phrase, a, l, r, n, score."""
    counts = stored(phrase_counts(docs, most_words, least), "phrase-counts")
    left = uncovered(stored(scored(counts, scale), "phrase-scores"), most_words)
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = left.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    sizes = counts.where("words = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def oracle_sql() -> str:
    """The same result in DuckDB's SQL, from separate counts of one, two and three words."""
    return f"""
WITH pieces AS (
  SELECT coalesce(lang, '{UNKNOWN}') AS lang,
         unnest(string_split_regex(translate(text, '{UPPER}', '{LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents WHERE text IS NOT NULL
), split AS (
  SELECT lang, [w FOR w IN string_split_regex(piece, '[\\x20\\x09]+') IF w <> ''] AS w FROM pieces
), grams AS (
  SELECT lang, k AS words, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM split, unnest([1, 2, 3]) s(k), unnest(range(1, len(w) - k + 2)) t(i)
), counts AS (
  SELECT lang, words, phrase, count(*) AS f FROM grams GROUP BY ALL
), sizes AS (
  SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counts WHERE words = 1 GROUP BY lang
), candidates AS (
  SELECT * FROM counts WHERE words >= 2 AND f >= {LEAST_COUNT}
), cuts AS (
  SELECT c.lang, c.phrase, c.words, c.f AS a, k, l.f AS l, r.f AS r,
         CAST({SCALE} * c.f::HUGEINT * c.f // (l.f::HUGEINT * r.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, words)) AS k, string_split(phrase, ' ') AS w FROM candidates) c
  JOIN counts l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:k], ' ')
  JOIN counts r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[k + 1:], ' ')
), scored AS (
  SELECT lang, phrase, words, a, l, r, score FROM cuts
  QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inside AS (
  SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase, f
  FROM (SELECT *, string_split(phrase, ' ') AS w FROM candidates WHERE words = 3)
), kept AS (
  SELECT s.* FROM scored s
  WHERE NOT EXISTS (SELECT 1 FROM inside i
                    WHERE s.words = 2 AND i.lang = s.lang AND i.phrase = s.phrase AND 100 * i.f >= {COVERED} * s.a)
)
SELECT lang, rank, phrase, a, l, r, n, score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
JOIN sizes USING (lang) WHERE rank <= {TOP}
"""
