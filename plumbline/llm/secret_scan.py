"""Secret scan: known patterns, and sliding-window entropy per character class.

Candidates are unbroken runs of one character class. A window slides over each; its Shannon entropy is kept by
counts that change for the entering and the leaving character only. Windows above the class threshold are joined to
spans. Candidates that mix too few kinds of characters are suppressed, and so are windows that overlap a match of the
allow list; what stands beside a match is scanned like any other text. The allow list never suppresses a pattern's span.
All of it takes time in proportion to the text.

Nulls and edge cases: a null or empty text has no span; a null doc_id stays null; repeated rows are scanned each;
an empty table gives an empty result; other columns of the input are left out (``find_secrets``) or kept as they are
(``redact_secrets``). Offsets count code points, ends are exclusive.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.shared import columns

#: The patterns of the contract, in the order in which equal starts are listed.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
BASE_KINDS = ("assign", "access", "hex")

PLACEHOLDER = "[SECRET]"


@dataclass(frozen=True)
class EntropyClass:
    """Characters of a class, window length, least bits per character, and kinds of characters a candidate must mix."""

    kind: str
    characters: str
    window: int
    bits: float
    mixes: tuple[str, ...]


#: A random window of 24 base64 letters has 4.3 bits on average, one of 24 hex digits 3.4; prose stays under 3.9.
CLASSES = (
    EntropyClass("entropy_hex", "0-9A-Fa-f", 24, 3.0, ("[0-9]", "[A-Fa-f]")),
    EntropyClass("entropy_base64", "A-Za-z0-9+/_-", 24, 4.0, ("[0-9]", "[a-z]", "[A-Z]")),
    # Random windows of these have 4.0 bits on average; digits in two places tell keys from long names.
    EntropyClass("entropy_base32", "A-Z2-7", 24, 3.6, ("[A-Z]", "[2-7]")),
    EntropyClass("entropy_lower", "a-z0-9", 24, 3.7, ("[0-9][a-z]+[0-9]",)),
)
#: Candidates that look random but are public by nature: documentation samples, counted alphabets, runs of words.
ALLOW = (
    r"(?i)example|sample|placeholder|changeme|your[_-]|dummy",
    r"(?i)0123456789|1234567890|abcdefghij",
    r"(.)\1{7}",
    r"\A(?:[A-Za-z]{2,}[0-9]{0,2}[/_-])+[A-Za-z]{2,}[0-9]{0,2}\Z",
)

SPAN_TYPE = "array<struct<kind:string,start:int,end:int>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def allowed(run: str, allow: list[re.Pattern]) -> list[tuple[int, int]]:
    """Stretches of a run that the allow list names, in order and without overlap."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(m.span() for a in allow for m in a.finditer(run)):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def high_windows(
    candidate: str, window: int, bits: float, spared: Sequence[tuple[int, int]] = ()
) -> list[tuple[int, int]]:
    """Joined spans of all windows whose entropy reaches ``bits``; counts and sums are updated, never rebuilt. Windows
    that overlap one of the ``spared`` stretches, which are in order, don't count."""
    terms = _terms(window)
    most = window * math.log2(window) - bits * window
    counts: dict[str, int] = {}
    total, spans, at = 0, [], 0
    for i, c in enumerate(candidate):
        n = counts.get(c, 0)
        total += terms[n + 1] - terms[n]
        counts[c] = n + 1
        if i >= window:
            gone = candidate[i - window]
            n = counts[gone]
            total += terms[n - 1] - terms[n]
            counts[gone] = n - 1
        if i >= window - 1 and total <= most * _UNIT:
            start = i - window + 1
            while at < len(spared) and spared[at][1] <= start:
                at += 1
            if at < len(spared) and spared[at][0] <= i:
                continue
            if spans and start <= spans[-1][1]:
                spans[-1] = (spans[-1][0], i + 1)
            else:
                spans.append((start, i + 1))
    return spans


#: c log2 c is held as a whole number of these parts, so sums don't depend on the way they came about.
_UNIT = 1 << 30


def _terms(window: int) -> list[int]:
    # One more than the window: a character enters before another leaves.
    return [0, *(round(c * math.log2(c) * _UNIT) for c in range(1, window + 2))]


class Scanner:
    def __init__(self, classes: tuple[EntropyClass, ...], allow: tuple[str, ...]) -> None:
        self.assign = re.compile(ASSIGN, re.IGNORECASE | re.ASCII)
        # Runs that are too short fail whatever follows in them, so the least lengths can stand in the patterns.
        self.access = re.compile(f"AKIA[A-Z0-9]{{{ACCESS_LEAST - 4},}}")
        self.hex = re.compile(f"[0-9a-f]{{{HEX_LEAST},}}")
        self.classes = [
            (c, re.compile(f"[{c.characters}]{{{c.window},}}"), [re.compile(m) for m in c.mixes]) for c in classes
        ]
        self.allow = [re.compile(a) for a in allow]

    def spans(self, text: str) -> list[tuple[int, int, str, int]]:
        """(start, rank of the kind, kind, end), sorted."""
        found = [(m.start(), 0, "assign", m.end()) for m in self.assign.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
        found += [(m.start(), 1, "access", m.end()) for m in self.access.finditer(text)]
        found += [(m.start(), 2, "hex", m.end()) for m in self.hex.finditer(text)]
        for rank, (c, runs, mixes) in enumerate(self.classes, len(BASE_KINDS)):
            for m in runs.finditer(text):
                run = m[0]
                if all(x.search(run) for x in mixes):
                    spans = high_windows(run, c.window, c.bits, allowed(run, self.allow))
                    found += [(m.start() + s, rank, c.kind, m.start() + e) for s, e in spans]
        return sorted(found)


def find_secrets(
    docs: DataFrame, classes: tuple[EntropyClass, ...] = CLASSES, allow: tuple[str, ...] = ALLOW
) -> DataFrame:
    """doc_id and all spans of its text, by start and then kind."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(classes, allow)
        for batch in batches:
            rows = [
                [{"kind": k, "start": s, "end": e} for s, _, k, e in scanner.spans(t or "")]
                for t in batch.column("text").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(rows, _SPANS)], names=["doc_id", "spans"]
            )

    return columns(docs, doc_id="long", text="string").mapInArrow(scan, f"doc_id long, spans {SPAN_TYPE}")


def redact(text: str, spans: list[tuple[int, int, str, int]]) -> str:
    out, at = [], 0
    for start, _, _, end in spans:
        if start >= at:
            out += [text[at:start], PLACEHOLDER]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact_secrets(
    docs: DataFrame, classes: tuple[EntropyClass, ...] = CLASSES, allow: tuple[str, ...] = ALLOW
) -> DataFrame:
    """All rows and columns, with each joined run of spans in ``text`` replaced by a placeholder.

    ``n_chars``, where the table has it, is counted anew for texts that changed. Null texts stay null.
    """
    schema = docs.schema

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(classes, allow)
        for batch in batches:
            at = batch.schema.get_field_index("text")
            before = batch.column(at).to_pylist()
            after = [t and redact(t, scanner.spans(t)) for t in before]
            arrays = [batch.column(i) for i in range(batch.num_columns)]
            arrays[at] = pa.array(after, batch.schema.field(at).type)
            count = batch.schema.get_field_index("n_chars")
            if count >= 0:
                old = arrays[count].to_pylist()
                new = [n if a == b else len(a) for n, a, b in zip(old, after, before, strict=True)]
                arrays[count] = pa.array(new, batch.schema.field(count).type)
            yield pa.RecordBatch.from_arrays(arrays, schema=batch.schema)

    return docs.mapInArrow(scan, schema)


def digest(found: DataFrame) -> DataFrame:
    """Counts, digest of the pattern spans and text of all spans."""

    def of(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    def text(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select(
        "doc_id",
        *(of(k).alias(f"n_{k}") for k in BASE_KINDS),
        F.sha2(text(base).cast("binary"), 256).alias("base_sha256"),
        text(F.col("spans")).alias("spans"),
    )
