"""Personal data: patterns propose spans, checks confirm them, nearby words adjust their score.

Patterns propose spans of each kind, leftmost and without overlap within the kind. A proposal that fails the check of its
kind is dropped: parts of an address up to 255, the Luhn sum of a card number, the remainder by 97 of an account number,
numbers of digits. What is left has a score from its kind and its check, raised by words that go with the kind and
lowered by words that speak against it, within ``REACH`` characters. Spans of the base kinds stay whatever their score,
which then only says how sure they are; the further kinds need ``LEAST_SCORE``.

All kinds are found in time proportional to the text: runs of the characters of a kind are taken whole and cut in one
pass, so no pattern starts again inside a run that failed.

Nulls and edge cases: a null or empty text has no span; a null doc_id stays null; repeated rows are searched each; an
empty table gives an empty result; other columns are left out (``find_personal_data``) or kept as they are
(``mask_personal_data``). Offsets count code points, ends are exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.shared import columns

#: The kinds of the contract, in the order in which they are listed.
BASE_KINDS = ("email", "ip", "card", "phone")
#: Kinds that the method adds: international account numbers, and social security numbers where words say so.
MORE_KINDS = ("iban", "ssn")
KINDS = BASE_KINDS + MORE_KINDS

#: Score of a proposal that passed its check; checks that random digits rarely pass weigh more.
SCORES = {"email": 0.8, "ip": 0.5, "card": 0.7, "phone": 0.5, "iban": 0.9, "ssn": 0.3}
STEP, LEAST_SCORE = 0.3, 0.5
#: Characters before and after a span in which words count.
REACH = 48
#: Word beginnings that go with a kind.
FOR = {
    "email": ("mail", "contact", "write", "correo", "courriel"),
    "ip": ("ip", "host", "server", "address", "login", "adresse"),
    "card": ("card", "visa", "master", "credit", "debit", "payment", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "whatsapp", "ruf"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social", "security", "taxpayer"),
}
#: Word beginnings that speak against any kind: samples, and numbers that name things.
AGAINST = ("example", "sample", "dummy", "version", "isbn", "invoice", "serial")

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9][0-9.]{6,}")
_SPACED = re.compile(r"[0-9][0-9 -]{11,}[0-9]")
_GAPS = re.compile(r"[ -]{2,}")
_DIALLED = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_ACCOUNT = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SOCIAL = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
_WORDS = re.compile("[^\\W\\d_]+")

SPAN_TYPE = "array<struct<kind:string,start:int,end:int,score:double>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

Span = tuple[int, int]


def emails(text: str) -> Iterator[Span]:
    """Each ``@`` with the characters of a name before it, back to the last match, and a domain of two labels or more."""
    done, at = 0, text.find("@")
    while at >= 0:
        # No name goes across an @, so each stretch is looked at once.
        stretch = text[done:at]
        start = done + len(stretch.rstrip(_LOCAL))
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
        done = domain.end() if domain else at + 1
        at = text.find("@", done)


def addresses(text: str) -> Iterator[Span]:
    """Four numbers joined by points, each up to 255; a longer chain is taken four by four."""
    for run in _DOTTED.finditer(text):
        start = run.start()
        numbers: list[str] = []
        for part in run[0].split("."):
            if part:
                numbers.append(part)
            # An empty part is two points in a row, or one at the end: the chain is over.
            if not part or len(numbers) == 4:
                length = sum(map(len, numbers)) + 3
                if len(numbers) == 4 and all(len(n.lstrip("0")) <= 3 and int(n.lstrip("0") or 0) <= 255 for n in numbers):
                    yield start, start + length
                start += sum(len(n) + 1 for n in numbers) + (not part)
                numbers = []


def luhn(digits: str) -> bool:
    """Whether a number of a card passes its check digit."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def cards(text: str) -> Iterator[Span]:
    """Chains of digits with single spaces or hyphens between them: 13 to 19 digits that pass ``luhn``."""
    for run in _SPACED.finditer(text):
        at = run.start()
        for gap in [*_GAPS.finditer(text, run.start(), run.end()), None]:
            end = gap.start() if gap else run.end()
            if end - at >= 13:
                digits = "".join(_DIGIT.findall(text, at, end)) if end - at < 38 else ""
                if 13 <= len(digits) <= 19 and luhn(digits):
                    yield at, end
            at = gap.end() if gap else end


def phones(text: str) -> Iterator[Span]:
    """A plus sign and 9 to 15 digits with spaces, points, hyphens and brackets between them."""
    for m in _DIALLED.finditer(text):
        if 9 <= len(_DIGIT.findall(m[0])) <= 15:
            yield m.span()


def mod97(account: str) -> bool:
    """Whether an account number leaves 1 when divided by 97: country and check digits go to the end, letters count from
    10 on."""
    moved = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def accounts(text: str) -> Iterator[Span]:
    """International account numbers. Words may follow in the same pattern, so ends at spaces are tried from the right."""
    for m in _ACCOUNT.finditer(text):
        end = m.end()
        while end > m.start():
            account = text[m.start() : end].replace(" ", "")
            if len(account) < 15:
                break
            if mod97(account):
                yield m.start(), end
                break
            end = text.rfind(" ", m.start(), end)


def socials(text: str) -> Iterator[Span]:
    """Numbers in the groups of a social security number, without those that are never given out."""
    for m in _SOCIAL.finditer(text):
        if m[1] not in ("000", "666") and m[1] < "900" and m[2] != "00" and m[3] != "0000":
            yield m.span()


FINDERS = {"email": emails, "ip": addresses, "card": cards, "phone": phones, "iban": accounts, "ssn": socials}


def score(text: str, kind: str, start: int, end: int) -> float:
    """The kind's own score, a step up if a word that goes with it is near, a step down if one speaks against it."""
    near = (text[max(0, start - REACH) : start] + "\n" + text[end : end + REACH]).lower()
    words = _WORDS.findall(near)
    value = SCORES[kind]
    value += STEP * any(w.startswith(FOR[kind]) for w in words)
    value -= STEP * any(w.startswith(AGAINST) for w in words)
    return round(min(1.0, max(0.0, value)), 3)


def spans(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) of all spans, by kind as listed and start."""
    found = []
    for kind, find in FINDERS.items():
        for start, end in find(text):
            sure = score(text, kind, start, end)
            if kind in BASE_KINDS or sure >= LEAST_SCORE:
                found.append((kind, start, end, sure))
    return found


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id and all spans of its text with their scores, by kind as listed and start."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                [{"kind": k, "start": a, "end": b, "score": s} for k, a, b, s in spans(t or "")]
                for t in batch.column("text").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, _SPANS)], names=["doc_id", "spans"])

    return columns(docs, doc_id="long", text="string").mapInArrow(scan, f"doc_id long, spans {SPAN_TYPE}")


def masked(text: str, least: float = LEAST_SCORE) -> str:
    """The text with ``[EMAIL]``, ``[CARD]`` and so on in place of spans; of spans that overlap, the first one names
    the whole."""
    out, at = [], 0
    for start, end, kind in sorted((a, b, k) for k, a, b, s in spans(text) if s >= least):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def mask_personal_data(docs: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """All rows and columns, with spans of a score of ``least`` or more masked in ``text``. Null texts stay null."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            after = [t and masked(t, least) for t in batch.column("text").to_pylist()]
            arrays = [batch.column(i) for i in range(batch.num_columns)]
            arrays[at] = pa.array(after, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(arrays, schema=batch.schema)

    return docs.mapInArrow(scan, docs.schema)


def digest(found: DataFrame) -> DataFrame:
    """Counts, digest of the base kinds' spans and text of all spans."""

    def of(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    def text(rows):
        return F.array_join(F.transform(rows, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select(
        "doc_id",
        *(of(k).alias(f"n_{k}") for k in BASE_KINDS),
        F.sha2(text(base).cast("binary"), 256).alias("base_sha256"),
        text(F.col("spans")).alias("spans"),
    )
