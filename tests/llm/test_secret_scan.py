import math
import random
import re
import time
from collections import Counter

from llm_data import ODD_TEXTS, documents, sha  # noqa: F401

from plumbline.llm import secret_scan as s

KEY = "AKIA" + "ABCD1234EFGH5678"
HEX = "0123456789abcdef01234567"
RANDOM = "kJ8s0Qz3LxWv5TnB2yRfGh7Pc1"


def base(text):
    kinds = (
        ("assign", re.compile(s.ASSIGN, re.I | re.A), lambda m: len(m[2]) >= 6),
        ("access", re.compile(s.ACCESS), lambda m: len(m[0]) >= 20),
        ("hex", re.compile(s.HEX), lambda m: len(m[0]) >= 24),
    )
    return sorted((m.start(), r, k, m.end()) for r, (k, p, ok) in enumerate(kinds) for m in p.finditer(text) if ok(m))


def entropy_windows(run, window, bits):
    """Joined windows from fresh counts of each."""
    spans = []
    for i in range(len(run) - window + 1):
        total = sum(round(c * math.log2(c) * s._UNIT) for c in Counter(run[i : i + window]).values())
        if total <= (window * math.log2(window) - bits * window) * s._UNIT:
            if spans and i <= spans[-1][1]:
                spans[-1] = (spans[-1][0], i + window)
            else:
                spans.append((i, i + window))
    return spans


def test_incremental_entropy_equals_fresh_counts():
    rnd = random.Random(1)
    for _ in range(200):
        letters = "abcdefghijklmnopqrstuvwxyz0123456789"[: rnd.choice([2, 8, 20, 36])]
        run = "".join(rnd.choice(letters) for _ in range(rnd.randrange(0, 90)))
        bits = rnd.choice([2.0, 3.0, 3.5, 4.0])
        assert s.high_windows(run, 24, bits) == entropy_windows(run, 24, bits)


def test_query_form_against_patterns(documents):
    rnd = random.Random(2)
    parts = [
        "password", "PASSWD", "Secret", "token", "api_key", "apikey", "=", ":", " ", "  ", '"', "'", "abc", "abcdef",
        "toKen=token: abcdefgh", KEY, KEY[:-2], HEX, HEX[:-1], "Key", "toKen=abcdefgh", "\n", "é", "paſsword=1234567",
    ]
    rows = ODD_TEXTS + [(100 + k, "".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 14)))) for k in range(300)]
    found = s.digest(s.find_secrets(documents(rows))).collect()
    expected = []
    for i, text in rows:
        spans = base(text or "")
        n = Counter(k for _, _, k, _ in spans)
        expected.append((i, n["assign"], n["access"], n["hex"], sha(",".join(f"{k}:{a}:{b}" for a, _, k, b in spans))))
    got = [(r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in found]
    assert sorted(got, key=str) == sorted(expected, key=str)
    for r in found:
        assert all(f"{k}:{a}:{b}" in r["spans"] for i, t in rows if i == r["doc_id"] and i and i >= 100 for a, _, k, b in base(t or ""))


def test_entropy_spans_and_allow_list(documents):
    rows = [
        (1, f"see {RANDOM} there"),
        (2, "see EXAMPLE" + RANDOM + " there"),
        (3, "averylongwordwithoutanydigitsinitatall" * 2),
        (4, "some/path/to/files/under/a/long/folder/name2/again/and/again"),
        (5, "DEADBEEF00112233DEADBEEF99887766"),
    ]
    spans = {r["doc_id"]: r["spans"] for r in s.digest(s.find_secrets(documents(rows))).collect()}
    assert spans[1] == f"entropy_base64:4:{4 + len(RANDOM)}"
    # What stands beside an allowed word is no part of it.
    assert spans[2] == f"entropy_base64:11:{11 + len(RANDOM)}"
    assert spans[3] == spans[4] == ""
    assert spans[5].startswith("entropy_hex:0:")


def test_allow_list_spares_only_what_it_names(documents):
    rnd = random.Random(5)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    key = "".join(rnd.choice(letters) for _ in range(40))
    blob = "".join(rnd.choice(letters + "+/") for _ in range(400))
    blob = blob[:200] + "AAAAAAAA" + blob[208:]
    long = "".join(rnd.choice(letters) for _ in range(400))
    long = long[:200] + "sample" + long[206:]
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    rows = [(1, f"in docs/sample/{key} it"), (2, blob), (3, long), (4, alphabet)]
    found = {r["doc_id"]: r["spans"] for r in s.find_secrets(documents(rows)).collect()}
    text = dict(rows)
    covered = {i: {k for x in found[i] for k in range(x["start"], x["end"])} for i in text}
    at = text[1].index(key)
    assert covered[1] >= set(range(at, at + 40)) and min(covered[1]) > text[1].index("sample")
    for i in (2, 3):
        assert len(covered[i]) > 390
    assert not found[4]


def test_keys_beside_an_allowed_word_are_found():
    rnd = random.Random(9)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    scanner = s.Scanner(s.CLASSES, s.ALLOW)
    # With letters and digits of each kind, as the class demands.
    keys = ["".join(rnd.choice(letters) for _ in range(37)) + "a1B" for _ in range(500)]
    assert all(any(k.startswith("entropy") for _, _, k, _ in scanner.spans(key)) for key in keys)
    for before in ("sample", "example", "sample/", "EXAMPLE_"):
        found = [{i for a, _, k, b in scanner.spans(f"x {before}{key} y") if k.startswith("entropy") for i in range(a, b)} for key in keys]
        first = 2 + len(before)
        assert sum(len(f & set(range(first, first + 40))) >= 24 for f in found) == 500
        assert not any(f & set(range(2, 2 + len("sample"))) for f in found)


def test_time_is_proportional_to_the_text():
    scanner = s.Scanner(s.CLASSES, s.ALLOW)
    for part in ("example1A/", "aB3", "sample", "AAAAAAAA", "aB3/", "0123456789"):
        text = part * (200_000 // len(part))
        start = time.process_time()
        scanner.spans(text)
        assert time.process_time() - start < 10, part


def test_base32_and_lower_case_keys(documents):
    rnd = random.Random(6)
    for kind, letters in (
        ("entropy_base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
        ("entropy_lower", "abcdefghijklmnopqrstuvwxyz0123456789"),
    ):
        rows = [(k, "x " + "".join(rnd.choice(letters) for _ in range(32)) + " y") for k in range(200)]
        found = s.find_secrets(documents(rows)).collect()
        assert sum(any(x["kind"] == kind for x in r["spans"]) for r in found) >= 195
    names = ["averylongnameofafunction2inamodule", "INTERNATIONALIZATIONANDLOCALIZATION", "zzzz1yyyy2" * 4]
    found = s.find_secrets(documents(list(enumerate(names)))).collect()
    assert not any(r["spans"] for r in found)


def test_redaction_keeps_rows_and_columns(documents):
    rows = [*ODD_TEXTS, (20, f"x {KEY} y token = {HEX}. z"), (21, f"{HEX}{HEX} {RANDOM}")]
    docs = documents(rows)
    out = s.redact_secrets(docs)
    assert out.columns == docs.columns and out.schema == docs.schema
    got = out.collect()
    assert len(got) == len(rows)
    texts = {r["doc_id"]: (r["text"], r["n_chars"]) for r in got}
    assert texts[20] == ("x [SECRET] y [SECRET] z", 23)
    assert texts[21][0].startswith("[SECRET]") and HEX not in texts[21][0]
    assert texts[2] == (None, None) and texts[1] == ("", 0) and texts[4] == ("word", 4)


def test_empty_table(documents, spark):
    empty = documents([(1, "a")]).where("false")
    assert s.digest(s.find_secrets(empty)).collect() == []
    assert s.redact_secrets(empty).collect() == []
