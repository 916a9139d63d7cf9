import random
import re
import time
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from llm_data import ODD_TEXTS, documents, sha  # noqa: F401

from plumbline.llm import personal_data as p


def digits(text):
    return re.sub("[^0-9]", "", text)


def luhn(text):
    d = [int(c) for c in digits(text)][::-1]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


# The patterns of the contract as they are written.
PATTERNS = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda t: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda t: all(int(x) <= 255 for x in t.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda t: 13 <= len(digits(t)) <= 19 and luhn(t)),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: 9 <= len(digits(t)) <= 15),
}


def base(text):
    return [
        (k, m.start(), m.end()) for k, (x, ok) in PATTERNS.items() for m in re.finditer(x, text) if ok(m[0])
    ]


def found(text):
    return [s[:3] for s in p.spans(text) if s[0] in p.BASE_KINDS]


@settings(max_examples=3000, deadline=None)
@given(st.text(alphabet="ab@.-+ 0159()_é\n%", max_size=60))
def test_base_spans_equal_the_patterns(text):
    assert found(text) == base(text)


@settings(max_examples=2000, deadline=None)
@given(
    st.lists(
        st.sampled_from(
            ["1.2.3.4", "255.", ".", "..", "0", "0255.1.1.1", "4111 1111-1111 1111", "4111111111111111", " ", "-", "--", "  ",
             "+49 (30) 123", "456-78", "+", "a.b@c.de", "@", "x@y", "@z.", ".q", "é", "79927398713", "0000000000000", "300.1.1.1"]
        ),
        max_size=12,
    )
)
def test_base_spans_equal_the_patterns_on_parts(parts):
    text = "".join(parts)
    assert found(text) == base(text)


def test_query_against_patterns(documents):
    rnd = random.Random(4)
    parts = ["mail me at ", "a.b+c@d-e.org", ", ", "call +1 (212) 555-0100", " ip 10.0.0.1", "4012 8888 8888 1881", "\n", "é", "7"]
    rows = ODD_TEXTS + [(100 + k, "".join(rnd.choice(parts) for _ in range(rnd.randrange(0, 12)))) for k in range(300)]
    rows += [(None, "x@y.zz"), (900, "x@y.zz"), (900, "x@y.zz")]
    got = p.digest(p.find_personal_data(documents(rows))).collect()
    expected = []
    for i, text in rows:
        own = base(text or "")
        n = Counter(k for k, _, _ in own)
        expected.append((i, *(n[k] for k in p.BASE_KINDS), sha(",".join(f"{k}:{a}:{b}" for k, a, b in own))))
    names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256"]
    assert sorted((tuple(r[c] for c in names) for r in got), key=str) == sorted(expected, key=str)
    for r in got:
        assert {len(s.split(":")) for s in r["spans"].split(",") if s} <= {3}


IBANS = ["DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "FR14 2004 1010 0505 0001 3M02 606"]


def test_account_numbers_need_their_remainder():
    for iban in IBANS:
        text = f"Konto {iban}, bitte"
        assert [(k, text[a:b]) for k, a, b, _ in p.spans(text) if k == "iban"] == [("iban", iban)]
        wrong = text.replace("1", "2", 1)
        assert not any(s[0] == "iban" for s in p.spans(wrong))
    text = f"IBAN {IBANS[1]} THEN MORE WORDS"
    assert [text[a:b] for k, a, b, _ in p.spans(text) if k == "iban"] == [IBANS[1]]


def test_social_security_numbers_need_context():
    assert any(s[0] == "ssn" for s in p.spans("his SSN is 123-45-6789"))
    assert not any(s[0] == "ssn" for s in p.spans("the code is 123-45-6789"))
    assert not any(s[0] == "ssn" for s in p.spans("SSN 000-45-6789, SSN 666-45-6789, SSN 923-45-6789, SSN 123-00-6789"))
    assert not any(s[0] == "ssn" for s in p.spans("example SSN 123-45-6789"))


def test_context_moves_scores():
    def of(text):
        return p.spans(text)[0][3]

    assert of("call me: +1 212 555 0100") > of("see +1 212 555 0100") > of("version +1 212 555 0100")
    assert of("server 10.0.0.1") > of("at 10.0.0.1") > of("version 10.0.0.1")
    far = "server" + " " * (p.REACH + 1) + "10.0.0.1"
    assert of(far) == of("at 10.0.0.1")


def test_base_spans_stay_whatever_their_score():
    (only,) = p.spans("version 10.0.0.1 of the sample")
    assert only[0] == "ip" and only[3] < p.LEAST_SCORE


def test_masking_keeps_rows_and_columns(documents):
    rows = [*ODD_TEXTS, (20, "mail a@b.cd or call +1 212 555 0100 now"), (21, "version 10.0.0.1")]
    docs = documents(rows)
    out = p.mask_personal_data(docs)
    assert out.schema == docs.schema
    got = out.collect()
    assert len(got) == len(rows)
    texts = {r["doc_id"]: r["text"] for r in got}
    assert texts[20] == "mail [EMAIL] or call [PHONE] now" and texts[21] == "version 10.0.0.1"
    assert texts[2] is None and texts[1] == ""


def test_empty_table(documents):
    empty = documents([(1, "a")]).where("false")
    assert p.digest(p.find_personal_data(empty)).collect() == []
    assert p.mask_personal_data(empty).collect() == []


def test_time_is_proportional_to_the_text():
    """Texts of two million characters on which patterns that start again in each run would take hours."""
    size = 2_000_000
    texts = ["a" * size, "1" * size, "1." * (size // 2), "1 " * (size // 2), "+1" + " " * size, "a@" * (size // 2)]
    texts += ["1-" * (size // 2), "+" * size, "AB12" * (size // 4), "a.b@c" * (size // 5), "0.0.0.0." * (size // 8)]
    for text in texts:
        start = time.process_time()
        p.spans(text)
        assert time.process_time() - start < 30, text[:20]
