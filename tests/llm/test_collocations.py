import random
import re
import tracemalloc
from collections import Counter

import pyarrow as pa
from llm_data import ODD_TEXTS, documents  # noqa: F401
from pyspark.sql import functions as F

from plumbline.llm import collocations as c


def plain(rows, most_words=3, least=10, top=2000, scale=c.SCALE):
    """(lang, rank, phrase, a, l, r, n, score) from separate counts of all phrases."""
    f = Counter()
    for lang, text in rows:
        lower = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            w = re.findall("[^\x20\x09]+", piece)
            for i in range(len(w)):
                f[lang or "und", ()] += 1
                for k in range(1, most_words + 1):
                    if i + k <= len(w):
                        f[lang or "und", tuple(w[i : i + k])] += 1
    found = {(g, p): a for (g, p), a in f.items() if len(p) > 1 and a >= least}
    out = []
    for (g, p), a in found.items():
        cuts = [(scale * a * a // (f[g, p[:k]] * f[g, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        if not any(
            h == g and len(q) > len(p) and 100 * b >= 50 * a and any(q[i : i + len(p)] == p for i in range(len(q)))
            for (h, q), b in found.items()
        ):
            out.append((g, " ".join(p), a, f[g, p[:k]], f[g, p[k:]], f[g, ()], score))
    ranked = []
    for g in {x[0] for x in out}:
        own = sorted((x for x in out if x[0] == g), key=lambda x: (-x[6], -x[2], x[1].encode()))[:top]
        ranked += [(g, i, *x[1:]) for i, x in enumerate(own, 1)]
    return sorted(ranked)


def got(frame):
    return sorted(tuple(r) for r in frame.collect())


def make_rows(seed, n=60):
    rnd = random.Random(seed)
    words = ["New", "york", "City", "é", "a", "B", "漢字", "\U0001f600", "x\x1cy", "A-b", "ÉÉ"]
    ends = [" ", "  ", "\t", " ", " ", ". ", ",", "\n", "\x0b", "; ", "! ", "?"]
    langs = ["en", "de", None, "und"]
    return [
        (rnd.choice(langs), "".join(rnd.choice(words) + rnd.choice(ends) for _ in range(rnd.randrange(0, 120))))
        for _ in range(n)
    ]


def test_against_separate_counts(documents):
    rows = make_rows(1) + [(None, None), ("en", ""), ("en", " \t.,")] + [("fr", "one two three four")] * 10
    docs = documents([(1, t) for _, t in rows], lang=[g for g, _ in rows])
    assert got(c.collocations(docs)) == plain(rows)
    assert got(c.collocations(docs, least=25, top=5)) == plain(rows, least=25, top=5)


def test_other_orders(documents):
    rows = make_rows(2, 40)
    docs = documents([(1, t) for _, t in rows], lang=[g for g, _ in rows])
    for most in (2, 4):
        assert got(c.collocations(docs, most_words=most, least=6)) == plain(rows, most, least=6)


def test_a_longer_candidate_replaces_what_it_holds(documents):
    rows = [("en", "red green blue")] * 10 + [("en", "green blue")] * 10 + [("en", "red green")] * 11
    found = {r["phrase"] for r in c.collocations(documents([(1, t) for _, t in rows])).collect()}
    # 10 of 20 is half, 10 of 21 is not.
    assert found == {"red green blue", "red green"}


def test_scores_are_exact_beyond_64_bits(spark):
    big = 4_000_000_007
    counts = spark.createDataFrame(
        [("en", 0, "", 9 * big), ("en", 1, "a", big), ("en", 1, "b", big + 1), ("en", 2, "a b", big - 1)],
        "lang string, words int, phrase string, f long",
    )
    (row,) = c.scored(counts).collect()
    assert row["score"] == c.SCALE * (big - 1) ** 2 // (big * (big + 1)) and row["l"] == big


def test_odd_texts_and_empty_table(documents):
    docs = documents(ODD_TEXTS * 10)
    assert got(c.collocations(docs)) == plain([("en", t) for _, t in ODD_TEXTS] * 10)
    assert c.collocations(docs.where("false")).collect() == []


def test_one_word_in_a_third_of_all_places(documents):
    rows = [("en", "hot " * 5_000)] * 2 + make_rows(3)
    docs = documents([(1, t) for _, t in rows], lang=[g for g, _ in rows]).repartition(8)
    assert got(c.collocations(docs)) == plain(rows)


def test_windows_travel_once(documents):
    """Windows are shuffled by their first words, and what ROLLUP sums to; nothing in between."""
    counts = c.phrase_counts(documents([(1, "a b c d")] * 10))
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2 and plan.count("Scan") == 1
    assert counts.agg(F.sum("f")).first()[0] == 40 + 40 + 30 + 20


def test_blocks_and_parts_of_texts_change_nothing(documents):
    rows = make_rows(4, 30) + [("en", " ".join(t or "" for _, t in make_rows(5, 40))), ("de", "x" * 500), ("en", " a  b ")]
    docs = documents([(1, t) for _, t in rows], lang=[g for g, _ in rows])

    def windows(block_bytes, most_words):
        found = Counter()
        for r in c.top_windows(docs, most_words, block_bytes).collect():
            for w, n in zip(r["windows"].split("\t"), r["n"], strict=True):
                found[r["bucket"], r["lang"], w] += n
        return found

    for most_words in (2, 3, 4):
        whole = windows(1 << 20, most_words)
        for block_bytes in (1, 7, 64, 1000):
            assert windows(block_bytes, most_words) == whole


def test_memory_of_a_long_text_is_bounded():
    """Windows of one text of 24 MB, from parts of 4 MB."""
    rnd = random.Random(6)
    text = pa.array([" ".join("".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(200_000)) * 20], pa.large_string())
    tracemalloc.start()
    n = sum(len(x) for x, _ in c._parts(text[0], 3, c.BLOCK_BYTES))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(text[0].as_py()) <= n < len(text[0].as_py()) + 200 and peak < 10 * len(text[0].as_py())
