import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from llm_data import DATA, ODD_TEXTS, documents, sorted_rows  # noqa: F401

from plumbline.llm import language_id as g


def held_out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 3 == 1


class PlainTree:
    """Context counts in dictionaries, one byte at a time."""

    def __init__(self, texts):
        whole = Counter()
        for t in texts:
            data = b"\0\0\0" + t.lower().encode()
            whole.update(data[i : i + 4] for i in range(len(data) - 3))
        self.counts = defaultdict(Counter)
        for s, n in whole.items():
            for order in range(4):
                self.counts[s[3 - order : 3]][s[3]] += n

    def bits(self, text):
        data, total = b"\0\0\0" + text.lower().encode(), 0.0
        for i in range(3, len(data)):
            for order in (3, 2, 1, 0):
                seen = self.counts.get(data[i - order : i])
                if not seen:
                    continue
                whole = seen.total() + len(seen)
                if data[i] in seen:
                    total -= math.log2(seen[data[i]] / whole)
                    break
                total -= math.log2(len(seen) / whole)
            else:
                total += 8
        return total


TEXTS = {
    "de": ["der die und ein Haus ist groß", "wir gehen nach Hause und die Kinder auch", "ein alter Baum"],
    "en": ["the house is big and old", "we are going home with the children", "an old tree stands there"],
}


def test_code_lengths_are_exact():
    trees, plain = [], []
    for texts in TEXTS.values():
        block = next(g.blocks(pa.array([t.lower() for t in texts])))
        code, n = np.unique(g.strings(block)[0], return_counts=True)
        trees.append(g.ContextTree.grown(code, n.astype(float)))
        plain.append(PlainTree(texts))
    tried = ["the children", "ein Kind", "", "é漢", "x", "zzz the", "groß"]
    block = next(g.blocks(pa.array([t.lower() for t in tried])))
    got = g.code_lengths(block, trees)
    assert np.allclose(got, [[p.bits(t) for p in plain] for t in tried])


def test_documents(documents):
    rows, langs = list(ODD_TEXTS), [None] * len(ODD_TEXTS)
    for k in range(120):
        lang = "de" if k % 2 else "en"
        rows.append((1000 + k, " ".join(TEXTS[lang][(k + j) % 3] for j in range(3))))
        langs.append(lang)
    rows += [(5000, "12345 ... !!!"), (5001, "the old house")]
    langs += ["en", "fr"]
    docs = documents(rows, langs)
    got = g.identify(docs).collect()
    assert len(got) == len(rows)
    learnt = {x: [t for (i, t), y in zip(rows, langs, strict=True) if y == x and t is not None and not held_out(i)] for x in ("de", "en", "fr")}
    plain = {x: PlainTree(t) for x, t in learnt.items() if t}
    by_row = sorted_rows((r["doc_id"], r["held_out"], r["lang_pred"]) for r in got)
    expected = []
    for i, t in rows:
        letters = t is not None and any(c.isalpha() for c in t)
        expected.append((i, held_out(i), min(plain, key=lambda x: (plain[x].bits(t), x)) if letters else "und"))
    assert by_row == sorted_rows(expected)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_frozen_tree_is_bounded(documents):
    docs = documents([(k, TEXTS["en"][k % 3]) for k in range(60)], "en")
    full, small = g.learn(docs)["en"], g.learn(docs, max_strings=20)["en"]
    assert len(small.codes[0]) <= 20 < len(full.codes[0])


def test_nothing_to_learn_and_empty_table(documents):
    docs = documents(ODD_TEXTS, None)
    assert {(r["lang_pred"], r["score"]) for r in g.identify(docs).collect()} == {("und", 0.0)}
    assert g.identify(docs.where("false")).collect() == []


def test_accuracy_on_given_data(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    judged = [r["lang_pred"] == truth[r["doc_id"]] for r in g.identify(docs).collect() if r["held_out"]]
    assert judged and np.mean(judged) >= 0.95


def test_too_many_languages(documents):
    rows = [(k, f"text {k}") for k in range(600)]
    with pytest.raises(ValueError, match="languages"):
        g.learn(documents(rows, [f"l{k}" for k in range(600)]))
