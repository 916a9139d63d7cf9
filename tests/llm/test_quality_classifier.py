import zlib

import numpy as np
import pytest
from llm_data import DATA, ODD_TEXTS, documents, sorted_rows  # noqa: F401

from plumbline.llm import quality_classifier as q


def held_out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 3 == 1


def test_trees_learn_and_flat_walk_equals_nested():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 5)).astype(np.float32)
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] > 0)).astype(float)
    trees = q.grow(x[:1500], y[:1500], 30, 3)
    scores = trees.scores(x[1500:])
    assert ((scores >= 0.5) == (y[1500:] == 1)).mean() > 0.95

    def walk(row):
        total = trees.base
        for f, t, leaf in zip(trees.feature, trees.threshold, trees.leaf, strict=True):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + int(row[f[node]] > t[node])
            total += leaf[node - len(f)]
        return 1 / (1 + np.exp(-total))

    assert np.allclose([walk(r) for r in x[1500:1600]], scores[:100])


def test_statistics_don_t_depend_on_neighbours():
    import pyarrow as pa

    texts = [t for _, t in ODD_TEXTS] + ["Some Words. some words!\nsome more, words"]
    together = np.concatenate([q.statistics(b) for b in q.blocks(pa.array(texts))])
    alone = np.concatenate([q.statistics(b) for t in texts for b in q.blocks(pa.array([t], pa.string()))])
    assert together.shape[1] == len(q.FEATURES) and np.array_equal(together, alone)
    row = dict(zip(q.FEATURES, together[-1], strict=True))
    assert np.expm1(row["log_words"]) == pytest.approx(7, abs=1e-4)
    assert row["distinct_words"] == pytest.approx(6 / 7) and row["top_word"] == pytest.approx(2 / 7)


def test_documents_on_given_data(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    rows = q.score_documents(docs, labels).collect()
    assert len(rows) == docs.count()
    assert all(r["held_out"] == held_out(r["doc_id"]) and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    judged = [(r["predicted"], truth[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([p == t for p, t in judged]) > 0.85


def test_odd_rows(documents, spark):
    docs = documents(ODD_TEXTS + [(100 + k, "good text of words " * 5 if k % 2 else "*** !!! ###") for k in range(90)])
    label_rows = [(100 + k, k % 2, None) for k in range(90)] + [(100, 1, 0), (100, 0, 0), (100, 0, 0), (None, 1, 1), (101, None, 0), (7, None, 0)]
    labels = spark.createDataFrame(label_rows, "doc_id long, quality int, toxic int").selectExpr("*", "1 AS y", "2 AS known_id")
    rows = q.score_documents(docs, labels).collect()
    assert len(rows) == len(ODD_TEXTS) + 90
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert [r["predicted"] for r in sorted(rows, key=lambda r: r["doc_id"] or 0) if 100 <= (r["doc_id"] or 0) < 190] == [0, 1] * 45
    kept = q.keep_good(docs, labels)
    assert kept.columns == docs.columns
    good = sorted_rows((r["doc_id"],) for r in rows if r["predicted"])
    assert sorted_rows((r["doc_id"],) for r in kept.collect()) == good


def test_no_labels_and_empty_tables(documents, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = documents(ODD_TEXTS)
    assert {r["score"] for r in q.score_documents(docs, none).collect()} == {0.5}
    assert q.score_documents(docs.where("false"), none).collect() == []
    assert q.keep_good(docs.where("false"), none).collect() == []


def test_held_out_labels_change_nothing(documents, spark):
    docs = documents([(k, "good words here " * 4 if k % 2 else "*** ###") for k in range(120)])
    rows = [(k, k % 2) for k in range(120)]
    turned = [(k, 1 - y if held_out(k) else y) for k, y in rows]
    scores = [
        sorted_rows(q.score_documents(docs, spark.createDataFrame(r, "doc_id long, quality int")).collect())
        for r in (rows, turned)
    ]
    assert scores[0] == scores[1]
