import zlib

import numpy as np
import pyarrow as pa

from docketry.llm import toxicity as t
from llm_data import ODD, odd_documents


def corpus(spark, n=600):
    """Every fifth document holds an insult."""
    rng = np.random.default_rng(3)
    plain = [f"word{i}" for i in range(300)]
    rows = []
    for i in range(n):
        said = rng.choice(plain, 40).tolist()
        if i % 5 == 0:
            said[rng.integers(40)] = "Vermin!!"
            said[rng.integers(40)] = "filth,"
        rows.append((i, " ".join(said), int(i % 5 == 0)))
    docs = spark.createDataFrame([(i, s) for i, s, _ in rows], "doc_id long, text string")
    return docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"), {i: y for i, _, y in rows}


def test_held_out_rows_are_told_apart(spark):
    docs, labels, truth = corpus(spark)
    rows = t.score_documents(docs, t.train(docs, labels)).collect()
    assert {r.doc_id for r in rows} == set(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    assert all(r.predicted == (r.score >= 0.7) for r in rows)


def test_held_out_labels_are_not_learned(spark):
    docs, labels, _ = corpus(spark)
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(doc_id AS string)) % 3 = 1 THEN 1 - toxic ELSE toxic END AS toxic")
    a, b = t.train(docs, labels), t.train(docs, flipped)
    assert np.array_equal(a[0], b[0]) and np.allclose(a[1], b[1]) and a[2] == b[2]


def test_odd_rows(spark):
    docs, labels, _ = corpus(spark)
    model = t.train(docs, labels)
    odd = odd_documents(spark)
    rows = t.score_documents(odd, model).collect()
    assert sorted((r.doc_id for r in rows), key=repr) == sorted((i for i, _ in ODD), key=repr)
    assert all(0 <= r.score <= 1 for r in rows)
    kept = t.remove_toxic(odd, model)
    assert kept.columns == odd.columns and kept.count() == sum(r.predicted == 0 for r in rows)
    assert t.score_documents(odd.limit(0), model).count() == 0


def test_no_labels(spark):
    docs = odd_documents(spark)
    labels = spark.createDataFrame([(1, None), (None, 1), (4, 7)], "doc_id long, toxic int")
    assert {r.score for r in t.score_documents(docs, t.train(docs, labels)).collect()} == {0.5}


def test_scores_equal_a_plain_sum():
    texts = ["Foo bar, foo baz", None, "", "bar foo " * 5000]
    found = list(t.features(pa.array(texts)))
    keys = np.unique(np.concatenate(found))
    weights = np.linspace(-0.5, 0.5, len(keys))
    want = [1 / (1 + np.exp(-(0.25 + sum(weights[np.searchsorted(keys, f)])))) for f in found]
    assert np.allclose(t.scores(pa.array(texts), (keys, weights, 0.25), t.lookup_bits(keys)), want)
