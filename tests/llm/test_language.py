import numpy as np
import pytest
from pyspark.sql import functions as F

from docketry.llm import language
from llm_data import odd_documents


def test_codewords_differ():
    for n in (2, 3, 4, 6, 9):
        code = language.codewords(n)
        assert len({tuple(row) for row in code}) == n
        assert set(np.unique(code)) <= {-1.0, 1.0}
    assert language.codewords(4).shape == (4, 7)


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = language.identify(docs, language.train(docs)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 20
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.9
    assert all(0 <= r.score <= 1 for r in rows)


def test_odd_rows(spark):
    docs = odd_documents(spark)
    model = language.train(docs)
    rows = {r.doc_id: r for r in language.identify(docs, model).collect() if r.doc_id is not None}
    assert rows[1].lang_pred == rows[2].lang_pred == rows[3].lang_pred == "und" and rows[1].score == 0
    assert language.identify(docs, model).count() == docs.count()
    assert language.identify(docs.limit(0), model).count() == 0


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    row = language.identify(docs, language.train(docs)).first()
    assert (row.lang_pred, row.score) == ("und", 0.0)


def test_one_language_and_no_letter(spark):
    docs = spark.createDataFrame([(i, "der die das und", "de") for i in range(9)] + [(20, "12 34 !!", "de"), (21, "日本", None)], "doc_id long, text string, lang string")
    rows = {r.doc_id: r.lang_pred for r in language.identify(docs, language.train(docs)).collect()}
    assert rows[0] == "de" and rows[20] == "und" and rows[21] == "de"


def test_mixture_is_flagged(spark):
    sums = np.array([[3.0, -3.0], [0.0, 0.0]])
    code = np.array([[1.0, -1.0], [-1.0, 1.0]])
    best, belief, lead = language.decode(sums, np.array([10, 10]), code)
    assert best[0] == 0 and lead[0] > language.LEAD and lead[1] < language.LEAD
    assert belief[1] == pytest.approx(0.5)
