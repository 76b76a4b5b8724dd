import math
import re

from conftest import rows

from docketry.operators import fulltext
from docketry.session import new_folder

DOCS = {
    1: "The cat sat. The CAT!",
    2: "a dog",
    3: "",
    4: None,
    5: "Ação e reação",
    6: "a dog",
    7: "cat dog",
}


def docs(spark):
    return spark.createDataFrame(list(DOCS.items()), "doc_id bigint, text string")


def words(text):
    return re.findall(r"\w+", (text or "").lower())


def brute(query, k):
    n = len(DOCS)
    avg = sum(len(words(t)) for t in DOCS.values()) / n
    scores = {}
    for term in set(words(query)):
        df = sum(term in words(t) for t in DOCS.values())
        for doc, text in DOCS.items():
            tf = words(text).count(term)
            if tf:
                idf = math.log(1 + (n - df + 0.5) / (df + 0.5))
                length = len(words(text))
                scores[doc] = scores.get(doc, 0) + idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / avg))
    ranked = sorted(scores.items(), key=lambda s: (-round(s[1], 9), s[0]))
    return [(d, round(s, 6)) for d, s in ranked[:k]]


def test_postings(spark):
    got = rows(fulltext.postings(docs(spark), "doc_id", "text").filter("doc_id IN (1, 5)"))
    assert got == [(1, "cat", 2), (1, "sat", 1), (1, "the", 2), (5, "ação", 1), (5, "e", 1), (5, "reação", 1)]
    terms = {r[0]: (r[1], r[2]) for r in rows(fulltext.term_stats(fulltext.postings(docs(spark), "doc_id", "text")))}
    assert terms["dog"] == (3, 3) and terms["cat"] == (2, 3)
    assert dict(rows(fulltext.document_lengths(docs(spark), "doc_id", "text")))[4] == 0


def test_ranked_search(spark):
    index = fulltext.build_index(docs(spark), "doc_id", "text", new_folder(spark, "fts"))
    queries = dict(enumerate(("cat dog", "DOG", "ação", "absent", "absent cat cat", "", "!!")))
    for found in (
        fulltext.search_index(index, queries, 3),
        fulltext.scan_bm25(docs(spark), "doc_id", "text", queries, 3),
    ):
        got = found.orderBy("qid", "rank").collect()
        for qid, query in queries.items():
            assert [(r["doc_id"], round(r["score"], 6)) for r in got if r["qid"] == qid] == brute(query, 3), query


def test_queries_without_words(spark):
    index = fulltext.build_index(docs(spark), "doc_id", "text", new_folder(spark, "fts"))
    assert fulltext.search_index(index, {1: "", 2: "?!"}).count() == 0
    assert fulltext.scan_bm25(docs(spark), "doc_id", "text", {1: "", 2: "?!"}).count() == 0


def test_rebuild_replaces_the_index(spark):
    path = new_folder(spark, "fts")
    fulltext.build_index(docs(spark), "doc_id", "text", path)
    index = fulltext.build_index(docs(spark).filter("doc_id = 2"), "doc_id", "text", path)
    assert fulltext.search_index(index, {0: "cat"}).count() == 0
    assert [r["doc_id"] for r in fulltext.search_index(index, {0: "dog"}).collect()] == [2]
