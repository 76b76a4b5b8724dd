import os

import numpy as np
import pytest
from conftest import rows

from docketry.operators import fulltext, postings as p
from docketry.session import new_folder
from test_fulltext import brute, docs


@pytest.fixture(scope="module")
def corpus(spark):
    """Frequent words in nearly all texts, rare ones in few."""
    rng = np.random.default_rng(6)
    common, rare = [f"common{i}" for i in range(5)], [f"rare{i}" for i in range(300)]
    texts = [(i * 3, " ".join([*rng.choice(common, rng.integers(3, 30)), *(rng.choice(rare, 1) if rng.random() < 0.3 else [])])) for i in range(15000)]
    return spark.createDataFrame(texts, "doc_id bigint, text string").repartition(4)


@pytest.fixture(scope="module")
def index(spark, corpus):
    return p.build_index(corpus, "doc_id", "text", new_folder(spark, "blocks"), term_buckets=4)


def test_packing_round_trip():
    rng = np.random.default_rng(1)
    for n, top in ((1, 5), (2, 300), (128, 70_000), (128, 1 << 33)):
        numbers = np.sort(rng.choice(min(top * 10, 1 << 40), n, replace=False)) if top < 1 << 30 else np.cumsum(rng.integers(1, top, n))
        counts, lengths = rng.integers(1, top, n), rng.integers(1, 300, n)
        back = p.unpack(p.pack(numbers, counts, lengths), int(numbers[0]), n)
        assert all(np.array_equal(a, b) for a, b in zip(back, (numbers, counts, lengths)))


def test_postings_are_all_there_in_half_the_space(spark, corpus, index):
    assert rows(index.postings(), "doc_id", "term", "tf") == rows(fulltext.postings(corpus, "doc_id", "text"), "doc_id", "term", "tf")
    plain = fulltext.build_index(corpus, "doc_id", "text", new_folder(spark, "plain"), term_buckets=4)
    size = lambda path: sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet"))
    assert size(f"{index.path}/blocks") <= size(f"{plain.path}/postings") / 2
    most = index.blocks().agg({"n": "max"}).first()[0]
    assert most <= p.BLOCK


QUERIES = {0: "rare7 common0", 1: "common0 common1 common2", 2: "rare1 rare2 common3", 3: "absent", 4: "rare299", 5: "absent common4", 6: ""}


@pytest.mark.parametrize("k", [1, 10, 100])
def test_search_equals_a_scan(spark, corpus, index, k):
    want = fulltext.scan_bm25(corpus, "doc_id", "text", QUERIES, k)
    got = p.search_index(index, QUERIES, k)
    key = lambda df: [(r.qid, r.doc_id, round(r.score, 6), r["rank"]) for r in df.orderBy("qid", "rank").collect()]
    assert key(got) == key(want)


def test_blocks_that_cannot_matter_are_not_read(spark, index):
    read = spark.sparkContext.accumulator(0)
    query = {0: "rare7 rare8 rare9 common0 common1"}
    p.search_index(index, query, 3, read).collect()
    held = index.terms(query[0].split()).agg({"df": "sum"}).first()[0]
    assert 0 < read.value < held / 2


def test_small_texts_and_reopening(spark):
    path = new_folder(spark, "blocks")
    with pytest.raises(ValueError):
        p.open_index(spark, path)
    p.build_index(docs(spark), "doc_id", "text", path)
    index = p.open_index(spark, path)
    queries = dict(enumerate(("cat dog", "DOG", "ação", "absent", "absent cat cat", "", "!!")))
    got = p.search_index(index, queries, 3).orderBy("qid", "rank").collect()
    for qid, query in queries.items():
        assert [(r.doc_id, round(r.score, 6)) for r in got if r.qid == qid] == brute(query, 3)
    empty = p.build_index(docs(spark).limit(0), "doc_id", "text", new_folder(spark, "blocks"))
    assert p.search_index(empty, queries, 3).count() == 0 and empty.postings().count() == 0


def test_only_the_terms_asked_for_are_read(index):
    plan = index.blocks(["rare7"])._jdf.queryExecution().executedPlan().toString()
    assert "term_bucket" in plan.split("PartitionFilters")[1].split("PushedFilters")[0] and "EqualTo(term,rare7)" in plan
