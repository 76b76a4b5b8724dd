import math
from collections import defaultdict

import pytest

from docketry.llm import mixing as m
from llm_data import ODD, odd_documents


def targets(sizes):
    """Targets by sharing out the excess again and again, as asked."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, out, free = 1.5 * sum(sizes.values()), dict.fromkeys(names, 0.0), set(names)
    while free and total > 1e-9:
        share = total / sum(weight[s] for s in free)
        for s in free:
            out[s] += share * weight[s]
        total = sum(max(0, out[s] - 2 * sizes[s]) for s in free)
        for s in [s for s in free if out[s] >= 2 * sizes[s]]:
            out[s] = 2.0 * sizes[s]
            free.discard(s)
    return out


def words(text):
    return len((text or "").encode().split())


def check(documents, rows):
    """Sizes, targets, and each source near its target."""
    size = defaultdict(int)
    for _, source, text in documents:
        size[source] += words(text)
    want, taken = targets(size), defaultdict(int)
    assert len(rows) == len(documents)
    assert sorted((r.doc_id, r.size) for r in rows if r.doc_id is not None) == sorted((i, words(t)) for i, _, t in documents if i is not None)
    for r in rows:
        assert r.source_size == size[r.source] and math.isclose(r.target, want[r.source], rel_tol=1e-9, abs_tol=1e-6)
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 2
        taken[r.source] += r.taken
    least = {s: min([words(t) for _, x, t in documents if x == s and t] or [0]) for s in size}
    return {s: (taken[s], want[s], least[s]) for s in size}


def test_query(spark, sf):
    documents = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "text").collect()]
    for took, target, _ in check(documents, m.q_mixing(spark, sf).collect()).values():
        assert abs(took - target) <= 0.05 * target


def test_odd_rows(spark):
    frame = odd_documents(spark)
    documents = [(r.doc_id, r.source, r.text) for r in frame.collect()]
    rows = m.mix(frame).collect()
    check(documents, rows)
    assert {r.taken for r in rows if r.size == 0} == {0}
    assert m.mix(odd_documents(spark, [])).count() == 0
    empty = m.mix(odd_documents(spark, [(1, None), (2, " ")])).collect()
    assert {(r.size, r.source_size, r.target, r.taken) for r in empty} == {(0, 0, 0.0, 0)}


def test_a_hot_source_small_ones_and_any_deal_of_the_rows(spark):
    documents = [(i, "hot" if i % 3 else f"s{i % 30}" if i % 2 else None, "w " * (1 + i * i % 97)) for i in range(900)]
    frame = spark.createDataFrame(documents, "doc_id long, source string, text string")
    rows = m.mix(frame).collect()
    for took, target, _ in check(documents, rows).values():
        assert abs(took - target) <= 60
    again = m.mix(frame.repartition(7)).collect()
    assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in again)
    other = m.mix(frame, seed="other").collect()
    assert sorted((r.doc_id, r.taken) for r in rows) != sorted((r.doc_id, r.taken) for r in other)


def test_a_copy_for_each_whole_number_crossed(spark):
    # Equal sizes: copies are the expected number of a source, rounded down or up, and evenly spread over the order.
    documents = [(i, "a" if i % 2 else "b", "one two") for i in range(600)]
    rows = m.mix(spark.createDataFrame(documents, "doc_id long, source string, text string")).collect()
    for source in "ab":
        copies = [r.copies for r in sorted(rows, key=lambda r: r.doc_id) if r.source == source]
        rate = next(r.target / r.source_size for r in rows if r.source == source)
        for i in range(len(copies)):
            assert abs(sum(copies[:i + 1]) - rate * (i + 1)) <= 1 + 1e-6


def test_the_mix_itself(spark):
    frame = odd_documents(spark)
    told = m.mix(frame).groupBy("doc_id").sum("copies").collect()
    rows = m.mixture(frame)
    assert rows.columns == frame.columns
    assert {r[0]: r[1] for r in rows.groupBy("doc_id").count().collect()} == {r[0]: r[1] for r in told if r[1]}
    assert {(r.doc_id, r.text) for r in rows.collect()} <= set(ODD)


def test_sums_go_on_over_batches_and_ranges(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        documents = [(i, f"s{i % 4}" if i % 5 else None, "w " * 3) for i in range(500)]
        rows = m.mix(spark.createDataFrame(documents, "doc_id long, source string, text string")).collect()
        for took, target, _ in check(documents, rows).values():
            assert abs(took - target) <= 3 + 1e-6
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 0, None: 5}, {"a": 1, "b": 1, "c": 100, "d": 3}, {None: 7}])
def test_targets_share_the_excess(spark, sizes):
    frame = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {r.source: r.target for r in m.source_targets(frame).collect()}
    want = targets(sizes)
    assert got.keys() == want.keys() and all(math.isclose(got[s], want[s], abs_tol=1e-9) for s in want)
