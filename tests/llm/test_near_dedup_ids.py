"""One id with two texts: each is judged by its own set."""

from docketry.llm import near_dedup as n
from test_near_dedup import edits


def test_an_id_with_two_texts_that_each_have_a_copy(spark):
    x, y, z = ([f"{c}{i}" for i in range(200)] for c in "xyz")
    rows = [(7, " ".join(x)), (7, " ".join(y)), (8, edits(x, 1, 2)), (9, edits(y, 2, 2)), (3, " ".join(z)), (9, "a text of its own")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in n.near_copies(docs).collect())
    assert out == [(3, 198, 3, True), (7, 198, 7, True), (7, 198, 7, True), (8, 198, 7, False), (9, 3, 9, True), (9, 198, 7, False)]
    # The copies go, and not the unique text that shares an id with one.
    left = sorted((r.doc_id, r.text) for r in n.remove_near_copies(docs).collect())
    assert left == sorted([rows[0], rows[1], rows[4], rows[5]])


def test_a_component_gets_its_smallest_id(spark):
    x = [f"x{i}" for i in range(200)]
    rows = [(i, edits(x, i, i % 3)) for i in (50, -4, 12, 7, 33, 12)] + [(7, "something else"), (40, None)]
    out = n.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in out) == sorted([(i, -4) for i in (50, -4, 12, 7, 33, 12)] + [(7, 7), (40, 40)])
