import numpy as np

from docketry.llm import vector_tree as v


def test_every_query_gets_ten(spark):
    """A tight cluster of easy queries, pairs far out, and one id that fills a leaf of its own."""
    rng = np.random.default_rng(2)
    points = [rng.normal(0, 1e-3, (600, 4)) + 1]
    points += [rng.normal(0, 1e-3, (2, 4)) + 100 * rng.normal(size=4) for _ in range(30)]
    points = np.concatenate(points)
    ids = list(range(len(points)))
    far = 1000 + rng.normal(0, 1e-3, (15, 4))
    points, ids = np.concatenate([points, far]), ids + [5000] * len(far)
    docs = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in zip(ids, points)], "vec_id long, embedding array<double>")
    index = v.build(docs)
    queries = index.leaves.where("vec_id % 10 = 0")
    for visits in (1, None):
        found = v.search(index, queries, visits=visits).groupBy("query_id").count().collect()
        assert {r["query_id"] for r in found} == {i for i in ids if i % 10 == 0}
        assert {r["count"] for r in found} == {10}
    few = v.build(docs.where("vec_id < 4"))
    assert {r["count"] for r in v.search(few, few.leaves).groupBy("query_id").count().collect()} == {3}
