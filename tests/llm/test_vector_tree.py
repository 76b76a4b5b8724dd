import numpy as np
import pytest

from docketry.llm import vector_tree as v


def brute(ids, points, queries, k=10):
    out = {}
    for q in queries:
        gaps = np.sqrt(((points - points[ids.index(q)]) ** 2).sum(axis=1))
        out[q] = sorted((g, i) for g, i in zip(gaps, ids) if i != q)[:k]
    return out


def compare(rows, want):
    got = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    hits = total = 0
    for q, true in want.items():
        found = got.get(q, [])
        assert found == sorted(found) and len(found) <= 10 and all(i != q for _, i in found)
        hits += len({i for _, i in found} & {i for _, i in true})
        total += len(true)
    return hits / max(1, total), got


def test_query_recall(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    ids, points = [r.vec_id for r in table], np.array([r.embedding for r in table], float)
    recall, got = compare(v.q_vector_tree(spark, sf).collect(), brute(ids, points, [i for i in ids if i % 100 == 0]))
    assert recall >= 0.9
    for q, found in got.items():
        for score, i in found:
            assert score == pytest.approx(np.linalg.norm(points[ids.index(q)] - points[ids.index(i)]), abs=1e-12)


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, leaf string, vector int")


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [float(i % 7), float(i // 7), 1.0], 0, None, 1) for i in range(1, 40)]
    rows += [(100, None, 0, "x", 1), (200, [0.0, 0.0, 0.0], 0, None, 1), (300, [nan, 1.0, 1.0], 0, None, 1), (400, [inf, 1.0, 1.0], 0, None, 1),
             (500, [1.0, None, 1.0], 0, None, 1), (600, [1.0, 1.0], 0, None, 1), (None, [1.0, 1.0, 1.0], 0, None, 1), (700, [1.0, 1.0, 1.0], 0, None, 1)]
    index = v.build(table(spark, rows))
    found = v.search(index, index.leaves.where("vec_id % 100 = 0")).collect()
    assert {r.query_id for r in found} == {700}
    good = [(i, e) for i, e, *_ in rows if i is not None and (i < 40 or i == 700)]
    recall, _ = compare(found, brute([i for i, _ in good], np.array([e for _, e in good]), [700]))
    assert recall == 1.0
    assert v.build(table(spark, [])) is None


def test_few_candidates_and_ties(spark):
    rows = [(i, [1.0, 2.0], 0, None, 1) for i in range(4)]
    index = v.build(table(spark, rows))
    found = v.search(index, index.leaves.where("vec_id = 2")).orderBy("rank").collect()
    assert [(r.rank, r.vec_id, r.score) for r in found] == [(1, 0, 0.0), (2, 1, 0.0), (3, 3, 0.0)]


def test_salted_leaves_and_query_blocks(spark, monkeypatch):
    monkeypatch.setattr(v, "GROUP_ROWS", 20)
    monkeypatch.setattr(v, "QUERY_BLOCK", 5)
    rng = np.random.default_rng(0)
    points = np.concatenate([np.ones((100, 4)), rng.normal(size=(200, 4))]).astype(np.float32)
    rows = [(i, [float(x) for x in p], 0, None, 1) for i, p in enumerate(points)]
    index = v.build(table(spark, rows))
    found = v.search(index, index.leaves.where("vec_id % 10 = 0"), visits=index.n_leaves).collect()
    recall, _ = compare(found, brute(list(range(300)), points.astype(float), range(0, 300, 10)))
    assert recall == 1.0


def test_best_bins_are_whole():
    points = np.random.default_rng(1).normal(size=(2000, 8))
    tree = v.grow_tree(points)
    leaves = int((tree["leaf"] >= 0).sum())
    order = v.best_bins(tree, points[0], leaves)
    assert sorted(order) == list(range(leaves))
    assert v.best_bins(tree, points[0], 3) == order[:3]
    assert set(v.leaf_of(tree, points)) <= set(range(leaves))
