import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from docketry.checks.inputs import label_queries, load
from docketry.functions.vectors import cosine_distance, norm, unit
from docketry.operators import ivf
from docketry.operators.embedding import IMAGE_WIDTH, TEXT_WIDTH, embed, embed_hashed
from docketry.operators.knn import knn_exact
from docketry.operators.vectors import require_width, split_by_width
from docketry.session import new_folder


def vectors(spark, *data):
    return spark.createDataFrame([(i, v) for i, v in enumerate(data)], "id bigint, v array<float>")


def test_norms(spark):
    got = vectors(spark, [3.0, 4.0], [0.0, 0.0], None).select("id", norm(F.col("v")), unit(F.col("v"))).orderBy("id").collect()
    assert got[0][1] == 5.0 and got[0][2] == [0.6, 0.8]
    assert got[1][1] == 0.0 and got[1][2] is None
    assert got[2][1] is None and got[2][2] is None


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0]), ([1.0, 1.0], [2.0, 2.0]), ([0.0], [1.0])], "a array<float>, b array<float>")
    got = [r[0] for r in df.select(F.round(cosine_distance(F.col("a"), F.col("b")), 9)).collect()]
    assert got == [1.0, 0.0, None]


def test_width(spark):
    df = vectors(spark, [1.0, 2.0], [1.0], None, [1.0, None])
    good, bad = split_by_width(df, "v", 2)
    assert rows(good, "id") == [(0,)] and rows(bad, "id") == [(1,), (2,), (3,)]
    assert require_width(good, v=2).count() == 1
    with pytest.raises(Exception, match="v must hold 2 numbers, found 1"):
        require_width(df.filter("id < 2"), v=2).collect()


@pytest.mark.parametrize("width", [TEXT_WIDTH, IMAGE_WIDTH])
def test_hashed_vectors(spark, width):
    texts = ["Hello, hello world", "hello world HELLO", "", None, "çà 42"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    got = [r[0] for r in df.orderBy("id").select(embed_hashed(F.col("t"), width)).collect()]
    assert all(len(v) == width and abs(np.linalg.norm(v) - 1) < 1e-6 for v in got)
    assert got[0] == got[1] and got[2] == got[3] and got[0] != got[4]
    seeded = df.filter("id = 0").select(embed_hashed(F.col("t"), width, "image")).first()[0]
    assert seeded != got[0]


def test_user_encoder(spark):
    def factory():
        def encode(texts):
            return np.array([[len(t) + 1.0, 1.0, 0.0] for t in texts])

        return encode

    df = spark.createDataFrame([("abc",), ("",), (None,)], "t string")
    got = [r[0] for r in df.select(embed(F.col("t"), factory)).collect()]
    assert np.allclose(got[0], np.array([4.0, 1.0, 0.0]) / np.sqrt(17))
    assert got[1] == got[2] and np.allclose(np.linalg.norm(got[1]), 1)


def brute(queries, table, k, exclude_self=False):
    out = []
    for qid, q in queries:
        scored = []
        for i, v in table:
            if v is None or len(v) != len(q) or (exclude_self and i == qid) or not np.any(v):
                continue
            a, b = np.asarray(v, np.float64), np.asarray(q, np.float64)
            scored.append((round(1 - a @ b / np.linalg.norm(a) / np.linalg.norm(b), 9) + 0.0, i))
        out += [(qid, i, d, rank + 1) for rank, (d, i) in enumerate(sorted(scored)[:k])]
    return out


def same(got, want):
    assert [(a[0], a[1], a[3]) for a in got] == [(a[0], a[1], a[3]) for a in want]
    assert np.allclose([a[2] for a in got], [a[2] for a in want], atol=2e-9)


def data(seed, n, width=6):
    rng = np.random.default_rng(seed)
    table = [(i, [float(np.float32(x)) for x in rng.normal(size=width)]) for i in range(n)]
    table[3] = (3, table[2][1])  # equal vectors: the lower id wins
    table[7] = (7, [0.0] * width)
    table[8] = (8, [1.0])
    table[9] = (9, None)
    return table


@pytest.mark.parametrize("max_cells", [4_000_000, 12], ids=["scan", "blocks"])
@pytest.mark.parametrize("exclude_self", [False, True])
def test_exact_neighbours(spark, max_cells, exclude_self):
    table = data(1, 120)
    queries = [(i, v) for i, v in table if v is not None and len(v) == 6 and i != 7][:15]
    t = spark.createDataFrame(table, "id bigint, v array<float>").repartition(5)
    q = spark.createDataFrame(queries, "qid bigint, vector array<float>")
    got = knn_exact(q, t, "id", "v", 4, exclude_self, max_query_cells=max_cells)
    same([tuple(r) for r in got.orderBy("qid", "rank").collect()], brute(queries, table, 4, exclude_self))


def test_string_ids_and_no_queries(spark):
    t = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [1.0, 0.0])], "id string, v array<float>")
    q = spark.createDataFrame([("q", [2.0, 0.0])], "qid string, vector array<double>")
    for cells in (100, 1):
        got = knn_exact(q, t, "id", "v", 2, max_query_cells=cells).orderBy("rank").collect()
        assert [r["id"] for r in got] == ["a", "c"]
    assert knn_exact(q.limit(0), t, "id", "v").count() == 0


@pytest.fixture(scope="module")
def index(spark):
    table = load(spark, "/root/testdata/sf0.001", "embeddings")
    return ivf.build_index(table, "vec_id", "embedding", 64, new_folder(spark, "ivf"))


def ids(found):
    got = {}
    for r in found.collect():
        got.setdefault(r["qid"], set()).add(r["id"])
    return got


def test_index_holds_every_row_once(spark, index, sf):
    stored = index.rows()
    assert rows(stored, "id") == rows(load(spark, sf, "embeddings").select("vec_id"))
    assert {len(r[0]) for r in stored.select("codes").collect()} == {2}
    assert stored.select("part_id").distinct().count() == ivf.NUM_PARTITIONS


def test_all_partitions_without_codes_is_exact(spark, index, sf):
    queries = label_queries(spark, sf)
    exact = knn_exact(queries, load(spark, sf, "embeddings"), "vec_id", "embedding", 10)
    full = ivf.search_index(index, queries, 10, nprobe=4, use_codes=False)
    assert rows(exact) == rows(full)


def test_recall_grows_with_probes(spark, index, sf):
    queries = label_queries(spark, sf)
    exact = ids(knn_exact(queries, load(spark, sf, "embeddings"), "vec_id", "embedding", 10))

    def recall(nprobe):
        found = ids(ivf.search_index(index, queries, 10, nprobe=nprobe))
        return sum(len(exact[q] & found.get(q, set())) for q in exact) / sum(len(s) for s in exact.values())

    at = [recall(n) for n in (1, 2, 4)]
    assert at[0] <= at[1] <= at[2] and at[2] >= 0.9


def test_small_table_and_odd_width(spark):
    table = vectors(spark, *[[float(i + 1), 1.0, 2.0] for i in range(30)])
    path = new_folder(spark, "ivf")
    ivf.build_index(table, "id", "v", 3, path, num_sub_vectors=2)
    index = ivf.open_index(spark, path)
    q = spark.createDataFrame([(0, [1.0, 1.0, 2.0]), (1, [9.0, 1.0, 2.0])], "qid bigint, vector array<float>")
    found = ivf.search(q, table, "id", "v", index, k=1, nprobe=4)
    assert rows(found, "qid", "id") == [(0, 0), (1, 8)]
    # One query at a time gives the same.
    assert rows(ivf.search_index(index, q, 1, nprobe=4, max_query_cells=1), "qid", "id") == [(0, 0), (1, 8)]
    assert rows(ivf.search(q, table, "id", "v", None, k=1), "qid", "id") == [(0, 0), (1, 8)]


def test_a_rebuilt_index_is_published_whole(spark):
    path = new_folder(spark, "ivf")
    with pytest.raises(ValueError):
        ivf.open_index(spark, path)
    first = ivf.build_index(vectors(spark, [1.0, 0.0], [0.0, 1.0]), "id", "v", 2, path)
    ivf.build_index(vectors(spark, [1.0, 0.0], [0.0, 1.0], [1.0, 1.0]), "id", "v", 2, path, with_codes=False)
    assert ivf.open_index(spark, path).rows().count() == 3 and first.rows().count() == 2
    empty = ivf.build_index(vectors(spark, [1.0, 0.0]).limit(0), "id", "v", 2, new_folder(spark, "ivf"))
    q = spark.createDataFrame([(0, [1.0, 1.0])], "qid bigint, vector array<float>")
    assert ivf.search_index(empty, q, 3).count() == 0
