import zlib
from collections import Counter, defaultdict

import numpy as np

from docketry.llm import sharding as s
from llm_data import ODD, odd_documents


def test_the_curve_visits_every_cell_by_steps_of_one():
    for dims, bits in ((2, 3), (3, 2), (4, 2)):
        side = 1 << bits
        cells = np.array(np.meshgrid(*[range(side)] * dims)).reshape(dims, -1).T
        index = s.hilbert_index(cells, bits)
        assert sorted(index) == list(range(side ** dims))
        walk = cells[np.argsort(index)]
        assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def check(rows, shards):
    sizes = Counter(r.shard for r in rows)
    counts = [sizes.get(k, 0) for k in range(shards)]
    assert sum(counts) == len(rows) and max(counts) - min(counts) <= 1
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_query(spark, sf):
    rows = s.q_sharding(spark, sf).collect()
    check(rows, 16)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r.doc_id: (r.size, r.text_crc32) for r in rows} == {i: (len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in texts.items()}
    assert {r.law for r in rows} == {"rows"} and {r.grown_shard for r in rows} == {None}


def test_odd_rows(spark):
    rows = s.shard_documents(odd_documents(spark)).collect()
    check(rows, 16)
    assert sorted((r.doc_id for r in rows), key=repr) == sorted((i for i, _ in ODD), key=repr)
    assert {r.size for r in rows if r.doc_id in (1, 2)} == {1} and {r.text_crc32 for r in rows if r.doc_id == 1} == {0}
    check(s.shard_documents(odd_documents(spark), shards=3).collect(), 3)
    assert s.shard_documents(odd_documents(spark, [])).count() == 0


def test_a_third_in_one_group(spark):
    rows = [(i, "same text" if i % 3 == 0 else f"text {i}") for i in range(300)]
    out = s.shard_documents(odd_documents(spark, rows)).collect()
    check(out, 16)


def test_files_are_narrow(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    s.write_shards(docs, str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.count() == docs.count()
    per_shard = back.groupBy("__shard").agg({"lang": "approx_count_distinct"}).collect()
    assert np.mean([r[1] for r in per_shard]) < 4
