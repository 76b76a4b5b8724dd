from docketry.llm import sharding as s


def test_sources_that_begin_alike_get_cells_of_their_own(spark):
    rows = [(i, "text", "en", f"https://example.org/{i % 8}" if i % 9 else None) for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    borders = s.string_borders(docs, "source", 32)
    assert borders == [f"https://example.org/{k}".encode() for k in range(7)]
    held = s.shard_documents(docs, shards=8, keep=["source"]).select("shard", "row.source").distinct().groupBy("shard").count().collect()
    # A reader of one source skips shards.
    assert len(held) == 8 and max(r["count"] for r in held) < 8


def test_borders_cut_many_values_evenly(spark):
    docs = spark.createDataFrame([(f"https://{i:05d}",) for i in range(3200)], "source string")
    assert s.string_borders(docs, "source", 32) == [f"https://{i:05d}".encode() for i in range(99, 3199, 100)]
