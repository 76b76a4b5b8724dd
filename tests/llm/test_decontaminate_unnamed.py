import hashlib

from docketry.llm import decontaminate as d


def test_items_without_an_id_hit(spark):
    passage = "a b c d e f g h i j k l m n"
    bench = spark.createDataFrame([(None, passage), (3, "a b c d e f g h i j k l m"), (None, "q r s")], "item_id long, text string")
    docs = spark.createDataFrame([(1, passage), (2, "x q r s"), (3, "nothing here")], "doc_id long, text string")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = [(1, 14, 14, 2, sha("3"), True), (2, 4, 3, 1, sha(""), True), (3, 2, 0, 0, sha(""), False)]
    for limit in (1 << 20, 100):
        assert sorted(tuple(r) for r in d.decontaminate(docs, bench, block_limit=limit).collect()) == want
    assert [r.doc_id for r in d.remove_contaminated(docs, bench).collect()] == [3]
