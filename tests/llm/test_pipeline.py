import corpus_pipeline
from docketry.llm import toxicity
from llm_data import LONG, odd_documents
from test_near_dedup_rule import brute as near_brute
from test_decontaminate import brute as bench_brute
from test_personal_data import brute as data_brute
from test_tokens import check_pieces


def staged(spark, docs, sf, path):
    """Every stage's input and output, written and read as the pipeline does."""
    out = []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(f"{path}/{name}")
        after = spark.read.parquet(f"{path}/{name}")
        out.append((docs, after))
        docs = after
    return out


def test_stages_equal_brute_force(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    steps = staged(spark, docs, sf, tmp_path)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "personal_data", "packing"]
    assert all(after.columns == docs.columns for _, after in steps[:-1])
    texts = lambda df: [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]

    model = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    passed = toxicity.score_documents(docs, model).where("predicted = 0").select("doc_id").collect()
    assert sorted(i for i, _ in texts(steps[0][1])) == sorted(r.doc_id for r in passed)

    groups = near_brute(texts(steps[1][0]), 5, 100, 80)
    assert sorted(i for i, _ in texts(steps[1][1])) == sorted(i for i, g in groups.items() if g[2])

    bench = spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()
    clean = [r[0] for r in bench_brute(texts(steps[2][0]), bench) if not r[-1]]
    assert sorted(i for i, _ in texts(steps[2][1])) == sorted(clean)

    masked = dict(texts(steps[3][1]))
    for i, text in texts(steps[3][0]):
        assert (masked[i] == text) == (data_brute(text)[1] == "")
        assert data_brute(masked[i])[1] == ""

    check_pieces(list(masked.items()), steps[4][1].collect())


def test_odd_rows(spark, sf, tmp_path):
    docs = odd_documents(spark)
    steps = staged(spark, docs, sf, tmp_path)
    assert steps[-1][1].count() >= 10
    assert LONG in {r.text for r in steps[3][1].collect()}


def test_nothing(spark, sf, tmp_path):
    assert staged(spark, odd_documents(spark, []), sf, tmp_path)[-1][1].count() == 0


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
