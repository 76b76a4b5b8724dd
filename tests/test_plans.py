import pytest
from conftest import rows
from pyspark.sql import functions as F

import __spark_entry__ as entry
from docketry.checks.queries import QUERIES
from docketry.checks import inputs
from docketry.operators.sections import attach_sections_join
from docketry.plans import case_sections as cases
from docketry.plans import product_catalog as catalog
from docketry.operators import fulltext, ivf
from docketry.session import materialise, new_folder, shared_dir

# A few literal products under the declared schema.
PRODUCTS = [
    (1, "Lamp", "Desk lamp with a dimmer", "Home", 19.99, "product photo lamp"),
    (2, "Mug", None, "Kitchen", 7.5, None),
]


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_case_sections_join_form(spark, sf):
    pages = inputs.file_pages(spark, sf)
    ranges = cases.page_index(cases.page_stamps(pages))
    joined = attach_sections_join(cases.document_items(pages, ranges), cases.DOCUMENT_KEY)
    got = rows(cases.case_sections(pages, n=None))
    assert got and got == rows(joined)
    for block_pages in (1, 2, 3):
        assert rows(cases.case_sections(pages, n=None, block_pages=block_pages)) == got


def test_keep_last_section_keeps_more(spark, sf):
    pages = inputs.file_pages(spark, sf)
    some, more = cases.case_sections(pages), cases.case_sections(pages, keep_last_section=True)
    assert more.exceptAll(some).filter(F.col("previous_section_index").isNotNull()).count() == 0
    assert more.count() > some.count()


def test_products(spark):
    name = catalog.store_product_catalog(catalog.products_from_rows(spark, PRODUCTS), "b")
    stored = {r["id"]: r for r in spark.table(name).collect()}
    assert stored[1]["image_uri"] == "gs://b/images/1.jpg" and stored[1]["price"] == 19.99
    assert "image_desc" not in spark.table(name).columns
    assert [len(stored[i][c]) for i in (1, 2) for c in ("text_embedding", "image_embedding")] == [384, 512] * 2
    assert catalog.products_from_rows(spark, []).count() == 0


def test_materialise(spark):
    df = materialise(spark.range(5).withColumn("r", F.rand(1)), "t")
    assert rows(df) == rows(df) and df.count() == 5


def test_shared_folder_is_the_named_one(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plans_have_no_cross_join(spark, sf, name):
    plan = entry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_indexes_of_the_case_table(spark, sf):
    name = cases.store_case_sections(inputs.file_pages(spark, sf), "indexed_ns", n=None, keep_last_section=True)
    built = cases.index_case_sections(spark.table(name), new_folder(spark, "indexes"))
    assert set(built.vectors) == {"text_embedding"}
    text = spark.table(name).orderBy("index_x", "doc_id").first()["text"]
    hits = fulltext.search_index(built.text, {0: text}, 5).collect()
    assert 0 < len(hits) <= 5


def test_indexes_of_the_product_table(spark, sf):
    products = inputs.products(spark, "/root/testdata/sf0.01")
    name = catalog.store_product_catalog(products, "b", "indexed_ns")
    built = catalog.index_product_catalog(spark.table(name), new_folder(spark, "indexes"))
    codes = {c: {len(r[0]) for r in i.rows().select("codes").collect()} for c, i in built.vectors.items()}
    assert codes == {"text_embedding": {12}, "image_embedding": {16}}
    product = spark.table(name).filter("id = 7").first()
    query = spark.createDataFrame([(0, product["text_embedding"])], "qid int, vector array<float>")
    found = ivf.search(query, spark.table(name), "id", "text_embedding", built.vectors["text_embedding"], 5, nprobe=4)
    nearest = found.orderBy("rank").first()
    assert nearest["distance"] == 0.0
    same = spark.table(name).filter(F.col("id") == nearest["id"]).first()["description"]
    assert sorted(same.lower().split()) == sorted(product["description"].lower().split())
