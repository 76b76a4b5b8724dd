"""Plans that must stay as they are for the sake of scale."""

import re

import pytest
from pyspark.sql import functions as F

from docketry.checks import inputs, queries
from docketry.operators.knn import knn_exact
from docketry.operators.paging import first_documents, page_index, page_stamps
from docketry.operators.sections import attach_sections
from docketry.sources.markup import html_text_items
from docketry.sources.objects import object_inventory


def final_plan(df):
    """The plan as adaptive execution ended up running it."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_markup_is_cut_and_shuffled_once(spark, sf, no_broadcast):
    items = html_text_items(inputs.load(spark, sf, "pages"), block_pages=8)
    plan = final_plan(attach_sections(items, block="block"))
    assert len(re.findall("Scan parquet", plan)) == 1
    assert len(re.findall("Generate posexplode", plan)) == 1
    assert "ReusedExchange" in plan


def test_section_attach_shuffles_the_items_once(spark, sf, no_broadcast):
    plan = final_plan(attach_sections(inputs.conversation_items(spark, sf), block_rows=2))
    assert len(re.findall("Scan parquet", plan)) == 1
    assert len(re.findall(r"[+:]- Exchange hashpartitioning\(doc_id#\d+L, block#\d+L", plan)) == 2  # items, borders


def test_rank_filter_runs_before_the_shuffle(spark, sf):
    plan = final_plan(first_documents(page_index(page_stamps(inputs.file_pages(spark, sf)))))
    assert re.search(r"WindowGroupLimit .*Partial", plan)


def test_index_aggregates_before_the_shuffle(spark, sf):
    assert "partial_min" in final_plan(queries.q_page_index(spark, sf))


def test_filters_and_columns_reach_the_scan(spark, sf, tmp_path):
    inputs.conversation_items(spark, sf).write.parquet(str(tmp_path / "items"))
    stored = spark.read.parquet(str(tmp_path / "items"))
    plan = queries.section_headers(stored)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(label,section_header)" in plan
    width = queries.q_vector_width_check(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<vec_id:bigint,embedding:array<float>>" in width


def test_inventory_reads_no_content(spark, sf):
    plan = object_inventory(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"ReadSchema: struct<path:string,length:bigint>", plan)


def test_text_is_cut_once_per_row(spark, sf):
    plan = queries.q_fts_postings(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_extract_all") == 1


def test_exact_search_does_not_shuffle_the_table(spark, sf):
    plan = queries.q_knn_cosine(spark, sf)._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("MapInArrow"):]
    assert "Exchange" not in below and "WindowGroupLimit" in plan


def test_all_vectors_as_queries_move_no_vector(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    found = knn_exact(table.selectExpr("vec_id AS qid", "embedding AS vector"), table, "vec_id", "embedding", 10, exclude_self=True)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Exchange" not in plan[plan.rindex("MapInArrow"):] and "Join" not in plan


def test_postings_are_not_shuffled(spark, sf):
    assert "hashpartitioning" not in queries.q_fts_postings(spark, sf)._jdf.queryExecution().executedPlan().toString()


def test_hot_document_is_many_tasks(spark):
    """One document with most of the rows is cut into blocks, and no block exceeds its bound."""
    rows = spark.range(20_000).select(
        F.when(F.col("id") < 15_000, "hot").otherwise(F.concat(F.lit("d"), F.col("id") % 50)).alias("doc_id"),
        F.when(F.col("id") < 15_000, F.col("id")).otherwise(F.floor((F.col("id") - 15_000) / 50)).alias("row_idx"),
        F.when(F.col("id") % 7 == 0, "section_header").otherwise("text").alias("label"),
        F.col("id").cast("string").alias("text"),
    )
    small = attach_sections(rows, block_rows=500)
    assert small.exceptAll(attach_sections(rows)).count() == 0 and small.count() == attach_sections(rows).count()
    sizes = rows.groupBy("doc_id", F.floor(F.col("row_idx") / 500)).count().agg(F.max("count")).first()[0]
    assert sizes == 500
