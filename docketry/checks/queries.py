"""The registered queries: every operator run over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from docketry.checks import inputs
from docketry.checks.inputs import load
from docketry.functions.paths import last_segment, stem, uri_bucket, uri_path
from docketry.functions.vectors import cosine_distance, has_width, norm, unit
from docketry.operators import fulltext, ivf, leaves, postings
from docketry.operators.embedding import IMAGE_SEED, IMAGE_WIDTH, TEXT_WIDTH, embed, embed_hashed
from docketry.operators.knn import knn_exact
from docketry.operators.knn_join import knn_join
from docketry.operators.messages import count_attempts, dead_letter_split, document_messages
from docketry.operators.paging import (
    assemble_documents,
    first_documents,
    page_index,
    page_range_slice,
    page_stamps,
    unconverted,
)
from docketry.operators.sections import attach_sections, attach_sections_join, section_headers
from docketry.plans import case_sections as cases
from docketry.plans import product_catalog as catalog
from docketry.session import materialise, new_folder, spread
from docketry.sinks.catalog import replace_table
from docketry.sinks.objects import write_objects
from docketry.sources.envelopes import decode_envelopes
from docketry.sources.markup import html_text_items
from docketry.sources.objects import read_objects
from docketry.sources.pages import pages_by_lines
from docketry.sources.tables import distinct_prefixes, read_table
from docketry.sinks.files import write_pages
from docketry.streaming.arrivals import Layout, arrived_files, file_events, redeliver, start_index_stream
from docketry.streaming.convert import read_markdown, start_convert_stream
from docketry.streaming.ranges import current_ranges, start_range_stream

Query = Callable[[SparkSession, str], DataFrame]

EVENT = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("event_type", T.StringType())])

VECTOR_WIDTH = 64
SUB_VECTORS = 4
NEIGHBOURS = 10
IMAGE_BUCKET = "lake"
TEXTS_PER_OBJECT = 100

# Query texts of the full-text search, by id.
SEARCHES = {0: "worthless double ring", 1: "La que, des leur", 2: "the DER und"}


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_index(page_stamps(inputs.file_pages(spark, sf_dir)))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(load(spark, sf_dir, "documents"))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(load(spark, sf_dir, "pages"))


def q_page_stamps(spark, sf_dir):
    return page_stamps(inputs.file_pages(spark, sf_dir))


def q_page_index(spark, sf_dir):
    return _index(spark, sf_dir)


def q_first_documents(spark, sf_dir):
    return first_documents(_index(spark, sf_dir))


def q_page_range_slice(spark, sf_dir):
    pages = inputs.file_pages(spark, sf_dir).select("file_path", "page", "page_text")
    return page_range_slice(pages, _index(spark, sf_dir))


def q_document_markdown(spark, sf_dir):
    return assemble_documents(q_page_range_slice(spark, sf_dir))


def q_doc_messages(spark, sf_dir):
    return document_messages(_index(spark, sf_dir))


def q_unconverted_documents(spark, sf_dir):
    index = _index(spark, sf_dir)
    done = index.filter(F.col("min_page") == F.col("max_page"))
    return unconverted(index, done)


def q_case_sections(spark, sf_dir):
    return cases.case_sections(inputs.file_pages(spark, sf_dir))


def _checksum(v: Column) -> Column:
    """One number that depends on every place of the vector."""
    placed = F.transform(v, lambda x, i: x.cast("double") * (i + 1))
    return F.round(F.aggregate(placed, F.lit(0.0), lambda acc, x: acc + x), 3)


def q_case_sections_embedded(spark, sf_dir):
    cases.store_case_sections(inputs.file_pages(spark, sf_dir))
    stored = read_table(spark, cases.NAMESPACE, cases.TABLE)
    return stored.withColumn("text_width", F.size("text_embedding")).withColumn(
        "text_checksum", _checksum(F.col("text_embedding"))
    ).drop("text_embedding")


def q_section_headers(spark, sf_dir):
    return section_headers(inputs.conversation_items(spark, sf_dir))


def q_section_attach(spark, sf_dir):
    return attach_sections_join(inputs.conversation_items(spark, sf_dir))


def q_section_attach_window(spark, sf_dir):
    return attach_sections(inputs.conversation_items(spark, sf_dir))


def q_section_attach_keep_last(spark, sf_dir):
    return attach_sections(inputs.conversation_items(spark, sf_dir), keep_last_section=True)


def q_html_text_items(spark, sf_dir):
    return html_text_items(_pages(spark, sf_dir)).drop("block")


def q_html_sections(spark, sf_dir):
    return attach_sections(html_text_items(_pages(spark, sf_dir)), block="block")


def q_pages_from_text(spark, sf_dir):
    return pages_by_lines(_documents(spark, sf_dir), "doc_id", "text")


def q_uri_parts(spark, sf_dir):
    url = F.col("url")
    return load(spark, sf_dir, "pages").select(
        "page_id",
        uri_bucket(url).alias("bucket"),
        uri_path(url).alias("object_path"),
        last_segment(uri_path(url)).alias("last_segment"),
        stem(uri_path(url)).alias("stem"),
    )


def q_distinct_prefixes(spark, sf_dir):
    return distinct_prefixes(load(spark, sf_dir, "pages"), "url")


def q_object_inventory(spark, sf_dir):
    """The texts of each source as one object, written by the executors and read whole."""
    texts = load(spark, sf_dir, "documents").select("source", "doc_id", "text")
    grouped = texts.groupBy("source", F.floor(F.col("doc_id") / TEXTS_PER_OBJECT).alias("group")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("doc_id", "text"))), lambda d: d["text"]), "\f").alias("body")
    )
    objects = grouped.select(F.format_string("texts/%s-%d.txt", "source", "group").alias("object_path"), F.encode("body", "UTF-8").alias("content"))
    root = new_folder(spark, "objects")
    write_objects(objects, root).count()
    name = F.concat(F.lit("texts/"), last_segment(F.col("file_path")))
    return read_objects(spark, f"{root}/texts", "*.txt").select(name.alias("name"), "size", F.md5("content").alias("md5"))


def q_markdown_objects(spark, sf_dir):
    """One markdown object per document part at its fixed path, read back."""
    documents = q_document_markdown(spark, sf_dir).select("object_path", F.encode("markdown", "UTF-8").alias("content"))
    root = new_folder(spark, "objects")
    write_objects(documents, root).count()
    path = F.regexp_extract("file_path", "(raw/cases_md/.*)$", 1)
    return read_objects(spark, root, "*.md").select(path.alias("object_path"), F.md5("content").alias("md5"))


def q_catalog_enrich(spark, sf_dir):
    return catalog.with_image_uri(inputs.products(spark, sf_dir), IMAGE_BUCKET).drop("image_desc")


def q_catalog_roundtrip(spark, sf_dir):
    name = replace_table(q_catalog_enrich(spark, sf_dir), catalog.NAMESPACE, "enriched_parts")
    return spark.sql(f"SELECT category, count(*) AS n, min(price) AS min_price, max(image_uri) AS max_uri FROM {name} GROUP BY category")


def q_product_catalog(spark, sf_dir):
    catalog.store_product_catalog(inputs.products(spark, sf_dir), IMAGE_BUCKET)
    stored = read_table(spark, catalog.NAMESPACE, catalog.TABLE)
    return stored.withColumns({
        "text_width": F.size("text_embedding"),
        "text_checksum": _checksum(F.col("text_embedding")),
        "image_width": F.size("image_embedding"),
        "image_checksum": _checksum(F.col("image_embedding")),
    }).drop("text_embedding", "image_embedding")


def q_envelope_decode(spark, sf_dir):
    decoded = decode_envelopes(inputs.event_envelopes(spark, sf_dir), EVENT)
    return decoded.select("payload.event_id", "payload.event_type", "reason")


def q_dead_letter_split(spark, sf_dir):
    failed = load(spark, sf_dir, "events").filter(F.col("event_type") == "error")
    retry, dead = dead_letter_split(count_attempts(failed, "user_id"))
    return retry.withColumn("destination", F.lit("retry")).unionByName(dead.withColumn("destination", F.lit("dead_letter")))


def _places(df: DataFrame, key: str) -> DataFrame:
    """The vector's places other than 0, as rows."""
    placed = F.transform("v", lambda x, i: F.struct(i.alias("pos"), x.alias("x")))
    used = F.filter(placed, lambda p: p["x"] != 0)
    return df.select(key, F.size("v").alias("width"), F.explode_outer(used).alias("p")).select(
        key, "width", "p.pos", F.round(F.col("p.x").cast("double"), 6).alias("weight")
    )


def q_text_embeddings(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    return _places(docs.select("doc_id", embed_hashed(F.col("text"), TEXT_WIDTH).alias("v")), "doc_id")


def _vowel_counts():
    """An encoder as a user would bring one: counts of five letters."""
    return lambda texts: np.array([[text.count(letter) for letter in "aeiou"] for text in texts], dtype=float)


def q_custom_embeddings(spark, sf_dir):
    docs = _documents(spark, sf_dir).select("doc_id", embed(F.col("text"), _vowel_counts).alias("v"))
    return docs.select("doc_id", *[F.round(F.col("v")[i].cast("double"), 5).alias(f"v{i}") for i in range(5)])


def q_image_desc_embeddings(spark, sf_dir):
    described = inputs.products(spark, sf_dir)
    return _places(
        described.select("id", embed_hashed(F.col("image_desc"), IMAGE_WIDTH, IMAGE_SEED).alias("v")), "id"
    )


def q_vector_norms(spark, sf_dir):
    v = F.col("embedding")
    return load(spark, sf_dir, "embeddings").select(
        "vec_id", F.round(norm(v), 6).alias("norm"), _checksum(unit(v)).alias("unit_checksum")
    )


def q_vector_width_check(spark, sf_dir):
    v = F.col("embedding")
    return load(spark, sf_dir, "embeddings").select(
        "vec_id", F.size(v).alias("width"), has_width(v, VECTOR_WIDTH).alias("fits")
    )


def _neighbours(found: DataFrame) -> DataFrame:
    return found.select("qid", F.col("id").alias("vec_id"), F.round("distance", 6).alias("distance"), "rank")


def q_knn_cosine(spark, sf_dir):
    return _neighbours(
        knn_exact(inputs.label_queries(spark, sf_dir), load(spark, sf_dir, "embeddings"), "vec_id", "embedding", NEIGHBOURS)
    )


def _ivf(spark, sf_dir, with_codes: bool) -> ivf.IvfIndex:
    return ivf.build_index(
        load(spark, sf_dir, "embeddings"), "vec_id", "embedding", VECTOR_WIDTH, new_folder(spark, "ivf"),
        num_sub_vectors=SUB_VECTORS, with_codes=with_codes,
    )


def q_knn_many(spark, sf_dir):
    """Every vector is a query."""
    table = load(spark, sf_dir, "embeddings")
    queries = table.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"))
    return _neighbours(knn_join(queries, table, "vec_id", "embedding", NEIGHBOURS, exclude_self=True))


def q_ivf_assign(spark, sf_dir):
    """Whether each row lies in the partition of its nearest centre."""
    index = _ivf(spark, sf_dir, with_codes=False)
    centres = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in index.centroids()])
    gaps = F.transform(centres, lambda c: cosine_distance(F.col("vector"), c))
    own = F.element_at("gaps", F.col("part_id") + 1)
    return index.rows().withColumn("gaps", gaps).select(F.col("id").alias("vec_id"), (own <= F.array_min("gaps") + 1e-6).alias("nearest"))


def q_ann_search_full_probe(spark, sf_dir):
    index = _ivf(spark, sf_dir, with_codes=False)
    queries = inputs.label_queries(spark, sf_dir)
    return _neighbours(ivf.search_index(index, queries, NEIGHBOURS, nprobe=ivf.NUM_PARTITIONS, use_codes=False))


def q_ann_search(spark, sf_dir):
    """For each query the number of hits, whether each distance is exact, and whether enough true neighbours are found."""
    table, queries = load(spark, sf_dir, "embeddings"), inputs.label_queries(spark, sf_dir)
    found = ivf.search_index(_ivf(spark, sf_dir, with_codes=True), queries, NEIGHBOURS, nprobe=ivf.NUM_PARTITIONS, refine_factor=30)
    found = found.join(queries, "qid").join(table.select(F.col("vec_id").alias("id"), "embedding"), "id")
    exact = F.abs(F.col("distance") - cosine_distance(F.col("embedding"), F.col("vector"))) < 1e-6
    true = knn_exact(queries, table, "vec_id", "embedding", NEIGHBOURS).select("qid", "id", F.lit(True).alias("true"))
    return found.join(true, ["qid", "id"], "left").groupBy("qid").agg(
        F.count(F.lit(1)).alias("hits"),
        F.bool_and(exact).alias("exact"),
        (F.count("true") >= 0.8 * NEIGHBOURS).alias("recalled"),
    )


PROBES = 5


def q_ann_search_leaves(spark, sf_dir):
    """Every fiftieth document as a query against all: hits, exact distances, and whether all queries together find nine tenths in a part of the rows."""
    table = materialise(_documents(spark, sf_dir).select("doc_id", embed_hashed(F.col("text")).alias("v")), "vectors")
    n = table.count()
    index = leaves.build_index(table, "doc_id", "v", TEXT_WIDTH, new_folder(spark, "leaves"), leaf_rows=max(16, int(0.75 * n ** 0.5)))
    queries = materialise(table.where("doc_id % 50 = 0").select(F.col("doc_id").alias("qid"), F.col("v").alias("vector")), "queries")
    found = leaves.search_index(index, queries, NEIGHBOURS, nprobe=PROBES, refine_factor=100)
    found = found.join(queries, "qid").join(table.select(F.col("doc_id").alias("id"), "v"), "id")
    exact = F.abs(F.col("distance") - cosine_distance(F.col("v"), F.col("vector"))) < 1e-6
    true = knn_join(queries, table, "doc_id", "v", NEIGHBOURS).groupBy("qid").agg(F.max("distance").alias("last"))
    # Copies of one text are equally near: a row as near as the tenth counts.
    told = found.join(true, "qid").groupBy("qid").agg(F.count("*").alias("hits"), F.bool_and(exact).alias("exact"), F.count_if(F.col("distance") <= F.col("last")).alias("near"))
    read = leaves.leaves_of(index, queries, PROBES, PROBES).groupBy("qid").agg(F.sum("n").alias("read"))
    told = materialise(told.join(read, "qid"), "told")
    sums = told.agg(F.sum("hits").alias("hits"), F.sum("near").alias("near"), F.avg("read").alias("read")).first()
    recalled, pruned = sums.near >= 0.9 * sums.hits, sums.read <= 0.4 * n
    return told.select("qid", "hits", "exact", F.lit(recalled).alias("recalled"), F.lit(pruned).alias("pruned"))


def q_fts_postings(spark, sf_dir):
    return fulltext.postings(_documents(spark, sf_dir), "doc_id", "text")


def q_fts_terms(spark, sf_dir):
    return fulltext.term_stats(q_fts_postings(spark, sf_dir))


def q_fts_lengths(spark, sf_dir):
    return fulltext.document_lengths(_documents(spark, sf_dir), "doc_id", "text")


def _hits(found: DataFrame) -> DataFrame:
    return found.select("qid", "doc_id", F.round("score", 6).alias("score"), "rank")


def q_bm25_scan(spark, sf_dir):
    return _hits(fulltext.scan_bm25(_documents(spark, sf_dir), "doc_id", "text", SEARCHES, NEIGHBOURS))


def q_bm25_search(spark, sf_dir):
    index = fulltext.build_index(_documents(spark, sf_dir), "doc_id", "text", new_folder(spark, "fulltext"))
    return _hits(fulltext.search_index(index, SEARCHES, NEIGHBOURS))


def _blocks(spark, sf_dir) -> postings.BlockIndex:
    return postings.build_index(_documents(spark, sf_dir), "doc_id", "text", new_folder(spark, "blocks"))


def q_fts_block_postings(spark, sf_dir):
    return _blocks(spark, sf_dir).postings()


def q_bm25_blocks(spark, sf_dir):
    return _hits(postings.search_index(_blocks(spark, sf_dir), SEARCHES, NEIGHBOURS))


def q_stream_file_arrivals(spark, sf_dir):
    layout = inputs.install_stream(spark, sf_dir)
    files, _ = arrived_files(file_events(spark, layout.arrivals, max_files=2))
    out = f"{layout.root}/arrived"
    (
        files.select("file_path")
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", layout.checkpoint("arrived"))
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    return spark.read.schema("file_path string").parquet(out)


def q_stream_page_index(spark, sf_dir):
    layout = inputs.install_stream(spark, sf_dir)
    start_index_stream(spark, layout, max_files=2).awaitTermination()
    return spark.read.schema("key string, value string").option("recursiveFileLookup", "true").parquet(layout.messages)


def q_stream_redelivery(spark, sf_dir):
    """Half of the files have no pages when they are announced; their events come again."""
    layout = Layout(new_folder(spark, "stream"))
    pages = inputs.file_pages(spark, sf_dir).select("file_path", "page", "page_text")
    early = F.pmod(F.xxhash64("file_path"), F.lit(2)) == 0
    write_pages(pages.filter(early), layout.pages)
    inputs.arrival_events(spark, sf_dir).repartition(4).write.parquet(layout.arrivals)
    start_index_stream(spark, layout).awaitTermination()
    write_pages(pages.filter(~early), layout.pages)
    redeliver(spark, layout)
    start_index_stream(spark, layout).awaitTermination()
    return spark.read.schema("key string, value string").option("recursiveFileLookup", "true").parquet(layout.messages)


def q_stream_page_ranges(spark, sf_dir):
    """Pages come in two lots, and every document's range is widened by the second."""
    layout = Layout(new_folder(spark, "stream"))
    pages = inputs.file_pages(spark, sf_dir).select("file_path", "page", "page_text")
    for lot in (0, 1):
        write_pages(pages.filter(F.col("page") % 2 == lot), layout.pages)
        start_range_stream(spark, layout).awaitTermination()
    return current_ranges(spark, layout)


def q_stream_convert(spark, sf_dir):
    layout = inputs.install_stream(spark, sf_dir)
    start_index_stream(spark, layout, max_files=2).awaitTermination()
    start_convert_stream(spark, layout).awaitTermination()
    return read_markdown(spark, layout).drop("run", "batch", "bucket")


QUERIES: dict[str, Query] = {name[2:]: fn for name, fn in globals().copy().items() if name.startswith("q_")}
