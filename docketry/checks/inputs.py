"""Inputs of the registered queries, derived by Spark from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from docketry.functions.paths import uri_bucket, uri_path
from docketry.session import new_folder, spread
from docketry.sinks.files import write_pages
from docketry.sources.envelopes import encode_envelopes
from docketry.streaming.arrivals import Layout


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def file_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as pages of files: ten conversations make one file.

    Turns count from 0 without gaps, so a page number is the number of turns in the
    file's earlier conversations plus the turn. System turns and texts of
    more than one line carry no stamp. Conversation 0 has a stamp that must not match.
    The lines of a turn are its typed texts; a user's first line is a section header.
    """
    turns = load(spark, sf_dir, "conversations")
    per_conversation = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    in_file = Window.partitionBy("file_no").orderBy("conv_id").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_conversation.withColumn("file_no", F.floor(F.col("conv_id") / 10)).select(
        "conv_id", "file_no", F.coalesce(F.sum("n").over(in_file), F.lit(0)).alias("pages_before")
    )
    stamp = F.concat(
        F.lit("\nNum. "), F.col("conv_id").cast("string"), F.lit(" - Pág. "), (F.col("turn") + 1).cast("string")
    )
    unstamped = (F.col("role") == "system") | F.col("text").contains("\n")
    heads = F.col("role") == "user"
    lines = F.transform(
        F.split("text", "\n"),
        lambda line, i: F.struct(
            F.when(heads & (i == 0), "section_header").otherwise("text").alias("label"), line.alias("text")
        ),
    )
    return turns.join(offsets, "conv_id").select(
        F.concat(F.lit("gs://lake/raw/cases_pdf/batch."), F.col("file_no").cast("string"), F.lit(".pdf")).alias("file_path"),
        (F.col("pages_before") + F.col("turn") + 1).alias("page"),
        F.when(unstamped, F.col("text")).otherwise(F.concat("text", stamp)).alias("page_text"),
        F.filter(lines, lambda b: b["text"] != "").alias("blocks"),
    )


def conversation_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents; a user's turn is a section header."""
    turn = F.col("turn").cast("string")
    return load(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("doc_id"),
        F.col("turn").alias("row_idx"),
        F.concat(F.lit("#/texts/"), turn).alias("self_ref"),
        F.when(F.col("role") == "user", "section_header").otherwise("text").alias("label"),
        "text",
    )


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as products of a catalog."""
    return spread(load(spark, sf_dir, "part")).select(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("name"),
        F.concat_ws(" ", "p_name", "p_type").alias("description"),
        F.col("p_brand").alias("category"),
        F.col("p_retailprice").alias("price"),
        F.concat(F.lit("product photo "), F.col("p_name")).alias("image_desc"),
    )


def event_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as a push envelope."""
    payload = F.to_json(F.struct("event_id", "event_type"))
    return encode_envelopes(load(spark, sf_dir, "events").select(payload.alias("json")), "json").select("envelope")


def label_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query vector per label: the mean of all its vectors."""
    return (
        load(spark, sf_dir, "embeddings")
        .select("label", F.posexplode("embedding").alias("pos", "x"))
        .groupBy("label", "pos")
        .agg(F.avg(F.col("x").cast("double")).alias("x"))
        .groupBy(F.col("label").alias("qid"))
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("vector"))
    )


def arrival_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One envelope per page file, and one per web page, which lies elsewhere."""
    files = file_pages(spark, sf_dir).select(F.col("file_path").alias("uri")).distinct()
    others = load(spark, sf_dir, "pages").select(F.col("url").alias("uri"))
    payload = F.to_json(F.struct(uri_bucket(F.col("uri")).alias("bucket"), uri_path(F.col("uri")).alias("name")))
    return encode_envelopes(files.unionByName(others).select(payload.alias("json")), "json").select("envelope")


def install_stream(spark: SparkSession, sf_dir: str) -> Layout:
    """Pages and arrival events as files in a fresh folder, as a stream finds them."""
    layout = Layout(new_folder(spark, "stream"))
    write_pages(file_pages(spark, sf_dir).select("file_path", "page", "page_text"), layout.pages)
    arrival_events(spark, sf_dir).repartition(4).write.parquet(layout.arrivals)
    return layout
