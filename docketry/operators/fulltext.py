"""Full-text index and ranked search (BM25).

The index is three tables in a published version folder: postings, terms and corpus totals. A document's words are counted
inside its row, so its postings are never shuffled to be added up; a term may occur in every document, so no step gathers a
term's postings.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession, Window, functions as F, types as T

from docketry.functions.given import given
from docketry.functions.pieces import pieces
from docketry.functions.text import tokens
from docketry.session import materialise
from docketry.sinks.versions import new_version, publish, published

# Own choice of the usual constants.
K1 = 1.2
B = 0.75

# Folders of an index unless the builder says otherwise; the number is stored with the index.
TERM_BUCKETS = 64
# Query words that travel with the tasks; more are joined like any table.
MAX_BROADCAST_TERMS = 100_000


def _words(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(key, tokens(F.col(text)).alias("words"))


def _occurrences(words: DataFrame, *columns: Column | str) -> DataFrame:
    # The outer form: the plain one filters on the array first and so cuts the text twice.
    return words.select(*columns, F.explode_outer("words").alias("term")).filter(F.col("term").isNotNull())


COUNTED = T.ArrayType(T.StructType([T.StructField("term", T.StringType()), T.StructField("tf", T.LongType())]))


def _counted(column: str) -> Column:
    """Distinct words of each row and how often each occurs; the words of a piece of a batch are numbered and counted at once."""

    def counted(words: pa.Array) -> pa.Array:
        rows = np.repeat(np.arange(len(words)), pc.fill_null(pc.list_value_length(words), 0).to_numpy())
        coded = words.flatten().dictionary_encode()
        size = max(1, len(coded.dictionary))
        pairs, counts = np.unique(rows * size + coded.indices.to_numpy(), return_counts=True)
        row, code = np.divmod(pairs, size)
        ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(words)))]).astype(np.int32)
        terms = coded.dictionary.take(pa.array(code))
        return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([terms, pa.array(counts.astype(np.int64))], ["term", "tf"]))

    @F.arrow_udf(COUNTED)
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return map(counted, pieces(batches))

    return count(column)


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """`(key, term, tf)` for every word of every document, whole texts; a row is a document, and nothing is shuffled."""
    return _words(docs, key, text).select(key, F.inline(_counted("words")))


def term_stats(posting_rows: DataFrame) -> DataFrame:
    """In how many documents a term occurs, and how often."""
    return posting_rows.groupBy("term").agg(
        F.count(F.lit(1)).alias("df"), F.sum("tf").cast("bigint").alias("total")
    )


def document_lengths(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(key, F.size(tokens(F.col(text))).cast("bigint").alias("length"))


def _idf(df: Column, n: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def _weight(tf: Column, length: Column, avg_length: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / avg_length))


def query_terms(spark: SparkSession, queries: Mapping[int, str]) -> list[Row]:
    """`(qid, term)`: the distinct words of each query, cut as the texts are."""
    frame = spark.createDataFrame(list(queries.items()), "qid bigint, query string")
    return frame.select("qid", F.explode(F.array_distinct(tokens(F.col("query")))).alias("term")).orderBy("qid", "term").collect()


def _ranked(scored: DataFrame, key: str, k: int) -> DataFrame:
    """Top `k` of each query; equal up to the ninth digit means equal, then the key decides."""
    order = Window.partitionBy("qid").orderBy(F.desc(F.round("score", 9)), key)
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "qid", key, "score", "rank"
    )


def scan_bm25(docs: DataFrame, key: str, text: str, queries: Mapping[int, str], k: int = 10) -> DataFrame:
    """`(qid, key, score, rank)` without an index: one pass over the texts, no wide shuffle.

    The pass counts the queries' words inside each row and keeps a few numbers per
    document; totals and scores are computed from these.
    """
    by_query: dict[int, list[str]] = {}
    for row in query_terms(docs.sparkSession, queries):
        by_query.setdefault(row["qid"], []).append(row["term"])
    terms = sorted({t for words in by_query.values() for t in words})
    listed = F.array(*[F.lit(t) for t in terms]).cast("array<string>")
    hits = F.filter("words", lambda w: F.array_contains(listed, w))
    counts = given(hits, lambda found: F.transform(listed, lambda t: F.size(F.filter(found, lambda h: h == t))))
    counted = _words(docs, key, text).select(key, F.size("words").cast("bigint").alias("length"), counts.alias("tf"))
    # The totals are taken on the way; only documents with a hit are kept.
    seen = Observation()
    counted = counted.observe(
        seen,
        F.count(F.lit(1)).alias("n"),
        F.sum("length").alias("length"),
        *[F.sum(F.when(F.col("tf")[i] > 0, 1).otherwise(0)).alias(f"df{i}") for i in range(len(terms))],
    )
    counted = materialise(counted.filter(F.exists("tf", lambda n: n > 0)), "bm25")
    totals = dict(seen.get)
    totals["avg_length"] = (totals["length"] or 0) / max(totals["n"], 1)

    def weight(term: str) -> Column:
        i = terms.index(term)
        idf = _idf(F.lit(totals[f"df{i}"]), F.lit(totals["n"]))
        return idf * _weight(F.col("tf")[i], F.col("length"), F.lit(totals["avg_length"]))

    per_query = [
        F.struct(F.lit(qid).cast("bigint").alias("qid"), reduce(add, map(weight, words)).alias("score"))
        for qid, words in by_query.items()
    ]
    if not per_query:
        return _ranked(counted.limit(0).select(F.lit(0).cast("bigint").alias("qid"), key, F.lit(0.0).alias("score")), key, k)
    scored = counted.select(key, F.inline(F.array(*per_query)))
    return _ranked(scored.filter(F.col("score") > 0), key, k)


POSTINGS_SCHEMA = "length bigint, term string, tf bigint, term_bucket int"
TERMS_SCHEMA = "term string, df bigint, total bigint, term_bucket int"


@dataclass
class TextIndex:
    """A published build; `path` is its version folder."""

    spark: SparkSession
    path: str
    key: str
    key_type: str
    term_buckets: int


def open_index(spark: SparkSession, path: str) -> TextIndex:
    """The published index below `path`, in any session; `ValueError` if there is none."""
    facts = published(spark, path)
    if facts is None:
        raise ValueError(f"no index below {path}")
    return TextIndex(spark, facts["folder"], facts["key"], facts["key_type"], int(facts["term_buckets"]))


def _term_bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")


def build_index(docs: DataFrame, key: str, text: str, path: str, term_buckets: int = TERM_BUCKETS) -> TextIndex:
    """Write a new version of the index below `path`, then publish it.

    Postings carry the document length, so search joins nothing large. They are laid
    out by ranges of bucket, term and document: a search reads few files, and a
    frequent term is cut into as many as its rows need.
    """
    spark, folder = docs.sparkSession, new_version(path)
    length = F.size("words").cast("bigint").alias("length")
    rows = _words(docs, key, text).select(key, length, F.inline(_counted("words"))).withColumn("term_bucket", _term_bucket(term_buckets))
    (
        rows.repartitionByRange("term_bucket", "term", key)
        .sortWithinPartitions("term_bucket", "term")
        .write.partitionBy("term_bucket")
        .parquet(f"{folder}/postings")
    )
    stored = spark.read.schema(f"{key} {docs.schema[key].dataType.simpleString()}, {POSTINGS_SCHEMA}").parquet(f"{folder}/postings")
    (
        term_stats(stored)
        .withColumn("term_bucket", _term_bucket(term_buckets))
        .repartitionByRange("term_bucket", "term")
        .write.partitionBy("term_bucket")
        .parquet(f"{folder}/terms")
    )
    total = spark.read.schema(TERMS_SCHEMA).parquet(f"{folder}/terms").agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
    n = docs.count()  # documents without words count too
    spark.createDataFrame([(n, total / max(n, 1))], "n bigint, avg_length double").coalesce(1).write.parquet(f"{folder}/corpus")
    key_type = docs.schema[key].dataType.simpleString()
    publish(spark, path, folder, {"key": key, "key_type": key_type, "term_buckets": str(term_buckets)})
    return TextIndex(spark, folder, key, key_type, term_buckets)


def search_index(index: TextIndex, queries: Mapping[int, str], k: int = 10) -> DataFrame:
    """`(qid, key, score, rank)` by a written index; only the queries' buckets and terms are read."""
    spark = index.spark
    asked = query_terms(spark, queries)
    pairs = spark.createDataFrame(asked, "qid bigint, term string").withColumn("term_bucket", _term_bucket(index.term_buckets))
    buckets = [r["term_bucket"] for r in pairs.select("term_bucket").distinct().collect()]
    few = len(asked) <= MAX_BROADCAST_TERMS

    def stored(table: str, schema: str) -> DataFrame:
        rows = spark.read.schema(schema).parquet(f"{index.path}/{table}").filter(F.col("term_bucket").isin(buckets))
        return rows.filter(F.col("term").isin(sorted({row["term"] for row in asked}))) if few else rows

    def small(rows: DataFrame) -> DataFrame:
        """At most one row per query and word."""
        return F.broadcast(rows) if few else rows

    corpus = spark.read.parquet(f"{index.path}/corpus").first()
    stats = stored("terms", TERMS_SCHEMA).select("term", "df").join(small(pairs.select("qid", "term")), "term")
    hits = stored("postings", f"{index.key} {index.key_type}, {POSTINGS_SCHEMA}").join(small(stats), "term")
    weight = _idf(F.col("df"), F.lit(corpus["n"])) * _weight(
        F.col("tf"), F.col("length"), F.lit(corpus["avg_length"])
    )
    return _ranked(hits.groupBy("qid", index.key).agg(F.sum(weight).alias("score")), index.key, k)
