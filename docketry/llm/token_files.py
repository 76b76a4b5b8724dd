"""Token ids as ORC files: run-length encoded integers, row indexes, and Bloom filters on document ids.

Documents are dealt by ranges of their id, sorted and encoded, and each range becomes one
file. A row holds the document's ids as an integer array, which ORC
run-length encodes, and its first id's position within the file. Positions over all
files follow from one total per file. Readers open stripes in parallel and skip stripes and
row groups by their minima, maxima and Bloom filters of `doc_id`.

Edge cases: null or empty text is the end id alone; rows with equal ids are kept, in the order of
their texts; a null id sorts first; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from docketry.llm.tokens import ended, encoder
from docketry.session import new_folder

END_ID = 2
STORED = "doc_id long, part int, part_start long, n_tokens long, tokens array<int>"

ORC_OPTIONS = {
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.create.index": "true",
    "orc.row.index.stride": "2000",
    "orc.stripe.size": str(32 << 20),
    "compression": "zstd",
}


def write_token_files(documents: DataFrame, path: str, vocabulary: str, end_id: int = END_ID) -> None:
    """Write all documents' ids below `path` in ascending order of `doc_id`."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(vocabulary, lower=True)
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            for first, flat, counts in known.column_ids(batch.column(1)):
                ids, borders = ended(flat, counts, end_id)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(first, len(counts)),
                    pa.array(np.full(len(counts), part, np.int32)),
                    pa.array(at + borders[:-1]),
                    pa.array(counts + 1),
                    pa.ListArray.from_arrays(pa.array(borders.astype(np.int32)), pa.array(ids.astype(np.int32))),
                ], [f.split()[0] for f in STORED.split(", ")])
                at += int(borders[-1])

    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # Texts are dealt before they are encoded: drawing the ranges' borders then costs a scan and no encoding.
    ordered = texts.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(encode, STORED).write.options(**ORC_OPTIONS).orc(path)


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """`doc_id`, `start`, `n_tokens` and `tokens`; with `doc_ids` only stripes that may hold them are read."""
    stored = spark.read.schema(STORED).orc(path)
    # One row per file: few, and read from the narrow columns only.
    totals = stored.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    wanted = stored.where(F.col("doc_id").isin(doc_ids)) if doc_ids is not None else stored
    return wanted.join(F.broadcast(bases), "part").select("doc_id", (F.col("base") + F.col("part_start")).alias("start"), "n_tokens", "tokens")


def token_digests(tokens: DataFrame) -> DataFrame:
    """`ids_crc32` in place of the ids."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("tokens")
            flat = lists.flatten().to_numpy().astype("<u4")
            ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            sums = [zlib.crc32(flat[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("doc_id", "start", "n_tokens")] + [pa.array(sums, pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    return tokens.mapInArrow(digest, "doc_id long, start long, n_tokens long, ids_crc32 long")


def q_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = new_folder(spark, "token_files")
    write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("word_bpe_49k.json"))
    return token_digests(read_tokens(spark, path))
