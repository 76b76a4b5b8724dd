"""Packing by shortest-pack-first over the length histogram.

A document's ids (its text's, then the end id) are cut into full pieces of the
sequence length and one rest. The histogram of piece lengths, at most one count per
length whatever the number of documents, is packed on the driver: lengths come longest
first, and each goes to the emptiest packs that hold it, as counts of whole patterns. Pieces
then meet their pattern by rank: a piece is the r-th of its length, and its pattern, place
and sequence follow from r alone.

Ranks come from two levels, within a written part and over the parts of a length, so
no task sees all pieces of a common length. Ids never leave the task that makes them.

Edge cases: null or empty text is the end id alone; an empty table gives no pieces; repeated
documents and ids are packed each on their own; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from docketry.llm.blocks import ranges
from docketry.llm.tokens import ended, encoder
from docketry.session import materialise

SEQUENCE = 1024
END_ID = 0

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, local_rank long"
PLACED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def cut_documents(documents: DataFrame, vocabulary: str, end_id: int = END_ID, size: int = SEQUENCE) -> DataFrame:
    """The pieces of every document, each with its rank among those of its length in its part."""
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(vocabulary, lower=False)
        part, seen = TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        for batch in batches:
            for first, flat, counts in known.column_ids(batch.column(1)):
                ids, borders = ended(flat, counts, end_id)
                ids = ids.astype("<u4")
                pieces = -(-(counts + 1) // size)
                row = np.repeat(np.arange(len(counts)), pieces)
                start = ranges(np.zeros(len(counts), np.int64), pieces) * size
                length = np.minimum(size, (counts + 1)[row] - start)
                at = borders[row] + start
                sums = [zlib.crc32(ids[a:b]) for a, b in zip(at.tolist(), (at + length).tolist())]
                # The rank of a piece among those of its length that this task has cut.
                order = np.argsort(length, kind="stable")
                ordered = length[order]
                rank = np.empty(len(row), np.int64)
                rank[order] = np.arange(len(row)) - np.searchsorted(ordered, ordered, "left") + seen[ordered]
                seen += np.bincount(length, minlength=size + 1)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(first + row)), pa.array(start), pa.array(length), pa.array(sums, pa.int64()),
                    pa.array((counts + 1)[row]), pa.array(np.full(len(row), part, np.int32)), pa.array(rank),
                ], [f.split()[0] for f in PIECES.split(", ")])

    return texts.mapInArrow(cut, PIECES)


def pack_histogram(counts: dict[int, int], size: int = SEQUENCE) -> list[tuple[list[int], int]]:
    """Patterns (piece lengths in order of placing) and how many sequences follow each.

    Longest lengths first; among the open packs that have room the emptiest takes the
    piece, all packs of a pattern at once.
    """
    open_packs: dict[int, list[tuple[list[int], int]]] = defaultdict(list)  # by room left
    for length in sorted(counts, reverse=True):
        left, opened = counts[length], []
        room = size
        while left:
            while room >= length and not open_packs[room]:
                room -= 1
            if room < length:
                opened.append((size - length, ([length], left)))
                break
            pattern, number = open_packs[room].pop()
            taken = min(left, number)
            if number > taken:
                open_packs[room].append((pattern, number - taken))
            # Short pieces may go to the same pack again, so a grown pack is open at once.
            grown = room - length
            open_packs[grown].append((pattern + [length], taken))
            left -= taken
            room = max(room, grown)
        for room_left, pack in opened:
            # A new pack takes further pieces of its length as far as they fit.
            fit = room_left // length + 1
            pattern, number = pack
            whole, rest = divmod(number, fit)
            if whole:
                open_packs[size - fit * length].append(([length] * fit, whole))
            if rest:
                open_packs[size - rest * length].append(([length] * rest, 1))
    return [pack for packs in open_packs.values() for pack in packs]


def place_table(patterns: list[tuple[list[int], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length the runs of ranks: first rank, sequence of that rank, offset in the sequence."""
    runs = defaultdict(list)
    given: dict[int, int] = defaultdict(int)
    base = 0
    for pattern, number in patterns:
        offset = 0
        for length in pattern:
            runs[length].append((given[length], base, offset))
            given[length] += number
            offset += length
        base += number
    return {length: tuple(np.array(column, np.int64) for column in zip(*rows)) for length, rows in runs.items()}


def pack(documents: DataFrame, vocabulary: str, end_id: int = END_ID, size: int = SEQUENCE) -> DataFrame:
    """Every piece of every document with its sequence and its offset there."""
    spark = documents.sparkSession
    pieces = materialise(cut_documents(documents, vocabulary, end_id, size), "pieces")
    per_part = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    # At most one row per length comes to the driver.
    counts = {r.length: r.n for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = spark.sparkContext.broadcast(place_table(pack_histogram(counts, size)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank, lengths = batch.column("rank").to_numpy(), batch.column("length").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for length in np.unique(lengths):
                own = np.flatnonzero(lengths == length)
                first, base, at = places.value[int(length)]
                run = np.searchsorted(first, rank[own], side="right") - 1
                sequence[own] = base[run] + rank[own] - first[run]
                offset[own] = at[run]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")] + [pa.array(sequence), pa.array(offset)],
                [f.split()[0] for f in PLACED.split(", ")],
            )

    ranked = pieces.join(offsets, ["part", "length"]).withColumn("rank", F.col("before") + F.col("local_rank"))
    return ranked.mapInArrow(place, PLACED)


def q_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
