"""Benchmark decontamination: a broadcast set of benchmark word windows, scanned over training texts.

A window is `WINDOW` consecutive words of a benchmark item; an item of fewer words, but
not none, is one window. Words are runs of ASCII letters, digits and all characters from
U+0080, with A-Z lower-cased. A document word inside any occurrence of a window is hit; a
document is contaminated if at least one in twenty of its words is hit.

The benchmark is cut by item into blocks whose size is measured beforehand and is at most
`BLOCK_LIMIT` bytes; each block is broadcast and the documents are scanned against it, so a
benchmark of any size is whole. A document is never moved: marks of several blocks are
merged by document. Hashes propose, the words themselves decide.

Edge cases: null and empty texts have no words and are clean; repeated document ids are judged
row by row; items of null or empty text give no window; repeated items each count under
their own id; items without an id hit like any other and count as one item, which the digest of
the item list leaves out; an empty benchmark leaves all documents clean; columns beside id and text are
neither read nor lost (`remove_contaminated` keeps them all).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from docketry.llm.blocks import ALPHANUMERIC, Block, Words, blocks, map_rows, spread_marks, windows, words

WINDOW = 13
SHARE = 20
# Bytes of benchmark text in one broadcast block.
BLOCK_LIMIT = 32 << 20

RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def window_set(items: list[tuple[str | None, str]], window: int) -> dict[int, tuple]:
    """The windows of a benchmark by length: sorted hashes, a bitmap of them, the words, the items that hold them."""
    found: dict[int, dict[bytes, set[str | None]]] = {}
    for item, text in items:
        for block in blocks(pa.array([text])):
            w = words(block, ALPHANUMERIC, lower=True)
            n = len(w.hash)
            length = min(n, window)
            for at in range(n - length + 1 if n else 0):
                found.setdefault(length, {}).setdefault(w.text(at, at + length), set()).add(item)
    by_length = {}
    for length, held in found.items():
        texts = list(held)
        joined = b" ".join(texts)
        flat = words(Block(np.frombuffer(joined, np.uint8), np.array([0, len(joined)]), 0), ALPHANUMERIC)
        hashed = windows(flat.hash, length)[::length]
        order = np.argsort(hashed, kind="stable")
        # Most document windows are ruled out by one look at the bitmap of first bits.
        bits = np.zeros(1 << 20, bool)
        bits[hashed >> np.uint64(44)] = True
        by_length[length] = (hashed[order], bits, [texts[i] for i in order], [list(held[texts[i]]) for i in order])
    return by_length


def matches(found: dict[int, tuple], w: Words) -> Iterator[tuple[int, int, list[str | None]]]:
    """`(first word, length, items)` of every occurrence in a block of documents."""
    for length, (hashed, bits, texts, items) in found.items():
        own = windows(w.hash, length)
        if not len(own):
            continue
        likely = np.flatnonzero(bits[own >> np.uint64(44)])
        likely = likely[w.row[likely] == w.row[likely + length - 1]]
        low = np.searchsorted(hashed, own[likely], "left")
        high = np.searchsorted(hashed, own[likely], "right")
        some = high > low
        for at, a, b in zip(likely[some].tolist(), low[some].tolist(), high[some].tolist()):
            said = w.text(at, at + length)
            for i in range(a, b):
                if texts[i] == said:
                    yield at, length, items[i]


def scan(column: pa.Array, found: dict[int, tuple]) -> Iterator[tuple[Words, np.ndarray, list[set[str | None]]]]:
    """Block by block: the words, which of them are hit, and the items of each row."""
    for block in blocks(column):
        w = words(block, ALPHANUMERIC, lower=True)
        starts, lengths, items = [], [], [set() for _ in range(len(block))]
        for at, length, held in matches(found, w):
            starts.append(at)
            lengths.append(length)
            items[w.row[at]].update(held)
        marks = spread_marks(len(w.hash), np.array(starts, np.int64), np.array(lengths, np.int64)) if starts else np.zeros(len(w.hash), bool)
        yield w, marks, items


def per_row(w: Words, marks: np.ndarray) -> np.ndarray:
    return np.bincount(w.row[marks], minlength=len(w.counts)) if len(w.counts) else np.zeros(0, np.int64)


def item_blocks(benchmark: DataFrame, item_id: str, text: str, limit: int) -> Iterator[list[tuple[str | None, str]]]:
    """The benchmark's items in blocks of at most about `limit` bytes, whose number follows its measured size."""
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(text).alias("text")).where("text IS NOT NULL")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    count = max(1, -(-int(total) * 2 // limit)) if total > limit else 1
    for k in range(count):
        part = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(count)) == k) if count > 1 else items
        yield [(r.item, r.text) for r in part.collect()]


def decontaminate(
    documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = SHARE, block_limit: int = BLOCK_LIMIT
) -> DataFrame:
    """One row per document: words, hit words, items found and whether it is contaminated."""
    spark = documents.sparkSession
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sets = [spark.sparkContext.broadcast(window_set(items, window)) for items in item_blocks(benchmark, "item_id", "text", block_limit)]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            rounds = zip(*(scan(batch.column("text"), s.value) for s in sets))
            for parts in rounds:
                w = parts[0][0]
                marks = np.logical_or.reduce([m for _, m, _ in parts])
                held = [set().union(*sets_of) for sets_of in zip(*(i for _, _, i in parts))]
                hit = per_row(w, marks)
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(at, len(w.counts)),
                    pa.array(w.counts.astype(np.int64)),
                    pa.array(hit.astype(np.int64)),
                    pa.array([len(h) for h in held], pa.int64()),
                    pa.array([hashlib.sha256(",".join(sorted(h - {None})).encode()).hexdigest() for h in held], pa.string()),
                    pa.array((hit > 0) & (share * hit >= w.counts)),
                ], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])
                at += len(w.counts)

    return texts.mapInArrow(judge, RESULT)


def remove_contaminated(
    documents: DataFrame, benchmark: DataFrame, spans: bool = False, window: int = WINDOW, share: int = SHARE,
    block_limit: int = BLOCK_LIMIT, text: str = "text",
) -> DataFrame:
    """The documents that are not contaminated, all columns kept.

    With `spans=True` no document goes; instead the hit words of contaminated ones are cut
    out of the text, with what lies between two hit words.
    """
    spark = documents.sparkSession
    sets = [spark.sparkContext.broadcast(window_set(items, window)) for items in item_blocks(benchmark, "item_id", "text", block_limit)]

    at = documents.columns.index(text)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean, texts, row = [], [], 0
            for parts in zip(*(scan(batch.column(at), s.value) for s in sets)):
                w = parts[0][0]
                marks = np.logical_or.reduce([m for _, m, _ in parts])
                hit = per_row(w, marks)
                bad = (hit > 0) & (share * hit >= w.counts)
                clean.append(~bad)
                if spans:
                    texts += [cut_words(w, marks, i) if b else batch.column(at)[row + i].as_py() for i, b in enumerate(bad)]
                row += len(w.counts)
            if spans:
                yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
            elif clean:
                yield batch.filter(pa.array(np.concatenate(clean)))

    return map_rows(documents, keep)


def cut_words(w: Words, marks: np.ndarray, row: int) -> str:
    """A row's text without its hit words."""
    raw = w.block.data[w.block.offsets[row]:w.block.offsets[row + 1]]
    a = w.first[row]
    b = a + w.counts[row]
    gone = np.zeros(len(raw) + 1, np.int64)
    hit = np.flatnonzero(marks[a:b]) + a
    base = w.block.offsets[row]
    # From a hit word to the next word's start if that is hit too, else to its own end.
    follows = np.isin(hit + 1, hit)
    stop = np.where(follows, w.starts[np.minimum(hit + 1, len(w.starts) - 1)], w.ends[hit])
    np.add.at(gone, w.starts[hit] - base, 1)
    np.add.at(gone, stop - base, -1)
    return raw[np.cumsum(gone[:-1]) == 0].tobytes().decode("utf-8", "replace")


def q_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
