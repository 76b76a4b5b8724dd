"""A full-text index of packed posting blocks, and BM25 search that skips blocks which cannot matter.

Documents are numbered in the order of their keys. A term's postings are cut into blocks of at most `BLOCK`, each one row: the first and last
number, how many postings, the greatest weight that any of them can add to a score, and the gaps between numbers, counts and
lengths packed into as few bytes as the block needs. Blocks lie in folders by a hash of the term, sorted by term and number.

A search reads the terms that can add most first, and the k-th score of what they give is a floor. Terms that together cannot lift a
document to the floor are not read but looked up: of their blocks only those are unpacked in whose range a document lies that may still pass.
The result is that of a full scan.

A term may occur in every document: its blocks are rows like any others, dealt out by ranges of term and number.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from docketry.functions.pieces import cuts
from docketry.functions.process import release
from docketry.operators.fulltext import B, K1, TERM_BUCKETS, _counted, _idf, _ranked, _term_bucket, _weight, _words, query_terms
from docketry.session import materialise
from docketry.sinks.versions import new_version, publish, published

BLOCK = 128
# Numbers of a window, in which documents meet the blocks that may hold them.
WINDOW = 4096
# Postings per wanted row that are read before a floor is set.
EAGER = 10
# What rounding may take off a score.
SLACK = 1e-6

BLOCKS = "term string, first long, last long, n int, best float, packed binary"
TERMS = "term string, df long, best float"
WIDTHS = ("<u1", "<u2", "<u4", "<u8")


def width_codes(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each block the least of `WIDTHS` that holds its values."""
    most = np.maximum.reduceat(values, starts)
    return ((most >= 1 << 8).astype(np.int64) + (most >= 1 << 16) + (most >= 1 << 32)).astype(np.uint8)


def places(codes: np.ndarray, n: np.ndarray, heads: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Where the bytes of each gap, count and length lie, and of which block each is.

    `codes` has three widths a block, `n` its postings and `heads` where it starts; a block has one gap less than postings.
    """
    at, found, blocks = heads + 3, [], []
    for part, size in enumerate((n - 1, n, n)):
        block = np.repeat(np.arange(len(n)), size)
        width = 1 << codes[part].astype(np.int64)
        found.append(at[block] + (np.arange(len(block)) - (np.cumsum(size) - size)[block]) * width[block])
        blocks.append(block)
        at = at + size * width
    return found, blocks


def pack_blocks(numbers: np.ndarray, counts: np.ndarray, lengths: np.ndarray, starts: np.ndarray) -> pa.Array:
    """The packed bytes of blocks that begin at `starts`, the first at 0; all blocks at once."""
    n = np.diff(np.r_[starts, len(numbers)])
    gaps = np.diff(numbers, prepend=numbers[:1])
    gaps[starts] = 0
    codes = np.stack([width_codes(values, starts) for values in (gaps, counts, lengths)])
    widths = 1 << codes.astype(np.int64)
    ends = np.cumsum(3 + (n - 1) * widths[0] + n * widths[1] + n * widths[2])
    heads = np.r_[0, ends[:-1]]
    out = np.empty(ends[-1], np.uint8)
    rest = np.ones(len(gaps), bool)
    rest[starts] = False
    at, blocks = places(codes, n, heads)
    for part, values in enumerate((gaps[rest], counts, lengths)):
        out[heads + part] = codes[part]
        own = codes[part][blocks[part]]
        for code in np.unique(own):
            held = own == code
            body = values[held].astype(WIDTHS[code]).view(np.uint8).reshape(-1, 1 << code)
            out[at[part][held][:, None] + np.arange(1 << code)] = body
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(np.r_[0, ends].astype(np.int64)), pa.py_buffer(out)]).cast(pa.binary())


def unpack_blocks(packed: pa.Array, first: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """Numbers, counts and lengths of all blocks, one block after another."""
    packed = packed.cast(pa.large_binary())
    _, offsets, data = packed.buffers()
    heads = np.frombuffer(offsets, np.int64, len(packed), packed.offset * 8)
    raw, n = np.frombuffer(data, np.uint8), n.astype(np.int64)
    codes = np.stack([raw[heads + part] for part in range(3)])
    at, blocks = places(codes, n, heads)
    parts = []
    for part in range(3):
        own, values = codes[part][blocks[part]], np.empty(len(blocks[part]), np.int64)
        for code in np.unique(own):
            held = own == code
            values[held] = raw[at[part][held][:, None] + np.arange(1 << code)].view(WIDTHS[code]).ravel()
        parts.append(values)
    starts, gaps = np.cumsum(n) - n, np.zeros(len(parts[1]), np.int64)
    rest = np.ones(len(gaps), bool)
    rest[starts] = False
    gaps[rest] = parts[0]
    total = np.cumsum(gaps)
    return [np.repeat(first - total[starts], n) + total, *parts[1:]]


def pack(numbers: np.ndarray, counts: np.ndarray, lengths: np.ndarray) -> bytes:
    return pack_blocks(numbers, counts, lengths, np.zeros(1, np.int64))[0].as_py()


def unpack(raw: bytes, first: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return tuple(unpack_blocks(pa.array([raw]), np.array([first]), np.array([n])))


@dataclass
class BlockIndex:
    """A published build; `path` is its version folder."""

    spark: SparkSession
    path: str
    key: str
    key_type: str
    term_buckets: int
    n: int
    avg_length: float

    def _of_terms(self, table: str, schema: str, terms: list[str] | None) -> DataFrame:
        rows = self.spark.read.schema(f"{schema}, term_bucket int").parquet(f"{self.path}/{table}")
        if terms is None:
            return rows
        asked = self.spark.createDataFrame([(t,) for t in terms], "term string").select(_term_bucket(self.term_buckets).alias("b")).distinct()
        return rows.where(F.col("term_bucket").isin([r.b for r in asked.collect()]) & F.col("term").isin(terms))

    def blocks(self, terms: list[str] | None = None) -> DataFrame:
        """The blocks of some terms, or all; other terms' folders are not opened."""
        return self._of_terms("blocks", BLOCKS, terms)

    def terms(self, terms: list[str] | None = None) -> DataFrame:
        return self._of_terms("terms", TERMS, terms)

    def documents(self) -> DataFrame:
        return self.spark.read.schema(f"number long, {self.key} {self.key_type}, length long").parquet(f"{self.path}/documents")

    def postings(self) -> DataFrame:
        """`(key, term, tf)` of every posting."""
        return unpacked(self.blocks()).join(self.documents().select("number", self.key), "number").select(self.key, "term", "tf")


def unpacked(blocks: DataFrame, read: Accumulator | None = None) -> DataFrame:
    """`(term, number, tf, length)` of all postings of some blocks; `read` adds up how many these are."""

    def postings_of(blocks: pa.RecordBatch) -> pa.RecordBatch:
        n = blocks.column("n").to_numpy()
        parts = unpack_blocks(blocks.column("packed"), blocks.column("first").to_numpy(), n)
        if read is not None:
            read.add(len(parts[0]))
        term = blocks.column(0).take(pa.array(np.repeat(np.arange(len(n)), n)))
        return pa.RecordBatch.from_arrays([term, *map(pa.array, parts)], names=["term", "number", "tf", "length"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to in cuts(batch.column("n").to_numpy()):
                yield postings_of(batch.slice(at, to - at))
            release()

    return blocks.select("term", "packed", "first", "n").mapInArrow(work, "term string, number long, tf long, length long")


def in_blocks(rows: DataFrame, avg_length: float, term_buckets: int, block: int = BLOCK) -> DataFrame:
    """Blocks of postings (`term`, `number`, `tf`, `length`, `term_bucket`)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            terms = batch.column(0).dictionary_encode()
            codes = terms.indices.to_numpy()
            number, tf, length = (batch.column(i).to_numpy() for i in (1, 2, 3))
            weight = tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / avg_length))
            runs = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
            starts = np.concatenate([np.arange(a, b, block) for a, b in zip(runs, np.r_[runs[1:], len(codes)])])
            ends = np.r_[starts[1:], len(codes)]
            # Rounded up, so that the bound holds.
            best = np.nextafter(np.maximum.reduceat(weight, starts).astype(np.float32), np.float32(np.inf))
            bodies = pack_blocks(number, tf, length, starts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(starts)), pa.array(number[starts]), pa.array(number[ends - 1]), pa.array((ends - starts).astype(np.int32)), pa.array(best), bodies, batch.column(4).take(pa.array(starts))],
                names=["term", "first", "last", "n", "best", "packed", "term_bucket"])

    order = ("term_bucket", "term", "number")
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("term", "number", "tf", "length", "term_bucket")
    return placed.mapInArrow(work, f"{BLOCKS}, term_bucket int")


def open_index(spark: SparkSession, path: str) -> BlockIndex:
    facts = published(spark, path)
    if facts is None:
        raise ValueError(f"no index below {path}")
    return BlockIndex(spark, facts["folder"], facts["key"], facts["key_type"], int(facts["term_buckets"]), int(facts["n"]), float(facts["avg_length"]))


def build_index(docs: DataFrame, key: str, text: str, path: str, term_buckets: int = TERM_BUCKETS, block: int = BLOCK) -> BlockIndex:
    """Number the documents, pack their postings and write a new version below `path`, then publish it."""
    spark, folder = docs.sparkSession, new_version(path)
    ordered = docs.select(F.col(key), F.col(text)).repartitionByRange(key).sortWithinPartitions(key)
    ordered = ordered.withColumn("at", F.monotonically_increasing_id())
    # The number of a partition and of a row within it, as the function packs them.
    counted = _words(ordered.withColumn("id", F.struct(key, "at")), "id", text).select("id", F.size("words").cast("long").alias("length"), _counted("words").alias("counts"))
    counted = materialise(counted.select(F.col(f"id.{key}").alias(key), F.shiftright("id.at", 33).alias("part"), F.col("id.at").bitwiseAND((1 << 33) - 1).alias("row"), "length", "counts"), "counted")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each range of the sort.
    bases = counted.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    numbered = counted.join(bases, "part").withColumn("number", F.col("base") + F.col("row"))
    numbered.select("number", key, "length").sortWithinPartitions("number").write.parquet(f"{folder}/documents")
    totals = spark.read.parquet(f"{folder}/documents").agg(F.count("*").alias("n"), F.sum("length").alias("length")).first()
    avg_length = (totals.length or 0) / max(totals.n, 1)
    rows = numbered.select("number", "length", F.inline("counts")).withColumn("term_bucket", _term_bucket(term_buckets))
    in_blocks(rows, avg_length, term_buckets, block).write.partitionBy("term_bucket").parquet(f"{folder}/blocks")
    key_type = docs.schema[key].dataType.simpleString()
    index = BlockIndex(spark, folder, key, key_type, term_buckets, totals.n, avg_length)
    terms = index.blocks().groupBy("term_bucket", "term").agg(F.sum("n").alias("df"), F.max("best").alias("best"))
    terms.repartitionByRange("term_bucket", "term").sortWithinPartitions("term").write.partitionBy("term_bucket").parquet(f"{folder}/terms")
    publish(spark, path, folder, {"key": key, "key_type": key_type, "term_buckets": str(term_buckets), "n": str(totals.n), "avg_length": repr(avg_length)})
    return index


def eager_terms(told: list[tuple[str, int, float]], k: int) -> int:
    """How many of a query's terms, by what they can add, are read before there is a floor; `told` has `(term, df, most)`."""
    held = 0
    for i, (_, df, _) in enumerate(told):
        held += df
        if held >= EAGER * k:
            return i + 1
    return len(told)


def needed_terms(told: list[tuple[str, int, float]], floor: float) -> int:
    """How many terms have to be read: the others together stay below the floor."""
    rest = 0.0
    for i in range(len(told) - 1, -1, -1):
        rest += told[i][2]
        if rest >= floor - SLACK:
            return i + 1
    return 0


def search_index(index: BlockIndex, queries: Mapping[int, str], k: int = 10, read: Accumulator | None = None) -> DataFrame:
    """`(qid, key, score, rank)`, as from a scan of all texts; `read` adds up how many postings are unpacked."""
    spark = index.spark
    asked = query_terms(spark, queries)
    idf = _idf(F.col("df"), F.lit(index.n))
    # One row for each distinct word of the queries comes to the driver.
    stats = {r.term: (r.df, r.idf, r.best * r.idf) for r in index.terms(sorted({r.term for r in asked})).select("term", "df", "best", idf.alias("idf")).collect()}
    told: dict[int, list[tuple[str, int, float]]] = {}
    for r in asked:
        if r.term in stats:
            told.setdefault(r.qid, []).append((r.term, stats[r.term][0], stats[r.term][2]))
    for terms in told.values():
        terms.sort(key=lambda t: (-t[2], t[0]))

    def weights(postings: DataFrame, picked: list[tuple[int, str]]) -> DataFrame:
        """What each posting adds to a query, for some `(qid, term)`."""
        pairs = spark.createDataFrame([(q, t, stats[t][1]) for q, t in picked], "qid long, term string, idf double")
        added = F.col("idf") * _weight(F.col("tf"), F.col("length"), F.lit(index.avg_length))
        return postings.join(pairs, "term").select("qid", "number", added.alias("score"))

    summed = lambda rows: rows.groupBy("qid", "number").agg(F.sum("score").alias("score"))
    eager = {q: eager_terms(terms, k) for q, terms in told.items()}
    first = [(q, t) for q, terms in told.items() for t, _, _ in terms[:eager[q]]]
    postings = materialise(unpacked(index.blocks(sorted({t for _, t in first})), read), "postings")
    tops = _ranked(summed(weights(postings, first)), "number", k).groupBy("qid").agg(F.count("*").alias("n"), F.min("score").alias("floor"))
    floors = {r.qid: r.floor for r in tops.collect() if r.n == k}
    needed = {q: max(eager[q], needed_terms(terms, floors.get(q, 0.0)) if q in floors else len(terms)) for q, terms in told.items()}
    more = [(q, t) for q, terms in told.items() for t, _, _ in terms[eager[q]:needed[q]]]
    if late := sorted({t for _, t in more} - {t for _, t in first}):
        postings = materialise(postings.unionByName(unpacked(index.blocks(late), read)), "postings")
    partial = summed(weights(postings, first + more))

    # What the terms that are only looked up can still add.
    rest = {q: sum(most for _, _, most in terms[needed[q]:]) for q, terms in told.items()}
    looked_up = [(q, t) for q, terms in told.items() for t, _, _ in terms[needed[q]:]]
    if looked_up:
        limits = spark.createDataFrame([(q, floors[q] - r - SLACK if r else -1.0) for q, r in rest.items()], "qid long, limit double")
        partial = materialise(partial.join(limits, "qid").where("score >= limit").drop("limit"), "candidates")
        pairs = spark.createDataFrame(looked_up, "qid long, term string")
        windows = partial.join(pairs, "qid").select("term", "number", F.floor(F.col("number") / WINDOW).alias("window")).distinct()
        heads = index.blocks(sorted({t for _, t in looked_up}))
        spans = heads.select("term", "first", "last", F.explode(F.sequence(F.floor(F.col("first") / WINDOW), F.floor(F.col("last") / WINDOW))).alias("window"))
        hit = spans.join(windows, ["term", "window"]).where(F.col("number").between(F.col("first"), F.col("last"))).select("term", "first").distinct()
        found = weights(unpacked(heads.join(hit, ["term", "first"], "left_semi"), read), looked_up)
        partial = summed(partial.unionByName(found.join(partial.select("qid", "number"), ["qid", "number"], "left_semi")))
    best = _ranked(partial, "number", k)
    return best.join(index.documents().select("number", index.key), "number").select("qid", index.key, "score", "rank")
