"""Substring dedup: word windows that start in an earlier document, found by super-k-mer partitioning.

A window is `WINDOW` words. Its minimiser is the least hash of the word triples in it, and consecutive
windows that share one travel as one packed string of words to the minimiser's bucket: about
three words are sent for each word of text, not thirteen. A task cuts its texts into blocks and sends each distinct
string of a block once to a bucket, compressed with all others for that bucket, with the documents it is in; so a
passage in a third of all documents is pre-aggregated before the shuffle.

In its bucket every window lies beside its equals: words get exact numbers, windows are sorted by a hash of them and
compared number by number, and the least document of each window is known. The bucket answers only to
the chunks of documents that hold the string after that least document, once per chunk. Chunks then cut their texts
again, look their strings up, and remove the covered words.

Memory: a bucket holds about `BUCKET_BYTES` of packed words and a chunk about `CHUNK_BYTES` of text; their
numbers follow the measured size of the input. The bytes of every minimiser are counted beforehand; the runs of one that would fill a bucket
are sent window by window, each to the bucket of its own words, so equal windows still meet and the minimiser is spread.

Edge cases: words are runs of bytes other than space and 9 to 13; null and empty texts have no words; texts shorter
than a window lose nothing; repeats within one document, and between rows that share an id, are not removed; rows with a null
id lose nothing and count as no document; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from docketry.llm.blocks import Block, Words, blocks, mix, powers, ranges, spread_marks, windows, words
from docketry.session import materialise

WINDOW = 13
MINIMISER = 3
# A run of windows that share a minimiser is cut at this many.
LONGEST_RUN = 64
SEND_BYTES = 4 << 20
BUCKET_BYTES = 8 << 20
CHUNK_BYTES = 4 << 20

SENT = "bucket long, texts binary, n_docs binary, docs binary"
ANSWERS = "chunk long, keys binary, n_windows binary, least binary"
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"

_CODEC = "zstd"


def squeeze(values: np.ndarray | bytes) -> bytes:
    """Compressed bytes, the plain length before them."""
    raw = values if isinstance(values, bytes) else np.ascontiguousarray(values).tobytes()
    return len(raw).to_bytes(8, "little") + pa.Codec(_CODEC, compression_level=3).compress(raw, asbytes=True)


def widen(blob: bytes) -> bytes:
    return pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec=_CODEC, asbytes=True)


def steps(values: np.ndarray) -> np.ndarray:
    return np.diff(values, prepend=0)


def runs(w: Words, window: int, hot: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Super-k-mers of a block: first word, number of windows, minimiser; those of `hot` minimisers as single windows with a key of their own."""
    n = len(w.hash) - window + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    least = mix(windows(w.hash, MINIMISER) ^ np.uint64(0x2545F4914F6CDD1D))
    width, span = window - MINIMISER + 1, 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: n], least[width - span: width - span + n])
    whole = w.row[:n] == w.row[window - 1:]
    new = np.ones(n, bool)
    new[1:] = (least[1:] != least[:-1]) | (w.row[1:n] != w.row[:n - 1]) | ~whole[:-1]
    begins = np.flatnonzero(new & whole)
    if not len(begins):
        return begins, begins, np.empty(0, np.uint64)
    # A run ends where the next begins or where a window would leave its text.
    edges = np.flatnonzero(new | ~whole)
    follow = np.append(edges, n)[np.searchsorted(edges, begins, "right")]
    counts = follow - begins
    split = np.isin(least[begins], hot) if hot is not None and len(hot) else np.zeros(len(begins), bool)
    longest = np.where(split, 1, LONGEST_RUN)
    pieces = -(-counts // longest)
    first = np.repeat(begins, pieces) + ranges(np.zeros(len(pieces), np.int64), pieces) * np.repeat(longest, pieces)
    ends, key = np.repeat(follow, pieces), least[first]
    if split.any():
        alone = np.flatnonzero(np.repeat(split, pieces))
        key[alone] = mix(key[alone] ^ windows(w.hash, window)[first[alone]])
    return first, np.minimum(np.repeat(longest, pieces), ends - first), key


def run_keys(w: Words, first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """128 bits for each run of words, as a structured array that sorts."""
    out = np.empty(len(first), [("a", "<u8"), ("b", "<u8")])
    sums = np.zeros(len(w.hash) + 1, np.uint64)
    for name, base in (("a", 0x9E3779B97F4A7C55), ("b", 0xC2B2AE3D27D4EB4F)):
        up, down = powers(base, len(w.hash))
        np.cumsum(w.hash * up[: len(w.hash)], out=sums[1:])
        out[name] = mix((sums[first + lengths] - sums[first]) * down[first] + lengths.astype(np.uint64))
    return out


def packed(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """All words of a block, each with one space behind it, and where each starts."""
    lengths = w.ends - w.starts
    begins = np.cumsum(lengths + 1) - lengths - 1
    out = np.full(int((lengths + 1).sum()), 32, np.uint8)
    out[ranges(begins, lengths)] = w.data[ranges(w.starts, lengths)]
    return out, np.append(begins, len(out))


def hot_minimisers(documents: DataFrame, window: int, bound: int) -> np.ndarray:
    """The minimisers whose runs come to more than about `bound` bytes as they are sent, each distinct run of a block once.

    A task reports what may matter: all that it leaves out comes to at most half of `bound` for one minimiser over all tasks.
    """
    floor = bound // (2 * max(1, documents.rdd.getNumPartitions()))

    def summed(keys: list[np.ndarray], sizes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
        return distinct, np.bincount(at, np.concatenate(sizes), len(distinct)).astype(np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sizes = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        for batch in batches:
            for block in blocks(batch.column("text"), SEND_BYTES):
                w = words(block)
                first, counts, least = runs(w, window)
                if not len(first):
                    continue
                _, own = np.unique(run_keys(w, first, counts + window - 1)["a"], return_index=True)
                begins = np.concatenate([[0], np.cumsum(w.ends - w.starts + 1)])
                sent = begins[first[own] + counts[own] + window - 1] - begins[first[own]]
                few, total = summed([least[own]], [sent])
                keys.append(few)
                sizes.append(total)
                if sum(map(len, keys[1:])) > max(1 << 20, len(keys[0])):
                    few, total = summed(keys, sizes)
                    keys, sizes = [few], [total]
        few, total = summed(keys, sizes)
        some = total > floor
        yield pa.RecordBatch.from_arrays([pa.array(few[some].view(np.int64)), pa.array(total[some])], ["minimiser", "bytes"])

    counted = documents.where("doc_id IS NOT NULL").select("text").mapInArrow(count, "minimiser long, bytes long")
    found = counted.groupBy("minimiser").agg(F.sum("bytes").alias("bytes")).where(F.col("bytes") > bound).collect()
    return np.sort(np.array([r.minimiser for r in found], np.int64).view(np.uint64))


def send(documents: DataFrame, window: int, buckets: int, hot: np.ndarray) -> DataFrame:
    """The distinct runs of every block, by bucket."""
    shared = documents.sparkSession.sparkContext.broadcast(hot)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text"), SEND_BYTES):
                w = words(block)
                first, counts, least = runs(w, window, shared.value)
                if not len(first):
                    continue
                docs = batch.column("doc_id").to_numpy()[block.first_row:block.first_row + len(block)]
                keys = run_keys(w, first, counts + window - 1)
                doc = docs[w.row[first]]
                # Distinct (run, document) pairs, runs together.
                order = np.lexsort((doc, keys["b"], keys["a"]))
                k, d = keys[order], doc[order]
                new_run = np.ones(len(k), bool)
                new_run[1:] = k[1:] != k[:-1]
                new_pair = new_run.copy()
                new_pair[1:] |= d[1:] != d[:-1]
                run_of = np.cumsum(new_run) - 1
                own = order[new_run]
                n_docs = np.bincount(run_of[new_pair])
                pair_docs, pair_at = d[new_pair], np.cumsum(n_docs) - n_docs
                bucket = (least[own] % np.uint64(buckets)).astype(np.int64)
                text, begins = packed(w)
                sorted_runs = np.lexsort((own, bucket))
                edges = np.flatnonzero(np.diff(bucket[sorted_runs], prepend=-1))
                rows = []
                for a, b in zip(edges, np.append(edges[1:], len(sorted_runs))):
                    some = sorted_runs[a:b]
                    at, to = begins[first[own[some]]], begins[first[own[some]] + counts[own[some]] + window - 1]
                    body = text[ranges(at, to - at)]
                    body[np.cumsum(to - at) - 1] = 10
                    listed = pair_docs[ranges(pair_at[some], n_docs[some])]
                    rows.append((int(bucket[some[0]]), squeeze(body), squeeze(n_docs[some].astype("<u4")), squeeze(steps(listed))))
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), *[pa.binary()] * 3))], [f.split()[0] for f in SENT.split(", ")])

    return documents.where("doc_id IS NOT NULL").select("doc_id", "text").mapInArrow(cut, SENT)


def same_windows(w: Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The windows of packed runs (first word) and the group of equal ones that each is in, exactly."""
    starts = np.flatnonzero(w.row[: len(w.row) - window + 1] == w.row[window - 1:])
    # Every word with the one separator behind it, which is made the same for all.
    data = np.where(w.data == 10, np.uint8(32), w.data)
    offsets = np.append(w.starts, len(data))
    texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(w.starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])
    number = texts.dictionary_encode().indices.to_numpy().astype(np.int64)
    hashed = windows(mix(number.astype(np.uint64) + np.uint64(1)), window)[starts]
    order = np.argsort(hashed, kind="stable")
    ranked = starts[order]
    new = np.ones(len(order), bool)
    new[1:] = hashed[order][1:] != hashed[order][:-1]
    alike = np.flatnonzero(~new)
    differs = np.zeros(len(alike), bool)
    for k in range(window):
        differs |= number[ranked[alike] + k] != number[ranked[alike - 1] + k]
    if differs.any():  # equal hashes of different windows: sort these by their words
        group = np.cumsum(new) - 1
        clash = np.isin(group, group[alike[differs]])
        at = np.flatnonzero(clash)
        columns = [number[ranked[at] + k] for k in range(window)]
        within = np.lexsort((*columns, group[at]))
        ranked[at], order[at] = ranked[at][within], order[at][within]
        for i in at[1:]:
            new[i] = new[i] or (number[ranked[i]:ranked[i] + window] != number[ranked[i - 1]:ranked[i - 1] + window]).any()
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    return starts, group


def answer(sent: DataFrame, window: int, chunks: int) -> DataFrame:
    """For each chunk the runs that hold windows of earlier documents, with the least document of each window."""

    def meet(_: tuple, table: pa.Table) -> pa.Table:
        data = np.frombuffer(b"".join(widen(t) for t in table.column("texts").to_pylist()), np.uint8)
        n_docs = np.frombuffer(b"".join(widen(t) for t in table.column("n_docs").to_pylist()), "<u4").astype(np.int64)
        docs = np.concatenate([np.cumsum(np.frombuffer(widen(t), np.int64)) for t in table.column("docs").to_pylist()])
        offsets = np.concatenate([[0], np.flatnonzero(data == 10) + 1])
        w = words(Block(data, offsets, 0))
        pair_run = np.repeat(np.arange(len(n_docs)), n_docs)
        run_least = np.minimum.reduceat(docs, np.cumsum(n_docs) - n_docs)
        starts, group = same_windows(w, window)
        run = w.row[starts]
        least = np.full(int(group.max(initial=-1)) + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, group, run_least[run])
        counts = w.counts - window + 1
        at = np.cumsum(counts) - counts
        earliest = np.minimum.reduceat(least[group], at)
        later = docs > earliest[pair_run]
        wanted = np.unique(np.stack([docs[later] % chunks, pair_run[later]]), axis=1)
        keys = run_keys(w, w.first, w.counts)
        rows = []
        edges = np.flatnonzero(np.diff(wanted[0], prepend=-1))
        for a, b in zip(edges, np.append(edges[1:], wanted.shape[1])):
            some = wanted[1, a:b]
            found = least[group[ranges(at[some], counts[some])]]
            rows.append((int(wanted[0, a]), keys[some].tobytes(), squeeze(counts[some].astype("<u1")), squeeze(steps(found))))
        columns = list(zip(*rows)) or [()] * 4
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), *[pa.binary()] * 3))], names=[f.split()[0] for f in ANSWERS.split(", ")])

    return sent.groupBy("bucket").applyInArrow(meet, ANSWERS)


def covered(w: Words, docs: np.ndarray, known: np.ndarray, answers: pa.Table, window: int, hot: np.ndarray) -> np.ndarray:
    """Which words of a block lie in a window of an earlier document."""
    first, counts, _ = runs(w, window, hot)
    marks = np.zeros(len(w.hash), bool)
    if not len(first) or not len(answers):
        return marks
    keys = run_keys(w, first, counts + window - 1)
    held = np.concatenate([np.frombuffer(k, keys.dtype) for k in answers.column("keys").to_pylist()])
    n = np.concatenate([np.frombuffer(widen(c), "<u1") for c in answers.column("n_windows").to_pylist()]).astype(np.int64)
    least = np.concatenate([np.cumsum(np.frombuffer(widen(v), np.int64)) for v in answers.column("least").to_pylist()])
    order = np.lexsort((held["b"], held["a"]))
    # Keys are found by their first half, whose few ties are walked through.
    at = np.searchsorted(held["a"][order], keys["a"], "left")
    found = np.full(len(keys), -1)
    open_at = np.arange(len(keys))
    while len(open_at):
        open_at = open_at[at[open_at] < len(order)]
        here = order[at[open_at]]
        same = held["a"][here] == keys["a"][open_at]
        open_at, here = open_at[same], here[same]
        hit = held["b"][here] == keys["b"][open_at]
        found[open_at[hit]] = here[hit]
        open_at = open_at[~hit]
        at[open_at] += 1
    own = np.flatnonzero((found >= 0) & known[w.row[first]])
    begins = np.cumsum(n) - n
    word = ranges(first[own], counts[own])
    earlier = least[ranges(begins[found[own]], counts[own])] < docs[w.row[word]]
    return spread_marks(len(w.hash), word[earlier], window)


def apply(documents: DataFrame, answers: DataFrame, window: int, with_text: bool, hot: np.ndarray) -> DataFrame:
    """Counts, digest and, if asked for, the text of what is left of every document."""
    shared = documents.sparkSession.sparkContext.broadcast(hot)
    schema = RESULT + (", kept_text string" if with_text else "")

    def finish(texts: pa.Table, found: pa.Table) -> pa.Table:
        out: list[tuple] = []
        ids = texts.column("doc_id")
        known = ids.is_valid().to_numpy()
        docs = ids.fill_null(0).to_numpy()
        for block in blocks(texts.column("text"), SEND_BYTES):
            w = words(block)
            own = slice(block.first_row, block.first_row + len(block))
            gone = covered(w, docs[own], known[own], found, window, shared.value)
            text, begins = packed(w)
            lengths = np.diff(begins)
            left = np.flatnonzero(~gone)
            body = text[ranges(begins[:-1][left], lengths[left])]
            ends = np.cumsum(np.bincount(w.row[left], lengths[left], minlength=len(block)).astype(np.int64))
            removed = np.bincount(w.row[gone], minlength=len(block))
            for i, (a, b) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist())):
                kept = body[a:max(a, b - 1)].tobytes()
                row = (int(docs[own][i]) if known[own][i] else None, int(w.counts[i]), int(removed[i]), hashlib.sha256(kept).hexdigest())
                out.append(row + ((kept.decode("utf-8", "replace"),) if with_text else ()))
        columns = list(zip(*out)) or [()] * (4 + with_text)
        kinds = [pa.int64()] * 3 + [pa.string()] * (1 + with_text)
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=[f.split()[0] for f in schema.split(", ")])

    return documents.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(finish, schema)


def chunk_of(doc_id: Column, text: Column, chunks: int) -> Column:
    return F.coalesce(F.pmod(doc_id, F.lit(chunks)), F.pmod(F.xxhash64(text), F.lit(chunks)))


def remove_repeats(
    documents: DataFrame, window: int = WINDOW, with_text: bool = False, bucket_bytes: int = BUCKET_BYTES, chunk_bytes: int = CHUNK_BYTES
) -> DataFrame:
    """Every document without the words of windows that an earlier document holds."""
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = int(texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0])
    buckets = max(1, 3 * total // bucket_bytes)
    chunks = max(1, total // chunk_bytes) | 1  # odd, so that ids with a stride are dealt evenly
    hot = hot_minimisers(texts, window, bucket_bytes)
    answers = materialise(answer(send(texts, window, buckets, hot), window, chunks), "repeats")
    dealt = texts.withColumn("chunk", chunk_of(F.col("doc_id"), F.col("text"), chunks))
    return apply(dealt, answers, window, with_text, hot)


def q_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
