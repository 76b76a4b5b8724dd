"""Toxicity by FTRL-proximal logistic regression on hashed word n-grams and skip-grams.

Features of a text are the distinct 64-bit hashes of its words, its word pairs and its pairs
with one word between (words are runs of ASCII letters, digits and characters from U+0080,
A-Z lower-cased). Each coordinate has its own learning rate, and L1 keeps most weights
at zero, so a model is a short list of hashes and weights that is broadcast.

Learning: at most about `MAX_ROWS` labelled rows (a documented bound; chosen by a hash of the
id, so the choice is the same in every run) are dealt to `SHARDS` tasks. Each runs FTRL over its rows
with a strong L1; features that most shards keep are the model's. A text that occurs twice is learned once. A second FTRL over these features
alone, with little L1, gives the weights. The number of
weights is bounded by `MAX_WEIGHTS`, the largest in absolute value. Scoring reads every word
of every text where it lies; nothing is shuffled.

Edge cases: a null or empty text has the bias alone, so the score of no evidence; labels other than
0 and 1 and null ids are not learned from; without labelled rows every score is 0.5;
repeated rows are scored each; an empty table gives no rows; other columns are not read, and
`remove_toxic` keeps them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from docketry.llm.blocks import ALPHANUMERIC, Words, blocks, map_rows, mix, release, windows, words
from docketry.session import materialise

# Features that are looked up at once.
CHUNK = 1 << 20
MAX_ROWS = 16_000
SHARDS = 4
# Share of the shards that must use a feature, and L1 per square root of a shard's rows.
AGREE = 0.7
SPARSE = 0.15
MAX_WEIGHTS = 200_000
THRESHOLD = 0.7

# FTRL-proximal: learning rate, its offset, L1, L2 and epochs, for choosing features and for their weights.
CHOOSE = (1.0, 1.0, None, 0.0, 5)
REFIT = (2.0, 1.0, 0.2, 0.0, 20)

_SKIP = np.uint64(0x9FB21C651E98DF25)

Model = tuple[np.ndarray, np.ndarray, float]


def held_out(doc_id: Column) -> Column:
    """Rows whose labels may not be learned."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def feature_runs(w: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """`(hashes, rows)` of words, word pairs and skip pairs in a block."""
    yield w.hash, w.row
    for gap in (1, 2):
        same = np.flatnonzero(w.row[:-gap] == w.row[gap:]) if len(w.row) > gap else np.empty(0, np.int64)
        if gap == 1:
            hashed = windows(w.hash, 2)[same] if len(same) else np.empty(0, np.uint64)
        else:
            hashed = mix(w.hash[same] * _SKIP + mix(w.hash[same + gap]))
        yield hashed, w.row[same]


def features(column: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct features of each text."""
    for block in blocks(column):
        w = words(block, ALPHANUMERIC, lower=True)
        runs = list(feature_runs(w))
        hashed = np.concatenate([h for h, _ in runs])
        row = np.concatenate([r for _, r in runs])
        hashed = hashed[np.argsort(row, kind="stable")]
        ends = np.cumsum(np.bincount(row, minlength=len(block)))
        for a, b in zip([0, *ends[:-1].tolist()], ends.tolist()):
            yield np.unique(hashed[a:b])


def coordinates(hashed: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The place of each hash among `keys`, from 1; 0 for others."""
    if not len(keys):
        return np.zeros(len(hashed), np.int32)
    at = np.minimum(np.searchsorted(keys, hashed), len(keys) - 1)
    return np.where(keys[at] == hashed, at + 1, 0).astype(np.int32)


def ftrl(flat: np.ndarray, sizes: np.ndarray, labels: np.ndarray, rates: tuple[float, float, float | None, float, int]) -> Model:
    """Weights of one shard, whose rows' features lie one after another: hashes, weights and bias."""
    alpha, beta, l1, l2, epochs = rates
    l1 = SPARSE * len(sizes) ** 0.5 if l1 is None else l1
    keys, seen = np.unique(flat, return_counts=True)
    # The gradient of one row in one epoch is below 1, so what occurs in few rows stays at zero under L1.
    keys = keys[seen * epochs > l1]
    index = np.concatenate([coordinates(flat[low:low + CHUNK], keys) for low in range(0, len(flat), CHUNK)] or [np.empty(0, np.int32)])
    ends = np.cumsum(sizes)
    # The bias is coordinate 0 and has no penalty.
    coded = [np.append(c[c > 0], 0) for c in (index[b - n:b] for b, n in zip(ends.tolist(), sizes.tolist()))]
    z, n, sparse = np.zeros(len(keys) + 1), np.zeros(len(keys) + 1), np.full(len(keys) + 1, l1)
    sparse[0] = 0.0

    def weights(z: np.ndarray, n: np.ndarray, sparse: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= sparse, 0.0, -(z - np.sign(z) * sparse) / ((beta + np.sqrt(n)) / alpha + l2 * (sparse > 0)))

    for _ in range(epochs):
        for at, y in zip(coded, labels):
            za, na = z[at], n[at]
            wa = weights(za, na, sparse[at])
            g = 1 / (1 + np.exp(-np.clip(wa.sum(), -30, 30))) - y
            z[at] = za + g - (np.sqrt(na + g * g) - np.sqrt(na)) / alpha * wa
            n[at] = na + g * g
    w = weights(z, n, sparse)
    used = np.flatnonzero(w[1:])
    return keys[used], w[1:][used], float(w[0])


def feature_rows(sample: DataFrame, allowed: np.ndarray | None = None) -> DataFrame:
    """`shard`, `doc_id`, `label` and the features of each sampled text, all or the allowed ones."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, len(batch), 500):
                some = batch.slice(low, 500)
                found = list(features(some.column("text")))
                if allowed is not None:
                    found = [np.intersect1d(f, allowed, assume_unique=True) for f in found]
                ends = np.concatenate([[0], np.cumsum([len(f) for f in found], dtype=np.int64)])
                flat = np.concatenate([*found, np.empty(0, np.uint64)]).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in ("shard", "doc_id", "label")), lists], ["shard", "doc_id", "label", "features"])

    return sample.mapInArrow(cut, "shard int, doc_id long, label int, features array<long>")


def fit_shards(rows: DataFrame, rates: tuple, most: int) -> dict[int | None, float]:
    """Mean weights of the features that most shards use; the bias is under None."""

    def learn(_: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("doc_id")
        table = table.take(pa.array(np.random.default_rng(7).permutation(len(table))))
        lists = table.column("features").combine_chunks()
        keys, weights, bias = ftrl(lists.flatten().to_numpy().view(np.uint64), lists.value_lengths().to_numpy(), table.column("label").to_numpy(), rates)
        release()
        return pa.table({
            "feature": pa.array([None, *keys.view(np.int64).tolist()], pa.int64()),
            "weight": pa.array([bias, *weights.tolist()], pa.float64()),
        })

    learned = rows.groupBy("shard").applyInArrow(learn, "feature long, weight double").groupBy("feature").agg(F.count("*").alias("n"), F.sum("weight").alias("w"))
    kept = learned.where(F.col("feature").isNull() | (F.col("n") > AGREE * most))
    return {r.feature: r.w / r.n for r in kept.orderBy(F.col("feature").isNotNull(), F.abs("w").desc(), "feature").limit(MAX_WEIGHTS + 1).collect()}


def train(documents: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = MAX_ROWS, shards: int = SHARDS) -> Model:
    """A model from the labelled rows that are not held out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    share = min(1.0, max_rows / max(1, known.count()))
    chosen = known.where(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # The chosen ids are bounded by max_rows, so the texts stay where they are.
    sample = texts.join(F.broadcast(chosen), "doc_id").groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.max("label").alias("label"))
    sample = sample.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int"))
    sample = materialise(sample, "toxicity_sample")
    # A shard without rows keeps nothing, so the share counts those with rows.
    filled = sample.select("shard").distinct().count()
    chosen_features = [f for f in fit_shards(feature_rows(sample), CHOOSE, filled) if f is not None]
    allowed = np.sort(np.array(chosen_features, np.int64).view(np.uint64))
    # What is left of the bounded sample is a few hashes a row, fitted in one task.
    weights = fit_shards(feature_rows(sample, allowed).withColumn("shard", F.lit(0)), REFIT, 0)
    bias = weights.pop(None, 0.0)
    keys = np.array(list(weights), np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], np.array(list(weights.values()), float)[order], bias


def lookup_bits(keys: np.ndarray) -> np.ndarray:
    bits = np.zeros(1 << 22, bool)
    bits[keys >> np.uint64(42)] = True
    return bits


def scores(column: pa.Array, model: Model, bits: np.ndarray) -> np.ndarray:
    """Scores of whole texts; a feature counts once however often it occurs."""
    keys, weights, bias = model
    out = []
    for block in blocks(column):
        w = words(block, ALPHANUMERIC, lower=True)
        hits, rows = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for hashed, row in feature_runs(w):
            likely = np.flatnonzero(bits[hashed >> np.uint64(42)])
            at = np.searchsorted(keys, hashed[likely])
            found = at < len(keys)
            found[found] = keys[at[found]] == hashed[likely][found]
            hits.append(at[found])
            rows.append(row[likely][found])
        both = np.unique(np.stack([np.concatenate(rows), np.concatenate(hits)]), axis=1)
        total = bias + np.bincount(both[0], weights[both[1]], minlength=len(block))
        out.append(1 / (1 + np.exp(-np.clip(total, -30, 30))))
    return np.concatenate(out) if out else np.empty(0)


def score_documents(documents: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """`doc_id`, `held_out`, `score` and `predicted` of every document."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    texts = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id").cast("long")).alias("held_out"), F.col("text").cast("string").alias("text")
    )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = lookup_bits(shared.value[0])
        for batch in batches:
            p = scores(batch.column("text"), shared.value, bits)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"]
            )

    return texts.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")


def remove_toxic(documents: DataFrame, model: Model, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """The documents that score below `threshold`, all columns kept."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    at = documents.columns.index(text)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = lookup_bits(shared.value[0])
        for batch in batches:
            yield batch.filter(pa.array(scores(batch.column(at), shared.value, bits) < threshold))

    return map_rows(documents, keep)


def q_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_documents(documents, train(documents, spark.read.parquet(f"{sf_dir}/labels.parquet")))
