"""Language identification by error-correcting output codes.

Each language has a codeword of bits. For each bit a binary classifier over byte n-grams
(two to four bytes of a lower-cased word between two spaces, hashed) tells the languages
with a 1 from those with a 0; its weights are smoothed log-odds of the n-gram counts. A text's
margin for a bit is the mean weight of its n-grams. Decoding adds the logistic loss of
each margin under each codeword and takes the language with the least; a small lead over the
second marks the text ambiguous. Up to `EXHAUSTIVE` languages get all ways to halve them, more
get random codewords far apart.

Learning reads at most about `MAX_ROWS` labelled rows (a documented bound; chosen by a hash of
the id). The model is one weight per slot and bit. All n-grams of all texts count; since weights add
up, each distinct word of a block is looked up once.

Edge cases: a text that is null or has no letter is `und` with score 0; so is every text if no label
could be learned; a single learned language is given to every text with a letter; ties go to the
smaller language name; repeated rows are judged each; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from docketry.llm.blocks import Block, Words, blocks, class_table, mix, words

MAX_ROWS = 20_000
SLOTS = 1 << 16
ORDERS = (2, 3, 4)
EXHAUSTIVE = 6
# n-grams after which more text adds no more weight, and the lead below which a text is ambiguous.
EVIDENCE = 12
LEAD = 0.2
SMOOTHING = 2.0
UNKNOWN = "und"

LETTERS = class_table(lambda b: 65 <= b <= 90 or 97 <= b <= 122 or b >= 128)

RESULT = "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean"


def held_out(doc_id: Column) -> Column:
    """Rows whose labels may not be learned."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def codewords(languages: int) -> np.ndarray:
    """One row of +1 and -1 per language; no two rows and no two columns are alike."""
    if languages < 2:
        return np.ones((languages, 1))
    if languages <= EXHAUSTIVE:
        columns = [[1 if i == 0 or i in chosen else -1 for i in range(languages)]
                   for size in range(languages - 1) for chosen in combinations(range(1, languages), size)]
        return np.array(columns, float).T
    bits, rng, best = 15 * int(np.ceil(np.log2(languages))), np.random.default_rng(11), None
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (languages, bits))
        apart = (bits - np.max(code @ code.T - 2 * bits * np.eye(languages))) / 2
        if best is None or apart > best[0]:
            best = (apart, code)
    return best[1]


def gram_slots(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words of a block: index of each word's, and slots of their n-grams with the distinct word."""
    _, first, distinct = np.unique(w.hash, return_index=True, return_inverse=True)
    lengths = (w.ends - w.starts)[first] + 2
    ends = np.cumsum(lengths)
    begins = ends - lengths
    text = np.full(int(lengths.sum()), 32, np.uint8)
    owner = np.repeat(np.arange(len(first)), lengths)
    inner = np.arange(len(text)) - begins[owner]
    middle = (inner > 0) & (inner < lengths[owner] - 1)
    text[middle] = w.data[(w.starts[first][owner] + inner - 1)[middle]]
    codes = text.astype(np.uint64) + np.uint64(1)
    slots, owners = [], []
    for order in ORDERS:
        n = len(text) - order + 1
        if n <= 0:
            continue
        value = np.zeros(n, np.uint64)
        for k in range(order):
            value = value * np.uint64(257) + codes[k:k + n]
        whole = np.flatnonzero(owner[:n] == owner[order - 1:])
        slots.append((mix(value[whole] + np.uint64(order << 56)) & np.uint64(SLOTS - 1)).astype(np.int64))
        owners.append(owner[whole])
    if not slots:
        return distinct, np.empty(0, np.int64), np.empty(0, np.int64)
    return distinct, np.concatenate(slots), np.concatenate(owners)


def train(documents: DataFrame, max_rows: int = MAX_ROWS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, their codewords, and the weight of each slot for each bit."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    known = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    share = min(1.0, max_rows / max(1, known.count()))
    sample = known.where(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            languages = batch.column("lang").to_pylist()
            names = sorted(set(languages))
            coded = np.array([names.index(x) for x in languages], np.int64)
            for block in blocks(batch.column("text")):
                w = words(block, LETTERS, lower=True)
                distinct, slots, owners = gram_slots(w)
                own = coded[block.first_row:block.first_row + len(block)]
                for k in np.unique(own):
                    weight = np.bincount(distinct[own[w.row] == k], minlength=int(distinct.max(initial=-1)) + 1)
                    totals.setdefault(names[k], np.zeros(SLOTS))
                    if len(slots):
                        totals[names[k]] += np.bincount(slots, weight[owners], minlength=SLOTS)
        for name, counts in totals.items():
            used = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(used), pa.string()), pa.array(used), pa.array(counts[used])], ["lang", "slot", "n"])

    # At most SLOTS rows for each language come to the driver.
    counted = sample.select("lang", "text").mapInArrow(count, "lang string, slot long, n double").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    table = counted.toPandas()
    languages = sorted(table["lang"].unique().tolist())
    counts = np.zeros((len(languages), SLOTS))
    counts[[languages.index(x) for x in table["lang"]], table["slot"].to_numpy(np.int64)] = table["n"].to_numpy()
    shares = (counts + SMOOTHING) / (counts.sum(axis=1, keepdims=True) + SMOOTHING * SLOTS)
    code = codewords(len(languages))
    ones, zeros = (code > 0).astype(float), (code < 0).astype(float)
    mean = lambda side: (side.T @ shares) / np.maximum(side.sum(axis=0)[:, None], 1)
    weights = np.log(mean(ones) + 1e-12) - np.log(mean(zeros) + 1e-12) if len(languages) > 1 else np.zeros((1, SLOTS))
    return languages, code, np.ascontiguousarray(weights.T, dtype=np.float32)


def block_margins(w: Words, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text of a block: summed weights of its n-grams by bit, and their number."""
    bits = weights.shape[1]
    distinct, slots, owners = gram_slots(w)
    n = int(distinct.max(initial=-1)) + 1
    grams = np.bincount(owners, minlength=n)
    found = weights[slots]
    per_word = np.stack([np.bincount(owners, found[:, b], minlength=n) for b in range(bits)], axis=1)
    sums = np.stack([np.bincount(w.row, per_word[distinct, b], minlength=len(w.counts)) for b in range(bits)], axis=1)
    return sums, np.bincount(w.row, grams[distinct], minlength=len(w.counts))


def decode(sums: np.ndarray, grams: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best codeword of each row, its share of belief, and its lead over the second."""
    margins = sums / np.maximum(grams, 1)[:, None] * np.minimum(grams, EVIDENCE)[:, None]
    loss = np.stack([np.logaddexp(0, -margins * row).sum(axis=1) for row in code], axis=1)
    belief = np.exp(loss.min(axis=1, keepdims=True) - loss)
    belief /= belief.sum(axis=1, keepdims=True)
    best = loss.argmin(axis=1)
    ranked = np.sort(belief, axis=1)
    lead = ranked[:, -1] - ranked[:, -2] if code.shape[0] > 1 else np.ones(len(best))
    return best, belief[np.arange(len(best)), best], lead


def has_letter(block: Block, counts: np.ndarray) -> np.ndarray:
    """Whether a text has a letter; characters beyond ASCII are looked up one by one only where no ASCII letter is."""
    ascii_letter = np.zeros(256, bool)
    ascii_letter[65:91] = ascii_letter[97:123] = True
    sums = np.concatenate([[0], np.cumsum(ascii_letter[block.data])])
    some = sums[block.offsets[1:]] > sums[block.offsets[:-1]]
    for i in np.flatnonzero(~some & (counts > 0)):
        text = block.data[block.offsets[i]:block.offsets[i + 1]].tobytes().decode("utf-8", "replace")
        some[i] = any(c.isalpha() for c in text)
    return some


def identify(documents: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray]) -> DataFrame:
    """The language of every document."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    texts = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id").cast("long")).alias("held_out"), F.col("text").cast("string").alias("text")
    )

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, code, weights = shared.value
        for batch in batches:
            for block in blocks(batch.column("text")):
                w = words(block, LETTERS, lower=True)
                if languages:
                    best, belief, lead = decode(*block_margins(w, weights), code)
                else:
                    best, belief, lead = np.zeros(len(block), int), np.zeros(len(block)), np.ones(len(block))
                known = has_letter(block, w.counts) & bool(languages)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(block.first_row, len(block)),
                    batch.column(1).slice(block.first_row, len(block)),
                    pa.array([languages[b] if k else UNKNOWN for b, k in zip(best, known)], pa.string()),
                    pa.array(np.where(known, belief, 0.0)),
                    pa.array(known & (lead < LEAD)),
                ], [f.split()[0] for f in RESULT.split(", ")])

    return texts.mapInArrow(judge, RESULT)


def q_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(documents, train(documents))
