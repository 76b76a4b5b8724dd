"""A word triple that stands among different neighbours in every document."""

import random

import numpy as np
import pyarrow as pa

from docketry.llm import substring_dedup as s
from docketry.llm.blocks import blocks, words
from test_substring_dedup import brute, passages, rows_of


def least_triple():
    """Three words whose hash is so small that they are the minimiser of nearly every window that holds them."""
    found = []
    for k in range(3000):
        text = f"t{k} u{k} v{k}"
        block = next(iter(blocks(pa.array([text]))))
        found.append((int(s.runs(words(block), 3)[2][0]), text))
    return min(found)[1]


def shared_phrase(n=240):
    rng, phrase = random.Random(3), least_triple()
    rows = []
    for i in range(n):
        said = [f"a{rng.randrange(3 * n)}" for _ in range(14)] + [phrase] + [f"b{rng.randrange(3 * n)}" for _ in range(14)]
        rows.append((i, " ".join(said)))
    return rows + [(n + i, f"x {text} y") for i, text in rows[: n // 4]]


def heaviest(sent):
    """Bytes of packed words in the fullest bucket."""
    total = {}
    for r in sent.collect():
        total[r.bucket] = total.get(r.bucket, 0) + len(s.widen(bytes(r.texts)))
    return max(total.values())


def test_a_hot_minimiser_is_spread(spark):
    rows = shared_phrase()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bound = 4000
    hot = s.hot_minimisers(docs, 13, bound)
    assert len(hot) == 1
    whole, spread = (heaviest(s.send(docs, 13, 64, h)) for h in (hot[:0], hot))
    assert whole > 4 * bound and spread < 2 * bound
    assert rows_of(s.remove_repeats(docs, bucket_bytes=bound, chunk_bytes=3000)) == brute(rows)


def test_all_minimisers_hot(spark, monkeypatch):
    rows = passages()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    every = s.hot_minimisers(docs, 13, 0)
    assert len(every) > 100
    monkeypatch.setattr(s, "hot_minimisers", lambda *_: every[::2])
    assert rows_of(s.remove_repeats(docs, bucket_bytes=500, chunk_bytes=300)) == brute(rows)
    assert np.all(np.diff(every.astype(object)) > 0)
