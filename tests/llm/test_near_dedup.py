import random
from collections import defaultdict

import numpy as np
import pytest

from docketry.llm import near_dedup as n
from docketry.llm.components import components
from llm_data import ODD, odd_documents

LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def shingles(text):
    w = (text or "").translate(LOWER).encode().split()
    return frozenset(zip(w, w[1:], w[2:])) if len(w) >= 3 else frozenset([tuple(w)] if w else [])


def brute(rows):
    """All pairs of texts, compared in full."""
    sets = {i: shingles(t) for i, t in rows if i is not None}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            s, t = sets[a], sets[b]
            if s and t and 85 * max(len(s), len(t)) <= 100 * min(len(s), len(t)):
                common = len(s & t)
                if 100 * common >= 85 * (len(s) + len(t) - common):
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect() if r.doc_id is not None}


def edits(base, seed, words):
    """A copy of `base` with `words` words replaced."""
    rng, out = random.Random(seed), list(base)
    for at in rng.sample(range(len(out)), words):
        out[at] = f"new{rng.random()}"
    return " ".join(out)


def family(groups=6, members=14):
    rows = []
    for g in range(groups):
        base = [f"g{g}w{i}" for i in range(120)]
        for m in range(members):
            rows.append((len(rows), edits(base, len(rows), m % 5)))
    return rows


def test_query_equals_all_pairs(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert got(n.q_near_dedup(spark, sf)) == brute(rows)


def test_groups_around_the_threshold(spark):
    rows = family()
    assert got(n.near_copies(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_large_nodes_branch_and_tight_ones_are_cut_into_blocks(spark):
    rows = family(2, 24)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(n.near_copies(docs, node_limit=4, depth=2)) == brute(rows)
    assert got(n.near_copies(docs, node_bytes=100)) == brute(rows)


def scattered(members=70):
    """Texts at all distances from one, most of them below the threshold."""
    base = [f"w{i}" for i in range(150)]
    return [(m, edits(base, m, m % 12)) for m in range(members)]


def test_pairs_around_the_threshold_are_all_checked(spark):
    rows = scattered()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(n.near_copies(docs)) == got(n.near_copies(docs, node_bytes=0)) == brute(rows)


def test_odd_rows(spark):
    docs = odd_documents(spark)
    out = n.near_copies(docs)
    assert out.count() == len(ODD)
    assert got(out) == brute(ODD)
    nobody = [r for r in out.collect() if r.doc_id is None]
    assert all(r.kept and r.component_id is None for r in nobody)
    kept = n.remove_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted((i for i, _ in ODD if i is None or brute(ODD)[i][2]), key=repr)
    assert n.near_copies(docs.limit(0)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100), (7, 7), (200, 201)]
    rows = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.id: r.component for r in rows} == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100, 200: 200, 201: 200}
    assert len(rows) == 46


def test_minwise_agreement_follows_similarity():
    rng = np.random.default_rng(1)
    base = rng.integers(1, 1 << 62, 400).astype(np.uint64)
    other = np.concatenate([base[40:], rng.integers(1, 1 << 62, 40).astype(np.uint64)])
    values = n.minwise(np.concatenate([base, other]), np.array([400, 400]), 512)
    assert np.mean(values[0] == values[1]) == pytest.approx(360 / 440, abs=0.06)


def test_forest_joins_what_its_pairs_join():
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 60, 200), rng.integers(0, 60, 200)
    a, b = a[a != b], b[a != b]
    chosen = n.spanning_forest(60, a, b, rng.integers(90, 128, len(a)))
    whole, forest = n.merge(np.arange(60), a, b), n.merge(np.arange(60), a[chosen], b[chosen])
    assert np.array_equal(whole, forest)
    assert len(chosen) == 60 - len(np.unique(whole))


def test_groups_are_not_cut_by_batches():
    import pyarrow as pa

    keys = np.sort(np.random.default_rng(2).integers(0, 50, 1000))
    table = pa.table({"node": keys})
    tables = list(n.whole_groups(iter(table.to_batches(max_chunksize=37)), "node", rows=60))
    seen = defaultdict(int)
    for t in tables:
        for k in np.unique(t.column("node").to_numpy()):
            seen[k] += 1
    assert max(seen.values()) == 1 and sum(map(len, tables)) == 1000
