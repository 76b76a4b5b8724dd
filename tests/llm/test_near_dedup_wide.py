"""Nodes of more members than the limit and of many labels: compared in one task, by bands of coordinates."""

import numpy as np
import pytest

from docketry.llm import near_dedup as n
from test_near_dedup import brute, edits, got
from test_near_dedup_rows import shared_passage


def sketches(rows=600, seed=1):
    """Sketches of which a third is one value everywhere, with near copies among them."""
    rng = np.random.default_rng(seed)
    made = rng.integers(0, 256, (rows, n.COORDINATES)).astype(np.uint8)
    made[rng.random(made.shape) < 0.33] = 7
    for row in range(0, rows - 3, 12):
        for copy in (row + 1, row + 3):
            other = rng.random(n.COORDINATES) < 0.22
            made[copy] = np.where(other, rng.integers(0, 256, n.COORDINATES), made[row])
    return made


def sorted_pairs(parts):
    return sorted(zip(*(c.tolist() for c in n.together(parts))))


@pytest.mark.parametrize("least", [83, 92, 128])
@pytest.mark.parametrize("pairs", [50, 1 << 17])
def test_bands_find_the_pairs_that_all_pairs_hold(monkeypatch, least, pairs):
    monkeypatch.setattr(n, "PAIRS", pairs)
    made, labels = sketches(), np.random.default_rng(2).integers(0, 300, 600)
    for label in (None, labels, np.where(labels < 250, 0, labels)):
        want = sorted_pairs(n.by_gaps(np.zeros(600, np.int64), made, label, least))
        assert sorted_pairs(n.by_bands(made, label, least)) == want and (len(want) > 20 or least == 128)
    alike = np.repeat(made[:1], 300, axis=0)
    assert len(sorted_pairs(n.by_bands(alike, None, least))) == 300 * 299 // 2


def test_choosing_in_parts_chooses_as_much(monkeypatch):
    made = sketches(400, 5)
    whole = n.together(n.by_gaps(np.zeros(400, np.int64), made, None, 60))
    monkeypatch.setattr(n, "PAIRS", 20)
    for choose in (lambda a, b, agree: n.spanning_forest(400, a, b, agree), lambda a, b, agree: n.best_of_each(400, a, b, agree, 2)):
        at = choose(*whole)
        a, b, more = n.chosen_pairs(n.by_gaps(np.zeros(400, np.int64), made, None, 60), choose, 400)
        assert len(a) == len(at) and np.array_equal(n.merge(np.arange(400), a, b), n.merge(np.arange(400), whole[0][at], whole[1][at]))
        dropped = np.delete(np.arange(len(whole[0])), at)
        assert len(a) + len(dropped) == len(whole[0]) and (len(more) > 0) == (len(dropped) > 0)


def test_texts_of_a_shared_passage_are_compared_without_branching(spark, monkeypatch):
    grown, kept = [], n.materialise
    monkeypatch.setattr(n, "materialise", lambda df, label: grown.append(label) or kept(df, label))
    rows = shared_passage()
    assert got(n.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), node_limit=20, wide_limit=1000)) == brute(rows)
    assert "level" not in grown and "in_large" in grown


def test_a_passage_of_thousands_of_texts_takes_no_further_trees(spark, monkeypatch):
    """At the limits of the job: a node of some 3,000 members that share a passage and are no copies."""
    grown, kept = [], n.materialise
    monkeypatch.setattr(n, "materialise", lambda df, label: grown.append(label) or kept(df, label))
    rows = [(i, f"a shared passage {i}") for i in range(6000)]
    copies = [" ".join(["a shared passage", *(f"c{c}w{i}" for i in range(40))]) for c in range(30)]
    rows += [(6000 + 2 * c + at, text) for c, first in enumerate(copies) for at, text in enumerate((first, edits(first.split(), c, 1)))]
    found = got(n.near_copies(spark.createDataFrame(rows, "doc_id long, text string")))
    assert {i: found[i][1] for i, _ in rows} == {i: i if i < 6000 else i - i % 2 for i, _ in rows}
    assert "level" not in grown and "wanted" not in grown
