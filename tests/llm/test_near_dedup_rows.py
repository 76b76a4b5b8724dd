"""How many rows a passage that many texts share costs: those of the trees that the depth asks for."""

import pytest

from docketry.llm import components as c, near_dedup as n
from test_near_dedup import brute, edits, got


def shared_passage(members=120):
    """Texts that hold one passage and else their own words; every sixth has a near copy."""
    passage, rows = [f"p{i}" for i in range(60)], []
    for m in range(members):
        own = passage + [f"m{m}w{i}" for i in range(40)]
        rows.append((len(rows), " ".join(own)))
        if m % 6 == 0:
            rows.append((len(rows), edits(own, m, 2)))
    return rows


def test_texts_of_a_shared_passage_take_no_more_trees_than_their_depth_asks_for(spark, monkeypatch):
    rows, grown, kept = shared_passage(), [], n.materialise

    def counted(df, label):
        out = kept(df, label)
        if label == "level":
            grown.append(out.count())
        return out

    monkeypatch.setattr(n, "materialise", counted)
    assert got(n.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), node_limit=60)) == brute(rows)
    assert 0 < sum(grown) < 25 * len(rows), grown


@pytest.mark.parametrize("most", [0, 1 << 16])
def test_components_do_not_depend_on_how_minima_travel(spark, monkeypatch, most):
    monkeypatch.setattr(c, "MAX_BROADCAST_EDGES", most)
    edges = [(i, i + 1) for i in range(40)] + [(90, i) for i in range(60, 80)] + [(100, 101), (101, 102), (102, 100), (7, 7)]
    rows = c.components(spark.createDataFrame(edges, "a long, b long")).collect()
    want = {**{i: 0 for i in range(41)}, **{i: 60 for i in [*range(60, 80), 90]}, 100: 100, 101: 100, 102: 100}
    assert {r.id: r.component for r in rows} == want and len(rows) == len(want)
    assert c.components(spark.createDataFrame([(3, 3)], "a long, b long")).isEmpty()


def test_further_links_that_join_nothing_change_no_label(spark):
    labels = c.joined(None, spark.createDataFrame([(1, 2), (2, 3), (5, 6)], "a long, b long"))
    same = c.joined(labels, spark.createDataFrame([(1, 3), (5, 6)], "a long, b long"))
    assert sorted(map(tuple, same.collect())) == sorted(map(tuple, labels.collect())) == [(1, 1), (2, 1), (3, 1), (5, 5), (6, 5)]
    more = c.joined(labels, spark.createDataFrame([(6, 2), (8, 9)], "a long, b long"))
    assert sorted(map(tuple, more.collect())) == [(1, 1), (2, 1), (3, 1), (5, 1), (6, 1), (8, 8), (9, 8)]
