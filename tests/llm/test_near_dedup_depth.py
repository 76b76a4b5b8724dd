"""Groups well above the node limit, with members that hang on one other alone."""

import math

import pytest

from docketry.llm import near_dedup as n
from test_near_dedup import brute, got


def fringe(members=60):
    """Near copies of one text, and for each a text that is a copy of it alone, just at the threshold."""
    base, rows = [f"w{i}" for i in range(300)], []
    for m in range(members):
        # Places three words apart, so each change costs three shingles.
        own = list(base)
        for at in range(3):
            own[4 + 3 * ((m + 31 * at) % 98)] = f"m{m}x{at}"
        edge = list(own)
        free = [4 + 3 * k for k in range(98) if not own[4 + 3 * k].startswith("m")]
        for at in range(8):
            edge[free[(5 * m + 11 * at) % len(free)]] = f"e{m}x{at}"
        rows += [(2 * m, " ".join(own)), (2 * m + 1, " ".join(edge))]
    return rows


def test_fringe_of_a_large_group_is_not_lost(spark):
    rows = fringe(40)
    want = brute(rows)
    assert {group for _, group, _ in want.values()} == {0}
    # With three trees for first nodes the chance to be lost deeper down is plain to see on a small group.
    assert got(n.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), trees=3, node_limit=6, depth=8)) == want


@pytest.mark.parametrize("part,whole", [(100, 85), (100, 80)])
def test_trees_follow_the_depth(part, whole):
    trees = n.enough_trees(part, whole)
    shared = n.shared_levels(part, whole, n.DEPTH)
    enough = n.trees_by_depth(part, whole, n.DEPTH, trees)
    assert (1 - shared[n.DEPTH]) ** trees > 0.01
    assert all((1 - s) ** t <= n.MISS * (1 + 1e-9) for s, t in zip(shared, enough))
    assert enough == sorted(enough) and enough[0] <= trees + 1 and math.isclose(shared[0], 1 - (1 - whole / part) * (1 - n.branching(part, whole) / 1024 * whole / part))
