"""Near-dedup under another rule than that of the query."""

import pytest

from docketry.llm import near_dedup as n
from test_near_dedup import LOWER, edits, got


def brute(rows, k, part, whole):
    """All pairs of texts on shingles of `k` words."""
    sets = {}
    for i, text in rows:
        w = (text or "").translate(LOWER).encode().split()
        sets[i] = {tuple(w[a:a + k]) for a in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
    label = {i: i for i in sets}
    for a in sets:
        for b in sets:
            common = len(sets[a] & sets[b])
            if a < b and common and part * common >= whole * len(sets[a] | sets[b]) and label[a] != label[b]:
                low, high = sorted((label[a], label[b]))
                label = {i: low if c == high else c for i, c in label.items()}
    return {i: (len(sets[i]), label[i], label[i] == i) for i in sets}


def test_a_copy_of_four_fifths_on_five_words(spark):
    base = [f"w{i}" for i in range(104)]
    rows = [(1, " ".join(base)), (2, " ".join(base + [f"more{i}" for i in range(22)]))]
    for g in range(4):
        words = [f"g{g}w{i}" for i in range(120)]
        rows += [(10 + 20 * g + m, edits(words, 20 * g + m, m % 5)) for m in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, 5, 100, 80)
    assert want[2] == (122, 1, False)
    assert got(n.near_copies(docs, shingle=5, part=100, whole=80)) == want
    assert got(n.near_copies(docs)) == brute(rows, 3, 100, 85) != want
    left = n.remove_near_copies(docs, shingle=5, part=100, whole=80).collect()
    assert sorted(r.doc_id for r in left) == sorted(i for i, (_, _, kept) in want.items() if kept)


@pytest.mark.parametrize("part,whole", [(100, 85), (100, 80), (100, 60)])
def test_bounds_follow_the_threshold(part, whole):
    twice, share = n.branching(part, whole), whole / part
    assert 0.99 < share * (1 + twice / 1024) <= 1
    roots = n.root_choices(n.enough_trees(part, whole), n.COORDINATES, twice)
    assert len({c for _, c in roots}) == len(roots) and (1 - share) ** len(roots) <= n.MISS
    deviation = (share * (1 - share) / n.COORDINATES) ** 0.5
    assert n.least_agreement(part, whole) <= n.COORDINATES * (share - 4 * deviation)
