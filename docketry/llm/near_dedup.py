"""Near-duplicates by chosen-path set similarity join.

A document is its set of word shingles; equal sets form one class, and classes are joined.
Each class carries `COORDINATES` minwise values. Every tree branches a class at a node by one
chosen coordinate, now and then by two, so that two sets at the threshold are expected to stay together
in one child; the node's id decides which coordinates. A node of at most `NODE_LIMIT` classes is
compared exhaustively by sketches, a larger one branches again. `TREES` independent trees
make a miss at one tree unlikely to be a miss at all: a pair at the threshold meets at the first level
of at least one with a probability above 1 - 1e-9. A pair is lost with more of the trees the deeper they branch, so
classes whose nodes were too large take further trees, as many as keep that probability at the depth they reached.

A pair that meets in several nodes is weighed in one of them. Within a node a spanning forest of the likely pairs
goes to the exact check on full sets; then only pairs between classes that are still apart, first the best
few of each class, then all of them, which are checked inside the node and never written out. So a group of n near copies
costs n rows and not n * n, and no link between groups is lost.

The members of a large node are first compared with a few pivots of it, in slices and on full sets, and get the label of what they are linked with. A
large node of one label is done. One with a main label and few others is cut into blocks of the main label's members, each with all the others. One of
many labels and at most `WIDE_LIMIT` classes is compared in one task by bands of coordinates: two sketches that agree where they must have a band in
common, so only members that share one are held against each other, and no pair is lost. Only nodes of still more members
branch. Nodes that branch to the last level and are still large are cut into blocks, and every block meets every other block, in bounded tasks.

Edge cases: null, empty and wordless texts have no set, are linked with nothing and kept; a text of
fewer words than a shingle is one shingle; rows with a null id are kept, with a null component; rows that
repeat an id are rows of one class if their texts agree, else each is judged by its own set, since a class is named by a
hash of its smallest id and its set (`class_name`) and a component gets its smallest id at the end; an
empty table gives no rows; other columns are not read, and `remove_near_copies` keeps them.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from docketry.llm.blocks import NOT_SPACE, Words, blocks, mix, ranges, release, windows, words
from docketry.llm.components import joined
from docketry.session import materialise

SHINGLE = 3
# A link needs PART * intersection >= WHOLE * union, unless the caller names another share.
PART, WHOLE = 100, 85
COORDINATES = 128
TREES = 12
# The chance at which a pair at the threshold may meet nowhere; a lower threshold takes more trees.
MISS = 1e-9
NODE_LIMIT = 2048
# Members of many labels that one task compares, by bands of coordinates: 13 MB or so of sketches and first nodes. Nodes of more branch.
WIDE_LIMIT = 65_536
DEPTH = 24
# How far below the threshold the share of agreeing coordinates may lie for a pair to be checked, in deviations.
DEVIATIONS = 4
# Bytes of sets that a node may bring to a task; the pairs of a heavier one are written out.
NODE_BYTES = 64 << 20
BEST = 8
# Members of a large node that all others are compared with, on average, and the first choices whose nodes are.
PIVOTS = 32
PIVOT_PLACES = 3
FILTER_BITS = 1 << 24
# Pairs of a node that are held against each other at once, and rows of a node from which on its pairs are found by bands.
PAIRS = 1 << 17
BANDED = 2048
ROOT_BITS = (1 << 31) - 1

SIGNED = "doc_id long, said long, n_shingles long, key binary, sketch binary, nodes array<long>"


def branching(part: int, whole: int) -> int:
    """Share of nodes that branch twice, in 1024ths: one child of a pair at the threshold survives on average."""
    return min(1024, int(1024 * (part / whole - 1)))


def least_agreement(part: int, whole: int) -> int:
    """Coordinates that must agree for a pair to be checked: some deviations below the threshold, rounded up to a hundredth."""
    share = whole / part
    slack = math.ceil(100 * DEVIATIONS * math.sqrt(share * (1 - share) / COORDINATES)) / 100
    return int(COORDINATES * (share - slack))


def shingle_sets(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The sets of a block's texts, one after another and each sorted, and their sizes."""
    hashed, row = [], []
    starts = np.flatnonzero(w.counts[w.row] >= k)
    if len(starts):
        starts = starts[starts < (w.first + w.counts)[w.row[starts]] - k + 1]
        hashed.append(windows(w.hash, k)[starts])
        row.append(w.row[starts])
    for n in range(1, k):
        short = np.flatnonzero(w.counts == n)
        if len(short):
            hashed.append(windows(w.hash, n)[w.first[short]])
            row.append(short)
    if not hashed:
        return np.empty(0, np.uint64), np.zeros(len(w.counts), np.int64)
    hashed, row = np.concatenate(hashed), np.concatenate(row)
    order = np.lexsort((hashed, row))
    hashed, row = hashed[order], row[order]
    new = np.ones(len(row), bool)
    new[1:] = (hashed[1:] != hashed[:-1]) | (row[1:] != row[:-1])
    return hashed[new], np.bincount(row[new], minlength=len(w.counts))


def minwise(sets: np.ndarray, sizes: np.ndarray, coordinates: int) -> np.ndarray:
    """For each set that is not empty a row of minwise values, which name a shingle per coordinate."""
    begins = (np.cumsum(sizes) - sizes)[sizes > 0]
    out = np.empty((len(begins), coordinates), np.uint64)
    factors = mix(np.arange(1, coordinates + 1, dtype=np.uint64)) | np.uint64(1)
    for c in range(coordinates):
        moved = sets ^ mix(np.array([1000 + c], np.uint64))[0]
        moved *= factors[c]
        out[:, c] = np.minimum.reduceat(moved, begins) if len(begins) else 0
    return mix(out)


def root_choices(trees: int, coordinates: int, twice: int) -> list[tuple[int, int]]:
    """`(tree, coordinate)` of the first level; different trees take different coordinates while there are any."""
    chosen, at = [], 0
    for tree in range(trees):
        for _ in range(2 if int(mix(np.array([tree + 77], np.uint64))[0] & np.uint64(1023)) < twice else 1):
            chosen.append((tree, at % coordinates))
            at += 1
    return chosen


def enough_trees(part: int, whole: int) -> int:
    """Trees of whose first nodes a pair at the threshold shares at least one, but for a chance of `MISS`."""
    trees = TREES
    while (1 - whole / part) ** len(root_choices(trees, COORDINATES, branching(part, whole))) > MISS:
        trees += 1
    return trees


def child_nodes(parents: np.ndarray, sketches: np.ndarray, twice: int) -> tuple[np.ndarray, np.ndarray]:
    """Children of members of large nodes: node ids and the member's index."""
    coordinates = sketches.shape[1]
    turn = mix(parents ^ np.uint64(0x5DEECE66D))
    both = (turn & np.uint64(1023)) < twice
    first = (turn >> np.uint64(10)) % np.uint64(coordinates)
    second = (first + np.uint64(1) + (turn >> np.uint64(30)) % np.uint64(coordinates - 1)) % np.uint64(coordinates)
    nodes, members = [], []
    for choice, rows in ((first, np.arange(len(parents))), (second, np.flatnonzero(both))):
        value = sketches[rows, choice[rows].astype(np.int64)].astype(np.uint64)
        nodes.append(mix(parents[rows] ^ mix((choice[rows] << np.uint64(20)) | value)))
        members.append(rows)
    return np.concatenate(nodes), np.concatenate(members)


def class_name(doc_id: Column, key: Column) -> Column:
    """The number that names a class, from its smallest id and the key of its set."""
    return F.xxhash64(doc_id, key)


def set_keys(sets: np.ndarray, sizes: np.ndarray) -> list[bytes | None]:
    """128 bits for each set that is not empty."""
    ends = np.cumsum(sizes)
    return [hashlib.blake2b(sets[b - n:b], digest_size=16).digest() if n else None for b, n in zip(ends.tolist(), sizes.tolist())]


def sign(documents: DataFrame, shingle: int, roots: list[tuple[int, int]]) -> DataFrame:
    """Hash of the text, set size, set key, sketch and first nodes of every document."""
    text = F.col("text").cast("string")
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("said"))

    def signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                w = words(block, NOT_SPACE, lower=True)
                sets, sizes = shingle_sets(w, shingle)
                values = minwise(sets, sizes, COORDINATES)
                # Eight bits a value: values that differ seem alike now and then, and a pair too many is checked.
                sketch = values.astype(np.uint8)
                nodes = np.stack([mix(values[:, c] ^ mix(np.array([t * 1000 + c], np.uint64))[0]) for t, c in roots], axis=1).view(np.int64)
                filled, at = sizes > 0, np.cumsum(sizes > 0) - 1
                node_ends = np.concatenate([[0], np.cumsum(filled * len(roots))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(block.first_row, len(block)),
                    batch.column(2).slice(block.first_row, len(block)),
                    pa.array(sizes.astype(np.int64)),
                    pa.array(set_keys(sets, sizes), pa.binary()),
                    pa.array([sketch[i].tobytes() if f else None for i, f in zip(at, filled)], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(node_ends), pa.array(nodes.ravel())),
                ], [f.split()[0] for f in SIGNED.split(", ")])

    return texts.mapInArrow(signatures, SIGNED)


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, rows: int = 4096) -> Iterator[pa.Table]:
    """Tables of some thousand rows that hold whole groups, from batches sorted by `key`."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        for low in range(0, len(batch), rows):
            piece = batch.slice(low, rows)
            if kept and sum(map(len, kept)) >= rows:
                values = piece.column(key).to_numpy()
                held = kept[-1].column(key)[len(kept[-1]) - 1].as_py()
                same = int(np.searchsorted(values != held, True)) if (values != held).any() else len(piece)
                if same < len(piece):
                    yield pa.Table.from_batches([*kept, piece.slice(0, same)])
                    kept = [piece.slice(same)]
                    continue
            kept.append(piece)
    if kept and sum(map(len, kept)):
        yield pa.Table.from_batches(kept)


def sketch_matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def by_gaps(node: np.ndarray, sketches: np.ndarray, label: np.ndarray | None, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The likely pairs of small nodes: rows are held against the next, the one after it and so on."""
    size = np.bincount(np.unique(node, return_inverse=True)[1])
    size = np.repeat(size, size)  # rows are sorted by node
    rows = np.arange(len(node))
    for gap in range(1, int(size.max(initial=1))):
        rows = rows[(rows + gap < len(node))]
        rows = rows[(size[rows] > gap) & (node[rows] == node[np.minimum(rows + gap, len(node) - 1)])]
        if not len(rows):
            break
        some = rows if label is None else rows[label[rows] != label[rows + gap]]
        # A look at a quarter of the coordinates rules out most pairs.
        quick = (sketches[some, :32] == sketches[some + gap, :32]).sum(axis=1)
        some = some[quick >= least * 32 // sketches.shape[1] - 8]
        agree = (sketches[some] == sketches[some + gap]).sum(axis=1)
        some, agree = some[agree >= least], agree[agree >= least]
        if len(some):
            yield some, some + gap, agree


def across(sketches: np.ndarray, label: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows in the order of a band of coordinates and their label, and for each where the other labels of its band begin and how many rows these have."""
    n, key = len(sketches), np.zeros(len(sketches), np.uint64)
    for c in range(low, high):
        key = (key << np.uint64(8) if high - low <= 8 else mix(key)) ^ sketches[:, c]
    order = np.lexsort((label, key))
    key, own = key[order], label[order]
    run = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (own[1:] != own[:-1])])
    begins = np.repeat(np.r_[run[1:], n], np.diff(np.r_[run, n]))
    return order, begins, np.searchsorted(key, key, "right") - begins


def by_bands(sketches: np.ndarray, label: np.ndarray | None, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The likely pairs of one node of many rows.

    Two sketches that agree at `least` coordinates differ at too few to differ in each of the bands, so rows are held against those that
    share a band and have another label. A pair is told by the first band it shares. Where most share many bands, all rows are one band.
    """
    n, coordinates = sketches.shape
    number = coordinates - least + 1
    label = np.arange(n) if label is None else np.unique(label, return_inverse=True)[1]
    edges = np.linspace(0, coordinates, number + 1).astype(np.int64)
    bands = list(zip(edges[:-1].tolist(), edges[1:].tolist()))
    if sum(int(across(sketches, label, *band)[2].sum()) for band in bands) > int(across(sketches, label, 0, 0)[2].sum()):
        bands = [(0, 0)]
    for band, (low, high) in enumerate(bands):
        order, begins, left = across(sketches, label, low, high)
        row, at, total = 0, 0, np.cumsum(left)
        while row < n:
            # Some rows with all of their pairs, or a share of the pairs of one row.
            to = int(np.searchsorted(total, (total[row - 1] if row else 0) + PAIRS, "right")) if not at else row
            if to > row:
                a, b = np.repeat(np.arange(row, to), left[row:to]), ranges(begins[row:to], left[row:to])
                row = to
            else:
                b = np.arange(begins[row] + at, begins[row] + min(at + PAIRS, left[row]))
                a, at = np.full(len(b), row), at + len(b)
                if at >= left[row]:
                    row, at = row + 1, 0
            a, b = order[a], order[b]
            quick = (sketches[a, :32] == sketches[b, :32]).sum(axis=1)
            some = quick >= least * 32 // coordinates - 8
            a, b = a[some], b[some]
            same = sketches[a] == sketches[b]
            agree = same.sum(axis=1)
            some = agree >= least
            a, b, same, agree = a[some], b[some], same[some], agree[some]
            if band and len(a):
                fresh = ~np.logical_and.reduceat(same[:, :low], edges[:band], axis=1).any(axis=1)
                a, b, agree = a[fresh], b[fresh], agree[fresh]
            if len(a):
                yield np.minimum(a, b), np.maximum(a, b), agree


def likely_chunks(node: np.ndarray, sketches: np.ndarray, label: np.ndarray | None, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of rows of one node whose sketches agree at `least` coordinates, in parts; with labels, only across labels. Rows are sorted by node."""
    starts = np.flatnonzero(np.r_[True, node[1:] != node[:-1]]) if len(node) else np.empty(0, np.int64)
    sizes = np.diff(np.r_[starts, len(node)])
    # Nodes between two wide ones are taken together.
    cuts = np.unique(np.concatenate([[0, len(node)], *([s, s + n] for s, n in zip(starts.tolist(), sizes.tolist()) if n > BANDED)])).astype(np.int64)
    for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        wide = node[low] == node[high - 1] and high - low > BANDED
        own = None if label is None else label[low:high]
        for a, b, agree in by_bands(sketches[low:high], own, least) if wide else by_gaps(node[low:high], sketches[low:high], own, least):
            yield a + low, b + low, agree


def together(parts: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)), *parts]
    return tuple(np.concatenate(c) for c in zip(*found))


def likely_pairs(node: np.ndarray, sketches: np.ndarray, label: np.ndarray | None, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All parts of `likely_chunks`."""
    return together(likely_chunks(node, sketches, label, least))


def merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after joining the pairs: the least label of each component."""
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, before[a], low)
        np.minimum.at(label, before[b], low)
        label = label[label]
        label = label[label]
        if np.array_equal(before, label):
            return label


def spanning_forest(n: int, a: np.ndarray, b: np.ndarray, agree: np.ndarray) -> np.ndarray:
    """Indexes of pairs that form a forest of the best pairs (every component takes its best pair, and so on)."""
    order = np.argsort(-agree, kind="stable")
    label, kept = np.arange(n), []
    while len(order):
        la, lb = label[a[order]], label[b[order]]
        apart = la != lb
        order, la, lb = order[apart], la[apart], lb[apart]
        if not len(order):
            break
        ends = np.stack([la, lb], axis=1).ravel()
        _, first = np.unique(ends, return_index=True)
        best = np.unique(order[first // 2])
        kept.append(best)
        label = merge(label, a[best], b[best])
    return np.unique(np.concatenate(kept)) if kept else np.empty(0, np.int64)


def best_of_each(n: int, a: np.ndarray, b: np.ndarray, agree: np.ndarray, most: int) -> np.ndarray:
    """Indexes of pairs among the `most` best of one of their rows."""
    index = np.tile(np.arange(len(a)), 2)
    row = np.concatenate([a, b])
    order = np.lexsort((-agree[index], row))
    row = row[order]
    place = np.arange(len(row)) - np.searchsorted(row, row, "left")
    return np.unique(index[order][place < most])


def weighed_here(node: np.ndarray, roots: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs belong to the node they are found in: its first common node of the first level, any if there is none."""
    own = (node[a] & ROOT_BITS).astype(roots.dtype)
    common = (roots[a] == roots[b]) & (roots[a] != 0)
    first = roots[a, common.argmax(axis=1)]
    is_root = (roots[a] == own[:, None]).any(axis=1)
    return np.where(is_root, first == own, ~common.any(axis=1))


def node_chunks(table: pa.Table, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The likely pairs across labels of whole nodes that belong to them, in parts: row numbers and agreeing coordinates."""
    node = table.column("node").to_numpy()
    roots = table.column("roots").combine_chunks().flatten().to_numpy().reshape(len(node), -1)
    for a, b, agree in likely_chunks(node, sketch_matrix(table.column("sketch")), table.column("label").to_numpy(), least):
        here = weighed_here(node, roots, a, b)
        yield a[here], b[here], agree[here]


def chosen_pairs(parts: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], choose: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs that `choose` keeps of all, and which of the `n` rows have others: what it drops of some pairs it drops of all of them."""
    kept, waiting, more = together(iter(())), [], np.zeros(n, bool)

    def settle() -> None:
        nonlocal kept
        kept = together([kept, *waiting])
        waiting.clear()
        chosen = choose(*kept)
        dropped = np.ones(len(kept[0]), bool)
        dropped[chosen] = False
        more[kept[0][dropped]] = more[kept[1][dropped]] = True
        kept = tuple(c[chosen] for c in kept)

    for part in parts:
        waiting.append(part)
        if sum(len(a) for a, _, _ in waiting) >= max(PAIRS, len(kept[0])):
            settle()
    settle()
    return kept[0], kept[1], np.flatnonzero(more)


def propose(members: DataFrame, least: int, how: str) -> DataFrame:
    """Pairs to check (`a`, `b`) from members (`node`, `rep`, `sketch`, `roots`, `label`) of nodes.

    All pairs are across labels. `forest`: a spanning forest of the labels; `best`: the best few of each class; `all`: all.
    A row without `b` says that the class `a` has more pairs in the node.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "node"):
            node, rep, n = table.column("node").to_numpy(), table.column("rep").to_numpy(), len(table)
            if how == "forest":
                # Nodes have labels of their own here: a label in two nodes is linked in each.
                of_node = np.unique(np.stack([node, table.column("label").to_numpy()], axis=1), axis=0, return_inverse=True)[1].ravel()
                found = [chosen_pairs(node_chunks(table, least), lambda a, b, agree: spanning_forest(n, of_node[a], of_node[b], agree), n)]
            elif how == "best":
                found = [chosen_pairs(node_chunks(table, least), lambda a, b, agree: best_of_each(n, a, b, agree, BEST), n)]
            else:
                found = ((a, b, np.empty(0, np.int64)) for a, b, _ in node_chunks(table, least))
            for a, b, more in found:
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate([node[a], node[more]])),
                    pa.array(np.concatenate([np.minimum(rep[a], rep[b]), rep[more]])),
                    pa.array([*np.maximum(rep[a], rep[b]).tolist(), *[None] * len(more)], pa.int64()),
                ], ["node", "a", "b"])
            release()

    return members.repartition("node").sortWithinPartitions("node").mapInArrow(compare, "node long, a long, b long")


def linked(p: np.ndarray, q: np.ndarray, part: int = PART, whole: int = WHOLE) -> bool:
    """Whether two sorted sets reach the threshold."""
    if whole * max(len(p), len(q)) > part * min(len(p), len(q)):
        return False
    both = np.concatenate([p, q])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return part * common >= whole * (len(p) + len(q) - common)


def confirm_inside(members: DataFrame, least: int, part: int, whole: int) -> DataFrame:
    """The links (`a`, `b`) across labels in nodes whose members bring their full sets in `hashes`."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "node", rows=512):
            rep = table.column("rep").to_numpy()
            sets = [np.frombuffer(v, np.uint64) for v in table.column("hashes").to_pylist()]
            for a, b, _ in node_chunks(table, least):
                true = np.array([linked(sets[i], sets[j], part, whole) for i, j in zip(a.tolist(), b.tolist())], bool)
                a, b = a[true], b[true]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(rep[a], rep[b])), pa.array(np.maximum(rep[a], rep[b]))], ["a", "b"])

    return members.repartition("node").sortWithinPartitions("node").mapInArrow(check, "a long, b long")


def sets_of(documents: DataFrame, ids: DataFrame, shingle: int) -> DataFrame:
    """`id` (the name of the class that a document's id and set would give) and the full set of at least the wanted documents.

    The texts are scanned where they lie: a bitmap of fixed size over hashed ids tells which sets to make. When
    it fills up it lets more rows through, never fewer than needed.
    """
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS)) + 1
    marked = ids.select(slot(F.col("id")).alias("slot")).groupBy(F.expr("bitmap_bucket_number(slot)").alias("bucket"))
    marked = marked.agg(F.expr("bitmap_construct_agg(bitmap_bit_position(slot))").alias("bits")).collect()
    # A bucket holds 32,768 slots from slot 1 on, and there are FILTER_BITS / 32768 of them.
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in marked:
        bits[(r.bucket - 1) * 4096: r.bucket * 4096] = np.frombuffer(bytes(r.bits), np.uint8)
    shared = documents.sparkSession.sparkContext.broadcast(np.unpackbits(bits, bitorder="little").astype(bool))
    texts = documents.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"), slot(F.col("doc_id").cast("long")).alias("slot"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = shared.value[batch.column("slot").to_numpy() - 1]
            some = batch.filter(pa.array(wanted))
            for block in blocks(some.column("text")):
                sets, sizes = shingle_sets(words(block, NOT_SPACE, lower=True), shingle)
                keys, ends = set_keys(sets, sizes), np.cumsum(sizes).tolist()
                held = [sets[e - n:e].tobytes() for e, n in zip(ends, sizes.tolist())]
                own = some.column("id").slice(block.first_row, len(block))
                yield pa.RecordBatch.from_arrays([own, pa.array(keys, pa.binary()), pa.array(held, pa.binary())], ["id", "key", "hashes"])

    made = texts.where("id IS NOT NULL").mapInArrow(make, "id long, key binary, hashes binary")
    return made.where("key IS NOT NULL").select(class_name(F.col("id"), F.col("key")).alias("id"), "hashes")


def confirm(pairs: DataFrame, sets: DataFrame, part: int, whole: int) -> DataFrame:
    """The pairs that reach the threshold on full sets."""
    left = pairs.join(sets.select(F.col("id").alias("a"), F.col("hashes").alias("x")), "a")
    both = left.join(sets.select(F.col("id").alias("b"), F.col("hashes").alias("y")), "b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs_of = zip(batch.column("x"), batch.column("y"))
            true = [linked(*(np.frombuffer(v.as_buffer(), np.uint64) for v in pair), part, whole) for pair in pairs_of]
            yield batch.select(["a", "b"]).filter(pa.array(true, pa.bool_()))

    return both.select("a", "b", "x", "y").mapInArrow(check, "a long, b long")


def in_slices(first: DataFrame, limit: int, node_bytes: int) -> DataFrame:
    """Members (`node`, `rep`, `sketch`) of large nodes, with the members `n` of their node and the `slices` it is dealt out in."""
    sizes = first.groupBy("node").agg(F.count("*").alias("n"), F.sum(8 * F.col("n_shingles")).alias("bytes")).where(F.col("n") > limit)
    slices = F.greatest(F.ceil(F.col("n") / limit), F.ceil(8 * F.col("bytes") / node_bytes)).cast("int")
    large = materialise(sizes.select("node", "n", slices.alias("slices")), "large")
    return materialise(first.drop("n_shingles").join(large, "node"), "in_large")


def link_to_pivots(members: DataFrame, sets: DataFrame, least: int, part: int, whole: int) -> DataFrame:
    """Links (`a`, `b`) of members of large nodes (as `in_slices` has them) with some of their node, enough to join what they join.

    A node is dealt out in slices of bounded size, and its pivots go to each of them. Of what a slice joins, all hang on the least.
    """
    known = members.withColumn("slice", F.pmod(F.xxhash64("rep"), F.col("slices")).cast("int"))
    # The same classes are pivots of nodes of like size.
    chance = F.pmod(F.xxhash64("rep", F.lit("pivot")), F.lit(1 << 40)) / (1 << 40)
    pivots = known.where(chance < PIVOTS / F.col("n")).withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    both = known.withColumn("label", F.lit(0)).unionByName(pivots.withColumn("label", F.lit(1)))
    both = both.select(F.xxhash64("node", "slice").alias("node"), "rep", "sketch", "label").join(sets.withColumnRenamed("id", "rep"), "rep")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "node", rows=512):
            rep = table.column("rep").to_numpy()
            a, b, agree = likely_pairs(table.column("node").to_numpy(), sketch_matrix(table.column("sketch")), table.column("label").to_numpy(), least)
            sets = [np.frombuffer(v, np.uint64) for v in table.column("hashes").to_pylist()]
            heads: dict[int, int] = {}

            def top(x: int) -> int:
                while (up := heads.get(x, x)) != x:
                    heads[x] = x = heads.get(up, up)
                return x

            for k in np.argsort(-agree, kind="stable").tolist():
                i, j = int(a[k]), int(b[k])
                x, y = top(int(rep[i])), top(int(rep[j]))
                if x != y and linked(sets[i], sets[j], part, whole):
                    heads[max(x, y)] = min(x, y)
            links = [(top(x), x) for x in heads]
            low, high = zip(*links) if links else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(low, pa.int64()), pa.array(high, pa.int64())], ["a", "b"])

    return both.repartition("node").sortWithinPartitions("node").mapInArrow(check, "a long, b long").distinct()


def branch(members: DataFrame, classes: DataFrame, twice: int) -> DataFrame:
    """The next level: children (`node`, `rep`, `label`) of the members of large nodes."""

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                sketches = sketch_matrix(batch.column("sketch"))
                nodes, member = child_nodes(batch.column("node").to_numpy().view(np.uint64), sketches, twice)
                same = [batch.column(c).take(pa.array(member)) for c in ("rep", "label")]
                yield pa.RecordBatch.from_arrays([pa.array(nodes.view(np.int64)), *same], ["node", "rep", "label"])

    known = members.select("node", "rep").join(classes.select("rep", "label", "sketch"), "rep").select("node", "rep", "label", "sketch")
    return known.mapInArrow(grow, "node long, rep long, label long")


def plant(wanted: DataFrame, classes: DataFrame, twice: int, turn: int) -> DataFrame:
    """The first nodes (`node`, `rep`, `label`) in further trees: `more` of them for each class; another `turn` has other trees."""

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                sketches, more = sketch_matrix(batch.column("sketch")), batch.column("more").to_numpy()
                for tree in range(int(more.max())):
                    some = np.flatnonzero(more > tree)
                    root = mix(np.array([(turn << 32) + tree], np.uint64))
                    nodes, member = child_nodes(np.repeat(root, len(some)), sketches[some], twice)
                    same = [batch.column(c).take(pa.array(some[member])) for c in ("rep", "label")]
                    yield pa.RecordBatch.from_arrays([pa.array(nodes.view(np.int64)), *same], ["node", "rep", "label"])

    known = wanted.select("rep", "more").join(classes.select("rep", "label", "sketch"), "rep").select("rep", "label", "sketch", "more")
    return known.mapInArrow(grow, "node long, rep long, label long")


def block_pairs(members: DataFrame, limit: int) -> DataFrame:
    """Members of nodes that stay large, as bounded nodes: every block of a node with every other."""
    half = max(1, limit // 4)
    cut = members.withColumn("blocks", F.ceil(F.col("n") / half).cast("int"))
    cut = cut.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    met = cut.select("node", "rep", "block", other)
    return met.select(F.xxhash64("node", F.least("block", "other"), F.greatest("block", "other")).alias("node"), "rep")


def label_blocks(members: DataFrame, limit: int) -> DataFrame:
    """Members of large nodes of one `main` label, as bounded nodes: each block of its members with all members of other labels."""
    cut = members.withColumn("blocks", F.ceil((F.col("n") - F.col("others")) / max(1, limit // 2)).cast("int"))
    own = F.array(F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    met = cut.withColumn("block", F.explode(F.when(F.col("label") == F.col("main"), own).otherwise(every)))
    return met.select(F.xxhash64("node", "block").alias("node"), "rep", F.lit(None).cast("int").alias("place"))


def shared_levels(part: int, whole: int, depth: int) -> list[float]:
    """For each level the chance that a pair at the threshold still shares a node of one tree there."""
    share, twice = whole / part, branching(part, whole) / 1024
    apart, out = 0.0, []
    for _ in range(depth + 1):
        once = 1 - share + share * apart
        apart = (1 - twice) * once + twice * once * once
        out.append(1 - apart)
    return out


def trees_by_depth(part: int, whole: int, depth: int, trees: int) -> list[int]:
    """For each level the trees that leave a pair apart in all of them with a chance of at most `MISS`; no fewer than `trees`."""
    return [max(trees, math.ceil(math.log(MISS) / math.log1p(-shared))) if shared < 1 else trees for shared in shared_levels(part, whole, depth)]


def grow_levels(level: DataFrame, classes: DataFrame, limit: int, wide: int, depth: int, twice: int) -> tuple[DataFrame, DataFrame | None]:
    """Members (`node`, `rep`, `place`) of all nodes that are compared, and the level (`rep`, `level`) that members of nodes of more than `wide` branch to."""
    done, deep = [], []
    for at in range(depth + 1):
        # A node of one label has nothing left to find. Members meet their node's size once, and those of large nodes its labels.
        sizes = level.groupBy("node").agg(F.count("*").alias("n"), (F.min("label") < F.max("label")).alias("several")).where("several").drop("several")
        sized = materialise(level.join(sizes, "node"), "sized")
        done.append(sized.where(F.col("n") <= limit).select("node", "rep", "place"))
        members = sized.where(F.col("n") > limit)
        mains = members.groupBy("node", "label").agg(F.count("*").alias("of_label"), F.first("n").alias("n"))
        mains = mains.groupBy("node").agg(F.max(F.struct("of_label", "label")).alias("main"), F.first("n").alias("n"))
        others = F.col("n") - F.col("main.of_label")
        kind = F.when(others <= limit // 2, "tight").when(F.col("n") <= wide, "whole").otherwise("branch")
        mains = materialise(mains.select("node", F.col("main.label").alias("main"), others.alias("others"), kind.alias("kind")), "mains")
        kinds = {r.kind for r in mains.select("kind").distinct().collect()}
        if not kinds:
            break
        if kinds != {"branch"}:
            members = materialise(members.join(mains, "node"), "in_large")
        if "tight" in kinds:
            done.append(label_blocks(members.where("kind = 'tight'"), limit))
        if "whole" in kinds:
            done.append(members.where("kind = 'whole'").select("node", "rep", "place"))
        if "branch" not in kinds:
            break
        if kinds != {"branch"}:
            members = members.where("kind = 'branch'")
        deep.append(members.select("rep").distinct().withColumn("level", F.lit(min(at + 1, depth))))
        level = block_pairs(members, limit) if at == depth else branch(members, classes, twice)
        level = materialise(level.withColumn("place", F.lit(None).cast("int")), "level")
    else:
        done.append(level.select("node", "rep", "place"))
    return reduce(DataFrame.unionByName, done), reduce(DataFrame.unionByName, deep) if deep else None


def small_nodes(classes: DataFrame, limit: int, wide: int, depth: int, part: int, whole: int, trees: int) -> DataFrame:
    """Members (`node`, `rep`) of all nodes that are compared, with `place` among the first choices or null.

    Two classes share as many trees as the lesser of their depths asks for. A round of further trees is for all classes
    that want more than the least that a class had before it was raised. All of these share that many already, so each takes
    the trees beyond it, and any two of them meet in those that both want.
    """
    twice, enough = branching(part, whole), trees_by_depth(part, whole, depth, trees)
    out, deep = grow_levels(classes.select("rep", "label", F.posexplode("nodes").alias("place", "node")), classes, limit, wide, depth, twice)
    had, turn = None, 0
    while deep is not None:
        deepest = deep.groupBy("rep").agg(F.max("level").alias("level"))
        wanted = deepest.select("rep", "level", F.array(*[F.lit(n) for n in enough])[F.col("level")].alias("need"))
        wanted = wanted.withColumn("had", F.lit(trees)) if had is None else wanted.join(had, "rep", "left").fillna(trees, ["had"])
        wanted = materialise(wanted, "wanted")
        least = wanted.where("need > had").agg(F.min("had")).first()[0]
        if least is None:
            break
        turn += 1
        # Trees cost a row each, so no more are taken than the depth that is reached asks for.
        has = F.greatest("need", "had")
        level = plant(wanted.where(has > least).select("rep", (has - least).alias("more")), classes, twice, turn)
        level = materialise(level.withColumn("place", F.lit(None).cast("int")), "level")
        found, deeper = grow_levels(level, classes, limit, wide, depth, twice)
        out = out.unionByName(found)
        had = wanted.select("rep", has.alias("had"))
        if deeper is None:
            break
        deep = wanted.select("rep", "level").unionByName(deeper)
    return out


def first_level(members: DataFrame, choices: int) -> DataFrame:
    """`rep` and `roots`: the compared nodes of the first level that it is in, by place, cut to 31 bits; 0 where there is none."""
    placed = members.where("place IS NOT NULL").groupBy("rep").agg(
        F.map_from_entries(F.collect_list(F.struct("place", F.col("node").bitwiseAND(ROOT_BITS).cast("int").alias("node")))).alias("at")
    )
    every = F.sequence(F.lit(0), F.lit(choices - 1))
    return placed.select("rep", F.transform(every, lambda j: F.coalesce(F.col("at")[j], F.lit(0))).alias("roots"))


def open_members(proposed: DataFrame, known: DataFrame, labels: DataFrame) -> DataFrame:
    """Members with pairs that were not proposed yet, with the label of their component."""
    more = proposed.where("b IS NULL").select("node", F.col("a").alias("rep")).distinct()
    found = more.join(known, "rep").join(labels, F.col("rep") == F.col("id"), "left")
    return materialise(found.select("node", "rep", "sketch", "roots", F.coalesce("component", "rep").alias("label")), "left")


def judged(
    documents: DataFrame, shingle: int = SHINGLE, trees: int | None = None, node_limit: int = NODE_LIMIT, depth: int = DEPTH, node_bytes: int = NODE_BYTES,
    part: int = PART, whole: int = WHOLE, wide_limit: int | None = None,
) -> DataFrame:
    """`doc_id`, `said` (a hash of the text), `n_shingles`, `component_id` and `kept` of every document.

    Nodes of more than `wide_limit` members branch: `WIDE_LIMIT`, or `node_limit` where that is set below its default.
    """
    wide = wide_limit or (WIDE_LIMIT if node_limit >= NODE_LIMIT else node_limit)
    least, trees = least_agreement(part, whole), trees or enough_trees(part, whole)
    roots = root_choices(trees, COORDINATES, branching(part, whole))
    signed = materialise(sign(documents, shingle, roots), "signatures")
    classes = signed.where("key IS NOT NULL AND doc_id IS NOT NULL").groupBy("key").agg(F.min(F.struct("doc_id", "sketch", "nodes", "n_shingles")).alias("m"))
    classes = classes.select("key", class_name(F.col("m.doc_id"), F.col("key")).alias("rep"), "m.doc_id", "m.sketch", "m.nodes", "m.n_shingles")
    classes = materialise(classes, "classes")
    labels = None
    first = classes.select("rep", "sketch", "n_shingles", F.posexplode("nodes").alias("place", "node")).where(F.col("place") < PIVOT_PLACES).drop("place")
    large = in_slices(first, node_limit, node_bytes)
    if not large.isEmpty():
        sets = materialise(sets_of(documents, classes.select("rep", F.col("doc_id").alias("id")).join(large.select("rep").distinct(), "rep", "left_semi"), shingle), "sets")
        labels = joined(None, link_to_pivots(large, sets, least, part, whole))
        classes = classes.join(labels, F.col("rep") == F.col("id"), "left").withColumn("label", F.coalesce("component", "rep")).drop("id", "component")
        classes = materialise(classes, "classes")
    else:
        classes = classes.withColumn("label", F.col("rep"))
    placed = materialise(small_nodes(classes, node_limit, wide, depth, part, whole, trees), "placed")
    choices = len(roots)
    nowhere = F.array_repeat(F.lit(0), choices)
    known = classes.select("rep", "label", "sketch").join(first_level(placed, choices), "rep", "left")
    known = materialise(known.withColumn("roots", F.coalesce("roots", nowhere)), "known")
    members = placed.select("node", "rep").join(known, "rep")

    # First a forest of every node, then the best pairs of what is still apart, at last all the rest.
    proposed = materialise(propose(members, least, "forest"), "proposed")
    pairs = proposed.where("b IS NOT NULL").select("a", "b").distinct()
    if not pairs.isEmpty():
        wanted = proposed.select(F.explode(F.array("a", "b")).alias("rep")).where("rep IS NOT NULL").distinct()
        sets = sets_of(documents, classes.select("rep", F.col("doc_id").alias("id")).join(wanted, "rep", "left_semi"), shingle)
        sets = materialise(sets, "sets")
        labels = joined(labels, confirm(pairs, sets, part, whole))
        left = open_members(proposed, known, labels)
        if not left.isEmpty():
            proposed = materialise(propose(left, least, "best"), "proposed")
            pairs = proposed.where("b IS NOT NULL").select("a", "b").distinct()
            labels = joined(labels, confirm(pairs, sets, part, whole))
            left = open_members(proposed, known, labels)
        if not left.isEmpty():
            rest = left.join(sets.withColumnRenamed("id", "rep"), "rep")
            heavy = rest.groupBy("node").agg(F.sum(F.octet_length("hashes")).alias("bytes")).where(F.col("bytes") > node_bytes).select("node")
            heavy = materialise(heavy, "heavy")
            inside = confirm_inside(rest.join(heavy, "node", "left_anti"), least, part, whole)
            written = propose(left.join(heavy, "node", "left_semi"), least, "all").where("b IS NOT NULL").select("a", "b").distinct()
            labels = joined(labels, inside.unionByName(confirm(written, sets, part, whole)))
    of_class = classes.select("key", "rep", F.col("doc_id").alias("first"))
    if labels is not None:
        inside = of_class.join(labels, F.col("rep") == F.col("id"))
        leasts = inside.groupBy("component").agg(F.min("first").alias("component_id"))
        named = labels.join(leasts, "component").select("id", "component_id")
        of_class = of_class.join(named, F.col("rep") == F.col("id"), "left").select("key", F.coalesce("component_id", "first").alias("component"))
    else:
        of_class = of_class.select("key", F.col("first").alias("component"))
    rows = signed.select("doc_id", "said", "n_shingles", "key").join(of_class, "key", "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component", "doc_id"))
    return rows.select("doc_id", "said", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def near_copies(documents: DataFrame, **settings: int) -> DataFrame:
    """`doc_id`, `n_shingles`, `component_id` and `kept` of every document; `settings` as for `judged`."""
    return judged(documents, **settings).drop("said")


def remove_near_copies(documents: DataFrame, **settings: int) -> DataFrame:
    """One document of each group, the one of the smallest id; all columns kept."""
    gone = judged(documents, **settings).where("NOT kept").select(F.col("doc_id").alias("__gone"), F.col("said").alias("__said"))
    # A text that shares its id with a copy of something else stays.
    same = (documents["doc_id"].cast("long") == F.col("__gone")) & (F.xxhash64(documents["text"].cast("string")) == F.col("__said"))
    return documents.join(gone, same, "left_anti")


def q_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(spark.read.parquet(f"{sf_dir}/documents.parquet"))
