"""Approximate nearest neighbours by a hierarchical k-means tree, searched best bin first.

The tree is fitted on a bounded sample (`SAMPLE` vectors; documented, chosen by a hash of the id): each node's vectors are
split by k-means into `BRANCHES` children until a leaf has few. Every vector of the table is then put into a leaf. A query walks the
tree with a priority queue over the distance to node centres: the nearest open node is opened first, and leaves come out in the order
in which they are to be visited. How many leaves are visited is calibrated: a bounded set of queries is compared with exact answers over
all rows, and visits widen until the mean recall reaches `RECALL`; if no number does, all leaves are visited. A query goes on past these
visits until its leaves hold k rows besides those of its own id, so it gets k neighbours wherever there are so many.

Leaves meet the queries that visit them as groups of bounded size: a leaf of many rows is salted by its measured count, its
queries are repeated for each salt, and queries beyond a block's size go to further groups. Distances are exact, in double precision
and on the original vectors; each group hands on k rows per query, and the best are merged by query and salt, then by query.

Edge cases: vectors that are null, zero, of another width than most, or hold null or not finite components take no part, as
queries or candidates; a query with fewer candidates than k gets them all; ties go to the smaller id; repeated ids
are rows of their own, but never neighbours of a query with that id; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from docketry.session import materialise

NEIGHBOURS = 10
QUERY_STEP = 100
SAMPLE = 20_000
BRANCHES = 8
LEAF = 64
STEPS = 12
CALIBRATION = 200
RECALL = 0.97
GROUP_ROWS = 20_000
QUERY_BLOCK = 2_000

FOUND = "query_id long, vec_id long, score double"


def kmeans(points: np.ndarray, k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Centres and assignment by Lloyd's steps from distinct starting points."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(points, axis=0)
    centres = distinct[rng.choice(len(distinct), min(k, len(distinct)), replace=False)]
    for _ in range(STEPS):
        near = nearest(points, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        counts = np.bincount(near, minlength=len(centres))[:, None]
        centres = np.where(counts > 0, sums / np.maximum(counts, 1), centres)
    return centres, nearest(points, centres)


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin(np.square(centres).sum(axis=1) - 2 * points @ centres.T, axis=1)


def grow_tree(points: np.ndarray, branches: int = BRANCHES, leaf: int = LEAF) -> dict[str, np.ndarray]:
    """A tree as arrays: for each node its centre, its first child (-1 for a leaf), the number of children, its leaf number."""
    centre, child, width, number, leaves = [points.mean(axis=0)], [-1], [0], [-1], 0
    todo = [(0, points)]
    while todo:
        node, own = todo.pop()
        centres, near = kmeans(own, branches, node) if len(own) > leaf else (np.empty((0, 0)), None)
        if len(centres) < 2:
            number[node], leaves = leaves, leaves + 1
            continue
        child[node], width[node] = len(centre), len(centres)
        for i, c in enumerate(centres):
            todo.append((len(centre), own[near == i]))
            centre.append(c)
            child.append(-1)
            width.append(0)
            number.append(-1)
    return {"centre": np.array(centre), "child": np.array(child), "width": np.array(width), "leaf": np.array(number)}


def leaf_of(tree: dict[str, np.ndarray], points: np.ndarray) -> np.ndarray:
    """The leaf of each vector: the nearest child at every level."""
    at = np.zeros(len(points), np.int64)
    while True:
        inner = np.flatnonzero(tree["child"][at] >= 0)
        if not len(inner):
            return tree["leaf"][at]
        for node in np.unique(at[inner]):
            own = inner[at[inner] == node]
            first = tree["child"][node]
            at[own] = first + nearest(points[own], tree["centre"][first:first + tree["width"][node]])


def best_bins(tree: dict[str, np.ndarray], query: np.ndarray, visits: int, rows: np.ndarray | None = None, least: int = 0) -> list[int]:
    """Leaves in the order of visiting: the open node nearest to the query goes on first.

    With `rows`, the number of rows of each leaf, visits go on until the leaves hold `least` rows.
    """
    queue, out, held = [(0.0, 0)], [], 0
    while queue and (len(out) < visits or (rows is not None and held < least)):
        _, node = heapq.heappop(queue)
        first = tree["child"][node]
        if first < 0:
            out.append(int(tree["leaf"][node]))
            held += int(rows[out[-1]]) if rows is not None else 0
            continue
        gaps = tree["centre"][first:first + tree["width"][node]] - query
        for i, d in enumerate(np.einsum("ij,ij->i", gaps, gaps).tolist()):
            heapq.heappush(queue, (d, int(first + i)))
    return out


def usable_vectors(table: DataFrame, vector: str) -> DataFrame:
    """`vec_id` and `vector` (doubles) of the rows that take part."""
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    fit = F.expr("forall(vector, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) <> double('Infinity')) AND exists(vector, x -> x <> 0)")
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & fit)
    widths = rows.groupBy(F.size("vector").alias("w")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "w").limit(1).collect()
    return rows.where(F.size("vector") == (widths[0].w if widths else 0))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().reshape(len(column), -1) if len(column) else np.empty((0, 0))


def top_rows(qids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The `k` nearest rows of each query among `vectors`: query ids, ids, distances."""
    out = []
    norms = np.einsum("ij,ij->i", vectors, vectors)
    for low in range(0, len(qids), 256):
        some = queries[low:low + 256]
        rough = np.maximum(norms - 2 * some @ vectors.T + np.einsum("ij,ij->i", some, some)[:, None], 0)
        for qid, query, row in zip(qids[low:low + 256], some, rough):
            own = np.flatnonzero(ids != qid)
            if len(own) > k:
                # The rough distance is off by rounding only: all rows that may be among the k nearest are measured again.
                edge = np.partition(row[own], k - 1)[k - 1]
                own = own[row[own] <= edge + 1e-9 * (edge + norms.max() + 1)]
            gaps = vectors[own] - query
            exact = np.sqrt(np.einsum("ij,ij->i", gaps, gaps))
            best = np.lexsort((ids[own], exact))[:k]
            out.append((np.full(len(best), qid), ids[own][best], exact[best]))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))


def found_batch(found: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()), pa.array(found[2], pa.float64())], ["query_id", "vec_id", "score"])


def merged(found: DataFrame, k: int, salts: int = 16) -> DataFrame:
    """The `k` best rows of each query, by query and salt first."""
    nearest_first = [F.col("score"), F.col("vec_id")]
    first = Window.partitionBy("query_id", F.pmod(F.xxhash64("vec_id"), F.lit(salts))).orderBy(*nearest_first)
    second = Window.partitionBy("query_id").orderBy(*nearest_first)
    some = found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)
    return some.withColumn("rank", F.row_number().over(second)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def exact_search(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Exact neighbours of a bounded query set: it travels with the tasks, the table is scanned."""
    held = queries.select("vec_id", "vector").collect()
    qids, points = np.array([r.vec_id for r in held], np.int64), np.array([r.vector for r in held], float)
    shared = vectors.sparkSession.sparkContext.broadcast((qids, points))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                yield found_batch(top_rows(*shared.value, batch.column("vec_id").to_numpy(), matrix(batch.column("vector")), k))

    return merged(vectors.mapInArrow(scan, FOUND), k) if len(held) else vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")


class Index:
    """A fitted tree, all vectors with their leaf, and the number of rows of each leaf."""

    def __init__(self, tree: dict[str, np.ndarray], leaves: DataFrame, sizes: DataFrame):
        self.tree, self.leaves, self.sizes = tree, leaves, sizes
        self.n_leaves = int((tree["leaf"] >= 0).sum())


def build(table: DataFrame, vector: str = "embedding", sample: int = SAMPLE) -> Index | None:
    """The index of all usable vectors; None if there are none."""
    spark = table.sparkSession
    vectors = usable_vectors(table, vector)
    total = vectors.count()
    if not total:
        return None
    share = min(1.0, sample / total)
    chosen = vectors.where(F.pmod(F.xxhash64(F.lit("sample"), "vec_id"), F.lit(1 << 30)) < max(1, int(share * (1 << 30))))
    chosen = chosen.orderBy(F.xxhash64("vec_id"), "vec_id").limit(2 * sample).collect()
    points = np.array([r.vector for r in chosen] or [vectors.first().vector], float)
    tree = grow_tree(points)
    shared = spark.sparkContext.broadcast(tree)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                yield batch.append_column("leaf", pa.array(leaf_of(shared.value, matrix(batch.column("vector"))).astype(np.int64)))

    leaves = materialise(vectors.mapInArrow(assign, "vec_id long, vector array<double>, leaf long"), "leaves")
    return Index(tree, leaves, leaves.groupBy("leaf").agg(F.count("*").alias("n")))


def visited(index: Index, queries: DataFrame, visits: int, k: int = 0) -> DataFrame:
    """`query_id`, `vector`, `leaf`, `turn` of the leaves that each query visits, which hold `k` rows of other ids if there are so many."""
    rows = np.zeros(index.n_leaves, np.int64)
    for r in index.sizes.collect():
        rows[r.leaf] = r.n
    shared = index.leaves.sparkSession.sparkContext.broadcast((index.tree, rows))
    # Rows of the query's own id are no neighbours; an id may be repeated.
    asked = queries.select("vec_id", "vector")
    own = index.leaves.join(queries.select("vec_id").distinct(), "vec_id", "left_semi").groupBy("vec_id").agg(F.count("*").alias("own"))
    asked = asked.join(own, "vec_id", "left").select("vec_id", "vector", (F.coalesce("own", F.lit(0)) + k).alias("least"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, len(batch), 100):
                some = batch.slice(low, 100)
                tree, held = shared.value
                bins = [best_bins(tree, q, visits, held, n) for q, n in zip(matrix(some.column("vector")), some.column("least").to_pylist())]
                row = np.repeat(np.arange(len(some)), [len(b) for b in bins])
                turns = np.concatenate([np.arange(len(b)) for b in bins] or [np.empty(0, np.int64)])
                picked = some.take(pa.array(row))
                yield pa.RecordBatch.from_arrays(
                    [picked.column("vec_id"), picked.column("vector"), pa.array(np.concatenate(bins or [[]]).astype(np.int64)), pa.array(turns)],
                    ["query_id", "vector", "leaf", "turn"],
                )

    return asked.mapInArrow(walk, "query_id long, vector array<double>, leaf long, turn long")


def search_leaves(index: Index, stops: DataFrame, k: int) -> DataFrame:
    """Candidates (`query_id`, `vec_id`, `score`): the `k` best of each group of rows that a query visits."""
    salts = index.sizes.select("leaf", F.ceil(F.col("n") / GROUP_ROWS).cast("int").alias("salts"))
    asked = stops.groupBy("leaf").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("blocks"))
    rows = index.leaves.join(salts, "leaf").join(asked, "leaf")
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.col("salts"))).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("leaf", "salt", F.col("block").cast("long"), "vec_id", "vector")
    ways = stops.join(salts, "leaf").join(asked, "leaf").withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")))
    ways = ways.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).select("leaf", F.col("salt").cast("long"), "block", "query_id", "vector")

    def meet(held: pa.Table, asking: pa.Table) -> pa.Table:
        if not len(held) or not len(asking):
            return pa.Table.from_batches([found_batch((np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)))])
        found = top_rows(asking.column("query_id").to_numpy(), matrix(asking.column("vector")), held.column("vec_id").to_numpy(), matrix(held.column("vector")), k)
        return pa.Table.from_batches([found_batch(found)])

    keys = ["leaf", "salt", "block"]
    return rows.groupBy(*keys).cogroup(ways.groupBy(*keys)).applyInArrow(meet, FOUND)


def calibrate(index: Index, k: int, recall: float = RECALL, queries: int = CALIBRATION) -> int:
    """The least number of visited leaves (by doubling and filling in) whose mean recall reaches `recall`."""
    sample = index.leaves.orderBy(F.xxhash64(F.lit("calibrate"), "vec_id"), "vec_id").limit(queries)
    sample = materialise(sample.select("vec_id", "vector"), "calibration")
    exact = exact_search(index.leaves, sample, k)
    everywhere = visited(index, sample, index.n_leaves).select("query_id", "leaf", "turn")
    # The turn at which each true neighbour would be found; a bounded number of rows.
    turns = exact.join(index.leaves.select("vec_id", "leaf").distinct(), "vec_id").join(everywhere, ["query_id", "leaf"])
    turns = sorted(r.turn for r in turns.select("turn").collect())
    if not turns:
        return index.n_leaves
    return int(min(index.n_leaves, turns[min(len(turns) - 1, int(np.ceil(recall * len(turns))))] + 1))


def search(index: Index, queries: DataFrame, k: int = NEIGHBOURS, visits: int | None = None) -> DataFrame:
    """`query_id`, `rank`, `vec_id`, `score` of the `k` nearest found; `queries` has `vec_id` and `vector`."""
    stops = materialise(visited(index, queries, visits or calibrate(index, k), k), "stops")
    return merged(search_leaves(index, stops, k), k)


def q_vector_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = build(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return search(index, index.leaves.where(F.col("vec_id") % QUERY_STEP == 0))
