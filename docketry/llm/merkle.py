"""A Merkle manifest of a dataset, with a version of the tree for each changed document.

A leaf is the digest of a row's fields. The leaves of a language, by id, make a tree of `FAN` children a node, and the
languages' roots make one more on top. A tree is cut into aligned blocks of `FAN ** DEPTH` nodes, each built by one task from its own rows;
the roots of the blocks are the nodes of the next layer, and so on until one is left.

A changed leaf makes a new version of the tree by path copying: the version has copies of the leaf's ancestors, and shares all other
nodes with the first version. Within the block they are copied by the task that has it; above it the version goes on along the block's
path, the brothers of its root and of its root's ancestors, which is worked out once for each block and handed down layer by layer. So a
block is moved whole, a path has a few thousand bytes for `FAN ** DEPTH` leaves, and no node is rebuilt that a version does not change.

Positions come from ranges of language, id and digest, so a language with most of all rows spreads over all tasks.

Edge cases: null fields have a mark of their own; a null id comes first and is never changed by `altered`; rows that repeat an id are
leaves side by side, in the order of their digests; empty and long texts are fields like any others; a single row is leaf, subroot and
root at once, and its proof is the digest of nothing; an empty table gives no rows; columns beside the five fields are not read, and a field
that the table lacks is null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from docketry.llm.sharding import ranked
from docketry.session import materialise

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FAN = 8
# Levels of a block: 4,096 leaves.
DEPTH = 4

NODES = "tree string, at long, n long, digest string"
PATH = "tree string, at long, path array<struct<place:int,brothers:array<string>>>, subroot string, root string"
VERIFIED = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
STORED = "tree string, level int, at long, digest string"


def H(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value: Column) -> Column:
    """A value's length in bytes and itself, or a mark for null."""
    said = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(said).cast("string"), F.lit(":"), said), F.lit("-"))


def leaf(documents: DataFrame, **other: Column) -> Column:
    """The digest of a row; `other` has columns in place of the row's own."""
    own = {c: F.col(c) if c in documents.columns else F.lit(None) for c in FIELDS} | other
    return F.sha2(F.concat(*[field(own[c]) for c in FIELDS]).cast("binary"), 256)


def altered(documents: DataFrame) -> Column:
    """The digest of a row whose text is lower-cased where 3 divides the checksum of its id, else its own."""
    lowered = F.translate(F.col("text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return F.when(chosen, leaf(documents, text=lowered)).otherwise(leaf(documents))


def levels_of(n: int, fan: int, depth: int) -> int:
    """The levels that a block of a layer of `n` nodes has above its own nodes."""
    levels = 0
    while levels < depth and fan ** levels < n:
        levels += 1
    return levels


def build(digests: list[str], levels: int, fan: int) -> list[list[str]]:
    """The nodes of a block by level, its own first."""
    tree = [digests]
    for _ in range(levels):
        below = tree[-1]
        tree.append([H(*below[i:i + fan]) for i in range(0, len(below), fan)])
    return tree


def brothers(tree: list[list[str]], at: int, fan: int) -> list[tuple[int, list[str]]]:
    """For each level below the block's root: the place in its run of the node above position `at`, and the others of the run."""
    path = []
    for level in tree[:-1]:
        place = at % fan
        run = level[at - place:at - place + fan]
        path.append((place, run[:place] + run[place + 1:]))
        at //= fan
    return path


def path_copy(digest: str, path: list[tuple[int, list[str]]]) -> list[str]:
    """The nodes that a version with another leaf does not share: the leaf and a copy of each ancestor, the root last."""
    copied = [digest]
    for place, others in path:
        copied.append(H(*others[:place], copied[-1], *others[place:]))
    return copied


def in_blocks(layer: DataFrame, fan: int, depth: int) -> DataFrame:
    return layer.withColumn("block", F.floor(F.col("at") / fan ** depth))


def sorted_block(rows: pa.Table, fan: int, depth: int) -> tuple[pa.Table, list[list[str]]]:
    rows = rows.sort_by("at")
    return rows, build(rows["digest"].to_pylist(), levels_of(rows["n"][0].as_py(), fan, depth), fan)


def climb(layer: DataFrame, fan: int, depth: int) -> DataFrame:
    """The next layer: the root of every block."""

    def root(rows: pa.Table) -> pa.Table:
        rows, tree = sorted_block(rows, fan, depth)
        n = rows["n"][0].as_py()
        step = fan ** levels_of(n, fan, depth)
        return pa.table({"tree": rows["tree"][:1], "at": [rows["block"][0].as_py()], "n": [-(-n // step)], "digest": [tree[-1][0]]})

    return in_blocks(layer, fan, depth).groupBy("tree", "block").applyInArrow(root, NODES)


def meet(layer: DataFrame, paths: DataFrame, work: Callable[[pa.Table, list[list[str]], list, str, str], dict], schema: str, fan: int, depth: int) -> DataFrame:
    """`work` on every block of a layer, with the block's tree and its root's path."""

    def one(rows: pa.Table, above: pa.Table) -> pa.Table:
        rows, tree = sorted_block(rows, fan, depth)
        path = [(p["place"], p["brothers"]) for p in above["path"][0].as_py()]
        return pa.table(work(rows, tree, path, above["subroot"][0].as_py(), above["root"][0].as_py()))

    blocks = in_blocks(layer, fan, depth).groupBy("tree", "block")
    return blocks.cogroup(paths.withColumnRenamed("at", "block").groupBy("tree", "block")).applyInArrow(one, schema)


def descend(layer: DataFrame, paths: DataFrame, fan: int, depth: int) -> DataFrame:
    """The path to the root of every node of a layer, from the paths of the layer above."""

    def work(rows, tree, path, subroot, root):
        step = fan ** depth
        own = [brothers(tree, at % step, fan) + path for at in rows["at"].to_pylist()]
        told = [[{"place": place, "brothers": others} for place, others in p] for p in own]
        kind = pa.list_(pa.struct([("place", pa.int32()), ("brothers", pa.list_(pa.string()))]))
        return {"tree": rows["tree"], "at": rows["at"], "path": pa.array(told, kind), "subroot": pa.array([subroot] * len(told), pa.string()), "root": pa.array([root] * len(told), pa.string())}

    return meet(layer, paths, work, PATH, fan, depth)


def layers_of(nodes: DataFrame, fan: int, depth: int) -> list[DataFrame]:
    """All layers of all trees of `nodes` (`tree`, `at`, `n`, `digest`), the last with one node a tree."""
    layers = [nodes]
    while (layers[-1].agg(F.max("n")).first()[0] or 1) > 1:
        layers.append(materialise(climb(layers[-1].select("tree", "at", "n", "digest"), fan, depth), "nodes"))
    return layers


def placed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """`rows` by tree, with `at`, the position in the tree, and `n`, the tree's number of rows."""
    rows = ranked(rows, ["tree", *keys])
    trees = rows.groupBy("tree").agg(F.min("position").alias("start"), F.count("*").alias("n"))
    return rows.join(trees, "tree").withColumn("at", F.col("position") - F.col("start")).drop("position", "start", "total")


@dataclass
class Manifest:
    """The layers of the trees by language, and above the first of them the path of every block to the root."""

    leaves: DataFrame
    layers: list[DataFrame]
    paths: DataFrame
    fan: int
    depth: int

    def versions(self) -> DataFrame:
        """Every leaf against the version of the tree that its `altered` digest makes."""

        fan, depth = self.fan, self.depth

        def work(rows, tree, path, subroot, root):
            step, out = fan ** depth, []
            for doc_id, at, own, other in zip(*[rows[c].to_pylist() for c in ("doc_id", "at", "digest", "altered")]):
                up = brothers(tree, at % step, fan) + path
                folded = path_copy(other, up)[-1]
                out.append((doc_id, own, subroot, root, H(*[x for _, others in up for x in others]), folded, folded == root))
            names = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
            kinds = (pa.int64(), *[pa.string()] * 5, pa.bool_())
            return {name: pa.array(column, kind) for name, kind, column in zip(names, kinds, zip(*out))}

        return meet(self.layers[0], self.paths, work, VERIFIED, fan, depth)

    def nodes(self) -> DataFrame:
        """The first version: every node of the languages' trees, with its level and its position in it."""
        fan, depth = self.fan, self.depth

        def store(base: int) -> Callable[[pa.Table], pa.Table]:
            def every(rows: pa.Table) -> pa.Table:
                rows, tree = sorted_block(rows, fan, depth)
                block, own = rows["block"][0].as_py(), []
                # A block's root is a node of the next layer, unless the block is the whole tree.
                whole = fan ** (len(tree) - 1) >= rows["n"][0].as_py()
                for level, digests in enumerate(tree if whole else tree[:-1]):
                    first = block * fan ** (depth - level)
                    own += [(base * depth + level, first + i, d) for i, d in enumerate(digests)]
                level, at, digest = zip(*own) if own else ((), (), ())
                return pa.table({"tree": pa.array([rows["tree"][0].as_py()] * len(own), pa.string()), "level": pa.array(level, pa.int32()), "at": pa.array(at, pa.int64()), "digest": pa.array(digest, pa.string())})

            return every

        stored = []
        for base, layer in enumerate(self.layers):
            # Trees that ended below keep one node in each later layer, which is stored already.
            grown = layer.select("tree", "at", "n", "digest").where(F.lit(base == 0) | (F.col("n") > 1))
            stored.append(in_blocks(grown, fan, depth).groupBy("tree", "block").applyInArrow(store(base), STORED))
        whole = stored[0]
        for more in stored[1:]:
            whole = whole.unionByName(more)
        return whole

    def copied(self) -> DataFrame:
        """What each version adds: the copies of the ancestors of its leaf, up to the root of all; all other nodes are those of `nodes`."""
        fan, depth = self.fan, self.depth

        def work(rows, tree, path, subroot, root):
            step, out = fan ** depth, []
            for doc_id, name, at, own, other in zip(*[rows[c].to_pylist() for c in ("doc_id", "tree", "at", "digest", "altered")]):
                if own != other:
                    up = brothers(tree, at % step, fan) + path
                    out += [(doc_id, name, at, level, d) for level, d in enumerate(path_copy(other, up))]
            names, kinds = ("doc_id", "tree", "leaf_at", "level", "digest"), (pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.string())
            return {name: pa.array(column, kind) for name, kind, column in zip(names, kinds, zip(*out) if out else [()] * 5)}

        return meet(self.layers[0], self.paths, work, "doc_id long, tree string, leaf_at long, level int, digest string", fan, depth)


def manifest(documents: DataFrame, fan: int = FAN, depth: int = DEPTH, changed: Callable[[DataFrame], Column] = altered) -> Manifest:
    """The trees of `documents`; `changed` gives the digest that each row has by now."""
    lang = F.col("lang").cast("string") if "lang" in documents.columns else F.lit(None).cast("string")
    # A name for each language that is never null and sorts as the languages do, null first.
    tree = F.coalesce(F.concat(F.lit("="), lang), F.lit("-"))
    leaves = documents.select(F.col("doc_id").cast("long").alias("doc_id"), tree.alias("tree"), leaf(documents).alias("digest"), changed(documents).alias("altered"))
    leaves = materialise(leaves, "leaves").withColumn("row", F.monotonically_increasing_id())
    leaves = materialise(placed(leaves, ["doc_id", "digest", "row"]).drop("row"), "leaves")
    layers = layers_of(leaves, fan, depth)
    # The languages' roots are the leaves of one more tree.
    tops = layers[-1].select(F.lit("").alias("tree"), F.col("tree").alias("lang"), "digest")
    tops = materialise(placed(tops, ["lang"]), "subroots")
    above = layers_of(tops, fan, depth)
    root = above[-1].select("tree", F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<struct<place:int,brothers:array<string>>>)").alias("path"), F.lit("").alias("subroot"), F.col("digest").alias("root"))
    paths = root
    for layer in reversed(above[:-1]):
        paths = materialise(descend(layer, paths, fan, depth), "paths")
    below = tops.join(paths.drop("tree", "subroot"), "at").select(F.col("lang").alias("tree"), F.lit(0).cast("long").alias("at"), "path", F.col("digest").alias("subroot"), "root")
    paths = materialise(below, "paths")
    for layer in reversed(layers[1:-1]):
        paths = materialise(descend(layer, paths, fan, depth), "paths")
    return Manifest(leaves, layers, paths, fan, depth)


def q_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(spark.read.parquet(f"{sf_dir}/documents.parquet")).versions()
