"""Mixing sources to target weights by systematic sampling.

Every source gets a target in words: its share by weight of `SHARE` times all words, at most `MOST` times its own
words, the excess shared out again by weight. The expected copies of a document are its source's target by its source's
words. Documents of a source are put in order of size, their expected copies are summed up from the first one on, one
random offset is added, and a document is emitted once for each whole number that its part of the sum crosses. So a
document comes as often as expected, rounded down or up, and as neighbours in the order are of like size, a source's words
miss its target by about one document's size. So that this is a small one, the few heavy documents of a source come first, and what rounding them
took too much or too little changes the expected copies of those after them.

The sums are whole numbers of `1 / UNIT` copies and only their rest counts, so they are exact at any number of documents
and do not depend on how rows are dealt out. The order is made by ranges of source, size and id: a source with a third of all rows
spreads over many tasks, and one total per range and source carries the sums on. The offset is a digest of the seed and the source's name,
so reruns agree.

Edge cases: null text has size 0; documents without words take part and take no words; a null source comes last; rows
that repeat an id are rows of their own; a source without words has the target 0; an empty table gives no rows; other columns are not
read, and `mixture` keeps them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from docketry.llm.sharding import ranked
from docketry.session import materialise

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
SEED = "mix"
# A copy, in the units of the sums.
UNIT = 1 << 32
# A document is heavy with a hundredth of its source's target, and then at least a millionth of its source, so a source has a million at most.
COARSE, FINEST = 100, 1_000_000
WORD = r"[^\x20\x09-\x0D]+"


def water_level(sources: DataFrame, total: float) -> float:
    """The words for each unit of weight at which all sources together take `total`, none above its `most`.

    A round shares what the full sources leave among the others, which can only fill more of them; each round fills one at least,
    and the last fills none. Two sums a round come to the driver.
    """
    level = 0.0
    while True:
        full = F.col("most") <= F.lit(level) * F.col("weight")
        held = sources.agg(F.sum(F.when(full, F.col("most"))).alias("most"), F.sum(F.when(~full, F.col("weight"))).alias("weight")).first()
        if not held.weight:
            return level
        following = (total - (held.most or 0)) / held.weight
        if following <= level:
            return level
        level = following


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """`source`, `source_size`, `target` of every source of `sizes` (`source`, `size`)."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("absent", F.col("source").isNull())
    sources = ranked(sources, ["absent", "source"])
    of_rank = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("position") % len(weights) + 1).cast("int"))
    sources = materialise(sources.select("source", "source_size", of_rank.alias("weight"), (F.col("source_size") * most).alias("most")), "sources")
    level = water_level(sources, share * (sources.agg(F.sum("source_size")).first()[0] or 0))
    target = F.least(F.col("most").cast("double"), F.lit(level) * F.col("weight"))
    return sources.select("source", "source_size", target.alias("target"))


def sums_by_range(rows: DataFrame, order: list) -> DataFrame:
    """`rows` in `order`, with `part` and `before`: the units of earlier rows of the same source in this range, less whole copies."""
    schema = T.StructType([*rows.schema.fields, T.StructField("part", T.IntegerType()), T.StructField("before", T.LongType())])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, source = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.column("source").dictionary_encode()
            codes = names.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            units = batch.column("units").to_numpy()
            upto = np.cumsum(units)
            # A source's sum starts where the source does; the first one of a batch may go on from the last batch.
            starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
            base = (upto - units)[starts]
            if names[0].as_py() == source:
                base[0] -= held
            before = upto - units - np.repeat(base, np.diff(np.r_[starts, len(codes)]))
            held, source = int(before[-1] + units[-1]) % UNIT, names[-1].as_py()
            yield batch.append_column("before", pa.array(before % UNIT))

    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    return placed.mapInArrow(add, schema)


def copies_of_heavy(heavy: DataFrame, most: float = MOST) -> DataFrame:
    """`row`, `copies` of documents that are a good part of their target, largest first, by source; and a row without `row` for what is left of it.

    After each document the rate is what is left of the target by what is left of the words.
    """

    def walk(rows: pa.Table) -> pa.Table:
        # Nulls come first among equal sizes, as in the ranges of the others.
        order = sorted(zip(*[rows[c].to_pylist() for c in ("size", "doc_id", "tie", "row")]), key=lambda r: (-r[0], r[1] is not None, r[1] or 0, r[2], r[3]))
        target, words, upto = rows["target"][0].as_py(), rows["source_size"][0].as_py(), rows["offset"][0].as_py()
        taken = []
        for size, _, _, _ in order:
            units = int(min(max(target / words, 0.0), most) * UNIT)
            taken.append((upto + units) // UNIT)
            upto = (upto + units) % UNIT
            target, words = target - taken[-1] * size, words - size
        n = len(order)
        return pa.table({
            "source": pa.array([rows["source"][0].as_py()] * (n + 1), pa.string()),
            "row": pa.array([*[r[3] for r in order], None], pa.int64()),
            "copies": pa.array([*taken, None], pa.int64()),
            "target": pa.array([None] * n + [target], pa.float64()),
            "words": pa.array([None] * n + [words], pa.int64()),
            "offset": pa.array([None] * n + [upto], pa.int64()),
        })

    light = heavy.select("source", "size", "doc_id", "tie", "row", "source_size", "target", "offset")
    return light.groupBy("source").applyInArrow(walk, "source string, row long, copies long, target double, words long, offset long")


def copies_of_light(rows: DataFrame) -> DataFrame:
    """`rows` with `copies`, by systematic sampling within the source at the rate `expected` and from `offset` on."""
    rows = rows.withColumn("units", F.floor(F.col("expected") * UNIT))
    placed = materialise(sums_by_range(rows, [F.col("source").asc_nulls_last(), F.col("size").desc(), F.col("doc_id"), F.col("tie"), F.col("row")]), "sums")
    totals = placed.groupBy("source", "part").agg(F.pmod(F.sum("units"), F.lit(UNIT)).alias("n"))
    # One row for each range that a source reaches into.
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col("source").alias("of"), F.col("part").alias("at"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    start = F.pmod(F.col("base") + F.col("before") + F.col("offset"), F.lit(UNIT))
    joined = placed.join(totals, (F.col("part") == F.col("at")) & F.col("source").eqNullSafe(F.col("of")))
    return joined.withColumn("copies", F.shiftright(start + F.col("units"), 32))


def mix(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED, keep: list[str] | None = None) -> DataFrame:
    """The copies and words that the mix takes of every document, with the columns in `keep` as `kept`."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    sizes = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("tie"),
        F.monotonically_increasing_id().alias("row"),
        *([F.struct(*[F.col(f"`{c}`").alias(c) for c in keep]).alias("kept")] if keep else []),
    )
    sizes = materialise(sizes, "sizes")
    name = F.coalesce(F.concat(F.lit(f"{seed}="), F.col("source")), F.lit(seed))
    offset = F.conv(F.substring(F.md5(name.cast("binary")), 1, 8), 16, 10).cast("long")
    targets = source_targets(sizes.select("source", "size"), weights, share, most).withColumn("offset", offset).withColumnRenamed("source", "named")
    rows = sizes.join(targets, sizes["source"].eqNullSafe(targets["named"])).drop("named")
    is_heavy = (F.col("size") > 0) & (F.col("target") > 0) & (F.col("size") >= F.greatest(F.col("target") / COARSE, F.col("source_size") / FINEST))
    heavy, light = rows.where(is_heavy), rows.where(~is_heavy)

    settled = materialise(copies_of_heavy(heavy, most), "settled")
    heavy = heavy.join(settled.where("row IS NOT NULL").select("row", "copies"), "row")
    left = settled.where("row IS NULL").select(F.col("source").alias("named"), F.col("target").alias("rest"), "words", F.col("offset").alias("go_on"))
    light = light.join(left, light["source"].eqNullSafe(left["named"]), "left")
    rest, words = F.coalesce("rest", "target"), F.coalesce("words", "source_size")
    rate = F.least(F.greatest(rest / F.nullif(words, F.lit(0)), F.lit(0.0)), F.lit(float(most)))
    light = light.withColumn("expected", F.coalesce(rate, F.lit(0.0))).withColumn("offset", F.coalesce("go_on", "offset")).drop("named", "rest", "words", "go_on")
    taken = (F.col("copies") * F.col("size")).alias("taken")
    result = ["doc_id", "size", "source_size", "target", taken, "source", "copies", *(["kept"] if keep else [])]
    return heavy.select(*result).unionByName(copies_of_light(light).select(*result))


def mixture(documents: DataFrame, **options) -> DataFrame:
    """The rows of the mix themselves, each document as often as it is taken."""
    mixed = mix(documents, keep=documents.columns, **options).where("copies > 0")
    return mixed.select(F.explode(F.array_repeat("kept", F.col("copies").cast("int"))).alias("kept")).select("kept.*")


def q_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
