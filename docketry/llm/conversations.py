"""Repair of conversation structure by a run-length dynamic program.

A conversation is well formed if its roles' initials are `(s?(ua)+)?`. Rows may be kept, given another role, deleted or
inserted, at the costs below; blank and repeated rows have to go. A row is one of nine symbols (its role, and whether it is truncated or has to go), and
each symbol has a min-plus matrix of the cost from one state of the pattern to another. Equal symbols in a row make a run, and a run of
length n is passed by the cached powers 1, 2, 4, ... of its matrix. Costs are carried from the end to the start; then
choices are unrolled from the start, always the first letter in the alphabet that still leads to the least cost, so ties are broken as asked.

Rows are dealt out by ranges of conversation and turn, and each task reads its range in order. A conversation that lies in one range and in
one block is repaired there. Any other one, first and last of a range included, is cut into blocks of bounded size: matrices of
blocks tell the cost behind each block, every block unrolls its choices for all four states that it may be entered in, and the chain of
exits picks one of them. What meets in one task for a conversation is a row of a few numbers for each block, and at the end its
repaired text, which passes through as a stream for its digest. Repeated rows are found by the first turn of each role and text, pre-aggregated.

Edge cases: a null role or text is one space, and so is a null id or turn in the checksum; a null turn comes first; rows of one turn are
taken by role, then by the digest of their text; rows with a null id are one conversation; a role without a first character has to be
changed or deleted, like any other initial than s, u, a; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import count, groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from docketry.session import materialise

SPACES = " \t\n\x0b\x0c\r"
# What a row or an inserted one costs.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
# Rows and characters of a block.
BLOCK_ROWS = 2048
BLOCK_CHARS = 256 << 10

# States of the pattern: nothing yet, after s, after u, after a; an inserted or changed row leads to the next.
NEXT = (2, 2, 3, 2)
NAMES = {2: "user", 3: "assistant"}
STATES = range(4)
FAR = 1 << 60
# Inserted rows that end the pattern from each state, and what they cost.
TAILS = (0, 2, 1, 0)
END = tuple(INSERT * n for n in TAILS)
# Symbols: 2 * role + truncated, roles u, a, s and others; then rows that have to go.
ROLES = "uas"
GONE = 8

Matrix = tuple[tuple[int, ...], ...]


def kept_state(symbol: int, state: int) -> int | None:
    """The state after a row is kept, or None."""
    role = symbol >> 1
    return 2 if role == 0 and state != 2 else 3 if role == 1 and state == 2 else 1 if role == 2 and state == 0 else None


def product(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(min(row[k] + b[k][j] for k in STATES) for j in STATES) for row in a)


def before(matrix: Matrix, costs: tuple[int, ...]) -> tuple[int, ...]:
    """The costs before what `matrix` stands for, from those after it."""
    return tuple(min(row[k] + costs[k] for k in STATES) for row in matrix)


@lru_cache(maxsize=None)
def power(symbol: int, k: int) -> Matrix:
    """The cost from state to state over `2 ** k` rows of a symbol, each with rows inserted before it."""
    if k:
        return product(power(symbol, k - 1), power(symbol, k - 1))
    inserts = [[FAR] * 4 for _ in STATES]
    for state in STATES:
        inserts[state][state] = 0
        inserts[state][NEXT[state]] = INSERT
        inserts[state][NEXT[NEXT[state]]] = min(2 * INSERT, inserts[state][NEXT[NEXT[state]]])
    edits = [[FAR] * 4 for _ in STATES]
    for state in STATES:
        edits[state][state] = DELETE
        if symbol != GONE:
            cost = TRUNCATED * (symbol & 1)
            edits[state][NEXT[state]] = min(REROLE + cost, edits[state][NEXT[state]])
            if (to := kept_state(symbol, state)) is not None:
                edits[state][to] = min(cost, edits[state][to])
    return product(tuple(map(tuple, inserts)), tuple(map(tuple, edits)))


def powers(symbol: int, length: int) -> Iterator[Matrix]:
    k = 0
    while length >> k:
        if length >> k & 1:
            yield power(symbol, k)
        k += 1


def back(symbol: int, length: int, costs: tuple[int, ...]) -> tuple[int, ...]:
    """The costs before a run."""
    for matrix in powers(symbol, length):
        costs = before(matrix, costs)
    return costs


def runs(symbols: bytes) -> list[tuple[int, int]]:
    return [(symbol, sum(1 for _ in same)) for symbol, same in groupby(symbols)]


def matrix_of(symbols: bytes) -> Matrix:
    """The cost from state to state over all rows of a block."""
    whole = tuple(tuple(0 if i == j else FAR for j in STATES) for i in STATES)
    for symbol, length in runs(symbols):
        for matrix in powers(symbol, length):
            whole = product(whole, matrix)
    return tuple(tuple(min(x, FAR) for x in row) for row in whole)


@lru_cache(maxsize=1 << 16)
def unroll(symbol: int, length: int, state: int, costs: tuple[int, ...]) -> tuple[str, int]:
    """The choices of a run entered in `state`, and the state after it; `costs` are those after it, the least of them 0."""
    if length > 1:
        half = 1 << (length - 1).bit_length() - 1
        first, state = unroll(symbol, half, state, levelled(back(symbol, length - half, costs)))
        second, state = unroll(symbol, length - half, state, costs)
        return first + second, state
    due, said = before(power(symbol, 0), costs), ""
    while True:
        if DELETE + costs[state] == due[state]:
            return said + "D", state
        if INSERT + due[NEXT[state]] == due[state]:
            said, state = said + "I", NEXT[state]
            continue
        to = kept_state(symbol, state)
        if to is not None and TRUNCATED * (symbol & 1) + costs[to] == due[state]:
            return said + "K", to
        return said + "R", NEXT[state]


def levelled(costs: tuple[int, ...]) -> tuple[int, ...]:
    least = min(costs)
    return tuple(c - least for c in costs)


def choose(symbols: bytes, state: int, costs: tuple[int, ...]) -> tuple[str, int]:
    """The choices of a block entered in `state`, and the state after it, given the costs after it."""
    after, parts = [costs], runs(symbols)
    for symbol, length in reversed(parts[1:]):
        after.append(levelled(back(symbol, length, after[-1])))
    said = []
    for (symbol, length), costs in zip(parts, reversed(after)):
        chosen, state = unroll(symbol, length, state, levelled(costs))
        said.append(chosen)
    return "".join(said), state


@lru_cache(maxsize=1 << 16)
def solve(symbols: bytes) -> tuple[int, str]:
    """Cost and audit of a whole conversation."""
    costs = END
    for symbol, length in reversed(runs(symbols)):
        costs = back(symbol, length, costs)
    audit, state = choose(symbols, 0, END)
    return costs[0], audit + "I" * TAILS[state]


def repaired(roles: list[str], texts: list[str], audit: str, state: int) -> list[tuple[str, str]]:
    """The rows that an audit leaves, from the state it starts in."""
    out, row = [], 0
    for edit in audit:
        if edit == "I":
            state = NEXT[state]
            out.append((NAMES[state], ""))
            continue
        role, text = roles[row], texts[row]
        row += 1
        if edit == "K":
            state = kept_state(2 * ROLES.index(role[0]), state)
            out.append((role, text))
        elif edit == "R":
            state = NEXT[state]
            out.append((NAMES[state], text))
    return out


def lines(rows: list[tuple[str, str]]) -> str:
    return "\n".join(f"{role}:{text}" for role, text in rows)


def damage(conversations: DataFrame) -> DataFrame:
    """`conv_id`, `turn`, `role`, `text` and `copies` of every row, damaged by the checksum of its id and turn."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(said("text"), ".!?", "")).otherwise(said("text"))
    return conversations.select(
        F.col("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(said("role")).alias("role"),
        text.alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


def faulty(rows: DataFrame) -> DataFrame:
    """`rows` (as `damage` gives them) with `fault` of the first copy, from blank, duplicate, truncated, and the keys of their order."""
    trimmed = F.rtrim("text", F.lit(SPACES))
    rows = rows.withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256))).withColumn("row", F.monotonically_increasing_id())
    rows = rows.withColumn("at", F.struct(F.col("turn").isNotNull().alias("known"), "turn", "row"))
    counted = rows.where("copies > 0")
    firsts = counted.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d")).agg(F.min("at").alias("first"))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    fault = (
        F.when(trimmed == "", "blank").when(F.col("first") < F.col("at"), "duplicate")
        .when(~F.substring(trimmed, -1, 1).isin(".", "!", "?"), "truncated")
    )
    return rows.join(firsts, same, "left").select("conv_id", "turn", "role", "text", "copies", "digest", "row", fault.alias("fault"))


COUNTS = ("blank", "duplicate", "truncated", "illegal")
# What is told of a block: its rows, faults and turns, the initials at its ends, its matrix.
BLOCK = "part int, block int, n long, blank long, duplicate long, truncated long, illegal long, first string, last string, low long, high long, turns long, matrix array<long>, symbols binary"
TURN = "array<struct<role:string,text:string>>"


class Piece:
    """Rows of one conversation that were read and not yet handed on."""

    def __init__(self, conv_id):
        self.conv_id, self.begun = conv_id, False
        self.clear()

    def clear(self) -> None:
        self.roles, self.texts, self.symbols, self.chars = [], [], bytearray(), 0
        self.told = dict.fromkeys(COUNTS, 0)
        self.low = self.high = None
        self.turns = 0

    def add(self, turn: int | None, role: str, text: str, fault: str | None) -> None:
        if fault:
            self.told[fault] += 1
        if self.roles and self.roles[-1][:1] + role[:1] not in ("su", "ua", "au"):
            self.told["illegal"] += 1
        if turn is not None and turn != self.high:
            self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
        of_role = ROLES.index(role[0]) if role[:1] and role[0] in ROLES else 3
        self.symbols.append(GONE if fault in ("blank", "duplicate") else 2 * of_role + (fault == "truncated"))
        self.roles.append(role)
        self.texts.append(text)
        self.chars += len(text)

    def full(self, rows: int, chars: int) -> bool:
        return len(self.roles) >= rows or self.chars >= chars

    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.turns

    def whole(self) -> dict:
        cost, audit = solve(bytes(self.symbols))
        rows = repaired(self.roles, self.texts, audit, 0)
        return self.told | {"conv_id": self.conv_id, "done": True, "gaps": self.gaps(), "cost": cost, "audit": audit, "rows": rows}

    def cut(self, part: int, block: int) -> dict:
        row = self.told | {"conv_id": self.conv_id, "done": False, "part": part, "block": block, "n": len(self.roles)}
        row |= {"low": self.low, "high": self.high, "turns": self.turns, "roles": self.roles, "texts": self.texts, "symbols": bytes(self.symbols)}
        if self.roles:
            row |= {"first": self.roles[0][:1], "last": self.roles[-1][:1]}
        row["matrix"] = [x for r in matrix_of(bytes(self.symbols)) for x in r]
        self.begun = True
        self.clear()
        return row


def pieces(rows: DataFrame, block_rows: int, block_chars: int, turns: bool) -> DataFrame:
    """Conversations that one task could repair (`done`), and blocks of the others."""
    # Key columns tell apart what is otherwise alike, so no range need hold more than its share.
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "digest", "row")]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = placed.select("conv_id", "turn", "role", "text", "copies", "fault", F.spark_partition_id().alias("part"))
    kind = rows.schema["conv_id"].dataType
    schema = T.StructType([T.StructField("conv_id", kind), *T.StructType.fromDDL(
        f"done boolean, gaps long, cost long, audit string, repaired_sha256 string, rows {TURN}, {BLOCK}, roles array<string>, texts array<string>"
    ).fields])

    shape = to_arrow_schema(schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, first, part, out, held = None, True, None, [], 0
        block = count()  # of the range

        def finished(row: dict) -> dict:
            if row["done"]:
                row["repaired_sha256"] = hashlib.sha256(lines(row["rows"]).encode()).hexdigest()
                row["rows"] = [{"role": r, "text": t} for r, t in row["rows"]] if turns else None
            return row

        def batch_of(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(rows, shape)

        for batch in batches:
            for conv_id, turn, role, text, copies, fault, part in zip(*[c.to_pylist() for c in batch.columns]):
                if piece is None or conv_id != piece.conv_id:
                    if piece is not None:
                        # The first conversation of a range may have begun in an earlier one.
                        out.append(finished(piece.cut(part, next(block)) if first or piece.begun else piece.whole()))
                        first = False
                    piece = Piece(conv_id)
                for copy in range(copies):
                    if piece.full(block_rows, block_chars):
                        out.append(piece.cut(part, next(block)))
                        held += block_chars
                    piece.add(turn, role, text, fault if copy == 0 or fault == "blank" else "duplicate")
                held += len(text)
                if held >= 16 * block_chars:
                    yield batch_of(out)
                    out, held = [], 0
        if piece is not None:
            out.append(piece.cut(part, next(block)))
            yield batch_of(out)

    return placed.mapInArrow(read, schema)


def costs_behind(blocks: DataFrame) -> DataFrame:
    """`part`, `block`, `after`: the costs behind each block, by state."""

    def chain(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("part", "ascending"), ("block", "ascending")])
        costs, after = END, []
        for flat in reversed(rows["matrix"].to_pylist()):
            after.append(costs)
            costs = before(tuple(tuple(flat[4 * i:4 * i + 4]) for i in STATES), costs)
        return pa.table({"part": rows["part"], "block": rows["block"], "after": after[::-1]})

    return blocks.select("conv_id", "part", "block", "matrix").groupBy("conv_id").applyInArrow(chain, "part int, block int, after array<long>")


def choices(blocks: DataFrame) -> DataFrame:
    """`blocks` with `audits` and `exits`, one for each state they may be entered in; `due`, the cost from each."""
    schema = T.StructType([*blocks.schema.fields, *T.StructType.fromDDL("due array<long>, audits array<string>, exits array<int>").fields])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            due, audits, exits = [], [], []
            for symbols, flat, after in zip(*[batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("symbols", "matrix", "after")]):
                made = [choose(symbols, state, tuple(after)) for state in STATES]
                due.append(before(tuple(tuple(flat[4 * i:4 * i + 4]) for i in STATES), tuple(after)))
                audits.append([a for a, _ in made])
                exits.append([s for _, s in made])
            for name, column, kind in (("due", due, pa.int64()), ("audits", audits, pa.string()), ("exits", exits, pa.int32())):
                batch = batch.append_column(name, pa.array(column, pa.list_(kind)))
            yield batch

    return blocks.mapInArrow(work, schema)


def entries(blocks: DataFrame) -> DataFrame:
    """`part`, `block`, the state that each block is entered in, the rows that end the last one, and on each the sums of its conversation."""

    def chain(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("part", "ascending"), ("block", "ascending")])
        told = rows.to_pylist()
        total = {c: sum(r[c] for r in told) for c in COUNTS}
        entered, state, last, low, high, turns = [], 0, None, None, None, 0
        for r in told:
            entered.append(state)
            state = r["exits"][state]
            if r["n"]:
                total["illegal"] += last is not None and last + r["first"] not in ("su", "ua", "au")
                last = r["last"]
            if r["low"] is not None:
                turns += r["turns"] - (r["low"] == high)
                low, high = r["low"] if low is None else low, r["high"]
        n = len(told)
        total |= {"gaps": 0 if low is None else high - low + 1 - turns, "cost": told[0]["due"][0]}
        tails = [0] * (n - 1) + [TAILS[state] if any(r["n"] for r in told) else 0]
        columns = {"part": rows["part"], "block": rows["block"], "entered": pa.array(entered, pa.int32()), "tail": pa.array(tails, pa.int32())}
        return pa.table(columns | {c: pa.array([v] * n, pa.int64()) for c, v in total.items()})

    columns = ("conv_id", "part", "block", "n", *COUNTS, "first", "last", "low", "high", "turns", "due", "exits")
    schema = "part int, block int, entered int, tail int, " + ", ".join(f"{c} long" for c in (*COUNTS, "gaps", "cost"))
    return blocks.select(*columns).groupBy("conv_id").applyInArrow(chain, schema)


def repaired_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks with their audit and `rows`, in place of what they held."""
    light = materialise(choices(blocks.drop("done", "gaps", "cost", "audit", "repaired_sha256", "rows", "roles", "texts").join(costs_behind(blocks), ["part", "block"])), "choices")
    audit = F.concat(F.element_at("audits", F.col("entered") + 1), F.repeat(F.lit("I"), F.col("tail")))
    chosen = light.select("part", "block", "audits").join(entries(light), ["part", "block"]).withColumn("audit", audit).drop("audits", "tail")
    held = blocks.select("conv_id", "part", "block", "roles", "texts").join(chosen, ["part", "block"])
    schema = T.StructType([*held.drop("roles", "texts", "entered").schema.fields, T.StructField("rows", T.DataType.fromDDL(TURN))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            rows = []
            for roles, texts, audit, state in zip(*[columns.pop(c).to_pylist() for c in ("roles", "texts")], columns["audit"].to_pylist(), columns.pop("entered").to_pylist()):
                rows.append([{"role": r, "text": t} for r, t in repaired(roles, texts, audit, state)])
            kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
            yield pa.RecordBatch.from_arrays([*columns.values(), pa.array(rows, kind)], [*columns, "rows"])

    return held.mapInArrow(work, schema)


RESULT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def joined_blocks(blocks: DataFrame) -> DataFrame:
    """One row per conversation of its blocks, which pass in order; only the audit is gathered."""
    placed = blocks.repartition("conv_id").sortWithinPartitions("conv_id", "part", "block")
    placed = placed.select("conv_id", *RESULT[:-2], "audit", F.transform("rows", lambda r: F.concat(r["role"], F.lit(":"), r["text"])).alias("lines"))
    schema = T.StructType([*placed.drop("lines").schema.fields, T.StructField("repaired_sha256", T.StringType())])

    shape = to_arrow_schema(schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, audit, digest, begun = None, [], hashlib.sha256(), False

        def ended() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([row | {"audit": "".join(audit), "repaired_sha256": digest.hexdigest()}], shape)

        for batch in batches:
            for told in batch.to_pylist():
                said = told.pop("lines")
                if row is None or row["conv_id"] != told["conv_id"]:
                    if row is not None:
                        yield ended()
                    audit, digest, begun = [], hashlib.sha256(), False
                row = told
                audit.append(told["audit"])
                for line in said:
                    digest.update((b"\n" if begun else b"") + line.encode())
                    begun = True
        if row is not None:
            yield ended()

    return placed.mapInArrow(work, schema)


def repair(rows: DataFrame, block_rows: int = BLOCK_ROWS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Faults, cost, audit and digest of every conversation of `rows` (`conv_id`, `turn`, `role`, `text`, `copies`)."""
    read = materialise(pieces(faulty(rows), block_rows, block_chars, turns=False), "pieces")
    whole = read.where("done").select("conv_id", *RESULT)
    return whole.unionByName(joined_blocks(repaired_blocks(read.where("NOT done"))).select("conv_id", *RESULT))


def repaired_turns(rows: DataFrame, block_rows: int = BLOCK_ROWS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The repaired conversations themselves: `conv_id`, `part`, `block`, `place`, `role`, `text`; the order is that of the three numbers."""
    read = materialise(pieces(faulty(rows), block_rows, block_chars, turns=True), "pieces")
    zero = F.lit(0)
    whole = read.where("done").select("conv_id", zero.alias("part"), zero.alias("block"), "rows")
    rows = whole.unionByName(repaired_blocks(read.where("NOT done")).select("conv_id", "part", "block", "rows"))
    return rows.select("conv_id", "part", "block", F.posexplode("rows").alias("place", "row")).select("conv_id", "part", "block", "place", "row.role", "row.text")


def q_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damage(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
