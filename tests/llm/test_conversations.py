import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

from docketry.llm import conversations as c

GOOD = re.compile(r"(s?(ua)+)?\Z")


def brute_repair(rows):
    """All edits of a few rows, at most two inserted in one place: the cheapest, then the least audit."""
    best = None
    inserts = ["", "u", "a", "ua", "au"]
    per_row = []
    for role, text, fault in rows:
        must = fault in ("blank", "duplicate")
        late = fault == "truncated"
        edits = [("D", "", None, 3)]
        if not must:
            edits.append(("K", role[:1] or "?", f"{role}:{text}", late))
            edits += [("R", r[0], f"{r}:{text}", 2 + late) for r in ("user", "assistant")]
        per_row.append(edits)
    gaps = [inserts] * (len(rows) + 1)
    for chosen in itertools.product(*per_row):
        for put in itertools.product(*gaps):
            audit, said, lines, cost = "", "", [], 0
            for k in range(len(rows) + 1):
                for r in put[k]:
                    audit, said, cost = audit + "I", said + r, cost + 2
                    lines.append({"u": "user:", "a": "assistant:"}[r])
                if k < len(rows):
                    edit, initial, line, price = chosen[k]
                    audit, said, cost = audit + edit, said + initial, cost + price
                    if line is not None:
                        lines.append(line)
            if GOOD.match(said) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, "\n".join(lines))
    return best


def fault_list(rows):
    """Rows (turn, role, text) in order, with their first fault."""
    seen, out = set(), []
    for turn, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
        seen.add((role, text))
        out.append((turn, role, text, fault))
    return out


def brute(table):
    """The query's rows for (conv_id, turn, role, text), through the plain search."""
    conversations = defaultdict(list)
    for conv, turn, role, text in table:
        conversations[conv]
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub(r"[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        conversations[conv] += [(turn, role, text)] * (2 if kind == 3 else 1)
    out = []
    for conv, rows in conversations.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).hexdigest()))
        told = fault_list(rows)
        turns = [t for t, *_ in told if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        initials = [r[:1] for _, r, _, _ in told]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit, said = brute_repair([t[1:] for t in told]) if told else (0, "", "")
        counts = [sum(f == kind for *_, f in told) for kind in ("blank", "duplicate", "truncated")]
        out.append((conv, gaps, *counts, illegal, cost, audit, hashlib.sha256(said.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return sorted((tuple(r) for r in df.select(names).collect()), key=repr)


SCHEMA = "conv_id long, turn long, role string, text string, part int, block string, `fault` string, n int"


def table(spark, rows):
    """With extra columns that clash with the operator's own."""
    return spark.createDataFrame([(*r, 7, "x", "y", n) for n, r in enumerate(rows)], SCHEMA)


def odd_rows(rng, conversations=60):
    roles, texts = ["user", "assistant", "system", "tool", "", None, "u", "agent"], ["Hi.", "Yes!", "no", "", " \n", None, "End?  ", "…", "É.\x0b"]
    rows = []
    for conv in [None, *range(-2, conversations)]:
        for _ in range(rng.randint(1, 3)):
            rows.append((conv, rng.choice([None, 0, 1, 2, 3, 9]), rng.choice(roles), rng.choice(texts)))
    return rows + rows[:3]


def test_odd_rows_equal_a_search_of_all_edits(spark):
    rows = odd_rows(random.Random(5))
    assert got(c.repair(c.damage(table(spark, rows)))) == brute(rows)


@pytest.mark.parametrize("block_rows", [1, 3, 1000])
def test_blocks_of_any_size_give_one_result(spark, block_rows):
    rng = random.Random(3)
    rows = odd_rows(rng, 20)
    # One conversation with most rows, over several ranges.
    rows += [(7, t, ("user", "assistant", "system")[rng.randint(0, 9) % 3], rng.choice(["A.", "B!", "c", "D?"]) + str(t % 50) * (t % 3)) for t in range(600)]
    whole = c.repair(c.damage(table(spark, rows)), block_rows=10 ** 6, block_chars=10 ** 9)
    assert got(c.repair(c.damage(table(spark, rows).repartition(5)), block_rows=block_rows)) == got(whole)


def by_rows(symbols):
    """Least cost and audit by a plain program over single rows, forwards."""
    best = {0: (0, "")}
    offer = lambda d, s, x: d.__setitem__(s, min(d.get(s, x), x))
    for symbol in symbols:
        for _ in range(3):
            for s, (cost, audit) in list(best.items()):
                offer(best, c.NEXT[s], (cost + 2, audit + "I"))
        after = {}
        for s, (cost, audit) in best.items():
            offer(after, s, (cost + 3, audit + "D"))
            if symbol != c.GONE:
                offer(after, c.NEXT[s], (cost + 2 + (symbol & 1), audit + "R"))
                role = symbol >> 1
                to = {0: None if s == 2 else 2, 1: 3 if s == 2 else None, 2: 1 if s == 0 else None, 3: None}[role]
                if to is not None:
                    offer(after, to, (cost + (symbol & 1), audit + "K"))
        best = after
    return min((cost + c.END[s], audit + "I" * c.TAILS[s]) for s, (cost, audit) in best.items())


def test_runs_equal_single_rows():
    rng = random.Random(9)
    for _ in range(300):
        symbols = bytes(s for _ in range(rng.randint(0, 6)) for s in [rng.randint(0, 8)] * rng.choice([1, 1, 2, 5, 17]))
        assert c.solve(symbols) == by_rows(symbols)


def test_a_matrix_stands_for_its_rows():
    rng = random.Random(2)
    for _ in range(50):
        a, b = (bytes(rng.randint(0, 8) for _ in range(rng.randint(0, 9))) for _ in range(2))
        costs = c.before(c.product(c.matrix_of(a), c.matrix_of(b)), c.END)
        assert costs[0] == c.solve(a + b)[0]


def test_query_equals_a_plain_program(spark, sf):
    want = {}
    for conv, turn, role, text in [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]:
        want.setdefault(conv, []).append((turn, role, text))
    rows = {r.conv_id: r for r in c.q_conversations(spark, sf).collect()}
    assert set(rows) == set(want)
    for conv, turns in want.items():
        damaged = []
        for turn, role, text in sorted(turns):
            kind = zlib.crc32(f"{conv}:{turn}".encode()) % 20
            text = "" if kind == 1 else re.sub(r"[.!?]", "", text) if kind == 2 else text
            damaged += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
        symbols = bytes(c.GONE if f in ("blank", "duplicate") else 2 * "uas".index(r[0]) + (f == "truncated") for _, r, _, f in fault_list(damaged))
        assert (rows[conv].cost, rows[conv].audit) == by_rows(symbols)


def test_repaired_turns_are_well_formed(spark):
    rows = odd_rows(random.Random(8), 30) + [(3, t, "user", f"text {t}.") for t in range(100)]
    damaged = c.damage(table(spark, rows))
    told = {r.conv_id: r for r in c.repair(damaged, block_rows=7).collect()}
    turns = defaultdict(list)
    for r in c.repaired_turns(damaged, block_rows=7).collect():
        turns[r.conv_id].append(((r.part, r.block, r.place), r.role, r.text))
    for conv, row in told.items():
        said = [(role, text) for _, role, text in sorted(turns[conv])]
        assert GOOD.match("".join(role[0] for role, _ in said))
        assert hashlib.sha256("\n".join(f"{r}:{t}" for r, t in said).encode()).hexdigest() == row.repaired_sha256


def test_empty_table_and_a_conversation_that_is_dropped_whole(spark):
    assert c.repair(c.damage(table(spark, []))).count() == 0
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    row = c.repair(c.damage(table(spark, [(gone, 0, "user", "Hi.")]))).first()
    assert (row.gaps, row.blank, row.cost, row.audit, row.repaired_sha256) == (0, 0, 0, "", hashlib.sha256(b"").hexdigest())
