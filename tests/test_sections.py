import random

import pytest
from conftest import rows

from docketry.checks.inputs import conversation_items
from docketry.operators.sections import attach_sections, attach_sections_join, section_headers

SCHEMA = "doc_id string, row_idx bigint, label string, text string"


def items(spark, **documents):
    """Documents as strings: `h` header, `t` text, `n` null label, `.` gap."""
    kinds = {"h": "section_header", "t": "text", "n": None}
    data = [
        (doc, i, kinds[c], f"{doc}{i}") for doc, labels in documents.items() for i, c in enumerate(labels) if c != "."
    ]
    return spark.createDataFrame(data, SCHEMA)


def brute(documents, keep_last=False):
    out = []
    for doc, labels in documents.items():
        heads = [i for i, c in enumerate(labels) if c == "h"]
        for i, c in enumerate(labels):
            if c in "h.":
                continue
            before = [h for h in heads if h < i]
            after = [h for h in heads if h > i]
            if before and (after or keep_last):
                out.append((doc, i, f"{doc}{i}", f"{doc}{before[-1]}", before[-1], after[0] if after else None))
    return sorted(out, key=repr)


def test_edge_rows(spark):
    df = items(spark, a="thtthhtht", one="ttht", none="ttt")
    want = [("a", 2, 1, 4), ("a", 3, 1, 4), ("a", 6, 5, 7)]
    assert rows(attach_sections(df), "doc_id", "index_x", "index_y", "previous_section_index") == want
    assert rows(attach_sections_join(df), "doc_id", "index_x", "index_y", "previous_section_index") == want


def test_headers(spark):
    df = items(spark, a="thtthhtht", one="ttht")
    want = [("a", 1, "a1", 4), ("a", 4, "a4", 5), ("a", 5, "a5", 7), ("a", 7, "a7", None), ("one", 2, "one2", None)]
    assert rows(section_headers(df)) == want
    for block in (1, 2, 3):
        assert rows(section_headers(df, block_rows=block)) == want


def test_empty_input(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert attach_sections(empty).count() == attach_sections_join(empty).count() == 0


@pytest.mark.parametrize("block", [1, 2, 5, 16, 65_536])
def test_blocks_do_not_change_the_result(spark, block):
    rng = random.Random(block)
    documents = {f"d{i}": "".join(rng.choices("htn.", [1, 6, 1, 2], k=rng.randint(1, 60))) for i in range(12)}
    documents["long"] = "h" + "t" * 70 + "h" + "t" * 50 + "hh" + "t" * 9
    df = items(spark, **documents)
    assert rows(attach_sections(df, block_rows=block)) == brute(documents)
    assert rows(attach_sections_join(df, bin_rows=block, block_rows=block)) == brute(documents)
    assert rows(attach_sections(df, keep_last_section=True, block_rows=block)) == brute(documents, True)


def test_null_text_is_empty_section(spark):
    df = spark.createDataFrame(
        [("a", 0, "section_header", None), ("a", 1, "text", "x"), ("a", 2, "section_header", "s")], SCHEMA
    )
    for attach in (attach_sections, attach_sections_join):
        assert rows(attach(df), "text", "section") == [("x", "")]


def test_several_keys(spark):
    df = items(spark, a="hth", b="hth").selectExpr("'f' || doc_id AS file", "'1' AS doc_id", "row_idx", "label", "text")
    keys = ("file", "doc_id")
    assert rows(attach_sections(df, keys), *keys, "text") == [("fa", "1", "a1"), ("fb", "1", "b1")]


def test_window_and_join_agree_on_conversations(spark, sf):
    df = conversation_items(spark, sf)
    got = rows(attach_sections(df))
    assert got and got == rows(attach_sections_join(df)) == rows(attach_sections(df, block_rows=2))
