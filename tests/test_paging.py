import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from docketry import schemas
from docketry.operators.paging import (
    assemble_documents,
    first_documents,
    page_index,
    page_range_slice,
    page_stamps,
    unconverted,
)
from docketry.sources.pages import pages_by_break, pages_by_lines

F1, F2 = "gs://b/raw/cases_pdf/a.b.pdf", "gs://b/raw/cases_pdf/x/two.pdf"


def pages(spark, data):
    return spark.createDataFrame(data, schemas.PAGE)


@pytest.mark.parametrize(
    "text, strict, loose",
    [
        ("x Num. 12 - Pág. 3 y", ("12", "3"), ("12", "3")),
        ("NumX 12 - PágY 3", None, ("12", "3")),
        ("Num. 0 - Pág. 1", None, None),
        ("Num. 05 - Pág. 1", None, None),
        ("Num. 5 - Pág. 01", None, None),
        ("Num. 7 - Pág. 1 Num. 8 - Pág. 2", ("7", "1"), ("7", "1")),
        ("Num. 12 - Pag. 3", None, None),
        ("", None, None),
        (None, None, None),
    ],
)
def test_stamp_forms(spark, text, strict, loose):
    df = pages(spark, [(F1, 1, text)])
    for form, want in ((False, strict), (True, loose)):
        assert rows(page_stamps(df, form), "doc_id", "piece_page") == ([want] if want else [])


def sample(spark):
    return pages(spark, [
        (F1, 1, "Num. 5 - Pág. 1"),
        (F1, 2, "no stamp"),
        (F1, 3, "Num. 6 - Pág. 1"),
        (F1, 4, "Num. 5 - Pág. 2"),
        (F1, 5, None),
        (F1, 6, "Num. 9 - Pág. 1"),
        (F2, 1, "nothing"),
        (F2, 2, "Num. 5 - Pág. 1"),
    ])


def test_index_and_slice(spark):
    index = page_index(page_stamps(sample(spark)))
    assert rows(index, "file_path", "doc_id", "min_page", "max_page") == [
        (F1, "5", 1, 4), (F1, "6", 3, 3), (F1, "9", 6, 6), (F2, "5", 2, 2),
    ]
    sliced = page_range_slice(sample(spark), index)
    # Page 2 has no stamp, page 3 belongs to two documents, page 5 lies in no range.
    assert rows(sliced, "file_path", "doc_id", "page") == [
        (F1, "5", 1), (F1, "5", 2), (F1, "5", 3), (F1, "5", 4), (F1, "6", 3), (F1, "9", 6), (F2, "5", 2),
    ]


def test_no_stamp_gives_empty_results(spark):
    index = page_index(page_stamps(pages(spark, [(F1, 1, "plain")])))
    assert index.count() == 0
    assert assemble_documents(page_range_slice(sample(spark), index)).count() == 0


@pytest.mark.parametrize("bin_pages", [1, 2, 7, 64])
def test_slice_equals_plain_range_join(spark, bin_pages):
    rng = random.Random(bin_pages)
    data = pages(spark, [(f"f{f}", p, "") for f in range(3) for p in range(1, 60)])
    ranges = []
    for i in range(25):
        lo = rng.randint(1, 59)
        ranges.append((f"f{rng.randrange(3)}", str(i), lo, min(59, lo + rng.randint(0, 30))))
    want = sorted((f, d, p) for f, d, lo, hi in ranges for p in range(lo, hi + 1))
    frame = spark.createDataFrame(ranges, "file_path string, doc_id string, min_page bigint, max_page bigint")
    got = rows(page_range_slice(data, frame, bin_pages), "file_path", "doc_id", "page")
    assert sorted(got) == want


def test_first_documents_per_file(spark):
    index = spark.createDataFrame(
        [(f, str(100 - i), i, i) for f in ("a", "b") for i in range(1, 8)] + [("c", "1", 4, 9)],
        "file_path string, doc_id string, min_page bigint, max_page bigint",
    )
    got = rows(first_documents(index), "file_path", "min_page")
    assert got == [(f, i) for f in ("a", "b") for i in range(1, 5)] + [("c", 4)]


def test_documents_are_whole_whatever_the_part_size(spark):
    index = page_index(page_stamps(sample(spark)))
    sliced = page_range_slice(sample(spark), index)
    whole = rows(assemble_documents(sliced), "file_path", "doc_id", "markdown")
    assert whole[0] == (F1, "5", "Num. 5 - Pág. 1\n\nno stamp\n\nNum. 6 - Pág. 1\n\nNum. 5 - Pág. 2")
    parts = assemble_documents(sliced, part_bytes=20, block_pages=2)
    five = rows(parts.filter("doc_id = '5' AND stem = 'a.b'"), "part", "n_parts")
    assert five == [(0, 3), (1, 3), (2, 3)]
    joined = parts.groupBy("file_path", "doc_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "markdown"))), lambda p: p["markdown"]), "\n\n").alias("m")
    )
    assert rows(joined) == whole
    assert parts.select("object_path").distinct().count() == parts.count()
    assert rows(parts.filter("stem = 'a.b' AND doc_id = '5'"), "object_path") == [(f"raw/cases_md/a.b/5{p}.md",) for p in ("", ".part1", ".part2")]


def test_skip_is_by_full_path(spark):
    index = page_index(page_stamps(sample(spark)))
    done = spark.createDataFrame([(F1, "5"), ("gs://b/other/two.pdf", "5")], "file_path string, doc_id string")
    assert rows(unconverted(index, done), "file_path", "doc_id") == [(F1, "6"), (F1, "9"), (F2, "5")]


def test_pages_from_text(spark):
    docs = spark.createDataFrame([(1, "a\nb\nc\nd\ne"), (2, ""), (3, None)], "doc_id bigint, text string")
    assert rows(pages_by_lines(docs, "doc_id", "text", 2)) == [
        (1, 1, "a\nb"), (1, 2, "c\nd"), (1, 3, "e"), (2, 1, ""), (3, 1, ""),
    ]
    broken = spark.createDataFrame([(1, "p1\fp2\f\fp4"), (2, None)], "doc_id bigint, text string")
    assert rows(pages_by_break(broken, "doc_id", "text")) == [
        (1, 1, "p1"), (1, 2, "p2"), (1, 3, ""), (1, 4, "p4"), (2, 1, ""),
    ]
