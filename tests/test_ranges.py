import pytest
from conftest import rows

from docketry import schemas
from docketry.checks import inputs
from docketry.operators.paging import assemble_documents, page_index, page_range_slice, page_stamps
from docketry.session import new_folder
from docketry.sinks.files import write_pages
from docketry.streaming.arrivals import Layout
from docketry.streaming.ranges import converted_path, current_ranges, read_versions, start_range_stream, start_version_stream

DOC = ("file_path", "doc_id", "part", "markdown")
FILE = "gs://lake/raw/cases_pdf/x.pdf"


def deliver(spark, layout, pages, max_files=2560):
    write_pages(spark.createDataFrame(pages, schemas.PAGE), layout.pages)
    start_range_stream(spark, layout, max_files).awaitTermination()
    start_version_stream(spark, layout).awaitTermination()


def told(spark, layout):
    return rows(current_ranges(spark, layout), "doc_id", "min_page", "max_page")


def test_pages_of_one_file_in_several_batches(spark):
    layout = Layout(new_folder(spark, "stream"))
    page = lambda p, doc: (FILE, p, f"page {p} Num. {doc} - Pág. {p}")
    deliver(spark, layout, [page(3, 7), page(4, 7), page(9, 8)])
    assert told(spark, layout) == [("7", 3, 4), ("8", 9, 9)]
    deliver(spark, layout, [page(2, 7), page(6, 7)])
    assert told(spark, layout) == [("7", 2, 6), ("8", 9, 9)]
    # A page without a stamp in the middle widens nothing, and no document is written again.
    deliver(spark, layout, [(FILE, 5, "no stamp")])
    assert told(spark, layout) == [("7", 2, 6), ("8", 9, 9)]
    written = rows(read_versions(spark, layout), "doc_id", "markdown")
    whole = "\n\n".join(f"page {p} Num. 7 - Pág. {p}" for p in (2, 3, 4, 6))
    assert written == [("7", whole), ("8", "page 9 Num. 8 - Pág. 9")]
    assert spark.read.parquet(converted_path(layout)).count() == 3


@pytest.mark.parametrize("max_files", [3, 2560])
def test_any_order_ends_with_the_batch_result(spark, sf, max_files):
    layout = Layout(new_folder(spark, "stream"))
    pages = inputs.file_pages(spark, sf).select("file_path", "page", "page_text")
    for part in (1, 0):
        write_pages(pages.filter(pages.page % 2 == part), layout.pages)
        start_range_stream(spark, layout, max_files).awaitTermination()
        start_version_stream(spark, layout).awaitTermination()
    index = page_index(page_stamps(pages))
    assert rows(current_ranges(spark, layout), "file_path", "doc_id", "min_page", "max_page") == rows(index, "file_path", "doc_id", "min_page", "max_page")
    final = rows(assemble_documents(page_range_slice(pages, index)), *DOC)
    grown = rows(read_versions(spark, layout), *DOC)
    assert [r[:3] for r in grown] == [r[:3] for r in final]
    # Documents whose range the later pages widened are whole.
    first = {r[:2]: r[2:] for r in rows(page_index(page_stamps(pages.filter("page % 2 = 1"))), "file_path", "doc_id", "min_page", "max_page")}
    last = {r[:2]: r[2:] for r in rows(index, "file_path", "doc_id", "min_page", "max_page")}
    changed = {k for k in last if first.get(k) != last[k]}
    assert changed and [r for r in grown if r[:2] in changed] == [r for r in final if r[:2] in changed]


def test_a_batch_run_again_replaces_its_output(spark):
    import os

    layout = Layout(new_folder(spark, "stream"))
    deliver(spark, layout, [(FILE, p, f"Num. 7 - Pág. {p}") for p in (1, 2)])
    for name in ("ranges", "versions"):
        commits = f"{layout.checkpoint(name)}/commits"
        last = max((f for f in os.listdir(commits) if f.isdigit()), key=int)
        os.remove(f"{commits}/{last}")
        os.remove(f"{commits}/.{last}.crc") if os.path.exists(f"{commits}/.{last}.crc") else None
    start_range_stream(spark, layout).awaitTermination()
    start_version_stream(spark, layout).awaitTermination()
    assert told(spark, layout) == [("7", 1, 2)] and len(rows(read_versions(spark, layout), *DOC)) == 1


def test_nothing_yet(spark):
    layout = Layout(new_folder(spark, "stream"))
    assert current_ranges(spark, layout).count() == 0 and read_versions(spark, layout).count() == 0
