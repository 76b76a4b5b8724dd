import json

import pytest
from conftest import rows

from docketry.checks import inputs
from docketry.operators.messages import count_attempts, dead_letter_split
from docketry.operators.paging import assemble_documents, page_index, page_range_slice, page_stamps
from docketry import schemas
from docketry.session import new_folder
from docketry.sinks.files import write_pages
from docketry.sources.envelopes import encode_envelopes
from docketry.streaming.arrivals import Layout, outstanding, read_failures, redeliver, start_index_stream
from docketry.streaming.convert import decode_messages, read_markdown, start_convert_stream

DOC = ("file_path", "doc_id", "part", "markdown")


def batch_documents(spark, sf):
    pages = inputs.file_pages(spark, sf).select("file_path", "page", "page_text")
    return assemble_documents(page_range_slice(pages, page_index(page_stamps(pages))))


def run(spark, layout, max_files):
    start_index_stream(spark, layout, max_files).awaitTermination()
    start_convert_stream(spark, layout, max_files).awaitTermination()


@pytest.mark.parametrize("max_files", [1, 100])
def test_stream_equals_batch(spark, sf, max_files):
    layout = inputs.install_stream(spark, sf)
    run(spark, layout, max_files)
    want = rows(batch_documents(spark, sf), *DOC)
    assert want and rows(read_markdown(spark, layout), *DOC) == want


def announce(spark, layout, names):
    events = spark.createDataFrame([(json.dumps({"bucket": "lake", "name": n}),) for n in names], "json string")
    encode_envelopes(events, "json").select("envelope").coalesce(1).write.mode("append").parquet(layout.arrivals)


def test_repeats_and_restarts_write_nothing_twice(spark, sf):
    layout = inputs.install_stream(spark, sf)
    run(spark, layout, 100)
    first = rows(read_markdown(spark, layout), *DOC)
    # The same file announced again, twice in one batch, on the same checkpoint.
    announce(spark, layout, ["raw/cases_pdf/batch.0.pdf"] * 2)
    run(spark, layout, 100)
    assert rows(read_markdown(spark, layout), *DOC) == first
    # Everything again on a fresh checkpoint of the converter.
    start_convert_stream(spark, Layout(layout.root, generation="2")).awaitTermination()
    assert rows(read_markdown(spark, layout), *DOC) == first


def test_a_batch_run_again_replaces_its_output(spark, sf):
    layout = inputs.install_stream(spark, sf)
    run(spark, layout, 100)
    first = rows(read_markdown(spark, layout), *DOC)
    # A batch that was not committed is run again by the next start.
    import os

    for name in ("index", "convert"):
        commits = f"{layout.checkpoint(name)}/commits"
        last = max((f for f in os.listdir(commits) if f.isdigit()), key=int)
        os.remove(f"{commits}/{last}")
        os.remove(f"{commits}/.{last}.crc") if os.path.exists(f"{commits}/.{last}.crc") else None
    start_convert_stream(spark, layout).awaitTermination()
    assert rows(read_markdown(spark, layout), *DOC) == first
    run(spark, layout, 100)
    assert rows(read_markdown(spark, layout), *DOC) == first


def test_prefix_and_bad_messages(spark, sf):
    layout = Layout(new_folder(spark, "stream"))
    pages = inputs.file_pages(spark, sf).select("file_path", "page", "page_text")
    write_pages(pages, layout.pages)
    announce(spark, layout, ["raw/other/batch.0.pdf", "raw/cases_pdf/unknown.pdf"])
    bad = spark.createDataFrame([("not an envelope",)] * 5 + [('{"message":{}}',)], "envelope string")
    bad.write.mode("append").parquet(layout.arrivals)
    run(spark, layout, 100)
    assert read_markdown(spark, layout).count() == 0
    reasons = rows(read_failures(spark, layout).select("reason").distinct())
    assert reasons == [("no data",), ("no such object",)]
    retry, dead = dead_letter_split(count_attempts(read_failures(spark, layout)))
    assert retry.count() == 2 and rows(dead) == [("not an envelope", 5)]


def test_files_with_one_stem_stay_apart(spark, sf):
    layout = Layout(new_folder(spark, "stream"))
    data = [(f"gs://lake/raw/cases_pdf/{d}/x.pdf", p, f"{d} Num. 7 - Pág. {p}") for d in "ab" for p in (1, 2)]
    write_pages(spark.createDataFrame(data, schemas.PAGE), layout.pages)
    announce(spark, layout, ["raw/cases_pdf/a/x.pdf"])
    run(spark, layout, 100)
    announce(spark, layout, ["raw/cases_pdf/b/x.pdf"])
    run(spark, layout, 100)
    assert rows(read_markdown(spark, layout), "file_path", "stem", "markdown") == [
        (f"gs://lake/raw/cases_pdf/{d}/x.pdf", "x", f"{d} Num. 7 - Pág. 1\n\n{d} Num. 7 - Pág. 2") for d in "ab"
    ]


def test_failed_events_come_again_up_to_the_limit(spark, sf):
    layout = Layout(new_folder(spark, "stream"))
    late = [("gs://lake/raw/cases_pdf/late.pdf", 1, "Num. 7 - Pág. 1")]
    write_pages(spark.createDataFrame([("gs://lake/raw/cases_pdf/x.pdf", 1, "none")], schemas.PAGE), layout.pages)
    announce(spark, layout, ["raw/cases_pdf/late.pdf", "raw/cases_pdf/never.pdf"])
    run(spark, layout, 100)
    write_pages(spark.createDataFrame(late, schemas.PAGE), layout.pages)
    for attempt in range(2, 7):
        redeliver(spark, layout)
        run(spark, layout, 100)
        assert rows(read_markdown(spark, layout), "file_path", "doc_id") == [("gs://lake/raw/cases_pdf/late.pdf", "7")]
    retry, dead = outstanding(spark, layout)
    assert retry.count() == 0 and rows(dead, "stage", "attempts") == [("index", 5)]


def test_page_numbers_may_be_strings(spark):
    message = '{"doc_id":"7","min_page":"3","max_page":4,"bucket":"b","file_path":"x.pdf"}'
    rest = ['{"doc_id":"7","min_page":"x","max_page":4,"bucket":"b","file_path":"x.pdf"}', "no json", '{"doc_id":"7"}']
    good, bad = decode_messages(spark.createDataFrame([(m,) for m in [message, *rest]], "value string"))
    assert rows(good) == [("gs://b/x.pdf", "7", 3, 4)] and bad.count() == 3
