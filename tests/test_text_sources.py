import os
import subprocess
import sys

import pytest
from conftest import rows
from pyspark.sql import functions as F, types as T

from docketry import schemas
from docketry.functions import paths
from docketry.operators.messages import count_attempts, dead_letter_split, document_messages
from docketry.sources.envelopes import decode_envelopes, encode_envelopes, split_decoded
from docketry.sources.markup import html_text_items
from docketry.sources.objects import object_inventory, read_objects
from docketry.sources.tables import distinct_prefixes, find_table, find_table_folder, read_table
from docketry.sinks.catalog import replace_table, table_path
from docketry.sinks.objects import write_objects
from docketry.sinks.versions import outdated


@pytest.mark.parametrize(
    "uri, bucket, path",
    [
        ("gs://b", "b", ""),
        ("gs://b/", "b", ""),
        ("gs://b/x/y.pdf", "b", "x/y.pdf"),
        ("https://h.example/en/1?x=a/b", "h.example", "en/1?x=a/b"),
    ],
)
def test_uri(spark, uri, bucket, path):
    got = spark.createDataFrame([(uri,)], "u string").select(paths.uri_bucket(F.col("u")), paths.uri_path(F.col("u"))).first()
    assert tuple(got) == (bucket, path)


@pytest.mark.parametrize(
    "path, last, stem",
    [
        ("a/b//", "b", "b"),
        ("x/a.b.pdf", "a.b.pdf", "a.b"),
        ("noext", "noext", "noext"),
        ("d/.hidden", ".hidden", ".hidden"),
        ("d/dot.", "dot.", "dot."),
    ],
)
def test_segments(spark, path, last, stem):
    got = spark.createDataFrame([(path,)], "p string").select(paths.last_segment(F.col("p")), paths.stem(F.col("p"))).first()
    assert tuple(got) == (last, stem)


def page(spark, *html, url="http://h.example/en/1"):
    return spark.createDataFrame([(i, url, h) for i, h in enumerate(html)], "page_id bigint, url string, html string")


def test_markup_items(spark):
    html = (
        "<html><head><title>T</title></head><body><script>var t='</p>';</script><!-- <p>no</p> -->"
        "<h1 class=a>Head &amp; <b>bold</b></h1><p>one<br>two<p>three <i>it</i></p>"
        "<ul><li>x</li><li></li><li>&lt;y&gt;</ul><footer>end</footer></body></html>"
    )
    assert rows(html_text_items(page(spark, html)), "row_idx", "self_ref", "label", "text") == [
        (0, "#/texts/0", "section_header", "Head & bold"),
        (1, "#/texts/1", "text", "one two"),
        (2, "#/texts/2", "text", "three it"),
        (3, "#/texts/3", "list_item", "x"),
        (4, "#/texts/4", "list_item", "<y>"),
        (5, "#/texts/5", "text", "end"),
    ]


def test_markup_without_text(spark):
    assert html_text_items(page(spark, None, "", "<p></p>")).count() == 0


@pytest.mark.parametrize("block_pages", [1, 3, 4096])
def test_items_are_numbered_through_a_host(spark, block_pages):
    df = page(spark, *[f"<h1>h{i}</h1><p>a{i}</p><p>b{i}</p>" for i in range(8)])
    got = rows(html_text_items(df, block_pages), "row_idx", "text")
    want = [f"{kind}{i}" for i in range(8) for kind in ("h", "a", "b")]
    assert sorted(got) == list(enumerate(want))


EVENT = T.StructType([T.StructField("bucket", T.StringType()), T.StructField("n", T.LongType())])


def test_envelopes(spark):
    payloads = ['{"bucket":"b","n":1}', '{"bucket":"ç","n":2,"extra":true}', '{"n":3}', "{broken", "[1]"]
    wrapped = encode_envelopes(spark.createDataFrame([(p,) for p in payloads], "json string"), "json").select("envelope")
    raw = ['{"message":{"data":"%%%"}}', '{"message":{}}', "garbage", None, '{"message":{"data":"/////w=="}}']
    everything = wrapped.union(spark.createDataFrame([(r,) for r in raw], "envelope string"))
    good, bad = split_decoded(decode_envelopes(everything, EVENT))
    assert rows(good, "payload.bucket", "payload.n") == [("b", 1), ("ç", 2)]
    reasons = [r[0] for r in rows(bad, "reason")]
    assert reasons == sorted(["missing key", "bad json", "bad json", "bad encoding", "bad encoding", "no data", "no data", "no data"])


def test_messages_round_trip(spark):
    index = spark.createDataFrame(
        [("gs://b/raw/cases_pdf/x.pdf", "12", 3, 9)], "file_path string, doc_id string, min_page bigint, max_page bigint"
    )
    value = document_messages(index).first()["value"]
    assert value == '{"doc_id":"12","min_page":3,"max_page":9,"bucket":"b","file_path":"raw/cases_pdf/x.pdf"}'
    back = spark.createDataFrame([(value,)], "value string").select(F.from_json("value", schemas.DOCUMENT_MESSAGE).alias("m"))
    assert tuple(back.select("m.*").first()) == ("12", 3, 9, "b", "raw/cases_pdf/x.pdf")


def test_dead_letters(spark):
    failures = spark.createDataFrame([("m1",)] * 4 + [("m2",)] * 5 + [("m3",)] * 9, "message string")
    retry, dead = dead_letter_split(count_attempts(failures))
    assert rows(retry) == [("m1", 4)] and rows(dead) == [("m2", 5), ("m3", 9)]


def test_objects(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.txt").write_bytes(b"hello")
    (tmp_path / "b.bin").write_bytes(b"xx")
    assert rows(object_inventory(spark, str(tmp_path), "*.txt"), "size") == [(5,)]
    assert bytes(read_objects(spark, str(tmp_path), "*.txt").first()["content"]) == b"hello"
    plan = object_inventory(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "content" not in plan.split("Relation")[0]


def test_find_table(spark):
    replace_table(spark.range(3), "found_ns", "t")
    assert find_table(spark, "found_ns", "t") == "found_ns.t"
    assert read_table(spark, "found_ns", "t").count() == 3
    for namespace, table in (("found_ns", "u"), ("absent_ns", "t")):
        with pytest.raises(ValueError):
            find_table(spark, namespace, table)


def test_find_table_folder(spark):
    listing = spark.createDataFrame([("bronze/ab12_default$products/",), ("bronze/cd_default$cases/",)], "prefix string")
    assert find_table_folder(listing, "default", "cases") == "bronze/cd_default$cases"
    with pytest.raises(ValueError):
        find_table_folder(listing, "default", "other")


def test_replace_table(spark):
    name = replace_table(spark.range(3), "swap_ns", "t")
    # The new rows may be computed from the rows they replace, with another schema.
    replace_table(spark.table(name).selectExpr("id + 1 AS id", "'x' AS tag"), "swap_ns", "t")
    assert rows(spark.table(name)) == [(1, "x"), (2, "x"), (3, "x")]
    # Replaced versions are emptied once their time is over.
    replace_table(spark.range(1), "swap_ns", "t", retention_s=0)
    path = table_path(spark, "swap_ns", "t")
    assert outdated(spark, path, 0) == [] and rows(spark.table(name)) == [(0,)]


def test_readers_bear_a_replace(spark):
    name = replace_table(spark.range(3), "reader_ns", "t")
    reader = spark.table(name)
    replace_table(spark.range(9), "reader_ns", "t")
    assert reader.count() == 3 and read_table(spark, "reader_ns", "t").count() == 9


def test_a_plain_table_gives_way(spark):
    spark.sql("CREATE NAMESPACE IF NOT EXISTS plain_ns")
    spark.range(2).write.mode("overwrite").saveAsTable("plain_ns.t")
    assert spark.table(replace_table(spark.range(5), "plain_ns", "t")).count() == 5


OTHER_SESSION = """
import sys
sys.path.insert(0, {root!r})
from docketry.session import build_session
from docketry.sources.tables import read_table
spark = build_session("other", "local[1]", spark__ui__enabled="false", spark__sql__warehouse__dir={warehouse!r})
print("rows", read_table(spark, "shared_ns", "t").count())
"""


def test_another_session_reads_the_table(spark, tmp_path):
    replace_table(spark.range(7), "shared_ns", "t")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    script = OTHER_SESSION.format(root=root, warehouse=spark.conf.get("spark.sql.warehouse.dir"))
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, capture_output=True, text=True, timeout=200)
    assert "rows 7" in done.stdout, done.stderr[-2000:]


def test_objects_are_created_once(spark, tmp_path):
    one = spark.createDataFrame([("a/x.md", b"one"), ("a/y.md", b""), ("b/z.md", None)], "object_path string, content binary")
    two = spark.createDataFrame([("a/x.md", b"two"), ("c.md", b"new")], "object_path string, content binary")
    assert rows(write_objects(one, str(tmp_path / "o"))) == [("a/x.md", True), ("a/y.md", True), ("b/z.md", True)]
    assert rows(write_objects(two, str(tmp_path / "o"))) == [("a/x.md", False), ("c.md", True)]
    assert (tmp_path / "o/a/x.md").read_bytes() == b"one" and (tmp_path / "o/b/z.md").read_bytes() == b""


def test_failed_replace_keeps_the_old_rows(spark):
    name = replace_table(spark.range(2), "keep_ns", "t")
    with pytest.raises(Exception):
        replace_table(spark.range(2).select(F.raise_error(F.lit("no")).cast("bigint").alias("id")), "keep_ns", "t")
    assert rows(spark.table(name)) == [(0,), (1,)]


def test_distinct_prefixes(spark):
    df = spark.createDataFrame([("gs://b/x/1",), ("gs://b/x/2/3",), ("gs://b/top",), ("gs://c/x/1",), ("gs://c",)], "u string")
    assert rows(distinct_prefixes(df, "u")) == [("b", "x/"), ("c", "x/")]
