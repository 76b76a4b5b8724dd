"""Long words around identifiers, and texts of very many numbers."""

import random
import time

from docketry.llm import personal_data as p
from test_personal_data import brute


def found(spark, rows):
    return {r.doc_id: r.spans for r in p.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def test_a_word_of_any_length_makes_a_pattern(spark):
    address = "https://example.org/" + "path/" * 20
    other = address + "x"
    rows = [(i, f"see {address} +1 (2{i:02d}) 555-01{i:02d} now") for i in range(12)] + [(50, f"see {address} 5550199 now"), (51, f"see {other} 5550198 now")]
    out = found(spark, rows)
    at = len("see ") + len(address) + 1
    assert out[50] == f"phone:{at}:{at + 7}" and out[51] == ""


def test_a_text_of_very_many_numbers(spark):
    text = " ".join(str(100000 + i) for i in range(200_000))
    start = time.time()
    row = p.personal_data(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert time.time() - start < 60
    assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == brute(text)[0]


def test_very_many_spans(spark):
    rng = random.Random(1)
    parts = [rng.choice(["a@b.co", "1.2.3.4", "word", "12345", "+49 30 123456", "née"]) for _ in range(20_000)]
    text = " ".join(parts)
    row = p.personal_data(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    counts, spans = brute(text)
    assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == counts and set(spans.split(",")) <= set(row.spans.split(","))
    # Each span that starts where no earlier one is still open gives its mark.
    masked = p.mask(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().text
    want, at = [], 0
    for span in row.spans.split(","):
        kind, a, b = span.split(":")
        a, b = int(a), int(b)
        if a >= at:
            want += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    assert masked == "".join(want) + text[at:]


def test_sums_before_each_number(spark):
    values = [(i, [(7 * k + i) % 50 for k in range(i)]) for i in (0, 1, 2, 63, 64, 65, 128, 1000)]
    frame = spark.createDataFrame(values, "i int, v array<int>")
    out = frame.select("i", "v", p.earlier(frame.v, lambda a, x: a + x).alias("s")).collect()
    assert all(r.s == [sum(r.v[:k]) for k in range(r.i)] for r in out)
