import hashlib
import re

from docketry.llm import personal_data as p
from llm_data import ODD, odd_documents

# The base patterns as the contract states them.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, value):
    digits = [int(c) for c in value if c.isdigit()]
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "phone":
        return 9 <= len(digits) <= 15
    if kind == "card":
        doubled = [d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(reversed(digits))]
        return 12 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return True


def brute(text):
    spans = sorted((m.start(), rank, m.end()) for rank, kind in enumerate(p.KINDS) for m in re.finditer(PLAIN[kind], text or "") if passes(kind, m[0]))
    return [sum(s[1] == r for s in spans) for r in range(4)], ",".join(f"{p.KINDS[r]}:{a}:{b}" for a, r, b in spans)


TRICKY = [
    "a@b.c_x@d.e", "x@y.z@w.v", "a@b..c", "@b.c a@b a@-.-", "é.a@b.co über 1.2.3.4.5.6.7.8", "256.1.1.1 1.2.3.256 001.02.3.4 1.2.3.0000255",
    "4539 1488 0343 6467 and 4539-1488-0343-6467", "4539148803436467" * 2, "4539  1488 0343 6467", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 8 9 0 1",
    "+1 (017) 555-7713 +49 30 123456 +1", "++1 234 567 890", "+123456789012345678", "x" * 50000 + "@", "1" * 30000, "1." * 20000, "a@" * 3000,
    "+" + "1 " * 3000, "", "no data", "٣٤٥ ３４５", "a@b.c,d@e.f;\n1.1.1.1\t2.2.2.2",
]


def test_base_spans_equal_plain_patterns(spark):
    rows = list(enumerate(TRICKY)) + [(100 + i, t) for i, (_, t) in enumerate(ODD)]
    out = {r.doc_id: r for r in p.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        counts, spans = brute(text)
        assert [out[i].n_email, out[i].n_ip, out[i].n_card, out[i].n_phone] == counts, text[:80] if text else text
        assert out[i].base_sha256 == hashlib.sha256(spans.encode()).hexdigest(), text[:80] if text else text


def test_query_equals_plain_patterns(spark, sf):
    out = {r.doc_id: r for r in p.q_personal_data(spark, sf).collect()}
    for i, text in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        counts, spans = brute(text)
        assert out[i].base_sha256 == hashlib.sha256(spans.encode()).hexdigest()
        assert set(filter(None, spans.split(","))) <= set(filter(None, out[i].spans.split(",")))


def contexts(spark):
    """Seeds after `call me`, an unknown number there, and the same kind of string elsewhere."""
    rows = [(i, f"please call me +1 (2{i:02d}) 555-01{i:02d} soon") for i in range(12)]
    rows += [(50, "please call me 5550199 soon"), (51, "order of 5550188 pieces"), (52, "please call me 5550199, soon")]
    return rows


def test_patterns_find_unseen_identifiers(spark):
    rows = contexts(spark)
    out = {r.doc_id: r.spans for r in p.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[50] == "phone:15:22" and out[52] == "phone:15:22" and out[51] == ""
    assert all(out[i].startswith("phone:15:") for i in range(12))


def test_copies_lend_no_support(spark):
    rows = [(i, "please call me +1 (234) 555-0100 soon") for i in range(40)] + [(50, "please call me 5550199 soon")]
    out = {r.doc_id: r.spans for r in p.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[50] == ""


def test_masking(spark):
    docs = odd_documents(spark, contexts(spark) + [(90, "a@b.co at 1.2.3.4"), (91, None), (92, "plain")])
    out = p.mask(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    texts = {r.doc_id: r.text for r in out.collect()}
    assert texts[90] == "<EMAIL> at <IP>" and texts[50] == "please call me <PHONE> soon" and texts[0] == "please call me <PHONE> soon"
    assert texts[91] is None and texts[92] == "plain" and texts[51] == "order of 5550188 pieces"


def test_odd_rows_and_nothing(spark):
    assert p.personal_data(odd_documents(spark)).count() == len(ODD)
    assert p.personal_data(odd_documents(spark, [])).count() == 0
    assert p.mask(odd_documents(spark, [])).count() == 0


def test_main_path_has_no_python(spark, sf):
    plan = p.base_spans(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
