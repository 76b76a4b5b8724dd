import hashlib
import re

from docketry.llm import decontaminate as d
from llm_data import ODD, odd_documents

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def cut(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(documents, benchmark):
    """Every window against every position."""
    windows = {}
    for item, text in benchmark:
        w = cut(text)
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k:k + n]), set()).add(str(item))
    out = []
    for doc_id, text in documents:
        w, hit, items = cut(text), set(), set()
        for length in {len(x) for x in windows}:
            for k in range(len(w) - length + 1):
                found = windows.get(tuple(w[k:k + length]))
                if found:
                    hit.update(range(k, k + length))
                    items |= found
        out.append((doc_id, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_query_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    bench = spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()
    assert rows(d.q_decontaminate(spark, sf)) == brute(docs, bench)


BENCH = [(1, "a b c d e f g h i j k l m n"), (2, "a b c d e f g h i j k l m n"), (3, None), (4, ""), (5, "one, two!"), (6, "日本語"), (None, "text"), (10, LONG := "lorem ipsum dolor sit amet " * 5)]


def test_odd_rows(spark):
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    want = brute(ODD, [b for b in BENCH if b[0] is not None])
    assert rows(d.decontaminate(odd_documents(spark), bench)) == want
    # The same in several broadcast blocks.
    assert rows(d.decontaminate(odd_documents(spark), bench, block_limit=200)) == want


def test_empty_tables(spark):
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    assert d.decontaminate(odd_documents(spark, []), bench).count() == 0
    clean = d.decontaminate(odd_documents(spark), bench.limit(0))
    assert clean.count() == len(ODD) and clean.where("contaminated").count() == 0


def test_removing(spark):
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    docs = odd_documents(spark)
    bad = {r[0] for r in brute(ODD, [b for b in BENCH if b[0] is not None]) if r[-1]}
    kept = d.remove_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted((i for i, _ in ODD if i not in bad), key=repr)
    cut_texts = {r.doc_id: r.text for r in d.remove_contaminated(docs, bench, spans=True).collect()}
    assert cut_texts[5] == "" and cut_texts[9].split() == ["o", "p"] and cut_texts[4] == "one" and cut_texts[1] is None
