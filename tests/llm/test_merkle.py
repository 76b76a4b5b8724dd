import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from docketry.llm import merkle as m
from llm_data import ODD, odd_documents


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def levels(nodes, fan):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i:i + fan]) for i in range(0, len(out[-1]), fan)])
    return out


def others(tree, at, fan):
    for level in tree[:-1]:
        first = at // fan * fan
        yield at - first, level[first:at] + level[at + 1:first + fan]
        at //= fan


def lower(text):
    return None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def brute(rows, fan=8):
    """(doc_id, source, lang, n_chars, text) to the query's rows, with whole trees in memory."""
    trees = defaultdict(list)
    for doc_id, source, lang, n_chars, text in rows:
        changed = lower(text) if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0 else text
        own, now = (H(*[field(v) for v in (doc_id, source, lang, n_chars, t)]) for t in (text, changed))
        trees[lang].append((doc_id is not None, doc_id or 0, own, now, doc_id))
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    built = {lang: levels([leaf for _, _, leaf, _, _ in sorted(trees[lang])], fan) for lang in langs}
    top = levels([built[lang][-1][0] for lang in langs], fan)
    root, out = top[-1][0], []
    for place, lang in enumerate(langs):
        for at, (_, _, own, now, doc_id) in enumerate(sorted(trees[lang])):
            path = [*others(built[lang], at, fan), *others(top, place, fan)]
            folded = now
            for i, run in path:
                folded = H(*run[:i], folded, *run[i:])
            out.append((doc_id, own, built[lang][-1][0], root, H(*[x for _, run in path for x in run]), folded, folded == root))
    return sorted(out, key=repr)


def got(manifest):
    return sorted((tuple(r) for r in manifest.versions().collect()), key=repr)


def rows_of(frame):
    return [tuple(r) for r in frame.select(*[c if c in frame.columns else F.lit(None).alias(c) for c in m.FIELDS]).collect()]


def test_query_equals_whole_trees(spark, sf):
    assert got(m.manifest(spark.read.parquet(f"{sf}/documents.parquet"))) == brute(rows_of(spark.read.parquet(f"{sf}/documents.parquet")))


@pytest.mark.parametrize("fan, depth", [(8, 4), (8, 1), (2, 1), (2, 3), (3, 2)])
def test_any_block_gives_one_tree(spark, fan, depth):
    documents = [(i * 7 % 400, f"s{i % 3}", None if i % 50 == 0 else "en" if i % 3 else f"l{i % 23}", i, f"Text {i}" if i % 11 else None) for i in range(200)]
    frame = spark.createDataFrame(documents, "doc_id long, source string, lang string, n_chars long, text string")
    assert got(m.manifest(frame, fan, depth)) == brute(documents, fan)


def test_odd_rows(spark):
    frame = odd_documents(spark)
    assert got(m.manifest(frame)) == brute(rows_of(frame))
    assert m.manifest(odd_documents(spark, [])).versions().count() == 0
    one = m.manifest(odd_documents(spark, [(5, "Only ONE")])).versions().first()
    assert one.leaf == one.subroot == one.root and one.proof_sha256 == hashlib.sha256(b"").hexdigest()
    assert len(ODD) == m.manifest(frame).versions().count()


def test_lone_languages_beside_a_large_one(spark):
    documents = [(i, "s", "big", 1, f"T{i}") for i in range(70)] + [(1000 + i, "s", f"x{i}", 1, "A") for i in range(12)]
    frame = spark.createDataFrame(documents, "doc_id long, source string, lang string, n_chars long, text string")
    for depth in (1, 2):
        assert got(m.manifest(frame, 8, depth)) == brute(documents)


def test_versions_share_what_they_do_not_change(spark):
    documents = [(i, "s", "en" if i % 4 else "fr", 1, f"Text {i}") for i in range(150)]
    frame = spark.createDataFrame(documents, "doc_id long, source string, lang string, n_chars long, text string")
    for depth in (1, 4):
        built = m.manifest(frame, 8, depth)
        stored = {(r.tree, r.level, r["at"]): r.digest for r in built.nodes().collect()}
        own = defaultdict(dict)
        for doc_id, source, lang, n_chars, text in documents:
            own[f"={lang}"][doc_id] = H(*[field(v) for v in (doc_id, source, lang, n_chars, text)])
        want = {}
        for tree, leaves in own.items():
            for level, nodes in enumerate(levels([leaves[i] for i in sorted(leaves)], 8)):
                want.update({(tree, level, at): d for at, d in enumerate(nodes)})
        assert stored == want and built.nodes().count() == len(want)
        # A version holds its leaf and the leaf's ancestors alone, and ends in its own root.
        copied = defaultdict(dict)
        for r in built.copied().collect():
            copied[r.doc_id][r.level] = r.digest
        told = {r.doc_id: r for r in built.versions().collect()}
        assert set(copied) == {i for i, r in told.items() if not r.verified} == {i for i in range(150) if zlib.crc32(str(i).encode()) % 3 == 0}
        for i, nodes in copied.items():
            height = {"=en": 3, "=fr": 2}["=en" if i % 4 else "=fr"]
            assert sorted(nodes) == list(range(height + 2)) and nodes[height + 1] == told[i].folded_root
