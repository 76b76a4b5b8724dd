import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from docketry.functions.process import per_process
from docketry.llm import packing, token_files, tokens
from llm_data import ODD, odd_documents

FILES = {"word_bpe_49k.json": True, "byte_bpe_50k.json": False}


@pytest.fixture(scope="module", params=list(FILES))
def pair(request):
    path = public_tokenizers.path(request.param)
    return tokens.Encoder(path, FILES[request.param]), Tokenizer.from_file(path)


def same(pair, text):
    known, plain = pair
    assert known.ids(text) == plain.encode(text, add_special_tokens=False).ids, repr(text)


def test_units_give_the_ids_of_whole_texts(pair):
    for text in (
        "a  b", " lead", "trail ", "x\n\ny", "a \nb", "tab\tand more", "it's we'll 'tis", "A1b2 c3", "end.!? (x) #$%", "<|endoftext|> a<|endoftext|>b.",
        "İstanbul Σας ΣΑΣ K̊ H̱ é", "日本語 текст", "\x1c \x85 x", "...", "word... word!!! 12.5%", "\r\n", "",
    ):
        same(pair, text)
    for _, text in ODD:
        if text:
            same(pair, text)


TEXTS = st.text(st.one_of(st.sampled_from(" \n\t.,!'s<|>aAéÉßİ1×"), st.characters(exclude_categories=["Cs"])), max_size=40)


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXTS, max_size=4))
def test_units_on_random_texts(texts):
    for name, lower in FILES.items():
        path = public_tokenizers.path(name)
        known, plain = tokens.encoder(path, lower), per_process(("plain", path), lambda: Tokenizer.from_file(path))
        got = [[], *[(flat.tolist(), counts.tolist()) for _, flat, counts in known.column_ids(pa.array(texts, pa.string()))]]
        want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
        if texts:
            assert got[1] == (sum(want, []), [len(w) for w in want]), texts


def brute_ids(name, rows, end):
    plain = Tokenizer.from_file(public_tokenizers.path(name))
    return [(i, np.array(plain.encode(t or "", add_special_tokens=False).ids + [end], "<u4")) for i, t in rows]


def test_token_files_round_trip(spark, sf):
    rows = sorted(tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    at, want = 0, []
    for i, ids in brute_ids("word_bpe_49k.json", rows, 2):
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(tuple(r) for r in token_files.q_token_files(spark, sf).collect()) == want


def test_token_files_of_odd_rows(spark, tmp_path):
    path = str(tmp_path / "ids")
    token_files.write_token_files(odd_documents(spark), path, public_tokenizers.path("word_bpe_49k.json"))
    got = token_files.read_tokens(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, None, *sorted(i for i, _ in ODD if i is not None)]
    assert [r.start for r in got] == np.concatenate([[0], np.cumsum([r.n_tokens for r in got])[:-1]]).tolist()
    held = {i: ids.tolist() for i, ids in brute_ids("word_bpe_49k.json", ODD, 2)}
    assert all(list(r.tokens) == held[r.doc_id] for r in got if r.doc_id is not None)
    some = token_files.read_tokens(spark, path, [7, 12])
    assert sorted(r.doc_id for r in some.collect()) == [7, 12]
    assert {r.doc_id: r.start for r in some.collect()} == {r.doc_id: r.start for r in got if r.doc_id in (7, 12)}


def test_token_files_of_nothing(spark, tmp_path):
    path = str(tmp_path / "none")
    token_files.write_token_files(odd_documents(spark, []), path, public_tokenizers.path("word_bpe_49k.json"))
    assert token_files.token_digests(token_files.read_tokens(spark, path)).count() == 0


def check_pieces(rows, pieces, end=0, size=1024):
    by_doc = defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
    for i, ids in brute_ids("byte_bpe_50k.json", rows, end):
        copies = sum(j == i for j, _ in rows)
        own = sorted(by_doc[i], key=lambda p: p.start)
        if copies == 1:
            assert [p.start for p in own] == np.cumsum([0, *[p.length for p in own][:-1]]).tolist()
            assert sum(p.length for p in own) == len(ids)
            assert all(p.ids_crc32 == zlib.crc32(ids[p.start:p.start + p.length].tobytes()) and p.doc_tokens == len(ids) for p in own)
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append((p.offset, p.length))
    assert sorted(sequences) == list(range(len(sequences)))
    for held in sequences.values():
        held.sort()
        ends = np.cumsum([n for _, n in held])
        assert [o for o, _ in held] == [0, *ends[:-1].tolist()] and ends[-1] <= size
    return len(sequences)


def test_packing(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    pieces = packing.q_packing(spark, sf).collect()
    n = check_pieces(rows, pieces)
    assert sum(p.length for p in pieces) > 0.95 * 1024 * n


def test_packing_of_odd_rows(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    pieces = packing.pack(odd_documents(spark), path).collect()
    check_pieces(ODD, pieces)
    assert sorted((p.doc_id for p in pieces if p.start == 0), key=repr) == sorted((i for i, _ in ODD), key=repr)
    assert packing.pack(odd_documents(spark, []), path).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=20))
def test_histogram_is_packed_whole(counts):
    placed = defaultdict(int)
    for pattern, number in packing.pack_histogram(counts, 64):
        assert 0 < sum(pattern) <= 64 and number > 0
        for length in pattern:
            placed[length] += number
    assert dict(placed) == counts
