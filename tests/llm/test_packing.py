"""Packing: ids against the tokenizer on whole texts, and the form of sequences."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quireflow.llm import packing
from quireflow.llm.common import documents
from quireflow.llm.queries import op5_packing, tokenizer_path

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def check(rows, texts, tokenizer):
    """Rows of the operator for texts [(doc_id, text)] with distinct ids."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert sorted(by_doc) == sorted(i for i, _ in texts)
    for i, t in texts:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for piece in by_sequence.values():
        at = 0
        for r in sorted(piece, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= packing.WINDOW
    return sum(p[0]["sequence_length"] for p in by_sequence.values()), sum(r["length"] for r in rows)


def test_table(spark, tokenizer):
    texts = [(r["doc_id"], r["text"]) for r in documents(spark, SF).select("doc_id", "text").collect()]
    padded, used = check(op5_packing(spark, SF).collect(), texts, tokenizer)
    assert padded <= 1.02 * used


def test_edge_cases(docs_of, tokenizer):
    texts = [(1, None), (2, ""), (3, "  \n\n \t"), (4, "It's <|endoftext|> over there\x1cnow  é"), (5, "word " * 9000), (6, "x" * 20_000)]
    check(packing.pack(docs_of(texts), tokenizer_path()).collect(), texts, tokenizer)
    assert packing.pack(docs_of(texts).where("false"), tokenizer_path()).collect() == []
    kept = packing.pack(docs_of(texts), tokenizer_path(), keep_ids=True).collect()
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] for r in kept)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'sréΣß<|>"), st.characters(exclude_categories=["Cs"])), max_size=40), min_size=1, max_size=4))
def test_words_alone_give_the_ids_of_the_text(texts):
    cache = test_words_alone_give_the_ids_of_the_text.__dict__.setdefault("cache", packing.WordCache(tokenizer_path(), 2))
    raw = [t.encode() for t in texts]
    ids, starts = cache.encode(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64))
    for i, t in enumerate(texts):
        assert ids[starts[i] : starts[i + 1]].tolist() == [*cache.tokenizer.encode(t, add_special_tokens=False).ids, 2]


@given(st.lists(st.integers(1, 64), max_size=60))
def test_best_fit_takes_the_tightest_open_sequence(lengths):
    lengths.sort(reverse=True)
    sequences, offsets = packing.best_fit(lengths, 64)
    room = []
    for n, s, at in zip(lengths, sequences, offsets, strict=True):
        fits = [r for r in room if r >= n]
        if fits:
            assert room[s] == min(fits)
        else:
            assert s == len(room)
            room.append(64)
        assert at == 64 - room[s]
        room[s] -= n
