"""Runs of repeating words against all periods tried one by one."""

import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quireflow.llm import queries, runs


def plain_runs(words, least):
    out, n = [], len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, 2 * q):
                s = words[i : j + q]
                if all(any(s[x] != s[x + d] for x in range(len(s) - d)) for d in range(1, q)):
                    out.append((i, len(s), q))
            i = j + 1
    return sorted(out)


def plain_kept(words, found):
    gone = {x for s, length, q in found for x in range(s + q, s + length)}
    return [w for i, w in enumerate(words) if i not in gone]


@given(st.lists(st.integers(0, 2), max_size=70), st.integers(2, 14))
@settings(max_examples=300, deadline=None)
def test_automaton_finds_every_run(words, least):
    assert runs.runs_of(words, least) == plain_runs(words, least)


@given(st.lists(st.lists(st.sampled_from(["a", "b", "é", "word"]), max_size=40).map(" \n".join), min_size=1, max_size=6), st.integers(2, 12))
@settings(max_examples=200, deadline=None)
def test_slices_of_texts(texts, least):
    raw = [t.encode() for t in texts]
    counts, found, kept = runs._slice_runs(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]), least)
    for i, t in enumerate(texts):
        want = plain_runs(t.split(), least)
        assert counts[i] == len(t.split()) and found.get(i, []) == want
        assert kept[i].decode() == " ".join(plain_kept(t.split(), want))


def test_odd_rows(spark):
    docs = spark.createDataFrame(
        [(1, None, 7), (2, "", 7), (3, " \t\n", 7), (4, "x " * 30, 7), (4, "x " * 30, 7), (None, "a b " * 8 + "end", 7), (5, "once " + "y z q " * 40_000, 7)],
        "doc_id long, text string, runs int")
    got = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed[:12]) for r in runs.find_runs(docs).collect()), key=str)
    assert got == sorted([(1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""), (4, 30, [(0, 30, 1)], "x"), (4, 30, [(0, 30, 1)], "x"),
                          (None, 17, [(0, 16, 2)], "a b end"), (5, 120_001, [(1, 120_000, 3)], "once y z q")], key=str)
    assert runs.find_runs(docs.where("false")).count() == 0


@pytest.mark.parametrize("size", [7, 60])
def test_query_against_all_periods(spark, tmp_path, size):
    texts = {i: None if i % 41 == 0 else " ".join(f"w{(i * 7 + k * k) % 9}" for k in range(i % size * 3)) for i in range(240)}
    spark.createDataFrame([(i, t, "xx", "s") for i, t in texts.items()], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    for row in queries.QUERIES["op13_periodic_runs"](spark, str(tmp_path)).collect():
        words, h = (texts[row.doc_id] or "").split(), zlib.crc32(str(row.doc_id).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
        want = plain_runs(words, 12)
        assert row.n_runs == len(want)
        top = min(want, key=lambda r: (-r[1], r[0], r[2])) if want else (None, None, None)
        assert (row.start, row.length, row.period) == top
        assert row.exponent_milli == (1000 * top[1] // top[2] if want else None)
        assert row.runs_sha256 == hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in want).encode()).hexdigest()
        assert row.collapsed_sha256 == hashlib.sha256(" ".join(plain_kept(words, want)).encode()).hexdigest()
