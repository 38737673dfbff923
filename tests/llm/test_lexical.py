"""Ranked search against scores of all pairs."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from quireflow.llm import lexical

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_ranking(docs, items, k):
    bags = [(d, Counter(terms_of(t))) for d, t in docs if terms_of(t)]
    n_docs, n_terms = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms_of(t))
    out = []
    for i, wanted in asked.items():
        scored = []
        for d, b in bags:
            m = 50 + 50 * sum(b.values()) * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 20 * m)) for t in wanted if b[t])
            if score:
                scored.append((-score, d is None, d or 0, d))
        out += [(i, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def ranked(spark, docs, items, **options):
    left = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, score int")
    right = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, doc_id int")
    return sorted((tuple(r) for r in lexical.rank_documents(left, right, **options).collect()), key=str)


def test_against_all_pairs(spark):
    draw = random.Random(3)
    words = ["The", "the", "of", "É", "éa", "x1", "rare", "Rarer", "zz"] + [f"w{i}" for i in range(60)]
    some = lambda n: draw.choice([" ", "-", "_!\n"]).join(draw.choices(words, [1 / (1 + i) for i in range(len(words))], k=n))
    docs = [(i, some(draw.choice([0, 1, 3, 20, 200]))) for i in range(700)] + [(5, "rare words"), (5, "rare words"), (None, "rare words"), (900, None), (901, "?!"), (902, "the " * 60_000)]
    docs += [(1000 + i, docs[7][1]) for i in range(300)]
    items = [(i, some(12)) for i in range(25)] + [(3, "rare"), (None, "zz w3"), (30, None), (31, "..."), (32, "unknown")]
    want = plain_ranking(docs, items, 10)
    assert ranked(spark, docs, items, k=10, head=40) == want
    assert ranked(spark, docs, items, k=10, block_bytes=150) == want


def test_empty_tables(spark):
    assert ranked(spark, [], [(1, "a")]) == [] and ranked(spark, [(1, "a")], []) == [] and ranked(spark, [(1, "b")], [(1, "a")]) == []
    assert ranked(spark, [(1, None)], [(1, "a")]) == []


def test_large_counts_do_not_overflow():
    weights = lexical.Weights(10**11, 10**13, np.array([5]))
    assert weights.damping(np.array([10**8, 3])).tolist() == [50 + 50 * 10**8 * 10**11 // 10**13, 50 + 50 * 3 * 10**11 // 10**13]


def test_bounds_prune_and_lose_nothing():
    """Candidates hold every vector that reaches the threshold, and leave most others out."""
    draw, n_terms, n = np.random.default_rng(5), 200, 400
    lists = [np.sort(draw.choice(n_terms, draw.integers(1, 60), replace=False)) for _ in range(n)]
    offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in lists])]), pa.int32())
    counts = draw.integers(1, 9, offsets[-1].as_py())
    weights = lexical.Weights(10_000, 400_000, draw.integers(1, 9000, n_terms))
    batch = pa.RecordBatch.from_arrays([pa.array(draw.integers(60, 900, n)), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(lists).astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array(counts.astype(np.int32)))], names=["n", "terms", "counts"])
    batch = batch.append_column("length", pa.array(lexical.norms(batch, weights)))
    bucket, looked, skipped = lexical.Bucket(batch, weights, n_terms), 0, 0
    for _ in range(60):
        terms = np.sort(draw.choice(n_terms, 12, replace=False))
        wanted = np.zeros(n_terms, bool)
        wanted[terms] = True
        scores = bucket.scores(np.arange(n), wanted)
        for least in (1, int(np.sort(scores)[-10]), int(scores.max()), int(scores.max()) + 1, int(bucket.length.max() * 12)):
            if least < 1:
                continue
            rows = bucket.candidates(terms, least)
            assert set(np.flatnonzero(scores >= least)) <= set(rows.tolist())
            looked += len(rows) if least > 1 else 0
        skipped += not len(bucket.candidates(terms, bucket.length.max() * 12**0.5 * 1.01))
    assert skipped == 60 and looked < 0.25 * 60 * 4 * n
