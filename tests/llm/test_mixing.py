"""Mixing against plain Sainte-Laguë and plain water filling."""

import heapq
import random
import re

import pytest

from quireflow.llm import mixing
from quireflow.llm.common import documents
from quireflow.llm.queries import op9_mixing


def targets(sizes, weights=(5, 2, 1), ceiling=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = float(sum(sizes.values())), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > ceiling * sizes[s]}
        if not full:
            return out | {s: level * weight[s] for s in open_}
        for s in full:
            out[s] = float(ceiling * sizes[s])
            left -= out[s]
        open_ -= full
    return out


def check(rows, out, tolerance):
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in out:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= tolerance


def test_table(spark):
    folder = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in documents(spark, folder).select("doc_id", "text", "source").collect()]
    out = op9_mixing(spark, folder).collect()
    assert len(out) == len(rows)
    check(rows, out, 2 * mixing.BLOCK_WORDS)
    again = op9_mixing(spark, folder).collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, again))


def test_quotas_are_those_of_the_highest_quotients(spark):
    rng = random.Random(9)
    for trial in range(6):
        votes = [rng.choice([0.0, rng.random() * 10, rng.random() * 1000]) for _ in range(rng.randrange(1, 25))] + [7.0]
        seats = rng.randrange(0, 400)
        heap, want = [(-v, i, 0) for i, v in enumerate(votes) if v > 0], [0] * len(votes)
        heapq.heapify(heap)
        for _ in range(seats):
            _, i, k = heapq.heappop(heap)
            want[i] += 1
            heapq.heappush(heap, (-votes[i] / (2 * k + 3), i, k + 1))
        df = spark.createDataFrame([(0, i, v, seats) for i, v in enumerate(votes)], "all int, unit int, vote double, seats long")
        got = {r["unit"]: r["quota"] for r in mixing.apportioned(df, ["all"], "unit", "vote", "seats").collect()}
        assert [got[i] for i in range(len(votes))] == want


def test_edge_cases(docs_of):
    rows = [(1, None, None, "a"), (2, "", None, "a"), (3, "one two three " * 300, None, "b"), (4, "x " * 5000, None, None), (5, "y", None, "c"), (6, "z " * 200, None, "b"), (6, "z " * 200, None, "b"), (None, "w " * 70, None, "b")]
    rows += [(100 + i, "hot words here " * 20, None, "hot") for i in range(40)]
    df = docs_of(rows)
    out = mixing.mix(df, shard_docs=8).collect()
    assert len(out) == len(rows)
    check([(i, t, s) for i, t, _, s in rows], out, 6 * mixing.BLOCK_WORDS)
    assert mixing.mix(df.where("false")).collect() == []
    assert [r["taken"] for r in mixing.mix(df.where("doc_id = 1")).collect()] == [0]
    kept = mixing.mix(df.select("source", "lang", "text", "doc_id"), keep=True).collect()
    assert all(r["row"]["doc_id"] == r["doc_id"] for r in kept)
