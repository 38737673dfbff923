"""Nearest neighbours against brute force."""

import numpy as np
import pytest

from quireflow.llm import ann
from quireflow.llm.queries import op8_neighbours


def brute(rows, queries, k):
    out = {}
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    for q, w in queries:
        w = np.array(w, float)
        near = sorted(((-float(v @ w) / np.linalg.norm(v) / np.linalg.norm(w), i) for i, v in good if i != q and len(v) == len(w)))
        out[q] = [(i, -s) for s, i in near[:k]]
    return out


@pytest.mark.parametrize("table", ["sf0.01", "sf0.1"])
def test_recall(spark, table):
    folder = f"/root/testdata/{table}"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    want = brute(rows, [r for r in rows if r[0] % 50 == 0], 5)
    got = {}
    for r in op8_neighbours(spark, folder).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"], r["rank"]))
    assert got.keys() == want.keys()
    hits = 0
    for q, found in got.items():
        assert [f[2] for f in found] == [1, 2, 3, 4, 5]
        assert [f[:2] for f in found] == sorted((f[:2] for f in found), key=lambda f: (-f[1], f[0]))
        hits += len({f[0] for f in found} & {i for i, _ in want[q]})
    assert hits >= 0.95 * 5 * len(want)


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (50, [0.0, 2.0]), (1, [1.0, 0.0]), (2, [2.0, 0.1]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, [1.0, 0.0, 0.0]), (100, [0.0, 0.0])]
    rows += [(200 + i, [3.0, 4.0]) for i in range(20)] + [(250, [3.0, 4.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, dim string")
    got = {}
    for r in ann.neighbours(df, df.where("vec_id % 50 = 0"), k=5).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], round(r["score"], 12)))
    want = {q: [(i, round(s, 12)) for i, s in f] for q, f in brute(rows, [r for r in rows if r[0] in (0, 50, 200, 250)], 5).items()}
    assert got == want
    assert ann.neighbours(df.where("false"), df.where("vec_id = 0")).collect() == []
    assert len(ann.neighbours(df.where("vec_id = 2"), df.where("vec_id = 0")).collect()) == 1


def test_many_small_forests_give_the_same_neighbours(spark):
    rng = np.random.default_rng(1)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((600, 8)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = ann.neighbours(df, df.where("vec_id % 50 = 0"), k=5, forest=100).collect()
    want = brute(rows, [r for r in rows if r[0] % 50 == 0], 5)
    hits = sum(r["vec_id"] in {i for i, _ in want[r["query_id"]]} for r in found)
    assert hits >= 0.95 * len(found) and len(found) == 5 * len(want)


def test_any_finite_magnitude(spark):
    rows = [(0, [1e200, 1e200]), (1, [1e200, 0.0]), (2, [1e-200, 1e-200]), (3, [5e-324, 0.0]), (4, [1.7e308, 1.7e308]), (50, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = {(r.query_id, r.vec_id): r.score for r in ann.neighbours(df, df.where("vec_id % 50 = 0"), k=5).collect()}
    assert len(out) == 10
    for (q, v), score in out.items():
        diagonal = {0, 2, 4}
        assert abs(score - (1.0 if (q in diagonal) == (v in diagonal) else 0.5**0.5)) < 1e-12
