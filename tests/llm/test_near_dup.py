"""Near duplicates against all pairs of full sets."""

import random
import re

import pytest

from quireflow.llm import near_dup
from quireflow.llm.common import WORD, documents

SF = "/root/testdata/sf0.01"


def brute(rows, k, per_cent):
    sets = {}
    for i, t in rows:
        words = re.findall(WORD, "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(words[j : j + k]) for j in range(len(words) - k + 1)} or ({tuple(words)} if words else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    owners = {}
    for i in sorted(sets):
        shared = {}
        for s in sets[i]:
            for j in owners.setdefault(s, []):
                shared[j] = shared.get(j, 0) + 1
            owners[s].append(i)
        for j, both in shared.items():
            if 100 * both >= per_cent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return sorted((i, len(sets[i]), find(i), find(i) == i) for i in sets)


def got(df, k, per_cent):
    out = near_dup.near_duplicates(df, k=k, per_cent=per_cent)
    return sorted(tuple(r) for r in out.select("doc_id", "n_shingles", "component_id", "kept").collect())


@pytest.mark.parametrize("k,per_cent", [(3, 85), (5, 80)])
def test_table_matches_all_pairs(spark, k, per_cent):
    df = documents(spark, SF)
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    assert got(df, k, per_cent) == brute(rows, k, per_cent)


def test_a_family_of_near_copies_that_only_partly_link(spark, docs_of, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 40)
    rng = random.Random(5)
    base = [f"w{rng.randrange(4000)}" for _ in range(150)]
    rows = []
    for i in range(160):
        words = list(base)
        for _ in range(rng.randrange(1, 7)):
            words[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    rows += [(200 + i, rows[i][1]) for i in range(5)]
    assert got(docs_of(rows).repartition(7), 3, 85) == brute(rows, 3, 85)


def test_edge_cases(docs_of):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "ONE  two"), (6, "one"), (7, "a " * 60_000), (8, "a b c d"), (8, "a b c d")]
    want = [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, 1, 6, True), (7, 1, 7, True), (8, 2, 8, True), (8, 2, 8, True)]
    assert got(docs_of(rows), 3, 85) == want
    assert got(docs_of([(1, "")]).where("false"), 3, 85) == []


def test_number_of_sub_keys():
    for threshold in (0.5, 0.8, 0.85):
        m = near_dup.sub_keys(threshold)
        assert 1 - (1 - (1 - threshold**near_dup.ROWS) ** m) ** 2 <= near_dup.MISS


def test_every_text_of_a_repeated_id_links(docs_of):
    words = [f"w{i}" for i in range(100)]
    near, other = " ".join(words), " ".join(["x", *words[1:]])
    out = near_dup.near_duplicates(docs_of([(1, near), (2, other), (2, "zzz is another text of the same id"), (None, near + " more"), (None, "alone here")]), k=3, per_cent=85)
    found = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in out.collect()), key=str)
    assert found == sorted([(1, 98, 1, True), (2, 98, 1, False), (2, 6, 2, True), (None, 99, 1, False), (None, 1, None, True)], key=str)


def test_components_of_chains_stars_and_random_edges(spark):
    rng = random.Random(11)
    names = rng.sample(range(10**6), 400)
    edges = [(i, i + 1) for i in range(100)] + [(999, 900 + i) for i in range(50)] + [(names[rng.randrange(400)], names[rng.randrange(400)]) for _ in range(260)]
    edges += [(b, a) for a, b in edges[:120]] + [(5000, 5000)]
    label = {v: v for e in edges if e[0] != e[1] for v in e}
    while any(label[a] != label[b] for a, b in edges if a != b):
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    found = near_dup.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(found) == len(label) and {r.node: r.label for r in found} == label
    assert near_dup.components(spark.createDataFrame([(1, 1)], "a long, b long")).isEmpty()


def test_edges_within_a_component_leave_after_a_round(spark, monkeypatch):
    """Only the different edges between roots go on to the next round, however many edges there were."""
    sizes = []
    fixed = near_dup.checkpointed

    def counted(df):
        out = fixed(df)
        if out.columns == ["a", "b"]:
            sizes.append(out.count())
        return out

    monkeypatch.setattr(near_dup, "checkpointed", counted)
    edges = [(a, 10_000 + b) for a in range(60) for b in range(60)]
    near_dup.components(spark.createDataFrame(edges, "a long, b long"))
    assert sizes[0] == 3600 and sizes[1] <= 60 and sizes[-1] == 0


def test_a_round_proposes_at_most_one_edge_a_class(spark):
    rng = random.Random(8)
    rows = [(bucket, cls, cls) for bucket in range(300) for cls in rng.sample(range(400), 40)]
    df = spark.createDataFrame(rows, "bucket long, cls long, label long")
    tested = None
    for turn in range(3):
        edges = near_dup.proposals(df, tested, turn).collect()
        pairs = {(e.a, e.b) for e in edges}
        assert 0 < len(edges) <= 400 and len(pairs) == len(edges) and all(a < b for a, b in pairs)
        assert tested is None or not pairs & {tuple(r) for r in tested.collect()}
        more = spark.createDataFrame(edges)
        tested = more if tested is None else tested.union(more)
