"""Line dedup against a plain pass over all lines."""

import hashlib
import random

from quireflow.llm import line_dedup


def brute(rows, min_chars=10):
    first, owners = {}, {}
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    split = [(i, (t or "").split("\n")) for i, t in rows]
    for i, lines in split:
        for k in map(key, lines):
            owners.setdefault(k, set()).add(i)
            first[k] = min(first.get(k, i), i)
    out = []
    for i, lines in split:
        kept = [x for x in lines if len(key(x)) < min_chars or len(owners[key(x)]) < 2 or first[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


def got(df, **options):
    out = line_dedup.dedup_lines(df, **options).collect()
    return sorted((r["doc_id"], r["n_lines"], r["n_dropped"], hashlib.sha256((r["kept_text"] or "").encode()).hexdigest()) for r in out)


def test_runs_of_many_batches_give_what_one_batch_gives(docs_of):
    rng = random.Random(3)
    pool = [f"Line number {i} of the pool {'é' * (i % 3)}" for i in range(60)] + ["short", "", "  ", "TEN CHARS."]
    rows = [(i, "\n".join(rng.choice(["", " ", "\t"]) + rng.choice([str, str.upper])(rng.choice(pool)) for _ in range(rng.randrange(8)))) for i in range(90)]
    rows += [(200 + i, "The one line in a third of all documents\n" + str(i)) for i in range(50)]
    for batches in (1, 4, 11):  # eleven batches compact the runs over several levels
        assert got(docs_of(rows).repartition(3), batches=batches) == brute(rows)


def test_compaction_keeps_few_runs(spark, docs_of):
    runs = line_dedup.LineRuns(spark)
    for b in range(10):
        lines = line_dedup.keyed_lines(docs_of([(b, f"a line of batch {b // 2} which is long")]), 10)
        dropped = runs.add(lines).count()
        assert dropped == b % 2
    assert sum(map(len, runs.levels.values())) <= 4 and max(runs.levels) == 2
    keys = runs.seen().collect()
    assert len(keys) == len({bytes(r["key"]) for r in keys}) == 5


def test_edge_cases(docs_of):
    line = "ten chars!"
    rows = [(1, None), (2, ""), (3, f"{line}\n{line}"), (4, f" {line.upper()}\r\nx"), (5, "nine char"), (6, "nine char"), (7, (line + "\n") * 50_000)]
    assert got(docs_of(rows).select("lang", "text", "doc_id", "source")) == brute(rows)
    twice = got(docs_of([(3, line), (3, line), (4, line)]))
    assert [r[2] for r in twice] == [0, 0, 1]
    none = line_dedup.dedup_lines(docs_of([(None, line), (1, line), (None, None)])).collect()
    assert {(r["doc_id"], r["text"], r["n_dropped"]) for r in none} == {(None, line, 0), (1, line, 1), (None, None, 0)}
    assert got(docs_of(rows).where("false")) == []
    clash = docs_of([(1, line), (2, line)]).toDF("doc_id", "text", "owner", "key")
    assert sorted(r[2] for r in got(clash)) == [0, 1]


def test_rows_of_one_id_lose_lines_by_their_own_text(docs_of):
    rows = [(1, "shared long line one"), (2, "shared long line one\ntail"), (2, "only here, never repeated\ntail two")]
    out = {(r["doc_id"], r["text"]): (r["kept_text"], r["n_dropped"]) for r in line_dedup.dedup_lines(docs_of(rows)).collect()}
    assert out == {(1, rows[0][1]): (rows[0][1], 0), (2, rows[1][1]): ("tail", 1), (2, rows[2][1]): (rows[2][1], 0)}


def test_columns_called_like_internal_ones(docs_of):
    names = ["gone", "owner", "text_key", "pos", "key", "row", "lines", "kept_text", "n_lines", "n_dropped", "first", "last"]
    for name in names:
        clash = docs_of([(1, "ten chars!", "x"), (2, "ten chars!", "y")]).toDF("doc_id", "text", name, "source")
        out = line_dedup.dedup_lines(clash)
        assert sorted(r[2] for r in got(clash)) == [0, 1]
        assert len(set(out.columns)) == len(out.columns)
        kept = line_dedup.dedup_lines(clash, keep=True)
        assert sorted((r["row"][name], r["n_dropped"]) for r in kept.collect()) == [("x", 0), ("y", 1)]


def test_a_document_of_very_many_repeated_lines(docs_of):
    text = "\n".join(f"line number {i}" for i in range(100_000))
    assert sorted(r[2] for r in got(docs_of([(1, text), (2, text)]))) == [0, 100_000]
