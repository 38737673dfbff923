"""The pipeline against a brute-force version of its stages, each judged on its own input."""

import re

import pytest
from test_line_dedup import brute as line_brute
from test_mixing import targets
from test_near_dup import brute as near_brute

import corpus_pipeline
from quireflow.llm import langid
from quireflow.llm.common import documents, scratch_path
from quireflow.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def stages(spark):
    """The rows before the first stage and after each."""
    docs = documents(spark, SF)
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = scratch_path(spark, f"test-pipeline/{name}")
        stage(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_columns_stay_until_the_last_stage(stages):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "mixing", "packing"]
    assert all(s.columns == stages[0].columns for s in stages[1:-1])


def test_language_stage_keeps_texts_with_a_language(stages):
    before, after = ({r["doc_id"]: r for r in s.collect()} for s in stages[:2])
    lettered = {i for i, r in before.items() if langid.LETTERS.search(r["text"] or "")}
    assert after.keys() <= lettered and len(after) >= 0.98 * len(lettered)
    assert all(after[i]["text"] == before[i]["text"] and after[i]["source"] == before[i]["source"] for i in after)


def test_line_stage(stages):
    before = [(r["doc_id"], r["text"]) for r in stages[1].collect()]
    after = {r["doc_id"]: r for r in stages[2].collect()}
    import hashlib

    want = {i: digest for i, _, _, digest in line_brute(before)}
    assert {i: hashlib.sha256(r["text"].encode()).hexdigest() for i, r in after.items()} == {i: want[i] for i in after}
    gone = want.keys() - after.keys()
    assert all(r["n_chars"] == len(r["text"]) for r in after.values())
    blank = {hashlib.sha256(t.encode()).hexdigest() for t in ("", *("\n" * k for k in range(1, 400)))}
    assert all(want[i] in blank for i in gone)


def test_near_duplicate_stage(stages):
    before = [(r["doc_id"], r["text"]) for r in stages[2].collect()]
    assert {r["doc_id"] for r in stages[3].collect()} == {i for i, _, _, kept in near_brute(before, 5, 80) if kept}


def test_mixing_stage(stages):
    size = lambda t: len(WORDS.findall(t or ""))
    before = {r["doc_id"]: r for r in stages[3].collect()}
    sums, taken, per_doc = {}, {}, {}
    for r in before.values():
        sums[r["source"]] = sums.get(r["source"], 0) + size(r["text"])
    for r in stages[4].collect():
        whole = before[r["doc_id"]]
        assert whole["text"].startswith(r["text"]) and r["n_chars"] == len(r["text"])
        taken[r["source"]] = taken.get(r["source"], 0) + size(r["text"])
        per_doc[r["doc_id"]] = per_doc.get(r["doc_id"], 0) + size(r["text"])
    want = targets(sums)
    assert all(abs(taken.get(s, 0) - want[s]) <= 128 for s in sums)
    assert all(n <= 3 * size(before[i]["text"]) for i, n in per_doc.items())


def test_packing_stage(stages):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    copies: dict = {}
    for r in stages[4].collect():
        copies.setdefault(r["doc_id"], []).append(len(tokenizer.encode(r["text"], add_special_tokens=False).ids) + 1)
    used: dict = {}
    for r in stages[5].collect():
        used.setdefault(r["doc_id"], []).append(r["length"])
    assert {i: sum(v) for i, v in copies.items()} == {i: sum(v) for i, v in used.items()}
    rows = stages[5].collect()
    by_sequence: dict = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert all(sum(r["length"] for r in piece) <= 4096 for piece in by_sequence.values())
    assert all(r["doc_tokens"] in copies[r["doc_id"]] for r in rows)


def test_run_gives_the_rows_of_its_stages(spark, stages):
    key = lambda r: (r["doc_id"], r["start"], r["length"], r["ids_crc32"])
    assert sorted(map(key, corpus_pipeline.run(spark, SF).collect())) == sorted(map(key, stages[5].collect()))


def test_stages_take_odd_rows(spark):
    rows = [(1, None, "en", "a", None), (2, "", None, None, 0), (2, "the cat and the dog", "en", "a", 19), (2, "the cat and the dog", "en", "a", 19), (None, "the dog and the cat are here", "en", None, 5), (4, "le chat et le chien " * 30, "fr", "b", 1)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, owner string")
    for empty in (False, True):
        docs = df.where("false") if empty else df
        for name, stage in corpus_pipeline.STAGES:
            path = scratch_path(spark, f"odd/{name}")
            stage(spark, docs, SF).write.parquet(path)
            docs = spark.read.parquet(path)
        assert (docs.count() > 0) != empty
