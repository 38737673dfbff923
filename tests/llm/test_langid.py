"""Language ID: held-out accuracy, spans of mixed text, and Viterbi against the plain recurrence."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quireflow.llm import langid
from quireflow.llm.common import documents
from quireflow.llm.queries import op1_language_id

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    out = op1_language_id(spark, SF).join(documents(spark, SF).select("doc_id", "lang", "text"), "doc_id")
    rows = out.collect()
    assert len(rows) == 1000 and sum(r["held_out"] for r in rows) > 200
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows if r["held_out"]]) >= 0.98
    assert all(0 <= r["score"] <= 1 for r in rows)


LEARNT = [(i, t, lang) for i, (t, lang) in enumerate([
    ("the cat and the dog are in the house with the bird", "en"), ("there is nothing that they would have said to them", "en"),
    ("der hund und die katze sind in dem haus mit dem vogel", "de"), ("es gibt nichts das sie ihnen nicht gesagt haben", "de"),
    ("кошка и собака живут в этом доме вместе с птицей", "ru")] * 8)]


@pytest.fixture(scope="module")
def model(spark):
    return langid.train(spark.createDataFrame(LEARNT, "doc_id long, text string, lang string"))


def found(spark, model, texts):
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, score string")
    return {r["doc_id"]: r for r in langid.identify(df, model).collect()}


def test_mixed_texts_have_spans(spark, model):
    german, english, russian = "der hund und die katze sind in dem haus", "the cat and the dog are in the house", "собака живут в этом доме"
    out = found(spark, model, [f"{german} {english} {german}", f"{english} {russian}", f"the {german}"])
    assert [(s["lang"], s["start"], s["end"]) for s in out[0]["spans"]] == [("de", 0, 9), ("en", 9, 18), ("de", 18, 27)]
    assert [(s["lang"], s["start"], s["end"]) for s in out[1]["spans"]] == [("en", 0, 9), ("ru", 9, 14)]
    assert out[0]["lang_pred"] == "de" and out[1]["lang_pred"] == "en"
    assert [s["lang"] for s in out[2]["spans"]] == ["de"]  # one word is not worth two switches


def test_edge_cases(spark, model):
    out = found(spark, model, [None, "", "12 34 !?", "漢字 だけ", "the dog " * 40_000, "THE, dog;", "X"])
    assert [out[i]["lang_pred"] for i in range(3)] == ["und"] * 3 and all(out[i]["score"] == 0 and out[i]["spans"] == [] for i in range(3))
    assert out[3]["lang_pred"] in model.langs and out[3]["score"] == 0
    assert out[4]["lang_pred"] == out[5]["lang_pred"] == "en" and out[6]["lang_pred"] in model.langs
    nothing = langid.train(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert nothing is None and [r["lang_pred"] for r in found(spark, None, ["the dog", None]).values()] == ["und", "und"]
    assert langid.train(spark.createDataFrame([(1, None, "xx"), (2, "", "yy")], "doc_id long, text string, lang string")).langs == ["xx", "yy"]


def test_labels_of_held_out_rows_and_other_columns_play_no_part(spark):
    docs = documents(spark, "/root/testdata/sf0.001")
    plain = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(docs, langid.trained_on_folds(docs)).collect()}
    other = docs.withColumn("lang", F.when(langid.held_out(F.col("doc_id")), "zz").otherwise(F.col("lang"))).withColumn("source", F.lit("s"))
    changed = langid.identify(other, langid.trained_on_folds(other), keep=True)
    assert {r["doc_id"]: (r["lang_pred"], r["score"]) for r in changed.collect()} == plain
    assert sorted(tuple(r["row"]) for r in changed.collect()) == sorted(tuple(r) for r in other.collect())


@given(st.lists(st.lists(st.lists(st.sampled_from([0.0, -1.0, -2.5, -7.0]), min_size=3, max_size=3), max_size=40), max_size=5), st.integers(1, 9))
@settings(deadline=None, max_examples=80)
def test_blocks_give_the_best_path(texts, block):
    scores = [np.array(t, np.float32).reshape(-1, 3) for t in texts]
    for s, path in zip(scores, langid.best_paths(scores, 2.0, block), strict=True):
        if len(s):
            value = s[0].astype(float)
            for row in s[1:]:
                value = np.maximum(value, value.max() - 2.0) + row
            got = sum(s[i, k] for i, k in enumerate(path)) - 2.0 * int((np.diff(path) != 0).sum())
            assert got == pytest.approx(value.max())


def test_scripts():
    names = [langid.SCRIPT_NAMES[i] for i in langid.scripts_of(np.array([ord(c) for c in "aßЖλאحअ中あア한1"]))]
    assert names[:11] == ["Latin", "Latin", "Cyrillic", "Greek", "Hebrew", "Arabic", "Devanagari", "Han", "Kana", "Kana", "Hangul"]


def test_every_letter_has_a_script_that_languages_may_fit(docs_of):
    assert "" not in langid.SCRIPT_NAMES
    rng = random.Random(3)
    alphabets = {"or": 0x0B15, "chr": 0x13A0, "iu": 0x1403, "ii": 0xA000, "ff": 0x1E922, "zh": 0x3105, "got": 0x10330}
    rows = [(i, " ".join("".join(chr(alphabets[x] + rng.randrange(15)) for _ in range(5)) for _ in range(30)), x) for i, x in enumerate([*alphabets] * 8)]
    docs = docs_of(rows)
    found = langid.identify(docs, langid.train(docs.select("doc_id", "text", "lang"))).collect()
    assert {r["doc_id"]: r["lang_pred"] for r in found} == {i: x for i, _, x in rows}
    assert min(r["score"] for r in found) > 0.9


def test_long_runs_of_letters_are_learned(docs_of):
    rng = random.Random(4)
    rows = [(i, " ".join("".join(chr(0x0E01 + low + rng.randrange(12)) for _ in range(100)) for _ in range(5)), x) for i, (x, low) in enumerate([("a", 15), ("b", 0)] * 6)]
    docs = docs_of(rows)
    found = langid.identify(docs, langid.train(docs.select("doc_id", "text", "lang"))).collect()
    assert {r["doc_id"]: r["lang_pred"] for r in found} == {i: x for i, _, x in rows}
