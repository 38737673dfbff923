"""License scans against a search for the exact lines."""

import re

from quireflow.llm import licenses
from quireflow.llm.common import documents

SF = "/root/testdata/sf0.01"
NOTICES = {n: t for n, t in licenses.TEMPLATES.items() if n.endswith("notice")}


def test_table_has_every_notice_and_nothing_else(spark):
    rows = [(r["doc_id"], r["text"]) for r in documents(spark, SF).select("doc_id", "text").collect()]
    want = {(i, n) for i, t in rows for n, notice in NOTICES.items() if notice in t}
    found = licenses.scan(documents(spark, SF)).collect()
    assert {(r["doc_id"], r["license"]) for r in found if r["n_different"] == 0} == want
    assert all(r["n_different"] == 0 for r in found) and len(found) == len(want)


def test_every_template_finds_itself_inside_other_text(docs_of):
    filler = "lorem ipsum dolor sit amet " * 300
    rows = [(i, f"{filler}\n{t}\n{filler}") for i, t in enumerate(licenses.TEMPLATES.values())]
    found = {(r["doc_id"], r["license"]) for r in licenses.scan(docs_of(rows)).collect() if r["n_different"] == 0}
    assert {(i, n) for i, n in enumerate(licenses.TEMPLATES)} <= found
    assert all(re.search(licenses.CUE, t) and len(t.split()) < max(licenses.BLOCK_WORDS) // 2 for t in licenses.TEMPLATES.values())
    assert all(len(t.split()) < min(licenses.BLOCK_WORDS) // 2 for t in NOTICES.values())


def test_edge_cases(docs_of):
    mit = licenses.TEMPLATES["MIT"]
    rows = [(1, None), (2, ""), (3, "license"), (4, mit.replace("granted", "given").replace("copy,", "")), (5, "Licensed under the Apache License, Version 1.1."), (6, "no cue here at all"), (None, NOTICES["MIT notice"]), (7, NOTICES["MIT notice"]), (7, NOTICES["MIT notice"])]
    found = sorted(((r["doc_id"], r["license"], r["n_different"]) for r in licenses.scan(docs_of(rows).select("lang", "text", "doc_id")).collect()), key=str)
    assert found == sorted([(4, "MIT", 3), (7, "MIT notice", 0), (7, "MIT notice", 0), (None, "MIT notice", 0)], key=str)
    assert next(r["differences"] for r in licenses.scan(docs_of(rows)).collect() if r["doc_id"] == 4) == ["-granted", "+given", "-copy"]
    assert licenses.scan(docs_of(rows).where("false")).collect() == []


def test_block_that_holds_every_notice(docs_of):
    found = licenses.scan(docs_of([(1, " ".join(NOTICES.values())), (2, "\n".join(sorted(NOTICES.values())))])).collect()
    assert {(r["doc_id"], r["license"]) for r in found if r["n_different"] == 0} == {(i, n) for i in (1, 2) for n in NOTICES}


def test_case_and_what_stands_between_words_do_not_matter(docs_of):
    filler = "a paragraph about rivers, and about the people who live near them "
    forms = [str.upper, lambda t: t.replace(" ", "  "), lambda t: t.replace(" ", "\n"), lambda t: "// " + t.replace(" ", "\r\n// "), lambda t: "# " + t.replace(" ", "\n#\n# ")]
    cases = [(n, form) for n in licenses.TEMPLATES for form in forms]
    rows = [(i, f"{filler * k}\n{form(licenses.TEMPLATES[n])}\n{filler * 20}") for i, (n, form) in enumerate(cases) for k in (0, 7)]
    found = {(r["doc_id"], r["license"]) for r in licenses.scan(docs_of(rows).repartition(8)).collect() if r["n_different"] == 0}
    assert {(i, n) for i, (n, _) in enumerate(cases)} - found == set()
    assert all(len(licenses.words_of(t)) < max(licenses.BLOCK_WORDS) // 2 for t in licenses.TEMPLATES.values())


def test_every_pair_of_notices_is_found_whatever_they_save(docs_of):
    pairs = [(a, b, c) for a in NOTICES for b in NOTICES for c in (" ", "\n * ")]
    found = {(r["doc_id"], r["license"]) for r in licenses.scan(docs_of([(i, c.join([NOTICES[a].upper(), NOTICES[b], NOTICES[a]])) for i, (a, b, c) in enumerate(pairs)])).collect()}
    assert found == {(i, n) for i, (a, b, _) in enumerate(pairs) for n in (a, b)}
