"""Quality counts against plain Python; host verdicts on worked examples."""

import re

from quireflow.llm import quality


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = {}
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(3)}
    lines, earlier, dup = text.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in earlier
            earlier.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), len(lines)


TEXTS = [None, "", " \n\t", "one", "a b c a b c", "a b c d a b c", "x\nx\n \n \ny x\nx", "é ü#* <b>\r\n日本 語\x0b|", "a a a a a", "tab\there\n\n\nend", "w " * 70_000]


def test_counts(docs_of):
    rows = [(i, t, "x", "s") for i, t in enumerate(TEXTS)]
    got = {r["doc_id"]: r for r in quality.judge(docs_of(rows).select("source", "lang", "text", "doc_id")).collect()}
    for i, t in enumerate(TEXTS):
        assert tuple(got[i][c] for c in quality.COUNTS) == brute(t)
        n, _, _, _, repeat, _ = brute(t)
        assert got[i]["base_failed"] == (n < 50 or 100 * repeat > 50 * n)


def test_hosts_with_many_failures_go_and_small_ones_are_shrunk(docs_of):
    good = " ".join(f"word{i}" for i in range(80))
    rows = [(i, good, None, f"host{i % 8}") for i in range(400)]
    rows += [(1000 + i, "too short" if i % 10 else good, None, "bad") for i in range(200)]
    rows += [(2000, "short", None, "small"), (2001, good, None, "small"), (2002, good, None, "small"), (3000, good, None, None)]
    out = {r["doc_id"]: r for r in quality.judge(docs_of(rows)).collect()}
    assert all(out[i]["kept"] for i in range(400)) and not any(out[1000 + i]["kept"] for i in range(200))
    assert out[1000]["host_rejected"] and not out[1000]["base_failed"]
    assert not out[2000]["kept"] and out[2001]["kept"] and out[3000]["kept"]
    counted = quality.text_counts(docs_of(rows).selectExpr("doc_id", "source host", "text"))
    rates = {r["host"]: r["base_rate"] for r in quality.host_verdicts(counted).collect()}
    assert rates["bad"] < 0.9 and rates["host0"] > 0 and 0 < rates["small"] < 1 / 3 + 0.2


def test_no_rows_and_repeated_rows(docs_of):
    assert quality.judge(docs_of([(1, "x")]).where("false")).collect() == []
    assert quality.judge(docs_of([(1, "x"), (1, "x")])).count() == 2
