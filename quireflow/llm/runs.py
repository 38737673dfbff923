"""Runs of repeating words (maximal repetitions) in each text.

Method. A suffix automaton is built over the words; the nodes of its link tree stand for the suffixes of every prefix. The words are
appended one after the other: the path from a prefix's node to the root is accessed as in a link-cut tree, whose preferred paths are
kept in splay trees. Each preferred path the access crosses holds suffixes that last ended at one and the same place; the whole path
then takes the new end as its colour. A crossed segment with suffixes of lengths (low, high], last seen ``d`` words before, proves a
square of period ``d`` where ``low < d <= high``; ``d`` is then the smallest period, and the longest suffix gives the first word of the
run. The last end at which the same start and period are seen is the run's last word.

Before that, words that no run can hold are left out: a run of ``min_length`` words or more and of two periods or more is covered
by two equal factors of half its length, so each of its words lies in a window of ``ceil(min_length / 2)`` words that occurs twice in the
text. Windows are compared by 64-bit hash, which can only let more words through; the automaton works on the words themselves.

Scale. One pass over the texts, nothing is shuffled; a task holds slices of about two megabytes, or one longer text. Steps are
O(n log n) in the words of a text, whatever its periods.

Edge cases. Null, empty or blank text: 0 words, no run, empty collapsed text. Repeated rows and null ids keep rows of their own. Other
columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quireflow.llm.common import mixed, pieces, shingle_hashes, text_bytes, texts, word_hashes, word_spans

MIN_LENGTH = 12
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


class SuffixAutomaton:
    """States of all factors of a sequence; 1 is the root, 0 none. ``ends[i]`` is the state of the prefix that ends with word i."""

    def __init__(self, words: list[int]):
        length, link, steps = [0, 0], [0, 0], [{}, {}]
        ends, last = [], 1
        for word in words:
            length.append(length[last] + 1)
            link.append(1)
            steps.append({})
            made, at = len(length) - 1, last
            while at and word not in steps[at]:
                steps[at][word] = made
                at = link[at]
            if at:
                to = steps[at][word]
                if length[to] == length[at] + 1:
                    link[made] = to
                else:
                    copy = len(length)
                    length.append(length[at] + 1)
                    link.append(link[to])
                    steps.append(steps[to].copy())
                    link[to] = link[made] = copy
                    while at and steps[at].get(word) == to:
                        steps[at][word] = copy
                        at = link[at]
            ends.append(made)
            last = made
        self.length, self.link, self.ends = length, link, ends


class LastOccurrences:
    """The link tree as preferred paths, each a splay tree in order of depth whose root holds the path's last end (-1: none)."""

    def __init__(self, automaton: SuffixAutomaton):
        n = len(automaton.length)
        self.length, self.above = automaton.length, list(automaton.link)
        self.left, self.right, self.colour = [0] * n, [0] * n, [-1] * n

    def splay(self, x: int) -> None:
        left, right, above = self.left, self.right, self.above
        while True:
            p = above[x]
            if not p or (left[p] != x and right[p] != x):
                return
            g = above[p]
            inner = g and (left[g] == p or right[g] == p)
            if inner and (left[g] == p) == (left[p] == x):
                self._rotate(p)
                self._rotate(x)
            elif inner:
                self._rotate(x)
                self._rotate(x)
            else:
                self._rotate(x)

    def _rotate(self, x: int) -> None:
        left, right, above = self.left, self.right, self.above
        p = above[x]
        g = above[p]
        if left[p] == x:
            child = left[p] = right[x]
            right[x] = p
        else:
            child = right[p] = left[x]
            left[x] = p
        if child:
            above[child] = p
        above[p], above[x] = x, g
        if left[g] == p and g:
            left[g] = x
        elif right[g] == p and g:
            right[g] = x
        else:
            self.colour[x] = self.colour[p]  # p was the path's root

    def access(self, x: int, end: int) -> Iterator[tuple[int, int, int]]:
        """(low, high, last end) of each segment from ``x`` to the root, which all take the colour ``end``."""
        deeper = 0
        while x:
            self.splay(x)
            seen, over = self.colour[x], self.above[x]
            if seen >= 0:
                yield self.length[over], self.length[x], seen
            if self.right[x]:
                self.colour[self.right[x]] = seen
            self.right[x] = deeper
            deeper, x = x, over
        self.colour[deeper] = end


def runs_of(words: list[int], min_length: int = MIN_LENGTH) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start, then period."""
    automaton = SuffixAutomaton(words)
    paths, last = LastOccurrences(automaton), {}
    for end, state in enumerate(automaton.ends):
        for low, high, seen in paths.access(state, end):
            period = end - seen
            if low < period <= high:
                last[end - period - high + 1, period] = end
    return sorted((s, e - s + 1, q) for (s, q), e in last.items() if e - s + 1 >= min_length)


def possible_stretches(hashes: np.ndarray, text: np.ndarray, min_length: int) -> list[tuple[int, int]]:
    """Word ranges [a, b) that may hold runs: each word lies in a window that occurs twice in its text."""
    k = max(1, -(-min_length // 2))
    windows = shingle_hashes(hashes, k)
    if not len(windows):
        return []
    inside = text[: len(windows)] == text[k - 1 :]
    with np.errstate(over="ignore"):
        windows = mixed(windows + text[: len(windows)].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    at = np.flatnonzero(inside)
    order = at[np.argsort(windows[at], kind="stable")]
    same = windows[order[1:]] == windows[order[:-1]]
    again = np.zeros(len(windows), bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    reach = np.zeros(len(hashes) + 1, np.int64)
    found = np.flatnonzero(again)
    np.add.at(reach, found, 1)
    np.add.at(reach, found + k, -1)
    covered = np.cumsum(reach[:-1]) > 0
    opens = covered & np.concatenate([[True], ~covered[:-1] | (text[1:] != text[:-1])])
    closes = covered & np.concatenate([~covered[1:] | (text[1:] != text[:-1]), [True]])
    a, b = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    long = b - a >= min_length
    return list(zip(a[long].tolist(), b[long].tolist(), strict=True))


def _slice_runs(data: np.ndarray, starts: np.ndarray, min_length: int) -> tuple[np.ndarray, dict[int, list], list[bytes]]:
    """Of each text: its number of words, its runs (where it has any) and its words outside of repeats."""
    n = len(starts) - 1
    begin, end, text = word_spans(data, starts)
    first = np.searchsorted(text, np.arange(n + 1))
    runs: dict[int, list] = {}
    kept = np.ones(len(begin), bool)
    for a, b in possible_stretches(word_hashes(data, begin, end), text, min_length):
        ids: dict[bytes, int] = {}
        raw = data[begin[a] : end[b - 1]].tobytes()
        spans = zip((begin[a:b] - begin[a]).tolist(), (end[a:b] - begin[a]).tolist(), strict=True)
        words = [ids.setdefault(raw[x:y], len(ids)) for x, y in spans]
        owner = int(text[a])
        for start, length, period in runs_of(words, min_length):
            runs.setdefault(owner, []).append((a + start - int(first[owner]), length, period))
            kept[a + start + period : a + start + length] = False
    for found in runs.values():
        found.sort(key=lambda r: (r[0], r[2]))
    # what stays: the bytes of kept words, and a blank after each but the last one of its text
    mark = np.zeros(len(data) + 1, np.int8)
    mark[begin[kept]] += 1
    np.add.at(mark, end[kept], -1)
    stays = np.cumsum(mark[:-1], dtype=np.int8) > 0
    out = np.where(stays, data, np.uint8(0x20))
    mine = np.flatnonzero(kept)
    joined = mine[:-1][text[mine[:-1]] == text[mine[1:]]]
    stays[end[joined]] = True
    sizes = np.diff(np.concatenate([[0], np.cumsum(stays)])[starts])
    raw, reach = out[stays].tobytes(), np.concatenate([[0], np.cumsum(sizes)]).tolist()
    return np.diff(first), runs, [raw[x:y] for x, y in zip(reach, reach[1:], strict=False)]


def find_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_length: int = MIN_LENGTH) -> DataFrame:
    """One row per document: doc_id, n_words, runs (by start, then period) and the text without repeats, words joined by one blank.

    A run has ``min_length`` words or more and two periods or more; a word goes if it lies in a run behind its first period.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = text_bytes(batch.column("text"))
            for a, b in pieces(at):
                counts, runs, collapsed = _slice_runs(data[at[a] : at[b]], at[a : b + 1] - at[a], min_length)
                lists = pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in runs.get(i, ())] for i in range(b - a)], pa.list_(_RUN))
                columns = [batch.column("doc_id").slice(a, b - a), pa.array(counts, pa.int64()), lists, pa.array(collapsed, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "runs", "collapsed"])

    return texts(df, id_col, text_col).mapInArrow(run, SCHEMA)
