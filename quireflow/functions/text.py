"""Text streams and edit distances."""

from __future__ import annotations

from collections.abc import Hashable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# What Python's str.split() treats as white space: the Unicode property plus four separators.
WHITE_SPACE = r"[\p{IsWhite_Space}\x1c-\x1f]+"

# Sequences from this length on are tried in a band first.
BAND_FROM = 3000


def collapse_spaces(text: Column) -> Column:
    """White space collapsed to single blanks and stripped; case kept."""
    return F.trim(F.regexp_replace(text, WHITE_SPACE, " "))


def words_of(stream: Column) -> Column:
    """Words of a collapsed text (no words in an empty one)."""
    return F.when(stream == "", F.array().cast("array<string>")).otherwise(F.split(stream, " "))


def bit_distance(a: Sequence[Hashable], b: Sequence[Hashable]) -> int:
    """Edit distance with bit vectors, exact for sequences of any length.

    Equal ends are cut off. Long sequences are first tried in a diagonal band: mostly equal texts
    stay within a narrow one, which is widened until the distance fits."""
    lead = 0
    for x, y in zip(a, b):
        if x != y:
            break
        lead += 1
    tail = 0
    shorter = min(len(a), len(b)) - lead
    while tail < shorter and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    a, b = a[lead:len(a) - tail], b[lead:len(b) - tail]
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return len(a)
    if len(a) >= BAND_FROM:
        reach = sum(x != y for x, y in zip(a, b)) if len(a) == len(b) else len(a) - len(b) + len(a) // 64
        while reach < len(a) // 6:
            distance = _banded(a, b, reach)
            if distance <= reach:
                return distance
            reach *= 2
    return _full(a, b)


def _full(a: Sequence[Hashable], b: Sequence[Hashable]) -> int:
    """After Hyyro (2003): one column of the distance table per element of ``b``, held as two bit
    vectors of vertical differences over all of ``a``."""
    places: dict[Hashable, int] = {}
    bit = 1
    for item in a:
        places[item] = places.get(item, 0) | bit
        bit <<= 1
    ones, last, distance = bit - 1, bit >> 1, len(a)
    rises, falls = ones, 0
    for item in b:
        match = places.get(item, 0)
        diagonal = (((match & rises) + rises) ^ rises) | match | falls
        up = falls | (ones & ~(diagonal | rises))
        down = rises & diagonal
        distance += bool(up & last) - bool(down & last)
        up = (up << 1) | 1
        rises = ones & ((down << 1) | ~(diagonal | up))
        falls = diagonal & up & ones
    return distance


def _banded(a: Sequence[Hashable], b: Sequence[Hashable], reach: int) -> int:
    """The distance if it is at most ``reach``, otherwise something larger (same paper). Only the
    rows within ``reach`` of the diagonal are kept; the band moves down a row per column, so the
    lower border is followed along the diagonal until it meets the last row, then along that row."""
    size = 2 * reach + 2
    ones, top = (1 << size) - 1, size - 1
    positions: dict[Hashable, list[int]] = {}
    for at, item in enumerate(a):
        positions.setdefault(item, []).append(at)
    for found in positions.values():
        found.reverse()
    seen: dict[Hashable, tuple[int, int]] = {}  # element -> (its bits, the band start they are for)
    rises, falls = ones & ~((1 << (size - reach - 1)) - 1), 0
    distance, start = reach, reach + 1 - size
    below = top - 1
    turn = len(a) - reach
    for column, item in enumerate(b):
        match, since = seen.get(item, (0, start))
        match >>= start - since
        ahead = positions.get(item)
        while ahead and ahead[-1] < start + size:
            place = ahead.pop() - start
            if place >= 0:
                match |= 1 << place
        seen[item] = match, start
        diagonal = (((match & rises) + rises) ^ rises) | match | falls
        up = falls | (ones & ~(diagonal | rises))
        down = diagonal & rises
        if column < turn:
            distance += not (diagonal >> top) & 1
        else:
            distance += ((up >> below) & 1) - ((down >> below) & 1)
            below -= 1
        shifted = (diagonal & ones) >> 1
        rises = ones & (down | ~(shifted | up))
        falls = shifted & up & ones
        start += 1
    return distance


# --- many pairs at once ---

REACHES = 1_000_000  # diagonals of all pairs worked on together
STRIDE = 16  # elements compared at a time


def edit_distances(a: np.ndarray, sizes_a: np.ndarray, b: np.ndarray, sizes_b: np.ndarray) -> np.ndarray:
    """Edit distances of many pairs of sequences, given as the codes (not negative) of all sequences one after the other and their lengths.

    After Ukkonen (1985): for every diagonal of a pair's table the furthest row reached with 0, 1, 2, ... edits, all pairs together, so a pair
    costs the square of its distance. One that is far apart for its length goes on to the bit vectors."""
    out = np.zeros(len(sizes_a), np.int64)
    longest = np.maximum(sizes_a, sizes_b)
    most = (5 * np.sqrt(longest)).astype(np.int64) + 8
    ends_a, ends_b = np.cumsum(sizes_a), np.cumsum(sizes_b)
    order = np.argsort(longest, kind="stable")
    at = 0
    while at < len(order):
        ahead = order[at : at + REACHES]
        some = max(1, int(np.searchsorted((2 * most[ahead] + 1) * np.arange(1, len(ahead) + 1), REACHES, side="right")))
        chosen = ahead[:some]
        out[chosen] = _reached(a, ends_a[chosen] - sizes_a[chosen], sizes_a[chosen], b, ends_b[chosen] - sizes_b[chosen], sizes_b[chosen], most[chosen])
        at += some
    for k in np.flatnonzero(out < 0).tolist():
        out[k] = bit_distance(a[ends_a[k] - sizes_a[k] : ends_a[k]].tolist(), b[ends_b[k] - sizes_b[k] : ends_b[k]].tolist())
    return out


def _padded(codes: np.ndarray, first: np.ndarray, sizes: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Some of the sequences with ``end`` behind each, as windows of ``STRIDE``, and where each begins."""
    start = np.cumsum(sizes + STRIDE) - (sizes + STRIDE)
    flat = np.full(int((sizes + STRIDE).sum()) + STRIDE, end, np.int32)
    run = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    flat[np.repeat(start, sizes) + run] = codes[np.repeat(first, sizes) + run]
    return np.lib.stride_tricks.sliding_window_view(flat, STRIDE), start


def _reached(a: np.ndarray, first_a: np.ndarray, n: np.ndarray, b: np.ndarray, first_b: np.ndarray, m: np.ndarray, most: np.ndarray) -> np.ndarray:
    """The distances of some pairs, -1 for those above ``most``."""
    (wide_a, start_a), (wide_b, start_b) = _padded(a, first_a, n, -1), _padded(b, first_b, m, -2)
    out, n, m = np.full(len(n), -1, np.int64), n.astype(np.int32), m.astype(np.int32)
    pair = np.arange(len(n))  # those still open, with a row of diagonals each
    rows = np.zeros((len(n), 1), np.int32)
    edits = 0
    while len(pair):
        diagonal = np.arange(-edits, edits + 1, dtype=np.int32)
        if edits:
            before, rows = rows, np.full((len(pair), 2 * edits + 1), -1, np.int32)
            rows[:, 1:-1] = before + 1
            np.maximum(rows[:, 2:], before, out=rows[:, 2:])
            np.maximum(rows[:, :-2], before + 1, out=rows[:, :-2])
            np.minimum(rows, np.minimum(n[pair][:, None], m[pair][:, None] - diagonal), out=rows)
        flat = rows.reshape(-1)
        lane = np.flatnonzero((flat >= 0) & (rows + diagonal >= 0).reshape(-1))
        of, k = pair[lane // len(diagonal)], lane % len(diagonal) - edits
        at_a, at_b = start_a[of] + flat[lane], start_b[of] + flat[lane] + k
        same = wide_a[at_a, 0] == wide_b[at_b, 0]
        while True:
            lane, at_a, at_b = lane[same], at_a[same], at_b[same]
            if not len(lane):
                break
            equal = wide_a[at_a] == wide_b[at_b]
            same = equal.all(axis=1)
            on = np.where(same, STRIDE, equal.argmin(axis=1))
            flat[lane] += on
            at_a, at_b = at_a + on, at_b + on
        goal = m[pair] - n[pair]
        there = np.abs(goal) <= edits
        there[there] = rows[there, goal[there] + edits] >= n[pair[there]]
        out[pair[there]] = edits
        edits += 1
        on = ~there & (most[pair] >= edits)
        pair, rows = pair[on], rows[on]
    return out


def _codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts, and how many each has."""
    joined = "".join(texts.to_pylist())
    return np.frombuffer(joined.encode("utf-32-le"), np.int32), pc.utf8_length(texts).to_numpy().astype(np.int64)


def _word_codes(*texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """The words of all texts as numbers, the same for equal words, and how many each text has."""
    lists = [pc.split_pattern(pc.if_else(pc.equal(t, ""), None, t), " ") for t in texts]
    words = pa.chunked_array([found.flatten() for found in lists], pa.large_string()).combine_chunks()
    words = (words.chunk(0) if isinstance(words, pa.ChunkedArray) else words).dictionary_encode().indices.to_numpy()
    sizes = [pc.fill_null(pc.list_value_length(found), 0).to_numpy().astype(np.int64) for found in lists]
    ends = np.cumsum([int(s.sum()) for s in sizes])
    return [(words[end - int(s.sum()) : end], s) for end, s in zip(ends.tolist(), sizes, strict=True)]


@F.pandas_udf(StructType().add("char_edits", "integer").add("word_edits", "integer"))
def _edits(ref: pd.Series, hyp: pd.Series) -> pd.DataFrame:
    texts = [pa.array(t, pa.large_string(), from_pandas=True) for t in (ref, hyp)]
    there = pc.and_(*[t.is_valid() for t in texts])
    texts = [t.filter(there) for t in texts]
    out = {}
    for name, ((a, n), (b, m)) in {"char_edits": [_codes(t) for t in texts], "word_edits": _word_codes(*texts)}.items():
        found = np.zeros(len(ref), np.int32)
        known = there.to_numpy(zero_copy_only=False)
        found[known] = edit_distances(a, n, b, m)
        out[name] = pd.array(found, "Int32")
        out[name][~known] = pd.NA
    return pd.DataFrame(out)


def word_distance(ref_words: Column, hyp_words: Column) -> Column:
    """Edit distance between two short word arrays, in the JVM: each distinct word becomes one
    character, then the built-in character distance applies. For fewer than 50,000 distinct words."""
    def encoded(words: Column, known: Column) -> Column:
        codes = F.transform(words, lambda w: F.lpad(F.hex(F.array_position(known, w) + 255), 4, "0"))
        return F.decode(F.unhex(F.array_join(codes, "")), "UTF-16BE")

    # Held in a one-element array, the list of distinct words is built once a row, not per word.
    known_once = F.array(F.array_distinct(F.concat(ref_words, hyp_words)))
    return F.transform(known_once, lambda known: F.levenshtein(encoded(ref_words, known), encoded(hyp_words, known)))[0]


def edit_counts(ref: Column, hyp: Column) -> Column:
    """struct<char_edits, word_edits> of two collapsed texts: equal texts cost nothing, the others go to the kernel in Arrow batches,
    always in full length."""
    none, equal = F.lit(None).cast("string"), ref == hyp
    return F.when(equal, F.struct(F.lit(0).alias("char_edits"), F.lit(0).alias("word_edits"))) \
        .otherwise(_edits(F.when(equal, none).otherwise(ref), F.when(equal, none).otherwise(hyp)))
