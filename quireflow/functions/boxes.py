"""Greedy one-to-one box matching inside Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, StructField, StructType

MATCHES = ArrayType(StructType([
    StructField("iou", DoubleType()), StructField("same", BooleanType()),
    StructField("p", IntegerType()), StructField("t", IntegerType())]))


SMALL_GRID = 4096  # combinations of boxes compared at once


@F.pandas_udf(MATCHES)
def match_many(candidates: pd.Series) -> pd.Series:
    """Matches of candidate lists that are sorted by (IoU falling, predicted, truth)."""
    def one(rows):
        if rows is None:
            return None
        used_p, used_t, kept = set(), set(), []
        for row in rows:
            if row["p"] not in used_p and row["t"] not in used_t:
                used_p.add(row["p"])
                used_t.add(row["t"])
                kept.append({"iou": row["iou"], "same": row["same"], "p": row["p"], "t": row["t"]})
        return kept

    return candidates.map(one)


def match_boxes(page1, x1, y1, w1, h1, type1, page2, x2, y2, w2, h2, type2) -> tuple[list, list]:
    """IoUs and type agreement of the matches of one pair of trees; boxes of a tree are bounded by
    the node limit. Only boxes of one page whose vertical spans meet are compared."""
    page1, page2 = (np.array([-1 if v is None or v != v else int(v) for v in p]) for p in (page1, page2))
    def overlaps(p, t):
        """IoU of boxes ``p`` with boxes ``t`` (index arrays that broadcast)."""
        wide = np.maximum(0.0, np.minimum(x1[p] + w1[p], x2[t] + w2[t]) - np.maximum(x1[p], x2[t]))
        high = np.maximum(0.0, np.minimum(y1[p] + h1[p], y2[t] + h2[t]) - np.maximum(y1[p], y2[t]))
        inter = wide * high
        union = w1[p] * h1[p] + w2[t] * h2[t] - inter
        return np.divide(inter, union, out=np.zeros_like(inter), where=union > 0)

    if len(x1) * len(x2) <= SMALL_GRID:
        grid = overlaps(np.arange(len(x1))[:, None], np.arange(len(x2))[None, :])
        found = np.nonzero((grid > 0) & (page1[:, None] == page2[None, :]))
        candidates = list(zip((-grid[found]).tolist(), found[0].tolist(), found[1].tolist()))
    else:
        order = np.lexsort((y2, page2))
        reach = max(h2.max(), 0.0)  # how far above a box one may start and still meet it
        candidates = []
        pages, tops = page2[order], y2[order]
        for p in range(len(x1)):
            first, last = np.searchsorted(pages, page1[p], "left"), np.searchsorted(pages, page1[p], "right")
            low = first + np.searchsorted(tops[first:last], y1[p] - reach, "left")
            stop = first + np.searchsorted(tops[first:last], y1[p] + max(h1[p], 0.0), "right")
            t = order[low:stop]
            candidates.extend((-v, p, k) for v, k in zip(overlaps(p, t).tolist(), t.tolist()) if v > 0)
    candidates.sort()
    free1, free2 = [True] * len(x1), [True] * len(x2)
    ious, same = [], []
    for v, p, t in candidates:
        if free1[p] and free2[t]:
            free1[p] = free2[t] = False
            ious.append(-v)
            same.append(type1[p] == type2[t])
    return ious, same


@F.pandas_udf(StructType([StructField("iou", ArrayType(DoubleType())), StructField("same", ArrayType(BooleanType()))]))
def match_packed(page1: pd.Series, x1: pd.Series, y1: pd.Series, w1: pd.Series, h1: pd.Series, type1: pd.Series,
                 page2: pd.Series, x2: pd.Series, y2: pd.Series, w2: pd.Series, h2: pd.Series, type2: pd.Series) -> pd.DataFrame:
    rows = [match_boxes(*row) for row in zip(page1, x1, y1, w1, h1, type1, page2, x2, y2, w2, h2, type2)]
    return pd.DataFrame({"iou": [r[0] for r in rows], "same": [r[1] for r in rows]})


MOST_COMBINATIONS = 4_000_000  # combinations of boxes, over all groups, compared at once


def match_groups(group1, box1, type1, group2, box2, type2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, IoU, same type) of the greedy matches of all groups at once; the boxes of a group (a page) stand together, ``box`` is (4, n).

    A candidate that ranks first for both of its boxes is a match whatever the others do; those are taken until none is left. A
    group with very many combinations goes through ``match_boxes`` alone."""
    groups, start2 = np.unique(group2, return_index=True)
    many2 = np.diff(np.append(start2, len(group2)))
    at = np.minimum(np.searchsorted(groups, group1), max(0, len(groups) - 1))
    meets = (groups[at] == group1) if len(groups) else np.zeros(len(group1), bool)
    first, width = np.where(meets, start2[at], 0) if len(groups) else np.zeros(len(group1), int), np.where(meets, many2[at], 0) if len(groups) else np.zeros(len(group1), int)
    found: list[tuple] = []
    big = np.isin(group1, np.unique(group1)[np.bincount(np.unique(group1, return_inverse=True)[1], width) > MOST_COMBINATIONS // 4]) if len(group1) else np.zeros(0, bool)
    for g in np.unique(group1[big]).tolist():
        one, two = np.flatnonzero(group1 == g), np.flatnonzero(group2 == g)
        ious, same = match_boxes(np.zeros(len(one)), *box1[:, one], type1[one], np.zeros(len(two)), *box2[:, two], type2[two])
        found.append((np.full(len(ious), g), np.array(ious, float), np.array(same, bool)))
    width[big] = 0
    upto = np.cumsum(width)
    a = 0
    while a < len(group1):
        # whole groups of about so many combinations
        b = int(np.searchsorted(upto, (upto[a - 1] if a else 0) + MOST_COMBINATIONS, side="right"))
        b = max(b, a + 1)
        while b < len(group1) and group1[b] == group1[b - 1]:
            b += 1
        p = np.repeat(np.arange(a, b), width[a:b])
        t = np.repeat(first[a:b] - (upto[a:b] - width[a:b] - (upto[a - 1] if a else 0)), width[a:b]) + np.arange(len(p))
        a = b
        wide = np.maximum(0.0, np.minimum(box1[0, p] + box1[2, p], box2[0, t] + box2[2, t]) - np.maximum(box1[0, p], box2[0, t]))
        high = np.maximum(0.0, np.minimum(box1[1, p] + box1[3, p], box2[1, t] + box2[3, t]) - np.maximum(box1[1, p], box2[1, t]))
        inter = wide * high
        union = box1[2, p] * box1[3, p] + box2[2, t] * box2[3, t] - inter
        iou = np.divide(inter, union, out=np.zeros_like(inter), where=union > 0)
        live = np.flatnonzero(iou > 0)
        live = live[np.lexsort((t[live], p[live], -iou[live]))]
        while len(live):
            _, for_p = np.unique(p[live], return_index=True)
            _, for_t = np.unique(t[live], return_index=True)
            won = live[np.intersect1d(for_p, for_t, assume_unique=True)]
            found.append((group1[p[won]], iou[won], type1[p[won]] == type2[t[won]]))
            live = live[~np.isin(p[live], p[won]) & ~np.isin(t[live], t[won])]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0), np.zeros(0, bool)
    return tuple(np.concatenate([f[k] for f in found]) for k in range(3))
