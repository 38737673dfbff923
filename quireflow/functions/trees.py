"""Tree layout and tree edit distance over arrays.

A tree arrives as parallel arrays (one element per node). The two helpers here run inside Arrow batches of many trees.
"""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

BATCH_CELLS = 2_000_000  # distance-table cells worked on together


# Numbers the layout adds to every node.
LAYOUT = ("pre", "page", "post", "lmld", "mpost", "mlmld")


def layout(ids: Sequence, parents: Sequence, is_page: Sequence) -> tuple[list[int], dict[str, list[int]], int]:
    """Reading order of one tree and the ``LAYOUT`` numbers of its nodes in that order.

    Siblings must come in their order. ``page`` is the reading-order ordinal of the nearest page
    node, None without one; post-order and leftmost leaf are also given for the mirrored tree.

    No node is left out. One whose parent is missing follows the roots as a further root, and a ring of
    nodes is opened at its first; of nodes with one id the first has the children. The last value
    counts such misplaced nodes.
    """
    index: dict = {}
    for i, v in enumerate(ids):
        index.setdefault(v, i)
    misplaced = len(ids) - len(index)
    children: list[list[int]] = [[] for _ in ids]
    roots = []
    lost = []
    for i, parent in enumerate(parents):
        if parent is None:
            roots.append(i)
        elif parent in index:
            children[index[parent]].append(i)
        else:
            lost.append(i)
    roots += lost
    misplaced += len(lost)
    reached, todo = [False] * len(ids), list(roots)
    for i in range(-1, len(ids)):
        if i >= 0 and not reached[i]:  # only rings are left: cut this one before its first node
            children[index[parents[i]]].remove(i)
            roots.append(i)
            todo.append(i)
            misplaced += 1
        while todo:
            node = todo.pop()
            reached[node] = True
            todo.extend(children[node])
    visited, pages, depths = [], [], []
    stack = [(r, None, 0) for r in reversed(roots)]
    seen_pages = 0
    while stack:
        node, page, depth = stack.pop()
        if is_page[node]:
            page, seen_pages = seen_pages, seen_pages + 1
        visited.append(node)
        pages.append(page)
        depths.append(depth)
        stack.extend((child, page, depth + 1) for child in reversed(children[node]))
    size = [1] * len(ids)
    for node in reversed(visited):
        for child in children[node]:
            size[node] += size[child]
    # Mirrored, the reading order runs through the siblings from the right.
    mirrored = [0] * len(ids)
    before = 0
    for root in reversed(roots):
        mirrored[root] = before
        before += size[root]
    for node in visited:
        before = mirrored[node] + 1
        for child in reversed(children[node]):
            mirrored[child] = before
            before += size[child]
    # Post-order follows from reading order, subtree size and depth.
    sizes = [size[node] for node in visited]
    post = [pre + n - 1 - d for pre, (n, d) in enumerate(zip(sizes, depths))]
    mpost = [mirrored[node] + n - 1 - d for node, n, d in zip(visited, sizes, depths)]
    return visited, {
        "pre": list(range(len(visited))), "page": pages, "post": post, "lmld": [p - n + 1 for p, n in zip(post, sizes)],
        "mpost": mpost, "mlmld": [p - n + 1 for p, n in zip(mpost, sizes)]}, misplaced


def keyroot_cost(post: Sequence[int], lmld: Sequence[int]) -> int:
    """Sum of the sizes of all keyroot subtrees: the last node of every leftmost leaf."""
    last: dict[int, int] = {}
    for p, leaf in zip(post, lmld):
        if p > last.get(leaf, -1):
            last[leaf] = p
    return sum(p - leaf + 1 for leaf, p in last.items())


def keyroots(lmld: np.ndarray) -> np.ndarray:
    """The last node (in post-order) of every leftmost leaf."""
    return np.array(sorted({leaf: node for node, leaf in enumerate(lmld.tolist())}.values()))


def nesting(lmld: np.ndarray, roots: np.ndarray) -> np.ndarray:
    """How many keyroots nest inside each keyroot, along the deepest line. Keyroots of equal
    nesting span disjoint subtrees, so their tables can be filled side by side."""
    level = np.zeros(len(roots), int)
    open_roots: list[tuple[int, int]] = []  # (leftmost leaf, level), outermost last
    for k, leaf in enumerate(lmld[roots].tolist()):
        top = -1
        while open_roots and open_roots[-1][0] >= leaf:
            top = max(top, open_roots.pop()[1])
        level[k] = top + 1
        open_roots.append((leaf, top + 1))
    return level


def _leaf_distances(lab1: np.ndarray, l1: np.ndarray, lab2: np.ndarray, l2: np.ndarray) -> np.ndarray:
    """Distances between subtrees where one side is a single node, zero elsewhere.

    One node against a subtree costs its size, less one if the label occurs in it."""
    dist = np.zeros((len(lab1), len(lab2)), np.int32)
    labels = max(lab1.max(), lab2.max()) + 1

    def against(leaf_labels, lab, lmld):
        seen = np.zeros((labels, len(lab) + 1), np.int32)
        seen[lab, np.arange(len(lab)) + 1] = 1
        seen = seen.cumsum(axis=1, dtype=np.int32)
        end = np.arange(len(lab))
        size = (end - lmld + 1).astype(np.int32)
        within = seen[:, end + 1] > seen[:, lmld]
        return (size - within)[leaf_labels]

    leaves1, leaves2 = np.flatnonzero(l1 == np.arange(len(l1))), np.flatnonzero(l2 == np.arange(len(l2)))
    dist[leaves1] = against(lab1[leaves1], lab2, l2)
    dist[:, leaves2] = against(lab2[leaves2], lab1, l1).T
    return dist


def tree_distances(pairs: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
    """Zhang-Shasha distances of many pairs (labels1, lmld1, labels2, lmld2), in post-order.

    The tables of all keyroot pairs with the same two nesting levels, over all pairs of trees,
    are independent. They are laid side by side and filled row by row with array operations:
    the step along a row is a running minimum, kept apart between tables by an offset.
    """
    sides = []
    for _, l1, _, l2 in pairs:
        k1, k2 = keyroots(l1), keyroots(l2)
        v1, v2 = nesting(l1, k1), nesting(l2, k2)
        inner1, inner2 = l1[k1] < k1, l2[k2] < k2  # one-node tables are filled by _leaf_distances
        sides.append((k1[inner1], v1[inner1], k2[inner2], v2[inner2]))
    n1 = np.array([len(p[0]) for p in pairs])
    n2 = np.array([len(p[2]) for p in pairs])
    off1, off2, off_d = (np.concatenate([[0], np.cumsum(n)]).astype(np.int32) for n in (n1, n2, n1 * n2))
    lab1, lm1 = (np.concatenate([p[c] for p in pairs]).astype(np.int32) for c in (0, 1))
    lab2, lm2 = (np.concatenate([p[c] for p in pairs]).astype(np.int32) for c in (2, 3))
    dist = np.concatenate([_leaf_distances(*pair).ravel() for pair in pairs])

    tables: dict[tuple[int, int], list[np.ndarray]] = {}
    for p, (k1, v1, k2, v2) in enumerate(sides):
        for a in np.unique(v1):
            for b in np.unique(v2):
                i, j = k1[v1 == a], k2[v2 == b]
                grid = np.stack([np.full(len(i) * len(j), p), np.repeat(i, len(j)), np.tile(j, len(i))])
                tables.setdefault((a, b), []).append(grid)

    for level in sorted(tables):
        p, i, j = np.concatenate(tables[level], axis=1).astype(np.int32)
        li, lj = lm1[off1[p] + i], lm2[off2[p] + j]
        by_rows = np.argsort(li - i, kind="stable")  # longest first: finished tables drop off the end
        p, i, j, li, lj = p[by_rows], i[by_rows], j[by_rows], li[by_rows], lj[by_rows]
        rows, cols = i - li + 1, j - lj + 2
        first = np.concatenate([[0], np.cumsum(cols)]).astype(np.int32)
        table = np.repeat(np.arange(len(p), dtype=np.int32), cols)
        y = np.arange(first[-1], dtype=np.int32) - first[table]
        node2 = off2[p[table]] + lj[table] + np.maximum(y, 1) - 1
        edge = lm2[node2] == lj[table]
        jump = first[table] + lm2[node2] - lj[table]
        label2 = lab2[node2]
        cell = off_d[p[table]] + lj[table] + np.maximum(y, 1) - 1
        width = n2[p[table]].astype(np.int32)
        shift = y + table.astype(np.int64) * int(rows[0] + 2 * cols.max() + 1)
        border = y == 0
        active = np.searchsorted(-rows, -np.arange(1, rows[0] + 1), side="right")
        lengths = np.concatenate([[first[-1]], first[active]])
        at = np.concatenate([[0], np.cumsum(lengths)])
        filled = np.zeros(at[-1], np.int32)
        filled[:first[-1]] = y
        for x in range(1, rows[0] + 1):
            t, m = active[x - 1], lengths[x]
            node1 = off1[p[:t]] + li[:t] + x - 1
            back = lm1[node1] - li[:t]
            on_edge = np.repeat(back == 0, cols[:t]) & edge[:m]
            above = filled[at[x - 1]:at[x - 1] + m]
            here = cell[:m] + np.repeat(li[:t] + x - 1, cols[:t]) * width[:m]
            split = filled[np.repeat(at[back], cols[:t]) + jump[:m]] + dist[here]
            diagonal = np.empty(m, np.int32)
            diagonal[0] = 0
            diagonal[1:] = above[:-1]
            diagonal += np.repeat(lab1[node1], cols[:t]) != label2[:m]
            best = np.minimum(above + 1, np.where(on_edge, diagonal, split))
            best[border[:m]] = x
            row = np.minimum.accumulate(best - shift[:m]) + shift[:m]
            filled[at[x]:at[x] + m] = row
            keep = on_edge & ~border[:m]
            dist[here[keep]] = row[keep]
    return dist[off_d[1:] - 1]


ALIGNED_CELLS = 1_000_000  # cells of alignments worked on together


def aligned_distances(pairs: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
    """Distances (labels1, lmld1, labels2, lmld2), in post-order, of the pairs that an alignment of the two label sequences settles; -1 for the others.

    The edit distance of the sequences is never above that of the trees. An alignment of that cost whose aligned nodes stand in the same
    order before their children as well is a mapping of the trees, so then both are equal. Of all cheapest alignments one with the fewest
    relabelled nodes is taken."""
    out = np.full(len(pairs), -1, np.int64)
    n1, n2 = (np.array([len(p[c]) for p in pairs], np.int64) for c in (0, 2))
    order = np.lexsort((n2, n1))
    at = 0
    while at < len(order):
        # as many pairs as fit the budget when all are padded to the largest
        wide = np.maximum.accumulate(n2[order[at : at + ALIGNED_CELLS]])
        some = max(1, int(np.searchsorted((n1[order[at : at + len(wide)]] + 1) * (wide + 1) * np.arange(1, len(wide) + 1), ALIGNED_CELLS, side="right")))
        chosen = order[at : at + some]
        out[chosen] = _aligned([pairs[k] for k in chosen.tolist()], n1[chosen], n2[chosen])
        at += some
    return out


def _aligned(pairs: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], n1: np.ndarray, n2: np.ndarray) -> np.ndarray:
    many, rows, cols = len(pairs), int(n1.max()), int(n2.max())
    flat = [np.concatenate([p[c] for p in pairs]).astype(np.int64) for c in range(4)]
    first1, first2 = np.cumsum(n1) - n1, np.cumsum(n2) - n2
    padded = np.full((cols, many), -1)
    padded[np.arange(len(flat[2])) - np.repeat(first2, n2), np.repeat(np.arange(many), n2)] = flat[2]
    lab1 = np.full((rows, many), -2)
    lab1[np.arange(len(flat[0])) - np.repeat(first1, n1), np.repeat(np.arange(many), n1)] = flat[0]
    step = rows + cols + 1  # more than there are relabelled nodes
    dist = np.empty((rows + 1, cols + 1, many), np.int64 if step * step > 2**30 else np.int32)
    ramp = (np.arange(cols + 1) * step).astype(dist.dtype)[:, None]
    dist[0] = ramp
    relabel = dist.dtype.type(step + 1)
    for x in range(1, rows + 1):
        above, here = dist[x - 1], dist[x]
        here[0] = x * step
        np.minimum(above[1:] + dist.dtype.type(step), above[:-1] + np.where(padded == lab1[x - 1], dist.dtype.type(0), relabel), out=here[1:])
        here -= ramp
        np.minimum.accumulate(here, axis=0, out=here)
        here += ramp
    # back along a cheapest way, all pairs a step at a time
    pair, x, y = np.arange(many), n1.copy(), n2.copy()
    total = dist[x, y, pair] // step
    found = []
    while len(pair):
        here, inside = dist[x, y, pair], (x > 0) & (y > 0)
        up, left = np.maximum(x - 1, 0), np.maximum(y - 1, 0)
        cost = np.where(lab1[up, pair] == padded[left, pair], 0, step + 1)
        both = inside & (here == dist[up, left, pair] + cost)
        found.append((pair[both], up[both], left[both]))
        down = ~both & (x > 0) & (here == dist[up, y, pair] + step)
        x, y = np.where(both | down, up, x), np.where(both | ~down, left, y)
        more = (x > 0) | (y > 0)
        pair, x, y = pair[more], x[more], y[more]
    pair, x, y = (np.concatenate(c) for c in zip(*found))
    # before their children nodes stand by leftmost leaf, the outermost first
    big = rows + cols + 1
    key1 = (pair * big + flat[1][first1[pair] + x]) * big + (big - 1 - x)
    key2 = (pair * big + flat[3][first2[pair] + y]) * big + (big - 1 - y)
    by = np.argsort(key1)
    crossed = np.flatnonzero(np.diff(key2[by]) < 0)
    total[pair[by][crossed]] = -1
    return total


LARGE_CELLS = 4_000_000  # from so many pairs of nodes on, a pair of trees is worked on by itself, row by row


def _classes(labels: np.ndarray, lmld: np.ndarray, known: dict[tuple, int]) -> np.ndarray:
    """A number per node, the same for equal subtrees; ``known`` is shared by the trees that are compared."""
    out, open_, starts = np.empty(len(labels), np.int64), [], []
    for node, (label, leaf) in enumerate(zip(labels.tolist(), lmld.tolist(), strict=True)):
        children = len(starts)
        while children and starts[children - 1] >= leaf:
            children -= 1
        out[node] = known.setdefault((label, *open_[children:]), len(known))
        open_[children:], starts[children:] = [int(out[node])], [leaf]
    return out


def large_distance(lab1: np.ndarray, l1: np.ndarray, lab2: np.ndarray, l2: np.ndarray) -> int:
    """The distance of one pair of large trees, in post-order, without a table of all pairs of their nodes.

    Distances of subtrees are kept per pair of different subtrees, so repeated ones are compared once. Of the table of two
    keyroots only those rows are kept that a subtree still to be closed starts from: as many as keyroots nest."""
    known: dict[tuple, int] = {}
    c1, c2 = _classes(lab1, l1, known), _classes(lab2, l2, known)
    if c1[-1] == c2[-1]:
        return 0
    (names1, c1), (names2, c2) = (np.unique(c, return_inverse=True) for c in (c1, c2))
    dist = _room((len(names1), len(names2)))
    roots = []
    for c, lmld in ((c1, l1), (c2, l2)):
        all_roots = keyroots(lmld)
        roots.append(np.sort(all_roots[np.unique(c[all_roots], return_index=True)[1]]))  # the first of equal ones
    closes = np.zeros(len(l1), bool)
    closes[keyroots(l1)] = True
    for i in roots[0].tolist():
        li = int(l1[i])
        for j in roots[1].tolist():
            lj = int(l2[j])
            y = np.arange(j - lj + 2, dtype=np.int64)
            jump, edge, label2, of2 = l2[lj : j + 1] - lj, l2[lj : j + 1] == lj, lab2[lj : j + 1], c2[lj : j + 1]
            above, kept = y, {0: y}
            for x in range(1, i - li + 2):
                node = li + x - 1
                back, own = int(l1[node]) - li, dist[c1[node]]
                best = kept[back][jump] + own[of2]
                if not back:
                    best = np.where(edge, above[:-1] + (label2 != lab1[node]), best)
                row = np.append(x, np.minimum(best, above[1:] + 1)) - y
                row = np.minimum.accumulate(row, out=row)
                row += y
                if not back:
                    own[of2[edge]] = row[1:][edge]
                if closes[node]:
                    del kept[back]
                if node < i and l1[node + 1] == node + 1:
                    kept[x] = row
                above = row
    return int(dist[c1[-1], c2[-1]])


def _room(shape: tuple[int, int]) -> np.ndarray:
    """Zeros, in a file that has no name if they are too many for a task's memory."""
    cells = shape[0] * shape[1]
    if cells <= 16 * LARGE_CELLS:
        return np.zeros(shape, np.int32)
    with tempfile.TemporaryFile() as file:
        file.truncate(4 * cells)
        return np.memmap(file, np.int32, "r+", shape=shape)


def _distances(rows: list[tuple]) -> list[int | None]:
    """Distances in row order: alignments settle most pairs, the tables of the others are worked through in groups under the cell budget. Large
    pairs come one by one."""
    out: list[int | None] = [None] * len(rows)
    there = []
    for k, row in enumerate(rows):
        if row is not None and len(row[0]) * len(row[2]) > LARGE_CELLS:
            out[k] = large_distance(*row)
        elif row is not None:
            there.append(k)
    for k, d in zip(there, aligned_distances([rows[k] for k in there]).tolist()) if there else ():
        if d >= 0:
            out[k] = d
    group: list[int] = []
    cells = 0

    def flush():
        if group:
            for k, d in zip(group, tree_distances([rows[g] for g in group])):
                out[k] = int(d)
            group.clear()

    for k in there:
        if out[k] is not None:
            continue
        lab1, l1, lab2, l2 = rows[k]
        codes = np.unique(np.concatenate([lab1, lab2]), return_inverse=True)[1]
        rows[k] = codes[: len(lab1)], l1, codes[len(lab1) :], l2
        k1, k2 = keyroots(l1), keyroots(l2)
        cost = int((k1 - l1[k1] + 1).sum()) * int((k2 - l2[k2] + 1).sum())
        if cells + cost > BATCH_CELLS:
            flush()
            cells = 0
        group.append(k)
        cells += cost
    flush()
    return out


@F.pandas_udf(IntegerType())
def tree_distance(labels1: pd.Series, leaf1: pd.Series, labels2: pd.Series, leaf2: pd.Series) -> pd.Series:
    """Tree edit distance per row; rows without trees (refused pairs) give null."""
    rows: list[tuple | None] = []
    for a, la, b, lb in zip(labels1, leaf1, labels2, leaf2):
        if not len(a):
            rows.append(None)
            continue
        rows.append((a, la, b, lb))
    return pd.Series(_distances(rows), dtype="Int32")
