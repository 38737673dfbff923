"""Layout of many trees at once: reading order, post-order and leftmost leaves as array operations over rows.

Rows are nodes, grouped by tree, siblings in their order. Trees are walked level by level, all of them together.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from quireflow.functions.trees import layout as lay_out_one


@dataclass
class Laid:
    """Numbers of each node (in the order of the rows given) and of each tree.

    ``page`` is the reading-order ordinal of the nearest page node, -1 without one. ``mpost`` and ``mlmld`` belong to the mirrored tree.
    ``cost`` and ``mirrored_cost`` are the sizes of all keyroot subtrees; ``misplaced`` counts nodes without a place of their own."""

    pre: np.ndarray
    page: np.ndarray
    post: np.ndarray
    lmld: np.ndarray
    mpost: np.ndarray
    mlmld: np.ndarray
    keyroot: np.ndarray
    first: np.ndarray
    cost: np.ndarray
    mirrored_cost: np.ndarray
    misplaced: np.ndarray


def parent_rows(tree: np.ndarray, ids: np.ndarray, parents: np.ndarray, is_root: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The row of each node's parent (-1: none), which parents are missing, and which rows repeat an id. Of nodes with one id the first
    has the children."""
    n, asks = len(ids), np.flatnonzero(~is_root)
    values, code = np.unique(np.concatenate([ids, parents[asks]]), return_inverse=True)
    place = tree * len(values)
    known, first_row, of = np.unique(place + code[:n], return_index=True, return_inverse=True)
    wanted = place[asks] + code[n:]
    at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
    there = known[at] == wanted
    row, lost = np.full(n, -1), np.zeros(n, bool)
    row[asks[there]] = first_row[at[there]]
    lost[asks[~there]] = True
    return row, lost, first_row[of] != np.arange(n)


def _keyroots(base: np.ndarray, post: np.ndarray, leaf: np.ndarray) -> np.ndarray:
    """Which nodes are the last of their leftmost leaf."""
    last = np.full(len(post), -1)
    np.maximum.at(last, base + leaf, post)
    return last[base + leaf] == post


def lay_out(tree: np.ndarray, ids: np.ndarray, parents: np.ndarray, is_root: np.ndarray, is_page: np.ndarray) -> Laid:
    """``tree`` numbers the trees from 0 and does not fall. Nodes with a missing parent follow as further roots, rings are opened at
    their first node (``trees.layout``)."""
    n, many = len(ids), int(tree[-1]) + 1 if len(tree) else 0
    first = np.searchsorted(tree, np.arange(many))
    parent, lost, repeated = parent_rows(tree, ids, parents, is_root)
    misplaced = np.bincount(tree, lost, minlength=many) + np.bincount(tree, repeated, minlength=many)
    # siblings side by side; the roots of a tree are siblings under a number of their own
    family = np.where(parent >= 0, parent, n + tree)
    order = np.argsort(2 * family + lost, kind="stable")
    count = np.bincount(family, minlength=n + many)
    start = np.cumsum(count) - count
    levels = [order[start[n] :] if many else order]
    depth = np.full(n, -1)
    depth[levels[0]] = 0
    while True:
        sizes = count[levels[-1]]
        total = int(sizes.sum())
        if not total:
            break
        below = order[np.repeat(start[levels[-1]] - np.cumsum(sizes) + sizes, sizes) + np.arange(total)]
        depth[below] = len(levels)
        levels.append(below)
    size = (depth >= 0).astype(np.int64)
    for level in reversed(levels[1:]):
        np.add.at(size, parent[level], size[level])
    upto = np.cumsum(size[order])
    left = np.empty(n, np.int64)
    left[order] = upto - size[order] - (upto - size[order])[start[family[order]]]
    right = np.bincount(family, size, minlength=n + many).astype(np.int64)[family] - left - size
    pre, mpre, near = left.copy(), right.copy(), np.where(is_page, np.arange(n), -1)
    for level in levels[1:]:
        up = parent[level]
        pre[level] += pre[up] + 1
        mpre[level] += mpre[up] + 1
        near[level] = np.where(is_page[level], level, near[up])
    post, mpost = pre + size - 1 - depth, mpre + size - 1 - depth
    page_rows = np.flatnonzero(is_page)
    page_rows = page_rows[np.lexsort((pre[page_rows], tree[page_rows]))]
    ordinal = np.full(n + 1, -1)
    ordinal[page_rows] = np.arange(len(page_rows)) - np.searchsorted(tree[page_rows], tree[page_rows])
    laid = Laid(pre, ordinal[near], post, post - size + 1, mpost, mpost - size + 1, np.zeros(0, bool), first, np.zeros(0), np.zeros(0), misplaced.astype(np.int64))
    for t in np.unique(tree[depth < 0]).tolist():
        _lay_out_rings(laid, first[t], first[t + 1] if t + 1 < many else n, t, ids, parents, is_root, is_page)
    base = first[tree]
    laid.keyroot = _keyroots(base, laid.post, laid.lmld)
    mirrored = _keyroots(base, laid.mpost, laid.mlmld)
    laid.cost = np.bincount(tree, np.where(laid.keyroot, laid.post - laid.lmld + 1, 0), minlength=many).astype(np.int64)
    laid.mirrored_cost = np.bincount(tree, np.where(mirrored, laid.mpost - laid.mlmld + 1, 0), minlength=many).astype(np.int64)
    return laid


def _lay_out_rings(laid: Laid, a: int, b: int, tree: int, ids: np.ndarray, parents: np.ndarray, is_root: np.ndarray, is_page: np.ndarray) -> None:
    """One tree with a ring, node by node."""
    above = [None if r else p for r, p in zip(is_root[a:b].tolist(), parents[a:b].tolist(), strict=True)]
    visited, numbers, astray = lay_out_one(ids[a:b].tolist(), above, is_page[a:b].tolist())
    rows = a + np.array(visited)
    for name, values in numbers.items():
        getattr(laid, name)[rows] = [-1 if v is None else v for v in values]
    laid.misplaced[tree] = astray
