"""Exact search for near points in blocks: trees of cuts whose upper sides overlap by the radius, and the kernels inside a block.

Every pair within the radius meets in at least one block: at a cut, rows of the lower side that lie within the radius of the
cut go to both sides. So each block can be searched alone, and blocks are as small as the data allow.
"""
from __future__ import annotations

import numpy as np

#: Pairs whose distances are taken at a time, and pairs looked at at a time.
TILE, PAIRS = 65_536, 1_000_000
#: Rows of a cell that isn't cut further, and copies of a row in cells from which none is.
CELL_ROWS, CELL_COPIES = 256, 16


def _directions(x: np.ndarray) -> np.ndarray:
    """Principal directions, widest last, of the rows with their far values clipped, as a few far rows would turn all of them."""
    lo, hi = np.quantile(x, (0.02, 0.98), axis=0)
    c = np.clip(x, lo, hi) - np.median(x, 0)
    return np.linalg.eigh(c.T @ c)[1]


#: Share of a side's rows that may lie within the radius of a cut and so go to both sides.
BORDER = 0.45


def kd_build(x: np.ndarray, r: float, leaf: int) -> list:
    """Nodes (direction, cut, left, right), or (None, leaf number, -1, -1). A cut goes along the principal direction and where the
    fewest rows lie within the radius of it, between the third and the seventh tenth; where those are more than BORDER of all the side
    isn't cut. Leaves are counted with the rows that come in both sides."""
    nodes: list = []
    leaves = 0

    def grow(x):
        nonlocal leaves
        at = len(nodes)
        nodes.append(None)
        if len(x) > max(leaf, 8):
            best = None
            for v in _directions(x).T[::-1]:  # the widest first, for ties
                t = x @ v
                s = np.sort(t)
                cuts = np.quantile(t, (0.5, 0.45, 0.55, 0.4, 0.6, 0.35, 0.65, 0.3, 0.7))  # the middle first, for ties
                near = np.searchsorted(s, cuts, "left") - np.searchsorted(s, cuts - r, "left")
                near = np.where(near <= 0.75 * np.searchsorted(s, cuts, "left"), near, len(x))  # else the upper side is hardly smaller
                if (best is None or near.min() < best[0]) and s[0] < cuts[near.argmin()]:
                    best = near.min(), v, cuts[near.argmin()]
                if r == 0:  # nothing lies within it: the widest
                    break
            if best is not None and best[0] <= BORDER * len(x):
                v, m = best[1:]
                t = x @ v
                a, b = grow(x[t < m]), grow(x[t >= m - r])
                nodes[at] = (v, float(m), a, b)
                return at
        nodes[at] = (None, leaves, -1, -1)
        leaves += 1
        return at

    grow(x)
    return nodes


def kd_extend(nodes: list, leaf: int, tree: list) -> list:
    """The nodes with a leaf replaced by a tree, whose leaves take new numbers."""
    at = next(i for i, n in enumerate(nodes) if n[0] is None and n[1] == leaf)
    start, number = len(nodes), 1 + max(n[1] for n in nodes if n[0] is None)
    moved = [(None, n[1] + number, -1, -1) if n[0] is None else (n[0], n[1], n[2] + start, n[3] + start) for n in tree]
    out = [*nodes, *moved]
    out[at] = moved[0]
    return out


def kd_reach(nodes: list, x: np.ndarray, r: float):
    """Yields (leaf, row numbers): every leaf that a row has points within r in, whichever side of a cut they are on."""
    stack = [(0, np.arange(len(x)))]
    while stack:
        at, idx = stack.pop()
        if not len(idx):
            continue
        v, m, a, b = nodes[at]
        if v is None:
            yield m, idx
            continue
        t = x[idx] @ v
        stack += [(a, idx[t < m + r + 1e-9]), (b, idx[t >= m - r - 1e-9])]


def kd_route(nodes: list, x: np.ndarray, r: float | None):
    """Yields (leaf, row numbers); rows near a cut come in both sides, without a radius every row in one leaf."""
    stack = [(0, np.arange(len(x)))]
    while stack:
        at, idx = stack.pop()
        if not len(idx):
            continue
        v, m, a, b = nodes[at]
        if v is None:
            yield m, idx
            continue
        t = x[idx] @ v
        stack += [(a, idx[t < m]), (b, idx[t >= (m if r is None else m - r - 1e-9)])]


def _axes(x: np.ndarray) -> np.ndarray:
    """Coordinates along the principal directions of some of the rows, widest first. Far values are clipped; neither that nor the
    rotation takes two rows farther apart."""
    c = np.clip(x - np.median(x[:: max(1, len(x) // 2000)], 0), -1e4, 1e4)
    some = c[:: max(1, len(c) // 2000)]
    return c @ np.linalg.eigh(some.T @ some)[1][:, ::-1]


def _cells(t: np.ndarray, r: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(row, cell, bumped) and how many axes were cut. Axis by axis, cells of more than CELL_ROWS rows are cut into slices of 2 r, and
    rows within r of a slice's upper end come in the next one as well. Rows within r then meet in a cell; ``bumped`` has a bit for
    every axis that took the row a slice up, and two rows with a bit in common meet elsewhere without it."""
    row, cell, bumped = np.arange(len(t)), np.zeros(len(t), np.int64), np.zeros(len(t), np.int64)
    for d in range(t.shape[1] - 1):
        size = np.bincount(cell)
        cut = size[cell] > CELL_ROWS
        if not cut.any() or len(row) > CELL_COPIES * len(t):
            return row, cell, bumped, d
        at = t[row, d] / (2 * r)
        own = np.where(cut, np.floor(at), 0).astype(np.int64)
        up = np.nonzero(cut & (np.floor(at + 0.5 + 1e-6) > own))[0]
        row, bumped = np.r_[row, row[up]], np.r_[bumped, bumped[up] | 1 << d]
        key = np.r_[cell, cell[up]] * (own.max() - own.min() + 2) + np.r_[own, own[up] + 1] - own.min()
        o = np.argsort(key, kind="stable")
        row, bumped, key = row[o], bumped[o], key[o]
        cell = np.cumsum(np.r_[0, key[1:] != key[:-1]])
    return row, cell, bumped, t.shape[1] - 1


def near_pairs(x: np.ndarray, r: float, side: np.ndarray | None = None):
    """Yields arrays (i, j, dist) of row pairs i < j within r, exact in float64, each pair once.

    With ``side`` only pairs between rows of different sides come. Cells of slices are joined within a window along one more axis,
    PAIRS pairs at a time; the axes that are left rule out most of them before their distance is taken.
    """
    if len(x) < 2:
        return
    t = _axes(x)
    row, cell, bumped, d = _cells(t, r)
    low = t[:, d].min()
    span = t[:, d].max() - low + 4 * r + 1
    key = cell * span + (t[row, d] - low)
    o = np.argsort(key, kind="stable")
    row, bumped, key = row[o], bumped[o], key[o]
    count = np.searchsorted(key, key + r + 1e-6 + 1e-15 * key[-1], "right") - np.arange(1, len(key) + 1)
    ends = np.cumsum(count)
    most, columns = r * r + 1e-6, np.ascontiguousarray(t.T)
    axes = [q % t.shape[1] for q in range(d, d + t.shape[1])]
    near = columns[axes[:4]][:, row]  # in the order of the cells, where the rows of a window stand side by side
    first = 0
    while first < len(key):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + PAIRS, "right")))
        n = count[first:last]
        a = np.repeat(np.arange(first, last), n)
        b = np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + a + 1
        first = last
        d2 = np.zeros(len(a))
        for c in near:
            d2 += (c[a] - c[b]) ** 2
            keep = np.nonzero(d2 <= most)[0]
            if len(keep) < 0.9 * len(a):
                a, b, d2 = a[keep], b[keep], d2[keep]
        keep = (bumped[a] & bumped[b] == 0) & (d2 <= most)
        i, j, d2 = row[a[keep]], row[b[keep]], d2[keep]
        for q in axes[4:]:
            if len(i) < 64:
                break
            d2 += (columns[q][i] - columns[q][j]) ** 2
            keep = np.nonzero(d2 <= most)[0]
            if len(keep) < 0.9 * len(i):
                i, j, d2 = i[keep], j[keep], d2[keep]
        if side is not None:
            keep = side[i] != side[j]
            i, j = i[keep], j[keep]
        for s in range(0, len(i), TILE):
            p, q = i[s : s + TILE], j[s : s + TILE]
            dist = np.sqrt(((x[p] - x[q]) ** 2).sum(1))
            keep = dist <= r
            p, q = p[keep], q[keep]
            yield np.minimum(p, q), np.maximum(p, q), dist[keep]


def top_k(src: np.ndarray, dst: np.ndarray, dist: np.ndarray, k: int):
    """Of directed links keep, for each src, each dst once and the k with the least (dist, dst)."""
    o = np.lexsort((dst, dist, src))
    src, dst, dist = src[o], dst[o], dist[o]
    new = np.ones(len(src), bool)
    new[1:] = (src[1:] != src[:-1]) | (dst[1:] != dst[:-1]) | (dist[1:] != dist[:-1])
    src, dst, dist = src[new], dst[new], dist[new]
    first = np.r_[True, src[1:] != src[:-1]] if len(src) else np.empty(0, bool)
    start = np.maximum.accumulate(np.where(first, np.arange(len(src)), 0))
    keep = np.arange(len(src)) - start < k
    return src[keep], dst[keep], dist[keep]


def links_top_k(ids: np.ndarray, x: np.ndarray, r: float, k: int, side=None):
    """Directed links within r, at most the k nearest for each row; the buffer is cut back whenever it grows."""
    out, held = [], 0
    for i, j, d in near_pairs(x, r, side):
        a, b = ids[i], ids[j]
        out.append((np.r_[a, b], np.r_[b, a], np.r_[d, d]))
        held += 2 * len(a)
        if held > 2_000_000:
            out = [top_k(*map(np.concatenate, zip(*out)), k)]
            held = len(out[0][0])
            if held > 1_500_000:
                held = 0
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    return top_k(*map(np.concatenate, zip(*out)), k)


def join_labels(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Give the ends of every link the smallest label of their set, in place (labels are row numbers of set minima)."""
    while True:
        a, b = label[i], label[j]
        m = np.minimum(a, b)
        if (a == b).all():
            return
        np.minimum.at(label, a, m)
        np.minimum.at(label, b, m)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def local_sets(x: np.ndarray, r: float, side=None) -> np.ndarray:
    """For each row, the first row of the set that links within r connect it to."""
    label = np.arange(len(x))
    for i, j, _ in near_pairs(x, r, side):
        join_labels(label, i, j)
    return label
