"""Local outlier factors of rows that are held by the part of a table, without a list of edges.

The vectors of a box and of a margin around it are in one task, which finds neighbours, reach and densities of all of them.
A factor is kept where everything it hangs on lies nearer than the end of the margin; the other vectors are judged again in
boxes that reach seven times their distance to the k-th neighbour, which holds all that counts: a neighbour's k-th distance
is at most twice, that of a neighbour's neighbour at most four times as large.
"""

from __future__ import annotations

import numpy as np

LEAF = 8
BLOCK = 300_000  # distances at once
REACH = 7.0


def _tree(x: np.ndarray) -> tuple[np.ndarray, int]:
    """Positions of x in the order of a balanced k-d tree, -1 where there is none, and its number of leaves of LEAF places."""
    depth = max(0, int(np.ceil(np.log2(max(1, len(x)) / LEAF))))
    at = np.full(LEAF << depth, -1, np.int32)
    at[: len(x)] = np.arange(len(x))
    filled = np.concatenate([x, np.full((len(at) - len(x), x.shape[1]), np.inf)]) if len(at) > len(x) else x
    at[len(x) :] = np.arange(len(x), len(at))
    for level in range(depth):
        parts = at.reshape(1 << level, -1)
        half, step = parts.shape[1] // 2, max(1, BLOCK // parts.shape[1])
        for s in range(0, len(parts), step):
            own = parts[s : s + step]
            v = filled[own]
            known = np.isfinite(v)
            width = np.where(known, v, -np.inf).max(axis=1) - np.where(known, v, np.inf).min(axis=1)
            axis = np.argmax(width, axis=1)
            key = np.take_along_axis(v, axis[:, None, None], axis=2)[:, :, 0]
            parts[s : s + step] = np.take_along_axis(own, np.argpartition(key, half, axis=1), axis=1)
    return np.where(at < len(x), at, -1), 1 << depth


def neighbourhoods(x: np.ndarray, w: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(near, used, d), each (vectors, k + 1): the k nearest other rows of each vector as vectors, the rows taken of each, distances.

    x: different vectors in the order that decides ties; w: rows of each. A vector's other rows are among its neighbours.
    """
    n, top = len(x), min(k + 1, len(x))
    at, leaves = _tree(x)
    places = np.where(at < 0, n, at).reshape(leaves, LEAF)
    filled = np.concatenate([x, np.full((1, x.shape[1]), np.inf)])
    v = filled[places]
    empty = places == n
    low, high = v.min(axis=1), np.where(empty[:, :, None], -np.inf, v).max(axis=1)
    # a bound of the distance to the k-th: the top-th nearest vector within some leaves in a row
    group = max(1, min(leaves, 1 << int(np.ceil(np.log2(max(1, 3 * top / LEAF))))))
    reach = np.full(leaves, np.inf)
    wide = v.reshape(leaves // group, group * LEAF, -1)
    step = max(1, BLOCK // (wide.shape[1] ** 2))
    for s in range(0, len(wide), step):
        p = wide[s : s + step]
        with np.errstate(invalid="ignore"):
            d = sum((p[:, :, None, c] - p[:, None, :, c]) ** 2 for c in range(p.shape[2]))
        d[np.isnan(d)] = np.inf
        r = np.partition(d, top - 1, axis=2)[:, :, top - 1].reshape(-1, group, LEAF)
        reach[s * group : (s + len(p)) * group] = np.where(empty.reshape(-1, group, LEAF)[s : s + len(p)], -1.0, r).max(axis=2).ravel()
    near, used, dist = np.zeros((n, top), np.int32), np.zeros((n, top), np.uint8 if k < 256 else np.int32), np.zeros((n, top))
    real = np.flatnonzero(~empty.all(axis=1))
    sums = [(low, high)]
    while len(sums[0][0]) > 1:
        a, b = sums[0]
        sums.insert(0, (np.minimum(a[::2], a[1::2]), np.maximum(b[::2], b[1::2])))
    for s in range(0, len(real), 16_384):
        asks = real[s : s + 16_384]
        who, node = asks, np.zeros(len(asks), np.int64)
        for a, b in sums:
            gap = np.zeros(len(who))
            for c in range(x.shape[1]):
                gap += np.maximum(0.0, np.maximum(a[node, c] - high[who, c], low[who, c] - b[node, c])) ** 2
            keep = gap <= reach[who] * (1 + 1e-9)
            who, node = who[keep], node[keep]
            if len(a) < leaves:
                who, node = np.repeat(who, 2), np.stack([2 * node, 2 * node + 1], axis=1).ravel()
        order = np.argsort(who, kind="stable")
        who, node = who[order], node[order]
        mine, first, many = np.unique(who, return_index=True, return_counts=True)
        by_size = np.argsort(many, kind="stable")
        t = 0
        while t < len(by_size):  # leaves with about as many others to look at are looked at together
            least = many[by_size[t]]
            upto = min(int(np.searchsorted(many[by_size], max(least + 1, int(least * 1.15)), side="right")), t + max(1, BLOCK // (LEAF * LEAF * int(least * 1.15 + 2))))
            chosen = by_size[t : max(upto, t + 1)]
            t += len(chosen)
            most = int(many[chosen].max())
            spots = first[chosen][:, None] + np.arange(most)
            none = np.arange(most) >= many[chosen][:, None]
            others = places[node[np.minimum(spots, len(node) - 1)]]
            others[none] = n
            others = others.reshape(len(chosen), -1)
            q = places[mine[chosen]]
            pq, po = filled[q], filled[others]
            d = np.zeros((len(chosen), LEAF, others.shape[1]))
            with np.errstate(invalid="ignore"):
                for c in range(x.shape[1]):
                    e = pq[:, :, None, c] - po[:, None, :, c]
                    e *= e
                    d += e
            row, lane = np.nonzero(q < n)
            d = d[row, lane] if len(row) < q.size else d.reshape(-1, d.shape[2])
            own, mates = q[row, lane], others[row] if len(row) < q.size else np.repeat(others, LEAF, axis=0)
            pick = np.argpartition(d, top - 1, axis=1)[:, :top]
            edge = np.take_along_axis(d, pick, axis=1).max(axis=1)
            tied = np.flatnonzero((d <= edge[:, None]).sum(axis=1) > top)
            if len(tied):  # all nearer ones, then the first of those at the edge
                far = d[tied] - edge[tied, None]
                pick[tied] = np.argpartition(np.where(far < 0, -1, np.where(far > 0, n, mates[tied])), top - 1, axis=1)[:, :top]
            j, dd = np.take_along_axis(mates, pick, axis=1), np.take_along_axis(d, pick, axis=1)
            order = np.lexsort((j, dd), axis=1)
            j, dd = np.take_along_axis(j, order, axis=1), np.take_along_axis(dd, order, axis=1)
            have = w[j] - (j == own[:, None])
            near[own], dist[own] = j, np.sqrt(dd)
            used[own] = np.clip(k - (np.cumsum(have, axis=1) - have), 0, have)
    return near, used, dist


def factors(x: np.ndarray, w: np.ndarray, k: int, low: np.ndarray, high: np.ndarray, core: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lof, sure, reach) of the vectors ``core`` of x: factor, whether it can hang on nothing outside the box low..high that holds x, and the distance to the k-th neighbour."""
    near, used, d = neighbourhoods(x, w, k)
    n, step = len(x), 200_000
    kd, lrd, lof = np.zeros(n), np.zeros(n), np.zeros(n)
    enough = np.zeros(n, bool)
    for s in range(0, n, step):
        u = used[s : s + step]
        kd[s : s + step] = np.where(u > 0, d[s : s + step], 0.0).max(axis=1)
        enough[s : s + step] = u.sum(axis=1, dtype=np.int64) >= k
    margin = np.minimum(x - low, high - x).min(axis=1)
    sure = ((kd < margin) & enough) | np.isinf(margin)
    for s in range(0, n, step):
        u, j = used[s : s + step], near[s : s + step]
        lrd[s : s + step] = 1 / ((u * np.maximum(kd[j], d[s : s + step])).sum(axis=1) / u.sum(axis=1, dtype=np.int64) + 1e-10)
    held = sure.copy()
    for s in range(0, n, step):
        held[s : s + step] &= (sure[near[s : s + step]] | (used[s : s + step] == 0)).all(axis=1)
    near, used = near[core], used[core]
    lof = (used * lrd[near]).sum(axis=1) / used.sum(axis=1, dtype=np.int64) / lrd[core]
    return lof, held[core] & (held[near] | (used == 0)).all(axis=1), np.where(enough, kd, np.inf)[core]
