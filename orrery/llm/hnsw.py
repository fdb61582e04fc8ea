"""A hierarchical navigable small-world graph in flat neighbour arrays, built and searched in batches.

Every layer is one int32 array of shape (nodes of the layer, degree), padded with -1. Insertion takes a batch of
nodes at a time: their neighbours come from a beam search of the graph so far and from each other, are thinned by
the usual diversity rule (a candidate is kept if it is nearer to the node than to any kept one), and are linked back.
All steps are numpy operations over the whole batch, so that no Python loop runs per vector.
"""

from __future__ import annotations

import numpy as np


#: Nodes that are compared whole to find where a search starts.
WHOLE = 1024


class Layer:
    """One layer: `nodes` are rows of the vector table, `links` are positions in `nodes`."""

    def __init__(self, vectors: np.ndarray, degree: int):
        self.v = vectors
        self.links = np.full((len(vectors), degree), -1, np.int32)
        self.degree = degree
        self.size = 0


def _beam(layer: Layer, q: np.ndarray, entry: np.ndarray, ef: int, wide: int = 3, floor: float = -np.inf, least: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """For each query the ef best nodes found from `entry` (queries x entries): positions (-1: none) and cosines, best first.

    The `wide` best nodes not yet looked at are expanded at a time, until all of the ef are. After `least` of them, nodes
    under `floor` are not expanded: a query that has met nothing near by then has nothing near.
    """
    n, b, degree = layer.size, len(q), layer.degree
    found_i, found_s = np.full((b, ef), -1, np.int32), np.full((b, ef), -np.inf, np.float32)
    seen = np.zeros(b * (n + 1), bool)
    base = np.arange(b, dtype=np.int64) * (n + 1)
    seen[base + n] = True  # takes the padding
    rows, ids, sims, fresh_ones = np.arange(b), found_i.copy(), found_s.copy(), np.zeros((b, ef), bool)
    new, expanded = entry.astype(np.int32), 0
    while True:
        new = np.where(new < 0, n, new)
        new.sort(axis=1)
        flat = base[:, None] + new
        fresh = ~seen[flat]
        fresh[:, 1:] &= new[:, 1:] != new[:, :-1]
        seen[flat] = True
        r, c = np.nonzero(fresh)
        node = new[r, c]
        s = np.einsum("ij,ij->i", layer.v[node], q[r])
        better = s > sims[r, -1]
        r, node, s = r[better], node[better], s[better]
        count = np.bincount(r, minlength=len(rows))
        if len(r):
            at = np.arange(len(r)) - np.repeat(np.cumsum(count) - count, count)
            more_s, more_i = np.full((len(rows), int(count.max())), -np.inf, np.float32), np.full((len(rows), int(count.max())), -1, np.int32)
            more_s[r, at], more_i[r, at] = s, node
            all_s, all_i, all_new = np.concatenate([sims, more_s], 1), np.concatenate([ids, more_i], 1), np.concatenate([fresh_ones, more_i >= 0], 1)
            top = np.argsort(-all_s, axis=1, kind="stable")[:, :ef]
            row = np.arange(len(rows))[:, None]
            sims, ids, fresh_ones = all_s[row, top], all_i[row, top], all_new[row, top]
        may = fresh_ones & (sims >= floor) if expanded >= least else fresh_ones
        place = np.cumsum(may, axis=1)
        live = place[:, -1] > 0
        if not live.all():
            found_i[rows[~live]], found_s[rows[~live]] = ids[~live], sims[~live]
            if not live.any():
                return found_i, found_s
            rows, ids, sims, fresh_ones, base, q, may, place = (x[live] for x in (rows, ids, sims, fresh_ones, base, q, may, place))
        r, c = np.nonzero(may & (place <= wide))
        fresh_ones[r, c] = False
        new = np.full((len(rows), wide, degree), -1, np.int32)
        new[r, place[r, c] - 1] = layer.links[ids[r, c]]
        new = new.reshape(len(rows), -1)
        expanded += wide


def _diverse(layer: Layer, q: np.ndarray, ids: np.ndarray, sims: np.ndarray, m: int) -> np.ndarray:
    """Up to m of the candidates (best first) of each row, none nearer to a kept one than to the row's own vector; then the nearest of the rest."""
    b, c = ids.shape
    vec = layer.v[np.maximum(ids, 0)]
    among = np.matmul(vec, vec.transpose(0, 2, 1))
    kept = np.zeros((b, c), bool)
    nearest = np.full((b, c), -np.inf, np.float32)  # similarity of each candidate to its most similar kept one
    count = np.zeros(b, np.int32)
    for j in range(c):
        ok = (ids[:, j] >= 0) & (count < m) & (sims[:, j] > nearest[:, j])
        kept[:, j] = ok
        count += ok
        nearest = np.where(ok[:, None], np.maximum(nearest, among[:, j, :]), nearest)
    rank = np.where(kept, sims + 4, np.where(ids >= 0, sims, -np.inf))
    k = min(m, c)
    top = np.argsort(-rank, axis=1, kind="stable")[:, :k]
    out = np.where(np.take_along_axis(rank, top, 1) > -np.inf, np.take_along_axis(ids, top, 1), -1)
    return out if k == m else np.pad(out, ((0, 0), (0, m - k)), constant_values=-1)


def _link(layer: Layer, at: np.ndarray, to: np.ndarray) -> None:
    """Set the links of the new nodes `at` and link back, thinning the lists that overflow."""
    deg = layer.degree
    layer.links[at, : to.shape[1]] = to
    src = np.repeat(at, to.shape[1])
    dst = to.reshape(-1)
    ok = dst >= 0
    src, dst = src[ok], dst[ok]
    order = np.argsort(dst, kind="stable")
    src, dst = src[order], dst[order]
    targets, first, counts = np.unique(dst, return_index=True, return_counts=True)
    width = int(counts.max()) if len(counts) else 0
    for lo in range(0, len(targets), 2048):
        t, f, n = targets[lo : lo + 2048], first[lo : lo + 2048], counts[lo : lo + 2048]
        w = int(n.max())
        grid = f[:, None] + np.arange(w)[None]
        more = np.where(np.arange(w)[None] < n[:, None], src[np.minimum(grid, len(src) - 1)], -1)
        cand = np.concatenate([layer.links[t], more.astype(np.int32)], 1)
        full = (cand >= 0).sum(1) > deg
        light = np.nonzero(~full)[0]
        if len(light):
            packed = np.argsort(cand[light] < 0, axis=1, kind="stable")[:, :deg]
            layer.links[t[light]] = np.take_along_axis(cand[light], packed, 1)
        heavy = np.nonzero(full)[0]
        for h in range(0, len(heavy), 512):
            hh = heavy[h : h + 512]
            s = np.matmul(layer.v[np.maximum(cand[hh], 0)], layer.v[t[hh]][:, :, None])[:, :, 0]
            s = np.where(cand[hh] >= 0, s, -np.inf)
            o = np.argsort(-s, axis=1, kind="stable")[:, : 2 * deg]
            layer.links[t[hh]] = _diverse(layer, layer.v[t[hh]], np.take_along_axis(cand[hh], o, 1), np.take_along_axis(s, o, 1).astype(np.float32), deg)
    del width


def _grow(layer: Layer, n: int, m: int, ef: int, batch: int) -> None:
    """Insert rows 0..n-1 of the layer's table in order."""
    start = min(n, 32)
    if start:
        s = layer.v[:start] @ layer.v[:start].T
        np.fill_diagonal(s, -np.inf)
        k = min(start - 1, 2 * m)
        layer.size = start
        if k > 0:
            o = np.argsort(-s, axis=1, kind="stable")[:, :k].astype(np.int32)
            _link(layer, np.arange(start), _diverse(layer, layer.v[:start], o, np.take_along_axis(s, o, 1), m))
    while layer.size < n:
        lo = layer.size
        hi = min(n, lo + max(32, min(batch, lo // 2)))
        q = layer.v[lo:hi]
        ids, sims = _beam(layer, q, _starts(layer.v[: min(lo, WHOLE)], q), ef)
        own = q @ q.T
        np.fill_diagonal(own, -np.inf)
        k = min(hi - lo - 1, m)
        if k > 0:
            o = np.argpartition(-own, k - 1, axis=1)[:, :k]
            ids = np.concatenate([ids, (o + lo).astype(np.int32)], 1)
            sims = np.concatenate([sims, np.take_along_axis(own, o, 1)], 1)
            o = np.argsort(-sims, axis=1, kind="stable")[:, :ef]
            ids, sims = np.take_along_axis(ids, o, 1), np.take_along_axis(sims, o, 1)
        layer.size = hi
        _link(layer, np.arange(lo, hi), _diverse(layer, q, ids, sims, m))


def _starts(v: np.ndarray, q: np.ndarray, n: int = 4) -> np.ndarray:
    """The n rows of `v` most similar to each query, by comparing all."""
    n = min(n, len(v))
    return np.argpartition(q @ v.T, len(v) - n, axis=1)[:, len(v) - n :].astype(np.int32)


class Graph:
    """The graph over unit vectors (float32, one per row); rows are shuffled by a fixed seed, since batches assume no order."""

    def __init__(self, vectors: np.ndarray, m: int = 12, ef: int = 32, batch: int = 512, fan: int = 12, seed: int = 7):
        n = len(vectors)
        self.order = np.random.default_rng(seed).permutation(n)
        self.place = np.empty(n, np.int32)
        self.place[self.order] = np.arange(n)
        base = np.ascontiguousarray(vectors[self.order], np.float32)
        self.layers: list[Layer] = []
        while True:  # layer k holds the first n / fan^k rows, so that positions agree between layers
            layer = Layer(base[:n], 2 * m)
            _grow(layer, n, m, ef, batch)
            self.layers.append(layer)
            if n <= 64:
                break
            n = max(1, n // fan)

    def search(self, q: np.ndarray, k: int, ef: int = 32, floor: float = -np.inf, least: int = 16, batch: int = 512, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the k most similar vectors for each query (-1: none) and their approximate cosines.

        With a `floor`, only neighbours of that similarity are wanted, and a search that meets none near it ends early.
        `own` are the rows of the queries themselves, if they are in the graph: they start from their own nodes.
        """
        if not len(self.order):
            return np.full((len(q), k), -1, np.int64), np.full((len(q), k), -np.inf, np.float32)
        out_i, out_s = [], []
        for lo in range(0, len(q), batch):
            part = np.ascontiguousarray(q[lo : lo + batch], np.float32)
            if own is not None:
                at = self.place[own[lo : lo + batch]][:, None]
            else:
                whole = next(k for k, layer in enumerate(self.layers) if layer.size <= WHOLE)  # small enough to compare all
                at = _starts(self.layers[whole].v, part)
                for layer in reversed(self.layers[1:whole]):
                    at, _ = _beam(layer, part, at, 4)
            i, s = _beam(self.layers[0], part, at, max(ef, k), floor=floor, least=least)
            out_i.append(np.where(i[:, :k] >= 0, self.order[np.maximum(i[:, :k], 0)], -1))
            out_s.append(s[:, :k])
        return np.concatenate(out_i) if out_i else np.zeros((0, k), np.int64), np.concatenate(out_s) if out_s else np.zeros((0, k), np.float32)
