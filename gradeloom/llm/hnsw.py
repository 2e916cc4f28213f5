"""Hierarchical navigable small-world graphs in numpy, built and searched in batches.

All queries of a batch walk the graph in step, so that each step is a few array operations.
"""

from __future__ import annotations

import numpy as np

DEGREE = 16  # links a new node makes; a node keeps twice as many
BATCH = 512
BUILD_BEAM = 48
TOP = 64  # a layer of so few nodes is searched whole


def beam_search(
    vectors: np.ndarray, links: np.ndarray, entry: np.ndarray, queries: np.ndarray, width: int
) -> tuple[np.ndarray, np.ndarray]:
    """Ids and similarities of the ``width`` best nodes met, best first; -1 where there are
    fewer. ``entry``: some start nodes for each query."""
    q, n = len(queries), len(vectors)
    rows = np.arange(q)[:, None]
    seen = np.zeros((q, n + 1), bool)  # column n stands for a missing link
    seen[:, n] = True
    entry = np.sort(entry, axis=1)
    entry[:, 1:][entry[:, 1:] == entry[:, :-1]] = n
    sims = np.einsum("qkd,qd->qk", vectors[np.minimum(entry, n - 1)], queries)
    sims[entry == n] = -np.inf
    seen[rows, entry] = True
    ids = np.full((q, width), n)
    best = np.full((q, width), -np.inf, np.float32)
    k = min(entry.shape[1], width)
    ids[:, :k], best[:, :k] = entry[:, :k], sims[:, :k]
    ids[best == -np.inf] = n
    fresh = ids < n
    live = np.arange(q)
    while len(live):
        open_ = np.where(fresh[live], best[live], -np.inf)
        pick = np.argpartition(-open_, 1, axis=1)[:, :2] if width > 2 else open_.argmax(1)[:, None]
        chosen = np.take_along_axis(open_, pick, 1) > -np.inf
        some = chosen.any(1)
        live, pick, chosen = live[some], pick[some], chosen[some]
        if not len(live):
            break
        r = live[:, None]
        node = np.where(chosen, ids[r, pick], n)
        fresh[r, pick] = False
        near = links[node].reshape(len(live), -1)
        near = np.where(seen[r, near], n, near)
        near = np.sort(near, axis=1)  # two chosen nodes may share a link
        near[:, 1:][near[:, 1:] == near[:, :-1]] = n
        seen[r, near] = True
        cols = (near < n).sum(1).max()
        if not cols:
            continue
        near = near[:, :cols]
        sims = np.einsum("qkd,qd->qk", vectors[np.minimum(near, n - 1)], queries[live])
        sims[near == n] = -np.inf
        all_sims = np.concatenate([best[live], sims], 1)
        top = np.argpartition(-all_sims, width - 1, axis=1)[:, :width]
        best[live] = np.take_along_axis(all_sims, top, 1)
        ids[live] = np.take_along_axis(np.concatenate([ids[live], near], 1), top, 1)
        fresh[live] = np.take_along_axis(np.concatenate([fresh[live], near < n], 1), top, 1)
        fresh[live] &= best[live] > -np.inf
    order = np.argsort(-best, axis=1, kind="stable")
    best, ids = np.take_along_axis(best, order, 1), np.take_along_axis(ids, order, 1)
    return np.where(best > -np.inf, ids, -1), best


def choose_links(vectors: np.ndarray, own: np.ndarray, ids: np.ndarray, sims: np.ndarray, count: int) -> np.ndarray:
    """For each row of candidates, best first, up to ``count`` links in different directions:
    one that is nearer to a chosen link than to the node is passed over, and taken only if
    places are left. -1 fills up."""
    q, c = ids.shape
    ok = (ids >= 0) & (ids != own[:, None])
    chosen = np.full((q, count), -1)
    n = np.zeros(q, int)
    passed = ok.copy()
    for k in range(c):
        todo = ok[:, k] & (n < count)
        if not todo.any():
            continue
        r = np.flatnonzero(todo)
        have = chosen[r]
        to = np.einsum("qkd,qd->qk", vectors[have], vectors[ids[r, k]])
        to[have < 0] = -np.inf
        good = r[sims[r, k] > to.max(1)]
        chosen[good, n[good]] = ids[good, k]
        n[good] += 1
        passed[good, k] = False
    for k in range(c):
        r = np.flatnonzero(passed[:, k] & (n < count))
        chosen[r, n[r]] = ids[r, k]
        n[r] += 1
    return chosen


class Layer:
    """One layer: ``nodes`` are positions in the shard, links are positions in the layer."""

    def __init__(
        self, vectors: np.ndarray, nodes: np.ndarray, upper: "Layer | None", links: np.ndarray | None = None
    ):
        self.nodes, self.upper = nodes, upper
        self.vectors = vectors[nodes]
        n = len(nodes)
        # The last row is that of a missing link.
        self.links = np.full((n + 1, 2 * DEGREE), n)
        self.local = {int(v): k for k, v in enumerate(nodes)}
        if links is not None:
            self.links = links
            return
        done = 0
        while done < n:
            size = min(BATCH, max(TOP, done), n - done)
            self._add(np.arange(done, done + size), done)
            done += size

    def _add(self, new: np.ndarray, done: int) -> None:
        own = self.vectors[new]
        sims = own @ own.T
        np.fill_diagonal(sims, -np.inf)
        k = min(BUILD_BEAM, len(new))
        near = np.argpartition(-sims, k - 1, axis=1)[:, :k]
        ids, sims = new[near], np.take_along_axis(sims, near, 1)
        if done:
            width = min(BUILD_BEAM, done)
            entry = self._entry(own, done)
            known, best = beam_search(self.vectors[:done], self._old(done), entry, own, width)
            ids, sims = np.concatenate([ids, known], 1), np.concatenate([sims, best], 1)
        order = np.argsort(-sims, axis=1, kind="stable")
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        ids = np.where(sims > -np.inf, ids, -1)
        links = choose_links(self.vectors, new, ids, sims, DEGREE)
        missing = len(self.nodes)
        self.links[new, :DEGREE] = np.where(links < 0, missing, links)
        # The links back.
        source = np.repeat(new, DEGREE)
        target = links.ravel()
        source, target = source[target >= 0], target[target >= 0]
        if not len(target):
            return
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        touched, start, count = np.unique(target, return_index=True, return_counts=True)
        wide = np.full((len(touched), 2 * DEGREE + int(count.max())), -1)
        wide[:, : 2 * DEGREE] = np.where(self.links[touched] == missing, -1, self.links[touched])
        place = np.arange(len(target)) - np.repeat(start, count)
        wide[np.repeat(np.arange(len(touched)), count), 2 * DEGREE + place] = source
        for a in range(0, len(touched), BATCH):
            t, w = touched[a : a + BATCH], wide[a : a + BATCH]
            w = np.sort(w, axis=1)[:, ::-1]
            w[:, 1:][w[:, 1:] == w[:, :-1]] = -1
            w = w[:, : max(2 * DEGREE, int((w >= 0).sum(1).max()))]
            sims = np.einsum("qkd,qd->qk", self.vectors[w], self.vectors[t])
            sims[w < 0] = -np.inf
            order = np.argsort(-sims, axis=1, kind="stable")
            w, sims = np.take_along_axis(w, order, 1), np.take_along_axis(sims, order, 1)
            w = np.where(sims > -np.inf, w, -1)
            full = (w >= 0).sum(1) > 2 * DEGREE
            out = w[:, : 2 * DEGREE].copy()
            if full.any():
                out[full] = choose_links(self.vectors, t[full], w[full], sims[full], 2 * DEGREE)
            self.links[t] = np.where(out < 0, missing, out)

    def _old(self, done: int) -> np.ndarray:
        """Links among the first nodes, with ``done`` for a missing one."""
        links = np.full((done + 1, self.links.shape[1]), done)
        links[:done] = np.minimum(self.links[:done], done)
        return links

    def _entry(self, queries: np.ndarray, done: int) -> np.ndarray:
        """Start nodes among the first ``done``: what the layer above finds, and the first."""
        first = np.zeros((len(queries), 1), int)
        if self.upper is None:
            return first
        ids, _ = self.upper.search(queries, 4)
        here = np.array([self.local[int(v)] for v in self.upper.nodes] + [0])
        entry = here[ids]
        return np.concatenate([np.where(entry < done, entry, 0), first], 1)

    def search(self, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.nodes)
        width = min(width, n)
        if n <= TOP or width >= n:
            sims = queries @ self.vectors.T
            ids = np.argpartition(-sims, width - 1, axis=1)[:, :width]
            sims = np.take_along_axis(sims, ids, 1)
            order = np.argsort(-sims, axis=1, kind="stable")
            return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        return beam_search(self.vectors, self.links, self._entry(queries, n), queries, width)


def dump(layer: Layer) -> list[tuple[np.ndarray, np.ndarray]]:
    """Nodes and links of all layers, the lowest first, as plain arrays."""
    out = []
    while layer is not None:
        out.append((layer.nodes.astype(np.int32), layer.links.astype(np.int32)))
        layer = layer.upper
    return out


def load(vectors: np.ndarray, parts: list[tuple[np.ndarray, np.ndarray]]) -> Layer:
    layer = None
    for nodes, links in reversed(parts):
        layer = Layer(vectors, nodes.astype(int), layer, links.astype(int))
    return layer


def build(vectors: np.ndarray, seed: int = 0) -> Layer:
    """The lowest layer, holding every row of unit ``vectors``; the layers above hang on it."""
    n = len(vectors)
    level = (-np.log(1 - np.random.default_rng(seed).random(n)) / np.log(DEGREE)).astype(int)
    layer = None
    for height in range(level.max() if n > TOP else 0, -1, -1):
        nodes = np.flatnonzero(level >= height)
        if layer is None and len(nodes) < TOP // 4 and height:
            continue
        layer = Layer(vectors, nodes if height else np.arange(n), layer)
    return layer
