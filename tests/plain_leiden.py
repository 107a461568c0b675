"""Leiden and modularity of one small graph in plain Python, which the distributed form is held against."""

from __future__ import annotations

import math
import random


class _Leiden:
    """Leiden on an unweighted graph, as published: local moving, refinement, aggregation; visits in order of a seeded shuffle."""

    def __init__(self, pairs: list[tuple[int, int]], resolution: float, seed: int = 1):
        nodes = sorted({x for p in pairs for x in p})
        self.names, index = nodes, {n: i for i, n in enumerate(nodes)}
        self.adj: list[dict[int, float]] = [{} for _ in nodes]
        for a, b in pairs:
            self.adj[index[a]][index[b]] = self.adj[index[b]][index[a]] = 1.0
        self.loops = [0.0] * len(nodes)
        self.gamma, self.random = resolution, random.Random(seed)
        self.total = float(len(pairs))

    def run(self) -> dict[int, int]:
        flat = list(range(len(self.names)))  # each vertex's node in the current graph
        start = None
        while True:
            part = self._move(list(range(len(self.adj))) if start is None else start)
            if len(set(part)) == len(self.adj):
                break
            refined = self._refine(part)
            names = {c: i for i, c in enumerate(dict.fromkeys(refined))}
            if len(names) == len(self.adj):
                break
            flat = [names[refined[i]] for i in flat]
            start = [0] * len(names)
            for i, c in enumerate(refined):
                start[names[c]] = part[i]
            self._aggregate([names[c] for c in refined], len(names))
            ids = {c: i for i, c in enumerate(dict.fromkeys(start))}
            start = [ids[c] for c in start]
        final = part
        return {n: final[flat[i]] for i, n in enumerate(self.names)}

    def _strength(self, i: int) -> float:
        return sum(self.adj[i].values()) + 2 * self.loops[i]

    def _move(self, part: list[int]) -> list[int]:
        k = [self._strength(i) for i in range(len(self.adj))]
        weight: dict[int, float] = {}
        for i, c in enumerate(part):
            weight[c] = weight.get(c, 0.0) + k[i]
        queue = list(range(len(self.adj)))
        self.random.shuffle(queue)
        waiting, at = set(queue), 0
        fresh = max(part, default=-1) + 1
        while at < len(queue):
            i = queue[at]
            at += 1
            waiting.discard(i)
            own = part[i]
            links: dict[int, float] = {own: 0.0}
            for j, w in self.adj[i].items():
                links[part[j]] = links.get(part[j], 0.0) + w
            weight[own] -= k[i]
            gain = lambda c: links.get(c, 0.0) - self.gamma * k[i] * weight.get(c, 0.0) / (2 * self.total)
            best = max(sorted(links), key=gain)
            if gain(best) < 0:
                best, fresh = fresh, fresh + 1
            if gain(best) <= gain(own) + 1e-12:
                best = own
            weight[best] = weight.get(best, 0.0) + k[i]
            if best != own:
                part[i] = best
                for j in self.adj[i]:
                    if part[j] != best and j not in waiting:
                        waiting.add(j)
                        queue.append(j)
        return part

    def _refine(self, part: list[int]) -> list[int]:
        """Vertices of a community merged from singletons along edges, so that every part is connected."""
        k = [self._strength(i) for i in range(len(self.adj))]
        whole: dict[int, float] = {}
        for i, c in enumerate(part):
            whole[c] = whole.get(c, 0.0) + k[i]
        out = list(range(len(self.adj)))
        size, count = k[:], [1] * len(k)
        outer = [sum(w for j, w in self.adj[i].items() if part[j] == part[i]) for i in range(len(k))]
        order = list(range(len(k)))
        self.random.shuffle(order)
        for i in order:
            if count[out[i]] > 1 or outer[i] < self.gamma * k[i] * (whole[part[i]] - k[i]) / (2 * self.total):
                continue
            links: dict[int, float] = {}
            for j, w in self.adj[i].items():
                if part[j] == part[i] and out[j] != i:
                    links[out[j]] = links.get(out[j], 0.0) + w
            ok = {c: w - self.gamma * k[i] * size[c] / (2 * self.total) for c, w in links.items() if outer[c] >= self.gamma * size[c] * (whole[part[i]] - size[c]) / (2 * self.total) - 1e-12}
            if not ok or max(ok.values()) < 0:
                continue
            c = max(sorted(ok), key=ok.get)
            out[i] = c
            outer[c] += outer[i] - 2 * links[c]
            size[c] += k[i]
            count[c] += 1
        return out

    def _aggregate(self, part: list[int], n: int) -> None:
        adj: list[dict[int, float]] = [{} for _ in range(n)]
        loops = [0.0] * n
        for i, row in enumerate(self.adj):
            loops[part[i]] += self.loops[i]
            for j, w in row.items():
                a, b = part[i], part[j]
                if a == b:
                    loops[a] += w / 2
                else:
                    adj[a][b] = adj[a].get(b, 0.0) + w
        self.adj, self.loops = adj, loops


def leiden(pairs: list[tuple[int, int]], resolution: float = 1.0, seed: int = 1) -> dict[int, int]:
    """vertex -> community, communities numbered by their smallest vertex."""
    if not pairs:
        return {}
    found = _Leiden(pairs, resolution, seed).run()
    first: dict[int, int] = {}
    for v in sorted(found):
        first.setdefault(found[v], len(first))
    return {v: first[c] for v, c in found.items()}


def exact_modularity(pairs: list[tuple[int, int]], part: dict[int, int], resolution: float = 1.0) -> float:
    """The same for a small graph in plain Python."""
    m = len(pairs)
    inner: dict[int, int] = {}
    degree: dict[int, int] = {}
    for a, b in pairs:
        degree[part[a]] = degree.get(part[a], 0) + 1
        degree[part[b]] = degree.get(part[b], 0) + 1
        if part[a] == part[b]:
            inner[part[a]] = inner.get(part[a], 0) + 1
    return math.fsum(inner.get(c, 0) / m - resolution * (k / (2 * m)) ** 2 for c, k in degree.items())
