"""The hierarchy walked edge by edge in one process, to compare the distributed one with."""

from __future__ import annotations

import pandas as pd

from foldwise.operators.hierarchy import LEAST_DISTANCE


class Component:
    __slots__ = ("size", "cluster", "mass", "below", "waiting")

    def __init__(self, comp, size=1, cluster=None, mass=0.0, below=None):
        self.size, self.cluster, self.mass, self.below = size, cluster, mass, below
        self.waiting = [comp] if cluster is None else []


def walk(edges, states: dict[int, Component], min_size: int):
    """Merge along (a, b, weight, number) edges; returns closed clusters, joins, and the component map.

    A cluster is named by the number of the edge that opened it.
    """
    parent = {c: c for c in states}
    closed: list[tuple] = []
    joined: list[tuple[int, int]] = []

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def close(c: Component, density: float, into: int, weight: float) -> float:
        stability = c.mass - c.size * density
        chosen = c.below is None or not c.below > stability
        best = stability if chosen else c.below
        closed.append((c.cluster, into, weight, best, chosen))
        return best

    for lo, hi, weight, number in edges:
        a, b = find(lo), find(hi)
        density = 1.0 / max(weight, LEAST_DISTANCE)
        x, y = states[a], states[b]
        if x.size < y.size or (x.size == y.size and b < a):
            a, b, x, y = b, a, y, x
        parent[b] = a
        size = x.size + y.size
        if y.cluster is not None:
            x.below = close(x, density, number, weight) + close(y, density, number, weight)
            x.cluster, x.mass = number, size * density
        elif x.cluster is not None:
            x.mass += y.size * density
            joined.extend((w, x.cluster) for w in y.waiting)
        else:
            x.waiting += y.waiting
            if size >= min_size:
                x.cluster, x.mass, x.below = number, size * density, None
                joined.extend((w, number) for w in x.waiting)
                x.waiting = []
        x.size = size
        del states[b]
    return closed, joined, {c: find(c) for c in parent}


def resolve(clusters: list[tuple], radius: float) -> dict[int, int | None]:
    """Selected cluster at or above each cluster; None is noise.  Input as closed by ``walk`` plus the root."""
    up = {c: p for c, p, _, _, _ in clusters}
    birth = {c: w for c, _, w, _, _ in clusters}
    chosen = {c: f for c, _, _, _, f in clusters}
    order = sorted(up, key=lambda c: -c)  # a parent is opened by a later edge, so it has a larger number
    top: dict[int, int | None] = {}
    lifted: dict[int, int | None] = {}
    for c in order:
        p = up[c]
        if p is None:
            top[c] = lifted[c] = None
            continue
        top[c] = top[p] if top[p] is not None else (c if chosen[c] else None)
        lifted[c] = c if up[p] is None or birth[c] > radius else lifted[p]
        if lifted[c] is None:
            lifted[c] = c
    final = {t if birth[t] >= radius else lifted[t] for t in top.values() if t is not None}
    at: dict[int, int | None] = {}
    for c in order:
        p = up[c]
        above = at[p] if p is not None else None
        at[c] = above if above is not None else (c if c in final else None)
    return at


def in_one_process(min_size: int, radius: float):
    def run(frames):
        parts = list(frames)
        if not parts:
            return
        table = pd.concat(parts).sort_values(["weight", "lo", "hi"], kind="stable")
        edges = list(zip(table["lo"].tolist(), table["hi"].tolist(), table["weight"].tolist(), range(len(table))))
        nodes = set(table["lo"].tolist()) | set(table["hi"].tolist())
        states = {n: Component(n) for n in nodes}
        closed, joined, _ = walk(edges, states, min_size)
        closed += [(s.cluster, None, float("inf"), 0.0, False) for s in states.values() if s.cluster is not None]
        at = resolve(closed, radius)
        pos = [n for n, c in joined if at[c] is not None]
        yield pd.DataFrame({"pos": pos, "label": [at[c] for n, c in joined if at[c] is not None]}, dtype="int64")

    return run
