"""Small graphs with hand-checkable answers, and plain-Python counterparts."""

from __future__ import annotations

import random
from collections import deque

from graphloom.graph import Graph

SEVEN = [(0, 1), (2, 3), (3, 4), (3, 5), (4, 5), (5, 6)]
SCAN_SIX = [(0, 1), (1, 2), (1, 3), (2, 3), (2, 4), (2, 5), (3, 4)]
SCAN_TWO = [(0, 1), (1, 2), (1, 3), (2, 3), (3, 4), (4, 5), (5, 6), (5, 7), (6, 7), (7, 8)]
TEN = [(0, 1), (0, 2), (1, 2), (2, 3), (3, 4), (3, 7), (4, 5), (4, 6), (5, 6), (7, 8), (7, 9), (8, 9)]
CLIQUES = [(a, b) for a in range(5) for b in range(a + 1, 5)] + [(5, 6), (5, 7), (6, 7), (6, 9), (7, 8), (7, 9), (8, 9), (8, 10)]


def make(spark, edges, n=None, directed=False):
    rows = [(e[0], e[1], e[2] if len(e) > 2 else 1) for e in edges]
    kind = "double" if any(isinstance(w, float) for *_, w in rows) else "long"
    frame = spark.createDataFrame(rows, f"src long, dst long, w {kind}").coalesce(1)
    return Graph.from_edges(frame, directed, spark.range(n) if n is not None else None).store()


def pairs(frame):
    return {r[0]: r[1] for r in frame.collect()}


def random_edges(n, m, seed, most=9):
    r = random.Random(seed)
    found = {}
    while len(found) < m:
        a, b = r.randrange(n), r.randrange(n)
        if a != b:
            found[(min(a, b), max(a, b))] = r.randint(1, most)
    return [(a, b, w) for (a, b), w in found.items()]


def neighbours(edges, directed=False):
    out = {}
    for a, b, *w in edges:
        out.setdefault(a, {})[b] = w[0] if w else 1
        if not directed:
            out.setdefault(b, {})[a] = w[0] if w else 1
    return out


def dijkstra(edges, sources, directed=False):
    near, dist = neighbours(edges, directed), {s: 0 for s in sources}
    open_ = set(sources)
    while open_:
        v = min(open_, key=dist.get)
        open_.remove(v)
        for u, w in near.get(v, {}).items():
            if u not in dist or dist[v] + w < dist[u]:
                dist[u] = dist[v] + w
                open_.add(u)
    return dist


def reach(near, start, skip=None):
    seen, work = {start}, deque([start])
    while work:
        for u in near.get(work.popleft(), {}):
            if u not in seen and u != skip:
                seen.add(u)
                work.append(u)
    return seen
