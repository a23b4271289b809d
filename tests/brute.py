"""Plain recursive and relaxation answers for small inputs."""

from __future__ import annotations

from functools import lru_cache

FAR = 10**15


def distances(edges, nodes):
    """All distances over interior edges [(u, v, w)]; and to the boundary, v = None."""
    d = {(a, b): 0 if a == b else FAR for a in nodes for b in nodes}
    rim = {a: FAR for a in nodes}
    for u, v, w in edges:
        if v is None:
            rim[u] = min(rim[u], w)
        elif u != v:
            d[u, v] = d[v, u] = min(d[u, v], w)
    for k in nodes:
        for a in nodes:
            for b in nodes:
                d[a, b] = min(d[a, b], d[a, k] + d[k, b])
    return d, {a: min(d[a, k] + rim[k] for k in nodes) for a in nodes}


def least_weight(hits, d, rim):
    """Least weight of pairing every hit with another or the boundary; None when impossible."""
    hits = sorted(hits)

    @lru_cache(None)
    def best(mask):
        if not mask:
            return 0
        i = (mask & -mask).bit_length() - 1
        rest = mask ^ (1 << i)
        out = rim[hits[i]] + best(rest)
        for j in range(i + 1, len(hits)):
            if rest >> j & 1:
                out = min(out, d[hits[i], hits[j]] + best(rest ^ (1 << j)))
        return min(out, FAR)

    value = best((1 << len(hits)) - 1)
    return None if value >= FAR else value
