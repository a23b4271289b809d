"""Minimum-weight pairing of one small group of hits.

A compact primal-dual pairing on a list of distances. All unpaired trees grow
at the same rate, so the run has a time axis; its tight edges are the events.
One group is the unit Spark hands out; groups never know of each other.
"""

from __future__ import annotations

import numpy as np

FAR = 2**61
RIM = -1


class Group:
    """``rim[i]``: boundary distance of hit i (FAR if none); pairs (i, j, d) with i < j."""

    def __init__(self, rim: np.ndarray, i: np.ndarray, j: np.ndarray, d: np.ndarray):
        n = len(rim)
        order = np.lexsort((j, i))
        self.n, self.rim = n, rim.astype(np.int64)
        self.i, self.j, self.d = i[order], j[order], d[order].astype(np.int64)
        self.cover = np.zeros(n, np.int64)  # how far each hit's region has reached
        self.most = np.zeros(n, np.int64)  # the furthest it ever reached
        self.top = np.arange(n)  # outermost region of each hit
        self.inside: dict[int, int] = {}  # region -> enclosing region
        self.parts: dict[int, list[tuple[int, int, int]]] = {}  # region -> ring of (part, own hit, next part's hit)
        self.hits = {k: [k] for k in range(n)}
        self.dual: dict[int, int] = {}  # rings only
        self.sign = {k: 1 for k in range(n)}
        self.tree = {k: k for k in range(n)}
        self.mate: dict[int, tuple[int, int] | None] = {k: None for k in range(n)}
        self.up: dict[int, tuple[int, int]] = {}  # shrinking region -> edge to its parent
        self.rate = np.ones(n, np.int64)
        self.now = 0
        self.events: list[tuple[int, str]] = []
        self.next_id = n

    # state changes ---------------------------------------------------------

    def _set(self, region: int, sign: int) -> None:
        self.sign[region] = sign
        self.rate[self.hits[region]] = sign

    def _flip_to_root(self, region: int, edge: tuple[int, int]) -> None:
        """Pair ``region`` over ``edge`` and shift the pairing along its path to the root."""
        while True:
            old = self.mate[region]
            self.mate[region] = edge
            if old is None:
                return
            shrunk = int(self.top[old[1]])
            own, parent_hit = self.up[shrunk]
            self.mate[shrunk] = (own, parent_hit)
            region, edge = int(self.top[parent_hit]), (parent_hit, own)

    def _settle(self, *trees: int) -> None:
        for region in [r for r, s in self.sign.items() if s and self.tree[r] in trees]:
            self._set(region, 0)
            self.up.pop(region, None)

    def _path(self, region: int) -> list[int]:
        """Regions from ``region`` up to its root."""
        out = [region]
        while (edge := self.mate[out[-1]] if self.sign[out[-1]] > 0 else self.up[out[-1]]) is not None:
            out.append(int(self.top[edge[1]]))
        return out

    def _ring(self, a: int, b: int, edge: tuple[int, int]) -> None:
        """Close an odd ring of one tree into a single growing region."""
        left, right = self._path(a), self._path(b)
        common = next(r for r in left if r in set(right))
        left, right = left[: left.index(common) + 1], right[: right.index(common)]
        parts: list[tuple[int, int, int]] = []
        # Round the ring: from the common root down to a, across, and b back up.
        down = left[::-1]
        for part, nxt in zip(down, down[1:]):
            own, other = self.mate[nxt] if self.sign[nxt] > 0 else self.up[nxt]
            parts.append((part, other, own))
        parts.append((a, edge[0], edge[1]))
        for part in right:
            own, other = self.mate[part] if self.sign[part] > 0 else self.up[part]
            parts.append((part, own, other))
        new, self.next_id = self.next_id, self.next_id + 1
        self.parts[new], self.dual[new] = parts, 0
        self.hits[new] = [h for part, _, _ in parts for h in self.hits[part]]
        self.mate[new], self.tree[new] = self.mate[common], self.tree[common]
        for part, _, _ in parts:
            self.inside[part] = new
            self.sign.pop(part)
            self.up.pop(part, None)
        self.top[self.hits[new]] = new
        self._set(new, 1)

    def _part_of(self, ring: int, hit: int) -> int:
        region = hit
        while self.inside[region] != ring:
            region = self.inside[region]
        return region

    def _turned(self, ring: int, first: int) -> list[tuple[int, int, int]]:
        parts = self.parts[ring]
        at = next(k for k, p in enumerate(parts) if p[0] == first)
        return parts[at:] + parts[:at]

    def _open_ring(self, ring: int) -> None:
        """Undo an exhausted shrinking ring; its even path stays in the tree."""
        up, mate, tree = self.up.pop(ring), self.mate[ring], self.tree[ring]
        self.sign.pop(ring)
        start, goal = self._part_of(ring, up[0]), self._part_of(ring, mate[0])
        parts = self._turned(ring, start)
        at = next(k for k, p in enumerate(parts) if p[0] == goal)
        if at % 2:  # go round the other way so that an odd number of parts lies on the path
            parts = [parts[0]] + parts[:0:-1]
            links = [(b, a) for _, a, b in self._turned(ring, start)][::-1]
            at = len(parts) - at
            ring_parts = [(p[0], *link) for p, link in zip(parts, links)]
        else:
            ring_parts = parts
        for part, _, _ in ring_parts:
            self.inside.pop(part)
            self.top[self.hits[part]] = part
            self.tree[part] = tree
        for k, (part, own, other) in enumerate(ring_parts):
            nxt = ring_parts[(k + 1) % len(ring_parts)][0]
            if k <= at:
                self._set(part, -1 if k % 2 == 0 else 1)
                if k % 2 == 0:
                    if k == 0:
                        self.up[part] = up
                    if k < at:
                        self.mate[part], self.mate[nxt] = (own, other), (other, own)
                    else:
                        self.mate[part] = mate
                elif k < at:
                    self.up[nxt] = (other, own)
            else:
                self._set(part, 0)
                if (k - at) % 2:
                    self.mate[part], self.mate[nxt] = (own, other), (other, own)
        self.parts.pop(ring), self.hits.pop(ring), self.dual.pop(ring)

    # time ------------------------------------------------------------------

    def run(self, horizon: int | None = None) -> bool:
        """Grow until everything is paired (True) or time or partners run out (False)."""
        while any(s > 0 for s in self.sign.values()):
            event = self._next_event()
            wait = event[0] if event else FAR
            if horizon is not None and self.now + wait > horizon:
                self._advance(max(0, horizon - self.now))
                return False
            if event is None:
                return False
            self._advance(wait)
            self._handle(*event[1:])
        return True

    def _advance(self, delta: int) -> None:
        if delta:
            self.now += delta
            self.cover += delta * self.rate
            np.maximum(self.most, self.cover, out=self.most)
            for ring in self.dual:
                if ring in self.sign:
                    self.dual[ring] += delta * self.sign[ring]

    def _next_event(self) -> tuple | None:
        """(wait, kind, x, y), earliest first; ties: ring opened, boundary, pair, then by hit."""
        best = None
        for ring, dual in self.dual.items():
            if self.sign.get(ring, 0) < 0 and (best is None or dual < best[0]):
                best = (dual, "open", ring, 0)
        growing = self.rate > 0
        gap = np.where(growing & (self.rim < FAR), self.rim - self.cover, FAR)
        k = int(np.argmin(gap))
        if gap[k] < FAR and (best is None or gap[k] < best[0]):
            best = (int(gap[k]), "rim", k, RIM)
        if len(self.i):
            rate = self.rate[self.i] + self.rate[self.j]
            usable = (rate > 0) & (self.top[self.i] != self.top[self.j])
            gap = self.d - self.cover[self.i] - self.cover[self.j]
            gap = np.where(usable, np.where(rate == 2, (gap + 1) // 2, gap), FAR)
            k = int(np.argmin(gap))
            if gap[k] < FAR and (best is None or gap[k] < best[0]):
                best = (int(gap[k]), "pair", int(self.i[k]), int(self.j[k]))
        return best

    def _handle(self, kind: str, x: int, y: int) -> None:
        self.events.append((self.now, kind))
        if kind == "open":
            self._open_ring(x)
            return
        a = int(self.top[x])
        if kind == "rim":
            self._flip_to_root(a, (x, RIM))
            self._settle(self.tree[a])
            return
        b = int(self.top[y])
        if self.sign[a] < 1:
            a, b, x, y = b, a, y, x
        if self.sign[b] > 0:
            if self.tree[a] == self.tree[b]:
                self._ring(a, b, (x, y))
            else:
                self._flip_to_root(a, (x, y))
                self._flip_to_root(b, (y, x))
                self._settle(self.tree[a], self.tree[b])
            return
        own, other = self.mate[b]
        if other == RIM:
            self.mate[b] = (y, x)
            self._flip_to_root(a, (x, y))
            self._settle(self.tree[a])
            return
        c = int(self.top[other])
        self.tree[b] = self.tree[c] = self.tree[a]
        self.up[b] = (y, x)
        self._set(b, -1)
        self._set(c, 1)

    def pairs(self) -> list[tuple[int, int]]:
        """Final pairs (hit, hit or RIM), rings resolved."""
        out = []
        todo = [(r, self.mate[r]) for r in set(self.top.tolist()) if self.sign[r] == 0]
        while todo:
            region, (own, other) = todo.pop()
            if region < self.n:
                if other == RIM or own < other:
                    out.append((own, other))
                continue
            ring = self._turned(region, self._part_of(region, own))
            todo.append((ring[0][0], (own, other)))
            for k in range(1, len(ring), 2):
                part, mine, theirs = ring[k]
                todo.append((part, (mine, theirs)))
                todo.append((ring[k + 1][0], (theirs, mine)))
        return sorted(out)


def pair_up(rim, i, j, d, horizon: int | None = None) -> tuple[bool, list[tuple[int, int]], Group]:
    group = Group(np.asarray(rim), np.asarray(i, dtype=np.int64), np.asarray(j, dtype=np.int64), np.asarray(d, dtype=np.int64))
    done = group.run(horizon)
    return done, group.pairs() if done else [], group
