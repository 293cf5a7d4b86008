"""The sequential core of neighbour expansion over arrays of edges, for one task.

A bucket grows from a seed: the boundary vertex with the fewest open edges becomes core, its neighbours join the boundary, and open edges
between boundary vertices go to the bucket. Each choice depends on all before it, so the arrays of the graph (or of the sample) are in the
memory of one task. What one choice brings with it is done for all its vertices at once.
"""

from __future__ import annotations

import heapq

import numpy as np

#: Entries of the lists of joining vertices from which on arrays are faster than a loop.
MANY = 256


class Expansion:
    """Open edges, their lists by vertex, and open degrees. An edge's bucket is -1 while it is open."""

    def __init__(self, u: np.ndarray, v: np.ndarray, n_vertices: int):
        self.n, m = n_vertices, len(u)
        kind = np.int32 if max(m, n_vertices) < 1 << 31 else np.int64
        self.bucket = np.full(m, -1, np.int32)
        # The list of a vertex has its outgoing edges e, then its incoming ones as ~e. Keys are distinct, so that any sort will do.
        key, numbers = np.concatenate([u, v]).astype(np.int64, copy=False), np.arange(m)
        key *= 2 * m
        key[:m] += numbers
        numbers += m
        key[m:] += numbers
        del numbers
        key.sort()
        key %= max(2 * m, 1)
        self.other = np.concatenate([v, u]).astype(kind, copy=False)[key]
        np.subtract(m - 1, key, out=key, where=key >= m)
        self.entry = key.astype(kind)
        del key
        self.degree = np.bincount(u, minlength=n_vertices) + np.bincount(v, minlength=n_vertices)
        self.at = np.r_[0, np.cumsum(self.degree)]
        self.place = np.zeros(n_vertices, kind)  # scratch of _distinct() and _join()
        # the same memory, faster for single values
        self.buckets, self.degrees, self.starts, self.entries, self.others = (memoryview(a) for a in (self.bucket, self.degree, self.at, self.entry, self.other))

    def _open(self, vertex: int) -> list[int]:
        """The neighbours by open edges, one for each edge."""
        own, buckets = slice(self.starts[vertex], self.starts[vertex + 1]), self.buckets
        if own.stop - own.start < MANY:
            return [x for e, x in zip(self.entries[own].tolist(), self.others[own].tolist(), strict=True) if buckets[e if e >= 0 else ~e] < 0]
        return self.other[own][self.bucket[self._edges(self.entry[own])] < 0].tolist()

    @staticmethod
    def _edges(entries: np.ndarray) -> np.ndarray:
        return np.where(entries < 0, ~entries, entries)

    def _distinct(self, vertices: np.ndarray) -> np.ndarray:
        """Each vertex once, where it first comes."""
        k = np.arange(len(vertices))
        self.place[vertices[::-1]] = k[::-1]
        return vertices[self.place[vertices] == k]

    def grow(self, bucket: int, stop: int, capacity: int, average: float, rng: np.random.Generator, core: np.ndarray, boundary: np.ndarray, size: int) -> int:
        """Fills a bucket until it has `stop` edges or no seed is left; returns its size. Edges to core vertices ignore the capacity.
        core and boundary mark the vertices that are in them, and are changed."""
        n, degrees, starts = self.n, self.degrees, self.starts
        in_core, in_boundary = memoryview(core), memoryview(boundary)
        heap: list[int] = []  # degree * n + vertex
        seed = self._seeds(int(rng.integers(n)), 2 * average, core)
        while size < stop:
            vertex = None
            while heap:
                d, x = divmod(heapq.heappop(heap), n)
                if d == degrees[x] and not in_core[x]:  # else an entry that a later one replaced
                    vertex = x
                    break
            if vertex is None:
                vertex = next(seed, None)
            if vertex is None:
                break
            in_core[vertex] = True
            if not degrees[vertex]:
                continue
            joining = [x for x in dict.fromkeys([vertex, *self._open(vertex)]) if not in_boundary[x]]
            total = sum([starts[x + 1] - starts[x] for x in joining])
            joined = self._join(bucket, np.array(joining), capacity - size, core, boundary) if total >= MANY else None
            if joined is None:
                size = self._join_each(bucket, joining, capacity, in_core, in_boundary, size, heap)
                continue
            size += joined[0]
            for x in joined[1].tolist():
                heapq.heappush(heap, degrees[x] * n + x)
        return size

    def _seeds(self, start: int, most: float, core: np.ndarray):
        """Every vertex once, from a random one on, if it has open edges and no more than `most` when its turn comes."""
        for first in range(0, self.n, 4096):
            block = (start + np.arange(first, min(first + 4096, self.n))) % self.n
            for x in block[(self.degree[block] > 0) & ~core[block]].tolist():  # degrees only fall
                if not core[x] and 0 < self.degree[x] <= most:
                    yield x

    def _join(self, bucket: int, joining: np.ndarray, room: int, core: np.ndarray, boundary: np.ndarray) -> tuple[int, np.ndarray] | None:
        """All join at once: how many edges the bucket got, and the vertices to look at again. None, with nothing done, if there isn't room
        for all edges, as their order counts then."""
        starts = self.at[joining]
        lengths = self.at[joining + 1] - starts
        ends = np.cumsum(lengths)
        at = np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1])
        entry, other = self.entry[at], self.other[at]
        edge = self._edges(entry)
        boundary[joining] = True
        near = np.flatnonzero((self.bucket[edge] < 0) & boundary[other])
        # an edge of two that join is in the lists of both
        self.place[joining] = np.arange(len(joining))
        to = other[near]
        place = self.place[to]
        place[place >= len(joining)] = 0
        near = near[(joining[place] != to) | (entry[near] >= 0)]
        if len(near) > room:
            boundary[joining] = False
            return None
        to = other[near]
        self.bucket[edge[near]] = bucket
        np.subtract.at(self.degree, to, 1)
        self.degree[joining] -= np.bincount(np.searchsorted(ends, near, side="right"), minlength=len(joining))
        again = self._distinct(np.concatenate([joining, to]))
        return len(near), again[~core[again]]

    def _join_each(self, bucket: int, joining: list[int], capacity: int, core: memoryview, boundary: memoryview, size: int, heap: list[int]) -> int:
        """One after the other: each takes its open edges to core vertices, and to boundary vertices as long as there is room."""
        n, buckets, degrees = self.n, self.buckets, self.degrees
        for x in joining:
            boundary[x] = True
            own = slice(self.starts[x], self.starts[x + 1])
            near = [(e, y) for e, y in zip(self.entries[own].tolist(), self.others[own].tolist(), strict=True) if boundary[y] and buckets[e if e >= 0 else ~e] < 0]
            near.sort(key=_outgoing)  # incoming ones first
            for e, y in near:
                is_core = core[y]
                if is_core or size < capacity:
                    buckets[e if e >= 0 else ~e] = bucket
                    degrees[x] -= 1
                    degrees[y] -= 1
                    size += 1
                    if not is_core:
                        heapq.heappush(heap, degrees[y] * n + y)
            if not core[x]:
                heapq.heappush(heap, degrees[x] * n + x)
        return size


def _outgoing(entry: tuple[int, int]) -> bool:
    return entry[0] >= 0
