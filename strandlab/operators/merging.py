"""The closest of many motifs, as a list of them is merged pair by pair.

A motif keeps a few of its nearest ones and a bound below which none is missing, so a merge costs one pass over the list
and no table of all pairs is held.  Costs are those of motifs.best_offset; where two differ by rounding only, its own
values decide."""

from __future__ import annotations

import zlib

import numpy as np

from strandlab.operators.motifs import best_offset, merge, overlap_of

#: Nearest motifs that each keeps.
KEPT = 8
#: Costs nearer than this may differ by rounding only.
CLOSE = 1e-10


def shares(counts: np.ndarray) -> np.ndarray:
    more = counts + 0.1 / counts.shape[1]
    return more / more.sum(1, keepdims=True)


def columns(p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Left and right side of the products of columns (last axis: letters), and each column's product with itself."""
    p = np.maximum(p, 1e-9)
    logs = np.log2(p)
    return np.concatenate([p, logs], -1), np.concatenate([logs, p], -1), (p * logs).sum(-1)


def alignments(la: int, lb: int, overlap: int | None = None) -> list[tuple[int, int, int]]:
    """First columns of both and number of columns of each ungapped alignment that best_offset tries."""
    overlap = min(overlap_of(la, lb) if overlap is None else overlap, la, lb)
    every = [(max(0, o), max(0, -o), min(la - max(0, o), lb - max(0, -o))) for o in range(-(lb - overlap), la - overlap + 1)]
    return [(i, j, n) for i, j, n in every if n >= overlap]


def aligned_costs(a: tuple, b: tuple, overlap: int | None = None) -> np.ndarray:
    """Costs of every motif of a with every one of b, given as columns() of arrays (columns, motifs, letters)."""
    left, right, best = a[0], b[1], None
    for i, j, n in alignments(len(left), len(right), overlap):
        x = np.matmul(left[i : i + n], right[j : j + n].transpose(0, 2, 1))
        x = a[2][i : i + n, :, None] + b[2][j : j + n, None, :] - x
        x = np.tanh(x / 4).mean(0)
        best = x if best is None else np.minimum(best, x)
    return best


class Stacks:
    """Motifs by length, as arrays (columns, motifs, letters) that grow and shrink."""

    def __init__(self):
        self.size, self.ids, self.parts, self.at = {}, {}, {}, {}

    def add(self, ids: list[int], length: int, parts: tuple) -> None:
        """Motifs of one length, given as columns()."""
        n = self.size.get(length, 0)
        if length not in self.ids or n + len(ids) > len(self.ids[length]):
            room = max(16, 2 * (n + len(ids)))
            self.ids[length] = np.concatenate([self.ids[length][:n] if n else np.empty(0, np.int64), np.empty(room - n, np.int64)])
            grown = [np.zeros((length, room, *x.shape[2:])) for x in parts]
            for new, old in zip(grown, self.parts.get(length, ()), strict=False):
                new[:, :n] = old[:, :n]
            self.parts[length] = grown
        self.ids[length][n : n + len(ids)] = ids
        for kept, x in zip(self.parts[length], parts, strict=True):
            kept[:, n : n + len(ids)] = x
        self.size[length] = n + len(ids)
        self.at.update((m, (length, n + i)) for i, m in enumerate(ids))

    def drop(self, m: int) -> None:
        """The last one takes its place."""
        length, i = self.at.pop(m)
        last = self.size[length] = self.size[length] - 1
        if i < last:
            moved = self.ids[length][i] = self.ids[length][last]
            for x in self.parts[length]:
                x[:, i] = x[:, last]
            self.at[int(moved)] = (length, i)

    def get(self, m: int) -> tuple:
        length, i = self.at[m]
        return tuple(x[:, i : i + 1] for x in self.parts[length])

    def costs(self, some: tuple) -> tuple[np.ndarray, np.ndarray]:
        """ids of all, and the costs of the given motifs (of one length) with each."""
        ids, out = [], []
        for length, n in self.size.items():
            if n:
                ids.append(self.ids[length][:n])
                out.append(aligned_costs(some, tuple(x[:, :n] for x in self.parts[length])))
        return np.concatenate(ids), np.concatenate(out, axis=1)


def stacked(motifs: list[np.ndarray]) -> Stacks:
    """All motifs, numbered as they are listed."""
    out, lengths = Stacks(), {}
    for i, m in enumerate(motifs):
        lengths.setdefault(len(m), []).append(i)
    for length, ids in sorted(lengths.items()):
        out.add(ids, length, columns(np.stack([shares(motifs[i]) for i in ids], axis=1)))
    return out


def nearest(stacks: Stacks, some: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids and costs of the KEPT nearest ones of the given motifs (of one length; -1 and inf where there are fewer), and
    the bound below which none of a motif's costs is missing."""
    each = [stacks.get(m) for m in some]
    ids, cost = stacks.costs(tuple(np.concatenate(x, axis=1) for x in zip(*each, strict=True)))
    cost[ids[None, :] == np.array(some)[:, None]] = np.inf
    return _few(ids, cost)


def _few(ids: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if cost.shape[1] <= KEPT:
        near, at = np.full((len(cost), KEPT), -1), np.full((len(cost), KEPT), np.inf)
        near[:, : len(ids)], at[:, : len(ids)] = ids, cost
        return near, at, np.full(len(cost), np.inf)
    first = np.argpartition(cost, KEPT, axis=1)
    take = np.take_along_axis(cost, first, axis=1)
    return ids[first[:, :KEPT]], take[:, :KEPT], take[:, KEPT]


class Chain:
    """The merges of the closest pair, one after the other, whatever shuffles say.

    near, cost, bound: nearest() of all motifs, in order of their numbers."""

    def __init__(self, motifs: dict[str, np.ndarray], near: np.ndarray, cost: np.ndarray, bound: np.ndarray):
        self.names, self.counts = dict(enumerate(motifs)), dict(enumerate(motifs.values()))
        self.sums = {i: zlib.crc32(m.encode()) for i, m in self.names.items()}
        self.stacks = stacked(list(motifs.values()))
        self.next = len(motifs)
        self.live = np.arange(self.next)
        self.near, self.cost, self.bound = near.copy(), cost.copy(), bound.copy()
        self.place = np.arange(2 * self.next)
        self.exact: dict[tuple[int, int], float] = {}

    def _renew(self, i: int) -> None:
        near, cost, bound = nearest(self.stacks, [int(self.live[i])])
        self.near[i], self.cost[i], self.bound[i] = near[0], cost[0], bound[0]

    def _pair(self) -> tuple[int, int]:
        """The closest pair, by best_offset's own cost and then by name."""
        head = np.minimum(self.cost.min(axis=1), self.bound)
        while True:
            low = head.min()
            some = np.flatnonzero(head <= low + CLOSE)
            stale = [i for i in some if self.bound[i] < self.cost[i].min()]
            if not stale:
                break
            for i in stale:
                self._renew(i)
                head[i] = self.cost[i].min()
        pairs = set()
        for i in some:
            m = int(self.live[i])
            ids, cost = self.near[i], self.cost[i]
            if self.bound[i] <= low + CLOSE:  # more equal ones than are kept
                ids, cost = self.stacks.costs(self.stacks.get(m))
                cost = np.where(ids == m, np.inf, cost[0])
            pairs.update((m, int(o)) if self.names[m] < self.names[int(o)] else (int(o), m) for o in ids[cost <= low + CLOSE])
        if len(pairs) == 1:
            return pairs.pop()
        for a, b in pairs:
            if (a, b) not in self.exact:
                self.exact[a, b] = self._best(a, b)[0]
        return min(pairs, key=lambda k: (self.exact[k], self.names[k[0]], self.names[k[1]]))

    def _best(self, a: int, b: int) -> tuple[float, int]:
        p, q = self.counts[a], self.counts[b]
        return best_offset(shares(p), shares(q), overlap_of(len(p), len(q)))

    def step(self) -> tuple[int, int, int, int]:
        """Merges the closest pair: the numbers of both and of the new motif, and the second's offset in the first."""
        a, b = self._pair()
        offset, new = self._best(a, b)[1], self.next
        self.next += 1
        second = f"+{self.names.pop(b)}"
        self.names[new] = self.names.pop(a) + second
        self.sums[new] = zlib.crc32(second.encode(), self.sums[a])  # of the whole name
        self.counts[new] = merge(self.counts[a], self.counts[b], offset)
        self.exact = {k: c for k, c in self.exact.items() if a not in k and b not in k} if self.exact else self.exact
        for m in (a, b):
            self.stacks.drop(m)
        self.cost[(self.near == a) | (self.near == b)] = np.inf
        i, j = int(self.place[a]), int(self.place[b])
        last = len(self.live) - 1
        for x in (self.live, self.near, self.cost, self.bound):
            x[j] = x[last]  # the new motif takes the first one's place, the last one the second's
        self.place[self.live[j]] = j
        if i == last:
            i = j
        self.live, self.near, self.cost, self.bound = (x[:last] for x in (self.live, self.near, self.cost, self.bound))
        self.live[i], self.place[new] = new, i
        own = columns(shares(self.counts[new])[:, None, :])
        if last > 1:
            ids, cost = self.stacks.costs(own)
            near, first, bound = _few(ids, cost)
            self.near[i], self.cost[i], self.bound[i] = near[0], first[0], bound[0]
            self._enter(new, self.place[ids], cost[0])
        self.stacks.add([new], len(self.counts[new]), own)
        return a, b, new, offset

    def _enter(self, new: int, at: np.ndarray, cost: np.ndarray) -> None:
        """The new motif among the nearest ones of those (by place) to which it is near enough."""
        inside = cost < self.bound[at]
        at, cost = at[inside], cost[inside]
        worst = self.cost[at].argmax(axis=1)
        out = self.cost[at, worst]
        full = out < np.inf
        keep = ~full | (cost < out)
        self.bound[at[full]] = np.minimum(self.bound[at[full]], np.maximum(out, cost)[full])
        self.near[at[keep], worst[keep]], self.cost[at[keep], worst[keep]] = new, cost[keep]
