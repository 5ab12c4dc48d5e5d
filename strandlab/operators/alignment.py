"""Progressive multiple alignment of short DNA sequences: k-tuple distances, average linkage, profile alignment."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlab.session import for_python

#: Scores of a pair of columns and of gaps.
MATCH, MISMATCH, OPEN, EXTEND, TUPLE = 5.0, -4.0, -10.0, -1.0, 4


def tuple_distances(seqs: list[str], k: int = TUPLE) -> np.ndarray:
    """1 - share of common k-tuples, of the shorter sequence's."""
    sets = [{s[i : i + k] for i in range(len(s) - k + 1)} or {s} for s in seqs]
    n = len(sets)
    d = np.zeros((n, n))
    for i in range(n):
        for j in range(i + 1, n):
            d[i, j] = d[j, i] = 1 - len(sets[i] & sets[j]) / min(len(sets[i]), len(sets[j]))
    return d


def average_linkage(d: np.ndarray) -> list[tuple[int, int]]:
    """Merges (a, b), of items and of earlier merges numbered on from n."""
    n = len(d)
    size, alive, out = {i: 1 for i in range(n)}, list(range(n)), []
    dist = {(i, j): float(d[i, j]) for i in range(n) for j in range(i + 1, n)}
    for step in range(n - 1):
        a, b = min(((dist[p], p) for p in dist), key=lambda x: x)[1]
        new = n + step
        for c in alive:
            if c not in (a, b):
                x, y = dist.pop((min(a, c), max(a, c))), dist.pop((min(b, c), max(b, c)))
                dist[(c, new)] = (x * size[a] + y * size[b]) / (size[a] + size[b])
        dist.pop((a, b))
        alive = [c for c in alive if c not in (a, b)] + [new]
        size[new] = size[a] + size[b]
        out.append((a, b))
    return out


def _profile(rows: list[str], letters: str) -> np.ndarray:
    return np.array([[sum(r[i] == c for r in rows) / len(rows) for c in letters] for i in range(len(rows[0]))]).reshape(-1, len(letters))


def align_profiles(x: list[str], y: list[str]) -> tuple[list[str], list[str]]:
    """Two groups of aligned rows, aligned with each other by affine gaps."""
    letters = "".join(sorted(set("".join(x + y)) - {"-"})) or "A"
    p, q = _profile(x, letters), _profile(y, letters)
    pair = np.full((len(letters), len(letters)), MISMATCH)
    np.fill_diagonal(pair, MATCH)
    score = p @ pair @ q.T
    n, m = len(p), len(q)
    low = -1e18
    pair_, up, left = (np.full((n + 1, m + 1), low) for _ in range(3))  # last step: a pair, a gap in y, a gap in x
    pair_[0, 0] = 0
    along = EXTEND * np.arange(m + 1)
    for i in range(n + 1):
        if i:
            best = np.maximum(np.maximum(pair_[i - 1], up[i - 1]), left[i - 1])
            pair_[i, 1:] = best[:-1] + score[i - 1]
            up[i] = np.maximum(np.maximum(pair_[i - 1], left[i - 1]) + OPEN, up[i - 1] + EXTEND)
        # a gap in x that opens at any earlier column of the row
        start = np.maximum.accumulate(np.maximum(pair_[i], up[i]) + OPEN - along)
        left[i, 1:] = start[:-1] + along[1:] - EXTEND
    tables = (pair_, up, left)
    k, i, j, steps = int(np.argmax([t[n, m] for t in tables])), n, m, []
    while i or j:
        steps.append(k)
        i, j = i - (k != 2), j - (k != 1)
        cost = {0: (0, 0, 0), 1: (OPEN, EXTEND, OPEN), 2: (OPEN, OPEN, EXTEND)}[k]
        k = int(np.argmax([t[i, j] + c for t, c in zip(tables, cost, strict=True)]))
    steps.reverse()

    def spread(rows: list[str], gap: int) -> list[str]:
        out = []
        for r in rows:
            it = iter(r)
            out.append("".join("-" if k == gap else next(it) for k in steps))
        return out

    return spread(x, 2), spread(y, 1)


def align(seqs: list[str]) -> list[str]:
    """The sequences with gaps, all equally long."""
    if len(seqs) < 2:
        return list(seqs)
    groups = {i: ([i], [s]) for i, s in enumerate(seqs)}
    for step, (a, b) in enumerate(average_linkage(tuple_distances(seqs))):
        (ia, ra), (ib, rb) = groups.pop(a), groups.pop(b)
        ra, rb = align_profiles(ra, rb)
        groups[len(seqs) + step] = (ia + ib, ra + rb)
    order, rows = next(iter(groups.values()))
    return [r for _, r in sorted(zip(order, rows, strict=True))]


def align_groups(rows: DataFrame) -> DataFrame:
    """grp, seq_id, aligned for each group of (grp, seq_id, seq); a group is one family of at most about 100 sequences."""
    for_python(rows.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq_id")
        return pd.DataFrame({"grp": pdf["grp"], "seq_id": pdf["seq_id"], "aligned": align(pdf["seq"].tolist())})

    return rows.select(F.col("grp").cast("string"), F.col("seq_id").cast("long"), "seq").groupBy("grp").applyInPandas(lambda pdf: run(pdf), "grp string, seq_id long, aligned string")
