"""Progressive alignment of one large family over tasks.

Distances of pairs are dealt out over tasks; the guide tree (average linkage, one number a pair) is the driver's.  All
merges of one level of the tree run side by side: a merge gets two profiles (shares of letters by column) and gives the
merged one and its steps, found in memory that grows with the profiles' lengths, not their product, by divide and conquer
on the middle row.  Then the places of columns go down the tree, level by level, until each sequence has its own."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlab.operators.alignment import EXTEND, MATCH, MISMATCH, OPEN, TUPLE, average_linkage
from strandlab.session import for_python, written

#: Cells of a part of the table that is solved as a whole; steps: a pair of columns, a column of x alone, one of y alone.
CELLS = 20_000
PAIR, X, Y = 0, 1, 2
_LOW = -1e18


def _steps_along(start: int) -> np.ndarray:
    return np.array([0.0 if s == start else _LOW for s in (PAIR, X, Y)])


def forward_rows(p: np.ndarray, w: np.ndarray, start: int, keep: bool):
    """Best scores by last step and column at the end of p's rows (or at each row); w: scores of letters by y's columns;
    start: the step before the first."""
    m = w.shape[1]
    along, tables = EXTEND * np.arange(m + 1), []
    pair = up = left = None
    for i in range(len(p) + 1):
        if i:
            best = np.maximum(np.maximum(pair, up), left)
            new = np.full(m + 1, _LOW)
            new[1:] = best[:-1] + p[i - 1] @ w
            up = np.maximum(np.maximum(pair, left) + OPEN, up + EXTEND)
            pair, left = new, np.full(m + 1, _LOW)
        else:
            pair, up, left = (np.full(m + 1, _LOW) for _ in range(3))
            pair[0], up[0], left[0] = _steps_along(start)
        opened = np.maximum(pair, up) + OPEN
        opened[0] = max(opened[0], left[0] + EXTEND)
        reach = np.maximum.accumulate(opened - along)
        left[1:] = reach[:-1] + along[1:] - EXTEND
        if keep:
            tables.append((pair, up, left))
    return tables if keep else (pair, up, left)


def backward_row(p: np.ndarray, w: np.ndarray, end: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best scores of what follows the first row, by the step before and the column; end: the last step, if it is given."""
    m = w.shape[1]
    along = EXTEND * np.arange(m + 1)
    pair = up = left = None
    for i in range(len(p), -1, -1):
        if i < len(p):
            match, gap = np.full(m + 1, _LOW), up
            match[:-1] = pair[1:] + p[i] @ w
            after = {PAIR: np.maximum(match, gap + OPEN), X: np.maximum(match, gap + EXTEND), Y: np.maximum(match, gap + OPEN)}
        else:
            after = {s: np.full(m + 1, _LOW) for s in (PAIR, X, Y)}
            for s in (PAIR, X, Y):
                after[s][m] = 0.0 if end is None or s == end else _LOW
        # steps along y, any number of them
        left = np.maximum.accumulate((after[Y] + along)[::-1])[::-1] - along
        nxt = np.full(m + 1, _LOW)
        nxt[:-1] = left[1:] + OPEN
        pair, up = np.maximum(after[PAIR], nxt), np.maximum(after[X], nxt)
    return pair, up, left


def profile_steps(p: np.ndarray, q: np.ndarray, cells: int = CELLS) -> np.ndarray:
    """The steps of the best alignment of two profiles with affine gaps."""
    pair = np.full((p.shape[1], p.shape[1]), MISMATCH)
    np.fill_diagonal(pair, MATCH)
    w, out = pair @ q.T, []
    todo: list[tuple] = [(0, len(p), 0, len(q), PAIR, None)]
    while todo:
        i0, i1, j0, j1, start, end = todo.pop()
        if i1 - i0 <= 1 or (i1 - i0 + 1) * (j1 - j0 + 1) <= cells:
            out.append(_whole(p[i0:i1], w[:, j0:j1], start, end))
            continue
        mid = (i0 + i1) // 2
        ahead, behind = forward_rows(p[i0:mid], w[:, j0:j1], start, False), backward_row(p[mid:i1], w[:, j0:j1], end)
        both = np.stack([a + b for a, b in zip(ahead, behind, strict=True)])
        s, j = np.unravel_index(int(both.argmax()), both.shape)
        todo += [(mid, i1, j0 + int(j), j1, int(s), end), (i0, mid, j0, j0 + int(j), start, int(s))]
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint8)


def _whole(p: np.ndarray, w: np.ndarray, start: int, end: int | None) -> np.ndarray:
    rows = forward_rows(p, w, start, True)
    i, j = len(p), w.shape[1]
    k = end if end is not None else int(np.argmax([t[j] for t in rows[i]]))
    steps = []
    while i or j:
        steps.append(k)
        i, j = i - (k != Y), j - (k != X)
        cost = {PAIR: (0, 0, 0), X: (OPEN, EXTEND, OPEN), Y: (OPEN, OPEN, EXTEND)}[k]
        k = int(np.argmax([t[j] + c for t, c in zip(rows[i], cost, strict=True)])) if i or j else start
    return np.array(steps[::-1], dtype=np.uint8)


def merged(p: np.ndarray, q: np.ndarray, steps: np.ndarray, n: int, m: int) -> np.ndarray:
    """The profile of both: shares over n and m sequences."""
    out = np.zeros((len(steps), p.shape[1]))
    out[steps != Y] += p * (n / (n + m))
    out[steps != X] += q * (m / (n + m))
    return out


def family_distances(spark, seqs: list[str], k: int = TUPLE) -> np.ndarray:
    """1 - share of common k-tuples, of the shorter sequence's, of all pairs; rows of the table are dealt over tasks."""
    for_python(spark)
    held = spark.sparkContext.broadcast([{s[i : i + k] for i in range(len(s) - k + 1)} or {s} for s in seqs])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sets = held.value
        for pdf in batches:
            for i in pdf["id"].tolist():
                yield pd.DataFrame({"i": [i], "d": [[1 - len(sets[i] & x) / min(len(sets[i]), len(x)) for x in sets[i + 1 :]]]})

    n = len(seqs)
    parts = max(1, min(n, 8 * spark.sparkContext.defaultParallelism))
    d = np.zeros((n, n))
    for r in spark.range(n).repartition(parts).mapInPandas(run, "i long, d array<double>").collect():
        d[r["i"], r["i"] + 1 :] = r["d"]
    return d + d.T


def tree_levels(merges: list[tuple[int, int]], n: int) -> list[list[tuple[int, int, int]]]:
    """(new, a, b) of each level: what all is there for once the levels before are done."""
    at, out = [0] * n, []
    for k, (a, b) in enumerate(merges):
        level = max(at[a], at[b])
        at.append(level + 1)
        if level == len(out):
            out.append([])
        out[level].append((n + k, a, b))
    return out


def align_family(seqs: DataFrame, letters: str, most: int = 20_000) -> DataFrame:
    """seq_id, aligned of one family (seq_id, seq): equally long, with gaps.

    What the driver holds are the sequences (at most `most`), their distances and the tree; profiles, steps and places of
    columns are tables."""
    spark = seqs.sparkSession
    for_python(spark)
    rows = seqs.select(F.col("seq_id").cast("long"), F.coalesce("seq", F.lit("")).alias("seq")).orderBy("seq_id", "seq").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a family has at most {most} sequences")
    ids, texts = [r["seq_id"] for r in rows], [r["seq"] for r in rows]
    n, width = len(rows), len(letters)
    kind = "seq_id long, aligned string"
    if n < 2:
        return spark.createDataFrame(list(zip(ids, texts, strict=True)), kind)
    levels = tree_levels(average_linkage(family_distances(spark, texts)), n)
    leaves = spark.createDataFrame(list(enumerate(texts)), "node long, seq string")

    def profiles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            one = [np.eye(width)[[letters.index(c) for c in s]].reshape(-1, width).tobytes() for s in pdf["seq"]]
            yield pd.DataFrame({"node": pdf["node"], "n": 1, "profile": one})

    def merge_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for new, a, b, na, nb, x, y in zip(*(pdf[c] for c in ("new", "a", "b", "na", "nb", "x", "y")), strict=True):
                p, q = (np.frombuffer(v).reshape(-1, width) for v in (x, y))
                steps = profile_steps(p, q)
                out.append((new, na + nb, merged(p, q, steps, na, nb).tobytes(), a, b, steps.tobytes()))
            yield pd.DataFrame(out, columns=["node", "n", "profile", "a", "b", "steps"])

    now = written(leaves.mapInPandas(profiles, "node long, n long, profile binary"), "profiles")
    known, scripts = now, []
    for level in levels:
        tasks = spark.createDataFrame(level, "new long, a long, b long")
        side = lambda c, n_, v, known=known: known.select(F.col("node").alias(c), F.col("n").alias(n_), F.col("profile").alias(v))
        some = tasks.join(side("a", "na", "x"), "a").join(side("b", "nb", "y"), "b").repartition(max(1, min(len(level), 8 * spark.sparkContext.defaultParallelism)))
        made = written(some.mapInPandas(merge_rows, "node long, n long, profile binary, a long, b long, steps binary"), "merged")
        gone = tasks.select(F.explode(F.array("a", "b")).alias("node"))
        known = written(known.join(gone, "node", "left_anti").unionByName(made.select("node", "n", "profile")), "profiles")
        scripts.append(made.select("node", "a", "b", "steps"))

    def down(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for a, b, raw, at in zip(pdf["a"], pdf["b"], pdf["steps"], pdf["places"], strict=True):
                steps = np.frombuffer(raw, dtype=np.uint8)
                places = np.frombuffer(at, dtype=np.int64) if at is not None else np.arange(len(steps))
                out += [(a, places[steps != Y].tobytes()), (b, places[steps != X].tobytes())]
            yield pd.DataFrame(out, columns=["node", "places"])

    places = spark.createDataFrame([], "node long, places binary")
    for script in reversed(scripts):
        own = script.join(places, "node", "left")  # the root has none: its columns are the places
        places = written(places.join(script, "node", "left_anti").unionByName(own.mapInPandas(down, "node long, places binary")), "places")
    top = scripts[-1].select(F.octet_length("steps").alias("w")).first()["w"]

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for s, at in zip(pdf["seq"], pdf["places"], strict=True):
                row = np.full(top, "-", dtype="<U1")
                row[np.frombuffer(at, dtype=np.int64)] = list(s)
                out.append("".join(row))
            yield pd.DataFrame({"seq_id": pdf["seq_id"], "aligned": out})

    named = spark.createDataFrame([(k, i, s) for k, (i, s) in enumerate(zip(ids, texts, strict=True))], "node long, seq_id long, seq string")
    return named.join(places, "node").select("seq_id", "seq", "places").mapInPandas(put, kind)
