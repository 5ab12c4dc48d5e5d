"""Motifs as label paths of unequal lengths: discovered, found again, counted, merged.

Discovered paths go on as they are: one automaton over all of them finds their occurrences in one pass, these give count
matrices, and the matrices are merged pair by pair while random motifs rarely align better, with the shuffles dealt out
over tasks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlab.operators import merging as G
from strandlab.operators import suffixes as X
from strandlab.operators.motifs import MOST_BETTER, SHUFFLES, best_offset, overlap_of
from strandlab.session import for_python, written

#: Labels of all paths together that an automaton is built of at most.
AUTOMATON = 1_000_000
#: Shuffles that share a random generator.
DEALT = 100
#: Motifs whose costs with all others a task holds at once; merges a core that go ahead of their shuffles at most.
TOGETHER, AHEAD = 16, 16
_FIRST = 0x100  # character of label 0; labels are below 0xD000


def discovered(states: DataFrame, shortest: int = 8, longest: int = 15, spread: float = 8.0, likelier: float = 5.0) -> DataFrame:
    """path, length, n, n_seq, ll of the label paths of states (seq_id, x: a sequence's labels) that come at least
    sqrt(sequences) times, in n_seq sequences with n_seq ** 2 / n of at least `spread`, with a log-likelihood ratio above
    `likelier` against independent labels.

    A path's k-grams are made in each sequence's own array; only those of frequent beginnings are counted further: a
    frequent path has frequent prefixes."""
    rows = written(states.select("seq_id", "x"), "paths")
    size = rows.agg(F.sum(F.size("x")).alias("every"), F.sqrt(F.count("*")).alias("least")).first()
    every, least = size["every"] or 0, size["least"] or 0.0
    share = rows.select(F.explode("x").alias("state")).groupBy("state").agg((F.log(F.count("*") / F.lit(float(max(every, 1))))).alias("lp"))
    lp = F.map_from_entries(F.collect_list(F.struct("state", "lp")))
    grams = lambda k: F.expr(f"CASE WHEN size(x) >= {k} THEN transform(sequence(1, size(x) - {k} + 1), i -> slice(x, i, {k})) ELSE array() END")
    out = frequent = None
    for k in range(shortest, longest + 1):
        each = rows.select("seq_id", F.explode(grams(k)).alias("path"))
        if frequent is not None:
            each = each.withColumn("begin", F.slice("path", 1, k - 1)).join(frequent, "begin", "left_semi").drop("begin")
        n = each.groupBy("path", "seq_id").agg(F.count("*").alias("n")).groupBy("path").agg(F.sum("n").alias("n"), F.count("*").alias("n_seq")).where(F.col("n") >= least)
        n = written(n, f"paths{k}")
        out = n if out is None else out.unionByName(n)
        if n.isEmpty():
            break
        frequent = n.select(F.col("path").alias("begin"))
    alone = F.aggregate("path", F.lit(0.0), lambda a, s: a + F.col("lps")[s])
    ll = F.col("n") * (F.log(F.col("n") / F.lit(float(max(every, 1)))) - alone)
    found = out.join(F.broadcast(share.agg(lp.alias("lps")))).withColumn("ll", ll)  # one map of the states
    return found.where((F.col("n_seq") * F.col("n_seq") / F.col("n") >= spread) & (F.col("ll") > likelier)).select("path", F.size("path").alias("length"), "n", "n_seq", "ll")


@lru_cache(maxsize=2)
def _automaton(words: tuple[str, ...]):
    import ahocorasick

    a = ahocorasick.Automaton()
    for w in words:
        a.add_word(w, w)
    a.make_automaton()
    return a


def path_hits(states: DataFrame, paths: DataFrame, most: int = AUTOMATON) -> DataFrame:
    """path, seq_id, pos (from 0) of every occurrence of every path, overlapping ones too; states: seq_id, x.

    One pass with one automaton of all paths; where these have more than `most` labels together, their intervals in a
    suffix index give the same rows."""
    paths = written(paths.select("path").distinct().where(F.size("path") > 0), "paths")
    if (paths.agg(F.sum(F.size("path"))).first()[0] or 0) > most:
        labels = states.select("seq_id", F.posexplode("x").alias("pos", "state")).withColumn("pos", F.col("pos").cast("long"))
        index = X.build(labels)
        found = X.occurrences(index, X.probe(index, paths.select(F.col("path").alias("pattern"))))
        return found.select(F.col("pattern").alias("path"), "seq_id", F.col("pos").cast("int").alias("pos"))
    spark = states.sparkSession
    for_python(spark)
    words = spark.sparkContext.broadcast(tuple(sorted("".join(chr(_FIRST + s) for s in r["path"]) for r in paths.collect())))  # checked above

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a = _automaton(words.value) if words.value else None
        for pdf in batches:
            out: list[tuple] = []
            for seq, x in zip(pdf["seq_id"], pdf["x"], strict=True):
                if a is not None and x is not None:
                    text = "".join(map(chr, (np.asarray(x, dtype=np.int64) + _FIRST).tolist()))
                    out += [([ord(c) - _FIRST for c in w], seq, end - len(w) + 1) for end, w in a.iter(text)]
            yield pd.DataFrame(out, columns=["path", "seq_id", "pos"])

    return states.select("seq_id", "x").mapInPandas(run, "path array<int>, seq_id long, pos int")


def path_matrix(states: DataFrame, found: DataFrame, symbols: str) -> DataFrame:
    """path, place, symbol, n: the symbols (an array beside x) at each place of the paths' occurrences."""
    rows = found.join(states.select("seq_id", F.col(symbols).alias("_y")), "seq_id")
    each = rows.select("path", F.posexplode(F.slice("_y", F.col("pos") + 1, F.size("path"))).alias("place", "symbol"))
    return each.groupBy("path", "place", "symbol").agg(F.count("*").alias("n"))


_shares = G.shares


def nearest_motifs(spark, motifs: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The few nearest ones of each motif and their costs, with a bound below which none is missing; motifs are dealt out
    over tasks, and a task holds the costs of a few with all."""
    for_python(spark)
    held = spark.sparkContext.broadcast(list(motifs.values()))
    lengths: dict[int, list[int]] = {}
    for i, m in enumerate(motifs.values()):
        lengths.setdefault(len(m), []).append(i)
    some = [(ids[i : i + TOGETHER],) for ids in lengths.values() for i in range(0, len(ids), TOGETHER)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stacks = None
        for pdf in batches:
            stacks = stacks or G.stacked(held.value)
            for ids in pdf["ids"]:
                near, cost, bound = G.nearest(stacks, [int(i) for i in ids])
                yield pd.DataFrame({"id": ids, "near": list(near), "cost": list(cost), "bound": bound})

    rows = spark.createDataFrame(some, "ids array<int>").repartition(max(1, min(len(some), 4 * spark.sparkContext.defaultParallelism)))
    got = rows.mapInPandas(run, "id int, near array<long>, cost array<double>, bound double").toArrow().sort_by("id")  # a few numbers a motif
    few = lambda c: got[c].combine_chunks().flatten().to_numpy().reshape(-1, G.KEPT)
    return few("near"), few("cost"), got["bound"].to_numpy()


def _better(p: np.ndarray, q: np.ndarray, seed: tuple[int, ...], blocks: range, shuffles: int, enough: int) -> int:
    """The shuffles of these blocks that align better, up to a little above `enough`.

    A block's shuffles are drawn one by one and aligned at once; best_offset decides on those as good as p itself."""
    overlap = overlap_of(len(p), len(q))
    cost = best_offset(p, q, overlap)[0]
    places = np.arange(p.size).reshape(p.shape)
    left, _, own = G.columns(p)
    logs, other = left[:, p.shape[1] :].ravel(), G.columns(q[:, None, :])
    flat, better = left[:, : p.shape[1]].ravel(), 0
    for k in blocks:
        if better > enough:
            break  # the decision is made
        rng = np.random.default_rng([*seed, k])
        n = min(DEALT, shuffles - k * DEALT)
        mixed = np.empty((n, *p.shape), dtype=places.dtype)
        for i in range(n):
            rng.permuted(places[rng.permutation(len(p))], axis=1, out=mixed[i])
        at = mixed.transpose(1, 0, 2)
        costs = G.aligned_costs((np.concatenate([flat[at], logs[at]], -1), None, own[at[:, :, 0] // p.shape[1]]), other, overlap)[:, 0]
        better += int((costs < cost - G.CLOSE).sum())
        better += sum(best_offset(p.ravel()[mixed[i]], q, overlap)[0] < cost for i in np.flatnonzero(abs(costs - cost) <= G.CLOSE))
    return better


def shuffles_better_each(spark, pairs: list[tuple[np.ndarray, np.ndarray, tuple[int, ...]]], shuffles: int, enough: int) -> list[int]:
    """For each (p, q, seed), how many shuffles of p's columns and letters align better with q than p does, counted up to
    a little above `enough`; every DEALT shuffles have a generator of their own number, so tasks and their number change
    nothing.  Pairs are dealt out over tasks, few pairs block by block."""
    for_python(spark)
    blocks, tasks = -(-shuffles // DEALT), 4 * spark.sparkContext.defaultParallelism
    parts = max(1, min(blocks, -(-tasks // len(pairs))))
    rows = [(i, part, p.shape[1], p.tobytes(), q.tobytes(), list(seed)) for i, (p, q, seed) in enumerate(pairs) for part in range(parts)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            better = []
            for part, letters, p, q, seed in zip(pdf["part"], pdf["letters"], pdf["p"], pdf["q"], pdf["seed"], strict=True):
                p, q = (np.frombuffer(x).reshape(-1, letters) for x in (p, q))
                better.append(_better(p, q, tuple(map(int, seed)), range(part, blocks, parts), shuffles, enough))
            yield pd.DataFrame({"i": pdf["i"], "better": better})

    dealt = spark.createDataFrame(rows, "i int, part int, letters int, p binary, q binary, seed array<long>").repartition(min(len(rows), tasks))
    out = [0] * len(pairs)
    for r in dealt.mapInPandas(run, "i int, better long").groupBy("i").agg(F.sum("better").alias("better")).collect():  # a number a pair
        out[r["i"]] = r["better"]
    return out


def shuffles_better(spark, p: np.ndarray, q: np.ndarray, seed: tuple[int, ...], shuffles: int, enough: int) -> int:
    """shuffles_better_each of one pair."""
    return shuffles_better_each(spark, [(p, q, seed)], shuffles, enough)[0]


def merge_over_tasks(spark, motifs: dict[str, np.ndarray], seed: int = 5, shuffles: int = SHUFFLES, most_better: int | None = None) -> tuple[dict[str, np.ndarray], dict[str, dict[str, int]]]:
    """Merged count matrices, and of each its members with the place of their first column: the closest pair is merged as
    long as at most `most_better` (100 of 10,000) shuffles align better; the first pair that isn't ends it.

    As the first refusal ends it, which pairs come next does not depend on the shuffles: the driver, whose list of matrices
    it is, goes on merging, and the shuffles of the next pairs are dealt out together, some for each core."""
    limit = MOST_BETTER * shuffles // SHUFFLES if most_better is None else most_better
    names, made = list(motifs), {}  # of each merged motif: both parts, the second's offset in the first
    chain = G.Chain(motifs, *nearest_motifs(spark, motifs)) if len(motifs) > 1 else None
    cores, ahead, refused = spark.sparkContext.defaultParallelism, 1, False
    while chain and len(chain.live) > 1 and not refused:
        steps = [chain.step() for _ in range(min(ahead * cores, len(chain.live) - 1))]
        tests = [(_shares(chain.counts[a]), _shares(chain.counts[b]), (seed, chain.sums[a], chain.sums[b])) for a, b, _, _ in steps]
        for (a, b, new, offset), better in zip(steps, shuffles_better_each(spark, tests, shuffles, limit), strict=True):
            if better > limit:
                refused = True
                break
            made[new] = (a, b, offset)
        ahead = min(2 * ahead, AHEAD)
    parts = {m for a, b, _ in made.values() for m in (a, b)}
    now, shifts = {}, {}
    for root in [m for m in [*range(len(names)), *made] if m not in parts]:
        own, todo = {}, [(root, 0)]
        while todo:
            m, at = todo.pop()
            if m in made:
                a, b, offset = made[m]
                low = min(0, offset)
                todo += [(b, at + offset - low), (a, at - low)]
            else:
                own[names[m]] = at
        now["+".join(own)] = chain.counts[root] if chain else motifs[names[root]]
        shifts["+".join(own)] = own
    return now, shifts


def matrices(counts: DataFrame, letters: int) -> dict[str, np.ndarray]:
    """Count matrices by path (labels joined by dots) of a table of path, place, symbol, n; a list of motifs is small."""
    got, out = counts.select("path", "place", "symbol", "n").toArrow(), {}
    place, symbol, n = (got[c].to_numpy() for c in ("place", "symbol", "n"))
    for i, path in enumerate(got["path"].to_pylist()):
        m = out.setdefault(".".join(map(str, path)), np.zeros((len(path), letters)))
        m[place[i], symbol[i]] = n[i]
    return out
