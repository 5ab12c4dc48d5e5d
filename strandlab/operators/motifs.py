"""Motifs: common substrings, hits, count matrices, information, distances, alignment, merging."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlab.functions import sequences as S
from strandlab.functions.mathematics import bits
from strandlab.operators import rounds, suffixes
from strandlab.operators import suffixtree as T
from strandlab.session import for_python, written

#: How a pair of motif columns costs, when a merge is significant.
SHUFFLES, MOST_BETTER = 10_000, 100
#: Fixed value: rounds of common substrings at most.
ROUNDS = 512
#: Tables of steps that a plan reads side by side at most.
STEPS = 16


def hits(seqs: DataFrame, motifs: DataFrame, width: int = 0) -> DataFrame:
    """motif, seq_id, pos (from 0) of every occurrence of motif strings, and with a width the window of so many letters
    that begins there (shorter at an end); motifs: a checked small table.  Only the hits become rows."""
    for_python(seqs.sparkSession)
    words = sorted({r["motif"] for r in motifs.select("motif").collect() if r["motif"]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            for seq_id, s in zip(pdf["seq_id"].tolist(), pdf["seq"], strict=True):
                for m in words:
                    i = s.find(m)
                    while i >= 0:
                        found.append((m, seq_id, i, s[i : i + width]))
                        i = s.find(m, i + 1)
            yield pd.DataFrame(found, columns=["motif", "seq_id", "pos", "window"])

    rows = seqs.where("seq <> ''").select("seq_id", "seq").mapInPandas(run, "motif string, seq_id long, pos int, window string")
    return rows if width else rows.drop("window")


def window_matrix(found: DataFrame) -> DataFrame:
    """motif, place, residue, n of hits with their windows: equal windows are counted before they are cut up."""
    kinds = found.groupBy("motif", "window").agg(F.count("*").alias("n"))
    each = kinds.select("motif", "n", F.posexplode(F.regexp_extract_all("window", F.lit("(.)"), F.lit(1))).alias("place", "residue"))
    return each.groupBy("motif", "place", "residue").agg(F.sum("n").alias("n"))


def non_overlapping(found: DataFrame, width: int) -> DataFrame:
    """found with overlaps: whether an earlier hit of the motif in the sequence starts less than width before."""
    w = Window.partitionBy("motif", "seq_id").orderBy("pos")
    return found.withColumn("overlaps", F.coalesce(F.col("pos") - F.lag("pos").over(w) < width, F.lit(False)))


def count_matrix(seqs: DataFrame, found: DataFrame, width: int) -> DataFrame:
    """motif, place, residue, n: letters at each place of the windows that start at the hits."""
    window = F.regexp_extract_all(F.substring(F.col("seq"), F.col("pos") + 1, F.lit(width)), F.lit("(.)"), F.lit(1))
    rows = found.join(seqs, "seq_id").select("motif", F.posexplode(window).alias("place", "residue"))
    return rows.groupBy("motif", "place", "residue").agg(F.count("*").alias("n"))


def frequencies(counts: DataFrame, background: DataFrame, prior: float = 0.1) -> DataFrame:
    """motif, place, residue, n, p, bg with a pseudocount of prior x background at every residue."""
    places = counts.groupBy("motif", "place").agg(F.sum("n").alias("total"))
    grid = places.join(F.broadcast(background))  # places x letters
    full = grid.join(counts, ["motif", "place", "residue"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return full.select("motif", "place", "residue", "n", ((F.col("n") + prior * F.col("bg")) / (F.col("total") + prior)).alias("p"), "bg", "total")


def information(freq: DataFrame) -> DataFrame:
    """motif, ic: mean relative entropy of the columns."""
    column = freq.groupBy("motif", "place").agg(F.sum(bits("p", "bg")).alias("b"))
    return column.groupBy("motif").agg(F.avg("b").alias("ic"))


def logo_heights(freq: DataFrame, letters: int) -> DataFrame:
    """motif, place, residue, height: each letter's share of its column's information, less the small-sample correction."""
    column = freq.groupBy("motif", "place").agg((-F.sum(F.when(F.col("p") > 0, F.col("p") * F.log2("p")).otherwise(0.0))).alias("entropy"), F.first("total").alias("total"))
    small = (letters - 1) / (2.0 * math.log(2) * F.col("total"))
    height = column.select("motif", "place", (math.log2(letters) - (F.col("entropy") + small)).alias("stack"))
    return freq.join(height, ["motif", "place"]).select("motif", "place", "residue", (F.col("p") * F.col("stack")).alias("height"))


def distances(freq: DataFrame, width: int) -> DataFrame:
    """a, b (a < b), distance: the least mean relative entropy of a's columns to b's over all offsets that overlap by
    more than half of the width."""
    a = freq.select(F.col("motif").alias("a"), F.col("place").alias("pa"), "residue", F.col("p").alias("x"))
    b = freq.select(F.col("motif").alias("b"), F.col("place").alias("pb"), "residue", F.col("p").alias("y"))
    both = a.join(b, "residue").where("a < b").withColumn("offset", F.col("pa") - F.col("pb"))
    at = both.groupBy("a", "b", "offset").agg(F.sum(bits("x", "y")).alias("kl"), F.count_distinct("pa").alias("overlap"))
    return at.where(F.col("overlap") > width // 2).groupBy("a", "b").agg(F.min(F.col("kl") / F.col("overlap")).alias("distance"))


def column_costs(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Cost of every pair of columns of two motifs (rows are columns of the motif), between 0 and 1."""
    p, q = np.maximum(p, 1e-9), np.maximum(q, 1e-9)
    lp, lq = np.log2(p), np.log2(q)
    kl = (p * lp).sum(1)[:, None] - p @ lq.T
    lk = (q * lq).sum(1)[None, :] - lp @ q.T
    return 2 * (1 / (1 + np.exp(-(kl + lk) / 2)) - 0.5)


def best_offset(p: np.ndarray, q: np.ndarray, overlap: int) -> tuple[float, int]:
    """Mean cost and offset of the cheapest ungapped alignment that overlaps at least so far."""
    cost = column_costs(p, q)
    overlap = min(overlap, len(p), len(q))
    tried = []
    for offset in range(-(len(q) - overlap), len(p) - overlap + 1):
        line = np.diagonal(cost, -offset)
        if len(line) >= overlap:
            tried.append((float(line.mean()), offset))
    return min(tried)


def overlap_of(la: int, lb: int) -> int:
    return min(la, lb) if max(la, lb) >= 128 else max(6, min(la, lb) - 2)


def significant(p: np.ndarray, q: np.ndarray, rng: np.random.Generator, shuffles: int = SHUFFLES, enough: int | None = None) -> tuple[float, int, int]:
    """Cost and offset of the best alignment, and how many shuffles of the first motif's columns align better; with
    enough, counting ends above that number, where the decision is made."""
    overlap = overlap_of(len(p), len(q))
    cost, offset = best_offset(p, q, overlap)
    better = 0
    for _ in range(shuffles):
        mixed = rng.permuted(p[rng.permutation(len(p))], axis=1)
        better += best_offset(mixed, q, overlap)[0] < cost
        if enough is not None and better > enough:
            break
    return cost, offset, better


def merge(p: np.ndarray, q: np.ndarray, offset: int) -> np.ndarray:
    """Count matrices added at the offset of the second in the first."""
    low, high = min(0, offset), max(len(p), offset + len(q))
    out = np.zeros((high - low, p.shape[1]))
    out[-low : -low + len(p)] += p
    out[offset - low : offset - low + len(q)] += q
    return out


def merge_all(motifs: dict[str, np.ndarray], seed: int = 5, shuffles: int = SHUFFLES, most_better: int | None = None, shifts: dict[str, dict[str, int]] | None = None) -> dict[str, np.ndarray]:
    """Merge the closest pair as long as at most most_better shuffles align better (in proportion: 100 of 10,000).

    shifts, if given, is filled with the place of each member's first column in each motif of the result."""
    now = dict(motifs)
    shifts = {} if shifts is None else shifts
    shifts.update({m: {m: 0} for m in motifs})
    limit = MOST_BETTER * shuffles // SHUFFLES if most_better is None else most_better
    rng = np.random.default_rng(seed)
    norm = lambda m: (m + 0.1 / m.shape[1]) / (m + 0.1 / m.shape[1]).sum(1, keepdims=True)
    refused: set = set()
    while True:
        names = sorted(now)
        tried = [(best_offset(norm(now[a]), norm(now[b]), overlap_of(len(now[a]), len(now[b])))[0], a, b) for i, a in enumerate(names) for b in names[i + 1 :] if (a, b) not in refused]
        if not tried:
            return now
        _, a, b = min(tried)
        _, offset, better = significant(norm(now[a]), norm(now[b]), rng, shuffles, limit)
        if better > limit:
            refused.add((a, b))
            continue
        joined = merge(now.pop(a), now.pop(b), offset)
        now[f"{a}+{b}"] = joined
        low = min(0, offset)
        shifts[f"{a}+{b}"] = {m: at - low for m, at in shifts.pop(a).items()} | {m: at + offset - low for m, at in shifts.pop(b).items()}


def merge_table(counts: DataFrame, letters: str, groups: str, shuffles: int = 200) -> DataFrame:
    """group, motif, place, residue, n after merging within each group (a group's motifs are a short list)."""
    for_python(counts.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        motifs = {}
        for name, rows in pdf.groupby("motif"):
            m = np.zeros((int(rows["place"].max()) + 1, len(letters)))
            m[rows["place"], [letters.index(r) for r in rows["residue"]]] = rows["n"]
            motifs[name] = m
        out = [(pdf["grp"].iloc[0], name, i, letters[j], float(v)) for name, m in merge_all(motifs, shuffles=shuffles).items() for (i, j), v in np.ndenumerate(m) if v]
        return pd.DataFrame(out, columns=["grp", "motif", "place", "residue", "n"])

    return counts.withColumnRenamed(groups, "grp").groupBy("grp").applyInPandas(lambda pdf: run(pdf), "grp string, motif string, place int, residue string, n double")


def merged_members(counts: DataFrame, letters: str, shuffles: int = SHUFFLES) -> DataFrame:
    """merged, motif, shift: which motif of the list (one group, a short list) went where in which merged one."""
    for_python(counts.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        motifs, shifts = {}, {}
        for name, rows in pdf.groupby("motif"):
            m = np.zeros((int(rows["place"].max()) + 1, len(letters)))
            m[rows["place"], [letters.index(r) for r in rows["residue"]]] = rows["n"]
            motifs[name] = m
        merge_all(motifs, shuffles=shuffles, shifts=shifts)
        return pd.DataFrame([(k, m, at) for k, members in sorted(shifts.items()) for m, at in sorted(members.items())], columns=["merged", "motif", "shift"])

    return counts.withColumn("grp", F.lit("all")).groupBy("grp").applyInPandas(lambda pdf: run(pdf), "merged string, motif string, shift int")


def best_alignments(freq: DataFrame, width: int) -> DataFrame:
    """a, b (a < b), cost, offset of the cheapest ungapped alignment of any two motifs (place of b's first column in a;
    of equally cheap ones the smallest), whose columns cost between 0 and 1; it overlaps as far as allowed_overlap asks."""
    a = freq.select(F.col("motif").alias("a"), F.col("place").alias("pa"), "residue", F.greatest("p", F.lit(1e-9)).alias("x"))
    b = freq.select(F.col("motif").alias("b"), F.col("place").alias("pb"), "residue", F.greatest("p", F.lit(1e-9)).alias("y"))
    column = a.join(b, "residue").where("a < b").groupBy("a", "b", "pa", "pb").agg((F.sum(bits("x", "y") + bits("y", "x")) / 2).alias("kl"))
    cost = 2 * (1 / (1 + F.exp(-F.col("kl"))) - 0.5)
    at = column.groupBy("a", "b", (F.col("pa") - F.col("pb")).alias("offset")).agg(F.avg(cost).alias("cost"), F.count("*").alias("overlap"))
    at = at.where(F.col("overlap") >= overlap_of(width, width))
    return at.groupBy("a", "b").agg(F.min(F.struct(F.round("cost", 9).alias("cost"), "offset")).alias("m")).select("a", "b", "m.cost", "m.offset")


def motif_of_alignment(aligned: DataFrame, letters: str, prior: float = 0.1) -> DataFrame:
    """grp, place, residue, n, p, ll: the letters of every column of each aligned group (grp, seq_id, aligned), with a
    pseudocount of prior x background, and the group's log-likelihood ratio against the background.  Gaps don't count."""
    cells = aligned.select("grp", F.posexplode(F.split("aligned", "")).alias("place", "residue")).where(F.col("residue").isin(list(letters)))
    n = written(cells.groupBy("grp", "place", "residue").agg(F.count("*").alias("n")), "columns")
    every = n.agg(F.sum("n").alias("every"))
    bg = n.groupBy("residue").agg(F.sum("n").alias("k")).join(F.broadcast(every)).select("residue", (F.col("k") / F.col("every")).alias("bg"))
    f = frequencies(n.withColumnRenamed("grp", "motif"), bg, prior)
    ll = f.where("n > 0").groupBy("motif").agg(F.sum(F.col("n") * F.log(F.col("p") / F.col("bg"))).alias("ll"))
    return f.join(ll, "motif").select(F.col("motif").alias("grp"), "place", "residue", "n", "p", "ll")


def agreement(a: list[tuple[int, int]], b: list[tuple[int, int]], width: int) -> float:
    """The larger share of two sorted hit lists (sequence, position) that meets within width, matched greedily."""
    i = j = both = 0
    while i < len(a) and j < len(b):
        if a[i][0] == b[j][0] and abs(a[i][1] - b[j][1]) <= width:
            both, i, j = both + 1, i + 1, j + 1
        elif a[i] < b[j]:
            i += 1
        else:
            j += 1
    return max(both / len(a), both / len(b)) if a and b else 0.0


def agreement_table(found: DataFrame, pairs: DataFrame, width: int) -> DataFrame:
    """a, b, agreement for pairs of motifs.

    Hits are matched within each sequence, so a pair is split over its sequences and only counts meet."""
    for_python(found.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            both = []
            for x, y in zip(pdf["x"], pdf["y"], strict=True):
                x, y = sorted(x), sorted(y)
                i = j = n = 0
                while i < len(x) and j < len(y):
                    if abs(x[i] - y[j]) <= width:
                        n, i, j = n + 1, i + 1, j + 1
                    elif x[i] < y[j]:
                        i += 1
                    else:
                        j += 1
                both.append(n)
            yield pd.DataFrame({"a": pdf["a"], "b": pdf["b"], "both": both})

    lists = found.groupBy("motif", "seq_id").agg(F.collect_list("pos").alias("hits"))  # a motif's places in one sequence
    total = found.groupBy("motif").agg(F.count("*").alias("n"))
    x = lists.select(F.col("motif").alias("a"), "seq_id", F.col("hits").alias("x"))
    y = lists.select(F.col("motif").alias("b"), "seq_id", F.col("hits").alias("y"))
    n = pairs.join(x, "a").join(y, ["b", "seq_id"]).select("a", "b", "x", "y").mapInPandas(run, "a string, b string, both long").groupBy("a", "b").agg(F.sum("both").alias("both"))
    t = lambda c: total.select(F.col("motif").alias(c), F.col("n").alias(f"n_{c}"))
    out = pairs.join(n, ["a", "b"], "left").join(t("a"), "a").join(t("b"), "b")
    return out.select("a", "b", F.greatest(F.coalesce("both", F.lit(0)) / F.col("n_a"), F.coalesce("both", F.lit(0)) / F.col("n_b")).alias("agreement"))


def segments(x: np.ndarray, least: int, density: float) -> list[tuple[int, int, float, float]]:
    """(start, end, lowest, highest density) of maximal scoring segments: a segment splits where its weakest prefix or
    suffix ends; it counts if its density range is wide enough and it is long enough."""
    out, todo = [], [(0, len(x), -math.inf)]
    while todo:
        a, b, low = todo.pop()
        if b - a < 2:
            continue
        v = x[a:b]
        n = np.arange(1, b - a)
        prefix, suffix = np.cumsum(v)[:-1] / n, np.cumsum(v[::-1])[:-1] / n
        i, j = int(prefix.argmin()), int(suffix.argmin())
        weak = min(prefix[i], suffix[j])
        high = max(low, float(weak))
        if b - a >= least and low > -math.inf and high > density * max(low, 1e-9):
            out.append((a, b, float(low), high))
        cut = a + i + 1 if prefix[i] <= suffix[j] else b - j - 1
        todo += [(a, cut, high), (cut, b, high)]
    return sorted(out)


def refine(seqs: list[np.ndarray], motif: np.ndarray, background: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Mixture refinement of a count matrix (EM): windows are the motif or background; returns frequencies and share."""
    width, letters = motif.shape
    p = (motif + 0.1 / letters) / (motif + 0.1 / letters).sum(1, keepdims=True)
    wins = np.array([s[i : i + width] for s in seqs for i in range(len(s) - width + 1)])
    share = 1 / max(2.0, np.sqrt(len(wins)))
    base = np.log(background)[wins].sum(1)
    for _ in range(rounds):
        fit = np.log(p)[np.arange(width), wins].sum(1)
        z = 1 / (1 + np.exp(np.clip(base + math.log(1 - share) - fit - math.log(share), -700, 700)))
        counts = np.full((width, letters), 0.1 / letters)
        for c in range(letters):
            counts[:, c] += ((wins == c) * z[:, None]).sum(0)
        p, share = counts / counts.sum(1, keepdims=True), float(np.clip(z.mean(), 1e-6, 0.5))
    return p, share


def refine_over_tasks(seqs: DataFrame, alphabet: str, motif: np.ndarray, background: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, float, list[float]]:
    """refine() of a table (seq_id, seq): frequencies, share and the objective of each round, which never falls (log
    likelihood of all windows and the pseudocounts').

    A round's task adds up, over the windows of its sequences, the expected letters at each place, the expected number of
    motifs and the log likelihood; these sums (width x letters numbers a task) meet in Spark."""
    for_python(seqs.sparkSession)
    width, letters = motif.shape
    p = (motif + 0.1 / letters) / (motif + 0.1 / letters).sum(1, keepdims=True)
    usable = seqs.where(F.length("seq") >= width).select("seq")
    n = usable.agg(F.sum(F.length("seq") - (width - 1))).first()[0] or 0
    share, path = 1 / max(2.0, math.sqrt(n)), []
    at = np.zeros(128, dtype=np.int64)
    at[[ord(c) for c in alphabet]] = np.arange(letters)

    # equal windows have equal expectations: up to 12 letters, each different one is there once with its number
    packed = width <= 12
    if packed:
        usable = written(T.word_counts(usable, width, alphabet), "windows")

    def expectation(p: np.ndarray, share: float):
        lp, base = np.log(p), np.log(background)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            counts, motifs, total = np.zeros((width, letters)), 0.0, 0.0
            for pdf in batches:
                if packed:
                    code = pdf["code"].to_numpy()
                    given = [([(code >> 5 * (width - 1 - j)) & 31 for j in range(width)], pdf["n"].to_numpy())]
                else:
                    texts = (at[np.frombuffer(s.encode("ascii"), dtype=np.uint8)] for s in pdf["seq"])
                    given = (([x[j : j + len(x) - width + 1] for j in range(width)], 1) for x in texts)
                for x, times in given:
                    inside = sum(lp[j, x[j]] for j in range(width)) + math.log(share)
                    outside = sum(base[x[j]] for j in range(width)) + math.log(1 - share)
                    both = np.logaddexp(inside, outside)
                    z = np.exp(inside - both) * times
                    motifs, total = motifs + float(z.sum()), total + float((both * times).sum())
                    for j in range(width):
                        counts[j] += np.bincount(x[j], weights=z, minlength=letters)
            yield pd.DataFrame({"kind": range(width * letters + 2), "v": [*counts.ravel().tolist(), motifs, total]})

        return run

    for _ in range(rounds):
        rows = usable.mapInPandas(expectation(p, share), "kind int, v double").groupBy("kind").agg(F.sum("v").alias("v")).collect()  # width x letters + 2 rows
        got = np.zeros(width * letters + 2)
        for r in rows:
            got[r["kind"]] = r["v"]
        path.append(float(got[-1] + (0.1 / letters) * np.log(p).sum()))
        counts = got[:-2].reshape(width, letters) + 0.1 / letters
        p, share = counts / counts.sum(1, keepdims=True), float(np.clip(got[-2] / max(n, 1), 1e-6, 0.5))
    return p, share, path


def rounds_of_common(seqs: DataFrame, shortest: int, least: int, most: int = ROUNDS) -> DataFrame:
    """kmer, n, n_seq, round: in each round all longest substrings that so many sequences share are taken and blanked out
    of the sequences, until none of the shortest length is left, or for so many rounds.

    A round is a length, and lengths only fall.  The driver holds how many letters of rows have which length next, at most
    one number a length; rows of up to rounds.LETTERS letters go through many lengths in one task, in one step."""
    sizes = lambda t: {r["best"]: r["n"] for r in t.where("best IS NOT NULL").groupBy("best").agg(F.sum(F.length("seq")).alias("n")).collect()}
    rows, found = [written(rounds.bounded(seqs, shortest, least), "rows")], []
    waiting, lengths = sizes(rows[0]), set()
    while waiting and len(lengths) < most:
        order = sorted(waiting, reverse=True)
        fits = next((i for i in range(len(order)) if sum(waiting[b] for b in order[: i + 1]) > rounds.LETTERS), len(order))
        low = order[0] if not fits else order[fits] + 1 if fits < len(order) else shortest
        some = reduce(DataFrame.unionByName, rows).where(F.col("best").between(low, order[0]))
        step = rounds.by_one_task(some, low, shortest, least) if fits else rounds.over_tasks(some, low, shortest, least)
        step = written(step, "step")
        rows.append(step.where("best IS NOT NULL").select(*rows[0].columns))
        found.append(step.where("kmer IS NOT NULL").select("kmer", "n", "n_seq", "length"))
        lengths |= {r["length"] for r in found[-1].select("length").distinct().collect()}
        waiting = {b: n for b, n in waiting.items() if b < low}
        for b, n in sizes(rows[-1]).items():
            waiting[b] = waiting.get(b, 0) + n
        if len(rows) > STEPS:
            rows = [written(reduce(DataFrame.unionByName, rows).where(F.col("best") < low), "rows")]
            found = [written(reduce(DataFrame.unionByName, found), "found")]
    if not lengths:
        return seqs.sparkSession.createDataFrame([], "kmer string, n long, n_seq long, round int")
    turns = F.array(*map(F.lit, sorted(lengths, reverse=True)[:most]))
    out = reduce(DataFrame.unionByName, found).withColumn("round", (F.array_position(turns, F.col("length")) - 1).cast("int"))
    return out.where("round >= 0").select("kmer", "n", "n_seq", "round")


def suffix_order(labels: DataFrame, width: int = suffixes.WIDE) -> DataFrame:
    """event_id, place, before, lcp: every whole suffix of the label sequences in order (ties by event_id), from 0, with
    the event of the suffix before it and the length of their common prefix; labels: user_id, pos (from 0), event_id, state.

    The order is that of the suffix index: one sort by the first labels, prefix doubling only beyond."""
    rows = labels.select(F.col("user_id").alias("seq_id"), "pos", "event_id", "state")
    out = suffixes.with_before(suffixes.in_order(rows, width, ("event_id",))).withColumnRenamed("b_event_id", "before")
    return out.select("event_id", "place", "before", "lcp")
