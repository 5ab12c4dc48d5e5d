"""Context models (probabilistic suffix trees) of contexts of up to DEPTH letters: growth, scoring, calibration.

A node is a context (the letters before a position) with the log-odds of every next letter against the background.

Words are integers, five bits a letter; those whose beginning is frequent enough for a node are counted, a pass a length
(frequent_words).  A level's nodes are a table made from the words of two lengths and the nodes of the level before by
joins on codes.  A context is tried only if its probability exceeds p_min, so a level has at most
1 / p_min nodes, whatever the corpus.  Scoring looks contexts up in arrays that are broadcast once to an executor, of seen
continuations only; beyond BROADCAST_BYTES it joins the words of the sequences with the nodes instead.

Models of contexts below four letters (at most 26 ** 3 nodes) are counted by arrays in one narrow pass and grown at once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlab.functions import sequences as S
from strandlab.operators import context as P
from strandlab.operators.counting import DIGITS, kmer_totals
from strandlab.session import for_python, written

#: A context has fewer than 12 letters, outliers of the calibration.
DEPTH, OUTLIER = 11, 20.0
#: Bytes of a model that are broadcast at most.
BROADCAST_BYTES = 256 << 20


#: Contexts of so many letters have so few words that all can be counted in arrays.
SHORT = 3


@dataclass
class Tree:
    """nodes: k (letters of the context), code, n and p (arrays by next letter); background: by letter; size: nodes of
    each level; seen: continuations that were seen, of all nodes; held: a small model's codes, n and p by level."""

    alphabet: str
    background: np.ndarray
    nodes: DataFrame
    gamma: float
    size: list[int]
    seen: int
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] | None = None

    def continuations(self) -> DataFrame:
        """k, code, residue, lod of the continuations that were seen; any other has the log of gamma."""
        bg = F.array(*(F.lit(float(x)) for x in self.background))
        each = self.nodes.select("k", "code", F.posexplode(F.arrays_zip("n", "p", bg.alias("bg"))).alias("residue", "x")).where("x.n > 0 AND x.bg > 0")
        return each.select("k", "code", "residue", F.log(F.col("x.p") / F.col("x.bg")).alias("lod"))

    def arrays(self) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
        """By level: sorted codes of the contexts; sorted codes of the seen words of one letter more, and their log-odds."""
        deep = range(len(self.size))
        if self.held:
            contexts, words, lods = [], [], []
            for code, n, p in self.held:
                at, letter = np.nonzero((n > 0) & (self.background > 0))
                contexts.append(code)
                words.append(code[at] * 32 + letter)
                lods.append(np.log(p[at, letter] / self.background[letter]))
            return contexts, words, lods
        one = self.nodes.select("k", "code").toArrow()
        two = self.continuations().select("k", (F.col("code") * 32 + F.col("residue")).alias("code"), "lod").toArrow()
        level = lambda t, k: t.filter(np.equal(t["k"].to_numpy(), k)).sort_by("code")
        words = [level(two, k) for k in deep]
        return [level(one, k)["code"].to_numpy() for k in deep], [w["code"].to_numpy() for w in words], [w["lod"].to_numpy() for w in words]


def coded(text: str, alphabet: str) -> np.ndarray:
    """Numbers of the letters; the text has no others."""
    at = np.zeros(128, dtype=np.int64)
    at[[ord(c) for c in alphabet]] = np.arange(len(alphabet))
    return at[np.frombuffer(text.encode("ascii"), dtype=np.uint8)]


def words_of(x: np.ndarray, k: int) -> np.ndarray:
    """Codes of all words of k letters, by place."""
    out = np.zeros(max(len(x) - k + 1, 0), dtype=np.int64)
    for j in range(k):
        out = (out << 5) | x[j : j + len(out)]
    return out


def found_in(codes: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the sorted array, and whether they hold the codes."""
    at = np.minimum(np.searchsorted(among, codes), max(len(among) - 1, 0))
    return at, among[at] == codes if len(among) else np.zeros(len(codes), dtype=bool)


def short_words(seqs: DataFrame, most: int, alphabet: str) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Sorted codes and counts of all words of each length 1 .. most (at most 4, so at most letters ** most words), in one
    narrow pass: a task adds its words up in arrays and sends each word at most once."""
    if most > 4:
        raise ValueError("words of more letters are counted by level")
    for_python(seqs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = {k: np.zeros(1 << 5 * k, dtype=np.int64) for k in range(1, most + 1)}
        for pdf in batches:
            for s in pdf["seq"]:
                x = coded(s, alphabet)
                for k, n in total.items():
                    w = words_of(x, k)
                    if len(w) * 8 > len(n):
                        n += np.bincount(w, minlength=len(n))
                    else:
                        np.add.at(n, w, 1)
        for k, n in total.items():
            code = np.flatnonzero(n)
            yield pd.DataFrame({"k": k, "code": code, "n": n[code]})

    rows = seqs.select("seq").where("seq <> ''").mapInPandas(run, "k int, code long, n long").groupBy("k", "code").agg(F.sum("n").alias("n")).toPandas().sort_values(["k", "code"])
    at = {k: rows[rows["k"] == k] for k in range(1, most + 1)}
    return {k: (r["code"].to_numpy(dtype=np.int64), r["n"].to_numpy(dtype=np.int64)) for k, r in at.items()}


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal numbers of a sorted array begins, and how long it is."""
    first = np.flatnonzero(np.concatenate([np.ones(min(len(x), 1), dtype=bool), x[1:] != x[:-1]]))
    return first, np.diff(np.append(first, len(x)))


def word_counts(seqs: DataFrame, k: int, alphabet: str = S.LETTERS, by_sequence: bool = False) -> DataFrame:
    """code, n of all words of k letters (at most 12), and n_seq, the rows that have them, with by_sequence; seqs hold
    letters of the alphabet only.  A task sorts the words of some million places and sends each once."""
    if not 1 <= k <= 12:
        raise ValueError("at most 12 letters fit in a code")
    for_python(seqs.sparkSession)

    def summed(held: list[np.ndarray]) -> pd.DataFrame:
        if not by_sequence:
            x = np.sort(np.concatenate(held))
            first, n = _runs(x)
            return pd.DataFrame({"code": x[first], "n": n})
        own = [(w := np.sort(h), *_runs(w)) for h in held]
        x, n = np.concatenate([w[first] for w, first, _ in own]), np.concatenate([m for _, _, m in own])
        at = np.argsort(x)
        first, n_seq = _runs(x[at])
        return pd.DataFrame({"code": x[at][first], "n": np.add.reduceat(n[at], first), "n_seq": n_seq})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for pdf in batches:
            for s in pdf["seq"]:
                if len(s) >= k:
                    held.append(words_of(coded(s, alphabet), k))
                    size += len(s)
                if size > 1 << 22:
                    yield summed(held)
                    held, size = [], 0
        if held:
            yield summed(held)

    names = ["n", "n_seq"] if by_sequence else ["n"]
    rows = seqs.select("seq").where(F.length("seq") >= k).mapInPandas(run, "code long, " + ", ".join(f"{c} long" for c in names))
    return rows.groupBy("code").agg(*(F.sum(c).alias(c) for c in names))


def frequent_words(seqs: DataFrame, most: int, alphabet: str, least: float) -> DataFrame:
    """k, code, n of the words of 1 .. most letters whose first k - 1 letters come more than `least` times (those of up to
    SHORT + 1 letters: all); every word that itself comes more than `least` times is among them.

    A pass a length, nothing but its counts is shuffled: a place goes on only while the word that begins there is frequent,
    and finds the next one in a table by (frequent word, next letter), at most letters * places / least entries a length."""
    spark, letters = seqs.sparkSession, len(alphabet)
    known = short_words(seqs, min(most, SHORT + 1), alphabet)
    kinds = "k int, code long, n long"
    out = spark.createDataFrame(pd.concat([pd.DataFrame({"k": k, "code": c, "n": n}) for k, (c, n) in known.items()]), kinds)
    if most <= SHORT + 1:
        return out
    codes, n = known[SHORT + 1]
    codes = codes[n > least]
    first = np.full(1 << 5 * (SHORT + 1), -1)
    first[codes] = np.arange(len(codes))
    steps: list[np.ndarray] = []
    for k in range(SHORT + 2, most + 1):
        if not len(codes):
            break
        shipped, size = spark.sparkContext.broadcast((first, steps)), len(codes) * letters

        def run(batches: Iterator[pd.DataFrame], k: int = k, shipped=shipped, size: int = size) -> Iterator[pd.DataFrame]:
            begin, tables = shipped.value
            total, text, held = np.zeros(size, dtype=np.int64), [], 0

            def add() -> None:
                """Several sequences at once; no word goes over an end."""
                x, ends = np.concatenate(text), np.cumsum([len(t) for t in text])
                at = np.concatenate([np.arange(e - len(t), e - k + 1) for t, e in zip(text, ends, strict=True)])
                now = begin[words_of(x, SHORT + 1)[at]]
                for j, table in enumerate(tables, SHORT + 1):
                    at, now = at[now >= 0], now[now >= 0]
                    now = table[now * letters + x[at + j]]
                at, now = at[now >= 0], now[now >= 0]
                np.add.at(total, now * letters + x[at + k - 1], 1)

            for pdf in batches:
                for s in pdf["seq"]:
                    if len(s) >= k:
                        text.append(coded(s, alphabet))
                        held += len(s)
                    if held > 1 << 18:
                        add()
                        text, held = [], 0
            if text:
                add()
            at = np.flatnonzero(total)
            yield pd.DataFrame({"at": at, "n": total[at]})

        rows = seqs.select("seq").where("seq <> ''").mapInPandas(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n"))
        found = rows.toArrow().sort_by("at")  # at most letters * places / least numbers
        at, n = found["at"].to_numpy(), found["n"].to_numpy()
        longer = codes[at // letters] * 32 + at % letters
        out = out.unionByName(spark.createDataFrame(pd.DataFrame({"k": np.full(len(at), k, dtype=np.int32), "code": longer, "n": n}), kinds))
        table = np.full(size, -1)
        table[at[n > least]] = np.arange((n > least).sum())
        steps, codes = [*steps, table], longer[n > least]
    return out


def grow(seqs: DataFrame, alphabet: str = S.LETTERS, depth: int = DEPTH, p_min: float = P.P_MIN, gamma: float = P.GAMMA) -> Tree:
    """The tree of all contexts that the growth rule accepts; p_min is at least 2 / N of every length.

    The root is the background.  A context a + s is added to its parent s if P(as) > p_min, sum_k P(ask) ln(P(ask) /
    (P(k|s) P(as))) > p_min over the seen letters k, and some continuation was seen.  P(x) = (c(x) + 1) / (N + letters)."""
    if depth <= SHORT:
        return _grown_at_once(seqs, alphabet, depth, p_min, gamma)
    letters = len(alphabet)
    total = {r["k"]: r["total"] or 0 for r in kmer_totals(seqs, depth + 1).select("k", "total").collect()}  # depth + 1 rows
    whole = all(total.get(k) for k in range(1, depth + 2))
    if whole:
        p_min = max([p_min, *(2 / t for t in total.values())])
    least = min(p_min * (t + letters) - 1 for t in total.values()) if whole else math.inf  # c(w) of any candidate is above
    words = written(frequent_words(seqs, depth + 1 if whole else 1, alphabet, least), "words")
    one = np.zeros(letters)
    for r in words.where("k = 1").collect():  # letters
        one[r["code"]] = r["n"]
    background = one / max(one.sum(), 1)
    doubles = lambda v: F.array(*(F.lit(float(x)) for x in v))
    root = seqs.sparkSession.range(1).select(F.lit(0).alias("k"), F.lit(0).cast("long").alias("code"), F.array(*(F.lit(int(x)) for x in one)).cast("array<long>").alias("n"), doubles(background).alias("p"))
    levels, size = [written(root, "level")], [1]
    if whole:
        here, bg = F.sequence(F.lit(0), F.lit(letters - 1)), doubles(background)
        for k in range(1, depth + 1):
            parent = F.col("code").bitwiseAND(F.lit((1 << 5 * (k - 1)) - 1))
            tried = words.where((F.col("k") == k) & (F.col("n") > least)).select("code", ((F.col("n") + 1) / float(total[k] + letters)).alias("pw"), parent.alias("parent")).where(F.col("pw") > p_min)
            tried = written(tried.join(levels[-1].select(F.col("code").alias("parent"), F.col("p").alias("pp")), "parent"), "tried")
            longer = words.where(F.col("k") == k + 1).select(F.shiftright("code", 5).alias("code"), F.col("code").bitwiseAND(31).cast("int").alias("residue"), "n")
            after = longer.join(tried.select("code"), "code", "left_semi").groupBy("code").agg(F.map_from_entries(F.collect_list(F.struct("residue", "n"))).alias("m"))  # at most letters each
            full = tried.join(after, "code").withColumn("n", F.transform(here, lambda i: F.coalesce(F.col("m")[i], F.lit(0).cast("long"))))
            longer_p = lambda i: (F.col("n")[i] + 1) / float(total[k + 1] + letters)  # noqa: B023, E731
            part = F.transform(here, lambda i: F.when(bg[i] > 0, longer_p(i) * F.log(longer_p(i) / (F.col("pp")[i] * F.col("pw")))).otherwise(0.0))
            every = F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x)
            good = full.withColumn("err", F.aggregate(part, F.lit(0.0), lambda a, x: a + x)).withColumn("every", every).where((F.col("err") > p_min) & (F.col("every") > 0))
            p = F.transform(here, lambda i: (1 - gamma) * F.col("n")[i] / F.col("every") + gamma * bg[i])
            level = written(good.select(F.lit(k).alias("k"), "code", "n", p.alias("p")), "level")
            n = level.count()
            if not n:
                break
            levels.append(level)
            size.append(n)
    nodes = levels[0]
    for level in levels[1:]:
        nodes = nodes.unionByName(level)
    seen = nodes.agg(F.sum(F.size(F.filter("n", lambda x: x > 0)))).first()[0]
    return Tree(alphabet, background, nodes, gamma, size, int(seen))


def _grown_at_once(seqs: DataFrame, alphabet: str, depth: int, p_min: float, gamma: float) -> Tree:
    """grow() for contexts of at most SHORT letters."""
    letters = len(alphabet)
    known = short_words(seqs, depth + 1, alphabet)
    total = [0, *(int(known[k][1].sum()) for k in range(1, depth + 2))]
    one = np.zeros(letters)
    one[known[1][0]] = known[1][1]
    background = one / max(one.sum(), 1)
    held = [(np.zeros(1, dtype=np.int64), one[None, :], background[None, :])]
    p_min = max([p_min, *(2 / t if t else math.inf for t in total[1:])])
    used = background > 0
    for k in range(1, depth + 1):
        (codes, n), (longer, n_longer), (above, _, p_above) = known[k], known[k + 1], held[-1]
        parent, has = found_in(codes & ((1 << 5 * (k - 1)) - 1), above)
        p_word = (n + 1) / (total[k] + letters)
        after = np.zeros((len(codes), letters))
        after[found_in(longer >> 5, codes)[0], longer & 31] = n_longer
        p_longer = (after + 1) / (total[k + 1] + letters)
        with np.errstate(divide="ignore", invalid="ignore"):
            each = p_longer * np.log(p_longer / (p_above[parent] * p_word[:, None]))
        every = after.sum(1)
        good = has & (p_word > p_min) & (every > 0) & (each[:, used].sum(1) > p_min)
        if not good.any():
            break
        held.append((codes[good], after[good], (1 - gamma) * after[good] / every[good, None] + gamma * background))
    rows = [(k, c, x, y) for k, level in enumerate(held) for c, x, y in zip(level[0].tolist(), level[1].astype(np.int64).tolist(), level[2].tolist(), strict=True)]
    nodes = seqs.sparkSession.createDataFrame(pd.DataFrame(rows, columns=["k", "code", "n", "p"]), "k int, code long, n array<long>, p array<double>")
    return Tree(alphabet, background, nodes, gamma, [len(level[0]) for level in held], int(sum((level[1] > 0).sum() for level in held)), held)


def spelled(k: Column, alphabet: str) -> Column:
    """The letters of code, a word of k letters."""
    return F.translate(F.lpad(F.conv(F.col("code").cast("string"), 10, 32), k, "0"), DIGITS[: len(alphabet)].upper(), alphabet)


def name_of(tree: Tree):
    """The context's letters, from k and code."""
    return spelled(F.col("k"), tree.alphabet)


def node_table(spark, tree: Tree) -> DataFrame:
    """context, residue, p, lod."""
    bg = F.array(*(F.lit(float(x)) for x in tree.background))
    each = tree.nodes.select(F.when(F.col("k") > 0, name_of(tree)).otherwise("").alias("context"), F.posexplode(F.arrays_zip("p", bg.alias("bg"))).alias("i", "x")).where("x.bg > 0")
    return each.select("context", F.substring(F.lit(tree.alphabet), F.col("i") + 1, F.lit(1)).alias("residue"), F.col("x.p").alias("p"), F.log(F.col("x.p") / F.col("x.bg")).alias("lod"))


def score_one(x: np.ndarray, contexts: list[np.ndarray], words: list[np.ndarray], lod: list[np.ndarray], unseen: np.ndarray) -> float:
    """Sum over the letters of the log-odds at the deepest context that is there; unseen: by letter."""
    value = unseen[x]
    at, has = found_in(x, words[0])
    value[has] = lod[0][at[has]]
    active = np.arange(len(x))
    for k in range(1, len(contexts)):
        active = active[active >= k]
        code = words_of(x, k)[active - k] if len(active) else np.zeros(0, dtype=np.int64)
        has = found_in(code, contexts[k])[1]
        active, code = active[has], code[has]
        if not len(active):
            break
        value[active] = unseen[x[active]]
        at, has = found_in((code << 5) | x[active], words[k])
        value[active[has]] = lod[k][at[has]]
    return float(value.sum())


def score(seqs: DataFrame, tree: Tree, most: int = BROADCAST_BYTES) -> DataFrame:
    """seq_id, len, score of every sequence; one narrow pass, or joins if the model is larger than `most` bytes."""
    if 8 * sum(tree.size) + 16 * tree.seen > most:
        return score_by_join(seqs, tree)
    for_python(seqs.sparkSession)
    unseen = np.where(tree.background > 0, math.log(tree.gamma), 0.0)
    shipped, alphabet = seqs.sparkSession.sparkContext.broadcast(tree.arrays()), tree.alphabet

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            value = [score_one(coded(s, alphabet), *shipped.value, unseen) for s in pdf["seq"]]
            yield pd.DataFrame({"seq_id": pdf["seq_id"], "len": pdf["seq"].str.len().astype("int32"), "score": np.array(value, dtype=float)})

    return seqs.where("seq IS NOT NULL").select("seq_id", "seq").mapInPandas(run, "seq_id long, len int, score double")


def score_by_join(seqs: DataFrame, tree: Tree) -> DataFrame:
    """The same by joins: each distinct word of a letter and the letters before it meets the nodes of all its contexts."""
    deep = len(tree.size) - 1
    rows = written(seqs.where("seq IS NOT NULL").select("seq_id", "seq").withColumn("row", F.monotonically_increasing_id()), "rows")
    padded = F.concat(F.lit("~" * deep), F.translate("seq", tree.alphabet, DIGITS[: len(tree.alphabet)]))
    each = rows.select("row", F.explode(F.regexp_extract_all(padded, F.lit(f"(?=(.{{{deep + 1}}}))"), F.lit(1))).alias("word"))
    counted = written(each.groupBy("row", "word").agg(F.count("*").alias("n")), "counted")
    number = lambda text: F.conv(text, 32, 10).cast("long")
    context = lambda k: F.expr(f"substring(word, {deep + 1} - {k}, {k})")
    shorter = F.filter(F.array(*(F.struct(F.lit(k).alias("k"), (number(context(k)) if k else F.lit(0).cast("long")).alias("code")) for k in range(deep + 1))), lambda c: (c["k"] == 0) | (F.expr(f"length(ltrim('~', word)) - 1") >= c["k"]))
    words = counted.select("word").distinct().select("word", number(F.substring("word", deep + 1, 1)).cast("int").alias("residue"), F.explode(shorter).alias("c"))
    deepest = words.select("word", "residue", "c.k", "c.code").join(tree.nodes.select("k", "code"), ["k", "code"]).groupBy("word").agg(F.first("residue").alias("residue"), F.max(F.struct("k", "code")).alias("c"))
    unseen = F.element_at(F.array(*(F.lit(math.log(tree.gamma) if b > 0 else 0.0) for b in tree.background)), F.col("residue") + 1)
    lods = deepest.select("word", "residue", "c.k", "c.code").join(tree.continuations(), ["k", "code", "residue"], "left").select("word", F.coalesce("lod", unseen).alias("lod"))
    sums = counted.join(lods, "word").groupBy("row").agg(F.sum(F.col("n") * F.col("lod")).alias("score"))
    return rows.join(sums, "row", "left").select("seq_id", F.length("seq").alias("len"), F.coalesce("score", F.lit(0.0)).alias("score"))


def search(seqs: DataFrame, tree: Tree, fit: DataFrame, threshold: float = 3.0) -> DataFrame:
    """The sequences whose score is at least threshold deviations above what their length lets expect, with z; fit by
    length bands of a fixed width."""
    return P.z_scores(score(seqs, tree).withColumn("band", P.band()), fit).where(F.col("z") >= threshold)


def binned(scores: DataFrame) -> DataFrame:
    """scores with band: greedy bins of more than 500 sequences along the lengths."""
    bins = written(P.greedy_bins(scores.select(F.col("len").cast("long").alias("len"))), "bins")
    at = bins.select(F.col("bin").alias("band"), "len_min", "len_max")
    return scores.join(F.broadcast(at), F.col("len").between(F.col("len_min"), F.col("len_max"))).drop("len_min", "len_max")


def calibrate(scores: DataFrame, threshold: float = OUTLIER) -> DataFrame:
    """band, a, b, v, n: the line of each bin, fitted again without its outliers until there are none left."""
    kept = scores.where("len > 0")
    n = kept.count()
    while True:
        fit = written(P.fit_line(kept, ["band"]), "fit")
        z = (F.col("score") - (F.col("a") + F.col("b") * F.col("len"))) / F.when(F.col("v") > 0, F.col("v"))
        kept = written(kept.join(F.broadcast(fit.select("band", "a", "b", "v")), "band").where(F.coalesce(F.abs(z) < threshold, F.lit(True))).select(*scores.columns), "kept")
        before, n = n, kept.count()
        if n == before:
            return fit
