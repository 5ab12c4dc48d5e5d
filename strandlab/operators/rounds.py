"""Rounds of common substrings: words are tried from the longest length down, each place only where it can still count.

A row is a text (equal sequences are one, with their number as weight) with a bound for every place: no word that begins
there, holds nothing blanked and is longer can be common.  Bounds start as those of the suffix order (suffixes.reach) and
only fall, so a length needs the rows alone whose highest bound it is, and in these the places alone that reach it.  Rows of
few letters are taken through many lengths by one task; a length with more is counted over tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlab.operators import suffixes
from strandlab.session import for_python, written

#: Letters of the rows that one task takes through many lengths, places that are sent on at once.
LETTERS, SENT = 1 << 20, 1 << 16
#: Words of more letters are told apart by a digest of 128 bits while one task counts them.
SHORT = 64
#: Columns of a step's table: a word that it took, or a row as it leaves it.
WORD, ROW = "kmer string, n long, n_seq long, length int", "seq_id long, w long, seq string, b array<int>, best int"


def bounded(seqs: DataFrame, shortest: int, least: int) -> DataFrame:
    """seq_id (a new one), w (sequences that are equal), seq, b (bounds by place), best (the highest) of all texts in which
    something can be common."""
    texts = seqs.where("seq <> ''").groupBy("seq").agg(F.count("*").alias("w"))
    texts = written(texts.withColumn("seq_id", F.monotonically_increasing_id()), "texts")
    far = suffixes.reach(suffixes.with_before(suffixes.in_order(suffixes.letters(texts))), least)
    b = F.array_sort(F.collect_list(F.struct("pos", "reach")))["reach"]
    each = far.groupBy("seq_id").agg(F.transform(b, lambda x: x.cast("int")).alias("b"))  # a sequence is a row's value
    rows = texts.join(each.hint("merge"), "seq_id").withColumn("best", F.array_max("b"))
    return rows.where(F.col("best") >= shortest).select("seq_id", "w", "seq", "b", "best")


def _lowered(b: np.ndarray, k: int, starts: np.ndarray) -> np.ndarray:
    """Bounds after the length k, of which the words at starts are blanked; b: of a text, or of texts one after another."""
    b = np.minimum(b, k - 1)
    if len(starts):
        edge = np.zeros(len(b) + 1, dtype=np.int64)
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + k, -1)
        at = np.arange(len(b))
        gone = np.where(np.cumsum(edge[:-1]) > 0, at, len(b))
        b = np.minimum(b, np.minimum.accumulate(gone[::-1])[::-1] - at)  # up to what is blanked next; 0 in it
    return b


def _names(kinds: str) -> list[str]:
    return [x.split()[0] for x in kinds.split(", ")]


def _step(words: list[tuple], rows: list[tuple]) -> Iterator[pd.DataFrame]:
    """Words and rows as rows of a step's table."""
    each = [(*w, None, None, None, None, None) for w in words] + [(None, None, None, None, *r) for r in rows]
    whole = {x: "Int64" for x in ("n", "n_seq", "length", "seq_id", "w", "best")}
    for i in range(0, len(each), SENT):
        yield pd.DataFrame(each[i : i + SENT], columns=_names(f"{WORD}, {ROW}"), dtype=object).astype(whole)


def by_one_task(rows: DataFrame, low: int, shortest: int, least: int) -> DataFrame:
    """The step of all lengths from the highest bound down to low, of rows of few letters."""
    for_python(rows.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        given = [pdf for pdf in batches if len(pdf)]
        if not given:
            return
        given = pd.concat(given, ignore_index=True)
        text, sizes = "".join(given["seq"]), given["seq"].str.len().to_numpy(dtype=np.int64)
        b = np.concatenate([np.asarray(x, dtype=np.int64) for x in given["b"]])
        of, weight, words = np.repeat(np.arange(len(given)), sizes), given["w"].tolist(), []
        while (k := int(b.max())) >= low:
            found: dict = {}  # word: sequences, places, the last row
            places = np.flatnonzero(b == k)
            for i, s in zip(places.tolist(), of[places].tolist(), strict=True):
                word = text[i : i + k]
                key = word if k <= SHORT else hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=16).digest()
                entry = found.setdefault(key, [0, [], -1])
                entry[1].append(i)
                if entry[2] != s:
                    entry[0] += weight[s]
                    entry[2] = s
            taken = [(n_seq, at) for n_seq, at, _ in found.values() if n_seq >= least]
            words += [(text[at[0] : at[0] + k], sum(weight[s] for s in of[at].tolist()), n_seq, k) for n_seq, at in taken]
            b = _lowered(b, k, np.array([i for _, at in taken for i in at], dtype=np.int64))
        ends = np.cumsum(sizes)
        kept = [(r.seq_id, r.w, r.seq, x.tolist(), int(x.max())) for r, x in zip(given.itertuples(), np.split(b, ends[:-1]), strict=True) if x.max() >= shortest]
        yield from _step(words, kept)

    return rows.coalesce(1).mapInPandas(run, f"{WORD}, {ROW}")


def over_tasks(rows: DataFrame, k: int, shortest: int, least: int) -> DataFrame:
    """The step of one length, the highest bound k of all rows.

    A text sends each of its words once, with its places; joins are not broadcast, as Spark's estimate of rows made from a
    compressed text is far too low."""
    for_python(rows.sparkSession)

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, n = [], 0
        for pdf in batches:
            for r in pdf.itertuples():
                found: dict[str, list[int]] = {}
                for i in np.flatnonzero(np.asarray(r.b) == k).tolist():
                    found.setdefault(r.seq[i : i + k], []).append(i)
                out += [(w, r.seq_id, r.w, at) for w, at in found.items()]
                n += sum(map(len, found.values())) * (1 + k // 64)
                if n >= SENT:
                    yield pd.DataFrame(out, columns=["kmer", "seq_id", "w", "places"])
                    out, n = [], 0
        yield pd.DataFrame(out, columns=["kmer", "seq_id", "w", "places"])

    def lower(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                b = _lowered(np.asarray(r.b, dtype=np.int64), k, np.asarray(r.places if r.places is not None else [], dtype=np.int64))
                if b.max() >= shortest:
                    out.append((r.seq_id, r.w, r.seq, b.tolist(), int(b.max())))
            yield pd.DataFrame(out, columns=_names(ROW))

    each = rows.mapInPandas(words, "kmer string, seq_id long, w long, places array<int>")
    counted = each.groupBy("kmer").agg(F.sum(F.size("places") * F.col("w")).alias("n"), F.sum("w").alias("n_seq"))
    taken = written(counted.where(F.col("n_seq") >= least).withColumn("length", F.lit(k)), "common")
    hit = each.join(taken.select("kmer").hint("merge"), "kmer", "left_semi").groupBy("seq_id").agg(F.flatten(F.collect_list("places")).alias("places"))
    left = rows.join(hit.hint("merge"), "seq_id", "left").mapInPandas(lower, ROW)
    return taken.unionByName(left, allowMissingColumns=True)
