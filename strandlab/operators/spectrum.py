"""Spectra of words: how many words of each length there are and how often they repeat, without a row a word.

The longest words of all places are integers, five bits a letter, the first letter highest, so every shorter word is a
stretch of their order.  A task sorts those of some million places and sends each once, in ranges, as packed differences;
a range is merged as it comes, and only its numbers leave a task, besides the first and last word of each length, which
may go on in the next range."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlab.functions import sequences as S
from strandlab.operators.suffixtree import _runs, frequent_words
from strandlab.session import for_python

#: Places that a task sorts at once, and places of a range, about.
BLOCK, RANGE = 1 << 22, 1 << 23
#: Beginnings by which ranges are cut: of so many letters, words of 12 letters go on in at most 26 ** 4 ways.
CUT = 8


def longest_words(texts: list[bytes], most: int, alphabet: str) -> np.ndarray:
    """The longest word of each place of all texts, of `most` letters or up to the text's end, filled up with zeros; letters
    count from 1."""
    at = np.zeros(128, dtype=np.int64)
    at[[ord(c) for c in alphabet]] = np.arange(1, len(alphabet) + 1)
    x = at[np.frombuffer(b"\0".join(texts) + bytes(most), dtype=np.uint8)]
    n = len(x) - most
    out, inside = np.zeros(n, dtype=np.int64), np.ones(n, dtype=bool)
    for j in range(most):
        inside &= x[j : j + n] > 0
        out = (out << 5) | np.where(inside, x[j : j + n], 0)
    return out[x[:n] > 0]


def _planes(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8).T)


def packed(code: np.ndarray, n: np.ndarray) -> bytes:
    """Rising codes and their counts in few bytes: differences, byte by byte."""
    both = np.concatenate([_planes(np.diff(code, prepend=0)), _planes(n)])
    return pa.compress(both.tobytes(), codec="zstd", asbytes=True)


def unpacked(size: int, held: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(pa.decompress(held, decompressed_size=size * 16, codec="zstd", asbytes=True), dtype=np.uint8).reshape(16, size)
    whole = lambda p: np.ascontiguousarray(p.T).view("<i8").reshape(size)
    return np.cumsum(whole(raw[:8])), whole(raw[8:])


def merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Codes in order, each once, with their summed counts."""
    code, n = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.argsort(code, kind="stable")
    code = code[order]
    first, _ = _runs(code)
    return code[first], np.add.reduceat(n[order], first)


def range_starts(seqs: DataFrame, most: int, alphabet: str, places: int) -> np.ndarray:
    """The codes at which ranges begin, but the first: cut before a beginning when so many places are in the range; only
    beginnings of more places than that are counted by further letters, up to CUT."""
    deep = min(most, CUT)
    rows = frequent_words(seqs, deep, alphabet, places).toPandas()  # at most letters ** 4, and letters * all places / places a length
    ones = lambda k: sum(1 << 5 * j for j in range(k))
    rows["first"] = [(c + ones(k)) << 5 * (most - k) for k, c in zip(rows["k"].tolist(), rows["code"].tolist(), strict=True)]
    # the finest beginnings: those that no longer one goes on from
    split = {(k - 1, c >> 5) for k, c in zip(rows["k"].tolist(), rows["code"].tolist(), strict=True)}
    fine = rows[[(k, c) not in split for k, c in zip(rows["k"].tolist(), rows["code"].tolist(), strict=True)]].sort_values("first")
    out, size = [], 0
    for first, n in zip(fine["first"].tolist(), fine["n"].tolist(), strict=True):
        if size and size + n > places:
            out.append(first)
            size = 0
        size += n
    return np.array(out, dtype=np.int64)


def _numbers(code: np.ndarray, n: np.ndarray, most: int) -> Iterator[dict]:
    """Of a range's words, by length: its first and last word with their counts, and the numbers of those between."""
    for k in range(1, most + 1):
        cut = code >> 5 * (most - k)
        whole = (cut & 31) > 0  # not the end of a shorter sequence
        cut, m = cut[whole], n[whole]
        if not len(cut):
            continue
        first, _ = _runs(cut)
        total = np.add.reduceat(m, first)
        for i in {0, len(first) - 1}:
            yield {"k": k, "code": int(cut[first[i]]), "n": int(total[i])}
        inner = total[1:-1]
        if len(inner):
            yield {"k": k, "words": len(inner), "total": int(inner.sum()), "most": int(inner.max()), "once": int((inner == 1).sum()), "squares": int((inner * inner).sum())}


_SCHEMA = pa.schema([("k", pa.int32()), *((c, pa.int64()) for c in ("code", "n", "words", "total", "most", "once", "squares"))])


def word_spectrum(seqs: DataFrame, most: int = 12, alphabet: str = S.LETTERS, block: int = BLOCK, places: int = RANGE) -> DataFrame:
    """k, words (that differ), total (places), most, once (words of one place), squares (sum of n * n) for each length 1 ..
    most (at most 12) that has words; seqs hold letters of the alphabet (at most 31) only."""
    if not 1 <= most <= 12 or len(alphabet) > 31:
        raise ValueError("at most 12 letters of an alphabet of at most 31 fit in a code")
    spark = seqs.sparkSession
    for_python(spark)
    seqs = seqs.select("seq").where("seq <> ''")
    starts = spark.sparkContext.broadcast(range_starts(seqs, most, alphabet, places))

    def pieces(code: np.ndarray) -> pd.DataFrame:
        code = np.sort(code)
        first, n = _runs(code)
        code = code[first]
        at = [0, *np.searchsorted(code, starts.value).tolist(), len(code)]
        own = [(i, b - a, packed(code[a:b], n[a:b])) for i, (a, b) in enumerate(zip(at, at[1:], strict=False)) if b > a]
        return pd.DataFrame(own, columns=["part", "size", "held"])

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for pdf in batches:
            for s in pdf["seq"]:
                text = s.encode("ascii")
                while len(text) > block:  # a stretch of a long sequence, with the letters its last words go on in
                    yield pieces(longest_words([text[: block + most - 1]], most, alphabet)[:block])
                    text = text[block:]
                held.append(text)
                size += len(text)
                if size > block:
                    yield pieces(longest_words(held, most, alphabet))
                    held, size = [], 0
        if held:
            yield pieces(longest_words(held, most, alphabet))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, size, last = None, [], 0, 0
        for b in batches:
            for p, n, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if p != part and held:
                    yield pa.RecordBatch.from_pylist(list(_numbers(*merged(held), most)), schema=_SCHEMA)
                    held, size, last = [], 0, 0
                part = p
                held.append(unpacked(n, raw.as_py()))
                size += n
                if size > 2 * last + places // 2:  # so that what is held grows with the words that differ
                    held = [merged(held)]
                    size = last = len(held[0][0])
        if held:
            yield pa.RecordBatch.from_pylist(list(_numbers(*merged(held), most)), schema=_SCHEMA)

    rows = seqs.mapInPandas(cut, "part int, size int, held binary")
    kinds = "k int, code long, n long, words long, total long, most long, once long, squares long"
    found = rows.repartition("part").sortWithinPartitions("part").mapInArrow(count, kinds)
    names = {"words": F.sum, "total": F.sum, "most": F.max, "once": F.sum, "squares": F.sum}
    # a word at the ends of ranges is one row now; the rest of a length is one with no code
    each = found.groupBy("k", "code").agg(F.sum("n").alias("n"), *(f(c).alias(c) for c, f in names.items()))
    n = F.col("n")
    edge = {"words": F.lit(1), "total": n, "most": n, "once": F.when(n == 1, 1).otherwise(0), "squares": n * n}
    each = each.select("k", *(F.when(F.col("code").isNull(), F.col(c)).otherwise(v).cast("long").alias(c) for c, v in edge.items()))
    return each.groupBy("k").agg(*(f(c).alias(c) for c, f in names.items()))
