"""Hashed word, word-shape and character n-gram indicators of whole texts, and bounded labelled samples."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlab.llm.common import bounded_batches, discard, staged, text_of

BITS = 18
DIM = 1 << BITS
#: Labelled documents that a fit sees at most, for each class; the first by a hash of doc_id.
PER_CLASS = 4000
_CHUNK = 1 << 20
_SYMBOL = re.compile(rb"[#*$%&|<>]")
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    """word -> hash and shape in one integer; forgets all when it holds too many words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        text = word.decode("utf-8", "replace")
        core = text.strip(".,;:!?")
        shape = text[:1].isupper() | (len(core) > 1 and core.isupper()) << 1 | bool(_SYMBOL.search(word)) << 2 | text.endswith("!") << 3 | any(map(str.isdigit, text)) << 4 | (len(text) > 20) << 5 | (not core) << 6
        value = self[word] = (shape << 32) | zlib.crc32(word)
        return value


_WORDS = _Words()


def _fold(h: np.ndarray) -> np.ndarray:
    return ((h * _MIX) >> np.uint64(64 - BITS)).astype(np.uint32)


def _unique(parts: list[np.ndarray]) -> np.ndarray:
    found = np.concatenate(parts)
    if len(found) < 50_000:  # sorting beats numpy.unique's hashing here
        found.sort()
        return found[np.concatenate([[True], found[1:] != found[:-1]])]
    seen = np.zeros(DIM, dtype=bool)
    seen[found] = True
    return np.flatnonzero(seen).astype(np.uint32)


def indicators(text: str, orders: tuple[int, ...] = (1, 2, 3)) -> np.ndarray:
    """Sorted distinct hashed features of the whole text: word 1- and 2-grams, character n-grams of the given orders
    (over UTF-8 bytes), and word-shape n-grams by the logarithm of their share."""
    raw = text.encode("utf-8", "replace")
    parts = [np.zeros(1, dtype=np.uint32)]
    code = np.frombuffer(raw, dtype=np.uint8)
    for at in range(0, len(code), _CHUNK):  # long texts chunk by chunk, so that memory stays bounded
        c = code[max(0, at - max(orders) + 1) : at + _CHUNK].astype(np.uint64)
        h, found = c, []
        for n in range(1, max(orders) + 1):
            if n > 1:
                h = (h[:-1] << np.uint64(8)) | c[n - 1 :]
            if n in orders and len(h):
                found.append(_fold(h + np.uint64(n << 40)))
        parts += found if len(code) <= _CHUNK else [_unique(found)] * bool(found)
    words = raw.split()
    if words:
        value = np.fromiter(map(_WORDS.__getitem__, words), dtype=np.int64, count=len(words))
        h = (value & 0xFFFFFFFF).astype(np.uint64)
        parts += [_fold(h + np.uint64(5 << 40)), _fold(h[:-1] * np.uint64(31) + h[1:] + np.uint64(6 << 40))]
        shape = value >> 32
        same = np.concatenate([[0], h[1:] == h[:-1]]).astype(np.int64)
        for kind, s in ((7, shape), (8, (shape[:-1] << 8) | shape[1:]), (9, same)):
            v, n = np.unique(s, return_counts=True)
            if len(v):
                share = np.clip(np.log2(n / len(words)).round().astype(np.int64) + 16, 0, 31)
                parts.append(_fold((v.astype(np.uint64) << np.uint64(8)) + share.astype(np.uint64) + np.uint64(kind << 40)))
    return _unique(parts)


def held_out(modulus: int, fold: int) -> Column:
    """crc32 of the doc_id as text, modulo modulus, is fold."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == fold, F.lit(False))


def labelled_sample(labels: DataFrame, label: str, keep: Column, per_class: int = PER_CLASS) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, y) of at most per_class rows a class, and the number of usable rows of each class."""
    rows = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & keep).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    counts = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}  # two rows at most
    one = lambda y: rows.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
    return one(0).unionByName(one(1)), counts


def sampled_texts(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """h (hash of doc_id and text), y, text of the sampled documents, one row a doc_id (of several texts, the first by a
    hash), written once.  The sample has a fixed bound, so it is broadcast."""
    rows = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(sample), "doc_id")
    one = rows.groupBy("doc_id").agg(F.first("y").alias("y"), F.min_by("text", F.xxhash64("text")).alias("text"))
    return staged(one.select(F.xxhash64("doc_id", "text").alias("h"), "y", "text"), "sample")


def sample_features(texts: DataFrame, extract, dtype, most: int | None = None) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Feature arrays, classes and hashes of sampled texts in the order of their hashes; features, not texts, come to the
    driver.  most: only the first rows up to so many bytes of features."""
    bounded_batches(texts.sparkSession)
    schema = pa.schema([("h", pa.int64()), ("y", pa.int32()), ("x", pa.binary()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [extract(t.as_py()).tobytes() for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(x, pa.binary()), pa.array(map(len, x), pa.int64())], schema=schema)

    rows = staged(texts.select("h", "y", "text").mapInArrow(run, "h long, y int, x binary, n long"), "features")
    got = rows.select("h", "y", "x", "n")
    if most is not None:
        upto = rows.select("h", F.sum("n").over(Window.orderBy("h")).alias("bytes")).where(F.col("bytes") <= most).agg(F.max("h")).first()[0]  # a bounded sample
        got = got.where(F.col("h") <= F.lit(upto))
    got = got.toArrow().sort_by([("h", "ascending")])  # the same order at every run
    discard(rows)
    return [np.frombuffer(v.as_py(), dtype=dtype) for v in got["x"]], np.array(got["y"].to_pylist(), dtype=np.int32), np.array(got["h"].to_pylist(), dtype=np.int64)


class Indicators:
    """Sorted distinct features of a sample's texts, each as two bytes a feature or, where that takes less, as a bitmap: at
    most DIM / 8 bytes a text, however long."""

    def __init__(self, rows: list[bytes]):
        self.rows = rows

    def __len__(self) -> int:
        return len(self.rows)

    def __getitem__(self, i) -> np.ndarray | Indicators:
        if isinstance(i, (int, np.integer)):
            return unpacked(self.rows[i])
        return Indicators([self.rows[k] for k in i])

    def __iter__(self) -> Iterator[np.ndarray]:
        return map(unpacked, self.rows)


_HIGH = DIM >> 16  # values of a feature's upper bits


def packed(features: np.ndarray) -> bytes:
    """How many features have each value of the upper bits, and the lower 16 bits of all."""
    if 4 * _HIGH + 2 * len(features) < DIM // 8:
        return np.bincount(features >> 16, minlength=_HIGH).astype("<u4").tobytes() + features.astype("<u2").tobytes()
    seen = np.zeros(DIM, dtype=bool)
    seen[features] = True
    return np.packbits(seen).tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    if len(raw) < DIM // 8:
        upper = np.repeat(np.arange(_HIGH, dtype=np.uint32) << np.uint32(16), np.frombuffer(raw, dtype="<u4", count=_HIGH))
        return np.frombuffer(raw, dtype="<u2", offset=4 * _HIGH) + upper
    return np.flatnonzero(np.unpackbits(np.frombuffer(raw, dtype=np.uint8))).astype(np.uint32)


def sample_indicators(texts: DataFrame) -> tuple[Indicators, np.ndarray]:
    """Features and classes of all sampled texts, in the order of their hashes: rows times DIM / 8 bytes at most, which
    come to the driver part by part."""
    bounded_batches(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([packed(indicators(t.as_py())) for t in b.column(2)], pa.binary())], names=["h", "y", "x"])

    rows = staged(texts.select("h", "y", "text").mapInArrow(run, "h long, y int, x binary"), "features")
    got = sorted((r["h"], bytes(r["x"]), r["y"]) for r in rows.toLocalIterator())  # the same order at every run
    discard(rows)
    return Indicators([x for _, x, _ in got]), np.array([y for _, _, y in got], dtype=np.int32)


def split_apart(y: np.ndarray) -> np.ndarray:
    """Which fifth of the rows is kept for the calibration: none, unless both parts have both classes."""
    apart = np.arange(len(y)) % 5 == 4
    both = all(len(set(part.tolist())) == 2 for part in (y[apart], y[~apart]))
    return apart if both else np.zeros(len(y), dtype=bool)


def platt(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """a, b of the probability 1 / (1 + exp(-(a * margin + b))), by weighted Newton steps with a slight prior."""
    scale = float(np.std(margin)) or 1.0
    m, ab = margin / scale, np.array([1.0, 0.0])
    t = np.where(y == 1, 0.995, 0.005)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(ab[0] * m + ab[1], -30, 30)))
        g = np.array([np.sum(weight * (p - t) * m) + 1e-3 * ab[0], np.sum(weight * (p - t)) + 1e-3 * ab[1]])
        v = weight * p * (1 - p) + 1e-9
        hess = np.array([[np.sum(v * m * m) + 1e-3, np.sum(v * m)], [np.sum(v * m), np.sum(v) + 1e-3]])
        step = np.linalg.solve(hess, g)
        ab -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-7:
            break
    return max(float(ab[0]), 1e-6) / scale, float(ab[1])


def class_weights(y: np.ndarray, counts: dict[int, int]) -> np.ndarray:
    """Weights that give the sample the classes' shares among all usable rows."""
    total = sum(counts.values())
    share = {k: counts.get(k, 0) / total / max(1, int(np.sum(y == k))) for k in (0, 1)}
    return np.where(y == 1, share[1], share[0]) * len(y)


def score_texts(docs: DataFrame, score) -> DataFrame:
    """doc_id and score of every document; score(texts) gives the scores of an Arrow batch."""
    bounded_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score(b.column(1).to_pylist()), pa.float64())], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(run, "doc_id long, score double")
