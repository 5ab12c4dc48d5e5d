"""Language ID: string-kernel classification with Nystroem landmarks and one-versus-rest kernel ridge regression.

The kernel of two texts is the blended spectrum of presence: the number of distinct n-grams (orders 2 to 4 of lower-cased
letters, other characters being one blank) that both have, over the geometric mean of the numbers that each has.  A
text's kernel values with m landmark texts, times the inverse square root of the landmarks' own kernel matrix, are its
Nystroem features; a ridge regression on them per language, with targets 1 and -1, gives the decision values.

A batch of texts is scored by matrix products: its presence matrix over the landmarks' n-grams times the landmarks' one
gives all kernel values, and these times one small matrix all decision values.  Texts are read where they lie, whole,
without a shuffle; long ones in stretches, of which only distinct n-grams are kept.

Bounds, all parameters: the fit sees at most ROWS rows, as many of each language (the first by a hash of doc_id and
text; fewer where nearly all of a language's rows are repeated ones), of the LANGUAGES most frequent languages; LANDMARKS of these rows, dealt to the languages in turn, are landmarks,
texts of at most LANDMARK_GRAMS distinct n-grams (a language that has none: its shortest).  To the driver come languages' counts, landmarks'
n-grams and the sample's kernel values, no other row.

score is the winner's decision value, mapped from [-1, 1] to [0, 1] and cut there.  Defined results: lang_pred is `und`
and score 0 if the text is null, has no letter, or no language was learned; ties go to the first language in order of
code points; with one language every text with letters gets it, with score 1; repeated rows get a row each; a row that
is in no fold (null doc_id) is learned from; other columns are ignored.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlab.llm.common import bounded_batches, discard, staged, table
from strandlab.llm.ngrams import held_out

ORDERS = (2, 3, 4)
ROWS, LANGUAGES, LANDMARKS, LANDMARK_GRAMS = 4000, 200, 160, 4000
RIDGE = 1e-3
#: Texts whose presence matrix is built at once, and characters of a text taken at once.
TOGETHER, STRETCH = 32, 1 << 19
_BASE = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """By code point: is it a letter; is it part of a word (a letter or a mark)."""
    kinds = np.array([ord(unicodedata.category(chr(i))[0]) for i in range(sys.maxunicode + 1)], dtype=np.uint8)
    return kinds == ord("L"), (kinds == ord("L")) | (kinds == ord("M"))


def grams(text: str, orders: tuple[int, ...] = ORDERS) -> np.ndarray:
    """Sorted distinct 64-bit n-grams of the whole text; none if it has no letter.  Up to three characters' n-grams are
    exact, longer ones hashes."""
    letter, part = _letters()
    found, tail, some = [], np.zeros(0, dtype=np.uint64), False
    for at in range(0, len(text), STRETCH):
        code = np.frombuffer(text[at : at + STRETCH].lower().encode("utf-32-le", "replace"), dtype=np.uint32)
        some = some or bool(letter[code].any())
        inside = part[code]
        before = np.concatenate([[bool(len(tail)) and tail[-1] != 32], inside[:-1]])
        code = np.where(inside, code, 32)[inside | before]
        lead = tail if at else np.array([32], dtype=np.uint64)
        code = np.concatenate([lead, code.astype(np.uint64)])
        if at + STRETCH >= len(text) and code[-1] != 32:
            code = np.append(code, np.uint64(32))
        new, h = [], code
        for n in range(2, max(orders) + 1):
            h = (h[:-1] << np.uint64(21)) | code[n - 1 :] if n < 4 else (h[:-1] * _BASE) ^ (code[n - 1 :] * np.uint64(n) + (h[:-1] >> np.uint64(31)))
            if n in orders:
                new.append(h)
        new = np.concatenate([*found, *new])
        new.sort()
        found = [new[np.concatenate([[True], new[1:] != new[:-1]])] if len(new) else new]
        tail = code[-(max(orders) - 1) :]
    return found[0] if some else np.zeros(0, dtype=np.uint64)


class Kernel:
    """Normalised kernel values of texts with landmarks, by matrix products."""

    def __init__(self, landmarks: list[np.ndarray]):
        self.known = np.unique(np.concatenate(landmarks))
        self.size = np.array([len(g) for g in landmarks], dtype=np.float32)
        self.presence = np.zeros((len(self.known), len(landmarks)), dtype=np.float32)
        for j, g in enumerate(landmarks):
            self.presence[np.searchsorted(self.known, g), j] = 1

    def __call__(self, texts: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(texts), len(self.size)))
        for at in range(0, len(texts), TOGETHER):
            some = texts[at : at + TOGETHER]
            x = np.zeros((len(some), len(self.known)), dtype=np.float32)
            for i, g in enumerate(some):
                place = np.minimum(np.searchsorted(self.known, g), len(self.known) - 1)
                x[i, place[self.known[place] == g]] = 1
            own = np.array([max(1, len(g)) for g in some], dtype=np.float64)
            out[at : at + len(some)] = (x @ self.presence) / np.sqrt(own[:, None] * self.size)
        return out


def nystroem(own: np.ndarray) -> np.ndarray:
    """The inverse square root of the landmarks' kernel matrix, without directions that are zero but for rounding."""
    value, vector = np.linalg.eigh(own)
    keep = value > 1e-6 * max(float(value.max()), 1e-12)
    return vector[:, keep] / np.sqrt(value[keep])


def ridge(features: np.ndarray, y: np.ndarray, n_classes: int, strength: float = RIDGE) -> tuple[np.ndarray, np.ndarray]:
    """Weights and offsets of the one-versus-rest regressions; rows count so that all classes weigh the same."""
    target = np.where(y[:, None] == np.arange(n_classes), 1.0, -1.0)
    weight = 1 / np.bincount(y, minlength=n_classes)[y]
    weight /= weight.sum()
    centre, middle = weight @ features, weight @ target
    x, t = features - centre, target - middle
    w = np.linalg.solve((x * weight[:, None]).T @ x + strength * np.eye(x.shape[1]), (x * weight[:, None]).T @ t)
    return w, middle - centre @ w


def _sample(docs: DataFrame, learn: Column, rows: int, languages: int) -> tuple[DataFrame, list[str]]:
    usable = docs.where(learn & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), F.xxhash64("doc_id", "text").alias("h"))
    count = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages).collect()}
    known = sorted(count)
    each = max(1, rows // max(1, len(known)))
    # hashes below a share that leaves twice as many as are taken: few rows of any language meet in a task
    share = F.create_map(*(F.lit(v) for k in known for v in (k, min(1.0, 2 * each / count[k])))) if known else F.create_map(F.lit(""), F.lit(0.0))
    some = usable.where((F.col("h") / float(1 << 64) + 0.5) < F.element_at(share, F.col("lang")))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))
    return some.withColumn("place", place).where(F.col("place") <= each), known


def train(docs: DataFrame, learn: Column, *, rows: int = ROWS, languages: int = LANGUAGES, landmarks: int = LANDMARKS, landmark_grams: int = LANDMARK_GRAMS, strength: float = RIDGE):
    """predict(texts) -> (languages, scores), fitted on the documents for which learn holds."""
    bounded_batches(docs.sparkSession)
    sample, known = _sample(docs, learn, rows, languages)
    if not known:
        return lambda texts: (["und"] * len(texts), [0.0] * len(texts))
    number = {k: i for i, k in enumerate(known)}

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [grams(t.as_py()) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([g.tobytes() for g in found], pa.binary()), pa.array([len(g) for g in found], pa.int64())], names=["lang", "place", "grams", "n"])

    texts = staged(sample.select("lang", "place", "text").mapInArrow(extract, "lang string, place int, grams binary, n long"), "sample")
    far = F.col("n") > landmark_grams
    turn = F.row_number().over(Window.partitionBy("lang").orderBy(far, F.when(far, F.col("n")), "place"))
    chosen = texts.select("lang", "place", "n", turn.alias("turn")).where(~far | (F.col("turn") == 1)).orderBy("turn", "lang").limit(landmarks)
    marks = texts.join(F.broadcast(chosen.select("lang", "place", "turn")), ["lang", "place"]).select("turn", "lang", "grams").toArrow().sort_by([("turn", "ascending"), ("lang", "ascending")])
    kernel = Kernel([np.frombuffer(g.as_py(), dtype=np.uint64) for g in marks["grams"]])
    both = kernel.presence.T @ kernel.presence
    project = nystroem(both.astype(np.float64) / np.sqrt(np.outer(kernel.size, kernel.size)))

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = kernel([np.frombuffer(g.as_py(), dtype=np.uint64) for g in b.column(2)])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([v.tobytes() for v in k], pa.binary())], names=["lang", "place", "k"])

    got = texts.select("lang", "place", "grams").mapInArrow(values, "lang string, place int, k binary").toArrow().sort_by([("place", "ascending"), ("lang", "ascending")])
    discard(texts)
    x = np.stack([np.frombuffer(v.as_py(), dtype=np.float64) for v in got["k"]]) @ project
    y = np.array([number[v] for v in got["lang"].to_pylist()], dtype=np.int64)
    w, offset = ridge(x, y, len(known), strength)
    final = project @ w

    def predict(texts: list[str | None]) -> tuple[list[str], list[float]]:
        found = [grams(t or "") for t in texts]
        value = kernel(found) @ final + offset
        best = value.argmax(axis=1) if len(found) else []
        score = [1.0 if len(known) == 1 else min(1.0, max(0.0, (float(v[j]) + 1) / 2)) for v, j in zip(value, best, strict=True)]
        return [known[j] if len(g) else "und" for g, j in zip(found, best, strict=True)], [s if len(g) else 0.0 for g, s in zip(found, score, strict=True)]

    return predict


def identify(docs: DataFrame, predict) -> DataFrame:
    """doc_id, lang_pred, score of every document."""
    bounded_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, score = predict(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(score, pa.float64())], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def languages(spark, sf_dir: str) -> DataFrame:
    """op13: the language of every document; rows of fold 1 of 3 are held out from the fit."""
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, train(docs, ~held_out(3, 1)))
    return found.select("doc_id", held_out(3, 1).alias("held_out"), "lang_pred", "score")
