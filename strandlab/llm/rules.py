"""Quality rules: counted rules, and a hashed n-gram logistic regression with fixed thresholds.

The regression is trained on a bounded sample of labelled quality rows (at most PER_CLASS of each class, parameter
per_class, each whole, as at most 32 kB of features), calibrated to probabilities on the part kept apart, and applied to whole texts in Arrow batches together with the counts; nothing is shuffled.

Words are maximal runs of other characters than blank and U+0009-U+000D.  n_repeat_words counts the words covered by a
3-word window that occurs at least twice in the text.  A null text is empty (and fails on its word count); repeated
rows each get a row; without usable labels of both classes the model keeps everything and the counted rules decide.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlab.llm.common import bounded_batches, table
from strandlab.llm.ngrams import DIM, PER_CLASS, class_weights, indicators, labelled_sample, platt, sample_indicators, sampled_texts, split_apart

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A document stays if its probability of good quality is at least this.
KEEP_AT = 0.5
_NOT_SYMBOL = bytes(c for c in range(256) if c not in b"#*$%&|<>")
_BLANK = b" \t\n\x0b\x0c\r"


def repeated_words(words: list[bytes]) -> int:
    """Words in 3-word windows found twice or more."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=n)
    size = len(number)
    if size < 1 << 21:  # three numbers in one
        key = (ids[:-2] * size + ids[1:-1]) * size + ids[2:]
    else:
        key = np.unique(ids[:-1] * size + ids[1:], return_inverse=True)[1][:-1].astype(np.int64) * size + ids[2:]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    again = np.zeros(n - 2, dtype=bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    covered = np.zeros(n, dtype=bool)
    for k in range(3):
        covered[k : n - 2 + k] |= again
    return int(covered.sum())


def counted(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    blanks = len(raw) - len(raw.translate(None, _BLANK))
    seen: set[bytes] = set()
    dup = 0
    for line in raw.split(b"\n"):
        if line in seen:
            dup += 1
        elif line.strip(_BLANK):
            seen.add(line)
    return len(words), len(text) - blanks, len(raw.translate(None, _NOT_SYMBOL)), dup, repeated_words(words)


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words


def fit_logistic(x, y: np.ndarray, counts: dict[int, int], epochs: int = 8, seed: int = 11):
    """probability(text) of class 1, or None without both classes: AdaGrad on the logistic loss, then calibration."""
    if len(set(y.tolist())) < 2:
        return None
    weight = class_weights(y, counts)
    apart = split_apart(y)
    train = np.flatnonzero(~apart)
    balance = {k: 0.5 * len(train) / max(1, int(np.sum(y[train] == k))) for k in (0, 1)}
    w, square = np.zeros(DIM), np.full(DIM, 1e-6)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(train):
            v = x[i]
            scale = 1 / math.sqrt(max(1, len(v)))
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, float(w[v].sum()) * scale))))
            g = (p - y[i]) * balance[int(y[i])] * scale + 1e-5 * w[v]
            square[v] += g * g
            w[v] -= 0.1 * g / np.sqrt(square[v])
    final = w.astype(np.float32)
    use = np.flatnonzero(apart) if apart.any() else train
    margin = np.array([float(final[x[i]].sum()) / math.sqrt(max(1, len(x[i]))) for i in use])
    a, b = platt(margin, y[use], weight[use])

    def probability(text: str) -> float:
        v = indicators(text)
        z = a * float(final[v].sum()) / math.sqrt(max(1, len(v))) + b
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))

    return probability


def train_rules(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS):
    """The fitted probability function; docs must hold the labelled documents' texts."""
    sample, counts = labelled_sample(labels, "quality", F.lit(True), per_class)
    x, y = sample_indicators(sampled_texts(docs, sample))
    return fit_logistic(x, y, counts)


def apply_rules(docs: DataFrame, probability, keep_at: float = KEEP_AT) -> DataFrame:
    """The documents with the counts, base_failed, probability and kept; all columns of docs come along."""
    bounded_batches(docs.sparkSession)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    own = docs.select(F.struct("*").alias("row"))  # the text goes to Python once, within its row
    kind = own.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in range(8)]
            for t in pc.struct_field(b.column(0), "text"):
                text = str(t.as_py() or "")
                c = counted(text)
                failed = base_failed(c[0], c[4])
                p = 1.0 if probability is None else probability(text)
                for column, v in zip(out, (*c, failed, p, not failed and p >= keep_at), strict=True):
                    column.append(v)
            types = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(out, types, strict=True))], names=["row", *names, "base_failed", "probability", "kept"])

    return own.mapInArrow(run, f"row {kind}, {', '.join(f'{n} long' for n in names)}, base_failed boolean, probability double, kept boolean")


def quality_rules(spark, sf_dir: str) -> DataFrame:
    """op6: counts and verdict of every document."""
    docs = table(spark, sf_dir, "documents")
    probability = train_rules(docs, table(spark, sf_dir, "labels"))
    ids = docs.select("doc_id", "text")
    return apply_rules(ids, probability).select(F.col("row.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "probability", "kept")
