"""Search of a database with a model that is trained on other sequences: a context model filters, a hidden Markov model
scores, and E-values are for the database's size.

Both models come from the training part; the length calibration of the filter comes from the database, whose sequences
are mostly strangers: its lines say what score a stranger of a length has, and outliers are left out of the fit."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlab.functions import sequences as S
from strandlab.operators import context as P
from strandlab.operators import infinite as N
from strandlab.operators import markov as H
from strandlab.operators import suffixtree as T
from strandlab.session import written

#: Sequences that the hidden Markov model is trained on at most (the first by a hash), its states at first, iterations.
ROWS, STATES, ITERATIONS = 200, 8, 4
#: Fixed value: deviations above the length's line from which a sequence is scored.
PASS = 3.0


@dataclass
class SearchModel:
    """tree: context model; model: calibrated hidden Markov model; alphabet of both."""

    tree: T.Tree
    model: H.Model
    alphabet: str


def trained(train: DataFrame, alphabet: str = S.LETTERS, depth: int = T.DEPTH, rows: int = ROWS, states: int = STATES, iterations: int = ITERATIONS, seed: int = 3) -> SearchModel:
    """Both models of the training sequences (seq_id, seq); the context model sees all of them."""
    train = written(train.select("seq_id", "seq"), "training")
    tree = T.grow(train, alphabet, depth)
    some = train.where("seq <> ''").orderBy(F.xxhash64("seq_id", "seq"), "seq_id").limit(rows)
    codes = some.select("seq_id", S.encode("seq", alphabet).alias("codes"))
    _, _, model = N.train(written(codes, "codes"), len(alphabet), iterations, seed, states)
    return SearchModel(tree, H.calibrated(model), alphabet)


def filtered(search: SearchModel, database: DataFrame, threshold: float = PASS) -> DataFrame:
    """seq_id, len, score, z of the database's sequences that pass; lines by length bins of the database's own scores."""
    scores = written(T.binned(written(T.score(database, search.tree), "scores")), "binned")
    return P.z_scores(scores, T.calibrate(scores)).where(F.col("z") >= threshold).select("seq_id", "len", "score", "z")


def hits(search: SearchModel, database: DataFrame, threshold: float = PASS) -> DataFrame:
    """name, score, score_bias, p_score, p_score_bias, e, e_bias of what passes, as write_hits() takes them."""
    database = written(database.select("seq_id", "seq"), "database")
    size = database.count()
    passed = written(filtered(search, database, threshold).select("seq_id"), "passed")
    found = H.score_table(database.join(passed.distinct(), "seq_id", "left_semi"), search.model, alphabet=search.alphabet)
    return found.select(F.col("seq_id").cast("string").alias("name"), "score", "score_bias", F.col("p").alias("p_score"), F.col("p_bias").alias("p_score_bias"), (F.col("p") * size).alias("e"), (F.col("p_bias") * size).alias("e_bias"))
