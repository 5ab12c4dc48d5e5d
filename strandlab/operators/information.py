"""Information measures, agreement of labelings, competition of models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlab.functions.mathematics import bits
from strandlab.operators.orders import running

#: Background frequencies of the amino acids, in the order of the alphabet (Swiss-Prot 50.8).
AMINO = {
    "A": 0.0787945, "C": 0.0151600, "D": 0.0535222, "E": 0.0668298, "F": 0.0397062, "G": 0.0695071, "H": 0.0229198, "I": 0.0590092, "K": 0.0594422, "L": 0.0963728,
    "M": 0.0237718, "N": 0.0414386, "P": 0.0482904, "Q": 0.0395639, "R": 0.0540978, "S": 0.0683364, "T": 0.0540687, "V": 0.0673417, "W": 0.0114135, "Y": 0.0304133,
}


def null_model(spark, letters: int) -> DataFrame:
    """code, p: residue frequencies of the null model; uniform but for proteins.  They sum to 1."""
    values = list(AMINO.values()) if letters == 20 else [1.0] * letters
    every = sum(values)
    return spark.createDataFrame([(i, v / every) for i, v in enumerate(values)], "code int, p double")


def relative_entropy(table: DataFrame, by: str, p: str = "p", q: str = "bg") -> DataFrame:
    """by, bits: sum of p log2(p / q)."""
    return table.groupBy(by).agg(F.sum(bits(p, q)).alias("bits"))


def symmetric_divergence(table: DataFrame, key: str, item: str, p: str = "p") -> DataFrame:
    """a, b (a < b), kl: mean of both directions' relative entropies between any two keys' distributions.

    Joins on the item; keys are states or motif columns, a set of fixed size, so the pairs are states squared."""
    a = table.select(F.col(key).alias("a"), item, F.col(p).alias("p"))
    b = table.select(F.col(key).alias("b"), item, F.col(p).alias("q"))
    both = a.join(b, item).where("a < b")
    return both.groupBy("a", "b").agg((F.sum(bits("p", "q") + bits("q", "p")) / 2).alias("kl"))


def adjusted_rand(cells: DataFrame, i: str, j: str, n: str, by: list[str] | None = None) -> DataFrame:
    """ari of the contingency table cells (i, j, n), for each by; null if a margin leaves nothing to agree on."""
    by = by or []
    pairs = lambda c: F.sum((F.col(c) * (F.col(c) - 1)).cast("double"))
    s = cells.groupBy(*by).agg(pairs(n).alias("s"), F.sum(n).cast("double").alias("every"))
    margin = lambda k, out: cells.groupBy(*by, k).agg(F.sum(n).alias("m")).groupBy(*by).agg(pairs("m").alias(out))
    a, b = margin(i, "sa"), margin(j, "sb")
    join = lambda x, y: x.join(y, by) if by else x.join(y)  # noqa: E731  one row each without by
    all_ = join(join(s, a), b)
    expected = F.col("sa") * F.col("sb") / (F.col("every") * (F.col("every") - 1))
    half = (F.col("sa") + F.col("sb")) / 2
    return all_.select(*by, F.when(half != expected, (F.col("s") - expected) / (half - expected)).alias("ari"))


def contingency(a: DataFrame, b: DataFrame, key: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """x, y, n: how often the two labelings give x and y to the same position."""
    return a.join(b, key).groupBy(x, y).agg(F.count("*").alias("n"))


def competitive_weights(scores: DataFrame, by: str, score: str, models: int, temperature: Column | float) -> DataFrame:
    """weight = 1 + models x softmax(log posterior / temperature) of every model for every sequence."""
    w = Window.partitionBy(by)
    top = F.max(score).over(w)
    total = F.log(F.sum(F.exp(F.col(score) - F.col("_top"))).over(w)) + F.col("_top")
    rows = scores.withColumn("_top", top).withColumn("_lp", (F.col(score) - total) / temperature)
    rows = rows.withColumn("_m", F.max("_lp").over(w)).withColumn("_e", F.exp(F.col("_lp") - F.col("_m")))
    return rows.withColumn("weight", 1 + models * F.col("_e") / F.sum("_e").over(w)).drop("_top", "_lp", "_m", "_e")


def temperature(iteration: int) -> float:
    """Falls with the outer iteration, from 0."""
    import math

    return 2 / math.log10(iteration + 2)


def rank_auc(scored: DataFrame, score: str, positive: Column, by: list[str] | None = None) -> DataFrame:
    """Area under the ROC curve by average ranks; ties share their rank.

    Distinct scores are counted first; the ranks come from a running sum over ranges of them."""
    by = by or []
    n = scored.groupBy(*by, score).agg(F.count_if(positive).cast("double").alias("p"), F.count_if(~positive).cast("double").alias("q"))
    run = running(n, "q", [score], by)
    return run.groupBy(*by).agg((F.sum(F.col("p") * (F.col("below") + F.col("q") / 2)) / (F.sum("p") * F.sum("q"))).alias("auc"))
