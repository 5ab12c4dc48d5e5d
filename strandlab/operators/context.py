"""Length calibration of context-model scores: lines by length, bins, z-scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlab.operators.orders import running
from strandlab.session import written

#: Defaults of the growth rule.
P_MIN, GAMMA = 1e-5, 0.01


def background(counts: DataFrame) -> DataFrame:
    """residue, bg from counts (k, kmer, n)."""
    one = counts.where("k = 1")
    every = one.agg(F.sum("n").alias("every"))
    return one.join(F.broadcast(every)).select(F.col("kmer").alias("residue"), (F.col("n") / F.col("every")).alias("bg"))


def fit_line(scores: DataFrame, by: list[str]) -> DataFrame:
    """by, a, b, v, n: score = a + b len with the residuals' sample deviation, from sums alone."""
    x, y = F.col("len").cast("double"), F.col("score")
    s = scores.groupBy(*by).agg(F.regr_slope(y, x).alias("b"), F.regr_intercept(y, x).alias("a"), F.count("*").alias("n"), F.regr_syy(y, x).alias("syy"), F.regr_sxy(y, x).alias("sxy"))
    left = F.greatest(F.col("syy") - F.coalesce("b", F.lit(0.0)) * F.col("sxy"), F.lit(0.0))
    return s.select(*by, F.coalesce("a", F.lit(0.0)).alias("a"), F.coalesce("b", F.lit(0.0)).alias("b"), F.sqrt(left / F.greatest(F.col("n") - 1, F.lit(1))).alias("v"), "n")


def band(width: int = 512, most: int = 16):
    """Length bands of a fixed width; the last one is open."""
    return F.least((F.col("len") / width).cast("int"), F.lit(most - 1))


def calibrate(scores: DataFrame, threshold: float, rounds: int, by: str = "band") -> DataFrame:
    """by, a, b, v, n after dropping rows with |z| >= threshold and fitting again, a fixed number of times."""
    fit = fit_line(scores, [by])
    for _ in range(rounds):
        z = (F.col("score") - (F.col("a") + F.col("b") * F.col("len"))) / F.when(F.col("v") > 0, F.col("v"))
        kept = scores.join(F.broadcast(fit), by).where(F.coalesce(F.abs(z) < threshold, F.lit(True)))  # without a spread nothing stands out
        fit = fit_line(kept.select(*scores.columns), [by])
    return fit


def z_scores(scores: DataFrame, fit: DataFrame, by: str = "band") -> DataFrame:
    """scores with z; the fits are one row a band, a fixed number."""
    z = (F.col("score") - (F.col("a") + F.col("b") * F.col("len"))) / F.col("v")
    return scores.join(F.broadcast(fit.select(by, "a", "b", "v")), by).withColumn("z", F.when(F.col("v") > 0, z).otherwise(0.0))


def greedy_bins(lengths: DataFrame, min_items: int = 500, min_width: int = 2) -> DataFrame:
    """bin, len_min, len_max, n: bins along the sorted lengths, closed at a change of length once they hold more than
    min_items and span min_width; a short last one joins the bin before it.

    Where a bin that begins at a length would end is a question to running counts, answered for every length at once; the
    lengths that do begin one are those that chains of such steps reach from the first, found by doubling the steps."""
    histogram = lengths.groupBy(F.col("len").cast("long").alias("len")).agg(F.count("*").alias("n"))
    rows = written(running(running(histogram, "n", ["len"], name="below"), F.lit(1), ["len"], name="i"), "histogram")

    def first_above(value: Column, limit: Column) -> DataFrame:
        """i, at: the number of rows whose value is at most the limit of row i."""
        both = rows.select(value.alias("v"), F.lit(0).alias("kind"), F.lit(-1).cast("long").alias("i")).unionByName(rows.select(limit.alias("v"), F.lit(1).alias("kind"), "i"))
        return running(both, F.when(F.col("kind") == 0, 1).otherwise(0), ["v", "kind", "i"], name="at").where("kind = 1").select("i", "at")

    full = first_above(F.col("below") + F.col("n"), F.col("below") + min_items)
    wide = first_above(F.col("len"), F.col("len") + (min_width - 1))
    step = written(full.join(wide.withColumnRenamed("at", "wide"), "i").select("i", (F.greatest("at", "wide") + 1).alias("to")), "step")
    begin = rows.where("i = 0").select("i")
    n = begin.count()
    while n:
        more = begin.join(step, "i").select(F.col("to").alias("i")).join(rows.select("i"), "i", "left_semi")
        begin = written(begin.unionByName(more).distinct(), "begin")
        last, n = n, begin.count()
        if n == last:
            break
        on = step.select(F.col("i").alias("to"), F.col("to").alias("then"))
        step = written(step.join(on, "to").select("i", F.col("then").alias("to")), "step")
    marked = rows.join(begin.withColumn("first", F.lit(1)), "i", "left").withColumn("first", F.coalesce("first", F.lit(0)))
    number = running(marked, "first", ["len"], name="before").withColumn("bin", (F.col("before") + F.col("first") - 1).cast("int"))
    bins = written(number.groupBy("bin").agg(F.min("len").alias("len_min"), F.max("len").alias("len_max"), F.sum("n").alias("n")), "bins")
    end = bins.agg(F.max(F.struct("bin", "n")).alias("e")).select(F.when(F.col("e.n") <= min_items, F.greatest(F.col("e.bin") - 1, F.lit(0))).otherwise(F.col("e.bin")).alias("most"))
    joined = bins.join(F.broadcast(end))  # one row
    return joined.groupBy(F.least("bin", "most").alias("bin")).agg(F.min("len_min").alias("len_min"), F.max("len_max").alias("len_max"), F.sum("n").alias("n"))
