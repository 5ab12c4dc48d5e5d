"""Counts of k-mers, residues, transitions and emissions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlab.functions import sequences as S

#: Digits of base 32, as conv() reads them.
DIGITS = "0123456789abcdefghijklmnopqrstuv"
#: State numbers of the virtual start and end of every sequence.
START, END = 0, 1


def kmer_counts(seqs: DataFrame, k: int) -> DataFrame:
    """kmer, n over all sequences; partial sums are taken before the shuffle."""
    return seqs.select(F.explode(S.kmers("seq", k)).alias("kmer")).groupBy("kmer").agg(F.count("*").alias("n"))


def all_kmer_counts(seqs: DataFrame, most: int) -> DataFrame:
    """k, kmer, n for all lengths 1 .. most, in one pass over the sequences."""
    each = F.flatten(F.array(*(S.kmers("seq", k) for k in range(1, most + 1))))
    rows = seqs.select(F.explode(each).alias("kmer"))
    return rows.groupBy("kmer").agg(F.count("*").alias("n")).select(F.length("kmer").alias("k"), "kmer", "n")


def packed_counts(seqs: DataFrame, most: int = 12, alphabet: str = S.LETTERS) -> DataFrame:
    """k, code, n of the words of all lengths 1 .. most (at most 12) over the alphabet (at most 32 letters); a code has
    five bits a letter.

    One pass inside code generation: each place gives its longest word, of `most` letters or up to the sequence's end;
    these are counted, and every shorter word is the sum of the longer ones that begin with it."""
    if not 1 <= most <= 12 or len(alphabet) > len(DIGITS):
        raise ValueError("at most 12 letters of an alphabet of at most 32 fit in a code")
    digits = F.translate("seq", alphabet, DIGITS[: len(alphabet)])
    each = seqs.select(F.explode(F.regexp_extract_all(digits, F.lit(f"(?=(.{{1,{most}}}))"), F.lit(1))).alias("word"))
    longest = each.groupBy("word").agg(F.count("*").alias("n")).select(F.length("word").alias("m"), F.conv("word", 32, 10).cast("long").alias("code"), "n")
    shorter = longest.select("m", "code", "n", F.explode(F.sequence(F.lit(1), "m")).alias("k"))
    cut = shorter.select("k", F.expr("shiftright(code, 5 * (m - k))").alias("code"), "n")
    return cut.groupBy("k", "code").agg(F.sum("n").alias("n"))


def kmer_totals(seqs: DataFrame, most: int) -> DataFrame:
    """k, total (windows of that length) and least (2 / total), from lengths alone."""
    ks = F.explode(F.sequence(F.lit(1), F.lit(most))).alias("k")
    rows = seqs.select(F.length("seq").alias("len"), ks)
    total = F.sum(F.greatest(F.col("len") - F.col("k") + 1, F.lit(0)))
    return rows.groupBy("k").agg(total.alias("total")).withColumn("least", 2.0 / F.col("total"))


def residue_counts(seqs: DataFrame) -> DataFrame:
    return seqs.select(F.explode(S.chars("seq")).alias("residue")).groupBy("residue").agg(F.count("*").alias("n"))


def transitions(labels: DataFrame, by: list[str], order: list[Column | str], state: str = "state", weight: Column | None = None) -> DataFrame:
    """from_state, to_state, n: adjacent labels of each sequence, with START before the first and END after the last."""
    w = Window.partitionBy(*by).orderBy(*order)
    one = F.lit(1) if weight is None else weight
    rows = labels.select(F.coalesce(F.lag(state).over(w), F.lit(START)).alias("a"), F.col(state).alias("b"), F.lead(state).over(w).alias("c"), one.alias("w"))
    pairs = F.array(F.struct(F.col("a").alias("f"), F.col("b").alias("t")), F.when(F.col("c").isNull(), F.struct(F.col("b").alias("f"), F.lit(END).alias("t"))))
    each = rows.select(F.explode(F.array_compact(pairs)).alias("p"), "w")
    return each.groupBy(F.col("p.f").alias("from_state"), F.col("p.t").alias("to_state")).agg(F.sum("w").alias("n"))


def emissions(labels: DataFrame, state: str = "state", symbol: str = "symbol", weight: Column | None = None) -> DataFrame:
    one = F.lit(1) if weight is None else weight
    return labels.groupBy(state, symbol).agg(F.sum(one).alias("n"))


def dust(seqs: DataFrame) -> DataFrame:
    """seq_id, dust: sum of n (n - 1) / 2 over the sequence's triplets, divided by length - 3."""
    tri = seqs.where(F.length("seq") > 3).select("seq_id", F.length("seq").alias("len"), F.explode(S.kmers("seq", 3)).alias("t"))
    n = tri.groupBy("seq_id", "len", "t").agg(F.count("*").alias("n"))
    return n.groupBy("seq_id", "len").agg((F.sum(F.col("n") * (F.col("n") - 1)) / 2.0).alias("s")).select("seq_id", (F.col("s") / (F.col("len") - 3)).alias("dust"))
