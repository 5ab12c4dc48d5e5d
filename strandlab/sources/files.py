"""Files: FASTA, FASTQ, labelled FASTA, hit lists, numeric matrices.  All reading and writing goes through Spark, so any
file system that Spark knows will do."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlab.functions import sequences as S
from strandlab.session import for_python, written

#: Columns of a block of labelled FASTA; cap of the reader.
BLOCK = 70
CAP = 100_000


def read_fasta(spark, path: str, unalign: bool = True, cap: int | None = None, header: str = ">") -> DataFrame:
    """name, seq of every record; gaps are removed if any record has some.  header: what records begin with (">" or "@").

    Records are split by the reader itself, so a large file is read by many tasks.  cap: that many records, in order of
    name, which is what a fixed number of first records means without an order of files."""
    rows = spark.read.option("lineSep", "\n" + header).text(path)
    record = F.regexp_replace("value", "^" + header, "")
    parts = F.split(record, "\n", 2)
    seq = F.regexp_replace(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), r"\s", "")
    out = rows.where("trim(value) <> ''").select(F.trim(F.get(parts, F.lit(0))).alias("name"), seq.alias("seq"))
    if unalign:
        out = out.withColumn("seq", S.unaligned("seq"))
    return out.orderBy("name").limit(cap) if cap else out


def read_fastq(spark, path: str) -> DataFrame:
    """name, seq, qual; four lines a record, whatever lines begin with.

    A file's lines are read by byte ranges and numbered over them (one count a range gives each its start), so that a file
    of any size is read by many tasks; the four lines of a number meet by file and record."""
    at = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("range")]
    lines = written(spark.read.text(path).select(F.regexp_replace("value", "\r$", "").alias("line"), *at, F.monotonically_increasing_id().alias("id")), "lines")
    ranges = lines.groupBy("file", "range").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("file").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.select("file", "range", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    number = F.col("id") - F.col("first") + F.col("start")
    placed = lines.join(starts, ["file", "range"]).select("file", F.floor(number / 4).alias("record"), (number % 4).alias("k"), "line")
    line = lambda k: F.max(F.when(F.col("k") == k, F.col("line")))
    whole = placed.groupBy("file", "record").agg(line(0).alias("a"), line(1).alias("seq"), line(3).alias("qual")).where("qual IS NOT NULL")
    return whole.select(F.regexp_replace("a", "^@", "").alias("name"), "seq", "qual")


def write_fastq(df: DataFrame, path: str, name: str = "seq_id", seq: str = "seq", qual: str = "qual") -> None:
    """Four lines a record; an empty sequence has no record."""
    rows = df.where(F.length(seq) > 0)
    rows.select(F.concat_ws("\n", F.concat(F.lit("@"), F.col(name).cast("string")), seq, F.lit("+"), qual).alias("value")).write.text(path)


def fasta_line(name: Column | str, seq: Column | str, header: str = ">") -> Column:
    return F.concat(F.lit(header), S.col(name).cast("string"), F.lit("\n"), S.col(seq))


def write_fasta(df: DataFrame, path: str, name: str = "seq_id", seq: str = "seq", header: str = ">") -> None:
    df.select(fasta_line(name, seq, header).alias("value")).write.text(path)


def labelled_lines(name: str, seq: str, labels: list[int]) -> list[str]:
    """Blocks of 70 residues with each residue's label digits below it, the most significant first."""
    out = []
    for at in range(0, max(len(seq), 1), BLOCK):
        part, digits = seq[at : at + BLOCK], [str(x) for x in labels[at : at + BLOCK]]
        deep = max((len(x) for x in digits), default=1)
        out.append((">" if at == 0 else "^") + name)
        out.append(part)
        out += ["".join(x.rjust(deep)[i] for x in digits) for i in range(deep)]
    return out


def parse_labelled(lines: list[str]) -> list[tuple[str, str, list[int]]]:
    """(name, seq, labels) of every record of labelled lines."""
    out: list[tuple[str, str, list[int]]] = []
    at = 0
    while at < len(lines):
        head, seq, at = lines[at], lines[at + 1], at + 2
        rows = []
        while at < len(lines) and lines[at][:1] not in (">", "^"):
            rows.append(lines[at].ljust(len(seq)))
            at += 1
        labels = [int("".join(r[i] for r in rows)) for i in range(len(seq))]
        if head[0] == ">":
            out.append((head[1:], seq, labels))
        else:
            name, s, l = out[-1]
            out[-1] = (name, s + seq, l + labels)
    return out


def write_labelled(df: DataFrame, path: str) -> None:
    """name, seq, labels as labelled FASTA; a record is one value of several lines."""
    for_python(df.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"value": ["\n".join(labelled_lines(str(n), s, list(l))) for n, s, l in zip(pdf["name"], pdf["seq"], pdf["labels"], strict=True)]})

    df.select("name", "seq", "labels").mapInPandas(run, "value string").write.text(path)


def read_labelled(spark, path: str) -> DataFrame:
    for_python(spark)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [r for v in pdf["value"] for r in parse_labelled((">" + v.removeprefix(">")).rstrip("\n").split("\n"))]
            yield pd.DataFrame(rows, columns=["name", "seq", "labels"])

    return spark.read.option("lineSep", "\n>").text(path).mapInPandas(run, "name string, seq string, labels array<int>")


def write_hits(df: DataFrame, path: str) -> None:
    """Hits as CSV with a header; the name ends at its first blank."""
    df.withColumn("Name", F.substring_index(F.col("name").cast("string"), " ", 1)).select("Name", "score", "score_bias", "p_score", "p_score_bias", "e", "e_bias").write.csv(path, header=True)


def write_table(df: DataFrame, path: str) -> None:
    """A table of numbers as CSV with a header."""
    df.write.csv(path, header=True)


def read_matrix(spark, path: str, sep: str = "\t", header: bool = True) -> DataFrame:
    """A delimited numeric matrix, one row a line."""
    return spark.read.csv(path, sep=sep, header=header, inferSchema=True)


def long_matrix(df: DataFrame, key: str) -> DataFrame:
    """row, column, value of a wide matrix."""
    return df.unpivot(key, [c for c in df.columns if c != key], "column", "value").withColumnRenamed(key, "row")


def transposed(df: DataFrame, key: str, rows: list) -> DataFrame:
    """The transpose of a wide matrix whose row names are given."""
    return long_matrix(df, key).groupBy("column").pivot("row", rows).agg(F.first("value"))
