"""The corpus pipeline: quality rules, line dedup, near duplicates, mixing, packing.

Every stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and returns a DataFrame that is
written as Parquet and reread as the next one's docs.  All but the last return the columns of documents, and further
columns of docs, whatever their names, come along unchanged.

Defined results: null texts fail the quality rules as empty ones do; line_dedup leaves null texts, empty ones and rows
without a doc_id as they are; near_duplicates takes null and empty texts as equal, keeps one row of repeated ones and all
rows without a doc_id; mix_sources samples repeated rows one by one and a null source as a source of its own; pack gives
every row a sequence, null texts as the separator alone; an empty table gives empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlab.llm.common import discard, row_hash, staged, table, text_of
from strandlab.llm.linededup import dedup_rows
from strandlab.llm.mixing import mix_documents
from strandlab.llm.neardup import jaccard_classes
from strandlab.llm.packing import pack_documents
from strandlab.llm.rules import apply_rules, train_rules

#: Not expressible in SQL (trained model, MinHash, best-fit packing); tested against brute force.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the counted rules or the trained model reject go."""
    probability = train_rules(docs, table(spark, sf_dir, "labels"))
    return apply_rules(docs, probability).where("kept").select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks of lines that an earlier document has go, and documents of which nothing is left."""
    out = dedup_rows(docs).where(r"n_removed = 0 OR text RLIKE '[^\\x20\\x09-\\x0D]'")
    chars = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)
    new = {"text": F.col("text"), "n_chars": chars}
    return out.select(*(new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class stays: of its first document by doc_id and text, and of repeated rows of that the first by
    its other columns' hash.  Texts are told apart by (doc_id, text), so a doc_id with several texts loses none."""
    heads = jaccard_classes(docs).where("keeper").select(F.col("doc_id").alias("d"), F.col("text_hash").alias("t")).distinct()
    rows = docs.where("doc_id IS NOT NULL").select(F.struct("*").alias("row"), row_hash(docs).alias("h"), F.col("doc_id").cast("long").alias("d"), F.xxhash64(text_of()).alias("t"))
    kept = rows.join(heads.hint("merge"), ["d", "t"], "left_semi").groupBy("d", "t").agg(F.min_by("row", "h").alias("row"))
    return kept.select("row.*").unionByName(docs.where("doc_id IS NULL"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mix_documents(docs).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequences and places there."""
    return pack_documents(docs)


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("mix_sources", mix_sources), ("pack", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        out = staged(stage(spark, docs, sf_dir), name)
        discard(docs)
        docs = out
    return STAGES[-1][1](spark, docs, sf_dir)
