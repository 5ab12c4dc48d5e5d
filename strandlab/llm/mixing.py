"""Mixing sources to target weights by systematic sampling.

Target words of a source: its weight's share of the wanted total, at most LIMIT times its own size; what a full source
can't take is shared again among the others by weight until none is above.  Each document's expected copies are target /
size of its source.  Within a source the documents are put in one fixed order (size, then a hash of doc_id), the
expected copies are summed along it, one random offset is added, and a document is emitted once for each integer that
its step crosses.  Ordering by size makes every stretch of the order, and so the taken words, follow the target.

Scale: only doc_id, source and size are shuffled, by ranges of (source, size, hash), so that a hot source spreads over as
many tasks as its rows need.  The order doesn't depend on where ranges are cut: counts per (range, source) give each
range its start.  Sources may be many (hosts): they are ranked over ranges and their targets come from a few sums over
the table of sources, two numbers a step on the driver; that table is broadcast only where Spark finds it small.

Defined results: a null text has size 0; a null source is a source of its own, last in the order of code points; sources
without words get target 0; size 0 rows can be taken and add nothing; repeated rows are sampled one by one; documents of
the same id and size are equal in the order; an empty table gives an empty result.  mix_documents keeps all columns of
each row: only rows equal in every column are taken together.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlab.llm.common import WORD, bounded_batches, parts_of, row_hash, staged, starts, table, text_of

WEIGHTS = (5, 2, 1)
TOTAL = 1.5
LIMIT = 2.0
SEED = 20


def n_words() -> Column:
    return F.regexp_count(text_of(), F.lit(WORD)).cast("long")


def source_targets(rows: DataFrame, weights=WEIGHTS, total: float = TOTAL, limit: float = LIMIT) -> DataFrame:
    """source, rank, source_size, target; one row a source.

    Target words a unit of weight (level) rise from step to step: sources that the level would lift above their limit
    are full and leave what they can't take to the others, until no further one is full."""
    gone = F.col("source").isNull()
    found = rows.groupBy("source").agg(F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("source_size"))
    ranged = found.repartitionByRange(parts_of(rows.sparkSession), gone, "source").withColumn("part", F.spark_partition_id())
    ranged = staged(ranged, "sources")
    place = F.row_number().over(Window.partitionBy("part").orderBy(gone, "source"))
    before = starts(ranged.groupBy("part").agg(F.count("*").alias("n")), "part", "n").drop("n")
    ranked = ranged.join(before, "part").withColumn("rank", (F.col("start") + place - 1).cast("long"))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = staged(ranked.select("source", "rank", "source_size", weight.alias("weight")), "ranked")
    most = F.col("source_size") * limit
    wanted = total * (ranked.agg(F.sum("source_size")).first()[0] or 0)
    level, last = 0.0, -1
    while True:
        full = F.lit(level) * F.col("weight") > most if last >= 0 else F.lit(False)
        n, taken, open_ = ranked.agg(F.count(F.when(full, 1)), F.sum(F.when(full, most)), F.sum(F.when(~full, F.col("weight")))).first()
        if n == last or not open_:
            break
        level, last = (wanted - (taken or 0.0)) / open_, n
    target = F.when(F.lit(level) * F.col("weight") > most, most).otherwise(F.lit(level) * F.col("weight"))
    return ranked.select("source", "rank", "source_size", target.alias("target"))


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the task's number and the row's place among its source's rows of this task (sorted by source)."""
    part, rank, at = TaskContext.get().partitionId(), None, 0
    for b in batches:
        place = []
        for r in b.column(b.schema.get_field_index("rank")).to_pylist():
            at = at + 1 if r == rank else 0
            rank = r
            place.append(at)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array([part] * len(place), pa.int32()), pa.array(place, pa.int64())], names=[*b.schema.names, "part", "place"])


def mix(docs: DataFrame, *, weights=WEIGHTS, total: float = TOTAL, limit: float = LIMIT, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target and copies of every row of docs (doc_id, source, text)."""
    bounded_batches(docs.sparkSession)
    rows = staged(docs.select("doc_id", F.col("source").cast("string").alias("source"), n_words().alias("size")), "sizes")
    goal = staged(source_targets(rows, weights, total, limit), "goal")
    keyed = rows.join(goal.select(F.col("source").alias("_source"), "rank"), F.col("source").eqNullSafe(F.col("_source"))).select("doc_id", "size", "rank", F.xxhash64(F.lit(seed), "doc_id").alias("h"))
    order, kind = ["rank", "size", "h", "doc_id"], rows.schema["doc_id"].dataType.simpleString()
    # written once: the ranges' cuts come from a sample and must not differ between the two reads below
    put = staged(keyed.repartitionByRange(parts_of(rows.sparkSession), *order).sortWithinPartitions(*order).mapInArrow(_numbered, f"doc_id {kind}, size long, rank long, h long, part int, place long"), "order")
    counts = put.groupBy("part", "rank").agg(F.count("*").alias("n"))
    before = Window.partitionBy("rank").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    placed = put.join(first, ["part", "rank"]).join(goal, "rank")
    offset = F.pmod(F.xxhash64(F.lit(seed), F.lit("offset"), "rank"), F.lit(1 << 30)) / float(1 << 30)
    step = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    i = F.col("start") + F.col("place")
    copies = (F.floor(offset + (i + 1) * step) - F.floor(offset + i * step)).cast("long")
    return placed.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), "rank", "h")


def mixture(spark, sf_dir: str) -> DataFrame:
    """op3: the words that the mix takes of every document."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs as often as the mix takes them, each with its own columns; rows equal in all columns are sampled
    one by one and emitted together."""
    key = F.struct(row_hash(docs).alias("a"), row_hash(docs, 1).alias("b"))
    # the mix sees the key as its doc_id
    taken = mix(docs.select(key.alias("doc_id"), "source", "text"), **options).where("copies > 0")
    taken = taken.groupBy(F.col("doc_id.a").alias("a"), F.col("doc_id.b").alias("b")).agg(F.sum("copies").cast("int").alias("copies"))
    once = docs.select(F.struct("*").alias("row"), row_hash(docs).alias("a"), row_hash(docs, 1).alias("b")).dropDuplicates(["a", "b"])
    return once.join(taken.hint("merge"), ["a", "b"]).select("row", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")
