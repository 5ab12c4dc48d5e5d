"""A packed store: all sequences one after the other in chunks of a fixed size, with an offset array, read by ranges.

A sequence has the bytes start .. start + len - 1 of the whole, in order of seq_id; a chunk holds the bytes of its number
times its size onward, so a sequence may span chunks and a chunk may hold many.  Offsets are running sums over ranges; a
task holds one chunk.  Chunks lie in folders of `bucket` chunks, so that a read opens only the folders it needs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlab.operators.orders import running
from strandlab.session import written

#: Bytes of a chunk, chunks of a folder.
CHUNK, BUCKET = 1 << 16, 64


@dataclass
class Store:
    """offsets: seq_id, start, len; chunks: chunk, size, data, bucket."""

    offsets: DataFrame
    chunks: DataFrame
    chunk: int
    bucket: int


def write_packed(seqs: DataFrame, path: str, chunk: int = CHUNK, bucket: int = BUCKET) -> None:
    """seqs: seq_id (no two alike), seq (text, packed as UTF-8; or bytes)."""
    rows = written(seqs.select("seq_id", F.coalesce(F.col("seq").cast("binary"), F.lit(b"")).alias("data")), "packing")
    sizes = rows.select("seq_id", F.octet_length("data").cast("long").alias("len"))
    offsets = written(running(sizes, "len", ["seq_id"], name="start").select("seq_id", "start", "len"), "offsets")
    offsets.write.mode("overwrite").parquet(f"{path}/offsets")
    some = rows.join(offsets.where("len > 0"), "seq_id")
    touched = F.sequence(F.floor(F.col("start") / chunk), F.floor((F.col("start") + F.col("len") - 1) / chunk))
    cut = F.transform(touched, lambda c: _piece(c.cast("long"), chunk))
    pieces = some.select(F.explode(cut).alias("p")).select("p.*")
    whole = pieces.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("at", "data"))).alias("p"))  # a chunk's bytes
    data = F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["data"]))
    chunks = whole.select("chunk", data.alias("data"), F.floor(F.col("chunk") / bucket).cast("long").alias("bucket")).withColumn("size", F.octet_length("data"))
    chunks.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/chunks")
    seqs.sparkSession.createDataFrame([(chunk, bucket)], "chunk int, bucket int").coalesce(1).write.mode("overwrite").parquet(f"{path}/shape")


def _piece(c, chunk: int):
    """The part of a sequence that lies in chunk c: its place there and its bytes."""
    low = F.greatest(F.col("start"), c * chunk)
    high = F.least(F.col("start") + F.col("len"), (c + 1) * chunk)
    data = F.substring(F.col("data"), (low - F.col("start") + 1).cast("int"), (high - low).cast("int"))
    return F.struct(c.alias("chunk"), (low - c * chunk).alias("at"), data.alias("data"))


def read_packed(spark: SparkSession, path: str) -> Store:
    shape = spark.read.parquet(f"{path}/shape").first()
    kinds = "chunk long, data binary, size int, bucket long"
    return Store(spark.read.parquet(f"{path}/offsets"), spark.read.schema(kinds).parquet(f"{path}/chunks"), shape["chunk"], shape["bucket"])


def ranges(store: Store, wanted: DataFrame) -> DataFrame:
    """wanted with data: the bytes first .. first + size - 1 of the whole; wanted: id (no two alike), first, size."""
    last = F.col("first") + F.col("size") - 1
    at = wanted.where("size > 0").select("id", "first", "size", F.explode(F.sequence(F.floor(F.col("first") / store.chunk), F.floor(last / store.chunk))).alias("chunk"))
    at = at.withColumn("chunk", F.col("chunk").cast("long")).withColumn("bucket", F.floor(F.col("chunk") / store.bucket).cast("long"))
    low = F.greatest(F.col("first") - F.col("chunk") * store.chunk, F.lit(0))
    high = F.least(last + 1 - F.col("chunk") * store.chunk, F.lit(store.chunk))
    read = at.join(store.chunks.select("bucket", "chunk", "data"), ["bucket", "chunk"])
    pieces = read.select("id", "chunk", F.substring(F.col("data"), (low + 1).cast("int"), (high - low).cast("int")).alias("data"))
    whole = pieces.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("chunk", "data"))).alias("p"))
    joined = whole.select("id", F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["data"])).alias("data"))
    return wanted.join(joined, "id", "left").withColumn("data", F.coalesce("data", F.lit(b"")))


def slices(store: Store, wanted: DataFrame) -> DataFrame:
    """seq_id, start, len, data of parts of sequences (seq_id, start from 0, len), as far as the sequences go."""
    own = store.offsets.select("seq_id", F.col("start").alias("begin"), F.col("len").alias("whole"))
    asked = wanted.select("seq_id", "start", "len").distinct().join(own, "seq_id")
    size = F.greatest(F.least(F.col("start") + F.col("len"), F.col("whole")) - F.col("start"), F.lit(0))
    # a request is its own key
    keyed = asked.select(F.struct("seq_id", "start", "len").alias("id"), (F.col("begin") + F.col("start")).alias("first"), size.alias("size"))
    return ranges(store, keyed).select("id.*", "data")


def scan(store: Store) -> DataFrame:
    """seq_id, data of every sequence, put together from the chunks."""
    every = store.offsets.select(F.col("seq_id").alias("id"), F.col("start").alias("first"), F.col("len").alias("size"))
    return ranges(store, every).select(F.col("id").alias("seq_id"), "data")


def summary(store: Store) -> DataFrame:
    """n, residues, longest, chunks from the offsets alone."""
    total = F.coalesce(F.sum("len"), F.lit(0))
    return store.offsets.agg(F.count("*").alias("n"), total.alias("residues"), F.max("len").alias("longest"), F.ceil(total / store.chunk).cast("long").alias("chunks"))
