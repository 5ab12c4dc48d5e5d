"""Search and sessions as Structured Streaming jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlab.functions import sequences as S
from strandlab.operators.suffixtree import Tree, search
from strandlab.session import folder


def stream_of(spark, path: str, schema, files_per_batch: int = 8) -> DataFrame:
    """A stream of a Parquet table: a folder of files, or one file."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    single = p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isFile()  # noqa: SLF001
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if single:
        return reader.option("pathGlobFilter", p.getName()).parquet(str(p.getParent().toString()))
    return reader.parquet(path)


def run_to_table(stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there into a Parquet table in the shared folder, with its checkpoint beside it."""
    spark = stream.sparkSession
    root = folder(spark, label)
    q = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


def search_stream(docs: DataFrame, tree: Tree, fit: DataFrame, threshold: float) -> DataFrame:
    """seq_id, len, z, scanned of the documents of the stream that pass; scanned: the records seen up to the end of the
    hit's batch, the database size that its E-value is for.

    Model and fits are static; every micro-batch is scored as a batch and written under its batch id with its number of
    records, so a batch that is repeated after a failure replaces itself.  The running count is a sum over one row a
    batch.  The table holds the hits of all batches at the end."""
    spark = docs.sparkSession
    root = folder(spark, "hits")

    def one(batch: DataFrame, batch_id: int) -> None:
        seqs = batch.select(F.col("doc_id").alias("seq_id"), S.letters_of("text").alias("seq"))
        search(seqs, tree, fit, threshold).select("seq_id", "len", "z").write.mode("overwrite").parquet(f"{root}/out/batch={batch_id}")
        batch.agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{root}/seen/batch={batch_id}")

    # a stream without a batch has tables, too
    spark.createDataFrame([], "seq_id long, len int, z double").write.parquet(f"{root}/out/batch=-1")
    spark.createDataFrame([], "n long").write.parquet(f"{root}/seen/batch=-1")
    q = docs.writeStream.foreachBatch(one).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    seen = spark.read.schema("n long, batch long").parquet(f"{root}/seen")
    running = seen.select("batch", F.sum("n").over(Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, 0)).alias("scanned"))
    return spark.read.schema("seq_id long, len int, z double, batch long").parquet(f"{root}/out").join(running, "batch").drop("batch")


class Stopped(Exception):
    """Raised by a job that was told to stop in the middle."""


class StatefulJob:
    """A streaming aggregation whose results are written batch by batch into a folder of their own number, so that a batch
    that is repeated after a failure replaces itself; state and progress are in the checkpoint beside it.

    make: stream -> aggregated stream; mode: "update" (changed rows) or "append" (rows that the watermark has closed)."""

    def __init__(self, make, mode: str, root: str):
        self.make, self.mode, self.root = make, mode, root

    def run(self, stream: DataFrame, stop_in: int | None = None) -> int:
        """Process all that is there, and return the last batch's number.  stop_in: fail in that batch, after its rows are
        written and before its progress is."""
        spark, root, last = stream.sparkSession, self.root, [-1]

        def one(batch: DataFrame, batch_id: int) -> None:
            batch.write.mode("overwrite").parquet(f"{root}/out/batch={batch_id}")
            last[0] = batch_id
            if batch_id == stop_in:
                raise Stopped(f"stopped in batch {batch_id}")

        rows = self.make(stream)
        spark.createDataFrame([], rows.schema).write.mode("overwrite").parquet(f"{root}/out/batch=-1")
        q = rows.writeStream.outputMode(self.mode).foreachBatch(one).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
        try:
            q.awaitTermination()
        except Exception:
            if stop_in is None or last[0] != stop_in:
                raise
        return last[0]

    def written(self, spark, schema) -> DataFrame:
        """All rows of all batches, with batch."""
        return spark.read.schema(schema.add("batch", "long")).parquet(f"{self.root}/out")


def running_counts(rows: DataFrame, key: str) -> DataFrame:
    """key, n: on a stream, the counts so far of the keys that a batch changes."""
    return rows.groupBy(key).agg(F.count("*").alias("n"))


def latest(rows: DataFrame, key: str) -> DataFrame:
    """Each key's row of the last batch that has one."""
    rest = [c for c in rows.columns if c not in (key, "batch")]
    return rows.groupBy(key).agg(*(F.max_by(c, "batch").alias(c) for c in rest))


def arrivals(events: DataFrame, path: str, files: int = 8, delay: int = 3600) -> None:
    """Writes events as so many files in order of arrival: up to `delay` seconds after ts, by a hash, so that they come
    out of order; the last two hold a far later time without a user, which closes what is open."""
    came = F.unix_micros(F.col("ts").cast("timestamp")) + F.pmod(F.xxhash64("event_id"), F.lit(delay * 1_000_000))
    order = events.withColumn("_came", came)
    low, high = order.agg(F.min("_came"), F.max("_came")).first()
    part = F.least(F.floor((F.col("_came") - F.lit(low or 0)) * files / max(1, (high or 0) - (low or 0))), F.lit(files - 1)).cast("int")
    cut = order.withColumn("_file", part).drop("_came")
    for k in range(files):  # one after the other: a file stream goes by times of writing
        cut.where(F.col("_file") == k).drop("_file").coalesce(1).write.mode("append").parquet(path)
    last = events.agg(F.max("ts").alias("ts"))
    for days in (400, 800):
        end = last.withColumn("ts", F.coalesce("ts", F.lit("1970-01-01").cast(events.schema["ts"].dataType)) + F.expr(f"INTERVAL {days} DAYS"))
        end.select(*(F.col("ts") if c == "ts" else F.lit(None).cast(events.schema[c].dataType).alias(c) for c in events.columns)).coalesce(1).write.mode("append").parquet(path)


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """user_id, start, n, value of every session; on a stream, sessions close when the watermark passes them."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events
    g = rows.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("value"))
    return g.select("user_id", F.col("w.start").alias("start"), "n", "value")
