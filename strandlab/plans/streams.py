"""Queries that run as streams, and their batch forms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlab.functions.mathematics import exponential_survival
from strandlab.operators import context as P
from strandlab.operators import suffixtree as C
from strandlab.plans import context as Q
from strandlab.plans.registry import query
from strandlab.plans.sequences import seqs
from strandlab.session import folder, table, written
from strandlab.streaming import search as T

_GAPS = "e AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM e)"


@query("event_sessions", f"WITH {_GAPS} SELECT user_id, epoch_us(min(ts)) AS start_us, CAST(count(*) AS BIGINT) AS n, round(sum(value), 2) AS value FROM s GROUP BY user_id, k")
def event_sessions(spark, d):
    """Users' events cut into sessions at gaps of 30 minutes."""
    return T.sessions(table(spark, d, "events")).select("user_id", F.unix_micros(F.col("start").cast("timestamp")).alias("start_us"), "n", "value")


def interrupted(spark, d: str, make, mode: str, until: int) -> DataFrame:
    """All rows that a streaming aggregation of the events writes, stopped in the given batch and started again from its
    checkpoint; the events come in files of their time of arrival, one a batch."""
    events = table(spark, d, "events")
    path = folder(spark, "arrivals")
    T.arrivals(events, path)
    job = T.StatefulJob(make, mode, folder(spark, "job"))
    stream = T.stream_of(spark, path, events.schema, files_per_batch=1)
    job.run(stream, stop_in=until)
    job.run(stream)
    return job.written(spark, make(events).schema)


@query("stream_event_counts", "SELECT event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY event_type")
def stream_event_counts(spark, d):
    """Running counts per event type in the state store: micro-batches write the counts that they change, and each type's
    last one counts; stopped in the fourth batch and started again."""
    rows = interrupted(spark, d, lambda e: T.running_counts(e.where("event_id IS NOT NULL"), "event_type"), "update", 3)
    return T.latest(rows, "event_type")


@query("stream_sessions", f"WITH {_GAPS} SELECT user_id, epoch_us(min(ts)) AS start_us, CAST(count(*) AS BIGINT) AS n, round(sum(value), 2) AS value FROM s GROUP BY user_id, k")
def stream_sessions(spark, d):
    """Sessions of events that come out of order, written when the watermark has passed them; stopped in the sixth batch
    and started again."""
    rows = interrupted(spark, d, lambda e: T.sessions(e, late="2 hours"), "append", 5).where("user_id IS NOT NULL")
    return rows.select("user_id", F.unix_micros(F.col("start").cast("timestamp")).alias("start_us"), "n", "value")


@query("stream_search", f"WITH {Q._Z} SELECT seq_id, len, round(z, 4) AS z, (SELECT count(*) FROM documents) AS scanned, round(exp(-0.9 * (z - 1.5)) * (SELECT count(*) FROM documents), 5) AS e FROM z WHERE z >= 3.0")
def stream_search(spark, d):
    """The context-model search as a stream over the documents: model and fits are static, rows are scored as they come;
    E-values are for the records scanned so far."""
    rows = seqs(spark, d)
    tree = Q.tree(rows)
    scored = written(C.score(rows, tree).withColumn("band", P.band()), "scores")
    fit = written(P.calibrate(scored, Q.OUTLIER, Q.ROUNDS), "fit")
    path = f"{d}/documents.parquet"
    stream = T.stream_of(spark, path, spark.read.parquet(path).schema)
    hits = T.search_stream(stream, tree, fit, 3.0)
    return hits.select("seq_id", "len", F.round("z", 4).alias("z"), "scanned", F.round(exponential_survival("z", 1.5, 0.9) * F.col("scanned"), 5).alias("e"))
