"""Streams that keep state and are stopped, and the packed store, against plain versions."""

import random

import pytest

from strandlab.sources import packed
from strandlab.streaming import search as T


def events(spark, rows):
    return spark.createDataFrame(rows, "event_id long, user_id long, event_type string, ts timestamp, value double")


def some(n, seed=1):
    import datetime as D

    r = random.Random(seed)
    return [(i, r.randrange(5), r.choice("abc"), D.datetime(2024, 1, 1) + D.timedelta(seconds=r.randrange(200_000)), float(r.randrange(9))) for i in range(n)]


def test_counts_are_right_after_every_batch_and_a_stop(spark, tmp_path):
    e = events(spark, some(300))
    T.arrivals(e, f"file://{tmp_path}/in", files=5)
    make = lambda s: T.running_counts(s.where("event_id IS NOT NULL"), "event_type")
    job = T.StatefulJob(make, "update", f"file://{tmp_path}/job")
    stream = lambda: T.stream_of(spark, f"file://{tmp_path}/in", e.schema, files_per_batch=1)
    assert job.run(stream(), stop_in=2) == 2
    before = {p.name for p in (tmp_path / "job/out").iterdir()}
    assert before == {f"batch={k}" for k in (-1, 0, 1, 2)}
    assert job.run(stream()) >= 4
    rows = job.written(spark, make(e).schema)
    total: dict = {}
    seen = {}
    for r in sorted(rows.collect(), key=lambda r: r["batch"]):
        assert r["n"] > seen.get(r["event_type"], 0)  # running counts rise, also over the restart
        seen[r["event_type"]] = r["n"]
    for x in e.collect():
        total[x["event_type"]] = total.get(x["event_type"], 0) + 1
    assert seen == total == {r["event_type"]: r["n"] for r in T.latest(rows, "event_type").collect()}
    assert job.run(stream()) == -1  # nothing new


def test_sessions_close_once(spark, tmp_path):
    e = events(spark, some(400, 2))
    T.arrivals(e, f"file://{tmp_path}/in", files=6, delay=7200)
    job = T.StatefulJob(lambda s: T.sessions(s, late="3 hours"), "append", f"file://{tmp_path}/job")
    stream = lambda: T.stream_of(spark, f"file://{tmp_path}/in", e.schema, files_per_batch=1)
    job.run(stream(), stop_in=3)
    job.run(stream())
    got = sorted((r["user_id"], r["start"], r["n"], r["value"]) for r in job.written(spark, T.sessions(e).schema).where("user_id IS NOT NULL").collect())
    want = sorted((r["user_id"], r["start"], r["n"], r["value"]) for r in T.sessions(e).collect())
    assert got == want and len(got) > 100


def test_search_of_a_stream_without_files(spark, tmp_path):
    from strandlab.operators import context as P
    from strandlab.operators import suffixtree as C

    docs = spark.createDataFrame([(i, "abcabcabd" * (3 + i)) for i in range(9)], "doc_id long, text string")
    seqs = docs.selectExpr("doc_id AS seq_id", "text AS seq")
    tree = C.grow(seqs, depth=2)
    fit = P.calibrate(C.score(seqs, tree).withColumn("band", P.band()), 3.5, 1)
    (tmp_path / "empty").mkdir()
    got = T.search_stream(T.stream_of(spark, f"file://{tmp_path}/empty", docs.schema), tree, fit, -9.0)
    assert got.collect() == [] and got.columns == ["seq_id", "len", "z", "scanned"]
    docs.coalesce(1).write.parquet(f"file://{tmp_path}/some")
    assert {r["scanned"] for r in T.search_stream(T.stream_of(spark, f"file://{tmp_path}/some", docs.schema), tree, fit, -9.0).collect()} == {9}


@pytest.mark.parametrize(("chunk", "bucket"), [(1, 3), (7, 2), (64, 1), (1 << 16, 64)])
def test_packed_store_gives_back_ranges(spark, tmp_path, chunk, bucket):
    r = random.Random(chunk)
    seqs = {i * 3: "".join(r.choices("acgté", k=r.choice([0, 1, 5, 30, 90 if chunk > 1 else 3]))) for i in range(25)} | {-4: "zz", 999: None}
    path = f"file://{tmp_path}/p"
    packed.write_packed(spark.createDataFrame(list(seqs.items()), "seq_id long, seq string").repartition(3), path, chunk, bucket)
    store = packed.read_packed(spark, path)
    data = {i: (s or "").encode() for i, s in seqs.items()}
    whole = b"".join(data[i] for i in sorted(data))
    chunks = {x["chunk"]: bytes(x["data"]) for x in store.chunks.collect()}
    assert b"".join(chunks[k] for k in sorted(chunks)) == whole and all(len(chunks[k]) == chunk for k in sorted(chunks)[:-1])
    assert {x["seq_id"]: bytes(x["data"]) for x in packed.scan(store).collect()} == data
    wanted = [(i, r.randrange(40), r.randrange(60)) for i in data for _ in range(3)] + [(12345, 0, 5)]
    got = {(x["seq_id"], x["start"], x["len"]): bytes(x["data"]) for x in packed.slices(store, spark.createDataFrame(wanted, "seq_id long, start long, len long")).collect()}
    assert got == {(i, a, n): data[i][a : a + n] for i, a, n in wanted if i in data}
    total = packed.summary(store).first()
    assert tuple(total) == (len(data), len(whole), max(map(len, data.values())), -(-len(whole) // chunk))


def test_packed_store_of_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/p"
    packed.write_packed(spark.createDataFrame([], "seq_id long, seq string"), path)
    store = packed.read_packed(spark, path)
    assert packed.scan(store).collect() == [] and packed.summary(store).first()["n"] == 0
