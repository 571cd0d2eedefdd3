"""Streams: keyed TTL state over several batches and a restart, upserts into hash buckets."""

import os
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from corpusloom.streaming import jobs as streams

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def drain(spark, src, out, checkpoint, **kw):
    s = spark.readStream.schema("key string, request_id long, ts timestamp").option("maxFilesPerTrigger", 1).json(str(src))
    q = streams.requests_in_ttl(s, **kw).writeStream.format("json").option("path", str(out)).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    q.awaitTermination()
    return {r.request_id: (r.key, r.kind, r.answered_by, r.late) for r in spark.read.schema("key string, request_id long, kind string, answered_by long, late long").json(str(out)).collect()}


def put(spark, src, n, rows):
    data = [(k, i, START + timedelta(minutes=m)) for k, i, m in rows]
    spark.createDataFrame(data, "key string, request_id long, ts timestamp").coalesce(1).write.mode("append").json(str(src))


def test_ttl_over_batches_and_a_restart(spark, tmp_path):
    src, out, cp = tmp_path / "in", tmp_path / "out", tmp_path / "cp"
    kw = {"ttl_seconds": 3600.0, "delay": "10 hours"}
    put(spark, src, 0, [("a", 1, 0), ("a", 2, 30), ("b", 3, 5), (None, 4, 0)])
    first = drain(spark, src, out, cp, **kw)
    assert first == {1: ("a", "new", 1, 0), 2: ("a", "repeat", 1, 0), 3: ("b", "new", 3, 0), 4: (None, "new", 4, 0)}
    # out of order, from the checkpoint: 50 is a repeat of 0 and extends nothing, so 61 is new; 40 is late then
    put(spark, src, 1, [("a", 5, 50), ("a", 6, 61), ("b", 7, 65)])
    put(spark, src, 2, [("a", 8, 40), ("a", 9, 121), ("b", 10, 66)])
    got = drain(spark, src, out, cp, **kw)
    assert {i: got[i] for i in (5, 6, 7)} == {5: ("a", "repeat", 1, 0), 6: ("a", "new", 6, 0), 7: ("b", "repeat", 3, 0)}
    assert {i: got[i] for i in (8, 9, 10)} == {8: ("a", "late", None, 1), 9: ("a", "repeat", 6, 1), 10: ("b", "new", 10, 0)}
    put(spark, src, 3, [("z", 11, 60 * 24)])
    put(spark, src, 4, [("a", 12, 60 * 24 + 1)])  # the timer has ended the state of a, its count of late ones too
    got = drain(spark, src, out, cp, **kw)
    assert got[12] == ("a", "new", 12, 0) and len(got) == 12


def files(target):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, fs in os.walk(target) for f in fs if f.endswith(".parquet")}


def test_upsert_touches_its_buckets_only(spark, tmp_path):
    schema, target = "chunk_id long, text string", str(tmp_path / "t")
    frame = lambda rows: spark.createDataFrame(rows, schema)
    read = lambda: {(r.chunk_id, r.text) for r in streams.bucket_table(spark, target, schema).collect()}
    streams.upsert_buckets(target, frame([(i, f"old {i}") for i in range(100)] + [(None, "no key"), (None, "no key")]), 0, 16)
    before = files(target)
    assert len(read()) == 101 and streams.bucket_table(spark, target, schema).count() == 102
    batch = frame([(5, "new 5"), (200, "new 200"), (5, "new 5"), (None, "more")])
    streams.upsert_buckets(target, batch, 1, 16)
    after = files(target)
    assert {p: after[p] for p in before} == before and 1 <= len(after) - len(before) <= 3
    want = {(i, f"old {i}") for i in range(100) if i != 5} | {(5, "new 5"), (200, "new 200"), (None, "no key"), (None, "more")}
    assert read() == want
    streams.upsert_buckets(target, batch, 1, 16)  # replayed
    assert read() == want and streams.bucket_table(spark, target, schema).where("chunk_id is null").count() == 3
    streams.upsert_buckets(target, frame([]), 2, 16)
    assert read() == want and streams._committed(spark, target) == [0, 1]
    os.makedirs(tmp_path / "t" / "batch=7" / "_bucket=0")  # a write that never ended
    assert read() == want


def test_ingest_stream(spark, tmp_path):
    src, target = tmp_path / "in", str(tmp_path / "out")
    for rows in ([(1, "a"), (2, "b")], [(2, "c"), (3, "d")]):
        spark.createDataFrame(rows, "chunk_id long, text string").coalesce(1).write.mode("append").parquet(str(src))
        s = streams.event_stream(spark, str(src), "chunk_id long, text string")
        streams.ingest(s, lambda d: d.withColumn("text", F.upper("text")), target, str(tmp_path / "cp"), 4).awaitTermination()
    got = streams.bucket_table(spark, target, "chunk_id long, text string")
    assert sorted((r.chunk_id, r.text, r._batch) for r in got.collect()) == [(1, "A", 0), (2, "C", 1), (3, "D", 1)]
