"""Structured Streaming forms of the operators in which the order of arrival matters."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def event_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 4) -> DataFrame:
    """Parquet files of a folder as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def window_counts(requests: DataFrame, seconds: int = 60, delay: str = "10 minutes") -> DataFrame:
    """Requests per policy and fixed window; a window comes out when the watermark has passed it."""
    return requests.withWatermark("ts", delay).groupBy(F.window("ts", f"{seconds} seconds").alias("w"), "policy").agg(F.count("*").alias("requests"))


class _Ttl(StatefulProcessor):
    """Per key the time of the request that did the work. A repeat within the TTL is answered from it and extends nothing; a request after it
    does the work again. Late requests (older than the state's) change nothing but their count, which starts anew with it. An event-time timer
    ends the state when the watermark passes its TTL."""

    def __init__(self, ttl_ms: int, key: str):
        self.ttl, self.key = ttl_ms, key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("made", "at long, request long, late long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        data = pd.concat(list(rows)).sort_values(["at_ms", "request_id"], kind="stable")
        held = self.state.get() if self.state.exists() else None
        at, request, late = held if held is not None else (None, None, 0)
        out = []
        for ms, own in zip(data["at_ms"].tolist(), data["request_id"].tolist(), strict=True):
            if at is not None and ms < at:
                late += 1
                kind, answer = "late", None
            elif at is not None and ms - at <= self.ttl:
                kind, answer = "repeat", request
            else:
                if at is not None:
                    self.handle.deleteTimer(at + self.ttl + 1)
                at, request, late, kind, answer = ms, own, 0, "new", own
                self.handle.registerTimer(at + self.ttl + 1)
            out.append((key[0], own, kind, answer, late))
        self.state.update((at, request, late))
        frame = pd.DataFrame(out, columns=[self.key, "request_id", "kind", "answered_by", "late"])
        frame["answered_by"] = frame["answered_by"].astype("Int64")
        yield frame

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            at, _, _ = self.state.get()
            if expiredTimerInfo.getExpiryTimeInMs() > at + self.ttl:
                self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def requests_in_ttl(requests: DataFrame, key: str = "key", ttl_seconds: float = 86_400.0, delay: str = "1 hour") -> DataFrame:
    """(key, request_id, kind, answered_by, late) of a stream of requests (key, request_id long, ts timestamp): ``new`` requests need work,
    ``repeat`` ones are answered by the new one before them that is at most the TTL old, ``late`` ones come after a newer one of
    their key and are counted. Rows older than the watermark (``delay``) are dropped by Spark. Null keys are a key; rows
    without a time are left out. State is in RocksDB, so a key with a live TTL costs disk, not memory.
    """
    spark = requests.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    type_ = requests.schema[key].dataType.simpleString()
    rows = requests.where("ts is not null and request_id is not null").withWatermark("ts", delay)
    rows = rows.select(key, F.col("request_id").cast("long").alias("request_id"), "ts", F.unix_millis("ts").alias("at_ms"))
    made = rows.groupBy(key).transformWithStateInPandas(
        _Ttl(int(ttl_seconds * 1000), key), f"{key} {type_}, request_id long, kind string, answered_by long, late long", "Append", "EventTime"
    )
    return made


def latest_states(events: DataFrame) -> DataFrame:
    """The newest state of each run and stage (for update mode)."""
    return events.groupBy("run_id", "stage").agg(F.max_by("state", "event_no").alias("state"), F.max("event_no").alias("event_no"))


def _committed(spark: SparkSession, target: str) -> list[int]:
    """Numbers of the batches whose write has ended."""
    top = spark._jvm.org.apache.hadoop.fs.Path(target)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{target}/batch=*/_SUCCESS")) or []
    return sorted(int(s.getPath().getParent().getName().split("=")[1]) for s in found)


def bucket_table(spark: SparkSession, target: str, schema, before: int | None = None) -> DataFrame:
    """The table that ``ingest`` keeps in ``target``: of each bucket the files of the last batch that touched it (before
    the batch given). Columns ``_bucket`` and ``_batch`` (the batch a row came with) included."""
    done = [n for n in _committed(spark, target) if before is None or n < before]
    plain = spark.createDataFrame([], schema).schema
    full = T.StructType([*plain.fields]).add("_batch", "long").add("_bucket", "integer")
    if not done:
        return spark.createDataFrame([], full)
    rows = spark.read.schema(T.StructType([*full.fields]).add("batch", "long")).option("basePath", target).parquet(*[f"{target}/batch={n}" for n in done])
    last = rows.select("_bucket", "batch").groupBy("_bucket").agg(F.max("batch").alias("batch"))  # reads no column of the files
    return rows.join(F.broadcast(last), ["_bucket", "batch"], "left_semi").select(*full.names)  # a row a bucket


def upsert_buckets(target: str, batch: DataFrame, number: int, buckets: int = 64, key: str = "chunk_id") -> None:
    """Upsert a batch: the buckets of its keys are read, merged and written as files of this batch; others stay as they are.
    A batch that is replayed reads what was there before it and writes the same again. Rows without a key are added, to buckets by
    their content; a replay adds them once."""
    spark = batch.sparkSession
    own = F.pmod(F.xxhash64(F.coalesce(F.col(key).cast("string"), F.to_json(F.struct(*batch.columns)))), F.lit(buckets)).cast("int")
    new = batch.withColumn("_batch", F.lit(number).cast("long")).withColumn("_bucket", own)
    touched = [r._bucket for r in new.select("_bucket").distinct().collect()]  # at most ``buckets``
    if not touched:
        return
    old = bucket_table(spark, target, batch.schema, number).where(F.col("_bucket").isin(touched))
    both = old.unionByName(new)
    w = Window.partitionBy("_bucket", key).orderBy(F.desc("_batch"), F.xxhash64(*batch.columns))
    latest = both.where(F.col(key).isNotNull()).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    merged = latest.unionByName(both.where(F.col(key).isNull()))
    merged.repartition(len(touched), "_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{target}/batch={number}")


def ingest(documents: DataFrame, chunk: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, buckets: int = 64, key: str = "chunk_id"):
    """Chunk newly arrived documents and upsert the chunks by ``key`` into a table of hash buckets; see ``upsert_buckets``, and
    ``bucket_table`` for reading it."""

    def write(batch: DataFrame, number: int) -> None:
        upsert_buckets(target, chunk(batch), number, buckets, key)

    return documents.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
