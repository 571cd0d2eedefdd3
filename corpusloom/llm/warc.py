"""WARC archives: write one record per page, read the archives back, and merge their indexes in global order.

Archives are written and read through Spark's own writers and readers, so they can lie on any store that
Spark reaches. Each row of the text writer is one record; the line end is the record end.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .scratch import scratch_dir, stored
from .textvec import column

_EPOCH = dt.datetime(2020, 1, 1, tzinfo=dt.UTC)


@dataclass(frozen=True)
class WarcParams:
    """``least_revisit``: payloads shorter than this are always stored. ``records_per_file`` bounds an archive, which is
    read by one task. ``fan_in``: runs merged at a time by one loser tree."""

    least_revisit: int = 1000
    records_per_file: int = 2000
    fan_in: int = 64


def decide(pages: DataFrame, page_id: str = "page_id", html: str = "html", p: WarcParams = WarcParams()) -> DataFrame:
    """``pages`` with payload_bytes, payload_digest, record_type and refers_to.

    Of equal payloads of at least ``least_revisit`` bytes the one with the largest id is a response, the others
    revisit it. Rows of that same largest id (repeated rows) are all responses. Null html is an empty payload.
    """
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    marked = pages.withColumn("payload_bytes", F.octet_length(payload).cast("long")).withColumn("payload_digest", F.sha1(payload))
    slim = marked.where(F.col("payload_bytes") >= p.least_revisit).select(page_id, "payload_digest", "payload_bytes")
    last = slim.groupBy("payload_digest", "payload_bytes").agg(F.max(page_id).alias("refers_to"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    revisits = stored(slim.join(last, ["payload_digest", "payload_bytes"]).where(F.col(page_id) != F.col("refers_to")).select(page_id, "refers_to").distinct(), "revisits")
    return marked.join(revisits, page_id, "left").withColumn("record_type", F.when(F.col("refers_to").isNull(), "response").otherwise("revisit"))


def _record(page_id: str, url: str, html: str) -> Column:
    """Header, blank line and block of one record. A revisit has no payload of its own."""
    crlf = "\r\n"
    urn = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    is_revisit = F.col("record_type") == "revisit"
    body = F.when(is_revisit, F.lit("")).otherwise(F.coalesce(F.col(html), F.lit("")))
    http = F.concat(F.lit("HTTP/1.1 200 OK" + crlf + "Content-Type: text/html; charset=utf-8" + crlf + "Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(crlf + crlf))
    when = F.date_format(F.timestamp_seconds(F.lit(int(_EPOCH.timestamp())) + F.pmod(F.coalesce(F.col(page_id), F.lit(0)), F.lit(10**9))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    clean = F.regexp_replace(F.coalesce(F.col(url), F.lit("")), "[\\x00-\\x20\\x7f]", "")
    head = F.concat(
        F.lit("WARC/1.1" + crlf + "WARC-Type: "), F.col("record_type"),
        F.lit(crlf + "WARC-Record-ID: "), urn(F.coalesce(F.col(page_id).cast("string"), F.lit("null"))),
        F.lit(crlf + "WARC-Date: "), when,
        F.lit(crlf + "WARC-Target-URI: "), clean,
        F.lit(crlf + "WARC-Payload-Digest: sha1:"), F.col("payload_digest"),
        F.when(is_revisit, F.concat(F.lit(crlf + "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" + crlf + "WARC-Refers-To: "), urn(F.col("refers_to")))).otherwise(F.lit("")),
        F.lit(crlf + "Content-Type: application/http; msgtype=response" + crlf + "Content-Length: "), (F.octet_length(http) + F.octet_length(body)).cast("string"),
        F.lit(crlf + crlf),
    )
    return F.concat(head, http, body)


def write_archives(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", p: WarcParams = WarcParams()) -> None:
    """Write ``pages`` (after ``decide``) as uncompressed WARC files under ``path``."""
    pages.select(_record(page_id, url, html).alias("value")).write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", p.records_per_file).text(path)


def parse(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers, block) of each record of an archive."""
    at = 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        lines = data[at:stop].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at {at}")
        headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
        start = stop + 4
        end = start + int(headers["content-length"])
        if data[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at {at} doesn't end where it says")
        yield at, end + 4 - at, headers, data[start:end]
        at = end + 4


def url_key(url: str) -> str:
    """Sort-friendly form of an address: host labels reversed, then path and query."""
    u = urlsplit(url if "//" in url else f"//{url}")
    host = ",".join(reversed((u.hostname or "").split(".")))
    return f"{host}){u.path or '/'}{'?' + u.query if u.query else ''}".lower()


def read_archives(spark, path: str) -> DataFrame:
    """One row per record, each archive's captures sorted by URL key, time and id: a run. The payload of every
    response is checked against its digest. (run, page_id, url, url_key, date, offset, length, record_type,
    refers_to, payload_digest, payload_bytes, payload_ok)."""
    schema = "run string, page_id long, url string, url_key string, date string, offset long, length long, record_type string, refers_to long, payload_digest string, payload_bytes long, payload_ok boolean"
    names = [x.split()[0] for x in schema.split(", ")]

    def number(urn: str | None) -> int | None:
        v = urn[10:-1] if urn else "null"
        return None if v == "null" else int(v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0), b.column(1), strict=True):
                rows = []
                content = data.as_py()
                for at, length, h, block in parse(content):
                    head, _, payload = block.partition(b"\r\n\r\n")
                    size = int(next(x for x in head.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
                    digest = h["warc-payload-digest"].removeprefix("sha1:")
                    ok = h["warc-type"] == "revisit" or (len(payload) == size and hashlib.sha1(payload).hexdigest() == digest)
                    url = h["warc-target-uri"]
                    rows.append((name.as_py().rsplit("/", 1)[1], number(h["warc-record-id"]), url, url_key(url), h["warc-date"], at, length, h["warc-type"], number(h.get("warc-refers-to")), digest, size, ok))
                rows.sort(key=lambda r: (r[3], r[4], r[1] if r[1] is not None else -1))
                cols = list(zip(*rows, strict=True)) or [()] * len(names)
                kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, schema)


class LoserTree:
    """K-way merge: each inner node holds the loser of its match, so a new head plays one match a level."""

    def __init__(self, runs: list[Iterator]):
        self.runs = runs
        self.k = max(1, len(runs))
        self.heads = [next(r, None) for r in runs] or [None]
        self.tree = [-1] * self.k
        for i in range(self.k):
            self._play(i)

    def _wins(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (x[0], a) < (y[0], b)

    def _play(self, winner: int) -> None:
        node = (winner + self.k) // 2
        while node:
            if self.tree[node] < 0:  # while building, the first to come waits for its rival
                self.tree[node] = winner
                return
            if self._wins(self.tree[node], winner):
                winner, self.tree[node] = self.tree[node], winner
            node //= 2
        self.tree[0] = winner

    def __iter__(self) -> Iterator:
        while (head := self.heads[self.tree[0]]) is not None:
            yield head
            i = self.tree[0]
            self.heads[i] = next(self.runs[i], None)
            self._play(i)


def merge_runs(index: DataFrame, p: WarcParams = WarcParams()) -> DataFrame:
    """The captures of all runs in global order of (url_key, date, page_id), with ``position``: ascending along that
    order, with gaps between the ranges.

    The runs are cut at common range bounds by Spark's range partitioner; a task has its range of every run, each
    still sorted, and merges them with loser trees of at most ``fan_in`` runs, in passes.
    """
    ranged = index.repartitionByRange("url_key", "date", "page_id").sortWithinPartitions("run", "url_key", "date", "page_id")
    numbered = ranged.withColumn("position", F.spark_partition_id().cast("long") * F.lit(1 << 40))
    at = {n: i for i, n in enumerate(numbered.columns)}
    key_at = [at["url_key"], at["date"], at["page_id"]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, held = None, []
        for b in batches:
            schema = b.schema
            if b.num_rows:
                held.append(b)
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        names = table.column("run").to_pylist()
        cols = [table.column(k).to_pylist() for k in key_at]
        keys = [(u, d, -1 if i is None else i) for u, d, i in zip(*cols, strict=True)]
        starts = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
        runs = [iter([(keys[i], i) for i in range(a, z)]) for a, z in zip(starts, starts[1:], strict=False)]
        while len(runs) > 1:
            runs = [iter(list(LoserTree(runs[i : i + p.fan_in]))) for i in range(0, len(runs), p.fan_in)]
        order = pa.array([i for _, i in runs[0]], pa.int64())
        out = table.take(order)
        base = out.column("position")[0].as_py()
        out = out.set_column(at["position"], "position", pa.array(range(base, base + len(out)), pa.int64()))
        yield from out.to_batches(max_chunksize=10_000)

    return numbered.mapInArrow(run, numbered.schema)


def op8_warc(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    path = f"{scratch_dir(spark)}/corpusloom-{uuid.uuid4().hex}/warc"
    write_archives(decide(pages), path)
    index = stored(read_archives(spark, path), "index")
    return merge_runs(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", F.col("date").alias("capture_date"), "payload_ok")


ORACLE = r"""
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN last END AS refers_to,
       lower(array_to_string(list_reverse(string_split(regexp_extract(url, '^[^:]*://([^/?#:]*)', 1), '.')), ',') || ')'
             || coalesce(nullif(regexp_extract(url, '^[^:]*://[^/?#]*([^?#]*)', 1), ''), '/')
             || regexp_extract(url, '([?][^#]*)', 1)) AS url_key,
       strftime(TIMESTAMP '2020-01-01' + to_seconds(page_id), '%Y-%m-%dT%H:%M:%SZ') AS capture_date,
       true AS payload_ok
FROM (SELECT page_id, url, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest,
             max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages)
"""
