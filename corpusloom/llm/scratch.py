"""Intermediate tables in the folder that every executor shares."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_OWN: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a folder of our own only where it is unset (tests)."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="spark-corpusloom-")
    return _OWN[app]


def stored(df: DataFrame, label: str, batch_rows: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back, which cuts the lineage. Nothing reads the shuffle
    files of the write again, so Spark is told to delete them when it ends. ``batch_rows``: rows of an Arrow batch on
    the way to Python, for plans that send whole texts."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/corpusloom-{uuid.uuid4().hex}/{label}"
    wanted = {CLEANUP: "true"} | ({} if batch_rows is None else {BATCH: str(batch_rows)})
    before = {k: spark.conf.get(k, "false" if k == CLEANUP else "10000") for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def python_batches(spark: SparkSession, rows: int):
    """Arrow batches of so many rows for the jobs run within."""
    before = spark.conf.get(BATCH, "10000")
    spark.conf.set(BATCH, str(rows))
    try:
        yield
    finally:
        spark.conf.set(BATCH, before)


def drop(df: DataFrame) -> None:
    """Delete the files of a table made by ``stored`` that no later step reads."""
    spark = df.sparkSession
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_enough(df: DataFrame, rows: int) -> bool:
    """True if ``df`` has at most ``rows`` rows; the check that comes before every broadcast."""
    return df.limit(rows + 1).count() <= rows
