"""Intermediate tables in the folder that every executor shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a folder of our own only where it is unset, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if not folder and app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="spark-corpusloom-core-")
    return (folder or _OWN[app]).rstrip("/")


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once and read back: steps that use it again scan a table, and lost executors cost no recomputation."""
    path = f"{shared_dir(df.sparkSession)}/corpusloom-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Delete tables made by ``kept`` that no later step reads."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fits(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most so many rows: the check before a broadcast."""
    return df.limit(rows + 1).count() <= rows
