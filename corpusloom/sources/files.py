"""Scans and sinks: JSON lines, documents in folders, upserts and quarantine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

CHUNK_SCHEMA = (
    "text string, metadata struct<source_file:string,doc_title:string,chunk_id:string,chunk_index:int,page_start:int,page_end:int,breadcrumb:array<string>,"
    "clause_number:string,token_count:int,element_type:string,table_annotation:struct<clause_number:string,asset_type:string,security_function:string,applicable_groups:array<string>>>"
)
MAX_UPLOAD = 10 * 1024 * 1024


def strict_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object a line; blank lines are dropped and a bad line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def lenient_chunks(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(chunks, rejects): rows that parse and have text, and the raw lines of those that don't, with their file."""
    rows = spark.read.schema(f"{CHUNK_SCHEMA}, _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    rows = rows.withColumn("file", F.input_file_name())
    good = F.col("_bad").isNull() & (F.trim(F.coalesce("text", F.lit(""))) != "")
    reason = F.when(F.col("_bad").isNotNull(), "not JSON").otherwise("no text")
    return rows.where(good).drop("_bad"), rows.where(~good).select("file", reason.alias("reason"), F.col("_bad").alias("line"))


def documents_in(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """(path, modificationTime, length, content) of the files of a folder tree."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)


def admission(files: DataFrame) -> DataFrame:
    """Adds ``rejected``: why an upload is not admitted, or null."""
    why = (
        F.when(~F.lower("path").endswith(".pdf"), "not a PDF file name")
        .when(F.col("length") == 0, "empty file")
        .when(F.col("length") > MAX_UPLOAD, "larger than 10 MiB")
        .when(F.substring("content", 1, 5) != F.lit(b"%PDF-"), "no PDF header")
    )
    return files.withColumn("rejected", why)


def write_chunks(chunks: DataFrame, path: str) -> None:
    """One {text, metadata} object a line."""
    chunks.select("text", "metadata").write.json(path)


def upserted(stored: DataFrame, batch: DataFrame, key: str = "chunk_id") -> DataFrame:
    """The stored rows with the batch's rows in place of those of the same key; rows without a key are always added."""
    both = stored.withColumn("_from", F.lit(0)).unionByName(batch.withColumn("_from", F.lit(1)))
    w = Window.partitionBy(key).orderBy(F.desc("_from"), F.xxhash64(*stored.columns))
    keyed = both.where(F.col(key).isNotNull()).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return keyed.unionByName(both.where(F.col(key).isNull())).drop("_from")


def metadata_json(metadata: Column) -> Column:
    return F.to_json(metadata)


def metadata_struct(text: Column, schema: T.StructType | str) -> Column:
    """The struct that a JSON string holds; one with nulls where it cannot be read."""
    return F.from_json(F.coalesce(text, F.lit("{}")), schema)


def quarantined(results: DataFrame, error: str = "error") -> tuple[DataFrame, DataFrame]:
    """(good, bad): rows whose error column is null, and the others."""
    return results.where(F.col(error).isNull()).drop(error), results.where(F.col(error).isNotNull())
