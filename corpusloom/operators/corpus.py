"""Statistics, hashes and integrity of a corpus of chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import text as fx
from .lines import boilerplate_key, in_margin


def with_chunk_ids(chunks: DataFrame) -> DataFrame:
    """``chunk_id``: document id and five-digit index."""
    return chunks.withColumn("chunk_id", F.concat_ws("-", F.col("doc_id").cast("string"), F.lpad(F.col("chunk_index").cast("string"), 5, "0")))


def statistics(chunks: DataFrame) -> DataFrame:
    """One row of counts. A repeated chunk id is an error."""
    dup = chunks.groupBy("chunk_id").count().agg(F.max("count").alias("most"))
    facts = chunks.agg(F.count("*").alias("chunks"), F.sum("token_count").alias("tokens"), F.min("token_count").alias("min_tokens"), F.max("token_count").alias("max_tokens"), F.count_distinct("doc_id").alias("documents"))
    checked = facts.crossJoin(F.broadcast(dup))  # one row on either side
    return checked.where(F.assert_true(F.coalesce(F.col("most") <= 1, F.lit(True)), "a chunk id is repeated").isNull()).drop("most")


def content_hashes(df: DataFrame, key: str, content: str) -> DataFrame:
    """(key, sha256, bytes) of text or binary content; null counts as empty."""
    data = F.coalesce(F.col(content).cast("binary"), F.lit(b""))
    return df.select(key, F.sha2(data, 256).alias("sha256"), F.octet_length(data).cast("long").alias("bytes"))


def drift(frozen: DataFrame, now: DataFrame, key: str) -> DataFrame:
    """(id, state): missing, added, changed or same, of two tables of content_hashes."""
    a, b = frozen.select(F.col(key).alias("k"), F.col("sha256").alias("ha")), now.select(F.col(key).alias("j"), F.col("sha256").alias("hb"))
    state = F.when(F.col("j").isNull(), "missing").when(F.col("k").isNull(), "added").when(F.col("ha") != F.col("hb"), "changed").otherwise("same")
    return a.join(b, F.col("k") == F.col("j"), "full").select(F.coalesce("k", "j").alias("id"), state.alias("state"))


def counted_ranks(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, value, _to, _n): the rank up to which each distinct value of a group reaches, and the group's size. The number of rows of a
    group is its distinct values: for counts, lengths and tokens that is few, however many rows there are."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*by)
    return counted.withColumn("_to", F.sum("_c").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.sum("_c").over(w))


def lower_percentiles(df: DataFrame, by: list[str], value: str, p: float) -> DataFrame:
    """Element ``int((n - 1) * p)`` of each group's sorted values, by counting distinct values, so that no group is collected."""
    at = F.floor((F.col("_n") - 1) * F.lit(p))
    return counted_ranks(df, by, value).where(F.col("_to") > at).groupBy(*by).agg(F.min(value).alias("value"))


def medians(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, value): the mean of the middle one or two values, found like the percentiles."""
    reach = lambda r: F.min(F.when(F.col("_to") >= r, F.col(value)))
    low, high = (r(F.col("_n")) for r in (lambda n: F.floor((n + 1) / 2), lambda n: F.floor(n / 2) + 1))
    return counted_ranks(df, by, value).groupBy(*by).agg(((reach(low) + reach(high)) / 2).alias("value"))


def output_manifest(chunks: DataFrame, by: list[str], least: int, most: int) -> DataFrame:
    t = F.col("token_count")
    facts = chunks.groupBy(*by).agg(
        F.count("*").alias("chunks"), F.sum(t).alias("tokens"), F.round(F.avg(t), 6).alias("avg_tokens"),
        F.count_if(t < least).alias("below_min"), F.count_if(t > most).alias("above_max"),
    )
    middle = medians(chunks, by, "token_count").withColumnRenamed("value", "median_tokens")
    return facts.join(middle, by).join(lower_percentiles(chunks, by, "token_count", 0.95).withColumnRenamed("value", "p95_tokens"), by)


def per_artifact(chunks: DataFrame, by: str) -> DataFrame:
    return chunks.groupBy(by).agg(F.count("*").alias("chunks"), F.sum("token_count").alias("tokens"), F.sum(F.length("text")).alias("characters"))


def filter_chunks(chunks: DataFrame, types: list[str] | None = None, clauses_only: bool = False, pages: tuple[int, int] | None = None, search: str = "", fields: list[str] = ("text", "chunk_id", "clause_number")) -> DataFrame:
    """Chunks of the given types, with a clause, overlapping the pages, and with the search words in one of the fields."""
    out = chunks
    if types:
        out = out.where(F.col("element_type").isin(*types))
    if clauses_only:
        out = out.where(F.coalesce(F.col("clause_number"), F.lit("")) != "")
    if pages:
        out = out.where((F.col("page_end") >= pages[0]) & (F.col("page_start") <= pages[1]))
    if search.strip():
        out = out.where(F.contains(F.lower(F.concat_ws(" ", *fields)), F.lit(search.strip().lower())))
    return out


def review_rows(chunks: DataFrame, limit: int = 180) -> DataFrame:
    """Adds ``page_label`` and a one-line ``preview``."""
    label = F.when(F.col("page_start") == F.col("page_end"), F.concat(F.lit("p. "), F.col("page_start").cast("string"))).otherwise(F.concat(F.lit("pp. "), F.col("page_start").cast("string"), F.lit("-"), F.col("page_end").cast("string")))
    return chunks.withColumn("page_label", label).withColumn("preview", fx.shortened(F.col("text"), limit))


def histogram(df: DataFrame, value: str) -> DataFrame:
    """(bin, chunks) with min(36, max(8, int(sqrt(n)) * 2)) bins of equal width; empty bins are left out."""
    facts = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.least(F.lit(36), F.greatest(F.lit(8), F.floor(F.sqrt(F.count("*"))) * 2)).alias("bins"))
    wide = (F.col("hi") - F.col("lo")).cast("double")
    at = F.when(F.col(value) == F.col("hi"), F.col("bins")).otherwise(F.floor((F.col(value) - F.col("lo")) * F.col("bins") / wide) + 1)
    return df.crossJoin(F.broadcast(facts)).groupBy(at.cast("long").alias("bin")).agg(F.count("*").alias("chunks"))


def extraction_summary(lines: DataFrame, least: int = 30) -> DataFrame:
    page = lines.groupBy("doc", "page_number").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("c"))
    return page.groupBy("doc").agg(F.count("*").alias("pages"), F.sum("n").alias("lines"), F.sum("c").alias("characters"), F.count_if(F.col("c") < least).alias("low_text_pages"))


def margin_examples(lines: DataFrame, top: int) -> DataFrame:
    """The commonest margin lines of the corpus."""
    keyed = lines.where(in_margin()).withColumn("key", boilerplate_key(F.col("text"))).where("key <> ''")
    return keyed.groupBy("key").agg(F.count("*").alias("lines"), F.count_distinct("doc").alias("documents")).orderBy(F.desc("lines"), "key").limit(top)
