"""The keyword leg for a batch of questions: BM25 over an inverted index of posting blocks with score bounds.

Only terms of the questions are indexed. A term's postings are cut into blocks by impact and by part, a part being some of
the chunks, the same for all terms; each block knows its largest impact. Top-k runs in two rounds:

1. Each question's rarest terms give partial scores. The k-th of them is a score that the k-th best chunk reaches at least.
2. Terms whose largest impacts together stay below that bound cannot make a chunk a candidate; they are the common ones, and
   their lists are not joined with the question. A block of another term is skipped if its largest impact and the largest of all
   other terms of the question cannot reach the bound. What is left is summed; only chunks that may still reach the better
   bound that follows from these sums are looked up in the skipped terms.

Every chunk of the true top k keeps all its postings, so the ranking is the exact one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import let
from ..sources.tables import fits, kept
from .retrieval import terms, top_k


@dataclass(frozen=True)
class KeywordParams:
    """``k1``, ``b``: of BM25. ``block``: postings of a block of a term that all chunks have, about. ``levels``: impact levels of a term. ``probe``: postings of
    the rarest terms that a question reads for its first bound. ``broadcast_rows``: most rows of a side that is broadcast."""

    k1: float = 1.2
    b: float = 0.75
    block: int = 1000
    levels: int = 8
    probe: int = 2000
    broadcast_rows: int = 200_000


TOLERANCE = 2e-6  # scores are compared after rounding to 6 places


def _small(df: DataFrame, p: KeywordParams) -> DataFrame:
    return F.broadcast(df) if fits(df, p.broadcast_rows) else df


def postings(chunks: DataFrame, asked: DataFrame, chunk_id: str, p: KeywordParams) -> DataFrame:
    """(term, c, len, tf, chunk_id) of the asked terms, and one row with a null term for each chunk, which alone has its id: ``c`` is a
    number in its place. Terms are sorted and their runs counted within the row, so that the work grows with its terms
    and not with their square."""

    def runs(ts: Column) -> Column:
        starts = F.when(F.size(ts) > 0, F.filter(F.sequence(F.lit(0), F.size(ts) - 1), lambda i: ~F.get(ts, i - 1).eqNullSafe(F.get(ts, i)))).otherwise(F.array().cast("array<int>"))
        return let(starts, lambda at: F.transform(at, lambda i, j: F.struct(F.get(ts, i).alias("term"), (F.coalesce(F.get(at, j + 1), F.size(ts)) - i).alias("tf"))))

    counted = let(F.sort_array(terms(F.col("text"))), lambda ts: F.struct(F.size(ts).alias("len"), runs(ts).alias("runs")))
    rows = chunks.select(F.col(chunk_id).alias("chunk_id"), counted.alias("n")).withColumn("c", F.monotonically_increasing_id())
    whole = F.array(F.struct(F.lit(None).cast("string").alias("term"), F.lit(None).cast("int").alias("tf")))
    each = rows.select("c", "chunk_id", "n.len", F.explode(F.concat(whole, "n.runs")).alias("r")).select("r.term", "c", "len", "r.tf", F.when(F.col("r.term").isNull(), F.col("chunk_id")).alias("chunk_id"))
    wanted = asked.select("term").distinct().withColumn("hit", F.lit(True))
    return each.join(_small(wanted, p), "term", "left").where("hit or term is null").select("term", "c", "len", "tf", "chunk_id")


def index(chunks: DataFrame, asked: DataFrame, chunk_id: str, p: KeywordParams) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The blocks (term, level, part, top, entries of (c, w)), the terms (term, df, idf, top) and the chunks (c, chunk_id) of an index.
    Impacts in blocks lack the factor of the term, ``idf``, so that postings are shuffled once."""
    found = kept(postings(chunks, asked, chunk_id, p), "postings")
    facts = kept(found.where("term is null").agg(F.count("*").alias("n"), F.avg("len").alias("avg_len")), "facts")
    w = F.col("tf") * (p.k1 + 1) / (F.col("tf") + p.k1 * (1 - p.b + p.b * F.col("len") / F.col("avg_len")))
    part = F.pmod(F.xxhash64("c"), F.ceil(F.col("n") / (p.block * p.levels))).cast("int")
    level = F.least(F.floor(p.levels * (1 - F.col("w") / (p.k1 + 1))), F.lit(p.levels - 1)).cast("int")
    weighed = found.where("term is not null").crossJoin(F.broadcast(facts)).select("term", "c", w.alias("w"), part.alias("part"))  # facts is one row
    blocks = weighed.groupBy("term", level.alias("level"), "part").agg(F.max("w").alias("top"), F.collect_list(F.struct("c", "w")).alias("entries"))
    blocks = kept(blocks, "blocks")
    df = blocks.groupBy("term").agg(F.sum(F.size("entries")).alias("df"), F.max("top").alias("top"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    words = df.crossJoin(F.broadcast(facts)).select("term", "df", idf.alias("idf"), (idf * F.col("top")).alias("top"))
    return blocks, kept(words, "terms"), found.where("term is null").select("c", "chunk_id")


def _sums(asked: DataFrame, blocks: DataFrame) -> DataFrame:
    """(query_id, c, s) over the blocks that the terms of a question read. ``asked`` has ``idf`` and may have ``floor``: the least largest impact of a block.
    Only blocks are shuffled, by part: all blocks of a chunk are of one part, so its sums are made where they lie."""
    read = asked.join(blocks.withColumnRenamed("top", "block_top").repartition("part"), "term")
    if "floor" in asked.columns:
        read = read.where(F.col("block_top") * F.col("idf") >= F.col("floor"))
    each = read.select("query_id", "part", "idf", F.explode("entries").alias("e")).groupBy("part", "query_id", F.col("e.c").alias("c"))
    return each.agg(F.sum(F.col("idf") * F.col("e.w")).alias("s")).drop("part")


def _bound(sums: DataFrame, k: int) -> DataFrame:
    """(query_id, bound): the k-th largest sum of each question with as many."""
    w = Window.partitionBy("query_id").orderBy(F.desc("s"))
    return sums.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).groupBy("query_id").agg(F.min("s").alias("bound"), F.count("*").alias("c")).where(F.col("c") == k).drop("c")


def bm25_top(chunks: DataFrame, queries: DataFrame, k: int, chunk_id: str = "chunk_id", p: KeywordParams = KeywordParams()) -> DataFrame:
    """(query_id, chunk_id, score, rank): the k best chunks of each question by BM25, ties by chunk id.

    Chunks are (chunk_id, text), questions (query_id, text). Null and empty texts have no terms; chunks without a term in common with
    a question are not listed. Ids are taken as unique; other columns are ignored.
    """
    asked = queries.select("query_id", F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))
    blocks, words, ids = index(chunks, asked, chunk_id, p)
    own = Window.partitionBy("query_id")
    known = kept(asked.join(_small(words, p), "term"), "asked")
    rarest = known.withColumn("before", F.sum("df").over(own.orderBy("df", "term").rowsBetween(Window.unboundedPreceding, -1)))
    first = _bound(_sums(rarest.where(F.coalesce("before", F.lit(0)) < p.probe).select("query_id", "term", "idf"), blocks), k)
    # essential terms: those from which on the running sum of largest impacts reaches the bound
    bounded = known.join(first, "query_id", "left").withColumn("bound", F.coalesce("bound", F.lit(0.0)) - TOLERANCE)
    bounded = bounded.withColumn("reach", F.sum("top").over(own.orderBy("top", "term").rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("top").over(own))
    bounded = kept(bounded.withColumn("essential", F.col("reach") >= F.col("bound")).withColumn("floor", F.col("bound") - (F.col("all") - F.col("top"))), "bounds")
    sums = kept(_sums(bounded.where("essential").select("query_id", "term", "idf", "floor"), blocks), "sums")
    rest = bounded.groupBy("query_id").agg(F.first("bound").alias("bound"), F.sum(F.when(~F.col("essential"), F.col("top")).otherwise(0.0)).alias("rest"))
    better = _bound(sums, k).withColumnRenamed("bound", "second")
    left = sums.join(rest, "query_id").join(better, "query_id", "left")
    left = kept(left.where(F.col("s") + F.col("rest") >= F.greatest(F.col("bound"), F.coalesce("second", F.lit(0.0)) - TOLERANCE)).select("query_id", "c", "s"), "candidates")
    # skipped terms, for the chunks left only
    skipped = bounded.where("not essential").select("query_id", "term", "idf")
    each = blocks.join(_small(skipped.select("term").distinct(), p), "term", "left_semi").select("term", F.explode("entries").alias("e")).select("term", "e.c", "e.w")
    each = each.join(_small(left.select("c").distinct(), p), "c", "left_semi")
    more = left.join(each, "c").join(skipped, ["query_id", "term"]).groupBy("query_id", "c").agg(F.sum(F.col("idf") * F.col("w")).alias("m"))
    full = left.join(more, ["query_id", "c"], "left").select("query_id", "c", F.round(F.col("s") + F.coalesce("m", F.lit(0.0)), 6).alias("score"))
    return top_k(full.join(ids, "c").select("query_id", "chunk_id", "score"), k, "chunk_id").withColumnRenamed("chunk_id", chunk_id)
