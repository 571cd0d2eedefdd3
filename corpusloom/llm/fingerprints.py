"""Document fingerprints: bottom-k sketches of word-shingle hashes, as Column expressions only.

A sketch is the k smallest distinct 48-bit hashes of a text's 5-word shingles, ascending. Two sketches merge
into that of the union of their shingle sets, and the k smallest of a union are a random sample of it, which
gives resemblance, containment and the number of distinct shingles. Below k shingles all three are exact.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import let

_SPACE = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class SketchParams:
    """``k``: hashes kept. ``words``: words of a shingle. ``bucket_rows``: documents that are put in order together;
    ``max_buckets`` bounds the cut points that the plan carries."""

    k: int = 128
    words: int = 5
    bucket_rows: int = 1000
    max_buckets: int = 2000


def words(text: Column) -> Column:
    """A-Z lower-cased words between runs of space and TAB to CR; none for null and empty texts."""
    trimmed = F.trim(F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(_SPACE))
    return let(trimmed, lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, "[\\x20\\x09-\\x0D]+", -1)))


def shingle_hashes(text: Column, p: SketchParams = SketchParams()) -> Column:
    """48-bit hashes of all shingles; of the whole sequence if it is shorter than one; none without words."""

    def hashes(h: Column) -> Column:
        long = F.transform(
            F.sequence(F.lit(0), F.size(h) - p.words), lambda i: F.shiftrightunsigned(F.xxhash64(*[F.get(h, i + j) for j in range(p.words)]), 16)
        )
        short = F.array(F.shiftrightunsigned(F.xxhash64(h), 16))
        return F.when(F.size(h) >= p.words, long).when(F.size(h) > 0, short).otherwise(F.array().cast("array<bigint>"))

    return let(F.transform(words(text), lambda w: F.xxhash64(w)), hashes)


def sketch(text: Column, p: SketchParams = SketchParams()) -> Column:
    """Bottom-k sketch of a whole text: array<bigint>, ascending, at most k long."""
    return F.slice(F.sort_array(F.array_distinct(shingle_hashes(text, p))), 1, p.k)


def merged(a: Column, b: Column, p: SketchParams = SketchParams()) -> Column:
    """The sketch of both texts' shingles together. Null counts as empty."""
    none = F.array().cast("array<bigint>")
    return F.slice(F.sort_array(F.array_distinct(F.concat(F.coalesce(a, none), F.coalesce(b, none)))), 1, p.k)


def merge_groups(df: DataFrame, by: list[str], sketch_column: str = "sketch", p: SketchParams = SketchParams()) -> DataFrame:
    """The sketch of each group of texts. Only the k smallest hashes of a group leave each task."""
    least = Window.partitionBy(*by).orderBy("_hash")
    small = df.select(*by, F.explode(sketch_column).alias("_hash")).withColumn("_rank", F.dense_rank().over(least)).where(F.col("_rank") <= p.k)
    return small.groupBy(*by).agg(F.sort_array(F.collect_set("_hash")).alias(sketch_column))


def resemblance(a: Column, b: Column, p: SketchParams = SketchParams()) -> Column:
    """Estimated Jaccard similarity. Two empty sketches are alike (1); an empty and another one are not (0)."""
    found = let(merged(a, b, p), lambda u: F.size(F.array_intersect(F.array_intersect(u, a), b)) / F.size(u))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(found)


def containment(a: Column, b: Column, p: SketchParams = SketchParams()) -> Column:
    """Estimated share of a's shingles that b has: those of a that are in b, up to the smaller of the two sketches'
    reach. An empty a is contained in anything (1)."""

    def within(limit: Column) -> Column:
        mine = F.filter(a, lambda x: x <= limit)
        return let(mine, lambda m: F.when(F.size(m) > 0, F.size(F.array_intersect(m, b)) / F.size(m)).otherwise(F.lit(0.0)))

    top = (1 << 48) - 1
    reach = lambda s: F.when(F.size(s) >= p.k, F.array_max(s)).otherwise(F.lit(top))
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(let(F.least(reach(a), reach(b)), within))


def distinct_count(s: Column, p: SketchParams = SketchParams()) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    return F.when(F.size(s) < p.k, F.size(s).cast("double")).otherwise((p.k - 1) * float(1 << 48) / F.array_max(s))


def fingerprint(s: Column) -> Column:
    """A sketch as text: 12 hex digits a hash. Equal texts have equal fingerprints; no words, the empty string."""
    return F.array_join(F.transform(s, lambda x: F.lpad(F.lower(F.hex(x)), 12, "0")), "")


def with_next(df: DataFrame, key: str, columns: list[str], p: SketchParams = SketchParams()) -> DataFrame:
    """``df`` with the next row's values as ``next_<c>``, in ascending order of ``key`` (the first row's after the last). Rows of equal keys are ordered by the hash of all columns; null keys come first.

    The key range is cut into buckets at its quantiles (a mergeable aggregate), so the rows are dealt once
    and no task sees them all. The first row of each bucket also visits the bucket before it.
    """
    order = F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63)))
    tie = F.xxhash64(*df.columns)
    rows = df.withColumn("_o", order).withColumn("_t", tie)
    n = rows.count()
    m = max(1, min(p.max_buckets, n // p.bucket_rows))
    cuts = []
    if m > 1:
        cuts = sorted(set(df.select(order.alias("_o")).agg(F.percentile_approx("_o", [i / m for i in range(1, m)], 100 * m)).first()[0]))
    bucket = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col("_o"))) if cuts else F.lit(0)
    rows = rows.withColumn("_b", bucket)
    firsts = df.select(order.alias("_o"), tie.alias("_t")).withColumn("_b", bucket).groupBy("_b").agg(F.min(F.struct("_o", "_t")).alias("f")).collect()  # at most max_buckets rows
    firsts.sort(key=lambda r: r._b)
    if firsts:
        before = {(r.f._o, r.f._t): firsts[i - 1]._b for i, r in enumerate(firsts)}
        where = F.create_map(*[x for (o, t), b in before.items() for x in (F.concat_ws(":", F.lit(o), F.lit(t)), F.lit(b))])
        visit = F.try_element_at(where, F.concat_ws(":", "_o", "_t"))
        stay = F.struct(F.col("_b").alias("b"), F.lit(0).alias("guest"))
        go = F.struct(visit.alias("b"), F.lit(1).alias("guest"))
        rows = rows.withColumn("_v", F.explode(F.when(visit.isNotNull(), F.array(stay, go)).otherwise(F.array(stay)))).drop("_b")
    else:
        rows = rows.withColumn("_v", F.struct(F.lit(0).alias("b"), F.lit(0).alias("guest"))).drop("_b")
    rows = rows.select(*df.columns, F.col("_v.b").alias("_b"), F.col("_v.guest").alias("_guest"), "_o", "_t")
    w = Window.partitionBy("_b").orderBy("_guest", "_o", "_t")
    return rows.select(*rows.columns, *[F.lead(c).over(w).alias(f"next_{c}") for c in columns])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", p: SketchParams = SketchParams()) -> DataFrame:
    """(doc_id, n_chars, edited text, sketch, edited sketch, next sketch): see op1_document_fingerprints. One shuffle of the texts."""
    base = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    both = with_next(base, "doc_id", ["text"], p)
    part = F.floor(F.length("text") / 4).cast("int")
    edited = F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 4) as int))"), F.substring("next_text", F.lit(1), part))
    w = Window.partitionBy("_b").orderBy("_guest", "_o", "_t")
    made = both.select("doc_id", "_b", "_guest", "_o", "_t", F.length("text").cast("long").alias("n_chars"), sketch(F.col("text"), p).alias("sketch"), edited.alias("edited"))
    return (
        made.select("*", F.lead("sketch").over(w).alias("next_sketch"))
        .where("_guest = 0")
        .select("doc_id", "n_chars", "edited", "sketch", sketch(F.col("edited"), p).alias("edited_sketch"), "next_sketch")
    )


def op1_document_fingerprints(spark, sf_dir: str) -> DataFrame:
    p = SketchParams()
    f = fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), p=p)
    return f.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("sketch")).alias("fingerprint"),
        fingerprint(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch"), p).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch"), p).alias("near_next"),
        distinct_count(F.col("sketch"), p).alias("n_shingles_estimate"),
        containment(F.col("sketch"), F.col("edited_sketch"), p).alias("contained_in_edited"),
    )
