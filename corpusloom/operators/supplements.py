"""Supplement pages and their chunks: selection, blocks to text, acceptance and union with the base."""

from __future__ import annotations

from collections import Counter
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import let


# Why a page is chosen, the most urgent first, and what the summary table's page must say.
REASONS = ("explicit_page", "cis_summary_table", "low_text", "image_heavy")
SUMMARY_PHRASES = ("SAFEGUARDS TOTAL", "IG1", "IG2", "IG3")
SUMMARY_LABELS = ("ig1", "ig2", "ig3", "safeguards", "total")


def selected_pages(pages: DataFrame, most: int, min_chars: int = 160) -> DataFrame:
    """(doc, page_number, reasons, priority): up to ``most`` pages of a document (0: all) that need a visual parse. Pages have
    text and has_image, and maybe ``asked`` (boolean): named by the user."""
    compact = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "))
    asked = F.coalesce(F.col("asked"), F.lit(False)) if "asked" in pages.columns else F.lit(False)
    summary = F.lit(True)
    for phrase in SUMMARY_PHRASES:
        summary = summary & F.contains(F.upper(compact), F.lit(phrase))
    hits = (asked, summary, F.length(compact) < min_chars, F.col("has_image") & (F.length(compact) < 5 * min_chars))
    reasons = F.array_compact(F.array(*[F.when(hit, name) for name, hit in zip(REASONS, hits, strict=True)]))
    w = Window.partitionBy("doc").orderBy("priority", "page_number")
    got = pages.withColumn("reasons", reasons).where(F.size("reasons") > 0)
    got = got.withColumn("priority", F.array_position(F.array(*map(F.lit, REASONS)), F.col("reasons")[0]) - 1)
    got = got.withColumn("_n", F.row_number().over(w))
    return (got.where(F.col("_n") <= most) if most else got).select("doc", "page_number", "reasons", "priority")


def table_markdown(html: Column) -> Column:
    """An HTML table as markdown, short rows padded; without rows, its text."""
    plain = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", " "), r"\s+", " "))
    rows = F.transform(F.regexp_extract_all(html, F.lit("(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1)), lambda r: F.transform(F.regexp_extract_all(r, F.lit("(?is)<t[hd][^>]*>(.*?)</t[hd]>"), F.lit(1)), plain))
    wide = lambda rs: F.array_max(F.transform(rs, lambda r: F.size(r)))
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))

    def table(x: Column) -> Column:
        padded = F.transform(x["rows"], lambda r: F.concat(r, F.array_repeat(F.lit(""), x["n"] - F.size(r))))
        rule = line(F.transform(F.sequence(F.lit(1), x["n"]), lambda _: F.lit("---")))
        return F.array_join(F.concat(F.array(line(padded[0]), rule), F.transform(F.slice(padded, 2, F.size(padded)), line)), "\n")

    made = F.transform(F.array(F.struct(rows.alias("rows"), wide(rows).alias("n"))), lambda x: F.when(F.coalesce(x["n"], F.lit(0)) > 0, table(x)).otherwise(plain(html)))
    return made[0]


def page_text(blocks: DataFrame) -> DataFrame:
    """(doc, page_number, text) of visual blocks (type, bbox, content) from top to bottom, then left to right."""
    text = F.when(F.col("type") == "table", table_markdown(F.col("content"))).when(F.col("type") == "equation", F.concat(F.lit("$$"), F.col("content"), F.lit("$$"))).otherwise(F.col("content"))
    placed = F.struct(F.get("bbox", F.lit(1)).alias("y"), F.get("bbox", F.lit(0)).alias("x"), text.alias("t"))
    return blocks.groupBy("doc", "page_number").agg(F.array_join(F.transform(F.array_sort(F.collect_list(placed)), lambda b: b["t"]), "\n\n").alias("text"))


def _words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("([a-z0-9]+(?:\\.[0-9]+)?)"), F.lit(1))


def matching_share(left: str, right: str, least: float) -> Column:
    """Twice the characters in matching blocks over the characters of both (difflib); 0 as soon as a bound shows less than
    ``least``."""

    @F.pandas_udf("double")
    def share(a: pd.Series, b: pd.Series) -> pd.Series:
        def one(x: str, y: str) -> float:
            n = len(x) + len(y)
            if n and (2 * min(len(x), len(y)) / n < least or 2 * (Counter(x) & Counter(y)).total() / n < least):
                return 0.0
            return SequenceMatcher(None, x, y).ratio()

        return pd.Series([one(*t) for t in zip(a, b, strict=True)], dtype="float64")

    return share(left, right)


def base_text(pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """(doc, page_number, base): text of the chunks that cover a page. A chunk's pages lie in two stretches at most of the next power
    of two, which join by key with the stretches of that length that pages are in; the work grows with the pages that chunks cover."""
    power = F.when(F.col("page_start") < F.col("page_end"), F.ceil(F.log2(F.col("page_end") - F.col("page_start") + 1))).otherwise(0).cast("int")
    held = chunks.where(F.col("page_start") <= F.col("page_end")).withColumn("_power", power)
    at = lambda c: F.expr(f"shiftright(cast({c} AS bigint), _power)")
    placed = held.withColumn("_at", F.explode(F.array_distinct(F.array(at("page_start"), at("page_end")))))
    asked = pages.select("doc", "page_number").crossJoin(F.broadcast(held.select("_power").distinct())).withColumn("_at", at("page_number"))  # powers: 64 at most
    j = asked.join(placed, ["doc", "_power", "_at"]).where(F.col("page_number").between(F.col("page_start"), F.col("page_end")))
    return j.groupBy("doc", "page_number").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))), lambda s: s["text"]), "\n").alias("base"))


def accepted(candidates: DataFrame, least_chars: int = 40, share: float = 0.35, base_chars: int = 160, near: float = 0.75, alike: float = 0.97) -> DataFrame:
    """Supplements (text, base, and maybe ``reasons``) that are long enough, keep the labels of a summary table, share enough of
    their words with a base text of some length, and are not in it already. Texts are compared by their words."""
    texts = let(F.struct(_words(F.col("text")).alias("_t"), _words(F.col("base")).alias("_b")), lambda w: F.struct(w["_t"], w["_b"], F.array_join(w["_t"], " ").alias("_x"), F.array_join(w["_b"], " ").alias("_y")))
    c = candidates.select("*", F.inline(F.array(texts)))  # a row each: the conditions below, which use these often, are not moved before it
    own = F.size(F.array_distinct("_t"))
    agrees = (F.length("_y") < base_chars) | (F.size(F.array_intersect("_t", "_b")) >= share * F.greatest(own, F.lit(1)))
    labels = F.lit(True)
    if "reasons" in candidates.columns:
        table = F.coalesce(F.array_contains("reasons", "cis_summary_table"), F.lit(False))
        labels = ~table | (F.size(F.array_intersect("_t", F.array(*map(F.lit, SUMMARY_LABELS)))) == len(SUMMARY_LABELS))
    c = c.where((F.length("_x") >= least_chars) & agrees & labels & ~((F.length("_y") > 0) & F.contains("_y", F.col("_x"))))
    ratio = F.least(F.length("_x"), F.length("_y")) / F.greatest(F.length("_x"), F.length("_y"))
    c = c.withColumn("_near", F.when(ratio >= near, matching_share("_x", "_y", alike)).otherwise(0.0))
    return c.where(F.col("_near") < alike).drop("_t", "_b", "_x", "_y", "_near")



def with_supplements(base: DataFrame, extra: DataFrame) -> DataFrame:
    """Base chunks and, after them in each document, the supplements with ids of their own."""
    last = base.groupBy("doc").agg(F.max("chunk_index").alias("_m"))
    w = Window.partitionBy("doc").orderBy("page_number")
    rows = extra.join(last, "doc", "left").withColumn("chunk_index", F.coalesce(F.col("_m") + 1, F.lit(0)) + F.row_number().over(w) - 1)
    made = rows.select("doc", "chunk_index", "text", F.col("page_number").alias("page_start"), F.col("page_number").alias("page_end"), F.lit("supplement").alias("element_type"))
    return base.unionByName(made, allowMissingColumns=True)
