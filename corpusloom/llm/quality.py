"""Quality rules whose cutoffs come from mergeable quantile sketches per language and source."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .scratch import small_enough, stored
from .textvec import Block, blocks, column, slices, words

# Fixed values of the base rule.
SYMBOLS = b"[#*$%&|<>]"[1:-1]
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8

METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True


@dataclass(frozen=True)
class Fences:
    """A document is an outlier of its group beyond ``quantile`` by ``reach`` times the inner range.

    Groups with fewer than ``min_group`` documents use their language's cutoffs, then those of all.
    ``floor_*`` are the least distances from the quantile, so that very even groups reject nothing by
    hair's breadth. ``k`` is the accuracy parameter of the sketches (size bounded by it).
    """

    low: float = 0.25
    high: float = 0.75
    reach: float = 5.0
    min_group: int = 200
    floor_symbol: float = 0.02
    floor_length: float = 1.5
    floor_lines: float = 1.0
    k: int = 200
    broadcast_groups: int = 50_000


def _repeats(block: Block) -> np.ndarray:
    """Words of each text that lie in a WINDOW-word window found at least twice in that text."""
    h, doc, _, _ = words(block, False)
    out = np.zeros(len(block), np.int64)
    k = len(h) - WINDOW + 1
    if k < 2:
        return out
    _, ids = np.unique(h, return_inverse=True)
    span = 1
    ids = ids.astype(np.int64)
    while span < WINDOW:  # names of windows of 2, 4 and 8 words: equal names, equal words
        n = len(ids) - span
        pair = ids[:n] * (ids.max() + 1) + ids[span : span + n]
        _, ids = np.unique(pair, return_inverse=True)
        span *= 2
    inside = doc[:k] == doc[WINDOW - 1 : WINDOW - 1 + k]
    at = np.flatnonzero(inside)
    key = doc[at].astype(np.int64) * (ids.max() + 1) + ids[at]
    _, name, count = np.unique(key, return_inverse=True, return_counts=True)
    hit = at[count[name] > 1]
    cover = np.zeros(len(h) + 1, np.int64)
    np.add.at(cover, hit, 1)
    np.add.at(cover, hit + WINDOW, -1)
    covered = np.cumsum(cover[:-1]) > 0
    return np.bincount(doc[covered], minlength=len(block)).astype(np.int64)


def _dup_lines(block: Block, word_starts: np.ndarray) -> np.ndarray:
    """Lines with a word that equal an earlier line of the same text."""
    raw = block.raw
    ends = np.flatnonzero(raw == 10)
    starts = np.concatenate(([0], ends[:-1] + 1))
    has = np.searchsorted(word_starts, ends) > np.searchsorted(word_starts, starts)
    starts, ends = starts[has], ends[has]
    if not len(starts):
        return np.zeros(len(block), np.int64)
    doc = block.doc_of(starts)
    _, name = np.unique(block.hashes(raw, starts, ends), return_inverse=True)
    _, first = np.unique(doc.astype(np.int64) * (name.max() + 1) + name, return_index=True)
    dup = np.ones(len(doc), bool)
    dup[first] = False
    return np.bincount(doc[dup], minlength=len(block)).astype(np.int64)


def text_metrics(texts: list[str | None]) -> dict[str, np.ndarray]:
    """The METRICS of each text, in order; null and empty texts have zeros."""
    parts: dict[str, list[np.ndarray]] = {m: [] for m in METRICS}
    for block in blocks(texts):
        _, doc, starts, ends = words(block, False)
        n = len(block)
        points = np.concatenate(([0], np.cumsum((block.raw & 0xC0) != 0x80)))
        symbols = np.concatenate(([0], np.cumsum(_IS_SYMBOL[block.raw])))
        parts["n_words"].append(np.bincount(doc, minlength=n).astype(np.int64))
        parts["word_chars"].append(np.bincount(doc, points[ends] - points[starts], n).astype(np.int64))
        parts["n_symbols"].append(np.diff(symbols[block.bounds]))
        parts["n_dup_lines"].append(_dup_lines(block, starts))
        parts["n_repeat_words"].append(_repeats(block))
    return {m: np.concatenate(v) if v else np.zeros(0, np.int64) for m, v in parts.items()}


def with_metrics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the METRICS columns (long); columns of those names are replaced."""
    base = docs.drop(*METRICS)
    schema = T.StructType(list(base.schema))
    for m in METRICS:
        schema = schema.add(m, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = text_metrics(column(b, text))
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(found[m]) for m in METRICS)], [*b.schema.names, *METRICS])

    return base.mapInArrow(run, schema)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


_FEATURES = {
    "symbol": lambda: F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1)),
    "length": lambda: F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1)),
    "lines": lambda: F.col("n_dup_lines") / F.greatest(F.col("n_words"), F.lit(1)) * 20,
}


def sketches(metrics: DataFrame, lang: str, source: str, fences: Fences) -> DataFrame:
    """One row per (lang, source): the group's size and a KLL sketch per feature. Sketches merge, so hot
    groups are pre-aggregated on the map side and parts of a corpus can be sketched apart."""
    return (
        metrics.where(~base_failed())
        .groupBy(F.coalesce(F.col(lang), F.lit("")).alias("_lang"), F.coalesce(F.col(source), F.lit("")).alias("_source"))
        .agg(
            F.count("*").alias("_n"),
            *(F.kll_sketch_agg_double(f().cast("double"), F.lit(fences.k)).alias(f"_{x}") for x, f in _FEATURES.items()),
        )
    )


def _bounds(df: DataFrame, fences: Fences) -> DataFrame:
    q = lambda x, r: F.kll_sketch_get_quantile_double(F.col(f"_{x}"), F.lit(r))
    floor = {"symbol": fences.floor_symbol, "length": fences.floor_length, "lines": fences.floor_lines}
    out = []
    for x, least in floor.items():
        room = F.greatest(F.lit(least), fences.reach * (q(x, fences.high) - q(x, fences.low)))
        out += [(q(x, fences.low) - room).alias(f"{x}_low"), (q(x, fences.high) + room).alias(f"{x}_high")]
    return df.select(*[c for c in ("_lang", "_source") if c in df.columns], "_n", *out)


def thresholds(groups: DataFrame, fences: Fences) -> DataFrame:
    """Cutoffs per (lang, source); small groups take those of their language, then of the whole corpus."""

    def merged(*keys: str) -> DataFrame:
        return groups.groupBy(*keys).agg(F.sum("_n").alias("_n"), *(F.kll_merge_agg_double(f"_{x}").alias(f"_{x}") for x in _FEATURES))

    names = [f"{x}_{s}" for x in _FEATURES for s in ("low", "high")]
    as_struct = lambda df, to: df.select(*[c for c in ("_lang", "_source") if c in df.columns], F.when(F.col("_n") >= (1 if to == "all" else fences.min_group), F.struct(*names)).alias(to))
    own = as_struct(_bounds(groups, fences), "own")
    by_lang = as_struct(_bounds(merged("_lang"), fences), "by_lang")
    every = as_struct(_bounds(merged(), fences), "all")
    return own.join(by_lang, "_lang").crossJoin(F.broadcast(every)).select("_lang", "_source", F.coalesce("own", "by_lang", "all").alias("_cut"))


def verdict(metrics: DataFrame, lang: str, source: str, fences: Fences = Fences(), salt: str = "doc_id") -> DataFrame:
    """Adds ``base_failed`` and ``kept``. Cutoffs come from every document that the base rule passes. ``salt`` is a column
    of many values.

    Null and empty language or source count as the same. A group all of whose documents fail the base rule
    has no cutoff, and none of its documents is kept.
    """
    cut = stored(thresholds(stored(sketches(metrics, lang, source, fences), "sketches"), fences), "cutoffs")
    keyed = metrics.withColumn("_lang", F.coalesce(F.col(lang), F.lit(""))).withColumn("_source", F.coalesce(F.col(source), F.lit("")))
    if small_enough(cut, fences.broadcast_groups):
        joined = keyed.join(F.broadcast(cut), ["_lang", "_source"], "left")
    else:  # many groups: salt, as one source may hold a third of the rows
        salts = 32
        joined = keyed.withColumn("_salt", F.pmod(F.hash(salt), F.lit(salts))).join(
            cut.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), ["_lang", "_source", "_salt"], "left"
        ).drop("_salt")
    inside = F.lit(True)
    for x, f in _FEATURES.items():
        inside = inside & f().between(F.col(f"_cut.{x}_low"), F.col(f"_cut.{x}_high"))
    return (
        joined.withColumn("base_failed", base_failed())
        .withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(True)))
        .drop("_lang", "_source", "_cut")
    )


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    metrics = stored(with_metrics(docs).drop("text"), "metrics")
    return verdict(metrics, "lang", "source").select("doc_id", *METRICS, "base_failed", "kept")


def quality_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the rules reject go."""
    own = F.xxhash64("doc_id", "text", "lang", "source").alias("_row")  # rows of one id but other texts are judged apart
    found = with_metrics(docs.select("text", "lang", "source", own))
    cut = verdict(stored(found.drop("text"), "metrics"), "lang", "source", salt="_row")
    gone = stored(cut.where("not kept").select("_row").distinct(), "rejected")
    if small_enough(gone, 500_000):
        gone = F.broadcast(gone)
    return docs.withColumn("_row", own).join(gone, "_row", "left_anti").select(*docs.columns)
