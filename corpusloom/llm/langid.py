"""Language identification with hyperdimensional letter n-gram profiles.

Each letter has a random vector of +1 and -1. An n-gram's vector binds (multiplies) its letters' vectors,
each permuted (rotated) by its place; a text's vector bundles (sums) those of its n-grams; a language's
prototype bundles the normalised vectors of its texts. The prediction is the prototype of largest cosine
after the mean of all prototypes is taken off both sides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .scratch import python_batches, small_enough, stored
from .textvec import column, mix, slices

SYMBOLS = 128


@dataclass(frozen=True)
class HdParams:
    """``dims``: length of the vectors. ``seed``: of the letter vectors. ``docs_per_block``: texts bundled at a time
    in a task. ``max_languages``: more labels than this are an error, as prototypes are sent to every task."""

    dims: int = 512
    seed: int = 20
    docs_per_block: int = 128
    max_languages: int = 2000


_table: list[np.ndarray] = []


def _symbols() -> np.ndarray:
    """Code point of the basic plane to symbol: 0 for what isn't a letter, a-z, then other letters by hash."""
    if not _table:
        out = np.zeros(1 << 16, np.uint8)
        other = 27 + (mix(np.arange(1 << 16, dtype=np.uint64)) % np.uint64(SYMBOLS - 27)).astype(np.uint8)
        for cp in range(1 << 16):
            c = chr(cp)
            if c.isalpha():
                low = ord(c.lower()[0])
                out[cp] = low - 96 if 97 <= low <= 122 else other[low & 0xFFFF]
        _table.append(out)
    return _table[0]


def _letters(text: str | None) -> np.ndarray:
    """Symbols of a text with each run of non-letters as one 0, and a 0 at either end."""
    cp = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
    s = _symbols()[np.minimum(cp, 0xFFFF)]
    high = np.flatnonzero(cp > 0xFFFF)
    for i in high:  # rare
        s[i] = 27 + cp[i] % (SYMBOLS - 27) if chr(cp[i]).isalpha() else 0
    s = np.concatenate(([0], s, [0])).astype(np.int64)
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != 0) | (s[:-1] != 0)
    return s[keep]


def _vectors(p: HdParams) -> np.ndarray:
    rng = np.random.default_rng(p.seed)
    one = rng.integers(0, 2, (SYMBOLS, p.dims)).astype(np.float32) * 2 - 1
    return np.stack([np.roll(one, 2, axis=1), np.roll(one, 1, axis=1), one])


def bundles(texts: list[str | None], p: HdParams, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(unit vector of each text, whether it has a letter). No letter: zeros."""
    out, has = np.zeros((len(texts), p.dims), np.float32), np.zeros(len(texts), bool)
    for at in range(0, len(texts), p.docs_per_block):
        seqs = [_letters(t) for t in texts[at : at + p.docs_per_block]]
        grams = [(s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:] if len(s) > 2 else s[:0] for s in seqs]
        size = np.array([len(g) for g in grams])
        flat = np.concatenate(grams)
        if not len(flat):
            continue
        present = np.zeros(SYMBOLS**3, bool)
        present[flat] = True
        ids = np.flatnonzero(present)
        place = np.zeros(SYMBOLS**3, np.int32)
        place[ids] = np.arange(len(ids))
        doc = np.repeat(np.arange(len(grams)), size)
        counts = np.bincount(doc * len(ids) + place[flat], minlength=len(grams) * len(ids)).reshape(len(grams), -1).astype(np.float32)
        v = np.zeros((len(grams), p.dims), np.float32)
        for k in range(0, len(ids), 4096):
            g = ids[k : k + 4096]
            v += counts[:, k : k + 4096] @ (letters[0][g // SYMBOLS**2] * letters[1][g // SYMBOLS % SYMBOLS] * letters[2][g % SYMBOLS])
        norm = np.linalg.norm(v, axis=1, keepdims=True)
        out[at : at + len(grams)] = v / np.maximum(norm, 1e-9)
        has[at : at + len(grams)] = size > 0
    return out, has


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", p: HdParams = HdParams()) -> tuple[list[str], np.ndarray]:
    """(languages, prototypes) from every row with a label and a letter. Each task bundles its own texts; the sums of
    dims values per language are added up by key. Nothing to learn from: no languages. Raises ValueError beyond
    ``max_languages``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, sums = _vectors(p), {}
        for b in slices(batches):
            langs = column(b, lang)
            v, has = bundles(column(b, text), p, letters)
            for name in set(langs):
                own = np.array([x == name for x in langs]) & has
                if own.any():
                    sums[name] = sums.get(name, 0) + v[own].sum(axis=0, dtype=np.float64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.string()), pa.array([list(map(float, v)) for v in sums.values()], pa.list_(pa.float64()))], ["lang", "v"]
        )

    parts = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(text, lang).mapInArrow(run, "lang string, v array<double>")
    sums = parts.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    rows = sums.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("v")).limit(p.max_languages + 1).collect()
    if len(rows) > p.max_languages:
        raise ValueError(f"more than {p.max_languages} languages to learn")
    rows.sort(key=lambda r: r.lang)
    protos = np.array([r.v for r in rows]).reshape(-1, p.dims)
    return [r.lang for r in rows], protos / np.maximum(np.linalg.norm(protos, axis=1, keepdims=True), 1e-9)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text", p: HdParams = HdParams(), echo: bool = True) -> DataFrame:
    """``docs`` (without the text if not ``echo``: it need not come back from Python) with ``lang_pred`` and ``score`` (cosine, 0 to 1); ``und`` and 0 for null texts, texts without a letter,
    and all texts if the model has no language. Ties go to the first language in alphabetical order."""
    langs, protos = model
    mean = protos.mean(axis=0) if len(langs) > 1 else np.zeros(p.dims)
    centred = protos - mean
    centred /= np.maximum(np.linalg.norm(centred, axis=1, keepdims=True), 1e-9)
    base = docs.drop("lang_pred", "score")
    others = [c for c in base.columns if echo or c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = _vectors(p)
        for b in slices(batches):
            v, has = bundles(column(b, text), p, letters)
            v = v - mean
            cos = (v @ centred.T) / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
            if not langs:
                cos, has = np.zeros((len(v), 1)), np.zeros(len(v), bool)
            best = cos.argmax(axis=1)
            score = np.where(has, np.clip(cos[np.arange(len(best)), best], 0, 1), 0.0)
            names = [langs[i] if h else "und" for i, h in zip(best, has, strict=True)]
            kept = [b.column(b.schema.get_field_index(c)) for c in others]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(names, pa.string()), pa.array(score, pa.float64())], [*others, "lang_pred", "score"])

    return base.mapInArrow(run, T.StructType([*base.select(*others).schema, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.where(~held_out()).select("text", "lang"))
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), model).drop("text")


#: A text that is like no learned language by this cosine is rejected by the pipeline.
MIN_SCORE = 0.02
#: Rows of an Arrow batch on the way to Python in the stage.
STAGE_ROWS = 1000


def language_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents without a letter, and those unlike every learned language, go. Where no language could be
    learned, nothing can be told about the others and only null and blank texts go. Null and empty texts have no letter; ids and
    other columns play no part, so repeated rows fare alike; an empty table gives an empty one."""
    with python_batches(spark, STAGE_ROWS):
        model = train(docs.where(~held_out()).select("text", "lang"))
    if not model[0]:
        return docs.where(F.col("text").rlike(r"\S"))
    # A text is judged by itself: only texts and two hashes of each go to Python, and the hashes of those to leave out come back.
    k1, k2 = F.xxhash64("text").alias("_k1"), F.xxhash64(F.lit(9), "text").alias("_k2")
    judged = predict(docs.where("text is not null").select("text", k1, k2), model, echo=False)
    gone = stored(judged.where((F.col("lang_pred") == "und") | (F.col("score") < MIN_SCORE)).select("_k1", "_k2").distinct(), "unlike", STAGE_ROWS)
    side = F.broadcast(gone) if small_enough(gone, 500_000) else gone
    return docs.where("text is not null").withColumn("_k1", k1).withColumn("_k2", k2).join(side, ["_k1", "_k2"], "left_anti").select(*docs.columns)
