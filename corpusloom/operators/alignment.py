"""Passages aligned with the chunks they were taken from: a character q-gram index of the passages, read by every chunk.

Passages are the stated set; they are indexed in blocks of bounded size, and each block's index goes to the tasks that scan the
chunks, so chunks are never exploded or shuffled. Two routes:

* Whole: a chunk that contains a passage has each of its q-grams. Only the rarest gram of a passage is indexed, and a
  chunk that has it is compared with the passage itself. Complete for every length; passages shorter than q are a gram by themselves.
* Near: matched characters of at least ``least`` times the passage's length, in runs of ``run`` characters on average, leave at
  least ``least * length * (1 - (q - 1) / run)`` of its q-grams in the chunk. Of a passage with g grams of which c must be
  there, the g - c + l rarest are indexed, since any chunk with c of them has l of those; what the common grams would add is
  counted only for chunks that come that far, and similarity is measured only for those with c grams. Short passages use
  shorter grams. Pairs whose matches are more scattered than that are out of reach; ``exhaustive`` compares everything.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import text as fx


@dataclass(frozen=True)
class AlignParams:
    """``grams``: (least length of a passage, q) from long to short. ``run``: mean length of a matched run, in units of q.
    ``block_chars``: characters of the passages indexed at a time. ``floor``: the count bound uses at least this ratio.
    ``exhaustive``: near passages are compared with every chunk, for small tables and as a yardstick."""

    grams: tuple[tuple[int, int], ...] = ((64, 8), (24, 5), (0, 3))
    run: float = 1.25
    block_chars: int = 4_000_000
    floor: float = 0.3
    exhaustive: bool = False


def matched_ratio(needle: str, matcher: SequenceMatcher) -> float:
    """Characters of the needle in matching blocks, relative to its length; ``matcher`` has the other text as second sequence."""
    matcher.set_seq1(needle)
    return sum(m.size for m in matcher.get_matching_blocks()) / max(1, len(needle))


def gram_hashes(points: np.ndarray, q: int) -> np.ndarray:
    """64-bit hashes of all runs of q code points."""
    n = len(points) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, q, np.uint64)
    for j in range(q):
        h = (h ^ points[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def code_points(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


@dataclass
class _Index:
    """Postings of one block: grams in order, and for each the passages that are looked up by it."""

    needles: list[str]
    sizes: list[int] = field(default_factory=list)  # q of each passage
    grams: list[np.ndarray] = field(default_factory=list)  # distinct grams of each passage
    need: np.ndarray | None = None  # grams that must be in the chunk
    first: np.ndarray | None = None  # of those indexed, how many must be
    keys: np.ndarray | None = None
    starts: np.ndarray | None = None
    lists: np.ndarray | None = None

    @staticmethod
    def of(needles: list[str], p: AlignParams, least: float | None) -> _Index:
        """``least`` None: for passages that lie whole in a chunk."""
        self = _Index(needles)
        for s in needles:
            q = next(q for n, q in p.grams if len(s) >= n)
            q = min(q, len(s))
            self.sizes.append(q)
            self.grams.append(np.unique(gram_hashes(code_points(s), q)))
        every, counts = np.unique(np.concatenate(self.grams), return_counts=True) if needles else (np.zeros(0, np.uint64), None)
        need, first, keys, owner = [], [], [], []
        for i, (s, q, g) in enumerate(zip(needles, self.sizes, self.grams, strict=True)):
            order = g[np.argsort(counts[np.searchsorted(every, g)], kind="stable")]
            if least is None:
                c, hits, kept = 1, 1, order[:1]
            else:
                repeated = max(len(s) - q + 1, 1) - len(g)  # grams of the passage that occur in it again
                c = max(1, int(np.ceil(max(least, p.floor) * len(s) * (1 - (q - 1) / (p.run * q)))) - repeated)
                c = min(c, len(g))
                hits = 1 + c // 4
                kept = order[: len(g) - c + hits]
            need.append(c)
            first.append(min(hits, len(kept)))
            keys.append(kept)
            owner.append(np.full(len(kept), i, np.int32))
        if needles:
            flat, own = np.concatenate(keys), np.concatenate(owner)
            at = np.argsort(flat, kind="stable")
            flat, self.lists = flat[at], own[at]
            self.keys, self.starts = np.unique(flat, return_index=True)
            self.starts = np.append(self.starts, len(flat))
        self.need, self.first = np.array(need), np.array(first)
        return self

    def candidates(self, points: np.ndarray, whole: bool) -> np.ndarray:
        """Passages that the chunk of these code points may hold."""
        found = {q: np.unique(gram_hashes(points, q)) for q in set(self.sizes)}
        grams = np.unique(np.concatenate(list(found.values())))
        at = np.searchsorted(self.keys, grams)
        at = at[(at < len(self.keys))]
        hit = at[self.keys[at] == grams[: len(at)]]
        if not len(hit):
            return np.zeros(0, np.int64)
        counts = np.bincount(np.concatenate([self.lists[self.starts[i] : self.starts[i + 1]] for i in hit]), minlength=len(self.needles))
        near = np.flatnonzero(counts >= self.first)
        near = near[counts[near] > 0]
        if whole:
            return near
        return np.array([i for i in near if np.isin(self.grams[i], found[self.sizes[i]], assume_unique=True).sum() >= self.need[i]], np.int64)


def _scan(chunks: DataFrame, index: _Index, whole: bool, p: AlignParams) -> list:
    """The best chunk of each passage of a block: its place in the block, the score and the chunk's id."""
    sent = chunks.sparkSession.sparkContext.broadcast(index)
    kind = chunks.schema["chunk_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix, best = sent.value, {}
        everything = np.arange(len(ix.needles)) if p.exhaustive and not whole else None
        for b in batches:
            ids, texts = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("chunk_id", "hay"))
            for chunk, hay in zip(ids, texts, strict=True):
                own = ix.candidates(code_points(hay), whole) if everything is None else everything
                matcher = None
                for i in own.tolist():
                    if whole:
                        score = 1.0 if ix.needles[i] in hay else 0.0
                    else:
                        if matcher is None:
                            matcher = SequenceMatcher(None, "", hay, autojunk=False)
                        score = matched_ratio(ix.needles[i], matcher)
                    if score > 0 and (i not in best or (-score, chunk) < best[i]):
                        best[i] = (-score, chunk)
        at = list(best)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([-best[i][0] for i in at], pa.float64()), pa.array([best[i][1] for i in at], to_arrow_type(kind))], ["pos", "score", "chunk_id"])

    rows = chunks.mapInArrow(run, f"pos int, score double, chunk_id {kind.simpleString()}")
    return rows.groupBy("pos").agg(F.min(F.struct((-F.col("score")).alias("s"), "chunk_id")).alias("b")).select("pos", (-F.col("b.s")).alias("score"), "b.chunk_id").collect()  # a row a passage of the block


def aligned(sources: DataFrame, chunks: DataFrame, least: float = 0.60, p: AlignParams = AlignParams(), blank: bool = False, near: bool = True) -> DataFrame:
    """(source_id, chunk_id, score, status) of passages (source_id, text) over chunks (chunk_id, text).

    The first chunk by id that has the passage whole, with score 1; else the chunk with most matched characters relative to the
    passage's length, the first by id of equal ones. ``status`` is aligned from ``least`` on, else unresolved: then chunk_id is null
    and the score is that of the best chunk found near, 0 if none. White space counts as one space, case matters.
    Null and blank texts and null ids of chunks have no place; a null or blank passage is unresolved, or with ``blank`` in
    the first chunk. Without ``near`` only whole passages are found. Repeated source ids: one row each. Passages are read in blocks; a row of each block's passages goes through the driver.
    """
    spark = sources.sparkSession
    hay = chunks.select("chunk_id", fx.normalise(F.col("text")).alias("hay")).where("chunk_id is not null and hay <> ''")
    asked = sources.select("source_id", fx.normalise(F.col("text")).alias("needle"))
    size = F.length("needle")
    # blocks of about even size, by hash, so that the number of passages has no bound
    total = asked.agg(F.sum(size + 64)).first()[0] or 0
    blocks = max(1, -(-total // p.block_chars))
    kind, own = hay.schema["chunk_id"].dataType.simpleString(), asked.schema["source_id"].dataType.simpleString()
    schema = f"source_id {own}, chunk_id {kind}, score double, status string"
    out = spark.createDataFrame([], schema)
    for k in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("source_id", "needle"), F.lit(blocks)) == k).collect()  # about block_chars characters
        if not part:
            continue
        needles = sorted({r.needle for r in part if r.needle})
        found: dict[str, tuple] = {}
        for whole in (True, False) if near else (True,):
            left = [s for s in needles if s not in found] if not whole else needles
            if left:
                index = _Index.of(left, p, None if whole else least)
                found |= {left[r.pos]: (r.chunk_id, r.score) for r in _scan(hay, index, whole, p)}
        if blank and any(not r.needle for r in part):
            first = hay.agg(F.min("chunk_id")).first()[0]
            found[""] = (first, 1.0 if first is not None else 0.0)
        rows = []
        for r in part:
            chunk, score = found.get(r.needle, (None, 0.0))
            ok = chunk is not None and score >= least
            rows.append((r.source_id, chunk if ok else None, round(score, 6), "aligned" if ok else "unresolved"))
        out = out.unionByName(spark.createDataFrame(rows, schema))
    return out


def contained(sources: DataFrame, chunks: DataFrame) -> DataFrame:
    """(source_id, chunk_id): the first chunk by id that has a passage whole. Blank passages are in none."""
    return aligned(sources, chunks, 1.0, near=False).where("status = 'aligned'").select("source_id", "chunk_id")
