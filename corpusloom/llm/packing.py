"""Best-fit packing of token pieces into sequences, in rounds over a shrinking number of tasks."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .runs import Chars, RunTable, char_blocks, per_text
from .scratch import stored
from .textvec import column, slices

VOCABULARY = "word_bpe_49k.json"
_BETWEEN = "~"


@dataclass(frozen=True)
class PackParams:
    """``full``: bins with at most this many free tokens are emitted at once. ``fan_in``: how many tasks' underfull
    bins meet in one task of the next round. ``bins_per_task``: no task of a later round gets more bins on average; where
    that allows no fewer tasks, the bins are dealt anew. ``gain``: then a round that merges a smaller share of its
    bins is the last, as what is left hardly fits together. ``batch_rows``: items, or the documents they are made of,
    that go to Python at a time in the first job."""

    capacity: int = 4096
    end_id: int = 1
    full: int = 8
    fan_in: int = 4
    bins_per_task: int = 100_000
    pieces_per_task: int = 40_000
    gain: float = 0.01
    batch_rows: int = 1000


class _Words:
    """Ids of whole texts. The tokenizer drops white space before it splits, so a text's ids are those of its runs of
    other characters in order; a run of letters with signs after it is looked up in two parts, as the tokenizer splits
    there too. Texts that could hold a special token go to the tokenizer as they are."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.heads = {t.content[:2] for t in self.model.get_added_tokens_decoder().values()}
        self.between = int(self._whole([_BETWEEN])[0].item())
        self.table = RunTable(self._encode, slots=1 << 20)

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int32) for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode(self, runs: list[str]) -> list[np.ndarray]:
        """Many runs at a time, with a sign of one id between them that none of them has."""
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(runs)
        plain = [i for i, r in enumerate(runs) if _BETWEEN not in r]
        for lo in range(0, len(plain), 256):
            at = plain[lo : lo + 256]
            ids = self._whole([f" {_BETWEEN} ".join([runs[i] for i in at])])[0]
            cuts = [-1, *np.flatnonzero(ids == self.between).tolist(), len(ids)]
            for i, a, b in zip(at, cuts[:-1], cuts[1:], strict=True):
                out[i] = ids[a + 1 : b]
        other = [i for i, r in enumerate(runs) if _BETWEEN in r]
        for i, ids in zip(other, self._whole([runs[i] for i in other]), strict=True):
            out[i] = ids
        return out

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids (int32) of each text; null and empty texts have none."""
        whole = [i for i, t in enumerate(texts) if t and any(h in t for h in self.heads)]
        rest = list(texts)
        for i in whole:
            rest[i] = None
        out: list[np.ndarray] = []
        for block in char_blocks(rest):
            starts, ends, cp = _runs(block)
            ids, sizes = self.table.ids(block, cp, starts, ends)
            at = per_text(block, starts, sizes)
            out += [ids[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        for i in whole:
            out[i] = self._whole([texts[i]])[0]
        return out


def _runs(block: Chars) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, code points with Latin letters in lower case) of the runs to look up."""
    ink, kind = ~block.white(), block.kind()
    new = block.text_starts()
    cut = ink.copy()  # where a run starts: after white space, at the start of a text
    cut[1:] &= ~ink[:-1] | new[1:]
    starts = np.flatnonzero(cut)
    stop = np.ones(len(ink), bool)  # the last character of a run
    stop[:-1] = ~ink[1:] | new[1:]
    ends = np.flatnonzero(ink & stop) + 1
    letters, signs = np.concatenate(([0], np.cumsum(kind == 1))), np.concatenate(([0], np.cumsum(kind == 2)))
    n_letters, n_signs = letters[ends] - letters[starts], signs[ends] - signs[starts]
    middle = starts + n_letters
    # Letters, then signs, nothing else: as many letters in the first part as in the whole run.
    two = (n_letters > 0) & (n_signs > 0) & (n_letters + n_signs == ends - starts)
    two &= letters[middle] - letters[starts] == n_letters
    starts = np.sort(np.concatenate((starts, middle[two])))
    ends = np.sort(np.concatenate((ends, middle[two])))
    cp = block.cp
    upper = (kind == 1) & (((cp >= 65) & (cp <= 90)) | ((cp >= 0xC0) & (cp <= 0xDE)))
    return starts, ends, cp + (upper * np.uint32(32))


_models: dict[str, _Words] = {}


def token_pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", p: PackParams = PackParams(), path: str | None = None, with_ids: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): every document's tokens and its end token, cut only
    where they exceed the capacity. Null and empty texts have the end token alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = path or public_tokenizers.path(VOCABULARY)
        if name not in _models:
            _models[name] = _Words(name)
        end = np.array([p.end_id], "<u4").tobytes()
        step = p.capacity * 4
        for part in slices(batches, 256):
            rows = []
            for d, ids in zip(column(part, doc_id), _models[name].encode(column(part, text)), strict=True):
                ids = ids.tobytes() + end
                for k in range(0, len(ids), step):
                    x = ids[k : k + step]
                    rows.append((d, k // step, k // 4, len(x) // 4, zlib.crc32(x), x))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            arrays = [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]
            names = [doc_id, "piece", "start", "length", "ids_crc32", "ids"]
            yield pa.RecordBatch.from_arrays(arrays[: 5 + with_ids], names[: 5 + with_ids])

    return docs.select(doc_id, text).mapInArrow(run, f"{doc_id} long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def best_fit(used: np.ndarray, capacity: int) -> np.ndarray:
    """Bin number of each item, largest items first, each into the fullest bin that still takes it. Open bins
    are kept by free room; a bitmap over the room finds the least that is enough."""
    bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    free, mask = 0, 0
    out = np.zeros(len(used), np.int64)
    for i in np.argsort(-used, kind="stable"):
        need = int(used[i])
        fit = mask >> need
        if fit:
            room = need + (fit & -fit).bit_length() - 1
            b = bins[room].pop()
            if not bins[room]:
                mask &= ~(1 << room)
        else:
            b, room = free, capacity
            free += 1
        out[i] = b
        left = room - need
        if left:
            bins[left].append(b)
            mask |= 1 << left
    return out


def pack(items: DataFrame, length: str = "length", p: PackParams = PackParams()) -> DataFrame:
    """``items`` with ``sequence_id`` and ``offset``: gapless in every sequence, at most ``capacity`` in each.

    An item longer than the capacity, or of null or negative length, is an error. No items: no rows.
    """
    names = items.columns
    bins = stored(
        items.select(F.array(F.struct(*names)).alias("members"), F.col(length).cast("int").alias("used"), F.abs(F.xxhash64(*names)).alias("mixed")), "items", p.batch_rows
    )
    done: list[DataFrame] = []
    count = bins.count()
    tasks = max(1, -(-count // p.pieces_per_task))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = [f for f in frames if len(f)]
        if not got:
            return
        f = pd.concat(got, ignore_index=True).sort_values(["used", "mixed"], ignore_index=True)
        used = f["used"].to_numpy()
        if used.min() < 0 or used.max() > p.capacity:
            raise ValueError("an item does not fit into a sequence")
        f["bin"] = best_fit(used, p.capacity)
        f = f.sort_values("bin", kind="stable", ignore_index=True)
        edges = np.flatnonzero(np.diff(f["bin"].to_numpy(), prepend=-1))
        members = f["members"].to_numpy()
        ends = [*edges[1:], len(f)]
        yield pd.DataFrame(
            {
                "members": [[m for x in members[a:b] for m in x] for a, b in zip(edges, ends, strict=True)],
                "used": np.add.reduceat(f["used"].to_numpy(), edges).astype(np.int32),
                "mixed": np.maximum.reduceat(f["mixed"].to_numpy(), edges),
            }
        )

    turn = 0
    while count:
        packed = stored(bins.repartition(tasks, F.xxhash64("mixed", F.lit(turn))).mapInPandas(run, bins.schema), "bins")
        if tasks == 1:
            done.append(packed)
            break
        after, full = packed.agg(F.count("*"), F.count_if(F.col("used") >= p.capacity - p.full)).first()
        fewer = max(-(-tasks // p.fan_in), -(-(after - full) // p.bins_per_task))
        if fewer >= tasks and after > count * (1 - p.gain):
            done.append(packed)
            break
        done.append(packed.where(F.col("used") >= p.capacity - p.full))
        bins = packed.where(F.col("used") < p.capacity - p.full)
        count, tasks, turn = after - full, min(fewer, tasks), turn + 1
    if not done:
        return items.limit(0).withColumn("sequence_id", F.lit(0).cast("long")).withColumn("offset", F.lit(0).cast("long"))
    every = done[0]
    for d in done[1:]:
        every = every.unionByName(d)
    numbered = every.withColumn("sequence_id", F.monotonically_increasing_id())
    at = F.aggregate(
        "members",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("starts")),
        lambda acc, m: F.struct((acc["at"] + m[length]).alias("at"), F.array_append(acc["starts"], acc["at"]).alias("starts")),
        lambda acc: acc["starts"],
    )
    return (
        numbered.withColumn("starts", at)
        .select("sequence_id", F.explode(F.arrays_zip("members", "starts")).alias("m"))
        .select(*[F.col(f"m.members.{n}").alias(n) for n in names], "sequence_id", F.col("m.starts").alias("offset"))
    )


def op6_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return packing_stage(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)


def packing_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: all pieces with their places."""
    return pack(token_pieces(docs, with_ids=False))
