"""Vectorised words, lines and shingles over a block of UTF-8 texts (numpy, used inside tasks).

A word is a maximal run of characters other than space and TAB to CR. Words and lines are
compared by 64-bit polynomial hashes, finished with an avalanche step.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}
BLOCK_BYTES = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """Avalanche of 64-bit values (SplitMix finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power(kind: str, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        size = max(n, 1 << 16)
        out = np.full(size, _P if kind == "up" else _P_INV, np.uint64)
        out[0] = 1
        np.multiply.accumulate(out, out=out)
        if size > 4 * BLOCK_BYTES:  # a very long text: not worth keeping
            return out[:n]
        _powers[kind] = out
    return _powers[kind][:n]


def hash_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of ``raw[starts[i]:ends[i]]`` (ascending, disjoint), a stretch of about BLOCK_BYTES at a time."""
    out = np.zeros(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        k = max(i + 1, int(np.searchsorted(ends, starts[i] + BLOCK_BYTES, side="right")))
        a, b = starts[i], ends[k - 1]
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum((raw[a:b].astype(np.uint64) + np.uint64(1)) * _power("up", b - a), out=sums[1:])
        out[i:k] = mix((sums[ends[i:k] - a] - sums[starts[i:k] - a]) * _power("down", b - a)[starts[i:k] - a])
        i = k
    return out


@dataclass
class Block:
    """Bytes of several texts end to end. ``bounds[i]:bounds[i+1]`` is text i, which ends in a newline of our own."""

    raw: np.ndarray
    bounds: np.ndarray

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def spans(self, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the runs where ``mask`` is true."""
        edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
        return edge[::2], edge[1::2]

    def doc_of(self, starts: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, starts, side="right") - 1

    def hashes(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return hash_spans(raw, starts, ends)


def is_space(raw: np.ndarray) -> np.ndarray:
    return (raw == 32) | ((raw >= 9) & (raw <= 13))


def lower(raw: np.ndarray) -> np.ndarray:
    """A-Z to a-z, nothing else."""
    return raw + (((raw >= 65) & (raw <= 90)).view(np.uint8) << 5)


def blocks(texts: Iterable[str | None]) -> Iterator[Block]:
    """Cut a batch into blocks of about BLOCK_BYTES; no text is split. Null counts as empty."""
    parts: list[bytes] = []
    size = 0

    def block() -> Block:
        bounds = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64)
        return Block(np.frombuffer(b"".join(parts), np.uint8), bounds)

    for t in texts:
        b = (t or "").encode("utf-8", "surrogatepass") + b"\n"
        if parts and size + len(b) > BLOCK_BYTES:
            yield block()
            parts, size = [], 0
        parts.append(b)
        size += len(b)
    if parts:
        yield block()


def words(block: Block, fold: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, doc index, start, end) of every word; ``fold`` lower-cases A-Z first."""
    raw = lower(block.raw) if fold else block.raw
    starts, ends = block.spans(~is_space(raw))
    return block.hashes(raw, starts, ends), block.doc_of(starts), starts, ends


def shingle_sets(block: Block, n: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its n-word shingles (A-Z lower-cased).

    Fewer than n words: the whole sequence as one shingle. No word: empty.
    """
    h, doc, _, _ = words(block, True)
    count = np.bincount(doc, minlength=len(block))
    first = np.concatenate(([0], np.cumsum(count)))
    if len(h) >= n:
        k = len(h) - n + 1
        grams = np.zeros(k, np.uint64)
        for j in range(n):
            grams = grams * np.uint64(0xD6E8FEB86659FD93) + h[j : j + k]
        grams = mix(grams)
    out = []
    for i in range(len(block)):
        a, m = first[i], count[i]
        if m >= n:
            out.append(np.unique(grams[a : a + m - n + 1]))
        elif m:
            g = np.uint64(m)
            for j in range(m):
                g = mix(np.array([g]))[0] ^ h[a + j]
            out.append(mix(np.array([g])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def slices(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that what a task builds from one stays small. At the end of the task its
    memory goes back to the system, as the worker lives on for other stages."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
    release()


def release() -> None:
    """Give memory that earlier tasks of this worker have freed back to the system, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
