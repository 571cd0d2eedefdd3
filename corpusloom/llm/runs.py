"""Token ids of short runs of text, looked up a block at a time in a bounded table (numpy, used inside tasks).

A block is several texts end to end as code points. Runs are named by 64-bit hashes of their code points; a run
longer than ``LONG`` is never looked up but encoded each time, so only short runs are told apart by hash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np

from .textvec import hash_spans

LONG = 64
BLOCK_CHARS = 1 << 18
#: Code points with the Unicode property White_Space (fixed values).
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Kinds of code points below 256: 1 letter, 2 ASCII sign, 0 other.
_KIND = np.zeros(256, np.uint8)
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)]] = 1
_KIND[[c for c in range(0x21, 0x7F) if not chr(c).isalnum()]] = 2
_SPACE = np.zeros(0x3001, bool)
_SPACE[WHITE] = True


@dataclass
class Chars:
    """``text`` and its code points ``cp``; text i of the block is ``bounds[i]:bounds[i+1]``."""

    text: str
    cp: np.ndarray
    bounds: np.ndarray

    def white(self) -> np.ndarray:
        return _SPACE[np.minimum(self.cp, 0x3000)] & (self.cp <= 0x3000)

    def kind(self) -> np.ndarray:
        return _KIND[np.minimum(self.cp, 255)] * (self.cp < 256)

    def text_starts(self) -> np.ndarray:
        """True at the first code point of each text."""
        out = np.zeros(len(self.cp) + 1, bool)
        out[self.bounds[:-1]] = True
        return out[:-1]


def char_blocks(texts: list[str | None]) -> Iterator[Chars]:
    """Cut a batch into blocks of about BLOCK_CHARS; no text is split. Null counts as empty."""
    at = 0
    while at < len(texts):
        part, size = [], 0
        while at < len(texts) and (not part or size + len(texts[at] or "") <= BLOCK_CHARS):
            part.append(texts[at] or "")
            size += len(part[-1])
            at += 1
        text = "".join(part)
        yield Chars(text, np.frombuffer(text.encode("utf-32-le"), np.uint32), np.concatenate(([0], np.cumsum([len(t) for t in part]))).astype(np.int64))


class RunTable:
    """Open-addressing table from a run's hash to its ids. ``make`` gives the ids of runs that are not in it; beyond
    ``slots`` / 2 runs or ``most_ids`` ids the table starts anew, so its memory is bounded by those two."""

    def __init__(self, make: Callable[[list[str]], list[np.ndarray]], slots: int = 1 << 21, most_ids: int = 1 << 22):
        self.make, self.slots, self.most_ids = make, slots, most_ids
        self._clear()

    def _clear(self) -> None:
        self.key = np.zeros(self.slots, np.uint64)  # 0: free
        self.start = np.zeros(self.slots, np.int32)
        self.size = np.zeros(self.slots, np.int32)
        self.flat = np.zeros(1 << 16, np.int32)
        self.used = self.count = 0

    def _find(self, h: np.ndarray) -> np.ndarray:
        """The slot of each hash, or of the free place where it would go."""
        at = (h % np.uint64(self.slots)).astype(np.int64)
        open_ = np.flatnonzero((self.key[at] != h) & (self.key[at] != 0))
        while len(open_):
            at[open_] = (at[open_] + 1) % self.slots
            found = self.key[at[open_]]
            open_ = open_[(found != h[open_]) & (found != 0)]
        return at

    def _add(self, h: np.ndarray, ids: list[np.ndarray]) -> None:
        sizes = np.array([len(x) for x in ids], np.int32)
        new = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        while self.used + len(new) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        self.flat[self.used : self.used + len(new)] = new
        starts = self.used + np.concatenate(([0], np.cumsum(sizes)[:-1])) if len(ids) else np.zeros(0)
        left = np.arange(len(h))
        while len(left):  # of those that want one free slot, one gets it and the others look on
            at = self._find(h[left])
            self.key[at] = h[left]
            won = self.key[at] == h[left]
            self.start[at[won]], self.size[at[won]] = starts[left[won]], sizes[left[won]]
            left = left[~won]
        self.used += len(new)
        self.count += len(h)

    def ids(self, block: Chars, cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, how many each run has) of the runs ``starts[i]:ends[i]``. ``cp`` are the code points to
        hash, those of the block or a form of them that has the same ids."""
        flats, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
        for lo in range(0, len(starts), self.slots // 8):
            s, e = starts[lo : lo + self.slots // 8], ends[lo : lo + self.slots // 8]
            if self.count > self.slots * 3 // 8 or self.used > self.most_ids:
                self._clear()
            h = hash_spans(cp, s, e)
            h[h == 0] = 1
            short = e - s <= LONG
            at = np.zeros(len(s), np.int64)
            at[short] = self._find(h[short])
            gone = np.flatnonzero(short & (self.key[at] == 0))
            if len(gone):
                names, first = np.unique(h[gone], return_index=True)
                first = gone[first]
                self._add(names, self.make([block.text[a:b] for a, b in zip(s[first].tolist(), e[first].tolist(), strict=True)]))
                at[short] = self._find(h[short])
            begin, size = self.start[at].astype(np.int64), self.size[at].copy()
            source = self.flat
            long = np.flatnonzero(~short)
            if len(long):
                extra = self.make([block.text[a:b] for a, b in zip(s[long].tolist(), e[long].tolist(), strict=True)])
                size[long] = [len(x) for x in extra]
                begin[long] = self.used + np.concatenate(([0], np.cumsum(size[long])[:-1]))
                source = np.concatenate((self.flat[: self.used], *extra))
            flats.append(gathered(source, begin, size))
            sizes.append(size)
        return np.concatenate(flats), np.concatenate(sizes)


def gathered(source: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches ``source[begin[i] : begin[i] + size[i]]`` end to end."""
    total = int(size.sum())
    ends = np.cumsum(size)
    return source[np.repeat(begin - (ends - size), size) + np.arange(total)]


def per_text(block: Chars, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Bounds of each text's ids among those of the runs that start at ``starts``."""
    return np.concatenate(([0], np.cumsum(sizes)))[np.searchsorted(starts, block.bounds)]
