"""Phrase collocations: counts of n-grams in weighted acyclic automata, united by prefix range, composed for part lookups.

1. Words and word pairs are counted by 64-bit hash in numpy, over all texts; hashes that reach the least count leave a bit in
   a map of fixed size. Longer n-grams whose words and pairs have their bits are then counted into a second map. A phrase
   can only be frequent if it and all its parts have their bits, so the rest is passed over. Hashes that collide or
   share a bit only let more through: nothing is decided here.
2. Each task counts the n-grams left, sorts them and builds, key by key, a minimal acyclic transducer from n-gram to count
   for every range of prefixes. Each range unites the transducers of all tasks and sums their weights: exact counts.
3. The parts of every candidate are asked of the range they belong to: the requests become a transducer of their own, and
   composing it with that of the counts yields the frequency of each part. Scores, nested phrases and ranks are SQL.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .scratch import stored
from .textvec import Block, blocks, column, hash_spans, lower, mix, release, slices

Key = tuple[bytes, ...]  # language, then words


@dataclass(frozen=True)
class PhraseParams:
    """``longest``: words of a phrase. ``least``: occurrences of a candidate. ``nested_percent``: a phrase goes if a longer one
    around it is that frequent beside it. ``top``: phrases of each language in the report. ``bits``: each map of frequent
    hashes has 2**bits bits. ``slice_docs``: documents to a slice of the hashes. ``buffer``: n-grams that a task counts
    at a time. ``ranges``: prefix ranges; 0: as many as shuffle partitions. ``sample_docs``: about so many
    documents are looked at to find even ranges (nothing else depends on it). ``salts``: ways in which the requests to one
    range are dealt."""

    longest: int = 4
    least: int = 30
    nested_percent: int = 80
    top: int = 2000
    bits: int = 27
    slice_docs: int = 2000
    buffer: int = 1_000_000
    ranges: int = 0
    sample_docs: int = 1000
    salts: int = 4


# Acyclic transducers over words


class Automaton:
    """Minimal acyclic transducer. ``arcs[s]``: (word, weight, target) of state s by word; a weight of 0: no key ends there. The weight of a
    key stands on its last arc. State 0 has no arcs."""

    def __init__(self, arcs: list[tuple], root: int):
        self.arcs, self.root = arcs, root
        self._index: dict[int, dict] = {}

    def step(self, state: int, word: bytes) -> tuple[int, int] | None:
        if state not in self._index:
            self._index[state] = {w: (c, t) for w, c, t in self.arcs[state]}
        return self._index[state].get(word)

    def pack(self) -> bytes:
        names = sorted({w for s in self.arcs for w, _, _ in s})
        at = {w: i for i, w in enumerate(names)}
        flat = np.array([(at[w], c, t) for s in self.arcs for w, c, t in s], np.int64).reshape(-1, 3)
        sizes = np.array([len(s) for s in self.arcs], np.int64)
        text = b"\n".join(names)  # words hold no line breaks; languages are escaped
        head = np.array([len(sizes), len(flat), self.root, len(text)], np.int64)
        return zlib.compress(head.tobytes() + sizes.tobytes() + flat.T.tobytes() + text, 1)

    @staticmethod
    def unpack(blob: bytes) -> Automaton:
        raw = zlib.decompress(blob)
        n, m, root, _ = np.frombuffer(raw, np.int64, 4).tolist()
        sizes = np.frombuffer(raw, np.int64, n, 32).tolist()
        word, count, target = np.frombuffer(raw, np.int64, 3 * m, 32 + 8 * n).reshape(3, m).tolist()
        names = raw[32 + 8 * n + 24 * m :].split(b"\n")
        flat = list(zip(map(names.__getitem__, word), count, target, strict=True))
        arcs, at = [], 0
        for k in sizes:
            arcs.append(tuple(flat[at : at + k]))
            at += k
        return Automaton(arcs, root)


def build(keys: Iterable[tuple[Key, int]]) -> Automaton:
    """The minimal transducer of sorted distinct keys, one key after the other: when a key leaves the path of the one before,
    the states behind are finished and replaced by equal ones already registered."""
    register: dict[tuple, int] = {(): 0}
    states: list[tuple] = [()]
    last: Key = ()
    path: list[list] = [[]]  # arcs of the states on the path of the last key
    weight: list[int] = []  # of the arcs on that path

    def fold(depth: int) -> None:
        while len(path) - 1 > depth:
            arcs = tuple(path.pop())
            state = register.get(arcs)
            if state is None:
                state = register[arcs] = len(states)
                states.append(arcs)
            path[-1].append((last[len(path) - 1], weight.pop(), state))

    for key, count in keys:
        d = 0
        while d < len(last) and d < len(key) and last[d] == key[d]:
            d += 1
        fold(d)
        for _ in key[d:]:
            path.append([])
            weight.append(0)
        last = key
        weight[-1] = count
    fold(0)
    states.append(tuple(path[0]))
    return Automaton(states, len(states) - 1)


def union(automata: list[Automaton]) -> Iterator[tuple[Key, int]]:
    """Every key of any of them with the sum of its weights, in order."""

    def walk(at: list, key: Key) -> Iterator[tuple[Key, int]]:
        found: dict[bytes, list] = {}
        for a, s in at:
            for w, c, t in a.arcs[s]:
                e = found.get(w)
                if e is None:
                    found[w] = e = [0, []]
                e[0] += c
                if t:
                    e[1].append((a, t))
        for w in sorted(found):
            c, further = found[w]
            here = (*key, w)
            if c:
                yield here, c
            if further:
                yield from walk(further, here)

    return walk([(a, a.root) for a in automata], ())


def compose(asked: Automaton, counts: Automaton) -> Iterator[tuple[int, int]]:
    """(weight in ``asked``, weight in ``counts``) of every key of both, by walking the two together."""
    stack = [(asked.root, counts.root)]
    while stack:
        s, t = stack.pop()
        for w, i, further in asked.arcs[s]:
            hit = counts.step(t, w)
            if hit is not None:
                if i and hit[0]:
                    yield i, hit[0]
                if further and hit[1]:
                    stack.append((further, hit[1]))


# Words and n-grams of a block

_CUT = np.zeros(256, bool)  # ends a piece
_CUT[[46, 44, 59, 58, 33, 63, 10, 11, 12, 13]] = True
_GAP = _CUT.copy()  # ends a word
_GAP[[32, 9]] = True
_STEP = np.uint64(0xD6E8FEB86659FD93)


def label(lang: str | None) -> bytes:
    """A language as first label of a key: null is und; line breaks and backslashes escaped."""
    return ("und" if lang is None else lang).encode("utf-8", "surrogatepass").replace(b"\\", b"\\\\").replace(b"\n", b"\\n")


def unlabel(b: bytes) -> str:
    return re.sub(rb"\\(.)", lambda m: b"\n" if m[1] == b"n" else m[1], b).decode("utf-8", "surrogatepass")


class Grams:
    """Words of a block: ``h`` their hashes, ``g[n]`` hashes of (language, n words from here), ``whole[n]`` whether these are in
    one piece."""

    def __init__(self, block: Block, seeds: np.ndarray, longest: int):
        self.raw = lower(block.raw)
        self.starts, self.ends = block.spans(~_GAP[self.raw])
        self.doc = block.doc_of(self.starts)
        self.h = h = hash_spans(self.raw, self.starts, self.ends)
        piece = np.cumsum(_CUT[self.raw], dtype=np.int32)[self.starts]
        self.g = {1: mix(h ^ seeds[self.doc])}
        self.whole = {1: np.ones(len(h), bool)}
        for n in range(2, longest + 1):
            m = max(len(h) - n + 1, 0)
            self.g[n] = mix(self.g[n - 1][:m] * _STEP + h[n - 1 :][:m])
            self.whole[n] = piece[:m] == piece[n - 1 :][:m]

    def word(self, i: int) -> bytes:
        return self.raw[self.starts[i] : self.ends[i]].tobytes()


def _seed(lang: bytes) -> int:
    return int(hash_spans(np.frombuffer(lang + b"\n", np.uint8), np.array([0]), np.array([len(lang) + 1]))[0])


def _blocks(b: pa.RecordBatch, lang: str, text: str) -> Iterator[tuple[Block, list[bytes], np.ndarray]]:
    langs, at = [label(x) for x in column(b, lang)], 0
    seeds = {x: _seed(x) for x in set(langs)}
    for block in blocks(column(b, text)):
        own = langs[at : at + len(block)]
        at += len(block)
        yield block, own, np.array([seeds[x] for x in own], np.uint64)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


# Step 1


def _passing(g: Grams, maps: list[np.ndarray], longest: int, p: PhraseParams) -> dict[int, np.ndarray]:
    """For n up to ``longest`` the places where the n words lie in one piece and may be frequent with all their parts, by the
    maps of pairs and of longer n-grams as far as there are any."""
    ok = {1: _marked(maps[0], g.g[1], p) if maps else g.whole[1]}
    for n in range(2, longest + 1):
        m = len(g.g[n])
        ok[n] = g.whole[n] & ok[n - 1][:m] & ok[n - 1][1:][:m]
        level = 0 if n == 2 else 1
        if level < len(maps):
            at = np.flatnonzero(ok[n])
            ok[n][at] = _marked(maps[level], g.g[n][at], p)
    return ok


def frequent_map(docs: DataFrame, lang: str, text: str, n_docs: int, orders: tuple[int, ...], sent, p: PhraseParams) -> np.ndarray:
    """The bit map of the hashes of n-grams of these orders that may occur ``least`` times, among those that the maps in ``sent``
    let through. Counts are kept up to that number."""
    cap = min(p.least, 255)
    k = min(max(6, (n_docs // p.slice_docs).bit_length()), p.bits - 6)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit() -> pa.RecordBatch:
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            cut = np.searchsorted(keys >> np.uint64(64 - k), np.arange((1 << k) + 1, dtype=np.uint64))
            own = [i for i in range(1 << k) if cut[i] < cut[i + 1]]
            counts = np.minimum(counts, cap).astype(np.uint8)
            return pa.RecordBatch.from_arrays(
                [pa.array(own, pa.int32()), pa.array([keys[cut[i] : cut[i + 1]].tobytes() for i in own], pa.binary()), pa.array([counts[cut[i] : cut[i + 1]].tobytes() for i in own], pa.binary())],
                ["slice", "keys", "counts"],
            )

        held, size = [], 0
        for b in slices(batches):
            for block, _, seeds in _blocks(b, lang, text):
                g = Grams(block, seeds, max(orders))
                ok = _passing(g, sent.value, max(orders), p)
                for n in orders:
                    held.append(g.g[n][ok[n]])
                    size += len(held[-1])
                if size > 3 * p.buffer:
                    yield emit()
                    held, size = [], 0
        if size:
            yield emit()
        release()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def bits(s: int, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
            keys, counts = _summed(keys, counts)
            marks = np.zeros(1 << (p.bits - k), np.uint8)
            marks[((keys[counts >= cap] >> np.uint64(64 - p.bits)) & np.uint64(len(marks) - 1)).astype(np.int64)] = 1
            return pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([np.packbits(marks, bitorder="little").tobytes()], pa.binary())], ["slice", "bits"])

        now, held, size = None, [], 0
        for b in batches:
            for s, x, y in zip(column(b, "slice"), column(b, "keys"), column(b, "counts"), strict=True):
                if s != now and held:
                    yield bits(now, *map(np.concatenate, zip(*held, strict=True)))
                    held, size = [], 0
                now = s
                held.append((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint8).astype(np.int64)))
                size += len(held[-1][0])
                if size > 4 * p.buffer:
                    held = [_summed(*map(np.concatenate, zip(*held, strict=True)))]
                    size = len(held[0][0]) // 2
        if held:
            yield bits(now, *map(np.concatenate, zip(*held, strict=True)))
        release()

    parts = docs.select(lang, text).mapInArrow(count, "slice int, keys binary, counts binary").repartition("slice").sortWithinPartitions("slice").mapInArrow(merge, "slice int, bits binary")
    out = np.zeros(1 << (p.bits - 3), np.uint8)
    for r in stored(parts, "frequent_hashes").collect():  # 2**bits bits in all
        size = 1 << (p.bits - 3 - k)
        out[r.slice * size : (r.slice + 1) * size] = np.frombuffer(r.bits, np.uint8)
    return out


def _marked(bits: np.ndarray, keys: np.ndarray, p: PhraseParams) -> np.ndarray:
    at = (keys >> np.uint64(64 - p.bits)).astype(np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


# Step 2


def range_bounds(docs: DataFrame, lang: str, text: str, n_docs: int, p: PhraseParams) -> list[Key]:
    """Keys that cut the n-grams into about even ranges, from a sample of bounded size."""
    n = p.ranges or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out = []
            for block, langs, seeds in _blocks(b, lang, text):
                g = Grams(block, seeds, 1)
                for i in range(len(block)):
                    lo, hi = np.searchsorted(g.doc, [i, i + 1])
                    for at in np.unique(np.linspace(lo, max(hi - 4, lo), 20).astype(int)) if hi > lo else ():
                        out.append([langs[i], *(g.word(j)[:40] for j in range(at, min(at + 4, hi)))])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.binary()))], ["k"])

    some = docs.select(lang, text).sample(fraction=min(1.0, p.sample_docs / max(n_docs, 1)), seed=7)
    keys = sorted(tuple(bytes(x) for x in r.k) for r in some.mapInArrow(pick, "k array<binary>").limit(60 * p.sample_docs).collect())
    return sorted({keys[len(keys) * i // n] for i in range(1, n)}) if keys else []


def _shards(docs: DataFrame, lang: str, text: str, sent, bounds: list[Key], p: PhraseParams) -> DataFrame:
    """(range, blob) transducers of each task, and (lang, n) numbers of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[int, bytes] = {}
        seeds_of: dict[int, bytes] = {}
        total: dict[bytes, int] = {}
        held, size = [], 0

        def reduced(rows: list[np.ndarray]) -> np.ndarray:
            """Rows (hash, seed, words..., count) of equal n-grams summed."""
            r = np.concatenate(rows)
            r = r[np.argsort(r[:, 0], kind="stable")]
            same = r[1:, 0] == r[:-1, 0]
            if (same & (r[1:, 1:-1] != r[:-1, 1:-1]).any(1)).any():  # two n-grams with one hash
                r = r[np.lexsort(r[:, :-1].T[::-1])]
                same = (r[1:, :-1] == r[:-1, :-1]).all(1)
            first = np.flatnonzero(np.concatenate(([True], ~same)))
            out = r[first]
            out[:, -1] = np.add.reduceat(r[:, -1], first)
            return out

        def emit(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            keys = []
            for _, seed, *rest in rows.tolist():
                keys.append(((seeds_of[seed], *(names[w] for w in rest[:-1] if w)), rest[-1]))
            keys.sort()
            at, ids, blobs = 0, [], []
            while at < len(keys):
                i = bisect_right(bounds, keys[at][0])
                end = at
                while end < len(keys) and (i == len(bounds) or keys[end][0] < bounds[i]):
                    end += 1
                ids.append(i)
                blobs.append(build(keys[at:end]).pack())
                at = end
            none = [None] * len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(blobs, pa.binary()), pa.array(none, pa.string()), pa.array(none, pa.int64())], ["range", "blob", "lang", "n"])

        for b in slices(batches):
            for block, langs, seeds in _blocks(b, lang, text):
                g = Grams(block, seeds, p.longest)
                seeds_of.update(zip(seeds.tolist(), langs, strict=True))
                each = np.bincount(g.doc, minlength=len(block))
                for x, c in zip(langs, each.tolist(), strict=True):
                    total[x] = total.get(x, 0) + c
                ok = _passing(g, sent.value, p.longest, p)
                known, at = np.unique(np.where(ok[1], g.h, g.h[:1] if len(g.h) else 0), return_index=True)
                for w, i in zip(known.tolist(), at.tolist(), strict=True):
                    if w not in names:
                        names[w] = g.word(i)
                rows = []
                for n in range(1, p.longest + 1):
                    i = np.flatnonzero(ok[n])
                    r = np.zeros((len(i), p.longest + 3), np.uint64)
                    r[:, 0], r[:, 1], r[:, -1] = g.g[n][i], seeds[g.doc[i]], 1
                    for j in range(n):
                        r[:, 2 + j] = g.h[i + j]
                    rows.append(r)
                held.append(reduced(rows)) if len(g.h) else None
                size += len(held[-1]) if len(g.h) else 0
                if size > p.buffer:
                    held = [reduced(held)]
                    size = len(held[0])
                    if size > p.buffer // 2:
                        yield from emit(held[0])
                        held, size, names = [], 0, {}
        if held:
            yield from emit(reduced(held))
        yield pa.RecordBatch.from_arrays([pa.array([None] * len(total), pa.int32()), pa.array([None] * len(total), pa.binary()), pa.array([unlabel(x) for x in total], pa.string()), pa.array(list(total.values()), pa.int64())], ["range", "blob", "lang", "n"])
        release()

    return docs.select(lang, text).mapInArrow(run, "range int, blob binary, lang string, n long")


def _united(shards: DataFrame, p: PhraseParams) -> DataFrame:
    """(range, blob) of the transducer of each range over all tasks, without n-grams below the least count, and (lang, phrase, words, a) of each n-gram in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(i: int, held: list) -> Iterator[pa.RecordBatch]:
            keys = [(k, c) for k, c in union(held) if c >= p.least]
            n = len(keys)
            arrays = [[i] + [None] * n, [build(keys).pack()] + [None] * n, [None] + [unlabel(k[0]) for k, _ in keys], [None] + [b" ".join(k[1:]).decode("utf-8", "surrogatepass") for k, _ in keys], [None] + [len(k) - 1 for k, _ in keys], [None] + [c for _, c in keys]]
            types = [pa.int32(), pa.binary(), pa.string(), pa.string(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(arrays, types, strict=True)], ["range", "blob", "lang", "phrase", "words", "a"])

        now, held = None, []
        for b in batches:
            for i, blob in zip(column(b, "range"), column(b, "blob"), strict=True):
                if i != now and held:
                    yield from out(now, held)
                    held = []
                now = i
                held.append(Automaton.unpack(blob))
                if len(held) == 32:
                    held = [build(union(held))]
        if held:
            yield from out(now, held)
        release()

    return shards.repartition("range").sortWithinPartitions("range").mapInArrow(run, "range int, blob binary, lang string, phrase string, words int, a long")


# Step 3


def _part_counts(frequent: DataFrame, bounds: list[Key], p: PhraseParams) -> DataFrame:
    """(lang, phrase, a, k, l, r) for each cut of each candidate after k words."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 5000):
            rows = []
            for lang, phrase, a in zip(column(b, "lang"), column(b, "phrase"), column(b, "a"), strict=True):
                words = phrase.split(" ")
                for k in range(1, len(words)):
                    for side, part in ((0, words[:k]), (1, words[k:])):
                        key = (label(lang), *(w.encode("utf-8", "surrogatepass") for w in part))
                        rows.append((bisect_right(bounds, key), zlib.crc32(phrase.encode("utf-8", "surrogatepass")) % p.salts, lang, " ".join(part), phrase, a, k, side))
            cols = list(zip(*rows, strict=True)) or [()] * 8
            types = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["range", "salt", "lang", "part", "phrase", "a", "k", "side"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = None
        for b in batches:
            for at in range(0, b.num_rows, 20_000):
                s = b.slice(at, 20_000)
                rows = s.to_pylist()
                out, lo = [], 0
                while lo < len(rows):
                    if rows[lo]["blob"] is not None:
                        counts = Automaton.unpack(rows[lo]["blob"])
                        lo += 1
                        continue
                    hi = lo
                    while hi < len(rows) and rows[hi]["blob"] is None:
                        hi += 1
                    asked: dict[Key, list] = {}
                    for r in rows[lo:hi]:
                        asked.setdefault((label(r["lang"]), *(w.encode("utf-8", "surrogatepass") for w in r["part"].split(" "))), []).append(r)
                    keys = sorted(asked)
                    for i, f in compose(build((key, i + 1) for i, key in enumerate(keys)), counts):
                        out += [(r["lang"], r["phrase"], r["a"], r["k"], r["side"], f) for r in asked[keys[i - 1]]]
                    lo = hi
                cols = list(zip(*out, strict=True)) or [()] * 6
                types = [pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["lang", "phrase", "a", "k", "side", "f"])
        release()

    asked = frequent.where("words > 1").select("lang", "phrase", "a").mapInArrow(ask, "range int, salt int, lang string, part string, phrase string, a long, k int, side int")
    blobs = frequent.where("blob is not null").select("range", F.explode(F.sequence(F.lit(0), F.lit(p.salts - 1))).alias("salt"), "blob")
    both = blobs.unionByName(asked, allowMissingColumns=True).repartition("range", "salt").sortWithinPartitions("range", "salt", F.col("blob").isNull(), "lang", "part")
    found = both.mapInArrow(answer, "lang string, phrase string, a long, k int, side int, f long")
    return found.repartition("lang", "phrase").groupBy("lang", "phrase", "a", "k").agg(F.max(F.when(F.col("side") == 0, F.col("f"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("f"))).alias("r"))


def exact_score() -> Column:
    """floor(2000000 a / (l + r)) of long columns, in decimals: the product may pass 64 bits."""
    return F.expr("cast((cast(a as decimal(25,0)) * cast(2000000 as decimal(7,0))) div (cast(l as decimal(25,0)) + cast(r as decimal(25,0))) as bigint)")


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", p: PhraseParams = PhraseParams()) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of each language.

    Texts are lower-cased (A-Z), cut into pieces at ``.,;:!?`` and line breaks, and these into words at spaces and tabs; phrases
    lie within a piece. a, l and r are occurrences of the phrase and of its parts at the lowest-scoring cut, n all words of the
    language, score = floor(2000000 a / (l + r)) in exact decimals; ties by a, then by the phrase in byte order. Null languages
    are ``und``; null, empty and wordless texts have no words; each of several equal rows counts. Other columns are ignored. No phrase: no rows.
    """
    n_docs = docs.count()
    context, maps = docs.sparkSession.sparkContext, []
    for orders in ((1, 2), tuple(range(3, p.longest + 1))):
        if orders:
            maps.append(frequent_map(docs, lang, text, n_docs, orders, context.broadcast(list(maps)), p))
    sent = context.broadcast(maps)
    bounds = range_bounds(docs, lang, text, n_docs, p)
    shards = stored(_shards(docs, lang, text, sent, bounds, p), "shards")
    frequent = stored(_united(shards.where("range is not null").select("range", "blob"), p), "counts")
    cuts = _part_counts(frequent, bounds, p)
    big = lambda c: F.col(c).cast("decimal(38,0)")
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(exact_score().alias("score"), "k", "l", "r")).alias("c")).select("lang", "phrase", "a", "c.*")

    words = F.split("phrase", " ")
    spans = [F.struct(F.array_join(F.slice(words, i, m), " ").alias("phrase"), (F.lit(i + m - 1) <= F.col("words")).alias("ok")) for m in range(2, p.longest) for i in range(1, p.longest - m + 2)]
    inner = frequent.where("words > 2").select("lang", "a", "words", F.explode(F.array(*spans)).alias("s")).where(F.col("s.ok") & (F.size(F.split("s.phrase", " ")) < F.col("words")))
    around = inner.groupBy("lang", F.col("s.phrase").alias("phrase")).agg(F.max("a").alias("longer"))
    kept = best.join(around, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (big("longer") * 100 < big("a") * p.nested_percent))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    totals = shards.where("lang is not null").groupBy("lang").agg(F.sum("n").alias("n"))
    ranked = kept.withColumn("rank", rank).where(F.col("rank") <= p.top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_phrase_collocations(spark, sf_dir: str) -> DataFrame:
    """The 2000 best phrases of each language of ``documents``; see ``collocations``."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "text"))


ORACLE = r"""
WITH pieces AS (
  SELECT row_number() OVER () AS r, lang, ws FROM (
    SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS ws FROM documents)),
totals AS (SELECT lang, sum(length(ws)) AS n FROM pieces GROUP BY lang),
ats AS (SELECT lang, ws, m, unnest(range(1, length(ws) - m + 2)) AS i FROM pieces, (SELECT unnest([1, 2, 3, 4]) AS m) WHERE length(ws) >= m),
f AS (SELECT lang, ws[i:i + m - 1] AS p, m, count(*)::HUGEINT AS a FROM ats GROUP BY ALL HAVING count(*) >= 30),
cuts AS (SELECT lang, p, m, a, unnest(range(1, m)) AS k FROM f WHERE m > 1),
scored AS (SELECT c.lang, c.p, c.a, k, x.a AS l, y.a AS r, (2000000 * c.a) // (x.a + y.a) AS score FROM cuts c JOIN f x ON x.lang = c.lang AND x.p = c.p[1:k] JOIN f y ON y.lang = c.lang AND y.p = c.p[k + 1:]),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
subs AS (SELECT lang, a, p, m, len, unnest(range(1, m - len + 2)) AS i FROM f, (SELECT unnest([2, 3]) AS len) WHERE len < m),
longer AS (SELECT lang, p[i:i + len - 1] AS q, max(a) AS longer FROM subs GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN longer s ON s.lang = b.lang AND s.q = b.p WHERE s.longer IS NULL OR 100 * s.longer < 80 * b.a),
ranked AS (SELECT *, array_to_string(p, ' ') AS phrase, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(p, ' ')) AS rank FROM kept)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
