"""Byte-level BPE encoding and decoding with a rank queue in a hierarchical bitmap.

For one pre-token the symbols form a linked list. Every adjacent pair with a rank lies in the bucket of
that rank; a two-level bitmap over the ranks tells which buckets hold entries, and find-first-set gives
the next rank to merge. Merging leaves old entries behind; they are recognised as stale and skipped when
they come up. A pre-token of n bytes takes O(n log n) steps however long it is.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from functools import partial
from pathlib import Path

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, types as T

from .runs import Chars, RunTable, char_blocks, gathered, per_text
from .textvec import column, slices

DEFAULT_RANKS = "byte_bpe_50k.tiktoken"

_LEAF = 8  # a leaf of the bitmap has 2**_LEAF ranks
_LOW = (1 << _LEAF) - 1
_TOGETHER = 1 << 20  # bytes of pre-tokens that share a queue, unless one alone is longer


class Merger:
    """Merges pre-tokens by a rank table. Many of them lie end to end in one buffer and share one queue; no pair
    crosses from one to the next, so each is merged as if alone: always the leftmost pair of its lowest rank."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.single = np.array([ranks.get(bytes([i]), -1) for i in range(256)], np.int64)
        self.joined = {}  # left rank and right rank to the rank of both together
        for whole, r in ranks.items():
            for cut in range(1, len(whole)):
                a, b = ranks.get(whole[:cut]), ranks.get(whole[cut:])
                if a is not None and b is not None:
                    self.joined[a << 32 | b] = r
        self.pair = np.array([ranks.get(bytes([i, j]), -1) for i in range(256) for j in range(256)], np.int64)

    def merge(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Token ids (int32) of each piece."""
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(pieces)
        group: list[int] = []
        size = 0
        for i, p in enumerate(pieces):
            whole = self.ranks.get(p)
            if whole is not None:
                out[i] = np.array([whole], np.int32)
            elif p:
                if size + len(p) > _TOGETHER and group:
                    self._run(pieces, group, out)
                    group, size = [], 0
                group.append(i)
                size += len(p)
        if group:
            self._run(pieces, group, out)
        return out

    def _run(self, pieces: list[bytes], group: list[int], out: list[np.ndarray]) -> None:
        buf = b"".join(pieces[i] for i in group)
        n = len(buf)
        sizes = np.array([len(pieces[i]) for i in group])
        stops = np.cumsum(sizes)
        limit = np.repeat(stops, sizes).tolist()  # where the piece of a position ends
        end = list(range(1, n + 1))  # the symbol at i is buf[i:end[i]]; the next one starts at end[i]
        links = np.arange(-1, n)
        links[stops - sizes] = -1
        before = links.tolist()
        raw = np.frombuffer(buf, np.uint8).astype(np.int64)
        token = self.single[raw].tolist()
        first = np.full(n, -1)
        first[:-1] = self.pair[raw[:-1] << 8 | raw[1:]]
        first[stops - 1] = -1
        current = first.tolist()  # the rank under which a position counts; entries under another rank are stale
        alive = bytearray(b"\1") * n

        buckets: dict[int, list[int]] = {}
        leaves: dict[int, int] = {}
        top = 0
        order = np.argsort(first, kind="stable")
        order = order[np.searchsorted(first[order], 0) :]
        for part in np.split(order, np.flatnonzero(np.diff(first[order])) + 1) if len(order) else ():
            r = int(first[part[0]])
            buckets[r] = part.tolist()
            leaves[r >> _LEAF] = leaves.get(r >> _LEAF, 0) | 1 << (r & _LOW)
            top |= 1 << (r >> _LEAF)
        pair = self.joined.get
        while top:
            high = (top & -top).bit_length() - 1
            leaf = leaves[high]
            r = high << _LEAF | (leaf & -leaf).bit_length() - 1
            bucket = buckets.pop(r)
            if len(bucket) > 1:
                bucket.sort()
            leaf &= leaf - 1
            leaves[high] = leaf
            if not leaf:
                top &= top - 1
            waits, later = -1, []
            for i in bucket:
                if current[i] != r:
                    continue
                if limit[i] == waits:
                    later.append(i)
                    continue
                j = end[i]
                stop = end[i] = end[j]
                token[i] = r
                current[j] = -1
                alive[j] = 0
                new = None
                if stop < limit[i]:
                    before[stop] = i
                    new = pair(r << 32 | token[stop])
                if new is None:
                    current[i] = -1
                else:
                    current[i] = new
                    if new < r:  # a lower rank came up: the rest of this piece waits
                        waits = limit[i]
                    if new in buckets:
                        buckets[new].append(i)
                    else:
                        buckets[new] = [i]
                        leaves[new >> _LEAF] = leaves.get(new >> _LEAF, 0) | 1 << (new & _LOW)
                        top |= 1 << (new >> _LEAF)
                at = before[i]
                if at >= 0:
                    new = pair(token[at] << 32 | r)
                    if new is None:
                        current[at] = -1
                    else:
                        current[at] = new
                        if new < r:
                            waits = limit[i]
                        if new in buckets:
                            buckets[new].append(at)
                        else:
                            buckets[new] = [at]
                            leaves[new >> _LEAF] = leaves.get(new >> _LEAF, 0) | 1 << (new & _LOW)
                            top |= 1 << (new >> _LEAF)
            if later:
                buckets[r] = buckets.get(r, []) + later
                leaves[r >> _LEAF] = leaves.get(r >> _LEAF, 0) | 1 << (r & _LOW)
                top |= 1 << (r >> _LEAF)
        kept = np.flatnonzero(np.frombuffer(alive, np.uint8))
        ids = np.array(token, np.int32)[kept]
        for i, part in zip(group, np.split(ids, np.searchsorted(kept, stops[:-1])), strict=True):
            out[i] = part


def _tiles(block: Chars) -> np.ndarray:
    """Where to cut each text so that no match of the public pattern crosses a cut: before a run of other characters
    than white space and one space before it, before the last of several white characters, and between Latin letters
    that start such a run and an ASCII sign."""
    new, white, kind = block.text_starts(), block.white(), block.kind()
    cut = new.copy()
    if len(white):
        follows = ~white[1:] & white[:-1] & ~new[1:]  # a run after white space: the space goes with it, other white space alone
        space = block.cp[:-1] == 32
        cut[:-1] |= follows
        cut[1:] |= follows & ~space
        cut[1:] |= white[1:] & ~white[:-1]
        head = kind == 1  # letters from the start of a run on
        turn = (kind[1:] == 2) & head[:-1] & ~new[1:]
        broken = np.concatenate(([0], np.cumsum(~head)))
        starts = np.flatnonzero(new | np.concatenate(([True], white[:-1])))
        at = np.flatnonzero(turn) + 1
        first = starts[np.searchsorted(starts, at - 1, side="right") - 1]
        cut[at[broken[at] == broken[first]]] = True
    return np.flatnonzero(cut)


class Strings:
    """Byte strings by id, end to end, so that those of many ids are gathered at once."""

    def __init__(self, known: dict[int, bytes]):
        self.size = np.full(max(known, default=-1) + 1, -1, np.int64)
        self.size[list(known)] = [len(x) for x in known.values()]
        self.start = np.zeros(len(self.size), np.int64)
        self.start[list(known)] = np.cumsum([0, *[len(x) for x in known.values()]])[:-1]
        self.raw = np.frombuffer(b"".join(known.values()), np.uint8)

    def join(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[bytes, np.ndarray]:
        """(the strings of ``ids`` end to end, where those of ``bounds`` start). An id without a string is an error."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.size) or (self.size[ids] < 0).any()):
            raise ValueError("an id is not in the vocabulary")
        size = self.size[ids]
        return gathered(self.raw, self.start[ids], size).tobytes(), np.concatenate(([0], np.cumsum(size)))[bounds]


class Codec:
    """Encoder and decoder for one rank file. Short runs of text are looked up in a bounded table, so a merge runs
    about once for each different run in a task's texts."""

    def __init__(self, path: str, pattern: str):
        lines = Path(path).read_bytes().splitlines()
        self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x)}
        self.bytes = Strings({v: k for k, v in self.ranks.items()})
        self.decimals = Strings({v: b"%d " % v for v in self.ranks.values()})
        self.merger = Merger(self.ranks)
        white = lambda p: p.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
        self.pieces = regex.compile(white(pattern)).findall
        # A text can be cut first only if the pattern is the one that the cuts are made for.
        self.by_run = pattern == public_tokenizers.PATTERN
        self.table = RunTable(self._encode_runs)

    def _encode_runs(self, runs: list[str]) -> list[np.ndarray]:
        split = [self.pieces(r) for r in runs]
        place = {p: i for i, p in enumerate(dict.fromkeys(p for s in split for p in s))}
        ids = self.merger.merge([p.encode("utf-8", "replace") for p in place])
        none = np.zeros(0, np.int32)
        return [ids[place[s[0]]] if len(s) == 1 else np.concatenate([ids[place[p]] for p in s]) if s else none for s in split]

    def encode_blocks(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids of several texts end to end, bounds of each text's); null and empty texts have none."""
        for block in char_blocks(texts):
            starts = _tiles(block) if self.by_run else np.flatnonzero(block.text_starts())
            ends = np.append(starts[1:], len(block.cp)) if len(starts) else starts
            ids, sizes = self.table.ids(block, block.cp, starts, ends)
            yield ids, per_text(block, starts, sizes)

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        return [ids[a:b] for ids, at in self.encode_blocks(texts) for a, b in zip(at[:-1], at[1:], strict=True)]

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_all([text])[0]

    def decode_all(self, ids: pa.ListArray) -> list[bytes]:
        """The bytes of each list of ids; a null list counts as empty."""
        bounds = np.concatenate(([0], np.cumsum(ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))))
        raw, at = self.bytes.join(ids.flatten().to_numpy(zero_copy_only=False), bounds)
        return [raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]

    def digests(self, texts: list[str | None]) -> Iterator[tuple[int, str, str]]:
        """(number of ids, SHA-256 of the decimal ids with a space between them, SHA-256 of the decoded bytes) of each text."""
        for ids, at in self.encode_blocks(texts):
            names, n = self.decimals.join(ids, at)
            raw, r = self.bytes.join(ids, at)
            names, raw = memoryview(names), memoryview(raw)
            for i in range(len(at) - 1):
                yield int(at[i + 1] - at[i]), hashlib.sha256(names[n[i] : max(n[i], n[i + 1] - 1)]).hexdigest(), hashlib.sha256(raw[r[i] : r[i + 1]]).hexdigest()


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str | None, pattern: str | None) -> Codec:
    """One codec per worker process; ``path`` None means the public file of that name on the worker."""
    key = (path or public_tokenizers.path(DEFAULT_RANKS), pattern or public_tokenizers.PATTERN)
    if key not in _codecs:
        _codecs[key] = Codec(*key)
    return _codecs[key]


def _mapped(df: DataFrame, out: str, kind: T.DataType, f: Callable[[pa.RecordBatch], pa.Array]) -> DataFrame:
    base = df.drop(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 512):
                part = b.slice(start, 512)
                yield pa.RecordBatch.from_arrays([*part.columns, f(part)], [*part.schema.names, out])

    return base.mapInArrow(run, T.StructType([*base.schema, T.StructField(out, kind)]))


def _encode(batch: pa.RecordBatch, text: str, path: str | None, pattern: str | None) -> pa.Array:
    ids = codec(path, pattern).encode_all(column(batch, text))
    offsets = np.concatenate(([0], np.cumsum([len(i) for i in ids]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))


def _decode(batch: pa.RecordBatch, ids: str, path: str | None, pattern: str | None) -> pa.Array:
    lists = batch.column(batch.schema.get_field_index(ids))
    return pa.array(codec(path, pattern).decode_all(lists), pa.binary())


def encode(df: DataFrame, text: str = "text", out: str = "ids", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Adds the token ids (array of int) of every whole text; null and empty texts get an empty array.
    A column already called ``out`` is replaced. Special tokens are not recognised: they are ordinary text."""
    return _mapped(df, out, T.ArrayType(T.IntegerType()), partial(_encode, text=text, path=path, pattern=pattern))


def decode(df: DataFrame, ids: str = "ids", out: str = "decoded", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Adds the bytes (binary) that the ids stand for; null counts as no ids. An unknown id is an error."""
    return _mapped(df, out, T.BinaryType(), partial(_decode, ids=ids, path=path, pattern=pattern))


def digests(df: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every whole text: encoded, then decoded, in one pass, so that
    neither texts nor ids go back through the JVM."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            n, ids, decoded = zip(*codec(path, pattern).digests(column(b, text)), strict=True)
            arrays = [b.column(b.schema.get_field_index(doc_id)), pa.array(n, pa.int64()), pa.array(ids), pa.array(decoded)]
            yield pa.RecordBatch.from_arrays(arrays, [doc_id, "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = df.select(doc_id, text)
    out = T.StructType([rows.schema[0], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    return rows.mapInArrow(run, out)


def op7_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
