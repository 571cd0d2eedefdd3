"""Substring dedup: windows of words that occur twice are found in super-k-mers, dealt out by their minimisers.

The minimiser of a window is its least 3-word gram, the rarest first. Consecutive windows with the same minimiser travel
as one packed string (their words joined by one space) to the bucket of that minimiser; equal windows have the same
minimiser, so each bucket sorts and counts its windows by itself. How common a gram is comes from a table of counts of
fixed size, addressed by hash: a passage that many documents quote has no rare gram of its own, so windows that reach
over its edge go to buckets of the text around it. The order decides only where windows meet, never the result.

Equal strings of a task travel twice at most, which is enough to know that their windows repeat. Buckets answer with the
strings that have repeated windows; these are joined with the places of the strings, found by reading the texts again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .jaccard import JoinParams, classes, count_table
from .scratch import drop, small_enough, stored
from .textvec import Block, _power, blocks, column, mix, release, slices, words


@dataclass(frozen=True)
class WindowParams:
    """``words``: length of a window. ``gram``: words of a minimiser. ``table_bits``: the count table has 2**table_bits slots of
    a byte. ``bucket_bytes``: packed bytes of whole buckets that are counted at a time. ``sent``: strings a task
    remembers to have sent. ``broadcast_rows``, ``broadcast_spans``: bounds of what is broadcast."""

    words: int = 35
    gram: int = 3
    table_bits: int = 24
    bucket_bytes: int = 1 << 20
    sent: int = 100_000
    broadcast_rows: int = 500_000
    broadcast_spans: int = 4_000_000


_SEEDS = (np.uint64(0x6A09E667F3BCC909), np.uint64(0xBB67AE8584CAA73B))


def _ranks(h: np.ndarray, order: np.ndarray, p: WindowParams) -> np.ndarray:
    """For each window of words (by their hashes, of a block) its least gram: the class of its count, then its hash."""
    k = len(h) - p.gram + 1
    grams = np.zeros(k, np.uint64)
    for j in range(p.gram):
        grams = grams * np.uint64(0xD6E8FEB86659FD93) + h[j : j + k]
    grams = mix(grams)
    least = (order[(grams & np.uint64(len(order) - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (mix(grams) >> np.uint64(8))
    wide, width = p.words - p.gram + 1, 1
    while width * 2 <= wide:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    return np.minimum(least[: len(least) - (wide - width)], least[wide - width :])


def packed(block: Block, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of a block joined by one space, and where each begins (with the end of all): word i is [at[i], at[i + 1] - 1)."""
    keep = np.zeros(len(block.raw) + 1, np.int8)
    keep[starts] += 1
    keep[np.minimum(ends + 1, len(block.raw))] -= 1
    keep = np.cumsum(keep[:-1], dtype=np.int8).view(bool)
    raw = block.raw.copy()
    raw[ends] = 32
    return raw[keep], np.concatenate(([0], np.cumsum(ends - starts + 1)))


def super_kmers(block: Block, order: np.ndarray, p: WindowParams) -> Iterator[tuple[int, int, int, bytes]]:
    """(text index, its first window, minimiser, packed string) of every run of windows with one minimiser."""
    h, doc, starts, ends = words(block, True)
    if len(h) < p.words:
        return
    least = _ranks(h, order, p)
    whole = doc[: len(least)] == doc[p.words - 1 :]
    new = whole.copy()
    new[1:] &= ~whole[:-1] | (least[1:] != least[:-1])
    first = np.flatnonzero(new)
    stop = whole.copy()
    stop[:-1] &= ~whole[1:] | new[1:]
    last = np.flatnonzero(stop)
    raw, at = packed(block, starts, ends)
    raw = raw.tobytes()
    own = np.searchsorted(doc, np.arange(len(block)))
    d = doc[first]
    for i, f, m, a, b in zip(d.tolist(), (first - own[d]).tolist(), least[first].view(np.int64).tolist(), at[first].tolist(), (at[last + p.words] - 1).tolist(), strict=True):
        yield i, f, m, raw[a:b]


def digest(s: bytes) -> bytes:
    return hashlib.blake2b(s, digest_size=16).digest()


def _strings(docs: DataFrame, text: str, sent, p: WindowParams) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, seen = sent.value, {}
        for b in slices(batches):
            for block in blocks(column(b, text)):
                keys, found = [], []
                for _, _, m, s in super_kmers(block, order, p):
                    name = digest(s)
                    times = seen.get(name, 0)
                    if times < 2:
                        seen[name] = times + 1
                        keys.append(m)
                        found.append(s)
                if len(seen) > p.sent:
                    seen = {}
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(found, pa.binary())], ["bucket", "packed"])

    return docs.select(text).mapInArrow(run, "bucket long, packed binary")


def _sums(h: np.ndarray, n: int, seed: np.uint64) -> np.ndarray:
    """A 64-bit hash of every window of n words."""
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(mix(h ^ seed) * _power("up", len(h)), out=total[1:])
    return mix((total[n:] - total[:-n]) * _power("down", len(h))[: len(h) - n + 1])


def repeated_windows(strings: list[bytes], times: np.ndarray, p: WindowParams) -> Iterator[tuple[int, list[int]]]:
    """(index, [from, to, from, to, ...]) of the strings with windows that occur more than once in all of them; ``times``: how
    often each string occurs. Windows are equal if two hashes of 64 bits over the hashes of their words are."""
    raw = np.frombuffer(b"\n".join(strings) + b"\n", np.uint8)
    bounds = np.concatenate(([0], np.cumsum([len(s) + 1 for s in strings]))).astype(np.int64)
    h, of, _, _ = words(Block(raw, bounds), False)
    start = np.flatnonzero(of[: len(h) - p.words + 1] == of[p.words - 1 :])
    one, two = (_sums(h, p.words, s)[start] for s in _SEEDS)
    order = np.argsort(one, kind="stable")
    a, b = one[order], two[order]
    if ((a[1:] == a[:-1]) & (b[1:] != b[:-1])).any():
        order = np.lexsort((two, one))
        a, b = one[order], two[order]
    new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
    total = np.add.reduceat(times[of[start[order]]], np.flatnonzero(new))
    flag = np.zeros(len(start), bool)
    flag[order] = (total >= 2)[np.cumsum(new) - 1]
    own = of[start]
    first = np.searchsorted(own, np.arange(len(strings)))  # each string has a window
    edge = np.concatenate(([True], own[1:] != own[:-1]))
    begin = np.flatnonzero(flag & (edge | ~np.concatenate(([False], flag[:-1]))))
    end = np.flatnonzero(flag & (np.concatenate((edge[1:], [True])) | ~np.concatenate((flag[1:], [False])))) + 1
    spans: dict[int, list[int]] = {}
    for i, x, y in zip(own[begin].tolist(), (begin - first[own[begin]]).tolist(), (end - first[own[begin]]).tolist(), strict=True):
        spans.setdefault(i, []).extend((x, y))
    yield from spans.items()


def _counted(strings: DataFrame, p: WindowParams) -> DataFrame:
    """(digest, spans): every distinct string with repeated windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def count(held: dict[bytes, int]) -> pa.RecordBatch:
            names = list(held)
            got = list(repeated_windows(names, np.fromiter(held.values(), np.int64, len(names)), p)) if names else []
            return pa.RecordBatch.from_arrays([pa.array([digest(names[i]) for i, _ in got], pa.binary()), pa.array([s for _, s in got], pa.list_(pa.int32()))], ["digest", "spans"])

        held, size, now = {}, 0, None
        for b in slices(batches, 2000):
            for key, s in zip(column(b, "bucket"), column(b, "packed"), strict=True):
                if key != now and size > p.bucket_bytes:
                    yield count(held)
                    held, size = {}, 0
                now = key
                if s not in held:
                    size += len(s)
                held[s] = held.get(s, 0) + 1
        yield count(held)

    return strings.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "digest binary, spans array<int>")


def _places(docs: DataFrame, text: str, sent, p: WindowParams) -> DataFrame:
    """(digest, k1, k2, first) of every super-k-mer of every text, by the text's keys; a task names equal texts once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, seen = sent.value, set()
        for b in slices(batches):
            k1, k2, texts = column(b, "k1"), column(b, "k2"), column(b, text)
            fresh = []
            for i, k in enumerate(zip(k1, k2, strict=True)):
                if k not in seen:
                    seen.add(k)
                    fresh.append(i)
            if len(seen) > p.sent:
                seen = set()
            at = 0
            for block in blocks([texts[i] for i in fresh]):
                found = [(digest(s), fresh[at + i], f) for i, f, _, s in super_kmers(block, order, p)]
                at += len(block)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x for x, _, _ in found], pa.binary()), pa.array([k1[i] for _, i, _ in found], pa.int64()), pa.array([k2[i] for _, i, _ in found], pa.int64()), pa.array([f for _, _, f in found], pa.int32())],
                    ["digest", "k1", "k2", "first"],
                )

    return docs.select("k1", "k2", text).mapInArrow(run, "digest binary, k1 long, k2 long, first int")


def _kept(block: Block, spans: list, p: WindowParams) -> Iterator[tuple[int, int, bytes]]:
    """(words, words removed, kept words joined by one space) of each text of a block, given its repeated windows."""
    _, doc, starts, ends = words(block, False)
    raw, at = packed(block, starts, ends)
    cut = np.searchsorted(doc, np.arange(len(block) + 1))
    for i, ws in enumerate(spans):
        lo, hi = int(cut[i]), int(cut[i + 1])
        gone = np.zeros(hi - lo + 1, np.int64)
        if ws is not None and len(ws):
            w = np.asarray(ws, np.int64)
            np.add.at(gone, w[::2], 1)
            np.add.at(gone, np.minimum(w[1::2] + p.words - 1, hi - lo), -1)
        keep = np.cumsum(gone)[:-1] == 0
        part = raw[at[lo] : at[hi]]
        if not keep.all():
            part = part[np.repeat(keep, np.diff(at[lo : hi + 1]))]
        yield hi - lo, int((~keep).sum()), part[:-1].tobytes()


def without_repeats(docs: DataFrame, text: str = "text", p: WindowParams = WindowParams(), keep_text: bool = False) -> DataFrame:
    """``docs`` without ``text``, with n_words, n_removed and kept_sha256 (of the kept words joined by one space, UTF-8), and
    with ``keep_text`` also these as kept_text. Columns of these names are replaced.

    Words are maximal runs of other characters than space and TAB to CR, compared as they are. Null, empty and wordless
    texts have 0 words; texts shorter than a window keep all. Rows are told apart by nothing: equal texts, whatever
    their ids (which may repeat or be null), lose the same words.
    """
    order = classes(count_table(docs, text, JoinParams(words=p.gram, table_bits=p.table_bits)))
    sent = docs.sparkSession.sparkContext.broadcast(order)
    flagged = stored(_counted(_strings(docs, text, sent, p), p), "repeated_strings")
    keyed = docs.withColumn("k1", F.when(F.col(text).isNotNull(), F.xxhash64(text))).withColumn("k2", F.when(F.col(text).isNotNull(), F.xxhash64(F.lit(11), text)))
    side = F.broadcast(flagged) if small_enough(flagged, p.broadcast_rows) else flagged
    places = _places(keyed.where(F.col(text).isNotNull()), text, sent, p)
    hits = places.join(side, "digest").select("k1", "k2", F.struct("first", F.transform("spans", lambda x: x + F.col("first")).alias("s")).alias("hit"))
    cover = stored(hits.groupBy("k1", "k2").agg(F.flatten(F.collect_set("hit.s")).alias("_spans")), "windows")
    drop(flagged)
    side = cover
    if small_enough(cover, p.broadcast_rows) and (cover.agg(F.sum(F.size("_spans"))).first()[0] or 0) <= p.broadcast_spans:
        side = F.broadcast(cover)
    others = [c for c in docs.columns if c not in (text, "n_words", "n_removed", "kept_sha256", "kept_text", "_spans", "k1", "k2")]
    joined = keyed.join(side, ["k1", "k2"], "left").select(*others, F.col(text).alias("_text"), "_spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            n, removed, hashes, kept = [], [], [], []
            spans, at = column(b, "_spans"), 0
            for block in blocks(column(b, "_text")):
                for x, y, s in _kept(block, spans[at : at + len(block)], p):
                    n.append(x)
                    removed.append(y)
                    hashes.append(hashlib.sha256(s).hexdigest())
                    if keep_text:
                        kept.append(s.decode("utf-8", "surrogatepass"))
                at += len(block)
            made = [pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(hashes, pa.string())] + ([pa.array(kept, pa.string())] if keep_text else [])
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(others))), *made], [*others, *made_names])

    made_names = ["n_words", "n_removed", "kept_sha256"] + (["kept_text"] if keep_text else [])
    schema = docs.select(*others).schema
    for name in made_names:
        schema = schema.add(name, "long" if name.startswith("n_") else "string")
    return joined.mapInArrow(run, schema)


def op11_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every document; see ``without_repeats``."""
    return without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


ORACLE = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
starts AS (SELECT r, ws, unnest(range(1, greatest(length(ws) - 33, 1))) AS i FROM d),
wins AS (SELECT r, i, array_to_string(ws[i:i + 34], ' ') AS w FROM starts),
twice AS (SELECT w FROM wins GROUP BY w HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS j FROM wins WHERE w IN (SELECT w FROM twice)),
each AS (SELECT r, list(j) AS js FROM gone GROUP BY r)
SELECT doc_id, length(ws)::BIGINT AS n_words, coalesce(length(js), 0)::BIGINT AS n_removed,
       sha256(coalesce(array_to_string(list_transform(list_filter(list_zip(ws, range(1, length(ws) + 1)), lambda x: NOT list_contains(coalesce(js, []), x[2])), lambda x: x[1]), ' '), '')) AS kept_sha256
FROM d LEFT JOIN each USING (r)
"""
