"""Exact n-gram Jaccard self-join by size: fixed-size subsets for small sets, inverted lists for large ones.

Two sets with Jaccard similarity t or more overlap in at least ceil(t * size) shingles of either. Under
any one order of all shingles they therefore share at least l shingles of their prefixes of length
``size - ceil(t * size) + l``. Small sets enumerate every 2-subset of their prefix for l = 2, which is
selective; large sets would have too many subsets and instead scan the inverted lists of their prefix
for l = 1. The boundary between small and large minimises the rows of both.

The order puts common shingles last. How common a shingle is comes from a table of counts over the
whole corpus, of fixed size and addressed by hash, so shingles may share a slot: the order is the same
everywhere, hence exact, and only its quality depends on the table. Text that many documents quote thus
stays out of most prefixes.

Lists are not expanded into all pairs. Each list first links its members to its smallest document, which
joins groups of near copies with as many checks as there are copies; what remains is pairs whose
documents are still in different components, and they are dropped when the links to that common document
prove them too far apart (Jaccard distance is a metric). No list is cut, so no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .components import connected_components
from .scratch import drop, small_enough, stored
from .textvec import blocks, column, mix, shingle_sets, slices


@dataclass(frozen=True)
class JoinParams:
    """``percent``: least similarity. ``table_bits``: the count table has 2**table_bits slots of 1 byte (a
    logarithm), the only thing sent to every task. A larger corpus takes more. ``scan_cost``: work of scanning one inverted list against storing one
    subset. ``broadcast_rows``: id lists up to this many rows are broadcast, longer ones are shuffled."""

    percent: int = 75
    words: int = 5
    table_bits: int = 24
    scan_cost: float = 4.0
    broadcast_rows: int = 1_000_000


_SLICE = 1 << 16


def _sets(texts: list, n: int) -> Iterator[np.ndarray]:
    for block in blocks(texts):
        yield from shingle_sets(block, n)


def count_table(docs: DataFrame, text: str, p: JoinParams) -> np.ndarray:
    """8 * log2(1 + occurrences) by slot over all documents. Each task adds up a table of fixed size; slices of the tables
    are summed by key, streaming."""
    size, slots = 1 << p.table_bits, max(1, (1 << p.table_bits) // _SLICE)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(size, np.uint8)  # up to 255; what is beyond that in ``over`` and ``beyond``
        over, beyond = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in slices(batches):
            found = list(_sets(column(b, text), p.words))
            slot, times = np.unique((np.concatenate(found) & np.uint64(size - 1)).astype(np.int64), return_counts=True)
            total = table[slot] + times
            table[slot] = np.minimum(total, 255)
            full = total > 255
            if full.any():
                over, at = np.unique(np.concatenate((over, slot[full])), return_inverse=True)
                beyond = np.bincount(at, np.concatenate((beyond, total[full] - 255))).astype(np.int64)
        part = size // slots
        cut = np.searchsorted(over, np.arange(slots + 1) * part)
        more = np.stack([over % part, beyond], 1).astype(np.uint32)
        for lo in range(0, slots, 16):  # small batches: neither side holds the table twice
            own = range(lo, min(lo + 16, slots))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(own, pa.int32()),
                    pa.array([table[i * part : (i + 1) * part].tobytes() for i in own], pa.binary()),
                    pa.array([more[cut[i] : cut[i + 1]].tobytes() for i in own], pa.binary()),
                ],
                ["slot", "counts", "more"],
            )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for slot, blob, more in zip(column(b, "slot"), column(b, "counts"), column(b, "more"), strict=True):
                if slot not in sums:
                    sums[slot] = np.zeros(len(blob), np.uint32)
                sums[slot] += np.frombuffer(blob, np.uint8)
                over = np.frombuffer(more, np.uint32).reshape(-1, 2)
                sums[slot][over[:, 0]] += over[:, 1]
        coded = [np.round(8 * np.log2(1.0 + v)).astype(np.uint8).tobytes() for v in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(coded, pa.binary())], ["slot", "counts"])

    tables = docs.select(text).mapInArrow(count, "slot int, counts binary, more binary")
    parts = stored(tables.repartition("slot").mapInArrow(add, "slot int, counts binary"), "counts")
    table = np.zeros(size, np.uint8)
    for r in parts.collect():  # 2**table_bits bytes in all
        table[r.slot * (size // slots) : (r.slot + 1) * (size // slots)] = np.frombuffer(r.counts, np.uint8)
    return table


def classes(table: np.ndarray) -> np.ndarray:
    """Slot to class: 0 for slots about as full as the mean, then by powers of the square root of two."""
    full = 2.0 ** (np.arange(256) / 8) - 1
    mean = float((np.bincount(table, minlength=256) * full).sum() / len(table))
    rank = np.floor(2 * np.log2(np.maximum(full / (mean + np.sqrt(mean) + 1), 1)))
    return np.minimum(rank, 120).astype(np.uint8)[table]


def least_overlap(n: int, percent: int) -> int:
    return -(-n * percent // 100)


def prefixes(docs: DataFrame, doc_id: str, text: str, order: np.ndarray, p: JoinParams) -> DataFrame:
    """(id, own, n, digest, keys, last): row key, the document's own id, set size, digest of the set, and the prefix for l = 2 in the common order."""
    sent = docs.sparkSession.sparkContext.broadcast(order)
    bits = np.uint64(p.table_bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = sent.value
        for b in slices(batches):
            ids, own, ns, digests, offsets, keys, lasts = column(b, "_row"), column(b, doc_id), [], [], [0], [], []
            for s in _sets(column(b, text), p.words):
                n = len(s)
                ns.append(n)
                # two independent sums over the set: equal sets, equal digests
                digests.append(np.array([mix(s).sum(), mix(s ^ np.uint64(0x5BD1E995A5A5A5A5)).sum()], np.uint64).tobytes() if n else None)
                k = min(n, n - least_overlap(n, p.percent) + 2)
                cls = order[(s & np.uint64((1 << p.table_bits) - 1)).astype(np.int64)].astype(np.uint64)
                rank = (cls << np.uint64(56)) | (mix(s) >> np.uint64(8))
                if k < n:
                    rank = np.partition(rank, k - 1)[:k]
                rank = np.sort(rank)
                at = n - least_overlap(n, p.percent)
                lasts.append(int(rank[min(at, k - 1)] >> np.uint64(1)) if k else None)  # end of the prefix for l = 1
                keys.append(rank.view(np.int64))
                offsets.append(offsets[-1] + k)
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(own, pa.int64()), pa.array(ns, pa.int32()), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat)), pa.array(lasts, pa.int64())],
                ["id", "own", "n", "digest", "keys", "last"],
            )

    return docs.select("_row", doc_id, text).mapInArrow(run, "id long, own long, n int, digest binary, keys array<long>, last long")


def boundary(reps: DataFrame, p: JoinParams) -> int:
    """The largest size that counts as small, by the rows each choice makes. Reads a histogram of sizes up
    to 64; above that, subsets never pay."""
    hist = {r.n: r.c for r in reps.where("n between 2 and 64").groupBy("n").agg(F.count("*").alias("c")).collect()}
    one = lambda n: n - least_overlap(n, p.percent) + 1
    pairs = lambda n: min(n, one(n) + 1) * (min(n, one(n) + 1) - 1) / 2

    def cost(b: int) -> float:
        return sum(c * ((pairs(n) if n <= b else 0) + (p.scan_cost * one(n) if n > b * p.percent / 100 else 0)) for n, c in hist.items())

    return min(range(1, 65), key=cost)


def _postings(reps: DataFrame, b: int, p: JoinParams) -> DataFrame:
    """(key, id, n). Small sets meet each other on 2-subsets; large ones, and the small ones that could
    reach the size of a large one, meet on single shingles."""
    prefix = F.expr(f"slice(keys, 1, n - cast((n * {p.percent} + 99) div 100 as int) + 1)")
    lists = reps.where(f"n > 1 and n * 100 > {b} * {p.percent}").select(F.explode(prefix).alias("key"), "id", "n")
    subsets = reps.where(f"n > 1 and n <= {b}").select(
        F.explode(
            F.flatten(F.transform("keys", lambda x, i: F.transform(F.slice("keys", i + 2, F.size("keys")), lambda y: F.xxhash64(x, y))))
        ).alias("key"),
        "id",
        "n",
    )
    return lists.unionByName(subsets)  # keys of both kinds may collide: that only adds candidates


def _could_link(a: str, b: str, p: JoinParams) -> Column:
    """Whether two sets, each given as struct (n, lone, last), can overlap enough: by their sizes, and by what is left
    of the one whose prefix ends first without its lone shingles. (What it shares with the other set up to
    that end is in the other's prefix too, so its lone shingles are not in the other set.)"""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    left = F.when(F.col(f"{a}.last") <= F.col(f"{b}.last"), n - F.col(f"{a}.lone")).otherwise(m - F.col(f"{b}.lone"))
    return (n * 100 >= m * p.percent) & (m * 100 >= n * p.percent) & (left * (100 + p.percent) >= p.percent * (n + m))


def _held_here(a: Column, b: Column, p: JoinParams) -> Column:
    """Whether a pair of members of one list (structs id, s, nth) is taken up at this list. A pair that links shares at
    least so many prefix shingles as it needs beyond what the set whose prefix ends first has after it. All but
    one of that many can be passed over, and for the member of smaller id those are its most crowded lists:
    ``nth`` numbers a member's lists from the most crowded on."""
    n, m = a["s"]["n"], b["s"]["n"]
    need = F.floor((p.percent * (n + m) + 99 + p.percent) / (100 + p.percent))
    first = F.when(a["s"]["last"] <= b["s"]["last"], n).otherwise(m)
    after = F.floor((first * p.percent + 99) / 100) - 1
    return F.when(a["id"] < b["id"], a["nth"]).otherwise(b["nth"]) >= need - after


def measure(pairs: DataFrame, docs: DataFrame, doc_id: str, text: str, p: JoinParams, once: bool = False) -> DataFrame:
    """(a, b, inter, union) of pairs of documents, from their whole texts. ``once``: keys may repeat, with the same text."""
    ids = stored(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct(), "wanted")
    if small_enough(ids, p.broadcast_rows):
        ids = F.broadcast(ids)
    own = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("t")).join(ids, "id", "left_semi")
    if once:
        own = own.dropDuplicates(["id"])
    both = pairs.join(own.select(F.col("id").alias("a"), F.col("t").alias("ta")), "a").join(own.select(F.col("id").alias("b"), F.col("t").alias("tb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            inter, union = [], []
            for x, y in zip(_sets(column(batch, "ta"), p.words), _sets(column(batch, "tb"), p.words), strict=True):
                same = len(np.intersect1d(x, y, assume_unique=True))
                inter.append(same)
                union.append(len(x) + len(y) - same)
            yield pa.RecordBatch.from_arrays([pa.array(column(batch, "a"), pa.int64()), pa.array(column(batch, "b"), pa.int64()), pa.array(inter, pa.int64()), pa.array(union, pa.int64())], ["a", "b", "inter", "union"])

    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long, inter long, union long")


def row_key(docs: DataFrame, doc_id: str, text: str) -> Column:
    """A 64-bit key of a row: the document's id where ids are unique and not null. Otherwise a hash of id and text: rows of one id
    with different texts are told apart, and rows equal in both are one document. (Ids are better where they can be: originals
    tend to have smaller ones than their copies, and the smallest key of a group is compared with all.)"""
    own = F.col(doc_id).cast("long")
    clash = docs.select(own.alias("id")).groupBy("id").agg(F.count("*").alias("c")).where("c > 1 or id is null")
    return own if clash.isEmpty() else F.xxhash64(own, F.col(text))


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", p: JoinParams = JoinParams()) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_connecting_links) per row.

    Ids may repeat: rows of one id are sets of their own. Null ids stay, and are no component_id unless all ids of the class
    are null. Null, empty and wordless texts have an empty set and link with nothing. Equal sets link (their similarity is 1).
    n_connecting_links counts the verified links between different sets that were needed to connect the row's class, not all
    that exist. Other columns are ignored; an empty table gives no rows.
    """
    rows = linked_rows(docs, row_key(docs, doc_id, text), doc_id, text, p)
    return rows.select(F.col("own").alias(doc_id), F.col("n").cast("long").alias("n_shingles"), "component_id", "n_connecting_links")


def repeated(keys: DataFrame) -> DataFrame | None:
    """The keys that more than one row has; None if there are none."""
    twice = stored(keys.groupBy("id").agg(F.count("*").alias("c")).where("c > 1").select("id"), "repeated")
    return None if twice.isEmpty() else twice


def linked_rows(docs: DataFrame, key: Column, doc_id: str, text: str, p: JoinParams) -> DataFrame:
    """(id, own, n, component, component_id, n_connecting_links): ``id`` is the key of a row, ``component`` the least key of its class."""
    docs = docs.select(F.col(doc_id).cast("long").alias(doc_id), text, key.alias("_row"))
    order = classes(count_table(docs, text, p))
    every = stored(prefixes(docs, doc_id, text, order, p), "prefixes")
    sets, twice = every, repeated(every.select("id"))
    if twice is not None:  # rows equal in id and text: one of them takes part
        sets = every.join(twice, "id", "left_anti").unionByName(every.join(twice, "id", "left_semi").dropDuplicates(["id"]))
    classes_of = stored(
        sets.where("digest is not null").groupBy("n", "digest").agg(F.min("id").alias("rep"), F.min("own").alias("least")), "classes"
    )
    copies = stored(sets.select("id", "n", "digest").join(classes_of, ["n", "digest"]).where("id <> rep").select("id"), "copies")
    if small_enough(copies, p.broadcast_rows):
        copies = F.broadcast(copies)
    reps = sets.select("id", "n", "keys").join(copies, "id", "left_anti")
    small = boundary(reps, p)
    post = _postings(reps, small, p).repartition("key")  # dealt once for the counts and the join below

    common = post.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    met = stored(post.join(common, "key"), "met")  # few of the postings, which are off the disk before these are dealt by set
    # Lone: the shingles of a large set's prefix that are in no other set's prefix.
    length = F.expr(f"n - cast((n * {p.percent} + 99) div 100 as int) + 1")
    own = Window.partitionBy("id")
    nth = F.when(F.col("n") > small, F.row_number().over(own.orderBy(F.desc("c"), "key"))).otherwise(1 << 30)
    lone = F.when(F.col("n") > small, length - F.count("*").over(own)).otherwise(0)
    lists = met.select("key", "id", "n", nth.alias("nth"), lone.alias("lone")).join(sets.select("id", "last"), "id")
    lists = stored(lists.select("key", F.struct("id", F.struct("n", "lone", "last").alias("s"), "nth").alias("m")), "lists")
    drop(met)
    heads = lists.groupBy("key").agg(F.min("m").alias("head"), F.count("*").alias("c"))
    shared = stored(lists.join(heads, "key"), "shared")
    drop(lists)  # tables go when no later step reads them

    def held(a: str, b: str) -> Column:
        return _could_link(f"{a}.s", f"{b}.s", p) & _held_here(F.col(a), F.col(b), p)

    pair = lambda a, b: (F.least(f"{a}.id", f"{b}.id").alias("a"), F.greatest(f"{a}.id", f"{b}.id").alias("b"))
    stars = stored(shared.where("head.id <> m.id").where(held("head", "m")).select(*pair("head", "m")).distinct(), "stars")
    known = stored(measure(stars, docs, "_row", text, p, twice is not None), "known")
    link = F.col("inter") * 100 >= F.col("union") * p.percent
    first = stored(connected_components(known.where(link), "a", "b"), "first")

    # Lists whose members are still in different components: those outside the head's component are held against
    # another member of it, a different one in each list, and then, if still outside, against all others.
    shared = shared.where("c > 2").drop("c")
    labelled = stored(_label(shared, first, known), "labelled")
    drop(shared)
    drop(first)
    second = labelled.where("component = head_component and m.id <> head.id").groupBy("key").agg(F.min_by("m", F.xxhash64("key", "m.id")).alias("o"))
    tries = labelled.where("component <> head_component").join(second, "key").where(held("m", "o")).select(*pair("m", "o")).distinct()
    tries = stored(tries.join(known.select("a", "b"), ["a", "b"], "left_anti"), "tries")
    tried = stored(measure(tries, docs, "_row", text, p, twice is not None), "tried")
    first = stored(connected_components(known.where(link).unionByName(tried.where(link)), "a", "b"), "second")
    before, labelled = labelled, stored(_label(labelled.select("key", "m", "head"), first, known), "labelled_again")
    drop(before)
    drop(first)
    x = labelled.where("component <> head_component").select("key", "m", F.col("component").alias("cm"), F.col("far").alias("fm"), "head_component")
    y = labelled.select("key", F.col("m").alias("o"), F.col("component").alias("co"), F.col("far").alias("fo"))
    limit = 1 - p.percent / 100 + 1e-9
    rest = (
        x.join(y, "key")
        .where((F.col("cm") != F.col("co")) & ((F.col("co") == F.col("head_component")) | (F.col("m.id") < F.col("o.id"))) & held("m", "o"))
        .where(F.coalesce(F.abs(F.col("fm") - F.col("fo")) <= limit, F.lit(True)))
        .select(*pair("m", "o"))
        .distinct()
    )
    measured = known.unionByName(tried)
    rest = stored(rest.join(measured.select("a", "b"), ["a", "b"], "left_anti"), "rest")
    drop(labelled)
    more = stored(measure(rest, docs, "_row", text, p, twice is not None).where(link).select("a", "b"), "more")
    links = measured.where(link).select("a", "b").unionByName(more)
    final = connected_components(links, "a", "b")

    n_links = links.select(F.col("a").alias("rep")).unionAll(links.select(F.col("b").alias("rep"))).groupBy("rep").agg(F.count("*").alias("n_links"))
    linked = classes_of.join(final.select(F.col("node").alias("rep"), "component"), "rep", "left")
    least = linked.where("component is not null").groupBy("component").agg(F.min("least").alias("component_id"))
    named = (
        linked.join(least, "component", "left")
        .join(n_links, "rep", "left")
        .select("n", "digest", F.coalesce("component", "rep").alias("component"), F.when(F.col("component").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    )
    alone = F.col("digest").isNull()
    return every.select("id", "own", "n", "digest").join(named, ["n", "digest"], "left").select(
        "id", "own", "n", F.when(alone, F.col("id")).otherwise(F.col("component")).alias("component"), F.when(alone, F.col("own")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_connecting_links")
    )


def _label(shared: DataFrame, first: DataFrame, known: DataFrame) -> DataFrame:
    """List members with their component, their list head's component and their distance to that head (0 for itself)."""
    comp = first.select(F.col("node").alias("id"), "component")
    head_comp = first.select(F.col("node").alias("hid"), F.col("component").alias("head_component"))
    far = known.select(F.col("a").alias("hid"), F.col("b").alias("id"), (1 - F.col("inter") / F.col("union")).alias("far"))
    rows = shared.select("key", "m", "head", F.col("m.id").alias("id"), F.col("head.id").alias("hid"))
    return (
        rows.join(comp, "id", "left")
        .join(head_comp, "hid", "left")
        .join(far, ["hid", "id"], "left")
        .select("key", "m", "head", F.coalesce("component", "id").alias("component"), F.coalesce("head_component", "hid").alias("head_component"), F.when(F.col("id") == F.col("hid"), 0.0).otherwise(F.col("far")).alias("far"))
    )


def op5_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def near_copy_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of linked documents the row with the smallest id stays (of equal ids, that of the smallest
    key; null ids come last), and of rows equal in id and text one.

    Null, empty and wordless texts link with nothing and stay. Repeated ids with different texts are documents of their
    own. All columns of ``docs`` are returned; an empty table gives an empty one.
    """
    key = row_key(docs, "doc_id", "text")
    rows = stored(linked_rows(docs, key, "doc_id", "text", JoinParams()).select("id", "own", "component"), "classes_of_rows")
    first = F.struct(F.col("own").isNull(), "own", "id")
    best = rows.groupBy("component").agg(F.min(first).alias("best"), F.count("*").alias("c")).where("c > 1")
    gone = stored(rows.join(best, "component").where(F.col("id") != F.col("best.id")).select(F.col("id").alias("_row")).distinct(), "copies")
    side = F.broadcast(gone) if small_enough(gone, 500_000) else gone
    kept = docs.withColumn("_row", key).join(side, "_row", "left_anti")
    twice = repeated(rows.select("id"))
    if twice is not None:
        twice = twice.withColumnRenamed("id", "_row")
        kept = kept.join(twice, "_row", "left_anti").unionByName(kept.join(twice, "_row", "left_semi").dropDuplicates(["_row"]))
    return kept.select(*docs.columns)
