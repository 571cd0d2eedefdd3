"""Prefix trie of conversations: adaptive radix trees over turn ids, merged along the paths that tasks share.

A turn is named by 16 bytes, a conversation by the bytes of its turns one after the other. Conversations are dealt out
by ranges of these strings, so that a task (and a slice of bounded size within it) holds neighbours. Each slice is built
into an adaptive radix tree. A trie node that is no prefix of the slice's first or last string lies in that slice alone
and is emitted at once; of those that are, the first and the last string go on as two paths with what hangs off them.
These paths are few; they are dealt out, built and thinned the same way until one small slice is left.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .scratch import drop, small_enough, stored
from .textvec import column, release

TURN = 16  # bytes of a turn id


@dataclass(frozen=True)
class TrieParams:
    """``slice_rows``, ``slice_bytes``: most strings, and bytes of them, in one tree. ``last_rows``: so many paths are
    merged in one task. ``broadcast_rows``: most shared nodes that are broadcast. ``salts``: how many ways the children of one shared
    node are dealt where they are not."""

    slice_rows: int = 20_000
    slice_bytes: int = 4_000_000
    last_rows: int = 2_000
    broadcast_rows: int = 500_000
    salts: int = 32


class _Sorted:
    """Layout of up to 4 or 16 children: sorted bytes beside the children."""

    __slots__ = ("room", "keys", "kids")

    def __init__(self, room: int = 4):
        self.room, self.keys, self.kids = room, bytearray(), []

    def get(self, b: int):
        at = self.keys.find(b)
        return self.kids[at] if at >= 0 else None

    def put(self, b: int, kid):
        if len(self.keys) == self.room:
            bigger = _Sorted(16) if self.room == 4 else _Indexed()
            for x, y in self.items():
                bigger.put(x, y)
            return bigger.put(b, kid)
        at = bisect_left(self.keys, b)
        self.keys.insert(at, b)
        self.kids.insert(at, kid)
        return self

    def items(self):
        return zip(self.keys, self.kids, strict=True)


class _Indexed:
    """Layout of up to 48 children: a byte for each of 256 says which."""

    __slots__ = ("index", "kids")

    def __init__(self):
        self.index, self.kids = bytearray(256), []

    def get(self, b: int):
        at = self.index[b]
        return self.kids[at - 1] if at else None

    def put(self, b: int, kid):
        if len(self.kids) == 48:
            bigger = _Direct()
            for x, y in self.items():
                bigger.put(x, y)
            return bigger.put(b, kid)
        self.kids.append(kid)
        self.index[b] = len(self.kids)
        return self

    def items(self):
        return ((b, self.kids[at - 1]) for b, at in enumerate(self.index) if at)


class _Direct:
    """Layout of up to 256 children: one place for each byte."""

    __slots__ = ("kids",)

    def __init__(self):
        self.kids = [None] * 256

    def get(self, b: int):
        return self.kids[b]

    def put(self, b: int, kid):
        self.kids[b] = kid
        return self

    def items(self):
        return ((b, kid) for b, kid in enumerate(self.kids) if kid is not None)


@dataclass(slots=True)
class Facts:
    """What is known of a trie node besides its children in the tree: conversations that end here or in finished
    children, the least of them, the number of those children, their leaves and their saved code points."""

    n: int = 0
    least: int | None = None
    kids: int = 0
    leaves: int = 0
    saved: int = 0

    def add(self, o: Facts) -> None:
        self.n += o.n
        if self.least is None or (o.least is not None and o.least < self.least):
            self.least = o.least
        self.kids += o.kids
        self.leaves += o.leaves
        self.saved += o.saved


class Node:
    __slots__ = ("prefix", "own", "table", "chars", "ids", "sums")

    def __init__(self, prefix: bytes, chars: list):
        self.prefix, self.chars, self.own, self.table, self.ids, self.sums = prefix, chars, None, None, None, None


def _shared(a: bytes, b: bytes) -> int:
    """Length of the common start."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


class Tree:
    """Adaptive radix tree with path compression. ``chars`` of a string: the code points of each of its turns."""

    def __init__(self):
        self.root = Node(b"", [])

    def insert(self, key: bytes, facts: Facts, chars: list, ids: list | None = None) -> None:
        node, at = self.root, 0
        while True:
            p = node.prefix
            n = _shared(p, key[at : at + len(p)])
            if n < len(p):  # the path to this node parts here
                rest = Node(p[n + 1 :], node.chars)
                rest.own, rest.table, rest.ids = node.own, node.table, node.ids
                node.prefix, node.own, node.ids, node.table = p[:n], None, None, _Sorted().put(p[n], rest)
            at += n
            if at == len(key):
                break
            kid = node.table.get(key[at]) if node.table else None
            if kid is None:
                kid = Node(key[at + 1 :], chars)
                node.table = (node.table or _Sorted()).put(key[at], kid)
                node, at = kid, len(key)
                break
            node, at = kid, at + 1
        if len(chars) > len(node.chars):
            node.chars = chars
        if node.own is None:
            node.own = Facts()
        node.own.add(facts)
        if ids:
            node.ids = (node.ids or []) + ids

    def walk(self) -> Iterator[tuple[Node, int, int, bytes]]:
        """(node, depth in bytes of its parent, its own, its string) with parents before their children."""
        stack = [(self.root, 0, b"")]
        while stack:
            node, start, head = stack.pop()
            path = head + node.prefix
            yield node, start, len(path), path
            if node.table:
                stack.extend((kid, len(path), path + bytes((b,))) for b, kid in node.table.items())


def digest(path: bytes) -> bytes:
    return hashlib.blake2b(path, digest_size=16).digest()


NONE = hashlib.sha256(b"").hexdigest()


def ids_hash(ids: list) -> str:
    return hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest() if ids else NONE


def finish(tree: Tree, first: bytes | None, last: bytes | None) -> tuple[list, list, list]:
    """(nodes, paths, ends) of a tree over a slice whose strings run from ``first`` to ``last``; None: nothing is beyond it.

    nodes: (conv_id, depth, parent, parent key, n, children, leaves, saved, ends, key) of all trie nodes off the two paths.
    paths: (string, chars, [(depth, facts)]). ends: (key, ids) of strings that end on a path.
    """
    order = list(tree.walk())
    on_first = lambda p: first is not None and first.startswith(p)
    on_last = lambda p: last is not None and last.startswith(p)
    marks = [(on_first(p), on_last(p)) for *_, p in order]
    # Bottom up: ``sums`` of a tree node are the facts of the trie node at or above it that its subtree adds to.
    parent_of = {id(kid): node for node, *_ in order if node.table for _, kid in node.table.items()}
    held: dict[tuple[int, int], Facts] = {}  # facts of trie nodes on the paths, by (0 first, 1 last; depth)
    own: dict[int, Facts] = {}
    common = _shared(first, last) // TURN if first is not None else -1

    def side(f: bool, depth: int) -> tuple[int, int]:
        return (0 if f or depth <= common else 1, depth)

    for (node, start, end, _), (f, l) in zip(reversed(order), reversed(marks), strict=True):
        below = node.sums or Facts()
        if node.own:
            below.add(node.own)
        top, deepest = start // TURN + 1, end // TURN
        if not node.prefix and start == end:  # the root of the tree
            top = 0
        at_turn = end % TURN == 0
        if f or l:
            if at_turn:
                held.setdefault(side(f, deepest), Facts()).add(below)
            elif below.n:  # the branch point is within a turn: what hangs off it belongs to the turn before
                held.setdefault(side(f, deepest), Facts()).add(below)
            continue
        saved = (lambda d: (below.n - 1) * node.chars[d - 1] if d else 0)
        up = below
        if deepest >= top:  # trie nodes on this edge
            kids, leaves, gain = (below.kids, below.leaves, below.saved) if at_turn else (0, 0, 0)
            if at_turn:
                leaves = leaves or 1
                gain += saved(deepest)
                own[id(node)] = Facts(below.n, below.least, kids, leaves, gain)
                rest = range(deepest - 1, top - 1, -1)
            else:  # children of the lowest trie node of the edge part within their turn
                kids, leaves, gain = below.kids, below.leaves, below.saved + saved(deepest)
                own[id(node)] = Facts(below.n, below.least, kids, leaves, gain)
                rest = range(deepest - 1, top - 1, -1)
            for d in rest:
                gain += saved(d)
            up = Facts(below.n, below.least, 1, leaves, gain)
        parent = parent_of.get(id(node))
        if parent is not None:
            if parent.sums is None:
                parent.sums = Facts()
            parent.sums.add(up)

    nodes, ends = [], []
    above: dict[int, tuple] = {}  # by tree node: (conv_id, key) of the nearest trie node at or above its end
    for (node, start, end, path), (f, l) in zip(order, marks, strict=True):
        parent = parent_of.get(id(node))
        mine = above.get(id(parent)) if parent is not None else (None, None)
        if f or l:
            above[id(node)] = (None, path[: end // TURN * TURN])
            if node.ids:
                ends.append((digest(path), node.ids))
            continue
        facts, deepest = own.get(id(node)), end // TURN
        if facts is not None:
            top = start // TURN + 1 if parent is not None else 0
            gain = facts.saved
            for d in range(deepest, top - 1, -1):  # from the lowest trie node of the edge upwards
                low = d == deepest
                kin = (facts.least, None) if d > top else mine
                here = low and end % TURN == 0
                nodes.append(
                    (facts.least, d, kin[0], None if kin[1] is None else digest(kin[1]), facts.n, facts.kids if low else 1, facts.leaves, gain, ids_hash(node.ids) if here and node.ids else NONE, digest(path[: d * TURN]))
                )
                gain += (facts.n - 1) * node.chars[d - 2] if d > 1 else 0
            mine = (facts.least, None)
        above[id(node)] = mine
    paths = []
    if first is not None:
        charts = {p: n.chars for n, *_, p in order if p in (first, last)}
        for s, path in enumerate((first, last) if last != first else (first,)):
            found = sorted((d, x) for (k, d), x in held.items() if k == s)
            paths.append((path, charts[path][: len(path) // TURN], found))
    return nodes, paths, ends


_NODE = "conv_id long, depth int, parent_conv_id long, parent_key binary, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, key binary"
_PATH = "path binary, chars array<int>, at array<int>, n array<long>, least array<long>, kids array<long>, leaves array<long>, saved array<long>"
_ALL = f"kind int, {_NODE}, {_PATH}, end_key binary, end_first long, end_ids string"
_TYPES = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}
_FIELDS = [tuple(x.split(" ")) for x in _ALL.split(", ")]


def _batch(nodes: list, paths: list, ends: list) -> Iterator[pa.RecordBatch]:
    """Rows of one slice: kind 0 nodes, 1 paths, 2 conversations that end on a path."""
    n_node, n_path = _NODE.count(",") + 1, _PATH.count(",") + 1
    rows = [(0, *x, *[None] * (n_path + 3)) for x in nodes]
    for path, chars, found in paths:
        each = [[getattr(x, k) for _, x in found] for k in ("n", "least", "kids", "leaves", "saved")]
        rows.append((1, *[None] * n_node, path, chars, [d for d, _ in found], *each, None, None, None))
    rows += [(2, *[None] * (n_node + n_path), key, min(ids), ",".join(map(str, sorted(ids)))) for key, ids in ends]
    for at in range(0, len(rows), 5000):
        cols = list(zip(*rows[at : at + 5000], strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(c, _TYPES[t]) for c, (_, t) in zip(cols, _FIELDS, strict=True)], [n for n, _ in _FIELDS])


def _level(rows: DataFrame, p: TrieParams, final: bool) -> DataFrame:
    """One round over sorted rows: conversations (path, chars, conv_id) or paths."""
    raw = "conv_id" in rows.columns
    slice_rows, slice_bytes = p.slice_rows, p.slice_bytes

    def build(rs: list) -> Iterator[pa.RecordBatch]:
        tree = Tree()
        for r in rs:
            if raw:
                tree.insert(r["path"], Facts(1, r["conv_id"]), r["chars"], [r["conv_id"]])
            else:
                for d, *facts in zip(r["at"], r["n"], r["least"], r["kids"], r["leaves"], r["saved"], strict=True):
                    tree.insert(r["path"][: d * TURN], Facts(*facts), r["chars"][:d])
        yield from _batch(*finish(tree, None if final else rs[0]["path"], None if final else rs[-1]["path"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                for r in b.slice(at, 1000).to_pylist():
                    if not final and len(held) > 2 and (len(held) >= slice_rows or size + len(r["path"]) > slice_bytes):
                        yield from build(held)
                        held, size = [], 0
                    held.append(r)
                    size += len(r["path"])
        if held:
            yield from build(held)
        release()

    return rows.mapInArrow(run, _ALL)


def _ends(chunks: DataFrame) -> DataFrame:
    """(key, ends) from runs of conversation ids. A hash takes its input in order, so the runs of one string stream through one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, h = None, None
        for b in batches:
            keys, out = [], []
            for key, text in zip(column(b, "end_key"), column(b, "end_ids"), strict=True):
                if key == now:
                    h.update(b"," + text.encode())
                    continue
                if now is not None:
                    keys.append(now)
                    out.append(h.hexdigest())
                now, h = key, hashlib.sha256(text.encode())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(out, pa.string())], ["key", "ends"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([h.hexdigest()], pa.string())], ["key", "ends"])

    return chunks.select("end_key", "end_first", "end_ids").repartition("end_key").sortWithinPartitions("end_key", "end_first").mapInArrow(run, "key binary, ends string")


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, path, chars): each conversation begins with the first h turns of the one its hundred starts with, h = crc32 of
    its decimal id modulo 6, and goes on with its own turns after its first h. Only ids and lengths of turns are shuffled."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    name = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * TURN)
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long"), "turn", name.alias("id"), F.length(text).alias("chars"))
    own = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "id", "chars"))).alias("turns"))
    head = own.where("conv_id % 100 = 0").select(F.col("conv_id").alias("base"), F.slice("turns", 1, 5).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string")) % 6).cast("int")
    both = own.withColumn("base", F.expr("conv_id - conv_id % 100")).join(head, "base", "left").withColumn("h", h)
    kept = F.expr("concat(slice(coalesce(head, slice(turns, 1, 0)), 1, h), slice(turns, h + 1, greatest(size(turns) - h, 0)))")
    return both.withColumn("kept", kept).select(
        "conv_id", F.unhex(F.array_join(F.transform("kept", lambda x: x["id"]), "")).alias("path"), F.transform("kept", lambda x: x["chars"]).alias("chars")
    )


def prefix_trie(paths: DataFrame, p: TrieParams = TrieParams()) -> DataFrame:
    """The nodes of the trie of ``paths`` (conv_id, path, chars).

    A node's conv_id is the smallest id of the conversations that begin with it; see the columns of ``op12_prefix_trie``. No rows: no
    nodes. Conversations without turns belong to the root alone. The turn ids of one conversation (16 bytes each) must fit a task.
    """
    rows = paths.select("conv_id", "path", "chars").repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    found, final = [], False
    while True:
        out = stored(_level(rows, p, final), "trie")
        found.append(out)
        left = out.where("kind = 1").select(*[c.split(" ")[0] for c in _PATH.split(", ")])
        if final:
            break
        n, size = left.agg(F.count("*"), F.sum(F.length("path"))).first()
        if not n:
            break
        final = n <= 64 or (n <= p.last_rows and size <= 8 * p.slice_bytes)
        rows = left.coalesce(1).sortWithinPartitions("path") if final else left.repartitionByRange("path").sortWithinPartitions("path")
    names = [c.split(" ")[0] for c in _NODE.split(", ")]
    inner = found[0].where("kind = 0").select(*names)
    ends = stored(_ends(found[0].where("kind = 2")), "ends")
    upper = found[0].where("kind = 0").select(*names).limit(0)
    for x in found[1:]:
        upper = upper.unionByName(x.where("kind = 0").select(*names))
    upper = stored(upper.join(ends, "key", "left").withColumn("ends_sha256", F.coalesce("ends", "ends_sha256")).drop("ends"), "shared_nodes")
    nodes = inner.unionByName(upper.select(*names))
    parents = upper.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("_parent"))
    known = nodes.where("parent_key is null")
    open_ = nodes.where("parent_key is not null")
    if small_enough(parents, p.broadcast_rows):
        open_ = open_.join(F.broadcast(parents), "parent_key", "left")
    else:  # a node may have any number of children
        salted = parents.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(p.salts - 1))))
        open_ = open_.withColumn("_salt", F.pmod(F.hash("conv_id"), F.lit(p.salts)).cast("int")).join(salted, ["parent_key", "_salt"], "left").drop("_salt")
    return known.unionByName(open_.withColumn("parent_conv_id", F.col("_parent")).select(*names)).select(
        "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    )


def op12_prefix_trie(spark, sf_dir: str) -> DataFrame:
    """A row per node of the trie of rebuilt conversations: conv_id (smallest member), depth, parent_conv_id (the parent's
    conv_id; root: null), n_convs (members), n_children, n_leaves (childless nodes below it or itself), saved_tokens (over
    its subtree, (members - 1) x code points of the node's last text), ends_sha256 (ids of the members that end here).

    Null roles and texts are empty; rows with a null conv_id are left out; null turns come first, and turns of one number
    are ordered by the hash that names them. Other columns are ignored.
    """
    return prefix_trie(rebuilt(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


ORACLE = """
WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
own AS (
  SELECT conv_id, list({'r': role, 't': text} ORDER BY turn NULLS FIRST, sha256(length(role)::VARCHAR || ':' || role || text)) AS ts
  FROM turns GROUP BY conv_id),
bits AS (SELECT conv_id, ts, flatten(list_transform(range(length(conv_id::VARCHAR)), lambda i: list_transform(range(8), lambda b: (ascii(substr(conv_id::VARCHAR, (i + 1)::INT, 1)) >> b::INT) & 1))) AS bs FROM own),
hs AS (
  SELECT conv_id, ts, (xor(list_reduce(list_transform(bs, lambda x: x::BIGINT), lambda crc, b: CASE WHEN xor(crc, b) & 1 = 1 THEN xor(crc >> 1, 3988292384) ELSE crc >> 1 END, 4294967295::BIGINT), 4294967295::BIGINT) % 6)::INT AS h FROM bits),
built AS (SELECT a.conv_id, list_concat(coalesce(b.ts, [])[:h], a.ts[h + 1:]) AS ts FROM hs a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 100),
pre AS (SELECT conv_id, length(ts) AS n, unnest(range(length(ts) + 1)) AS depth, ts FROM built),
keyed AS (SELECT conv_id, n, depth, sha256(ts[:depth]::JSON::VARCHAR) AS k, CASE WHEN depth = 0 THEN NULL ELSE sha256(ts[:depth - 1]::JSON::VARCHAR) END AS pk, CASE WHEN depth = 0 THEN 0 ELSE length(ts[depth].t) END AS chars FROM pre),
nodes AS (
  SELECT depth, k, any_value(pk) AS pk, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
         string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE n = depth) AS ends
  FROM keyed GROUP BY depth, k),
kids AS (SELECT pk, count(*) AS c FROM nodes WHERE depth > 0 GROUP BY pk),
full_nodes AS (SELECT n.*, coalesce(c, 0) AS n_children FROM nodes n LEFT JOIN kids ON kids.pk = n.k),
above AS (
  SELECT u.depth AS ud, u.k AS uk, sum(CASE WHEN v.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((v.n_convs - 1) * v.chars) AS saved
  FROM full_nodes v JOIN keyed m ON m.conv_id = v.conv_id AND m.depth <= v.depth JOIN full_nodes u ON u.k = m.k AND u.depth = m.depth GROUP BY ALL)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs::BIGINT AS n_convs, n.n_children::BIGINT AS n_children,
       a.n_leaves::BIGINT AS n_leaves, a.saved::BIGINT AS saved_tokens, sha256(coalesce(n.ends, '')) AS ends_sha256
FROM full_nodes n JOIN above a ON a.uk = n.k AND a.ud = n.depth LEFT JOIN full_nodes p ON p.k = n.pk AND p.depth = n.depth - 1
"""
