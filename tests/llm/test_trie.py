"""The prefix trie against a plain trie in Python and its SQL."""

import hashlib
import zlib
from collections import defaultdict

import duckdb
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from corpusloom.llm import trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    """Nodes from (conv_id, turn, role, text) without ties of turn."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), (role or "", text or "")))
    own = {c: [x for _, x in sorted(ts)] for c, ts in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        full = own.get(c - c % 100, [])[:h] + ts[h:]
        ends[tuple(full)].append(c)
        for d in range(len(full) + 1):
            members[tuple(full[:d])].append(c)
    kids = defaultdict(set)
    for node in members:
        if node:
            kids[node[:-1]].add(node)
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, ms in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not kids[node]
            saved[node[:d]] += (len(ms) - 1) * len(node[-1][1]) if node else 0
    return sorted(
        (
            (min(ms), len(node), min(members[node[:-1]]) if node else None, len(ms), len(kids[node]), leaves[node], saved[node], hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest())
            for node, ms in members.items()
        ),
        key=str,
    )


def rows_of(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("p", [trie.TrieParams(), trie.TrieParams(slice_rows=3, last_rows=2, broadcast_rows=0, salts=3)])
def test_whole_table(spark, sf_dir, p):
    conv = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    want = plain([tuple(r) for r in conv.select("conv_id", "turn", "role", "text").collect()])
    assert rows_of(trie.prefix_trie(trie.rebuilt(conv), p)) == want


def test_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{sf_dir}/conversations.parquet'")
    rel = con.execute(trie.ORACLE)
    names = [c[0] for c in rel.description]
    assert sorted(COLUMNS) == sorted(names)
    want = sorted((tuple(dict(zip(names, r, strict=True))[c] for c in COLUMNS) for r in rel.fetchall()), key=str)
    assert rows_of(trie.op12_prefix_trie(spark, sf_dir)) == want


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 230), st.sampled_from("ab"), st.sampled_from(["", "x", "xyz"])), max_size=60), st.integers(3, 9))
def test_small_alphabets(spark, words, size):
    seen = defaultdict(int)
    rows = []
    for c, role, text in words:
        rows.append((c, seen[c], role, text))
        seen[c] += 1
    conv = spark.createDataFrame(rows, SCHEMA)
    got = trie.prefix_trie(trie.rebuilt(conv), trie.TrieParams(slice_rows=size, last_rows=4))
    assert rows_of(got) == plain(rows)


def test_edges(spark):
    """Null roles, texts, turns and ids, a very long text, copies, turnless members, repeated rows, other columns."""
    rows = [(7, None, None, None), (7, 0, "user", "hello"), (8, 0, "user", "é" * 300_000), (None, 1, "user", "lost"), (100, 0, "user", "a"), (100, 1, "bot", None), (103, 0, "user", "b")]
    rows += [(c, 0, "system", "same") for c in range(1000, 1060)]
    conv = spark.createDataFrame(rows, SCHEMA).withColumn("path", F.lit("clash")).withColumn("chars", F.lit("clash"))
    got = rows_of(trie.prefix_trie(trie.rebuilt(conv), trie.TrieParams(slice_rows=5, last_rows=2)))
    assert got == plain(rows)
    twice = [(c, 0, "user", "x") for c in (7, 8, 9, 11) for _ in range(2)]
    got = rows_of(trie.prefix_trie(trie.rebuilt(spark.createDataFrame(twice, SCHEMA))))
    assert got == plain([(c, i % 2, r, t) for i, (c, _, r, t) in enumerate(twice)])  # repeated rows are turns of their own
    assert rows_of(trie.prefix_trie(trie.rebuilt(spark.createDataFrame([], SCHEMA)))) == []


def test_layouts_grow():
    for n, kind in ((4, trie._Sorted), (5, trie._Sorted), (17, trie._Indexed), (49, trie._Direct), (256, trie._Direct)):
        t = trie.Tree()
        for i in range(n):
            t.insert(bytes([i]) * trie.TURN, trie.Facts(1, i), [1])
        assert type(t.root.table) is kind and [b for b, _ in t.root.table.items()] == list(range(n))
        assert all(t.root.table.get(i).own.least == i for i in range(n))
    t = trie.Tree()
    t.insert(b"a" * 48, trie.Facts(1, 3), [1, 2, 3])
    assert t.root.table.get(97).prefix == b"a" * 47  # one compressed path
    nodes, paths, ends = trie.finish(t, None, None)
    assert [(x[1], x[4]) for x in nodes] == [(0, 1), (3, 1), (2, 1), (1, 1)] and not paths and not ends
