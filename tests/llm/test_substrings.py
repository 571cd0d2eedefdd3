"""Substring dedup against counting every window in a dictionary."""

import hashlib
import random
import re
from collections import Counter

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from corpusloom.llm import substrings as sub

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(texts, n=35):
    """(n_words, n_removed, kept_sha256, kept) of each text."""
    split = [WORD.findall(t or "") for t in texts]
    seen = Counter(tuple(w[i : i + n]) for w in split for i in range(len(w) - n + 1))
    out = []
    for w in split:
        gone = {j for i in range(len(w) - n + 1) if seen[tuple(w[i : i + n])] > 1 for j in range(i, i + n)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return out


def run(spark, texts, p=sub.WindowParams(), ids=None):
    rows = [(ids[i] if ids else i, i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, at long, text string").withColumn("k1", F.lit("clash")).withColumn("n_words", F.lit("clash")).withColumn("digest", F.lit("stays"))
    got = sub.without_repeats(docs, p=p, keep_text=True).orderBy("at").collect()
    assert all(r.digest == "stays" for r in got)
    return [(r.n_words, r.n_removed, r.kept_sha256, r.kept_text) for r in got]


def test_whole_table(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = sorted((r.doc_id, *x[:3]) for r, x in zip(rows, plain([r.text for r in rows]), strict=True))
    got = sub.op11_substring_dedup(spark, sf_dir)
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert sorted(tuple(r) for r in got.collect()) == want
    assert any(r[2] for r in want) and any(not r[2] for r in want)


@pytest.mark.parametrize("p", [sub.WindowParams(), sub.WindowParams(bucket_bytes=1, sent=1, broadcast_rows=0, broadcast_spans=0, table_bits=17)])
def test_edges(spark, p):
    rng = random.Random(5)
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    passage = fresh(60)
    quoted = [" ".join(fresh(rng.randrange(40)) + passage + fresh(rng.randrange(40))) for _ in range(40)]
    copy = " ".join(fresh(50))
    texts = [None, "", " \n\t ", "one two", "x" * 300_000, "a " * 50_000, "a b c d e " * 20_000, copy, copy, copy, copy.replace(" ", "\n\t "), " ".join(fresh(34)), " ".join(fresh(35))]
    texts += [t := " ".join(fresh(35)), t, " ".join(t.split()[:34]), t.upper(), "é à b " * 12 + "\x00 z", *quoted]
    ids = [None, None] + [7] * (len(texts) - 2)
    assert run(spark, texts, p, ids) == plain(texts)


@settings(max_examples=6, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b", "c"]), max_size=30).map(" ".join), max_size=12))
def test_short_windows(spark, texts):
    texts = [*texts, "a b c"]
    assert run(spark, texts, sub.WindowParams(words=5, gram=3, table_bits=17)) == plain(texts, 5)


def test_empty_table(spark):
    assert sub.without_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_super_kmers_hold_every_window_once(spark):
    import numpy as np
    from corpusloom.llm.textvec import blocks

    rng = random.Random(1)
    texts = [" ".join(f"w{rng.randrange(50)}" for _ in range(n)) for n in (10, 35, 36, 500)]
    p = sub.WindowParams()
    found = {}
    for block in blocks(texts):
        for i, first, key, s in sub.super_kmers(block, np.zeros(1 << 10, np.uint8), p):
            w = s.decode().split(" ")
            for k in range(len(w) - 34):
                found[i, first + k] = (key, w[k : k + 35])
    want = {(i, k): t.split()[k : k + 35] for i, t in enumerate(texts) for k in range(len(t.split()) - 34)}
    assert {k: w for k, (_, w) in found.items()} == want
    by_window = {}
    for key, w in found.values():
        assert by_window.setdefault(tuple(w), key) == key  # equal windows, equal bucket
