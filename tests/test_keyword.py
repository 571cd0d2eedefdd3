"""The inverted index with score bounds against summing every posting."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import keyword, retrieval as rt


def rows_of(df):
    return sorted((r.query_id, r.rank, r.chunk_id, round(r.score, 5)) for r in df.collect())


def texts(rng, n, words, most):
    return [" ".join(rng.choices(words, weights=[1 / (i + 1) for i in range(len(words))], k=rng.randrange(most))) for _ in range(n)]


@pytest.mark.parametrize("p", [keyword.KeywordParams(), keyword.KeywordParams(block=7, levels=3, probe=1, broadcast_rows=0)])
@pytest.mark.parametrize("k", [1, 5])
def test_equals_the_full_sum(spark, p, k):
    rng = random.Random(k)
    words = [f"t{i}" for i in range(300)]
    bodies = texts(rng, 250, words, 40)
    chunks = spark.createDataFrame([(f"c{i:04d}", t) for i, t in enumerate([*bodies, None, "", "!?", bodies[3], bodies[3]])], "chunk_id string, text string").withColumn("term", F.lit("clash"))
    asked = [*texts(rng, 20, words, 30), None, "", "unknown words", bodies[3], bodies[3].upper(), "t0 t1", "t299"]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id int, text string").withColumn("df", F.lit("clash"))
    want = rt.top_k(rt.bm25(chunks, queries), k, "chunk_id")
    assert rows_of(keyword.bm25_top(chunks, queries, k, p=p)) == rows_of(want)


def test_common_terms_are_skipped(spark, monkeypatch):
    """A term of every chunk is never joined with the question once rare terms give a bound."""
    chunks = spark.createDataFrame([(f"c{i:04d}", "the common text of all " + (f"rare{i} word{i}" if i < 40 else f"other{i}")) for i in range(400)], "chunk_id string, text string")
    queries = spark.createDataFrame([(1, "the common text of all rare3 word3"), (2, "the common text of all rare5 word5")], "query_id int, text string")
    read, sums = [], keyword._sums
    monkeypatch.setattr(keyword, "_sums", lambda asked, blocks: read.append({r.term for r in asked.collect()}) or sums(asked, blocks))
    got = rows_of(keyword.bm25_top(chunks, queries, 1, p=keyword.KeywordParams(probe=2)))
    assert [(q, c) for q, _, c, _ in got] == [(1, "c0003"), (2, "c0005")]
    assert read[1] <= {"rare3", "word3", "rare5", "word5"}


def test_no_chunks_and_no_questions(spark):
    chunks = spark.createDataFrame([("a", "some words")], "chunk_id string, text string")
    queries = spark.createDataFrame([(1, "words")], "query_id int, text string")
    assert keyword.bm25_top(chunks.limit(0), queries, 3).collect() == []
    assert keyword.bm25_top(chunks, queries.limit(0), 3).collect() == []


def test_sums_of_a_chunk_are_made_where_its_blocks_lie(spark):
    """Blocks are shuffled by part, and no row of a question and a chunk is."""
    chunks = spark.createDataFrame([(f"c{i:04d}", f"the common text {i % 7}") for i in range(100)], "chunk_id string, text string")
    asked = spark.createDataFrame([(1, "common", 1.0), (1, "3", 2.0), (2, "text", 1.0), (3, "none", 1.0)], "query_id int, term string, idf double")
    blocks, _, _ = keyword.index(chunks, asked, "chunk_id", keyword.KeywordParams(block=2, levels=3))
    found = keyword._sums(F.broadcast(asked), blocks)
    assert found.groupBy("query_id").count().count() == 2 and found.count() == 200
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("hashpartitioning(") == 1 and "hashpartitioning(part" in plan


def test_terms_are_counted_by_runs(spark):
    chunks = spark.createDataFrame([("a", "b a b c B"), ("b", None), ("c", ""), ("d", "a")], "chunk_id string, text string")
    asked = spark.createDataFrame([("b",), ("a",)], "term string")
    df = keyword.postings(chunks, asked, "chunk_id", keyword.KeywordParams())
    assert "array_remove" not in df._jdf.queryExecution().optimizedPlan().toString()
    got = df.collect()
    ids = {r.c: r.chunk_id for r in got if r.term is None}
    want = {(None, "a", 5, None), (None, "b", 0, None), (None, "c", 0, None), (None, "d", 1, None), ("a", "a", 5, 1), ("b", "a", 5, 3), ("a", "d", 1, 1)}
    assert {(r.term, ids[r.c], r.len, r.tf) for r in got} == want and len(got) == 7
