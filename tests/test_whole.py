"""Cases where a query once did less than the whole job."""

from statistics import median

from pyspark.sql import functions as F

from corpusloom.operators import retrieval
from corpusloom.plans import QUERIES


def test_every_twentieth_vector_asks_all(spark, sf_dir):
    ids = {r.vec_id for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id").collect()}
    rows = QUERIES["r5_vector_leg"](spark, sf_dir).collect()
    assert {r.query_id for r in rows} == {i for i in ids if i % 20 == 0}
    assert len(rows) == 20 * len({r.query_id for r in rows}) and {r.query_id for r in rows if r.rank == 1 and r.score == 1} == {r.query_id for r in rows}
    assert {r.query_id for r in QUERIES["e1_retrieval_metrics"](spark, sf_dir).collect()} == {i for i in ids if i % 20 == 0}
    assert any(r.response_id % 20 < 4 for r in QUERIES["a6_semantic_match"](spark, sf_dir).collect())


def test_questions_in_parts(spark):
    q = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(7)], "query_id long, q array<double>")
    v = q.select(F.col("query_id").alias("passage_id"), F.col("q").alias("v"))
    whole = retrieval.vector_scores(q, v).collect()
    assert len(whole) == 49 and sorted(retrieval.vector_scores(q, v, 2).collect()) == sorted(whole)


def test_spans_of_every_line(spark, tmp_path):
    spark.createDataFrame([(1, "\n".join(f"line {i} words" for i in range(47)))], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("l1_span_overlaps", "l2_line_assembly"):
        assert {r.line_no for r in QUERIES[name](spark, str(tmp_path)).collect()} == set(range(47))


def test_all_events_are_jobs(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").collect()
    kinds = {}
    for e in events:
        kinds.setdefault(e.event_type, {})[e.event_id] = e.value
    want = {i: round(median(v for k, v in ds.items() if k != i), 6) for ds in kinds.values() for i in ds if len(ds) > 1}
    got = {r.id: r.median_seconds for r in QUERIES["j3_median_durations"](spark, sf_dir).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 2e-6 for i in want)
    assert {r.id for r in QUERIES["j5_progress"](spark, sf_dir).collect()} == {e.event_id for e in events}


def test_whole_passages_are_asked(spark, tmp_path):
    late = "zebra quagga okapi"
    filler = " ".join(f"filler{i}" for i in range(20))
    spark.createDataFrame([(1, f"{late} live here.", "en"), (2, "Something else is here.", "en")], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(5, f"{filler} {late}")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert {(r.query_id, r.chunk_id.split("-")[0]) for r in QUERIES["r4_keyword_leg"](spark, str(tmp_path)).collect()} == {(5, "1")}
