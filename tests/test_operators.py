"""Small literal cases of single operators."""

from difflib import SequenceMatcher

from pyspark.sql import functions as F

from corpusloom.functions import text as fx
from corpusloom.operators import audit, chunking, curation, evaluation, history, imports, jobs, lines, retrieval, reuse, supplements
from corpusloom.sources import files
from corpusloom.streaming import jobs as streams


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(column(F.col("c")).alias("x")).first().x


def test_text_functions(spark):
    assert one(spark, fx.clause_references, "Control 5.3 and safeguard 16.1, 5.3") == ["5.3", "16.1"]
    assert one(spark, fx.topic_tokens, "What are the required passwords and testing?") == ["password", "requir", "test"]
    assert one(spark, fx.session_title, "x" * 90) == "x" * 79 + "..."
    assert one(spark, lambda c: fx.shortened(c, 10), "a b  c d e f g h") == "a b c d..."
    assert one(spark, fx.token_estimate, "") == 1
    assert one(spark, lambda c: fx.char_windows(c, 10, 2), "abcdefghijklm") == ["abcdefghij", "ijklm"]
    import uuid

    assert one(spark, lambda c: fx.uuid5(c, uuid.NAMESPACE_DNS.hex), "python.org") == str(uuid.uuid5(uuid.NAMESPACE_DNS, "python.org"))


CAND = "query_id long, rank long, chunk_id string, text string, score double, rerank_score double, clause string, question string"


def test_candidates_are_deduplicated(spark):
    rows = [(1, 1, "a", "Same   passage", 0.9, 0.9, None, ""), (1, 2, "b", " same passage ", 0.8, 0.8, None, ""), (1, 3, "c", "Different passage", 0.7, 0.7, None, "")]
    assert [r.chunk_id for r in retrieval.deduplicated(spark.createDataFrame(rows, CAND)).orderBy("rank").collect()] == ["a", "c"]


def test_exact_clause_match(spark):
    rows = [(1, 1, "a", "x", 0.94, None, "5.3", "What is 5.3?"), (1, 2, "b", "y", 0.80, None, "5.6", "What is 5.3?")]
    got = retrieval.exact_clause_matches(spark.createDataFrame(rows, CAND)).collect()
    assert [(r.chunk_id, r.score) for r in got] == [("a", 1.0)]


def test_routes(spark):
    cases = [(1, "What does 5.3 require?", 0.78, 0.75, "5.3"), (2, "What is it?", 0.9, 0.5, None), (3, "What is it?", 0.72, 0.69, None), (4, "Compare both", 0.9, 0.5, None), (5, "What is 5.3?", 0.1, 0.05, "5.3")]
    q = spark.createDataFrame([(c[0], c[1]) for c in cases], "query_id long, question string")
    ranked = spark.createDataFrame([(c[0], k + 1, str(k), "t", 0.0, c[2 + k], c[4], c[1]) for c in cases for k in (0, 1)], CAND)
    got = {r.query_id: r.route for r in retrieval.routes(q, ranked).collect()}
    assert got == {1: "light", 2: "light", 3: "heavy", 4: "heavy", 5: "reject"}


def test_semantic_reuse(spark):
    schema = "id long, configuration long, question string, vector array<double>"
    responses = spark.createDataFrame([(1, 0, "stored", [1.0, 0.0]), (2, 0, "about 5.3", [1.0, 0.0])], schema).withColumnRenamed("id", "response_id")
    ask = lambda q, v: spark.createDataFrame([(9, 0, q, v)], schema).withColumnRenamed("id", "request_id")
    assert [r.response_id for r in reuse.semantic_matches(ask("again", [0.99, 0.05]), responses).collect()] == [1]
    assert reuse.semantic_matches(ask("about 5.4", [1.0, 0.0]), responses).count() == 0
    assert reuse.semantic_matches(ask("again", [0.78, 0.63]), responses).count() == 0
    assert reuse.semantic_matches(ask("again", [0.78, 0.63]), responses, 0.72, 0.72).count() == 1


def test_null_ids_go_before_ranks(spark):
    ranked = spark.createDataFrame([(1, 1, None), (1, 2, None), (1, 3, "a"), (1, 4, "a")], "query_id long, rank long, chunk_id string")
    want = spark.createDataFrame([(1, "a")], "query_id long, chunk_id string")
    assert tuple(evaluation.retrieval_rows(ranked, want, 5).first()) == (1, True, 2.0, 1.0)


def test_progress(spark):
    log = "INFO [parse 2/2]\n[mineru 1/4] page"
    m = one(spark, jobs.last_marker, log)
    assert (m.phase, m.done, m.total) == ("mineru", 1, 4)
    assert one(spark, jobs.last_marker, "nothing") is None
    j = spark.createDataFrame([(1, "k", 0.0, 30.0, log), (2, "k", 0.0, 10.0, "")], "id long, kind string, started_at double, finished_at double, log string")
    j = j.withColumn("marker", jobs.last_marker(F.col("log"))).withColumn("phases", F.array(*map(F.lit, ("parse", "mineru", "embed"))))
    got = {r.id: r.fraction for r in jobs.progress(j, jobs.median_durations(j), F.lit(600.0)).collect()}
    assert abs(got[1] - (1 + 1 / 4) / 3) < 1e-6 and got[2] == 0.95


def test_loose_json(spark):
    payloads = [("a", '[{"question": "Q1", "answer": "A1"}]'), ("b", '{"prompt": "Q2", "ground_truth": "A2", "context": ["x", "y"]}\n{broken\n{"query": "Q3"}'), ("c", "")]
    rows = imports.loose_records(spark.createDataFrame(payloads, "path string, payload string")).collect()
    assert sorted((r.file, r.line_no, r.error is None) for r in rows) == [("a", 1, True), ("b", 1, True), ("b", 2, False), ("b", 3, True)]
    c = imports.canonical(spark.createDataFrame(rows, imports.IMPORT_SCHEMA)).where("record is not null").collect()
    assert {(r.query, r.reference_answer, r.source_text) for r in c} == {("Q1", "A1", ""), ("Q2", "A2", "x\n\ny"), ("Q3", "", "")}


def test_review(spark):
    source = "Passwords must be at least fourteen characters long for every account in the enterprise network today"
    rows = [("k1", "How long must passwords be here?", "At least fourteen characters", source, ["c1"]), ("k2", "Known question of old days, really?", "At least fourteen characters", source, ["c1"]), ("k3", "How long must passwords be now?", "Bananas grow quickly", source, ["c1"]), ("k4", "How long must passwords be then?", "At least fourteen characters", source, []), ("k5", "How long?", "", "", ["c9"])]
    r = spark.createDataFrame(rows, "row_key string, query string, reference_answer string, source_text string, relevant_chunk_ids array<string>")
    chunks = spark.createDataFrame([("c1", f"Intro. {source}. More of it."), ("c2", "Something else altogether")], "chunk_id string, text string")
    got = {x.row_key: x for x in imports.reviewed(r, spark.createDataFrame([("known question of OLD days, really?",)], "query string"), chunks).collect()}
    # Content 20, alignment 35, support 15, id 15 (8 if only suggested), question 10 (3), new 5.
    assert {k: (x.score, x.recommendation) for k, x in got.items()} == {"k1": (100, "Ready to add"), "k2": (95, "Do not add"), "k3": (85, "Do not add"), "k4": (93, "Human review"), "k5": (14, "Do not add")}
    assert got["k1"].positives == ["source aligned", "answer supported", "chunk id agrees"] and got["k4"].cautions == ["other chunk id suggested"] and "unknown chunk id" in got["k5"].cautions


def test_record_discovery(spark):
    payload = '{"meta": {"x": 1}, "data": [{"User Input": "Q", "nested": {"target": "A"}}, {"question": "Q2", "ideal-answer": {"role": "x", "page_content": "A2"}, "documents": [{"text": "S1"}, "S2"]}, {"chat": [{"speaker": "Human", "message": "Q3"}, {"author": "bot", "value": "A3"}]}, {"other": 1}]}'
    rows = imports.loose_records(spark.createDataFrame([("f", payload)], "path string, payload string"))
    got = imports.canonical(rows).orderBy("row_no").select("query", "reference_answer", "source_text").collect()
    assert [tuple(r) for r in got] == [("", "A", ""), ("Q2", "A2", "S1\n\nS2"), ("Q3", "A3", "")]


def test_supplements(spark):
    base = " ".join(f"word{i}" for i in range(60))
    rows = [(1, base, base, []), (2, base + " more", base, []), (3, "new " * 30 + base, base, []), (4, "too short", base, []), (5, "alien text " + " ".join(f"other{i}" for i in range(30)), base, []), (6, base[:300] + " and quite new words after it to keep", "", ["cis_summary_table"]), (7, "IG1 IG2 IG3 Safeguards Total of all the controls that are here", "", ["cis_summary_table"])]
    df = spark.createDataFrame(rows, "k int, text string, base string, reasons array<string>")
    assert sorted(r.k for r in supplements.accepted(df).collect()) == [3, 7]
    pages = spark.createDataFrame([(1, 1, "x" * 900, True, True), (1, 2, "Safeguards total IG1 IG2 IG3" + "x" * 900, False, False), (1, 3, "x", True, False), (1, 4, "x" * 500, True, False), (1, 5, "x" * 500, False, False)], "doc int, page_number int, text string, has_image boolean, asked boolean")
    assert [(r.page_number, r.priority) for r in supplements.selected_pages(pages, 0).orderBy("priority").collect()] == [(1, 0), (2, 1), (3, 2), (4, 3)]


def test_table_markdown(spark):
    html = "<table><tr><th>A</th><th>B</th></tr><tr><td>1</td></tr></table>"
    assert one(spark, supplements.table_markdown, html) == "| A | B |\n| --- | --- |\n| 1 |  |"
    assert one(spark, supplements.table_markdown, "<p>no <b>rows</b></p>") == "no rows"


def test_sources(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"text": "a", "metadata": {"chunk_id": "c1"}}\nbroken\n{"metadata": {}}\n')
    good, bad = files.lenient_chunks(spark, str(tmp_path / "x.jsonl"))
    assert good.count() == 1 and sorted(r.reason for r in bad.collect()) == ["no text", "not JSON"]
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.pdf").write_bytes(b"%PDF-1.7")
    (tmp_path / "d" / "b.pdf").write_bytes(b"hello")
    found = files.documents_in(spark, str(tmp_path)).select("path", "length", "content")
    empty = spark.createDataFrame([("x/c.pdf", 0, b"")], found.schema)  # Spark's scan itself leaves empty files out
    got = files.admission(found.unionByName(empty)).collect()
    assert {r.path[-5:]: r.rejected for r in got} == {"a.pdf": None, "b.pdf": "no PDF header", "c.pdf": "empty file"}
    files.write_chunks(good, str(tmp_path / "out"))
    assert files.strict_jsonl(spark, str(tmp_path / "out"), files.CHUNK_SCHEMA).first().metadata.chunk_id == "c1"


def test_layout_folds(spark):
    rows = [(1, 1, 0, "abc", 10.0, 10.0), (1, 1, 1, "abcd", 10.5, 10.5), (1, 1, 2, "zz", 90.0, 10.0)]
    df = spark.createDataFrame(rows, "doc long, page_number long, line_no long, text string, x0 double, y0 double")
    assert [r.text for r in lines.without_near_duplicates(df).orderBy("line_no").collect()] == ["abcd", "zz"]


def test_audit_fields(spark):
    assert one(spark, lambda c: audit.sanitised(c, 5), " a\x00b\x85cdefg ") == "abcde"
    assert one(spark, audit.is_auditable, "/API/rag/x") and not one(spark, audit.is_auditable, "/api/ragged")


def test_feedback_reasons(spark):
    once, bad = history.reasons(F.array(F.lit("clear"), F.lit("x"), F.lit("clear")))
    r = spark.range(1).select(once.alias("o"), bad.alias("b")).first()
    assert (r.o, r.b) == (["clear", "x"], ["x"])
