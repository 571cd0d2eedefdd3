"""Cases by hand: imports, review, promotion, overlap and table annotations. Nothing here reads the library's own lists."""

import json

from pyspark.sql import functions as F

from corpusloom.operators import chunking, curation, imports


def fields(spark, *records):
    rows = [("f", i + 1, i + 1, json.dumps(r) if not isinstance(r, str) else r, None) for i, r in enumerate(records)]
    got = imports.canonical(spark.createDataFrame(rows, imports.IMPORT_SCHEMA).withColumn("query", F.lit("clash"))).orderBy("row_no").collect()
    return [(r.query, r.reference_answer, r.source_text, r.relevant_chunk_ids, r.verified, r.provenance) for r in got]


def test_fields_under_other_names(spark):
    deep = {"a": {"b": {"c": {"d": {"e": {"f": {"g": {"h": {"Question Text": "deep"}}}}}}}}}
    got = fields(
        spark,
        {"prompt": " Q ", "Expected-Output": 5, "contexts": [{"page_content": "one"}, "two", {"id": 7, "type": "x", "note": "three"}], "chunk ids": ["c1", " c2 ", ""], "verified": True, "provenance": "book"},
        {"question": "", "input": "second name", "meta": {"question": "inner first name"}, "relevant_ids": "c1, c2,,c3 ", "verified": "no"},
        {"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "q1"}, {"role": "assistant", "content": [{"text": "a1"}, {"text": "more"}]}, {"from": "human", "value": "q2"}, {"role": "tool", "content": "x"}], "ids": [1], "chunk_id": 4},
        {"query": {"role": "user", "content": {"value": "nested text"}}, "answer": True, "verified": 0},
        deep,
        {"other": [1, 2], "chunk_ids": [1, 2.5]},
    )
    assert got[0] == ("Q", "5", "one\n\ntwo\n\nthree", ["c1", "c2"], True, "book")
    assert got[1] == ("inner first name", "", "", ["c1", "c2", "c3"], True, "uploaded-json-review")
    assert got[2] == ("q2", "a1\n\nmore", "", [], False, "uploaded-json-review")
    assert got[3] == ("nested text", "True", "", [], False, "uploaded-json-review")
    assert got[4][0] == "deep"
    assert got[5] == ("", "", "", ["1", "2.5"], False, "uploaded-json-review")


def test_records_of_loose_files(spark):
    payloads = [
        ("whole", json.dumps({"rows": [{"question": "Q1", "answer": "A1", "extra": {"question": "inner", "answer": "inner"}}, {"wrap": {"context": "S"}}, {"nothing": 1}]})),
        ("loose", '﻿{"question": "a", "answer": "b"}, {"question": "c", "answer": "d"}\n\n{broken\n[{"question": "e"}]\n{"answer": "f"} trailing'),
        ("none", "just words"),
        ("empty", None),
        ("chat", json.dumps([{"conversation": [{"author": "human", "text": "q"}, {"author": "gpt", "text": "a"}], "question": "outer"}])),
    ]
    rows = imports.loose_records(spark.createDataFrame(payloads, "path string, payload string")).collect()
    good = sorted((r.file, r.row_no, json.loads(r.record)) for r in rows if r.error is None)
    assert [(f, n) for f, n, _ in good] == [("chat", 1), ("loose", 1), ("loose", 2), ("loose", 3), ("loose", 4), ("whole", 1), ("whole", 2)]
    assert good[5][2]["question"] == "Q1" and good[6][2] == {"context": "S"} and good[0][2]["question"] == "outer"
    bad = sorted((r.file, r.line_no) for r in rows if r.error is not None)
    assert bad == [("loose", 3), ("loose", 5), ("none", 1)]
    keys = imports.row_keys(spark.createDataFrame(rows, imports.IMPORT_SCHEMA).where("file = 'whole'"), F.lit(b"payload")).select("row_key").collect()
    assert len({k.row_key for k in keys}) == 2 and all(k.row_key[12] == "-" for k in keys)
    assert imports.loose_records(spark.createDataFrame([], "path string, payload string")).collect() == []


def test_verified_records(spark):
    rows = [("k1", " Q ", ["zz", "c2", "c1"], "c1"), ("k2", "Q", ["c2"], "c1"), ("k3", "Q", ["zz"], None), ("k4", "Q", ["c1"], "c1")]
    df = spark.createDataFrame([(k, q, ids, m, " A ", " S ", 90, 0.9, 0.8) for k, q, ids, m in rows], "row_key string, query string, relevant_chunk_ids array<string>, matched_chunk_id string, reference_answer string, source_text string, score int, alignment double, support double")
    ok = spark.createDataFrame([("k1",), ("k2",), ("k3",), ("k3",)], "row_key string")
    chunks = spark.createDataFrame([("c1",), ("c2",), ("c2",)], "chunk_id string")
    got = {r.row_key: r for r in imports.verified_records(df, ok, chunks).collect()}
    assert {k: r.relevant_chunk_ids for k, r in got.items()} == {"k1": ["c2", "c1"], "k2": ["c1"], "k3": []}
    assert (got["k1"].query, got["k1"].reference_answer, got["k1"].source_text, got["k1"].verified, got["k1"].provenance) == ("Q", "A", "S", True, "human-reviewed-json-upload")


def test_overlap_counts_numbers_whole_and_skips_stop_words(spark):
    rows = [("This is under control 5.3", "see 5.3 here"), ("Under this", "under this"), ("5 and 3", "5.3"), (None, "x"), ("the Safeguard", "SAFEGUARD")]
    df = spark.createDataFrame(rows, "a string, s string")
    assert [r.o for r in df.select(curation.overlap(F.col("a"), F.col("s")).alias("o")).collect()] == [0.5, 0.0, 0.0, 0.0, 1.0]


def test_promotion_and_known_ids(spark):
    cands = spark.createDataFrame([(1, "New  question?", "old", "src"), (2, "Known", "x", "y"), (3, "Another", "keep", "this")], "seq long, query string, reference_answer string, source_text string").withColumn("verified", F.lit(False)).withColumn("provenance", F.lit("p"))
    decisions = spark.createDataFrame([(1, "approve", " edited "), (2, "approve", None), (3, "reject", None), (1, "approve", " edited ")], "seq long, decision string, reference_answer string")
    existing = spark.createDataFrame([("KNOWN",)], "query string")
    got = curation.promoted(cands, decisions, existing).collect()
    assert [(r.seq, r.reference_answer, r.source_text, r.verified, r.provenance) for r in got] == [(1, "edited", "src", True, "human-reviewed-ui")]
    text = "A safeguard must be in place for every asset of the enterprise network."
    records = spark.createDataFrame([("a", "q", "r", text, ["c9", "c2", "c1"]), ("b", "q", "r", "", ["c1"]), ("c", "q", "r", text, ["zz"]), ("d", "q", "r", "unrelated", []), ("e", "", "r", text, None)], "row_key string, query string, reference_answer string, source_text string, relevant_chunk_ids array<string>")
    chunks = spark.createDataFrame([("c1", f"Intro {text}"), ("c2", "other words")], "chunk_id string, text string")
    got = {r.row_key: (r.relevant_chunk_ids, r.error) for r in curation.normalised_records(records, chunks).collect()}
    assert got == {"a": (["c2", "c1"], None), "b": (["c1"], "no source"), "c": (["c1"], None), "d": (None, "no chunk"), "e": (["c1"], "no question")}


def test_table_annotations_of_a_page(spark):
    dot = "•"
    page1 = ["IG1@100", "IG2@200", f"{dot}@100", "5.1@10", "Devices@20", f"{dot}@104", "x@200", f"{dot}@213", "-Protect-@50", "Data@20", "5.2 Inventory@10", "5.3@10", f"{dot}@200", "5.1@10", f"{dot}@200"]
    page2 = ["IG1@100", f"{dot}@100", "6.1@10", "-Detect-@5"]
    page3 = ["7.1@10", f"{dot}@100"]  # no labels: no table
    rows = [(1, p, i, c.split("@")[0], float(c.split("@")[1])) for p, page in enumerate((page1, page2, page3)) for i, c in enumerate(page)]
    lines = spark.createDataFrame([*rows, (2, 0, 0, None, 1.0)], "doc long, page_number int, line_no int, text string, x0 double")
    got = {r.clause_number: (r.asset_type, r.security_function, r.applicable_groups) for r in chunking.table_annotations(lines).collect()}
    assert got == {"5.1": (None, None, ["IG2"]), "5.3": (None, None, ["IG2"]), "6.1": (None, "Detect", [])}
    one = chunking.table_annotations(lines.where("page_number = 0 and line_no < 13")).where("clause_number = '5.1'").first()
    assert (one.asset_type, one.security_function, one.applicable_groups) == ("Data", "Protect", ["IG1"])
