"""Plans whose shuffles and work grow with the input alone."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from corpusloom.functions import text as fx
from corpusloom.llm import scratch
from corpusloom.operators import chunking, lines, supplements
from corpusloom.plans.documents import chunks
from corpusloom.plans.history import golden


def plan(df, which="executedPlan"):
    return getattr(df._jdf.queryExecution(), which)().toString()


def test_parts_are_written_and_shuffled_once(spark, monkeypatch):
    """Of packing: a part's text is not kept a second time beside the next part, nor dealt by its place."""
    seen, kept = {}, chunking.kept
    monkeypatch.setattr(chunking, "kept", lambda df, name: seen.setdefault(name, df.columns) and kept(df, name))
    df = spark.createDataFrame([(1, "A one. B two. C three."), (2, "\n\n".join("word " * 200 + str(i) for i in range(9))), (3, "x"), (4, "")], "doc_id int, text string")
    made = chunking.packed(df, ["doc_id"])
    assert "follows" not in seen["parts"]
    assert {r.doc_id for r in made.collect()} == {1, 2, 3}
    assert "SortMergeJoin" not in plan(made) and "BroadcastHashJoin" not in plan(made)


def test_lines_are_assembled_by_one_shuffle(spark):
    rng = random.Random(3)
    rows = [(d, 1, n, s, rng.choice(["a", "bb", "ccc ", " ", "dddd"]), rng.choice([None, 8.0, 9.0, 10.0]), rng.choice([True, False, None])) for d in range(6) for n in range(5) for s in range(rng.randrange(9))]
    rng.shuffle(rows)
    made = lines.assemble_spans(spark.createDataFrame(rows, "doc int, page_number int, line_no int, span_no int, text string, font_size double, is_bold boolean"))
    assert plan(made).split("== Initial Plan ==")[-1].count("Exchange") == 1
    want = {}
    held = defaultdict(list)
    for r in sorted(rows, key=lambda r: r[:4]):
        if r[4].strip():
            held[r[:3]].append(r[3:])
    for key, spans in held.items():
        mass = defaultdict(int)
        for _, text, size, _ in spans:
            mass[size] += len(text)
        bold = [b for *_, b in spans if b is not None]
        want[key] = ("".join(t for _, t, _, _ in spans).strip(), max(mass, key=mass.get), any(bold) if bold else None)
    assert {(r.doc, r.page_number, r.line_no): (r.text, r.font_size, r.is_bold) for r in made.collect()} == want


def test_pages_meet_chunks_by_key(spark):
    rng = random.Random(5)
    chunks = [(d, i, f"t{i}", a, a + rng.choice([-1, 0, 0, 1, 2, 3, 7, 40])) for d in range(3) for i in range(30) for a in [rng.randrange(-3, 60)]]
    chunks += [(0, 99, "none", None, 4), (0, 98, "none", 4, None), (None, 97, "none", 0, 9), (2, 96, "all", -(1 << 40), 1 << 40)]
    pages = [(d, n) for d in range(4) for n in range(-2, 70, 3)] + [(None, 4), (1, None)]
    found = supplements.base_text(spark.createDataFrame(pages, "doc int, page_number long"), spark.createDataFrame(chunks, "doc int, chunk_index int, text string, page_start long, page_end long"))
    want = {}
    for d, n in pages:
        hit = sorted((i, t) for c, i, t, a, b in chunks if None not in (d, n, c, a, b) and c == d and a <= n <= b)
        if hit:
            want[d, n] = "\n".join(t for _, t in hit)
    assert {(r.doc, r.page_number): r.base for r in found.collect()} == want
    assert "_at" in plan(found).split("== Initial Plan ==")[0] and "_power" in plan(found)


def test_words_of_supplements_are_cut_once(spark):
    df = spark.createDataFrame([(1, "some words " * 9, "other words " * 30)], "k int, text string, base string")
    assert plan(supplements.accepted(df), "optimizedPlan").count("regexp_extract_all") == 2


def test_shares_are_those_of_difflib(spark):
    from difflib import SequenceMatcher

    rng = random.Random(7)
    rows = [("", ""), ("a", ""), ("abc", "abc"), ("abc", "cba")] + [("".join(rng.choices("abcde ", k=300)),) * 2 for _ in range(3)] + [("".join(rng.choices("abcdefgh ", k=250)), "".join(rng.choices("abcdefgh ", k=250))) for _ in range(3)]
    for least in (0.0, 0.6, 0.97):
        got = spark.createDataFrame(rows, "a string, b string").select("a", "b", supplements.matching_share("a", "b", least).alias("s")).collect()
        for a, b, s in got:
            m = SequenceMatcher(None, a, b)
            assert s == (m.ratio() if m.real_quick_ratio() >= least and m.quick_ratio() >= least else 0.0)


def test_chunk_ids_cut_no_texts_and_questions_no_whole_text(spark, sf_dir):
    """Of g12: ids need the length of a text, a question its first six words."""
    assert "substring" in plan(chunks(spark, sf_dir), "optimizedPlan")
    assert "substring" not in plan(chunks(spark, sf_dir).select("doc_id", "chunk_index"), "optimizedPlan")
    assert ",  , 7)" in plan(golden(spark, sf_dir).select("query"), "optimizedPlan")
    texts = ["", "x", "é" * 1600, "ab" * 801, "漢字é" * 1000, " a  b c d e f g ", " " * 9, "one two three four five six", "a b c d e f  "]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "text string")
    got = df.select("text", fx.char_windows(F.col("text"), 1600, 240).alias("w"), fx.window_starts(F.col("text"), 1600, 240).alias("s"), F.slice(F.split("text", " "), 1, 6).alias("a"), F.slice(F.split("text", " ", 7), 1, 6).alias("b")).collect()
    for r in got:
        assert r.w == (None if r.s is None else [r.text[i : i + 1600] for i in r.s]) and r.a == r.b


def test_overlaps_shuffle_lists_once(spark):
    """spans are dealt once, as lists of neighbours and not one by one, whatever the batches cut; the fold stays."""
    rows = [(d, 1, n, i, f"w{i}" + "x" * (i % 3), 10.0 * (i - (i % 5 == 4)), 10.0 * (i - (i % 5 == 4)) + 9, 0.0, 9.0) for d in range(3) for n in range(4) for i in range(23)]
    rows += [(9, 1, 1, 0, "a", 0.0, 9.0, 0.0, 9.0), (9, 1, 1, 1, "  ", 0.0, 9.0, 0.0, 9.0), (9, 1, 1, 2, "longer", 1.0, 9.0, 0.0, 9.0)]
    spans = spark.createDataFrame(rows, "doc long, page_number long, line_no long, span_no int, text string, x0 double, x1 double, y0 double, y1 double").repartition(3)
    want = {(9, 1, 2)} | {(d, n, i) for d, _, n, i, text, *_ in rows if d < 9 and (i % 5 != 4 or len(text) > len(f"w{i - 1}" + "x" * ((i - 1) % 3))) and not (i % 5 == 3 and i < 22 and len(f"w{i + 1}" + "x" * ((i + 1) % 3)) > len(text))}
    for size in (7, 10_000):
        with scratch.python_batches(spark, size):
            made = lines.without_overlaps(spans)
            assert {(r.doc, r.line_no, r.span_no) for r in made.collect()} == want
    final = plan(made).split("== Initial Plan ==")[0]
    dealt = [x for x in final.splitlines() if " Exchange hashpartitioning" in x and "ReusedExchange" not in x]
    assert len(dealt) == 1 and final.count("ReusedExchange") == 1 and "MapInArrow" in final[final.index(dealt[0]) :]
