"""Topic matches and order statistics against plain Python."""

import random
import time
from statistics import median

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import corpus, evaluation, imports, jobs, lines, ranks, retrieval, reuse
from corpusloom.plans import QUERIES


@pytest.mark.parametrize("least", [0.5, 0.75])
def test_topic_matches(spark, least):
    rng = random.Random(7)
    words = [f"term{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)]
    say = lambda: " ".join(rng.choices(words, weights=[1 / (i + 1) for i in range(60)], k=rng.randrange(0, 12)))
    asks = [(i, say() + rng.choice(["", "", " about 5.3"]), i % 2) for i in range(300)]
    asks += [(1000 + i, "the commonest terma question of all", 0) for i in range(40)] + [(2000, None, 0), (2001, "", 1)]
    gives = [(i, say() + rng.choice(["", " in 5.3"]), i % 2) for i in range(300)] + [(900 + i, "commonest question terma", 0) for i in range(40)]
    req = spark.createDataFrame(asks, "request_id long, question string, configuration int").withColumn("order", F.lit("clash"))
    res = spark.createDataFrame(gives, "response_id long, question string, configuration int").withColumn("n", F.lit("clash"))
    tokens = lambda df, key: {r[0]: (r.configuration, tuple(r.c), frozenset(r.t)) for r in df.select(key, "configuration", reuse.fx.topic_tokens(F.col("question")).alias("t"), reuse.fx.bounded_clauses(F.col("question")).alias("c")).collect()}
    q, r = tokens(req, "request_id"), tokens(res, "response_id")
    want = {}
    for i, (conf, clauses, a) in q.items():
        best = None
        for j, (conf2, clauses2, b) in sorted(r.items()):
            s = len(a & b)
            if conf == conf2 and clauses == clauses2 and s >= 2 and s / min(len(a), len(b)) >= least:
                o = round(s / min(len(a), len(b)), 6)
                if best is None or o > best[1]:
                    best = (j, o)
        if best:
            want[i] = best
    got = {x.request_id: (x.response_id, x.overlap) for x in reuse.topic_matches(req, res, least).collect()}
    assert got == want and len(want) > 100


def test_topic_lists_are_shuffled_and_short(spark):
    """lists of words are never broadcast, and a set of 300 words is not listed for the square of them."""
    text = lambda i: " ".join(f"w{i}x{chr(97 + k % 26)}{k}q" for k in range(300))
    req = spark.createDataFrame([(i, text(i), 0) for i in range(4)], "request_id long, question string, configuration int")
    got = reuse.topic_matches(req, req.withColumnRenamed("request_id", "response_id"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "sequence(2" not in plan
    assert sorted((r.request_id, r.response_id, r.overlap) for r in got.collect()) == [(i, i, 1.0) for i in range(4)]


def test_medians_of_a_hot_kind(spark):
    rng = random.Random(3)
    rows = [(i, "hot", 0.0, rng.randrange(50) / 7) for i in range(900)] + [(1000 + i, f"k{i % 7}", 0.0, rng.random()) for i in range(40)]
    rows += [(2000, "alone", 0.0, 1.0), (2001, "two", 0.0, 1.0), (2002, "two", 0.0, 5.0), (2003, None, 0.0, 2.0), (2004, None, 0.0, 4.0), (2005, "two", None, 9.0), (2006, "two", 1.0, None)]
    df = spark.createDataFrame(rows, "id long, kind string, started_at double, finished_at double").withColumn("d", F.lit("clash"))
    done = {}
    for i, k, a, b in rows:
        if a is not None and b is not None:
            done.setdefault(k, {})[i] = b - a
    want = {i: median(v for j, v in ds.items() if j != i) for ds in done.values() for i in ds if len(ds) > 1}
    got = {r.id: r.median_seconds for r in jobs.median_durations(df).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)
    rows_, sizes = ranks.ranked(df.where("kind = 'hot'").select("kind", "finished_at", "id"), "kind", ["finished_at", "id"])
    got = [r.id for r in rows_.orderBy("_rank").collect()]
    assert got == [i for _, i in sorted((b, i) for i, k, _, b in rows if k == "hot")] and sizes.collect()[0]._n == 900
    assert {r.kind: round(r.median, 9) for r in ranks.medians(df.withColumn("v", F.col("finished_at")), "kind", "v", ["id"]).where("kind in ('hot', 'two')").collect()} == {"hot": round(median(b for _, k, _, b in rows if k == "hot"), 9), "two": 5.0}


def test_corpus_medians(spark):
    df = spark.createDataFrame([("a", x) for x in (5, 1, 9, 1)] + [("b", 3), ("b", None), ("c", None)], "g string, v int")
    assert {r.g: r.value for r in corpus.medians(df, ["g"], "v").collect()} == {"a": 3.0, "b": 3.0}


def test_marks_beside_accented_letters(spark):
    """an accented letter beside a word is no part of it, as in the SQL."""
    df = spark.createDataFrame([("è tionè ètion Tion_ tion2 TION tion",)], "text string")
    assert df.select(retrieval.marked_keywords(F.lit("a tion"), F.col("text"))).first()[0] == "è *tion*è è*tion* Tion_ tion2 *TION* *tion*"


def test_relevant_passages_are_counted_by_label(spark):
    """the same figures as from pairs, and no join makes a row for each question and relevant passage."""
    rng = random.Random(5)
    passages = spark.createDataFrame([(i % 190 if i % 50 else None, rng.choice([0, 1, 2, None])) for i in range(200)] + [(None, 9)], "chunk_id long, label int")
    asked = spark.createDataFrame([(i % 36, rng.choice([0, 1, 2, 9, None])) for i in range(40)], "query_id long, label int")
    ranked = spark.createDataFrame([(q, rng.randrange(190) if r % 5 else None, r) for q in range(36) for r in range(1, 15)], "query_id long, chunk_id long, rank int")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    got = evaluation.labelled_rows(ranked, asked, passages, 10)
    want = evaluation.retrieval_rows(ranked, asked.join(passages, "label").select("query_id", "chunk_id"), 10)
    assert rows(got) == rows(want) and any(r[1] for r in rows(want))


def test_overlaps_of_long_lines(spark):
    """the fold of each line, in time that grows with its spans."""
    rng = random.Random(9)
    rows = []
    for line in range(60):
        for n in rng.sample(range(40), 14):
            x, y = rng.choice([None, float(rng.randrange(40))] if line % 7 == 0 else [float(rng.randrange(40))]), float(rng.randrange(2))
            rows.append((1, 1, line, n, "a" * rng.randrange(5) + " ", x, None if rng.random() < 0.03 else (x or 0.0) + rng.randrange(8), y, y + rng.randrange(0, 4)))
    rows += [(2, 1, 0, n, "word", 10.0 * n, 10.0 * n + 9, 0.0, 9.0) for n in range(12_000)]
    df = spark.createDataFrame(rows, "doc long, page_number long, line_no long, span_no int, text string, x0 double, x1 double, y0 double, y1 double")
    began = time.time()
    got = {}
    for r in lines.without_overlaps(df).collect():
        got.setdefault((r.doc, r.line_no), set()).add(r.span_no)
    assert time.time() - began < 30 and len(got.pop((2, 0))) == 12_000
    some = lambda f, *v: f([x for x in v if x is not None]) if any(x is not None for x in v) else None
    less = lambda a, b: None if a is None or b is None else a - b

    def clash(s, v):
        x, y = less(some(min, s[6], v[6]), some(max, s[5], v[5])), less(some(min, s[8], v[8]), some(max, s[7], v[7]))
        size = [less(t[6], t[5]) for t in (s, v)]
        area = some(min, *[None if a is None else a * (t[8] - t[7]) for a, t in zip(size, (s, v), strict=True)])
        return None not in (x, y, area) and x > 0 and y > 0 and area > 0 and x * y / area > 0.7

    want = {}
    for s in sorted((r for r in rows if r[0] == 1 and r[4].strip()), key=lambda r: (r[2], r[3])):
        kept = want.setdefault((1, s[2]), [])
        rival = next((v for v in kept if clash(s, v)), None)
        if rival is None:
            kept.append(s)
        elif len(s[4].strip()) > len(rival[4].strip()):
            kept.remove(rival)
            kept.append(s)
    assert got == {k: {s[3] for s in v} for k, v in want.items()}


def test_transcripts_need_no_review(spark, sf_dir, monkeypatch):
    """records are read without the alignment of a review, which none of the columns comes from."""
    monkeypatch.setattr(imports, "reviewed", None)
    assert QUERIES["g14_transcripts"](spark, sf_dir).count() > 0
