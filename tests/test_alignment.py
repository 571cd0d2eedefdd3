"""Alignment of passages with chunks against comparing every passage with every chunk."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import alignment
from corpusloom.plans.documents import chunks as chunk_rows


def squeeze(t):
    return " ".join((t or "").split())


def every_pair(sources, chunks, least):
    """{source: (chunk, score)} with difflib over all chunks; the first chunk by id wins."""
    out = {}
    for key, text in sources:
        needle, best, score = squeeze(text), None, 0.0
        for chunk, body in sorted((c, squeeze(b)) for c, b in chunks if c is not None and squeeze(b)):
            if needle in body:
                best, score = chunk, 1.0
                break
            s = sum(m.size for m in SequenceMatcher(None, needle, body, autojunk=False).get_matching_blocks()) / max(1, len(needle))
            if s > score:
                best, score = chunk, s
        out[key] = (best if score >= least else None, round(score, 6))
    return out


def run(spark, sources, chunks, least=0.60, **kw):
    s = spark.createDataFrame(sources, "source_id long, text string")
    c = spark.createDataFrame(chunks, "chunk_id string, text string").repartition(3)
    return {r.source_id: (r.chunk_id, r.score, r.status) for r in alignment.aligned(s, c, least, **kw).collect()}


def typos(rng, t, share):
    out = []
    for ch in t:
        x = rng.random()
        out.append("" if x < share / 3 else rng.choice("abcdeXYZ") if x < 2 * share / 3 else ch + rng.choice("abcde") if x < share else ch)
    return "".join(out)


@pytest.fixture(scope="module")
def corpus(spark, sf_dir):
    rows = chunk_rows(spark, sf_dir).where("chunk_index < 2").select(F.concat_ws("-", F.lpad(F.col("doc_id").cast("string"), 6, "0"), "chunk_index").alias("c"), "text").collect()
    return [(r.c, r.text) for r in rows if len(squeeze(r.text)) > 60][:60]


def test_whole_passages_are_all_found(spark, corpus):
    rng = random.Random(1)
    sources, want = [], {}
    for i in range(120):
        c, t = rng.choice(corpus)
        t = squeeze(t)
        n = rng.choice([1, 2, 3, 5, 7, 9, 30, 70, 400])
        at = rng.randrange(max(1, len(t) - n))
        sources.append((i, f"  {t[at : at + n]}\n".replace(" ", "  ")))
    want = {i: min(c for c, b in corpus if squeeze(s) in squeeze(b)) for i, s in sources if squeeze(s)}
    got = run(spark, sources, corpus)
    assert {i: g[0] for i, g in got.items() if g[0] is not None} == want and all(got[i][1] == 1 for i in want)
    s = spark.createDataFrame(sources, "source_id long, text string")
    c = spark.createDataFrame(corpus, "chunk_id string, text string")
    assert {r.source_id: r.chunk_id for r in alignment.contained(s, c).collect()} == want


@pytest.mark.parametrize("least", [0.60, 0.80])
def test_recall_of_near_passages(spark, corpus, least):
    rng = random.Random(2)
    sources = []
    for i in range(60):
        t = squeeze(rng.choice(corpus)[1])
        n = rng.choice([40, 80, 160, 300])
        at = rng.randrange(max(1, len(t) - n))
        piece = t[at : at + n]
        edit = i % 5
        if edit < 3:
            piece = typos(rng, piece, (0.02, 0.05, 0.10)[edit])
        elif edit == 3:  # a stretch of its own
            cut = len(piece) // 3
            piece = piece[:cut] + "".join(rng.choice("qxzjkv ") for _ in range(len(piece) // 5)) + piece[cut + len(piece) // 5 :]
        else:  # words replaced
            piece = " ".join(w if rng.random() > 0.12 else "word" for w in piece.split())
        sources.append((i, piece))
    want = every_pair(sources, corpus, least)
    got = run(spark, sources, corpus, least)
    due = [i for i in want if want[i][0] is not None]
    right = [i for i in due if got[i][:2] == want[i]]
    assert len(due) > 40 and len(right) >= 0.9 * len(due), (len(right), len(due))
    assert all(got[i][1] <= want[i][1] for i in want)
    everything = run(spark, sources[:6], corpus, least, p=alignment.AlignParams(exhaustive=True))
    assert all(everything[i][:2] == want[i] for i in range(6))


def test_case_ties_and_blanks(spark):
    text = "the quick brown fox jumps over the lazy dog near the river bank"
    chunks = [("c", text), ("b", f"x {text}  y"), ("a", text.upper()), ("n", None), ("e", " \t"), (None, text), ("d", text.replace("lazy", "sleepy"))]
    sources = [(1, text), (2, text.upper()), (3, None), (4, " "), (1, "something else altogether: 12345"), (5, text.replace("lazy", "s1eepy"))]
    s = spark.createDataFrame(sources, "source_id long, text string").withColumn("hay", F.lit("clash"))
    c = spark.createDataFrame(chunks, "chunk_id string, text string").withColumn("needle", F.lit("clash"))
    got = sorted(((r.source_id, r.chunk_id, r.status) for r in alignment.aligned(s, c).collect()), key=str)
    assert got[0][0] == got[1][0] == 1 and {x[1] for x in got[:2]} == {"b", None}
    assert [x[1] for x in got[2:]] == ["a", None, None, "d"]
    assert {r.source_id: r.chunk_id for r in alignment.aligned(s, c, blank=True).where("source_id in (3, 4)").collect()} == {3: "a", 4: "a"}
    none = spark.createDataFrame([], "chunk_id string, text string")
    assert {r.status for r in alignment.aligned(s, none).collect()} == {"unresolved"}
    assert alignment.aligned(s.limit(0), c).collect() == []


def test_blocks_of_passages(spark, corpus):
    sources = [(i, squeeze(t)[:90]) for i, (_, t) in enumerate(corpus)]
    small = run(spark, sources[:12], corpus, p=alignment.AlignParams(block_chars=400))
    assert small == run(spark, sources[:12], corpus) and all(v[0] for v in small.values())
