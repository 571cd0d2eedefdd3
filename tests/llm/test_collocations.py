"""Phrase collocations against plain dictionaries, and the transducers by themselves."""

import random
import re
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from corpusloom.llm import collocations as col

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def plain(rows, least=30, top=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in (1, 2, 3, 4):
                f.update((lang, tuple(w[i : i + m])) for i in range(len(w) - m + 1))
    f = {k: v for k, v in f.items() if v >= least}
    longer = defaultdict(int)
    for (lang, p), v in f.items():
        for m in range(2, len(p)):
            for i in range(len(p) - m + 1):
                longer[lang, p[i : i + m]] = max(longer[lang, p[i : i + m]], v)
    found = defaultdict(list)
    for (lang, p), a in f.items():
        if len(p) > 1 and 100 * longer[lang, p] < 80 * a:
            s, k = min((2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p)))
            found[lang].append((-s, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, i + 1, ph.decode(), -a, l, r, n[lang], -s) for lang, xs in found.items() for i, (s, a, ph, l, r) in enumerate(sorted(xs)[:top]))


def rows_of(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def test_whole_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "text").collect()]
    want = plain(rows)
    assert want and rows_of(col.op13_phrase_collocations(spark, sf_dir)) == want


@pytest.mark.parametrize("p", [col.PhraseParams(least=4, top=40), col.PhraseParams(least=4, top=40, bits=8, buffer=200, ranges=5, slice_docs=3, salts=2)])
def test_edges(spark, p):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(12)] + ["É", "the", "THE", "a\x00b", "x" * 50_000]
    texts = [" ".join(rng.choice(vocabulary[:15]) + rng.choice(["", "", "", ".", ",", "\n", "\t", "\x0b"]) for _ in range(rng.randrange(60))) for _ in range(120)]
    texts += [None, "", " \t\n", ".,;:!?", vocabulary[-1], "new york city " * 50, "ab " * 20_000, "Same words here. Same words here"] + ["one text of many copies"] * 30
    langs = [None, "und", "en", "", "a\nb\\n", "back\\slash"]
    rows = [(rng.choice(langs), t) for t in texts]
    docs = spark.createDataFrame(rows, "lang string, text string").withColumn("phrase", F.lit("clash")).withColumn("n", F.lit("clash")).repartition(3)
    assert rows_of(col.collocations(docs, p=p)) == plain(rows, 4, 40)


def test_empty_table(spark):
    assert col.collocations(spark.createDataFrame([], "lang string, text string")).collect() == []


def test_products_beyond_64_bits(spark):
    a, l, r = 5 * 10**17, 6 * 10**17, 7 * 10**17
    df = spark.createDataFrame([(a, l, r)], "a long, l long, r long")
    assert df.select(col.exact_score().alias("s")).first().s == 2000000 * a // (l + r)


KEYS = st.dictionaries(st.lists(st.sampled_from([b"a", b"b", b"c", b""]), min_size=1, max_size=4).map(tuple), st.integers(1, 9), max_size=40)


@settings(max_examples=60, deadline=None)
@given(KEYS, KEYS, KEYS)
def test_transducers(x, y, z):
    a, b, c = (col.Automaton.unpack(col.build(sorted(d.items())).pack()) for d in (x, y, z))
    assert list(col.union([a])) == sorted(x.items())
    assert list(col.union([a, b, c])) == sorted((Counter(x) + Counter(y) + Counter(z)).items())
    assert sorted(col.compose(a, b)) == sorted((x[k], y[k]) for k in x.keys() & y.keys())


def test_equal_states_are_shared():
    keys = [((w, b"of", t), 1) for w in (b"end", b"top") for t in (b"day", b"year")]
    assert len(col.build(sorted(keys)).arcs) == 4  # none, after of, after the first word, start
