"""Vectors in cells against all pairs."""

from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F, types as T

from corpusloom.operators import reuse, vectors
from corpusloom.plans import QUERIES


def clusters(n, dim, centres, seed, spread=0.15):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, dim))
    return c[rng.integers(0, centres, n)] + spread * rng.normal(size=(n, dim))


def all_pairs(qs, vs, k):
    unit = lambda m: m / np.maximum(np.sqrt((m * m).sum(1, keepdims=True)), 1e-300)
    s = np.round(unit(qs) @ unit(vs).T, 6)
    return {i: sorted(((-x, j) for j, x in enumerate(row)))[:k] for i, row in enumerate(s)}


def frames(spark, qs, vs):
    q = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(qs)], "query_id long, q array<double>")
    v = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vs)], "passage_id long, v array<double>")
    return q, v


def got_of(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((r["rank"], -r.score, r.passage_id))
    return {i: [x[1:] for x in sorted(rows)] for i, rows in out.items()}


@pytest.mark.parametrize("p", [vectors.CellParams(), vectors.CellParams(cells=7, probe=2, part=13, asked=5, broadcast_rows=0)])
def test_exact(spark, p):
    vs = np.concatenate([clusters(300, 12, 9, 1), np.zeros((2, 12)), clusters(1, 12, 1, 5).repeat(30, 0)])  # zero vectors, many copies
    qs = np.concatenate([vs[::20], np.zeros((1, 12)), -vs[:3]])
    q, v = frames(spark, qs, vs)
    pairs = spark.sparkContext.accumulator(0)
    assert got_of(vectors.nearest(q, v, 10, p, seen=pairs)) == all_pairs(qs, vs, 10)


def test_pruning_and_recall(spark):
    vs = clusters(3000, 16, 40, 2)
    qs = vs[::20]
    q, v = frames(spark, qs, vs)
    want = all_pairs(qs, vs, 20)
    pairs = spark.sparkContext.accumulator(0)
    assert got_of(vectors.nearest(q, v, 20, seen=pairs)) == want
    assert pairs.value < 0.5 * len(qs) * len(vs)
    pairs = spark.sparkContext.accumulator(0)
    near = got_of(vectors.nearest(q, v, 20, exact=False, seen=pairs))
    recall = np.mean([len({j for _, j in near[i]} & {j for _, j in want[i]}) / 20 for i in want])
    assert recall >= 0.9 and pairs.value < 0.3 * len(qs) * len(vs)


def test_recall_on_the_tables(spark, sf_dir):
    exact = {(r.query_id, r.passage_id) for r in QUERIES["r5_vector_leg"](spark, sf_dir).collect()}
    near = {(r.query_id, r.passage_id) for r in QUERIES["r5_nearest_cells"](spark, sf_dir).collect()}
    assert len(near & exact) >= 0.9 * len(exact)


def test_similarity_join(spark):
    vs = clusters(600, 8, 30, 3)
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in v], int(rng.integers(0, 2)), "See 5.3" if rng.random() < 0.5 else "none") for i, v in enumerate(vs)] + [(900, None, 0, "none"), (901, [1.0], 0, "none"), (902, [], 1, None)]
    df = spark.createDataFrame(rows, "request_id long, vector array<double>, configuration int, question string").withColumn("id", F.lit("clash"))
    got = {r.request_id: (r.response_id, r.similarity) for r in reuse.semantic_matches(df, df.withColumnRenamed("request_id", "response_id"), same_ids=True).collect()}
    unit = vs / np.sqrt((vs * vs).sum(1, keepdims=True))
    s = np.round(unit @ unit.T, 6)
    want = {}
    for i in range(len(vs)):
        need = 0.88 if rows[i][3] == "See 5.3" else 0.92
        ok = [(-s[i, j], j) for j in range(len(vs)) if j != i and rows[i][2:] == rows[j][2:] and s[i, j] >= need]
        if ok:
            want[i] = (min(ok)[1], -min(ok)[0])
    assert got == want and len(want) > 100
    pairs = spark.sparkContext.accumulator(0)
    a = df.where("request_id < 600").select("request_id", F.col("vector").alias("q"))
    b = a.withColumnRenamed("request_id", "response_id").withColumnRenamed("q", "v")
    vectors.most_similar(a, b, F.lit(0.92), [], other_ids=True, seen=pairs).collect()
    assert 0 < pairs.value < 0.3 * len(vs) ** 2


def test_nothing_to_compare(spark):
    q, v = frames(spark, [[1.0, 0.0]], [[1.0, 0.0, 0.0]])
    assert vectors.nearest(q, v, 3).collect() == [] == vectors.nearest(q.limit(0), v, 3).collect() == vectors.nearest(q, v.limit(0), 3).collect()


class Captured:
    """In a frame's place: gives the function that a step would run on Arrow batches."""

    columns = ["grp", "query_id", "q", "floor"]
    sparkSession = SimpleNamespace(sparkContext=SimpleNamespace(broadcast=lambda v: SimpleNamespace(value=v)))

    def __init__(self):
        self.schema = T.StructType()

    def select(self, *_):
        return self

    def mapInArrow(self, run, _):
        return run


def test_cells_to_read_in_bounded_batches():
    """a batch whose questions reach many cells is handed on in parts."""
    rng = np.random.default_rng(1)
    c = rng.normal(size=(300, 8))
    c /= np.sqrt((c * c).sum(1, keepdims=True))
    n = 2000
    batch = pa.RecordBatch.from_pydict({"grp": [0] * n, "query_id": list(range(n)), "q": rng.normal(size=(n, 8)).tolist(), "floor": [-1.0] * n})
    out = list(vectors._to_cells(Captured(), c, np.append(np.full(300, 1.0), -1.0), None)(iter([batch])))
    assert sum(b.num_rows for b in out) == n * 300 and max(b.num_rows for b in out) <= vectors.PAIRS
