"""Nearest vectors by cosine: vectors are kept in cells around centroids, and questions are joined with cells by key.

Centroids are fitted on a bounded sample; every vector is put into the cell of its nearest one, with its angle to it. By the
triangle inequality of angles no vector of a cell is nearer to a question than the question's angle to the centroid less the
cell's radius. Searches read the nearest cells first; what the k-th vector found there scores decides which other cells can
still matter. Joins with a least similarity read only cells and vectors that can reach it. Cells with many vectors, or with
many questions, are split, and a split returns its best only.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..sources.tables import fits, kept
from .retrieval import top_k


@dataclass(frozen=True)
class CellParams:
    """``cells``: number of centroids; 0: the root of the number of vectors, at most ``most_cells``. ``sample``, ``rounds``: vectors
    that centroids are fitted on and passes over them. ``probe``: cells that a search reads at first. ``tight``: an
    approximate search takes this quantile of a cell's angles for its radius. ``part``, ``asked``:
    vectors and questions of a cell that one task compares, about. ``broadcast_rows``: most rows of a side that is broadcast."""

    cells: int = 0
    most_cells: int = 4096
    sample: int = 20_000
    rounds: int = 6
    probe: int = 8
    tight: float = 0.5
    part: int = 4096
    asked: int = 1024
    broadcast_rows: int = 200_000


SLACK = 2e-6  # similarities are compared after rounding to 6 places
PAIRS = 1 << 16  # pairs of a row and a cell that a step holds at a time


def _unit(m: np.ndarray) -> np.ndarray:
    length = np.sqrt((m * m).sum(1, keepdims=True))
    return np.divide(m, length, out=np.zeros_like(m), where=length > 0)


def _matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    col = batch.column(batch.schema.get_field_index(name))
    return np.asarray(col.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(col), -1)


def _slices(batches, cells: int):
    """The batches cut so that rows times ``cells`` stay near ``PAIRS``: memory follows neither the batch nor the number of cells."""
    rows = max(1, PAIRS // max(cells, 1))
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def _angles(unit: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(unit @ centroids.T, -1, 1))


def fitted(vectors: DataFrame, key: str, v: str, n: int, p: CellParams) -> np.ndarray:
    """Centroids of length 1, by spherical k-means on a sample of bounded size."""
    some = np.array([list(r[0]) for r in vectors.orderBy(F.xxhash64(key, v)).select(v).limit(p.sample).collect()], np.float64)
    some = _unit(some)
    some = some[(some != 0).any(1)]
    if not len(some):
        return np.zeros((0, 0))
    count = min(p.cells or int(np.sqrt(max(n, 1))) + 1, p.most_cells, len(some))
    centroids = some[np.linspace(0, len(some) - 1, count).astype(int)]
    for _ in range(p.rounds):
        own = (some @ centroids.T).argmax(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, some)
        full = (sums != 0).any(1)
        centroids = np.where(full[:, None], _unit(sums), centroids)
    return np.unique(centroids, axis=0)


def in_cells(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(grp, id, v, cell, angle) of vectors (grp, id, v) of one dimension. Vectors of length 0 are in a cell of their own."""
    sent = vectors.sparkSession.sparkContext.broadcast(centroids)

    def run(batches):
        for b in _slices(batches, len(sent.value)):
            unit = _unit(_matrix(b, "v"))
            a = _angles(unit, sent.value)
            cell = a.argmin(1)
            angle = a[np.arange(len(a)), cell]
            zero = ~(unit != 0).any(1)
            cell[zero], angle[zero] = len(sent.value), np.pi
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(angle)], [*b.schema.names, "cell", "angle"])

    return vectors.select("grp", "id", "v").mapInArrow(run, vectors.select("grp", "id", "v").schema.add("cell", "integer").add("angle", "double"))


def _to_cells(questions: DataFrame, centroids: np.ndarray, radii: np.ndarray, nearest: int | None) -> DataFrame:
    """Questions (grp, query_id, q, floor) with each cell to read: the ``nearest`` ones, or without that all others than those
    (``probed``) in which a similarity of ``floor`` can be."""
    sent = questions.sparkSession.sparkContext.broadcast((centroids, radii))
    names = ["grp", "query_id", "q", "floor"]
    probed = "probed" in questions.columns

    def run(batches):
        c, r = sent.value
        for b in _slices(batches, len(r)):
            unit = _unit(_matrix(b, "q"))
            a = np.concatenate((_angles(unit, c), np.zeros((len(unit), 1))), 1)  # last: the vectors of length 0
            if nearest is not None:
                k = min(nearest, a.shape[1])
                at = np.argpartition(a, k - 1, axis=1)[:, :k]
                rows, cells = np.repeat(np.arange(len(a)), k), at.ravel()
            else:
                floor = np.asarray(b.column(b.schema.get_field_index("floor")), np.float64)
                reach = np.arccos(np.clip(floor - SLACK, -1, 1))
                ok = (a - r <= reach[:, None]) | ~(unit != 0).any(1)[:, None]
                ok[:, -1] = r[-1] >= 0
                ok &= r >= 0  # cells without vectors
                if probed:
                    for i, seen in enumerate(b.column(b.schema.get_field_index("probed")).to_pylist()):
                        ok[i, seen] = False
                rows, cells = np.nonzero(ok)
            take = pa.array(rows)
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(n)).take(take) for n in names), pa.array(cells.astype(np.int32))], [*names, "cell"])

    return questions.select(*names, *(["probed"] if probed else [])).mapInArrow(run, questions.select(*names).schema.add("cell", "integer"))


def _compared(asked: DataFrame, cells: DataFrame, k: int, p: CellParams, other_ids: bool, seen=None) -> DataFrame:
    """(query_id, id, score): in each part of a cell the k best of each question that reach its ``floor``."""
    n = cells.groupBy("grp", "cell").agg(F.ceil(F.count("*") / p.part).cast("int").alias("parts"))
    m = asked.groupBy("grp", "cell").agg(F.ceil(F.count("*") / p.asked).cast("int").alias("lots"))
    plan = kept(n.join(m, ["grp", "cell"]), "cells")
    plan = F.broadcast(plan) if fits(plan, p.broadcast_rows) else plan
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = asked.join(plan, ["grp", "cell"]).withColumn("lot", F.pmod(F.xxhash64("query_id"), F.col("lots")).cast("int")).withColumn("part", each("parts"))
    right = cells.join(plan, ["grp", "cell"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).withColumn("lot", each("lots"))
    keys = ["grp", "cell", "part", "lot"]

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "id": [], "score": []}
        if len(a) and len(b):
            b = b.sort_values("id", kind="stable")
            q, v = _unit(np.stack(a["q"]).astype(np.float64)), _unit(np.stack(b["v"]).astype(np.float64))
            ids, mine, floor = b["id"].to_numpy(), a["query_id"].to_numpy(), a["floor"].to_numpy()
            scores = np.round(q @ v.T, 6)
            if seen is not None:
                seen.add(scores.size)
            for i in range(len(a)):
                s = scores[i]
                ok = s >= np.round(floor[i], 6)
                if other_ids:
                    ok &= ids != mine[i]
                at = np.flatnonzero(ok)
                at = at[np.argsort(-s[at], kind="stable")[:k]]
                out["query_id"] += [mine[i]] * len(at)
                out["id"] += ids[at].tolist()
                out["score"] += s[at].tolist()
        return pd.DataFrame(out)

    types = f"query_id {asked.schema['query_id'].dataType.simpleString()}, id {cells.schema['id'].dataType.simpleString()}, score double"
    return left.select(*keys, "query_id", "q", "floor").groupBy(*keys).cogroup(right.select(*keys, "id", "v").groupBy(*keys)).applyInPandas(best, types)


def _indexes(questions: DataFrame, vectors: DataFrame, p: CellParams, exact: bool = True):
    """For each dimension that both sides have: questions, vectors in cells, centroids and radii of cells (-1: nothing in it)."""
    sizes = questions.select(F.size("q").alias("d")).distinct().collect()  # dimensions, not rows
    for d in sorted(r.d for r in sizes if r.d and r.d > 0):
        own = vectors.where(F.size("v") == d).withColumn("v", F.transform("v", lambda x: x.cast("double")))
        n = own.count()
        if not n:
            continue
        centroids = fitted(own, "id", "v", n, p)
        if not len(centroids):
            centroids = np.eye(1, d)
        cells = kept(in_cells(own, centroids), "vectors")
        radii = np.full(len(centroids) + 1, -1.0)
        radius = F.max("angle") if exact else F.percentile_approx("angle", p.tight)
        for r in cells.groupBy("cell").agg(radius.alias("a")).collect():  # a row a cell
            radii[r.cell] = r.a
        asked = questions.where(F.size("q") == d).withColumn("q", F.transform("q", lambda x: x.cast("double")))
        yield asked, cells, centroids, radii


def nearest(queries: DataFrame, passages: DataFrame, k: int, p: CellParams = CellParams(), exact: bool = True, seen=None) -> DataFrame:
    """(query_id, passage_id, score, rank): the k passages (passage_id, v) of highest cosine for each question (query_id, q), ties by
    passage id. ``exact``: all of them; else cells count as smaller than they are (``tight``),
    which loses some. A vector of length 0 has cosine 0 with
    all. Vectors of other dimensions than the question's, null and empty ones have no place. ``seen``: an accumulator of pairs compared.
    """
    q = queries.select(F.lit(0).alias("grp"), "query_id", "q", F.lit(-1.0).alias("floor"))
    v = passages.select(F.lit(0).alias("grp"), F.col("passage_id").alias("id"), "v")
    out = None
    for asked, cells, centroids, radii in _indexes(q, v, p, exact):
        first = kept(_to_cells(asked, centroids, radii, p.probe), "probes")
        found = kept(top_k(_compared(first, cells, k, p, False, seen), k, "id"), "nearest")
        worst = found.where(F.col("rank") == k).select("query_id", F.col("score").alias("worst"))
        probed = first.groupBy("query_id").agg(F.collect_set("cell").alias("probed"))
        again = asked.drop("floor").join(probed, "query_id").join(worst, "query_id", "left").withColumn("floor", F.coalesce("worst", F.lit(-1.0)))
        second = kept(_to_cells(again, centroids, radii, None), "further")
        found = top_k(found.drop("rank").unionByName(_compared(second, cells, k, p, False, seen)), k, "id")
        found = found.select("query_id", F.col("id").alias("passage_id"), "score", "rank")
        out = found if out is None else out.unionByName(found)
    if out is None:
        types = [f"query_id {queries.schema['query_id'].dataType.simpleString()}", f"passage_id {passages.schema['passage_id'].dataType.simpleString()}", "score double", "rank long"]
        return queries.sparkSession.createDataFrame([], ", ".join(types))
    return out


def most_similar(requests: DataFrame, responses: DataFrame, floor: Column, same: list[str], p: CellParams = CellParams(), other_ids: bool = False, seen=None) -> DataFrame:
    """(request_id, response_id, similarity): for each request (request_id, q, ...) the response (response_id, v, ...) of highest
    cosine, at least ``floor``, among those equal in the columns ``same`` (nulls equal nothing); ties by response id. ``other_ids``: not the one of its own id.
    """
    grp = F.to_json(F.struct(*same)) if same else F.lit("")
    known = lambda df: df.dropna(subset=same) if same else df
    q = known(requests).select(grp.alias("grp"), F.col("request_id").alias("query_id"), "q", floor.cast("double").alias("floor"))
    v = known(responses).select(grp.alias("grp"), F.col("response_id").alias("id"), "v")
    out = None
    for asked, cells, centroids, radii in _indexes(q, v, p):
        found = top_k(_compared(kept(_to_cells(asked, centroids, radii, None), "reach"), cells, 1, p, other_ids, seen), 1, "id")
        found = found.select(F.col("query_id").alias("request_id"), F.col("id").alias("response_id"), F.col("score").alias("similarity"))
        out = found if out is None else out.unionByName(found)
    if out is None:
        types = [f"request_id {requests.schema['request_id'].dataType.simpleString()}", f"response_id {responses.schema['response_id'].dataType.simpleString()}", "similarity double"]
        return requests.sparkSession.createDataFrame([], ", ".join(types))
    return out
