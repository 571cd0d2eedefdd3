"""Retrieval metrics and judge aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def retrieval_rows(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """(query_id, hit, recall, mrr) of every question of ``relevant`` (query_id, chunk_id). Null ids are taken out before
    ranks are given. Recall counts repeated retrieved ids against distinct relevant ones, so it can exceed 1."""
    w = Window.partitionBy("query_id").orderBy("rank")
    real = ranked.where(F.col("chunk_id").isNotNull()).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
    want = relevant.where(F.col("chunk_id").isNotNull()).distinct()
    sizes = relevant.groupBy("query_id").agg(F.count_distinct("chunk_id").alias("n"))
    found = real.join(want, ["query_id", "chunk_id"]).groupBy("query_id").agg(F.count("*").alias("c"), F.min("_r").alias("first"))
    return _metrics(sizes, found)


def _metrics(sizes: DataFrame, found: DataFrame) -> DataFrame:
    """(query_id, hit, recall, mrr) from the number of relevant passages and what was found of them."""
    j = sizes.join(found, "query_id", "left")
    return j.select(
        "query_id", F.col("c").isNotNull().alias("hit"),
        F.round(F.when(F.col("n") > 0, F.coalesce("c", F.lit(0)) / F.col("n")).otherwise(0.0), 6).alias("recall"),
        F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("mrr"),
    )


def labelled_rows(ranked: DataFrame, asked: DataFrame, passages: DataFrame, k: int) -> DataFrame:
    """``retrieval_rows`` where a question's (query_id, label) relevant passages are all (chunk_id, label) of its label. Relevant
    passages are counted by label and never listed for each question; only ids with several labels are."""
    w = Window.partitionBy("query_id").orderBy("rank")
    real = ranked.where(F.col("chunk_id").isNotNull()).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
    asked = asked.select("query_id", "label").distinct()
    each = passages.where(F.col("chunk_id").isNotNull() & F.col("label").isNotNull()).groupBy("chunk_id").agg(F.collect_set("label").alias("labels"))
    alone = each.where(F.size("labels") == 1).groupBy(F.col("labels")[0].alias("label")).agg(F.count("*").alias("n"))
    several = each.where(F.size("labels") > 1).select("chunk_id", F.explode("labels").alias("label"))
    more = asked.join(several, "label").groupBy("query_id").agg(F.count_distinct("chunk_id").alias("n"))
    # a label whose passages have no id still has its questions, with nothing to find
    without = passages.where("label is not null").select("label").distinct().select("label", F.lit(0).cast("long").alias("n"))
    sizes = asked.join(alone.unionByName(without), "label").select("query_id", "n").unionByName(more).groupBy("query_id").agg(F.sum("n").alias("n"))
    hits = real.join(each.select("chunk_id", F.explode("labels").alias("label")), "chunk_id").join(asked, ["query_id", "label"])
    found = hits.select("query_id", "_r").distinct().groupBy("query_id").agg(F.count("*").alias("c"), F.min("_r").alias("first"))
    return _metrics(sizes, found)


def summary(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("queries"), *[F.round(F.avg(F.col(c).cast("double")), 6).alias(f"mean_{c}") for c in ("hit", "recall", "mrr")])


def judge_summary(rows: DataFrame) -> DataFrame:
    """(metric, mean_score, pass_rate, n) without null scores."""
    real = rows.where(F.col("score").isNotNull())
    return real.groupBy("metric").agg(F.round(F.avg("score"), 6).alias("mean_score"), F.round(F.avg(F.col("success").cast("double")), 6).alias("pass_rate"), F.count("score").alias("n"))


def judge_rows(results: DataFrame) -> DataFrame:
    """(query, metric, score, success) from one array of metric results per question."""
    return results.select("query", F.explode("metrics").alias("m")).select("query", "m.metric", "m.score", "m.success")


def seeded_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """The same n rows for the same seed, whatever the partitioning."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def misaligned(golden: DataFrame, grammar: str) -> DataFrame:
    """(records, aligned): how many records have an id of the grammar."""
    ok = F.exists("relevant_chunk_ids", lambda x: x.rlike(grammar))
    return golden.agg(F.count("*").alias("records"), F.count_if(F.coalesce(ok, F.lit(False))).alias("aligned"))


def unverified(golden: DataFrame) -> DataFrame:
    bad = golden.where(~F.coalesce("verified", F.lit(False)))
    return bad.groupBy(F.coalesce("provenance", F.lit("unknown")).alias("provenance")).agg(F.count("*").alias("records"))


def registry_summary(metrics: DataFrame, registry: DataFrame) -> DataFrame:
    """(name, value) of every registered metric; N/A where the map lacks it."""
    flat = metrics.select(F.explode("metrics").alias("name", "v"))
    return registry.join(flat, "name", "left").select("name", F.coalesce(F.col("v").cast("string"), F.lit("N/A")).alias("value"))


def example_rows(golden: DataFrame, ranked: DataFrame, answers: DataFrame) -> DataFrame:
    """(query_id, retrieved_chunk_ids, contexts, answer) of every golden question, passages in rank order."""
    got = ranked.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "text"))).alias("p"))
    j = golden.select("query_id").join(got, "query_id", "left").join(answers.select("query_id", "answer"), "query_id", "left")
    none = F.array().cast("array<string>")
    return j.select("query_id", F.coalesce(F.transform("p", lambda s: s["chunk_id"]), none).alias("retrieved_chunk_ids"), F.coalesce(F.transform("p", lambda s: s["text"]), none).alias("contexts"), "answer")
