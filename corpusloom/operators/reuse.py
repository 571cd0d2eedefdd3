"""Reuse of earlier answers: keys, exact, lexical and semantic matches, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as fx
from ..sources.tables import kept
from . import vectors

# The settings that make up a configuration.
SETTINGS = (
    "adaptive_rerank", "alpha", "answer", "answer_model", "collection", "embed_model", "heavy_rerank_k", "heavy_rerank_model", "host",
    "light_rerank_k", "relevance_threshold", "rerank_model", "retrieve_k", "top_n",
)


def digest(*parts: Column) -> Column:
    """SHA-256 of a JSON object of the columns in the given order; nulls are kept as nulls."""
    return F.sha2(F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}).cast("binary"), 256)


def configuration_key(df: DataFrame) -> Column:
    """Over the 14 settings in alphabetical order; a missing column counts as null."""
    return digest(*[(F.col(n) if n in df.columns else F.lit(None).cast("string")).alias(n) for n in SETTINGS])


def response_key(question: Column, configuration: Column, version: int = 1) -> Column:
    return digest(configuration.alias("configuration"), fx.question_key(question).alias("question"), F.lit(version).alias("version"))


def exact_reuse(requests: DataFrame, responses: DataFrame, ttl: float = 86_400.0) -> DataFrame:
    """(request_id, response_id): the newest response of the same key that is at most ``ttl`` seconds old."""
    pairs = requests.join(responses, "key").where((F.col("asked_at") >= F.col("created_at")) & (F.col("asked_at") - F.col("created_at") <= ttl))
    return pairs.groupBy("request_id").agg(F.max_by("response_id", F.struct("created_at", "response_id")).alias("response_id"))


def topic_matches(requests: DataFrame, responses: DataFrame, least: float = 0.50) -> DataFrame:
    """(request_id, response_id, overlap): the best response of the same configuration and clauses that shares two topic
    words or more; the overlap is relative to the smaller set; ties by response id.

    Equal questions are compared once. The words of a set are its ranks by how rare they are. A set of n words must share
    o = max(2, ceil(least * n)) with any larger one, so both have one of their first n - o + 1 (the larger: size - o + 1) words in
    common. The smaller set lists these; the larger lists each word with the most o that it may serve, under the powers of two up to
    that, so that a list grows with the words of a set and not with their square. The commonest words of a set are never listed,
    and a pair is taken up only at the rarest word it shares. Lists are joined by shuffles: their files are far smaller than their rows.
    """
    def sets(df: DataFrame, key: str, name: str) -> DataFrame:
        made = df.select(key, "configuration", fx.topic_tokens(F.col("question")).alias("ts"), F.to_json(fx.bounded_clauses(F.col("question"))).alias("clauses"))
        return kept(made, name).where(F.size("ts") >= 2)

    group = ["configuration", "clauses", "ts"]
    asked = sets(requests, "request_id", "asked")
    given = sets(responses, "response_id", "given").groupBy(*group).agg(F.min("response_id").alias("response_id"))
    both = asked.select(*group, F.lit(True).alias("q"), F.lit(None).alias("response_id")).unionByName(given.withColumn("q", F.lit(False)))
    every = both.groupBy(*group).agg(F.max("q").alias("q"), F.min("response_id").alias("response_id"))
    every = kept(every.withColumn("s", F.monotonically_increasing_id()), "sets")
    words = every.select("s", F.explode("ts").alias("t"))
    ranked = kept(words.groupBy("t").agg(F.count("*").alias("c")).orderBy("c", "t").select("t", F.monotonically_increasing_id().alias("w")), "words")
    order = words.join(ranked.hint("merge"), "t").groupBy("s").agg(F.array_sort(F.collect_list("w")).alias("order"))
    sized = kept(every.drop("ts").join(order.hint("merge"), "s").withColumn("n", F.size("order")), "ordered")

    power = lambda c: F.floor(F.log2(c)).cast("int")
    need = F.greatest(F.lit(2), F.ceil(F.col("n") * least)).cast("int")
    keys = ["configuration", "clauses", "w", "p"]
    small = sized.withColumn("o", need).withColumn("p", power(F.col("o")))
    small = small.select("*", F.explode(F.slice("order", 1, F.col("n") - F.col("o") + 1)).alias("w"))
    large = sized.select("*", F.posexplode(F.slice("order", 1, F.col("n") - 1)).alias("at", "w")).withColumn("o", F.least(need, F.col("n") - F.col("at")))
    large = large.withColumn("p", F.explode(F.sequence(F.lit(1), power(F.col("o")))))
    large = large.select(*keys, *[F.col(c).alias(f"_{c}") for c in ("o", "n", "s", "q", "response_id", "order")])
    # the smaller set (or one as large) asks, or the larger one
    up = F.col("q") & F.col("_response_id").isNotNull() & (F.col("n") <= F.col("_n"))
    down = F.col("_q") & F.col("response_id").isNotNull() & (F.col("n") < F.col("_n"))
    met = small.join(large.hint("merge"), keys).where((F.col("o") <= F.col("_o")) & (up | down)).withColumn("common", F.array_intersect("order", "_order"))
    met = met.where((F.element_at("common", 1) == F.col("w")) & (F.size("common") >= F.col("o"))).withColumn("overlap", F.round(F.size("common") / F.col("n"), 6)).where(F.col("overlap") >= least)
    hit = lambda s, r: F.struct(F.col(s).alias("s"), F.col(r).alias("response_id"))
    found = met.select("overlap", F.explode(F.array_compact(F.array(F.when(up, hit("s", "_response_id")), F.when(down, hit("_s", "response_id"))))).alias("h"))
    best = found.groupBy("h.s").agg(F.min(F.struct((-F.col("overlap")).alias("o"), "h.response_id")).alias("b"))
    own = asked.join(every.select(*group, "s").hint("merge"), group)
    return own.join(best.hint("merge"), "s").select("request_id", "b.response_id", (-F.col("b.o")).alias("overlap"))


def semantic_matches(requests: DataFrame, responses: DataFrame, anchored: float = 0.88, free: float = 0.92, same_ids: bool = False) -> DataFrame:
    """(request_id, response_id, similarity): the closest response of the same configuration and clauses; without a clause
    more similarity is asked for. ``same_ids``: requests and responses are numbered alike, and none answers itself."""
    a = requests.withColumn("clauses", F.to_json(fx.bounded_clauses(F.col("question")))).select("request_id", "configuration", "clauses", F.col("vector").alias("q"))
    b = responses.withColumn("clauses", F.to_json(fx.bounded_clauses(F.col("question")))).select("response_id", "configuration", "clauses", F.col("vector").alias("v"))
    need = F.when(F.col("clauses") == "[]", max(anchored, free)).otherwise(anchored)
    return vectors.most_similar(a, b, need, ["configuration", "clauses"], other_ids=same_ids)


def assisted(requests: DataFrame, responses: DataFrame, least: float = 0.72) -> DataFrame:
    """Related answers for a heavy question: a semantic match at a lower bound, else a lexical one. (request_id, response_id, how)."""
    near = semantic_matches(requests, responses, least, least).select("request_id", F.col("response_id").alias("s"))
    topic = topic_matches(requests, responses).select("request_id", F.col("response_id").alias("t"))
    both = near.join(topic, "request_id", "full")
    return both.select("request_id", F.coalesce("s", "t").alias("response_id"), F.when(F.col("s").isNotNull(), "semantic").otherwise("topic").alias("how"))


def retained(responses: DataFrame, newest: int = 200) -> DataFrame:
    return responses.orderBy(F.desc("created_at"), "response_id").limit(newest)


# The settings of a retrieval key.
RETRIEVAL_SETTINGS = (
    "collection", "complex", "embedding_model", "heavy_reranker_model", "hybrid_alpha", "light_reranker_model", "query", "relevance_threshold",
    "retrieve_k", "revision", "top_n",
)


def retrieval_key(df: DataFrame) -> Column:
    return digest(*[(F.col(n) if n in df.columns else F.lit(None).cast("string")).alias(n) for n in RETRIEVAL_SETTINGS])


def answer_keys(ranked: DataFrame, prompt: str, model: str) -> DataFrame:
    """(query_id, key) from the prompt, the model and a question's passages in order."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda s: s["text"])
    e = ranked.groupBy("query_id").agg(texts.alias("evidence"))
    return e.select("query_id", digest(F.col("evidence"), F.lit(model).alias("model"), F.lit(prompt).alias("prompt")).alias("key"))
