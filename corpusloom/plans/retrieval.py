"""Queries over ``benchmark`` and ``embeddings``: retrieval, reuse of answers and evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import text as fx
from ..operators import evaluation as ev, keyword, retrieval as rt, reuse, vectors
from .documents import CHUNKS_SQL, chunks
from .registry import query, table

#: Every vector whose id is divisible by 20 is a question; it is asked of all vectors.
ASKED = "vec_id % 20 = 0"
COS = "round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(p.embedding AS DOUBLE[])), 6)"
SCORES_SQL = f"scores AS (SELECT q.vec_id AS query_id, p.vec_id AS passage_id, {COS} AS score FROM embeddings q, embeddings p WHERE q.{ASKED})"
RANKED_SQL = f"{SCORES_SQL}, ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, passage_id) AS rank FROM scores) WHERE rank <= 20)"
CHUNK_WORDS = "regexp_extract_all(lower(text), '[a-z0-9]+')"
BM25_SQL = f"""{CHUNKS_SQL}, ids AS (SELECT doc_id || '-' || lpad(CAST(chunk_index AS VARCHAR), 5, '0') AS chunk_id, text FROM chunks),
sized AS (SELECT chunk_id, {CHUNK_WORDS} AS ts, len({CHUNK_WORDS}) AS n FROM ids),
facts AS (SELECT count(*) AS n, avg(n) AS avg_len FROM sized),
asked AS (SELECT DISTINCT item_id AS query_id, unnest({CHUNK_WORDS}) AS term FROM benchmark),
tf AS (SELECT term, chunk_id, n AS len, count(*) AS tf FROM (SELECT chunk_id, n, unnest(ts) AS term FROM sized) WHERE term IN (SELECT term FROM asked) GROUP BY 1, 2, 3),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
bm AS (SELECT query_id, chunk_id, round(sum(ln(1 + (f.n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))), 6) AS score FROM asked JOIN df USING (term) JOIN tf USING (term), facts f GROUP BY 1, 2),
kw AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM bm) WHERE rank <= 10)"""


def keyword_queries(spark, sf_dir) -> DataFrame:
    """All terms of each benchmark passage."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.array_join(rt.terms(F.col("text")), " ").alias("text"))


def keyword_ranked(spark, sf_dir, k: int = 10) -> DataFrame:
    ids = chunks(spark, sf_dir).withColumn("chunk_id", F.concat_ws("-", F.col("doc_id").cast("string"), F.lpad(F.col("chunk_index").cast("string"), 5, "0")))
    return keyword.bm25_top(ids.select("chunk_id", "text"), keyword_queries(spark, sf_dir), k)


def vector_ranked(spark, sf_dir, k: int = 20, exact: bool = True) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    q = e.where(ASKED).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    p = e.select(F.col("vec_id").alias("passage_id"), F.col("embedding").alias("v"))
    return vectors.nearest(q, p, k, exact=exact)


@query(f"WITH {BM25_SQL} SELECT query_id, chunk_id, score, rank FROM kw")
def r4_keyword_leg(spark, sf_dir):
    return keyword_ranked(spark, sf_dir)


@query(f"WITH {RANKED_SQL} SELECT * FROM ranked")
def r5_vector_leg(spark, sf_dir):
    return vector_ranked(spark, sf_dir)


@query()
def r5_nearest_cells(spark, sf_dir):
    """The same from the nearest cells alone: recall is measured in the tests."""
    return vector_ranked(spark, sf_dir, exact=False)


def _legs(spark, sf_dir):
    v = vector_ranked(spark, sf_dir)
    keyword = v.where("passage_id % 3 <> 0").select("query_id", "passage_id", (F.col("passage_id") % 17).cast("double").alias("score"))
    return v.where("passage_id % 4 <> 1").select("query_id", "passage_id", "score"), keyword


@query(f"""WITH {RANKED_SQL}, v AS (SELECT query_id, passage_id, score FROM ranked WHERE passage_id % 4 <> 1), k AS (SELECT query_id, passage_id, CAST(passage_id % 17 AS DOUBLE) AS score FROM ranked WHERE passage_id % 3 <> 0),
vs AS (SELECT query_id, passage_id, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1 END AS s FROM v WINDOW w AS (PARTITION BY query_id)),
ks AS (SELECT query_id, passage_id, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1 END AS s FROM k WINDOW w AS (PARTITION BY query_id)),
f AS (SELECT coalesce(vs.query_id, ks.query_id) AS query_id, coalesce(vs.passage_id, ks.passage_id) AS passage_id, round(0.5 * coalesce(vs.s, 0) + 0.5 * coalesce(ks.s, 0), 6) AS score FROM vs FULL JOIN ks ON vs.query_id = ks.query_id AND vs.passage_id = ks.passage_id)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, passage_id) AS rank FROM f) WHERE rank <= 10""")
def r6_score_fusion(spark, sf_dir):
    return rt.top_k(rt.fused(*_legs(spark, sf_dir), 0.5, "passage_id"), 10, "passage_id")


#: Candidates with texts: documents stand for passages, and questions name clauses now and then.
QUESTION = "CASE WHEN query_id % 4 = 0 THEN 'Compare control ' || query_id || '.1 and others' WHEN query_id % 4 = 1 THEN 'What is safeguard ' || (query_id % 7) || '.2 for?' ELSE 'What is it?' END"
CAND_SQL = f"{RANKED_SQL}, cand AS (SELECT query_id, rank, CAST(passage_id AS VARCHAR) AS chunk_id, score, coalesce(d.text, '') AS text, (passage_id % 7) || '.' || (passage_id % 3) AS clause, {QUESTION} AS question FROM ranked LEFT JOIN documents d ON d.doc_id = passage_id // 3)"


def questions(spark, sf_dir) -> DataFrame:
    q = F.col("query_id")
    text = (
        F.when(q % 4 == 0, F.concat(F.lit("Compare control "), q.cast("string"), F.lit(".1 and others")))
        .when(q % 4 == 1, F.concat(F.lit("What is safeguard "), (q % 7).cast("string"), F.lit(".2 for?")))
        .otherwise("What is it?")
    )
    return table(spark, sf_dir, "embeddings").where(ASKED).select(F.col("vec_id").alias("query_id")).withColumn("question", text)


def candidates(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    c = vector_ranked(spark, sf_dir).withColumn("doc_id", F.floor(F.col("passage_id") / 3)).join(docs, "doc_id", "left").join(questions(spark, sf_dir), "query_id")
    clause = F.concat_ws(".", (F.col("passage_id") % 7).cast("string"), (F.col("passage_id") % 3).cast("string"))
    return c.select("query_id", "rank", F.col("passage_id").cast("string").alias("chunk_id"), "score", F.coalesce("text", F.lit("")).alias("text"), clause.alias("clause"), "question")


PLAIN = r"trim(regexp_replace(lower(text), '\s+', ' ', 'g'))"
DEDUP_SQL = f"{CAND_SQL}, uniq AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, CASE WHEN {PLAIN} = '' THEN 'chunk:' || chunk_id ELSE {PLAIN} END ORDER BY rank) AS n FROM cand) WHERE n = 1)"


@query(f"WITH {DEDUP_SQL} SELECT query_id, rank, chunk_id FROM uniq")
def r7_candidate_dedup(spark, sf_dir):
    return rt.deduplicated(candidates(spark, sf_dir)).select("query_id", "rank", "chunk_id")


HITS = "list_has_any(list_distinct(regexp_extract_all(question, '[0-9]+(?:[.][0-9]+)+')), list_distinct(list_append(regexp_extract_all(left(text, 240), '[0-9]+(?:[.][0-9]+)+'), clause)))"


@query(f"""WITH {DEDUP_SQL}, hit AS (SELECT * FROM uniq WHERE {HITS}), f AS (SELECT *, first_value(score) OVER (PARTITION BY query_id ORDER BY rank) AS first FROM hit)
SELECT query_id, chunk_id, 1.0e0 AS score FROM f WHERE first >= 0.3""")
def r10_exact_clause_bypass(spark, sf_dir):
    return rt.exact_clause_matches(candidates(spark, sf_dir), 0.3).select("query_id", "chunk_id", "score")


@query("""SELECT item_id, trim(regexp_replace(t, '\\s+', ' ', 'g')) AS query, trim(regexp_replace(lower(t), '\\s+', ' ', 'g')) AS query_key, array_to_string(list_sort(list_distinct(regexp_extract_all(t, '[0-9]+(?:[.][0-9]+)+'))), ' ') AS clauses
FROM (SELECT item_id, '  5.' || (item_id % 4) || '  and  5.' || (item_id % 2) || ' ' || text AS t FROM benchmark)""")
def r1_query_normalisation(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    t = F.concat(F.lit("  5."), (F.col("item_id") % 4).cast("string"), F.lit("  and  5."), (F.col("item_id") % 2).cast("string"), F.lit(" "), F.col("text"))
    b = b.withColumn("t", t)
    return b.select("item_id", fx.normalise(F.col("t")).alias("query"), fx.question_key(F.col("t")).alias("query_key"), F.array_join(F.array_sort(fx.clause_references(F.col("t"))), " ").alias("clauses"))


def _any(column: str, markers: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains(lower({column}), '{m}')" for m in markers) + ")"


TURNS = "CASE WHEN turn % 3 = 0 THEN 'Compare ' || text WHEN turn % 3 = 1 THEN text || ' latest? sure?' ELSE text END"


def turns(spark, sf_dir) -> DataFrame:
    c, t = table(spark, sf_dir, "conversations"), F.col("turn") % 3
    return c.withColumn("q", F.when(t == 0, F.concat(F.lit("Compare "), F.col("text"))).when(t == 1, F.concat(F.col("text"), F.lit(" latest? sure?"))).otherwise(F.col("text")))


@query(rf"""SELECT conv_id, turn, regexp_matches(coalesce(q, ''), '(?i)\b(compare|comparison|contrast|difference|different|versus|vs\.?|across|relationship|combined|multiple|summarize|synthesi[sz]e)\b') AS comparison,
len(string_split(trim(regexp_replace(q, '\s+', ' ', 'g')), ' ')) > 24 OR length(q) - length(replace(q, '?', '')) > 1 OR {_any('q', fx.COMPLEX_MARKERS)} AS is_complex, {_any('q', fx.WEB_MARKERS)} AS needs_web FROM (SELECT *, {TURNS} AS q FROM conversations WHERE text IS NOT NULL)""")
def r11_query_complexity(spark, sf_dir):
    """R11, R12 and H11 on every turn of the conversations."""
    t = turns(spark, sf_dir).where("text is not null")
    return t.select("conv_id", "turn", fx.asks_comparison(F.col("q")).alias("comparison"), fx.is_complex(F.col("q")).alias("is_complex"), fx.contains_any(F.col("q"), fx.WEB_MARKERS).alias("needs_web"))


@query(f"""WITH s AS (SELECT conv_id, turn, len(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) > 24 AS c FROM conversations WHERE text IS NOT NULL)
SELECT conv_id, turn, CASE WHEN c THEN 'complex' ELSE 'fast' END AS profile, CAST(CASE WHEN c THEN 20 ELSE 8 END AS BIGINT) AS retrieve_k, CAST(CASE WHEN c THEN 5 ELSE 3 END AS BIGINT) AS top_n FROM s""")
def r13_query_profile(spark, sf_dir):
    profile = spark.createDataFrame([("fast", 8, 3), ("complex", 20, 5)], "profile string, retrieve_k long, top_n long")
    t = table(spark, sf_dir, "conversations").where("text is not null").withColumn("profile", F.when(fx.word_count(F.col("text")) > 24, "complex").otherwise("fast"))
    return t.join(F.broadcast(profile), "profile").select("conv_id", "turn", "profile", "retrieve_k", "top_n")  # two rows


@query(f"WITH {RANKED_SQL} SELECT query_id, passage_id, round(exp(score - greatest(score, 0.5)) / (exp(score - greatest(score, 0.5)) + exp(0.5 - greatest(score, 0.5))), 6) AS probability FROM ranked")
def r15_two_logit_probability(spark, sf_dir):
    return vector_ranked(spark, sf_dir).select("query_id", "passage_id", F.round(rt.two_logit_probability(F.col("score"), F.lit(0.5)), 6).alias("probability"))


RERANK_SQL = f"""{DEDUP_SQL}, r1 AS (SELECT * REPLACE (row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank) FROM uniq)"""


@query(f"""WITH {RERANK_SQL}, s AS (SELECT *, abs(score) AS rerank_score FROM r1 WHERE rank <= 8)
SELECT query_id, chunk_id, rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rank) AS rank FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rank) <= 5""")
def r16_rerank_top_n(spark, sf_dir):
    """The budget is scored and the best five stay."""
    from pyspark.sql import Window

    u = rt.deduplicated(candidates(spark, sf_dir)).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")).cast("long"))
    return rt.reranked(u, F.abs("score"), 8, 5).select("query_id", "chunk_id", "rerank_score", "rank")


ROUTE_SQL = f"""{CAND_SQL}, best AS (SELECT query_id, any_value(question) AS question, max(CASE WHEN rank = 1 THEN score END) AS top, max(CASE WHEN rank = 2 THEN score END) AS second, bool_or(rank = 1 AND {HITS}) AS exact FROM cand GROUP BY 1),
routed AS (SELECT query_id, top AS top_score, round(top - coalesce(second, 0), 6) AS margin, exact AS exact_clause_match, contains(question, 'Compare') AS complex_query,
 CASE WHEN top < 0.2 THEN 'reject' WHEN exact THEN 'light' WHEN contains(question, 'Compare') THEN 'heavy' WHEN top >= 0.4 AND round(top - coalesce(second, 0), 6) >= 0.01 THEN 'light' ELSE 'heavy' END AS route FROM best)"""


@query(f"WITH {ROUTE_SQL} SELECT * FROM routed")
def r18_route_decision(spark, sf_dir):
    c = candidates(spark, sf_dir).withColumn("rerank_score", F.col("score"))
    return rt.routes(questions(spark, sf_dir), c, sure=0.4, gap=0.01)


@query()
def r19_two_pass_rerank(spark, sf_dir):
    c, text = candidates(spark, sf_dir), F.col("text")
    return rt.two_pass(questions(spark, sf_dir), c, rt.light_scores(F.col("question"), text), F.abs("score")).select("query_id", "chunk_id", "rank", "rerank_score", "route")


@query(f"WITH {CAND_SQL} SELECT query_id, score >= 0.45 AS is_relevant, CASE WHEN score < 0.45 THEN 'Question irrelevant to the document.' END AS answer FROM cand WHERE rank = 1")
def r21_relevance_gate(spark, sf_dir):
    c = candidates(spark, sf_dir).withColumn("rerank_score", F.col("score"))
    return rt.gated(questions(spark, sf_dir), c, 0.45).select("query_id", "is_relevant", "answer")


@query(f"WITH {CAND_SQL} SELECT query_id, string_agg('[' || rank || '] ' || left(text, 1800), chr(10) || chr(10) ORDER BY rank) AS context FROM cand WHERE rank <= 5 GROUP BY query_id")
def r22_numbered_context(spark, sf_dir):
    return rt.contexts(candidates(spark, sf_dir).where("rank <= 5"), 1800)


NORMAL = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"


@query(f"""WITH {CAND_SQL} SELECT query_id, rank, CASE WHEN rank % 2 = 0 THEN 'd' || chunk_id ELSE 'f' || chunk_id END AS document_id, 'f' || chunk_id AS title, clause AS section, rank AS page_number, CASE WHEN rank % 3 = 0 THEN score ELSE rank / 10e0 END AS relevance,
CASE WHEN length({NORMAL}) <= 280 THEN {NORMAL} ELSE rtrim(left({NORMAL}, 277)) || '...' END AS summary FROM cand""")
def r23_citations(spark, sf_dir):
    """R20, R23 and R24."""
    c = candidates(spark, sf_dir)
    meta = F.struct(
        F.when(F.col("rank") % 2 == 0, F.concat(F.lit("d"), F.col("chunk_id"))).otherwise("").alias("document_id"), F.concat(F.lit("f"), F.col("chunk_id")).alias("source_file"), F.col("chunk_id"),
        F.lit(None).cast("string").alias("title"), F.col("clause").alias("clause_number"), F.array().cast("array<string>").alias("breadcrumb"), F.col("rank").alias("page_start"),
    )
    return rt.citations(c.withColumn("metadata", meta).withColumn("rerank_score", F.when(F.col("rank") % 3 != 0, F.col("rank") / 10)))


@query(f"WITH {CAND_SQL}, a AS (SELECT query_id, unnest([1, 1, 7, query_id % 3 + 1]) AS n FROM (SELECT DISTINCT query_id FROM cand)) SELECT a.query_id, CAST(a.n AS BIGINT) AS n, count(*) AS uses, any_value(c.chunk_id) AS chunk_id FROM a LEFT JOIN (SELECT * FROM cand WHERE rank <= 5) c ON a.query_id = c.query_id AND a.n = c.rank GROUP BY 1, 2")
def r25_citation_markers(spark, sf_dir):
    answers = questions(spark, sf_dir).withColumn("answer", F.concat(F.lit("See [1] and [1], not [7] but ["), (F.col("query_id") % 3 + 1).cast("string"), F.lit("].")))
    return rt.citation_markers(answers, candidates(spark, sf_dir).where("rank <= 5"))


@query(r"SELECT item_id, regexp_replace(text, '(?i)\b(thion|ther|andt|tion)\b', '*\1*', 'g') AS marked FROM benchmark")
def r26_keyword_marks(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", rt.marked_keywords(F.lit("The thion ther andt tion"), F.col("text")).alias("marked"))


@query(f"WITH {ROUTE_SQL} SELECT r.query_id, route, count(*) AS passages, string_agg(chunk_id, ',' ORDER BY rank) AS ranked, max(score) AS best FROM routed r JOIN cand c ON r.query_id = c.query_id WHERE rank <= 5 GROUP BY 1, 2")
def r27_run_report(spark, sf_dir):
    c = candidates(spark, sf_dir).withColumn("rerank_score", F.col("score"))
    route = rt.routes(questions(spark, sf_dir), c, sure=0.4, gap=0.01).select("query_id", "route")
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda s: s["chunk_id"]), ",")
    return c.where("rank <= 5").join(route, "query_id").groupBy("query_id", "route").agg(F.count("*").alias("passages"), ids.alias("ranked"), F.max("score").alias("best"))


# Reuse: user turns are requests; the same words asked in an earlier conversation are responses.
REQ_SQL = "req AS (SELECT conv_id * 1000 + turn AS request_id, text AS question, conv_id % 3 AS configuration, CAST(conv_id * 900 + turn AS DOUBLE) AS asked_at FROM conversations WHERE role = 'user' AND text IS NOT NULL)"


def requests(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "conversations").where("role = 'user' and text is not null")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("request_id"), F.col("text").alias("question"), (F.col("conv_id") % 3).alias("configuration"), (F.col("conv_id") * 900 + F.col("turn")).cast("double").alias("asked_at"))


def responses(req: DataFrame) -> DataFrame:
    return req.where("request_id % 2 = 0").select(F.col("request_id").alias("response_id"), "question", "configuration", F.col("asked_at").alias("created_at"))


@query(r'''SELECT conv_id, turn, sha256('{"configuration":' || (conv_id % 3) || ',"question":' || CAST(to_json(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) AS VARCHAR) || ',"version":1}') AS key FROM conversations WHERE text IS NOT NULL''')
def a2_response_key(spark, sf_dir):
    """A1 and A2: keys are digests of sorted JSON."""
    c = table(spark, sf_dir, "conversations").where("text is not null")
    return c.select("conv_id", "turn", reuse.response_key(F.col("text"), F.col("conv_id") % 3).alias("key"))


@query(rf"WITH {REQ_SQL}, k AS (SELECT *, trim(regexp_replace(lower(question), '\s+', ' ', 'g')) || '#' || configuration AS key FROM req) SELECT a.request_id, arg_max(b.request_id, b.asked_at * 1000000 + b.request_id % 1000) AS response_id FROM k a JOIN k b ON a.key = b.key WHERE b.request_id % 2 = 0 AND a.asked_at >= b.asked_at AND a.asked_at - b.asked_at <= 86400 GROUP BY 1")
def a3_exact_reuse(spark, sf_dir):
    key = F.concat_ws("#", fx.question_key(F.col("question")), F.col("configuration").cast("string"))
    req = requests(spark, sf_dir).withColumn("key", key)
    return reuse.exact_reuse(req.select("request_id", "key", "asked_at"), responses(req).withColumn("key", key).select("response_id", "key", "created_at"))


_STOP = ", ".join(f"'{w}'" for w in fx.TOPIC_STOP_WORDS)
TOPIC = rf"list_sort(list_distinct(list_transform(list_filter(regexp_extract_all(lower(question), '[a-z0-9]+'), lambda t: length(t) >= 3 AND t NOT IN ({_STOP})), lambda t: CASE WHEN t LIKE '%ing' AND length(t) > 6 THEN left(t, length(t) - 3) WHEN t LIKE '%ed' AND length(t) > 5 THEN left(t, length(t) - 2) WHEN t LIKE '%es' AND length(t) > 5 THEN left(t, length(t) - 2) WHEN t LIKE '%s' AND length(t) > 4 THEN left(t, length(t) - 1) ELSE t END)))"


@query(f"WITH {REQ_SQL} SELECT request_id, array_to_string({TOPIC}, ' ') AS tokens FROM req")
def a4_topic_tokens(spark, sf_dir):
    return requests(spark, sf_dir).select("request_id", F.array_join(fx.topic_tokens(F.col("question")), " ").alias("tokens"))


@query(f"""WITH {REQ_SQL}, t AS (SELECT request_id, configuration, {TOPIC} AS ts FROM req), e AS (SELECT request_id, configuration, len(ts) AS n, unnest(ts) AS token FROM t WHERE len(ts) >= 2),
s AS (SELECT a.request_id, b.request_id AS response_id, round(count(*) / CAST(least(a.n, b.n) AS DOUBLE), 6) AS overlap FROM e a JOIN e b ON a.configuration = b.configuration AND a.token = b.token AND b.request_id % 2 = 0 GROUP BY 1, 2, a.n, b.n HAVING count(*) >= 2)
SELECT request_id, response_id, overlap FROM s WHERE overlap >= 0.5 QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY overlap DESC, response_id) = 1""")
def a5_topic_match(spark, sf_dir):
    req = requests(spark, sf_dir)
    return reuse.topic_matches(req, responses(req))


VEC_SQL = "vec AS (SELECT vec_id, embedding, vec_id // 20 % 2 AS configuration, CASE WHEN vec_id // 40 % 2 = 0 THEN 'See 5.3' ELSE 'No clause' END AS question FROM embeddings)"


@query(f"""WITH {VEC_SQL}, s AS (SELECT a.vec_id AS request_id, b.vec_id AS response_id, a.question, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS similarity FROM vec a JOIN vec b ON a.configuration = b.configuration AND a.question = b.question WHERE a.{ASKED} AND a.vec_id <> b.vec_id)
SELECT request_id, response_id, similarity FROM s WHERE similarity >= CASE WHEN question = 'See 5.3' THEN 0.3 ELSE 0.4 END QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY similarity DESC, response_id) = 1""")
def a6_semantic_match(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"), F.expr("vec_id div 20 % 2").alias("configuration"), F.when(F.expr("vec_id div 40 % 2 = 0"), "See 5.3").otherwise("No clause").alias("question"))
    req = e.where(ASKED).withColumnRenamed("vec_id", "request_id")
    return reuse.semantic_matches(req, e.withColumnRenamed("vec_id", "response_id"), 0.3, 0.4, same_ids=True)


@query(f"WITH {REQ_SQL} SELECT request_id AS response_id, asked_at AS created_at FROM req WHERE request_id % 2 = 0 ORDER BY asked_at DESC, request_id LIMIT 200")
def a8_retention(spark, sf_dir):
    return reuse.retained(responses(requests(spark, sf_dir))).select("response_id", "created_at")


REL_SQL = f"{RANKED_SQL}, want AS (SELECT q.vec_id AS query_id, p.vec_id AS chunk_id FROM embeddings q JOIN embeddings p ON q.label = p.label WHERE q.{ASKED}), n AS (SELECT query_id, count(DISTINCT chunk_id) AS n FROM want GROUP BY 1), f AS (SELECT r.query_id, count(*) AS c, min(rank) AS first FROM ranked r JOIN want w ON r.query_id = w.query_id AND r.passage_id = w.chunk_id WHERE rank <= 10 GROUP BY 1), e AS (SELECT n.query_id, f.c IS NOT NULL AS hit, round(coalesce(f.c, 0) / CAST(n.n AS DOUBLE), 6) AS recall, round(coalesce(1e0 / f.first, 0), 6) AS mrr FROM n LEFT JOIN f ON n.query_id = f.query_id)"


def _eval_rows(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    q = e.where(ASKED).select(F.col("vec_id").alias("query_id"), "label")
    p = e.select(F.col("vec_id").alias("chunk_id"), "label")
    return ev.labelled_rows(vector_ranked(spark, sf_dir).withColumnRenamed("passage_id", "chunk_id"), q, p, 10)


@query(f"WITH {REL_SQL} SELECT * FROM e")
def e1_retrieval_metrics(spark, sf_dir):
    return _eval_rows(spark, sf_dir)


@query(f"WITH {REL_SQL} SELECT count(*) AS queries, round(avg(CAST(hit AS DOUBLE)), 6) AS mean_hit, round(avg(recall), 6) AS mean_recall, round(avg(mrr), 6) AS mean_mrr FROM e")
def e2_retrieval_summary(spark, sf_dir):
    return ev.summary(_eval_rows(spark, sf_dir))


JUDGE_SQL = "judged AS (SELECT event_id AS query, event_type AS metric, CASE WHEN event_id % 9 <> 0 THEN value END AS score, value > 50 AS success FROM events)"


def judged(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("query"), F.array(F.struct(F.col("event_type").alias("metric"), F.when(F.col("event_id") % 9 != 0, F.col("value")).alias("score"), (F.col("value") > 50).alias("success"))).alias("metrics"))


@query(f"WITH {JUDGE_SQL} SELECT metric, round(avg(score), 6) AS mean_score, round(avg(CAST(success AS DOUBLE)), 6) AS pass_rate, count(score) AS n FROM judged WHERE score IS NOT NULL GROUP BY metric")
def e3_judge_summary(spark, sf_dir):
    """E3 over E4's rows."""
    return ev.judge_summary(ev.judge_rows(judged(spark, sf_dir)))


@query(f"WITH {JUDGE_SQL} SELECT * FROM judged")
def e4_judge_rows(spark, sf_dir):
    return ev.judge_rows(judged(spark, sf_dir))


@query()
def e6_seeded_sample(spark, sf_dir):
    return ev.seeded_sample(table(spark, sf_dir, "benchmark"), "item_id", 10, 42)
