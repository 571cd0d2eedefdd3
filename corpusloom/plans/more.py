"""Queries for the remaining operators: upserts, ids, spans, clauses, supplements, imports and streams."""

from __future__ import annotations

import uuid

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..functions import text as fx
from ..operators import alignment, chunking, curation as cu, evaluation as ev, imports, jobs, lines as ln, retrieval as rt, reuse, supplements as su
from ..sources import files
from ..sources.tables import shared_dir
from ..streaming import jobs as streams
from .documents import CHUNKS_SQL, LINES_SQL, TOKENS, chunks, page_lines
from .history import GOLD_SQL, golden
from .registry import query, table
from .retrieval import CAND_SQL, candidates, questions, requests

NAMESPACE = "6ba7b8109dad11d180b400c04fd430c8"


@query("""WITH a AS (SELECT doc_id AS chunk_id, text, n_chars FROM documents WHERE doc_id % 3 <> 0), b AS (SELECT CASE WHEN doc_id % 50 = 0 THEN NULL ELSE doc_id END AS chunk_id, lower(text) AS text, n_chars FROM documents WHERE doc_id % 2 = 0)
SELECT chunk_id, text FROM a WHERE chunk_id NOT IN (SELECT chunk_id FROM b WHERE chunk_id IS NOT NULL) UNION ALL SELECT chunk_id, text FROM b""")
def s8_idempotent_upsert(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    old = d.where("doc_id % 3 <> 0").select(F.col("doc_id").alias("chunk_id"), "text", "n_chars")
    new = d.where("doc_id % 2 = 0").select(F.when(F.col("doc_id") % 50 != 0, F.col("doc_id")).alias("chunk_id"), F.lower("text").alias("text"), "n_chars")
    return files.upserted(old, new).select("chunk_id", "text")


@query(f"""SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || ['8', '9', 'a', 'b'][CAST('0x' || substr(h, 17, 1) AS INTEGER) % 4 + 1] || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS object_id
FROM (SELECT doc_id, sha1(unhex('{NAMESPACE}') || encode('chunk-' || doc_id)) AS h FROM documents)""")
def s9_object_ids(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", fx.uuid5(F.concat(F.lit("chunk-"), F.col("doc_id").cast("string")), NAMESPACE).alias("object_id"))


@query("SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events")
def s10_metadata_json(spark, sf_dir):
    text = F.when(F.col("event_id") % 5 == 0, "{broken").otherwise(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", files.metadata_struct(text, "k long").alias("m")).select("event_id", "m.k")


@query("SELECT doc_id, length(text) AS n FROM documents WHERE length(text) >= 100")
def s13_quarantine(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("error", F.when(F.length("text") < 100, "too short"))
    good, _ = files.quarantined(d)
    return good.select("doc_id", F.length("text").cast("long").alias("n"))


def spans(spark, sf_dir) -> DataFrame:
    """Words of the lines as spans; every fifth word lies over the one before it."""
    words = page_lines(spark, sf_dir).select("doc", "page_number", "line_no", F.posexplode(F.split("text", " ")).alias("span_no", "text"))
    at = F.when(F.col("span_no") % 5 == 4, F.col("span_no") - 1).otherwise(F.col("span_no"))
    return words.select("*", (at * 10.0).alias("x0"), (at * 10.0 + 9).alias("x1"), F.lit(0.0).alias("y0"), F.lit(9.0).alias("y1"), F.when(F.length("text") % 2 == 0, 12.0).otherwise(10.0).alias("font_size"), (F.col("span_no") == 0).alias("is_bold"))


@query()
def l1_span_overlaps(spark, sf_dir):
    return ln.without_overlaps(spans(spark, sf_dir).drop("font_size", "is_bold")).select("doc", "line_no", "span_no", "text")


@query(f"""WITH {LINES_SQL}, w AS (SELECT doc, line_no, unnest(string_split(text, ' ')) AS text, unnest(range(len(string_split(text, ' ')))) AS span_no FROM lines), r AS (SELECT *, CASE WHEN length(text) % 2 = 0 THEN 12e0 ELSE 10e0 END AS size FROM w WHERE trim(text) <> ''),
m AS (SELECT doc, line_no, size, sum(length(text)) AS m, min(span_no) AS f FROM r GROUP BY 1, 2, 3)
SELECT r.doc, r.line_no, string_agg(r.text, '' ORDER BY span_no) AS text, bool_or(span_no = 0) AS is_bold, (SELECT size FROM m WHERE m.doc = r.doc AND m.line_no = r.line_no ORDER BY m DESC, f LIMIT 1) AS font_size FROM r GROUP BY r.doc, r.line_no""")
def l2_line_assembly(spark, sf_dir):
    return ln.assemble_spans(spans(spark, sf_dir)).select("doc", "line_no", "text", "is_bold", "font_size")


@query()
def l3_near_duplicate_lines(spark, sf_dir):
    lines = page_lines(spark, sf_dir)
    shifted = lines.where("line_no % 6 = 0").withColumn("line_no", F.col("line_no") + 100_000).withColumn("x0", F.col("x0") + 1).withColumn("text", F.concat("text", F.lit("!")))
    return ln.without_near_duplicates(lines.unionByName(shifted)).select("doc", "line_no", "text")


@query(r"""WITH p AS (SELECT doc_id % 50 AS doc, doc_id AS page_number, trim(regexp_replace(text || CASE WHEN doc_id % 11 = 0 THEN ' Safeguards total IG1 IG2 IG3' ELSE '' END, '\s+', ' ', 'g')) AS t, doc_id % 2 = 0 AS has_image, doc_id % 101 = 0 AS asked FROM documents),
r AS (SELECT *, CASE WHEN asked THEN 0 WHEN contains(upper(t), 'SAFEGUARDS TOTAL') AND contains(upper(t), 'IG1') AND contains(upper(t), 'IG2') AND contains(upper(t), 'IG3') THEN 1 WHEN length(t) < 160 THEN 2 WHEN has_image AND length(t) < 800 THEN 3 END AS priority FROM p)
SELECT doc, page_number, CAST(priority AS BIGINT) AS priority FROM r WHERE priority IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc ORDER BY priority, page_number) <= 8""")
def l12_supplement_pages(spark, sf_dir):
    d = F.col("doc_id")
    text = F.concat("text", F.when(d % 11 == 0, " Safeguards total IG1 IG2 IG3").otherwise(""))
    p = table(spark, sf_dir, "documents").select((d % 50).alias("doc"), d.alias("page_number"), text.alias("text"), (d % 2 == 0).alias("has_image"), (d % 101 == 0).alias("asked"))
    return su.selected_pages(p, 8).select("doc", "page_number", F.col("priority").cast("long").alias("priority"))


@query(r"""SELECT page_id, '| ' || split_part(url, '/', 3) || ' | x |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || page_id || ' |  |' || chr(10) || chr(10) || '$$' || page_id || '$$' AS text FROM pages""")
def l14_visual_blocks(spark, sf_dir):
    """L14 and L15."""
    p = table(spark, sf_dir, "pages")
    no = F.col("page_id").cast("string")
    html = F.concat(F.lit("<table><tr><th>"), F.split("url", "/")[2], F.lit("</th><th> <b>x</b></th></tr><tr><td>"), no, F.lit("</td></tr></table>"))
    box = lambda y: F.array(F.lit(0.0), F.lit(y), F.lit(1.0), F.lit(1.0))
    both = F.explode(F.array(F.struct(F.lit("equation").alias("type"), box(9.0).alias("bbox"), no.alias("content")), F.struct(F.lit("table").alias("type"), box(1.0).alias("bbox"), html.alias("content"))))
    blocks = p.select(F.col("page_id").alias("doc"), F.lit(1).alias("page_number"), both.alias("b")).select("doc", "page_number", "b.*")
    return su.page_text(blocks).select(F.col("doc").alias("page_id"), "text")


def _clause_lines(spark, sf_dir) -> DataFrame:
    head = F.concat((F.col("line_no") % 9 + 1).cast("string"), F.lit(".1 Clause "), F.col("text"))
    return page_lines(spark, sf_dir).withColumn("text", F.when(F.col("line_no") % 4 == 2, F.left(head, F.lit(60))).otherwise(F.col("text")))


CLAUSE_SQL = f"""{LINES_SQL}, cl AS (SELECT doc, line_no, CASE WHEN line_no % 4 = 2 THEN left((line_no % 9 + 1) || '.1 Clause ' || text, 60) ELSE text END AS text FROM lines),
mk AS (SELECT *, nullif(regexp_extract(text, '^([0-9]{{1,2}}[.][0-9]{{1,2}})\\s+([A-Z][^\\n]{{2,120}})$', 1), '') AS c FROM cl), gr AS (SELECT *, count(c) OVER (PARTITION BY doc ORDER BY line_no) AS piece FROM mk),
pieces AS (SELECT doc, piece, max(c) AS clause, trim(string_agg(text, chr(10) ORDER BY line_no), ' ' || chr(10) || chr(9)) AS text FROM gr GROUP BY 1, 2)"""


@query(f"WITH {CLAUSE_SQL} SELECT doc, piece, clause, text FROM pieces WHERE text <> ''")
def c7_clause_split(spark, sf_dir):
    return chunking.clause_pieces(_clause_lines(spark, sf_dir))


@query(f"WITH {CLAUSE_SQL} SELECT doc, piece, CASE WHEN piece % 2 = 1 THEN '[Applies to Implementation Groups: IG1, IG2; Asset Type: Data]' || chr(10) || text ELSE text END AS text FROM pieces WHERE text <> ''")
def c8_annotated_clauses(spark, sf_dir):
    p = chunking.clause_pieces(_clause_lines(spark, sf_dir))
    groups = F.when(F.col("piece") % 2 == 1, F.array(F.lit("IG1"), F.lit("IG2"))).otherwise(F.array().cast("array<string>"))
    return p.select("doc", "piece", chunking.annotated(F.col("text"), groups, F.lit("Data"), F.lit("")).alias("text"))


@query(f"""WITH {CLAUSE_SQL}, p AS (SELECT doc, piece, CASE WHEN piece % 3 = 0 THEN clause END AS clause, text FROM pieces WHERE text <> ''),
f AS (SELECT *, CASE WHEN row_number() OVER w > 1 AND {TOKENS} < 40 AND lag(clause) OVER w IS NOT DISTINCT FROM clause THEN 0 ELSE 1 END AS new FROM p WINDOW w AS (PARTITION BY doc ORDER BY piece)),
g AS (SELECT *, sum(new) OVER (PARTITION BY doc ORDER BY piece) - 1 AS g FROM f) SELECT doc, CAST(g AS BIGINT) AS piece, max(clause) AS clause, string_agg(text, chr(10) ORDER BY piece) AS text FROM g GROUP BY doc, g""")
def c13_merge_undersized(spark, sf_dir):
    p = chunking.clause_pieces(_clause_lines(spark, sf_dir)).withColumn("clause", F.when(F.col("piece") % 3 == 0, F.col("clause")))
    return chunking.undersized_joined(p, ["doc"], "piece").select("doc", F.col("piece").cast("long").alias("piece"), "clause", "text")


def merged(spark, sf_dir) -> DataFrame:
    """The clause pieces of the documents as chunks, merged."""
    p = chunking.clause_pieces(_clause_lines(spark, sf_dir))
    one = F.lit(1).cast("long")
    rows = p.select(
        F.col("doc").alias("doc_id"), F.col("piece").alias("chunk_index"), "text", fx.token_estimate(F.col("text")).alias("token_count"), "clause", one.alias("page_start"), one.alias("page_end"), (F.col("piece") % 3).alias("depth"),
        F.when(F.col("clause").isNotNull(), "clause").otherwise("narrative").alias("element_type"), F.lit(None).cast("string").alias("table_annotation"),
    )
    return chunking.merged_chunks(rows)


@query()
def c14_global_merge(spark, sf_dir):
    return merged(spark, sf_dir)


IDS_SQL = f"""{CHUNKS_SQL}, b AS (SELECT doc_id, chunk_index, CASE doc_id % 5 WHEN 0 THEN 'control' || lpad(CAST(doc_id % 12 AS VARCHAR), 2, '0') || '-safeguard' || (doc_id % 12) || '.4' WHEN 1 THEN 'glossary-' || chunk_index WHEN 2 THEN 'control07-overview' WHEN 3 THEN 'intro-' || chunk_index ELSE 'doc-' || chunk_index END AS base_id FROM chunks)"""


@query(f"WITH {IDS_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, base_id ORDER BY chunk_index) AS n FROM b) SELECT doc_id, chunk_index, CASE WHEN n = 1 THEN base_id ELSE base_id || '-part' || CASE WHEN n < 100 THEN lpad(CAST(n AS VARCHAR), 2, '0') ELSE CAST(n AS VARCHAR) END END AS chunk_id FROM n")
def c16_semantic_ids(spark, sf_dir):
    """C16 and C17."""
    d = F.col("doc_id")
    clause = F.when(d % 5 == 0, F.concat((d % 12).cast("string"), F.lit(".4")))
    crumbs = F.when(d % 5 == 1, F.array(F.lit("A"), F.lit("Glossary"))).when(d % 5 == 2, F.array(F.lit("Control 7 Data"))).when(d % 5 == 3, F.array(F.lit("Introduction"))).otherwise(F.array(F.lit("Other")))
    base = chunking.semantic_id(clause, crumbs, F.concat(F.lit("doc-"), F.col("chunk_index").cast("string")))
    return chunking.unique_ids(chunks(spark, sf_dir).withColumn("base_id", base)).select("doc_id", "chunk_index", "chunk_id")


@query()
def c19_supplement_acceptance(spark, sf_dir):
    """Every second page's text, shortened, is offered as a supplement of its document's chunks."""
    base = chunks(spark, sf_dir).select(F.col("doc_id").alias("doc"), "chunk_index", "text", F.col("chunk_index").alias("page_start"), F.col("chunk_index").alias("page_end"))
    offered = base.where("doc % 2 = 0").select("doc", F.col("page_start").alias("page_number"), F.when(F.col("doc") % 4 == 0, F.col("text")).otherwise(F.concat(F.lit("| new | "), F.col("text"))).alias("text"))
    good = su.accepted(offered.join(su.base_text(offered, base), ["doc", "page_number"], "left"))
    return su.with_supplements(base, good).select("doc", "chunk_index", "page_start", "element_type")


@query()
def r3_batched_embedding(spark, sf_dir):
    """A deterministic embedder in a model's place: 16 hashed term counts, computed in Arrow batches."""
    return rt_embed(table(spark, sf_dir, "benchmark").select("item_id", "text"), "text")


def rt_embed(df: DataFrame, text: str, dims: int = 16) -> DataFrame:
    @F.pandas_udf("array<double>")
    def embed(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            v = [0.0] * dims
            for w in (t or "").lower().split():
                v[xxhash.xxh64_intdigest(w) % dims] += 1
            out.append(v)
        return pd.Series(out)

    return df.withColumn("vector", embed(text))


@query()
def a7_related_assist(spark, sf_dir):
    req = requests(spark, sf_dir)
    vec = rt_embed(req, "question")
    return reuse.assisted(vec.where("request_id % 2 = 1"), vec.where("request_id % 2 = 0").withColumnRenamed("request_id", "response_id")).select("request_id", "response_id", "how")


TTL_SQL = """WITH RECURSIVE e AS (SELECT user_id AS key, event_id AS request_id, CAST(epoch_ms(ts) AS BIGINT) AS ms, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events WHERE ts IS NOT NULL),
w AS (SELECT key, request_id, r, ms AS at, request_id AS answered_by FROM e WHERE r = 1
  UNION ALL SELECT e.key, e.request_id, e.r, CASE WHEN e.ms - w.at <= 3600000 THEN w.at ELSE e.ms END, CASE WHEN e.ms - w.at <= 3600000 THEN w.answered_by ELSE e.request_id END FROM w JOIN e ON e.key = w.key AND e.r = w.r + 1)
SELECT key, request_id, CASE WHEN request_id = answered_by THEN 'new' ELSE 'repeat' END AS kind, answered_by, CAST(0 AS BIGINT) AS late FROM w"""


@query(TTL_SQL)
def a10_streaming_repeats(spark, sf_dir):
    """The event table as a stream: each request of a user is new, or a repeat of one at most an hour before. What is there comes in
    one batch, hence in order; the tests send batches out of order."""
    e = _event_stream(spark, sf_dir).select(F.col("user_id").alias("key"), F.col("event_id").alias("request_id"), "ts")
    return _drained(spark, streams.requests_in_ttl(e, ttl_seconds=3600, delay="1000 days"), "append")


@query("SELECT chunk_id, arg_max(text, part) AS text FROM (SELECT doc_id // 2 AS chunk_id, text, doc_id % 2 AS part FROM documents) GROUP BY 1")
def s12_incremental_ingest(spark, sf_dir):
    """Two batches of documents upserted into hash buckets: the second has newer texts of the same ids."""
    target = f"{shared_dir(spark)}/corpusloom-{uuid.uuid4().hex}/ingest"
    d = table(spark, sf_dir, "documents").select(F.expr("doc_id div 2").alias("chunk_id"), "text", (F.col("doc_id") % 2).alias("part"))
    for number in (0, 1):
        streams.upsert_buckets(target, d.where(F.col("part") == number).select("chunk_id", "text"), number)
    return streams.bucket_table(spark, target, d.select("chunk_id", "text").schema).select("chunk_id", "text")


@query("WITH e AS (SELECT user_id AS run_id, event_type AS stage, props AS state, event_id AS event_no FROM events) SELECT run_id, stage, arg_max(state, event_no) AS state, max(event_no) AS event_no FROM e GROUP BY 1, 2")
def j1_streaming_states(spark, sf_dir):
    e = _event_stream(spark, sf_dir).select(F.col("user_id").alias("run_id"), F.col("event_type").alias("stage"), F.col("props").alias("state"), F.col("event_id").alias("event_no"))
    return _drained(spark, streams.latest_states(e), "complete")


@query("SELECT event_type AS policy, CAST(epoch(time_bucket(INTERVAL '3600 seconds', ts)) AS BIGINT) AS window_start, count(*) AS requests FROM events GROUP BY 1, 2")
def u7_streaming_windows(spark, sf_dir):
    e = _event_stream(spark, sf_dir).select("ts", F.col("event_type").alias("policy"))
    out = _drained(spark, streams.window_counts(e, 3600, "1000 days"), "complete")
    return out.select("policy", F.unix_timestamp("w.start").alias("window_start"), "requests")


def _event_stream(spark, sf_dir) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    # The table may be one file or a folder of part files.
    pattern = "*.parquet" if len(spark.read.parquet(path).inputFiles()) > 1 else "events.parquet"
    folder = path if pattern == "*.parquet" else sf_dir
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def _drained(spark, stream: DataFrame, mode: str) -> DataFrame:
    """Run a stream over all that is there into a table in the shared folder, and read that."""
    top = f"{shared_dir(spark)}/corpusloom-stream-{uuid.uuid4().hex}"
    schema = stream.schema

    def write(batch: DataFrame, number: int) -> None:
        path = f"{top}/out" if mode == "append" else f"{top}/out/v={number}"
        batch.write.mode("append" if mode == "append" else "overwrite").parquet(path)

    q = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{top}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    if mode == "append":
        return spark.read.schema(schema).parquet(f"{top}/out")
    got = spark.read.parquet(f"{top}/out")
    last = got.agg(F.max("v")).first()[0]
    return got.where(F.col("v") == last).drop("v")


@query(f"WITH {GOLD_SQL} SELECT count(*) AS records, count(*) FILTER (regexp_matches(relevant_chunk_ids[1], '^control[0-9]+-')) AS aligned FROM gold")
def e7_alignment_check(spark, sf_dir):
    return ev.misaligned(golden(spark, sf_dir), r"^control[0-9]+-")


@query(f"WITH {GOLD_SQL} SELECT coalesce(provenance, 'unknown') AS provenance, count(*) AS records FROM gold WHERE NOT verified GROUP BY 1")
def e8_unverified_report(spark, sf_dir):
    return ev.unverified(golden(spark, sf_dir))


@query("WITH m AS (SELECT event_type AS name, CAST(count(*) AS DOUBLE) AS v FROM events GROUP BY 1), r AS (SELECT unnest(['click', 'view', 'ndcg']) AS name) SELECT r.name, coalesce(CAST(CAST(v AS BIGINT) AS VARCHAR), 'N/A') AS value FROM r LEFT JOIN m ON r.name = m.name")
def e10_registry_summary(spark, sf_dir):
    counts = table(spark, sf_dir, "events").groupBy("event_type").count()
    maps = counts.select(F.create_map("event_type", "count").alias("metrics"))
    registry = spark.createDataFrame([("click",), ("view",), ("ndcg",)], "name string")
    return ev.registry_summary(maps, registry)


def _transcripts(spark, sf_dir) -> DataFrame:
    """Conversations as transcripts in loose JSON, read back as canonical records."""
    c = table(spark, sf_dir, "conversations").where("text is not null")
    turns = c.groupBy("conv_id").agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))), lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))).alias("messages"))).alias("payload"))
    return imports.canonical(imports.loose_records(turns.select(F.col("conv_id").cast("string").alias("path"), "payload")))


@query()
def g12_canonical_imports(spark, sf_dir):
    """Conversations as transcripts in loose JSON, read back and reviewed."""
    rows = _transcripts(spark, sf_dir)
    corpus = chunks(spark, sf_dir).select((F.col("doc_id") * 1000 + F.col("chunk_index")).cast("string").alias("chunk_id"), "text")
    kept = imports.reviewed(imports.row_keys(rows, F.col("record").cast("binary")), golden(spark, sf_dir), corpus)
    return kept.select(F.col("file").cast("long").alias("conv_id"), "query", "reference_answer", "score", "recommendation")


@query("WITH m AS (SELECT conv_id, arg_max(text, turn) FILTER (role = 'user') AS query, arg_max(text, turn) FILTER (role = 'assistant') AS reference_answer FROM conversations WHERE text IS NOT NULL GROUP BY 1) SELECT conv_id, trim(coalesce(query, '')) AS query, trim(coalesce(reference_answer, '')) AS reference_answer FROM m")
def g14_transcripts(spark, sf_dir):
    """The records as read; a review adds columns to them and neither rows nor texts."""
    return _transcripts(spark, sf_dir).select(F.col("file").cast("long").alias("conv_id"), "query", "reference_answer")


@query(f"WITH {CHUNKS_SQL}, t AS (SELECT doc_id, {TOKENS} AS n FROM chunks) SELECT count(*) AS chunks, count(*) FILTER (n < 40) AS undersized, count(DISTINCT doc_id) AS documents, CAST(sum(n) AS BIGINT) AS tokens FROM t")
def k12_chunking_summary(spark, sf_dir):
    c = chunks(spark, sf_dir).select("doc_id", fx.token_estimate(F.col("text")).alias("n"))
    return c.agg(F.count("*").alias("chunks"), F.count_if(F.col("n") < 40).alias("undersized"), F.count_distinct("doc_id").alias("documents"), F.sum("n").alias("tokens"))


@query()
def g6_optimise_dataset(spark, sf_dir):
    """Golden records realigned at 0.80: (source_id, chunk_id, score, status)."""
    c = chunks(spark, sf_dir).select((F.col("doc_id") * 1000 + F.col("chunk_index")).alias("chunk_id"), "text")
    return alignment.aligned(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("source_id"), "text"), c, 0.80, blank=True)


@query("""WITH p AS (SELECT doc_id AS doc, n FROM documents, (SELECT unnest(range(3)) AS n)), g AS (SELECT doc, string_agg('IG' || (n + 1), ',' ORDER BY n) FILTER ((doc + n) % 2 = 0) AS groups FROM p GROUP BY doc)
SELECT doc, '5.' || (doc % 9) AS clause_number, CASE doc % 3 WHEN 0 THEN 'Devices' WHEN 1 THEN 'Users' END AS asset_type, coalesce(lang, 'none') AS security_function, groups FROM g JOIN documents ON doc_id = doc""")
def c6_table_annotations(spark, sf_dir):
    """Each document as one page of a table: three labels, a clause, a mark under every second label, an asset type for two thirds and
    the language between hyphens as security function."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "lang")
    cell = lambda no, text, x: F.struct(F.lit(no).alias("line_no"), text.alias("text"), F.lit(x).alias("x0"))
    labels = [cell(n, F.lit(f"IG{n + 1}"), 100.0 * n) for n in range(3)]
    marks = [cell(10 + n, F.when((F.col("doc") + n) % 2 == 0, chunking.MARK).otherwise("x"), 100.0 * n + 5) for n in range(3)]
    asset = cell(20, F.when(F.col("doc") % 3 == 0, "Devices").when(F.col("doc") % 3 == 1, "Users").otherwise("Other"), 400.0)
    function = cell(21, F.concat(F.lit("-"), F.coalesce("lang", F.lit("none")), F.lit("-")), 500.0)
    rows = F.explode(F.array(*labels, cell(5, F.concat(F.lit("5."), (F.col("doc") % 9).cast("string")), 300.0), *marks, asset, function))
    lines = d.select("doc", F.lit(1).alias("page_number"), rows.alias("r")).select("doc", "page_number", "r.*")
    return chunking.table_annotations(lines).select("doc", "clause_number", "asset_type", "security_function", F.array_join("applicable_groups", ",").alias("groups"))


@query(f"WITH {CLAUSE_SQL} SELECT doc, piece, row_number() OVER (PARTITION BY doc ORDER BY piece) - 1 AS chunk_index, CASE WHEN clause IS NULL THEN 'narrative' ELSE 'clause' END AS element_type, {TOKENS} AS token_count FROM pieces WHERE text <> ''")
def c15_chunk_metadata(spark, sf_dir):
    return chunking.chunk_metadata(chunking.clause_pieces(_clause_lines(spark, sf_dir)), ["piece"]).select("doc", "piece", "chunk_index", "element_type", "token_count")


@query("WITH j AS (SELECT event_id AS id, event_type AS kind, ts FROM events WHERE event_type <> 'click') SELECT id, kind FROM j ORDER BY ts DESC, id")
def j10_job_listing(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("kind"), F.col("ts").alias("created_at"))
    return jobs.listing(e, ("click",)).select("id", "kind")


@query("WITH " + CAND_SQL + " SELECT query_id, chunk_id, CAST(length(question) + length(text) AS DOUBLE) AS rerank_score FROM cand")
def r14_pair_scoring(spark, sf_dir):
    """A scorer of lengths in a model's place."""
    scored = rt.pair_scored(candidates(spark, sf_dir), lambda q, t: q.str.len() + t.str.len())
    return scored.select("query_id", "chunk_id", "rerank_score")


@query("WITH " + CAND_SQL + " SELECT query_id, string_agg(chunk_id, ',' ORDER BY rank) AS retrieved, count(*) AS contexts, 'answer ' || query_id AS answer FROM cand WHERE rank <= 5 GROUP BY query_id")
def e9_example_rows(spark, sf_dir):
    q = questions(spark, sf_dir)
    answers = q.withColumn("answer", F.concat(F.lit("answer "), F.col("query_id").cast("string")))
    rows = ev.example_rows(q, candidates(spark, sf_dir).where("rank <= 5"), answers)
    return rows.select("query_id", F.array_join("retrieved_chunk_ids", ",").alias("retrieved"), F.size("contexts").cast("long").alias("contexts"), "answer")


@query("WITH " + CAND_SQL + " SELECT query_id, question AS query, chunk_id, text AS source_text, 'Answer ' || query_id AS reference_answer, false AS verified, 'ui-generated-candidate' AS provenance FROM cand WHERE rank = 1")
def g8_candidate_records(spark, sf_dir):
    answers = questions(spark, sf_dir).withColumn("answer", F.concat(F.lit(" Answer "), F.col("query_id").cast("string"), F.lit("  ")))
    made = cu.candidate_records(candidates(spark, sf_dir), answers)
    return made.select("query_id", "query", F.get("relevant_chunk_ids", F.lit(0)).alias("chunk_id"), "source_text", "reference_answer", "verified", "provenance")


@query()
def g18_normalised_records(spark, sf_dir):
    """Benchmark passages as imported records: every third names a chunk that exists, the others are aligned."""
    c = chunks(spark, sf_dir).select(F.concat_ws("-", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string")).alias("chunk_id"), "text")
    b = table(spark, sf_dir, "benchmark")
    ids = F.when(F.col("item_id") % 3 == 0, F.array(F.lit("1-0"))).otherwise(F.array(F.lit("none")))
    r = b.select(F.col("item_id").alias("row_key"), F.col("text").alias("query"), F.col("text").alias("reference_answer"), F.col("text").alias("source_text"), ids.alias("relevant_chunk_ids"))
    return cu.normalised_records(r, c).select("row_key", "relevant_chunk_ids", "error")


@query()
def a9_answer_keys(spark, sf_dir):
    """Retrieval and answer keys of the questions."""
    c = candidates(spark, sf_dir).where("rank <= 5")
    q = questions(spark, sf_dir).withColumnRenamed("question", "query")
    return q.select("query_id", reuse.retrieval_key(q).alias("retrieval_key")).join(reuse.answer_keys(c, "Answer from the passages.", "model"), "query_id")


# Scans and sinks: the documents are written in the shared folder as files of the kind in question and read back.
def _folder(spark) -> str:
    return f"{shared_dir(spark)}/corpusloom-{uuid.uuid4().hex}/files"


@query("SELECT doc_id, lang, length(text) AS chars FROM documents")
def s1_strict_jsonl(spark, sf_dir):
    path = _folder(spark)
    table(spark, sf_dir, "documents").select("doc_id", "lang", "text").write.json(path)
    return files.strict_jsonl(spark, path, "doc_id long, lang string, text string").select("doc_id", "lang", F.length("text").cast("long").alias("chars"))


@query("""SELECT CASE doc_id % 5 WHEN 0 THEN 'not JSON' WHEN 1 THEN 'no text' ELSE CASE WHEN trim(coalesce(text, '')) = '' THEN 'no text' END END AS reason, count(*) AS n,
CAST(sum(CASE WHEN doc_id % 5 > 1 AND trim(coalesce(text, '')) <> '' THEN length(text) ELSE 0 END) AS BIGINT) AS chars FROM documents GROUP BY 1""")
def s3_lenient_chunks(spark, sf_dir):
    """A fifth of the lines is cut off, another has no text."""
    path, d = _folder(spark), F.col("doc_id")
    whole = F.to_json(F.struct(F.when(d % 5 > 1, F.col("text")).alias("text"), F.struct(d.cast("string").alias("chunk_id")).alias("metadata")))
    table(spark, sf_dir, "documents").select(F.when(d % 5 == 0, F.left(whole, F.length(whole) - 2)).otherwise(whole).alias("value")).write.text(path)
    good, bad = files.lenient_chunks(spark, path)
    both = good.select(F.lit(None).cast("string").alias("reason"), F.length("text").alias("c")).unionByName(bad.select("reason", F.lit(0).alias("c")))
    return both.groupBy("reason").agg(F.count("*").alias("n"), F.sum("c").alias("chars"))


@query("SELECT lang, CAST(sum(strlen(text) + 1) AS BIGINT) AS bytes FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL GROUP BY 1")
def s4_document_discovery(spark, sf_dir):
    """A folder of files for each language, found by walking the tree."""
    path = _folder(spark)
    table(spark, sf_dir, "documents").where("text is not null and lang is not null").select(F.col("text").alias("value"), "lang").write.partitionBy("lang").text(path)
    found = files.documents_in(spark, path, "*.txt")
    return found.groupBy(F.regexp_extract("path", "lang=([^/]+)/", 1).alias("lang")).agg(F.sum("length").alias("bytes"))


@query("""SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'not a PDF file name' WHEN doc_id % 7 = 1 THEN 'empty file' WHEN doc_id % 7 = 2 THEN 'larger than 10 MiB' WHEN doc_id % 7 = 3 AND NOT starts_with(coalesce(text, ''), '%PDF-') THEN 'no PDF header' END AS rejected FROM documents""")
def s5_admission(spark, sf_dir):
    """The documents as uploads: some with another name, without content, too long, or without the header."""
    d, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    body = F.when(d % 7 == 1, "").when(d % 7 == 3, text).otherwise(F.concat(F.lit("%PDF-"), text))
    uploads = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("up/"), d.cast("string"), F.when(d % 7 == 0, ".txt").otherwise(".PDF")).alias("path"), F.encode(body, "UTF-8").alias("content"))
    return files.admission(uploads.withColumn("length", F.when(d % 7 == 2, files.MAX_UPLOAD + 1).otherwise(F.octet_length("content")))).select("doc_id", "rejected")


@query(f"WITH {CHUNKS_SQL} SELECT doc_id || '-' || chunk_index AS chunk_id, length(text) AS chars, {TOKENS} AS token_count FROM chunks")
def s6_chunk_sink(spark, sf_dir):
    path, c = _folder(spark), chunks(spark, sf_dir)
    meta = F.struct(F.concat_ws("-", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string")).alias("chunk_id"), fx.token_estimate(F.col("text")).cast("int").alias("token_count"))
    files.write_chunks(c.select("text", meta.alias("metadata")), path)
    return files.strict_jsonl(spark, path, files.CHUNK_SCHEMA).select("metadata.chunk_id", F.length("text").cast("long").alias("chars"), F.col("metadata.token_count").cast("long").alias("token_count"))


@query("""WITH r AS (SELECT l.doc_id, d.text, CASE l.doc_id % 4 WHEN 0 THEN ['d' || l.doc_id, 'd' || (l.doc_id + 1)] WHEN 1 THEN ['no such', 'd' || l.doc_id] WHEN 2 THEN ['no such'] ELSE [] END AS ids, CASE WHEN l.doc_id % 3 < 2 THEN 'd' || l.doc_id END AS matched FROM labels l JOIN documents d ON d.doc_id = l.doc_id WHERE l.quality = 1),
a AS (SELECT list('d' || doc_id) AS xs FROM documents), k AS (SELECT *, list_filter(ids, lambda x: list_contains(xs, x)) AS known FROM r, a)
SELECT doc_id AS row_key, CASE WHEN matched IS NOT NULL AND NOT list_contains(known, matched) THEN matched ELSE array_to_string(known, ',') END AS relevant_chunk_ids, trim(text, ' ') AS source_text, true AS verified, 'human-reviewed-json-upload' AS provenance FROM k""")
def g21_verified_records(spark, sf_dir):
    """Labelled documents as reviewed imports; those of good quality are approved."""
    d, own = F.col("doc_id"), F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    docs = table(spark, sf_dir, "documents")
    after = F.concat(F.lit("d"), (d + 1).cast("string"))
    ids = F.when(d % 4 == 0, F.array(own, after)).when(d % 4 == 1, F.array(F.lit("no such"), own)).when(d % 4 == 2, F.array(F.lit("no such"))).otherwise(F.array().cast("array<string>"))
    reviews = table(spark, sf_dir, "labels").join(docs.select("doc_id", "text"), "doc_id").select(
        d.alias("row_key"), "quality", F.lit("Why is it so?").alias("query"), F.lit("Because").alias("reference_answer"), F.col("text").alias("source_text"), ids.alias("relevant_chunk_ids"),
        F.when(d % 3 < 2, own).alias("matched_chunk_id"), F.lit(90).alias("score"), F.lit(1.0).alias("alignment"), F.lit(1.0).alias("support"),
    )
    made = imports.verified_records(reviews, reviews.where("quality = 1").select("row_key"), docs.select(own.alias("chunk_id"), "text"))
    return made.select("row_key", F.array_join("relevant_chunk_ids", ",").alias("relevant_chunk_ids"), "source_text", "verified", "provenance")
