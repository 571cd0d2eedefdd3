"""Queries over ``conversations``, ``labels``, ``pages`` and ``events``: history, audit, jobs and curation."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import text as fx
from ..operators import alignment, audit, curation as cu, history as hi, jobs
from .documents import CHUNKS_SQL, chunks
from .registry import query, table

MSG_SQL = "msg AS (SELECT conv_id AS session_id, conv_id * 1000 + turn AS message_id, turn, role, text FROM conversations)"


def messages(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("message_id"), "turn", "role", "text")


def sessions(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max("turn").alias("updated_at"))
    user = F.concat(F.lit("u"), (F.col("conv_id") % 5).cast("string"))
    return c.select(F.col("conv_id").alias("id"), user.alias("user_id"), F.when(F.col("conv_id") % 3 == 0, "general").when(F.col("conv_id") % 3 == 1, "document").alias("mode"), "updated_at")


SES_SQL = "ses AS (SELECT conv_id AS id, 'u' || (conv_id % 5) AS user_id, CASE conv_id % 3 WHEN 0 THEN 'general' WHEN 1 THEN 'document' END AS mode, max(turn) AS updated_at FROM conversations GROUP BY conv_id)"


@query(f"WITH {SES_SQL} SELECT id, updated_at FROM ses WHERE user_id = 'u1' AND coalesce(mode, 'document') = 'document'")
def h1_session_list(spark, sf_dir):
    return hi.sessions_of(sessions(spark, sf_dir), "u1", "document").select("id", "updated_at")


@query(f"WITH {MSG_SQL}, {SES_SQL} SELECT session_id, message_id, role FROM msg WHERE session_id IN (SELECT id FROM ses WHERE user_id = 'u2')")
def h2_owned_messages(spark, sf_dir):
    return hi.owned_messages(messages(spark, sf_dir), sessions(spark, sf_dir), "u2").select("session_id", "message_id", "role")


FB_SQL = "fb AS (SELECT doc_id AS feedback_id, doc_id % 60 AS session_id, (doc_id % 60) * 1000 + doc_id % 4 AS message_id, 'u' || (doc_id % 2) AS user_id, quality, doc_id AS updated_at FROM labels)"


def feedback(spark, sf_dir) -> DataFrame:
    d = F.col("doc_id")
    return table(spark, sf_dir, "labels").select(d.alias("feedback_id"), (d % 60).alias("session_id"), (d % 60 * 1000 + d % 4).alias("message_id"), F.concat(F.lit("u"), (d % 2).cast("string")).alias("user_id"), "quality", d.alias("updated_at"))


@query(f"WITH {MSG_SQL}, {FB_SQL} SELECT m.session_id, m.message_id, f.feedback_id, f.quality FROM msg m LEFT JOIN fb f ON m.session_id = f.session_id AND m.message_id = f.message_id")
def h3_messages_with_feedback(spark, sf_dir):
    return hi.with_feedback(messages(spark, sf_dir), feedback(spark, sf_dir)).select("session_id", "message_id", "feedback_id", "quality")


@query(f"WITH {FB_SQL}, a AS (SELECT message_id AS reply_to, feedback_id % 7 AS version FROM fb), {MSG_SQL} SELECT m.message_id AS reply_to, coalesce(max(version), 0) + 1 AS next_version FROM msg m LEFT JOIN a ON a.reply_to = m.message_id GROUP BY 1")
def h4_next_answer_version(spark, sf_dir):
    answers = feedback(spark, sf_dir).select(F.col("message_id").alias("reply_to"), (F.col("feedback_id") % 7).alias("version"))
    return hi.next_versions(messages(spark, sf_dir).select(F.col("message_id").alias("reply_to")), answers)


@query(f"WITH {MSG_SQL}, {FB_SQL} SELECT 'message' AS kind, message_id AS id FROM msg WHERE session_id % 7 <> 0 UNION ALL SELECT 'feedback', feedback_id FROM fb WHERE NOT (session_id % 7 = 0 AND session_id IN (SELECT session_id FROM msg))")
def h5_cascade_delete(spark, sf_dir):
    m = messages(spark, sf_dir)
    gone = m.where("session_id % 7 = 0").select("session_id").distinct()
    left = hi.without_sessions(m, gone).select(F.lit("message").alias("kind"), F.col("message_id").alias("id"))
    return left.unionByName(hi.without_sessions(feedback(spark, sf_dir), gone).select(F.lit("feedback").alias("kind"), F.col("feedback_id").alias("id")))


N = r"trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))"


@query(f"SELECT conv_id, turn, CASE WHEN length({N}) <= 80 THEN {N} ELSE rtrim(left({N}, 79)) || '...' END AS title FROM conversations")
def h6_session_title(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", fx.session_title(F.col("text")).alias("title"))


@query(f"WITH {MSG_SQL}, {FB_SQL}, r AS (SELECT f.*, row_number() OVER (PARTITION BY user_id, f.message_id ORDER BY updated_at DESC, feedback_id DESC) AS n, min(updated_at) OVER (PARTITION BY user_id, f.message_id) AS created_at FROM fb f WHERE (session_id, message_id) IN (SELECT session_id, message_id FROM msg WHERE role = 'assistant')) SELECT user_id, message_id, feedback_id, created_at FROM r WHERE n = 1")
def h7_feedback_upsert(spark, sf_dir):
    return hi.upserted_feedback(feedback(spark, sf_dir), messages(spark, sf_dir)).select("user_id", "message_id", "feedback_id", "created_at")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'clear,odd' ELSE 'helpful,clear' END AS chips, CASE WHEN doc_id % 3 = 0 THEN 'odd' ELSE '' END AS unknown FROM labels")
def h8_feedback_reasons(spark, sf_dir):
    chips = F.when(F.col("doc_id") % 3 == 0, F.array(*map(F.lit, ("clear", "odd", "clear")))).otherwise(F.array(*map(F.lit, ("helpful", "clear", "helpful"))))
    once, bad = hi.reasons(chips)
    return table(spark, sf_dir, "labels").select("doc_id", F.array_join(once, ",").alias("chips"), F.array_join(bad, ",").alias("unknown"))


@query("SELECT conv_id, turn, coalesce(string_agg(role || ': ' || text, ' / ') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), '') AS context FROM conversations WHERE text IS NOT NULL")
def h9_turn_context(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("text is not null")
    return hi.contexts(c, 3).select("conv_id", "turn", F.array_join("context", " / ").alias("context"))


@query("SELECT conv_id, turn, CAST(CASE WHEN row_number() OVER (PARTITION BY conv_id ORDER BY turn) % 3 = 0 THEN 2 ELSE 1 END AS BIGINT) AS answers FROM conversations WHERE role = 'user'")
def h10_answer_count(spark, sf_dir):
    return hi.answer_counts(table(spark, sf_dir, "conversations"), 3).select("conv_id", "turn", "answers")


@query(r"SELECT left(sha256(url), 24) AS source_id, url, left(trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')), 420) AS text FROM pages WHERE regexp_matches(url, '(?i)^https?://')")
def h12_web_sources(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("url", F.regexp_replace("html", "<[^>]*>", " ").alias("text"))
    return hi.web_sources(p)


@query("SELECT page_id, row_number() OVER (PARTITION BY page_id % 12 ORDER BY page_id // 24, page_id) AS source_no FROM pages")
def h13_source_numbers(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", (F.col("page_id") % 12).alias("conv"), F.floor(F.col("page_id") / 24).alias("batch"))
    return hi.numbered_sources(p, "conv", ["batch", "page_id"]).select("page_id", "source_no")


@query("SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN '## Question' ELSE '## Answer' END || chr(10) || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS document FROM conversations WHERE text IS NOT NULL GROUP BY conv_id")
def h14_markdown_export(spark, sf_dir):
    return hi.markdown(table(spark, sf_dir, "conversations").where("text is not null"))


# Audit: events are requests.
AUD_SQL = """aud AS (SELECT event_id AS id, ts, user_id, value,
 CASE event_id % 8 WHEN 0 THEN '/api/rag/general/stream' WHEN 1 THEN '/API/rag/documents/upload' WHEN 2 THEN '/api/rag/history/sessions' WHEN 3 THEN '/api/rag/history/{sessionId}' WHEN 4 THEN '/api/rag/feedback/x' WHEN 5 THEN '/api/admin/audit-logs' WHEN 6 THEN '/api/auth/me' ELSE '/api/ragged' END AS path,
 CASE WHEN event_id % 11 = 0 THEN 'DELETE' ELSE 'POST' END AS method,
 CAST(CASE event_id % 9 WHEN 1 THEN 401 WHEN 2 THEN 403 WHEN 3 THEN 504 WHEN 4 THEN 500 WHEN 5 THEN 404 ELSE 200 END AS BIGINT) AS status, event_id % 13 = 0 AS aborted, event_id % 17 = 0 AS exception, event_id % 2 = 0 AS has_token FROM events)"""


def requests(spark, sf_dir) -> DataFrame:
    e = F.col("event_id")
    pick = lambda m, xs, other: F.coalesce(F.get(F.array(*map(F.lit, xs)), (e % m).cast("int")), F.lit(other))
    paths = ("/api/rag/general/stream", "/API/rag/documents/upload", "/api/rag/history/sessions", "/api/rag/history/{sessionId}", "/api/rag/feedback/x", "/api/admin/audit-logs", "/api/auth/me")
    return table(spark, sf_dir, "events").select(
        e.alias("id"), "ts", "user_id", "value", pick(8, paths, "/api/ragged").alias("path"), F.when(e % 11 == 0, "DELETE").otherwise("POST").alias("method"),
        pick(9, (200, 401, 403, 504, 500, 404), 200).cast("long").alias("status"), (e % 13 == 0).alias("aborted"), (e % 17 == 0).alias("exception"), (e % 2 == 0).alias("has_token"),
    )


@query(f"WITH {AUD_SQL}, f AS (SELECT * FROM aud WHERE method = 'POST' AND status = 200 AND ts >= (SELECT min(ts) FROM events)) SELECT id, user_id, (SELECT count(*) FROM f) AS total FROM f ORDER BY ts DESC, id DESC LIMIT 100 OFFSET 100")
def u1_audit_page(spark, sf_dir):
    return audit.page(requests(spark, sf_dir), {"method": "POST", "status": 200, "user_id": None}, number=2, size=500).select("id", "user_id", "total")


@query(r"SELECT event_id, nullif(left(trim(regexp_replace('  ' || chr(7) || event_type || chr(27) || props, '[\x00-\x1f\x7f-\x9f]', '', 'g')), 20), '') AS clean, greatest(0, CAST(floor(value) AS BIGINT) - 50) AS duration_ms FROM events")
def u2_sanitised_fields(spark, sf_dir):
    raw = F.concat(F.lit("  \x07"), F.col("event_type"), F.lit("\x1b"), F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", audit.sanitised(raw, 20).alias("clean"), F.greatest(F.lit(0).cast("long"), F.floor("value") - 50).alias("duration_ms"))


@query(f"WITH {AUD_SQL} SELECT id FROM aud WHERE lower(path) = '/api/auth/me' OR lower(path) = '/api/rag' OR lower(path) LIKE '/api/rag/%' OR lower(path) = '/api/admin/audit-logs' OR lower(path) LIKE '/api/admin/audit-logs/%'")
def u3_auditable_paths(spark, sf_dir):
    return requests(spark, sf_dir).where(audit.is_auditable(F.col("path"))).select("id")


@query(f"""WITH {AUD_SQL} SELECT id, CASE WHEN lower(path) LIKE '/api/admin/audit-logs%' THEN 'ADMIN_AUDIT_LOG_VIEW' WHEN path = '/api/auth/me' AND status NOT IN (401, 403) THEN 'AUTH_PROFILE_VIEW' WHEN status = 401 THEN 'AUTH_UNAUTHORIZED' WHEN status = 403 THEN 'AUTH_FORBIDDEN'
WHEN path LIKE '%/general/stream' THEN CASE WHEN status >= 400 THEN 'RAG_QUERY_FAILED' ELSE 'RAG_QUERY' END WHEN status >= 400 THEN 'RAG_REQUEST_FAILED' WHEN lower(path) LIKE '%/documents/upload' THEN 'RAG_DOCUMENT_UPLOAD' WHEN method = 'DELETE' THEN 'RAG_HISTORY_DELETE' WHEN path LIKE '%/feedback/%' THEN 'RAG_FEEDBACK_SAVE' WHEN path LIKE '%{{sessionId}}%' THEN 'RAG_HISTORY_GET' WHEN path LIKE '%/history/sessions' THEN 'RAG_HISTORY_LIST' ELSE 'RAG_REQUEST_FAILED' END AS action FROM aud""")
def u4_audit_action(spark, sf_dir):
    return requests(spark, sf_dir).select("id", audit.action(F.col("path"), F.col("method"), F.col("status")).alias("action"))


@query(f"""WITH {AUD_SQL} SELECT id, CASE WHEN aborted THEN 'CLIENT_DISCONNECTED' WHEN exception THEN 'UNHANDLED_EXCEPTION' WHEN status = 401 THEN CASE WHEN has_token THEN 'INVALID_ACCESS_TOKEN' ELSE 'MISSING_ACCESS_TOKEN' END WHEN status = 403 THEN 'INSUFFICIENT_PERMISSION' WHEN status = 504 THEN 'RAG_STREAM_TIMEOUT' WHEN status >= 500 THEN 'RAG_SERVICE_FAILURE' WHEN status >= 400 THEN 'REQUEST_REJECTED' END AS failure_code,
CASE WHEN aborted THEN 499 WHEN exception THEN 500 ELSE status END AS final_status, NOT aborted AND NOT exception AND status BETWEEN 200 AND 399 AS succeeded FROM aud""")
def u5_failure_code(spark, sf_dir):
    """U5 and U6."""
    c = F.col
    status, ok = audit.final_status(c("status"), c("aborted"), c("exception"))
    return requests(spark, sf_dir).select("id", audit.failure_code(c("status"), F.lit(None).cast("string"), c("aborted"), c("exception"), c("has_token")).alias("failure_code"), status.cast("long").alias("final_status"), ok.alias("succeeded"))


@query("SELECT event_type AS policy, CAST(epoch(time_bucket(INTERVAL '3600 seconds', ts)) AS BIGINT) AS window_start, count(*) AS requests, greatest(0, count(*) - 2) AS over FROM events GROUP BY 1, 2")
def u7_window_counts(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumnRenamed("event_type", "policy")
    limits = e.select("policy").distinct().withColumn("permits", F.lit(2))
    return audit.over_limit(e, limits, 3600).withColumn("window_start", F.unix_timestamp("window_start"))


# Jobs: events of a user are the stages of a run.
@query("""WITH e AS (SELECT user_id AS run_id, event_id AS event_no, ['extract','clean','headings','tables','sections','chunks','ids'][event_id % 7 + 1] AS stage, event_type AS state FROM events),
l AS (SELECT run_id, stage, arg_max(state, event_no) AS state FROM e GROUP BY 1, 2), s AS (SELECT unnest(range(7)) AS stage_no, unnest(['extract','clean','headings','tables','sections','chunks','ids']) AS stage)
SELECT r.run_id, s.stage_no, s.stage, coalesce(l.state, 'pending') AS state FROM (SELECT DISTINCT run_id FROM e) r CROSS JOIN s LEFT JOIN l ON l.run_id = r.run_id AND l.stage = s.stage""")
def j1_stage_states(spark, sf_dir):
    stage = F.get(F.array(*map(F.lit, jobs.STAGES)), (F.col("event_id") % 7).cast("int"))
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("event_no"), stage.alias("stage"), F.col("event_type").alias("state"))
    return jobs.latest_states(e)


@query("SELECT event_id, 'embed' AS phase, event_id % 5 AS done, CAST(5 AS BIGINT) AS total FROM events")
def j2_progress_marker(spark, sf_dir):
    log = F.concat(F.lit("INFO [parse 1/2] x\nINFO [embed "), (F.col("event_id") % 5).cast("string"), F.lit("/5] done"))
    return table(spark, sf_dir, "events").select("event_id", jobs.last_marker(log).alias("m")).select("event_id", "m.phase", "m.done", "m.total")


JOB_SQL = "job AS (SELECT event_id AS id, event_type AS kind, 0e0 AS started_at, value AS finished_at FROM events)"


def job_table(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("kind"), F.lit(0.0).alias("started_at"), F.col("value").alias("finished_at"))


@query(f"""WITH {JOB_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY finished_at, id) AS r, count(*) OVER (PARTITION BY kind) AS n FROM job WHERE finished_at IS NOT NULL),
v AS (SELECT kind, list(finished_at ORDER BY finished_at, id) AS v FROM job WHERE finished_at IS NOT NULL GROUP BY 1), m AS (SELECT id, r.kind, v.v, r, (n - 2) // 2 + 1 AS lo, (n - 1) // 2 + 1 AS hi FROM r JOIN v USING (kind) WHERE n > 1)
SELECT id, kind, round((v[CASE WHEN lo >= r THEN lo + 1 ELSE lo END] + v[CASE WHEN hi >= r THEN hi + 1 ELSE hi END]) / 2, 6) AS median_seconds FROM m""")
def j3_median_durations(spark, sf_dir):
    return jobs.median_durations(job_table(spark, sf_dir)).withColumn("median_seconds", F.round("median_seconds", 6))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'parse,mineru,embed' ELSE 'retrieve,rerank,generate,judge' END AS phases, CASE WHEN event_id % 2 = 0 THEN CAST(event_id AS VARCHAR) END AS top_n, CASE WHEN event_id % 2 = 0 THEN 'a,b' ELSE '' END AS files FROM events")
def j6_command_options(spark, sf_dir):
    """J4 and J6."""
    e = F.col("event_id")
    command = F.when(e % 2 == 0, F.array(F.lit("ingest"), F.lit("--files"), F.lit("a"), F.lit("b"), F.lit("--supplement"), F.lit("--top-n"), e.cast("string"))).otherwise(F.array(F.lit("eval"), F.lit("golden")))
    return table(spark, sf_dir, "events").withColumn("command", command).select("event_id", F.array_join(jobs.phases(F.col("command")), ",").alias("phases"), jobs.option(F.col("command"), "--top-n").alias("top_n"), F.array_join(jobs.option_values(F.col("command"), "--files"), ",").alias("files"))


@query("SELECT event_id AS id, round((2 + event_id % 5 / 5e0) / 3, 6) AS fraction, round(60 * (1 - (2 + event_id % 5 / 5e0) / 3) / ((2 + event_id % 5 / 5e0) / 3), 6) AS eta_seconds FROM events")
def j5_progress(spark, sf_dir):
    j = job_table(spark, sf_dir)
    log = F.concat(F.lit("[mineru 1/4] [embed "), (F.col("id") % 5).cast("string"), F.lit("/5]"))
    running = j.withColumn("marker", jobs.last_marker(log)).withColumn("phases", F.array(*map(F.lit, ("parse", "mineru", "embed"))))
    return jobs.progress(running, jobs.median_durations(j), F.lit(60.0))


@query("SELECT event_id AS job_id, event_id % 50 + 3 AS produced, event_id % 50 AS embedded, event_id % 4 = 0 AS completed FROM events")
def j7_ingest_report(spark, sf_dir):
    n = (F.col("event_id") % 50).cast("string")
    log = F.concat(F.lit("Produced "), n, F.lit(" chunks\nProduced 3 chunks\nEmbedded "), n, F.lit(" chunks\n"), F.when(F.col("event_id") % 4 == 0, "Ingest complete").otherwise(""))
    return jobs.ingest_report(table(spark, sf_dir, "events").select(F.col("event_id").alias("job_id"), log.alias("log")))


@query("SELECT event_id AS job_id, p AS phase, CASE WHEN p = 'judge' THEN event_id % 9 ELSE 9 END AS done, CAST(9 AS BIGINT) AS total FROM events, (SELECT unnest(['retrieve', 'judge']) AS p)")
def j8_eval_report(spark, sf_dir):
    log = F.concat(F.lit("[retrieve 1/9] [retrieve 9/9] [judge "), (F.col("event_id") % 9).cast("string"), F.lit("/9]"))
    return jobs.phase_report(table(spark, sf_dir, "events").select(F.col("event_id").alias("job_id"), log.alias("log")))


# Curation: labelled documents are golden records whose question is their first words.
GOLD_SQL = r"""gold AS (SELECT l.doc_id AS seq, CASE l.doc_id % 5 WHEN 0 THEN 'How many ' WHEN 1 THEN 'What are ' WHEN 2 THEN 'How do ' ELSE '' END || array_to_string(list_slice(string_split(d.text, ' '), 1, 6), ' ') AS query,
 [CASE l.doc_id % 4 WHEN 0 THEN 'control' || lpad(CAST(l.doc_id % 20 + 1 AS VARCHAR), 2, '0') || '-safeguard1' WHEN 1 THEN 'control' || lpad(CAST(l.doc_id % 20 + 1 AS VARCHAR), 2, '0') || '-overview' WHEN 2 THEN 'glossary-1' ELSE 'x' || l.doc_id END] AS relevant_chunk_ids,
 l.quality = 1 AS verified, CASE WHEN l.toxic = 0 THEN d.source END AS provenance, d.text AS reference_answer FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""
SCOPE = "CASE WHEN contains(c, 'safeguard') THEN 'safeguard' WHEN contains(c, 'overview') THEN 'control overview' WHEN c LIKE 'glossary%' THEN 'glossary' WHEN c LIKE 'intro%' THEN 'introduction' ELSE 'other' END"
TYPE = "CASE WHEN regexp_matches(lower(query), '^(how many|how frequently|what is the minimum|what is the maximum)') THEN 'numeric / threshold' WHEN regexp_matches(lower(query), '^(what are|what two|what four)') THEN 'list' WHEN regexp_matches(lower(query), '^(how do|what characterizes|what data)') THEN 'explanation' ELSE 'fact' END"
CONTROL = "TRY_CAST(nullif(regexp_extract(c, 'control([0-9]{2})', 1), '') AS BIGINT)"


def golden(spark, sf_dir) -> DataFrame:
    d = F.col("doc_id")
    two = F.lpad((d % 20 + 1).cast("string"), 2, "0")
    ids = F.when(d % 4 == 0, F.concat(F.lit("control"), two, F.lit("-safeguard1"))).when(d % 4 == 1, F.concat(F.lit("control"), two, F.lit("-overview"))).when(d % 4 == 2, "glossary-1").otherwise(F.concat(F.lit("x"), d.cast("string")))
    lead = F.when(d % 5 == 0, "How many ").when(d % 5 == 1, "What are ").when(d % 5 == 2, "How do ").otherwise("")
    j = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), "doc_id")
    return j.select(d.alias("seq"), F.concat(lead, F.array_join(F.slice(F.split("text", " ", 7), 1, 6), " ")).alias("query"), F.array(ids).alias("relevant_chunk_ids"), (F.col("quality") == 1).alias("verified"), F.when(F.col("toxic") == 0, F.col("source")).alias("provenance"), F.col("text").alias("reference_answer"))


@query(f"WITH {GOLD_SQL}, c AS (SELECT *, relevant_chunk_ids[1] AS c FROM gold) SELECT seq, {SCOPE} AS scope, {CONTROL} AS control, {TYPE} AS answer_type FROM c")
def g4_record_classification(spark, sf_dir):
    first = F.get("relevant_chunk_ids", F.lit(0))
    return golden(spark, sf_dir).select("seq", cu.scope(first).alias("scope"), cu.control_number(first).alias("control"), cu.answer_type(F.col("query")).alias("answer_type"))


@query(rf"""WITH {GOLD_SQL}, c AS (SELECT *, relevant_chunk_ids[1] AS c FROM gold), k AS (SELECT *, {SCOPE} AS scope, {CONTROL} AS control, {TYPE} AS answer_type FROM c)
SELECT 'total' AS facet, 'records' AS value, count(*) AS n FROM k UNION ALL SELECT 'total', 'verified', count(*) FILTER (verified) FROM k UNION ALL SELECT 'total', 'duplicate_questions', count(*) - count(DISTINCT trim(regexp_replace(lower(query), '\s+', ' ', 'g'))) FROM k UNION ALL SELECT 'total', 'unique_relevant_ids', count(DISTINCT c) FROM k
UNION ALL SELECT 'scope', scope, count(*) FROM k GROUP BY 2 UNION ALL SELECT 'answer_type', answer_type, count(*) FROM k GROUP BY 2 UNION ALL SELECT 'control', CAST(control AS VARCHAR), count(*) FROM k WHERE control IS NOT NULL GROUP BY 2 UNION ALL SELECT 'provenance', coalesce(provenance, 'unknown'), count(*) FROM k GROUP BY 2
UNION ALL SELECT 'missing_control', CAST(i AS VARCHAR), 1 FROM range(1, 19) t(i) WHERE i NOT IN (SELECT control FROM k WHERE control IS NOT NULL)""")
def g5_dataset_audit(spark, sf_dir):
    return cu.audit(golden(spark, sf_dir))


@query(rf"""WITH {GOLD_SQL}, q AS (SELECT seq, query, seq / 400e0 AS top_score, seq % 3 <> 0 AS is_relevant, trim(regexp_replace(lower(query), '\s+', ' ', 'g')) AS k, len(string_split(trim(regexp_replace(query, '\s+', ' ', 'g')), ' ')) AS w FROM gold)
SELECT seq, CAST((CASE WHEN NOT is_relevant THEN 1 ELSE 0 END) + (CASE WHEN top_score < 0.5 THEN 1 ELSE 0 END) + (CASE WHEN k IN (SELECT k FROM q WHERE seq % 10 = 0) THEN 1 ELSE 0 END) + (CASE WHEN w NOT BETWEEN 6 AND 45 THEN 1 ELSE 0 END) + (CASE WHEN {' AND '.join(f"NOT contains(k, '{t}')" for t in cu.IMPORTANT)} THEN 1 ELSE 0 END) AS BIGINT) AS n_reasons FROM q""")
def g7_candidate_gate(spark, sf_dir):
    g = golden(spark, sf_dir)
    c = g.select("seq", F.col("query").alias("question"), (F.col("seq") / 400).alias("top_score"), (F.col("seq") % 3 != 0).alias("is_relevant"), F.lit("An answer").alias("answer"), F.get("relevant_chunk_ids", F.lit(0)).alias("chunk_id"))
    return cu.candidate_reasons(c, g.where("seq % 10 = 0")).select("seq", F.size("reasons").cast("long").alias("n_reasons"))


@query(rf"WITH {GOLD_SQL}, k AS (SELECT *, trim(regexp_replace(lower(query), '\s+', ' ', 'g')) AS k FROM gold) SELECT min(seq) AS seq FROM k WHERE seq % 3 <> 0 AND k NOT IN (SELECT k FROM k WHERE seq % 3 = 0) GROUP BY k")
def g9_append_new(spark, sf_dir):
    g = golden(spark, sf_dir)
    return cu.appended(g.where("seq % 3 = 0"), g.where("seq % 3 <> 0")).select("seq")


@query(rf"WITH {GOLD_SQL}, k AS (SELECT *, trim(regexp_replace(lower(query), '\s+', ' ', 'g')) AS k FROM gold) SELECT seq, true AS verified, 'human-reviewed-ui' AS provenance, CASE WHEN seq % 4 = 0 THEN 'edited ' || seq ELSE trim(reference_answer, ' ') END AS reference_answer, 'source ' || seq AS source_text FROM k WHERE seq IN (SELECT min(seq) FROM k WHERE seq % 3 = 1 AND seq % 2 = 0 AND k NOT IN (SELECT k FROM k WHERE seq % 3 = 0) GROUP BY k)")
def g10_promotion(spark, sf_dir):
    g = golden(spark, sf_dir)
    own = F.col("seq").cast("string")
    decisions = g.select("seq", F.when(F.col("seq") % 2 == 0, "approve").otherwise("reject").alias("decision"), F.when(F.col("seq") % 4 == 0, F.concat(F.lit(" edited "), own)).alias("reference_answer"), F.concat(F.lit("source "), own, F.lit(" ")).alias("source_text"))
    return cu.promoted(g.where("seq % 3 = 1"), decisions, g.where("seq % 3 = 0")).select("seq", "verified", "provenance", "reference_answer", "source_text")


@query(f"WITH {GOLD_SQL}, c AS (SELECT relevant_chunk_ids[1] AS c FROM gold), k AS (SELECT {CONTROL} AS control, count(*) AS n FROM c GROUP BY 1) SELECT i AS control, coalesce(n, 0) AS records, greatest(0, 12 - coalesce(n, 0)) AS remaining FROM range(1, 19) t(i) LEFT JOIN k ON k.control = i")
def g11_coverage(spark, sf_dir):
    return cu.coverage(golden(spark, sf_dir), 12)


@query(rf"WITH {CHUNKS_SQL}, c AS (SELECT doc_id * 1000 + chunk_index AS chunk_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS hay FROM chunks), s AS (SELECT item_id AS source_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS needle FROM benchmark) SELECT source_id, min(chunk_id) AS chunk_id FROM s JOIN c ON contains(hay, needle) GROUP BY 1")
def g1_source_alignment(spark, sf_dir):
    """The first step of G1: passages that a chunk has whole."""
    c = chunks(spark, sf_dir).select((F.col("doc_id") * 1000 + F.col("chunk_index")).alias("chunk_id"), "text")
    s = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("source_id"), "text")
    return alignment.contained(s, c)


@query()
def g3_dataset_alignment(spark, sf_dir):
    c = chunks(spark, sf_dir).select((F.col("doc_id") * 1000 + F.col("chunk_index")).alias("chunk_id"), "text")
    return alignment.aligned(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("source_id"), "text"), c)


_W = "list_distinct(regexp_extract_all(lower({}), '[a-z0-9]+(?:[.][0-9]+)?'))"


@query(f"WITH {GOLD_SQL}, w AS (SELECT seq, list_filter({_W.format('query')}, lambda t: t NOT IN ('a', 'an', 'and', 'are', 'as', 'at', 'be', 'by', 'for', 'from', 'in', 'is', 'it', 'of', 'on', 'or', 'that', 'the', 'this', 'to', 'under', 'with')) AS a, {_W.format('reference_answer')} AS b FROM gold) SELECT seq, CASE WHEN len(a) = 0 THEN 0 ELSE round(len(list_intersect(a, b)) / CAST(len(a) AS DOUBLE), 6) END AS overlap FROM w")
def g19_answer_overlap(spark, sf_dir):
    return golden(spark, sf_dir).select("seq", cu.overlap(F.col("query"), F.col("reference_answer")).alias("overlap"))
