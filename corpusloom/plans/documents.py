"""Queries over ``documents``: page lines, structure, chunks and corpus statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import text as fx
from ..operators import chunking, corpus, lines as ln
from .registry import query, table

#: Twenty lines make a page. Positions and sizes are functions of the line's number and length, so SQL can repeat them.
LINES_SQL = """
lines AS (
  SELECT doc, line_no // 20 + 1 AS page_number, line_no, text, 40e0 + (line_no % 20) * 38 AS y0,
         CASE WHEN line_no % 4 = 3 THEN 320e0 ELSE 72e0 END AS x0,
         CASE WHEN length(text) <= 30 THEN 18e0 WHEN length(text) <= 60 THEN 14e0 ELSE 10e0 END AS font_size
  FROM (SELECT doc_id AS doc, unnest(string_split(text, chr(10))) AS text, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM documents WHERE text IS NOT NULL))
"""
MARGIN = "(y0 < 70 OR y0 > 750)"
KEY = "lower(trim(regexp_replace(text, '[0-9]+', '#', 'g')))"


def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text is not null")
    rows = docs.select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n", -1)).alias("line_no", "text"))
    n = F.col("line_no")
    return rows.select(
        "doc",
        (F.floor(n / 20) + 1).cast("long").alias("page_number"),
        n.cast("long").alias("line_no"),
        "text",
        (F.lit(40.0) + (n % 20) * 38).alias("y0"),
        F.when(n % 4 == 3, 320.0).otherwise(72.0).alias("x0"),
        F.when(F.length("text") <= 30, 18.0).when(F.length("text") <= 60, 14.0).otherwise(10.0).alias("font_size"),
    )


@query(f"WITH {LINES_SQL}, pages AS (SELECT doc, count(DISTINCT page_number) AS n FROM lines GROUP BY doc) SELECT l.doc, {KEY} AS key, count(DISTINCT page_number) AS pages FROM lines l JOIN pages p ON l.doc = p.doc WHERE {MARGIN} AND {KEY} <> '' GROUP BY l.doc, {KEY}, p.n HAVING count(DISTINCT page_number) >= greatest(2, floor(p.n * 0.2))")
def l9_boilerplate_detection(spark, sf_dir):
    return ln.boilerplate(page_lines(spark, sf_dir), at_least=2)


@query(f"""WITH {LINES_SQL}, pages AS (SELECT doc, count(DISTINCT page_number) AS n FROM lines GROUP BY doc),
bad AS (SELECT l.doc, {KEY} AS key FROM lines l JOIN pages p ON l.doc = p.doc WHERE {MARGIN} AND {KEY} <> '' GROUP BY l.doc, {KEY}, p.n HAVING count(DISTINCT page_number) >= greatest(2, floor(p.n * 0.2)))
SELECT doc, line_no, text FROM lines WHERE NOT ({MARGIN} AND (doc, {KEY}) IN (SELECT doc, key FROM bad))""")
def l10_boilerplate_removal(spark, sf_dir):
    lines = page_lines(spark, sf_dir)
    return ln.without_boilerplate(lines, ln.boilerplate(lines, at_least=2)).select("doc", "line_no", "text")


@query(f"WITH {LINES_SQL} SELECT doc, page_number, CAST(sum(length(text)) AS BIGINT) AS chars FROM lines GROUP BY 1, 2 HAVING sum(length(text)) < 30 AND page_number % 2 = 1")
def l11_low_text_pages(spark, sf_dir):
    return ln.low_text_pages(page_lines(spark, sf_dir).withColumn("has_image", F.col("page_number") % 2 == 1))


@query(f"WITH {LINES_SQL} SELECT doc, line_no, text FROM lines WHERE length(text) % 7 <> 0")
def l4_horizontal_lines(spark, sf_dir):
    return ln.horizontal(page_lines(spark, sf_dir).withColumn("is_horizontal", F.length("text") % 7 != 0)).select("doc", "line_no", "text")


@query(f"WITH {LINES_SQL}, n AS (SELECT doc, page_number, bool_or(x0 = 72) AND bool_or(x0 = 320) AS two FROM lines GROUP BY 1, 2) SELECT l.doc, line_no, CAST(CASE WHEN two AND x0 = 320 THEN 1 ELSE 0 END AS BIGINT) AS column_no FROM lines l JOIN n ON l.doc = n.doc AND l.page_number = n.page_number")
def l5_column_clusters(spark, sf_dir):
    return ln.columns_of(page_lines(spark, sf_dir)).select("doc", "line_no", F.col("column_no").cast("long").alias("column_no"))


# Two columns whose rows align in pairs, so that the test of L6 and the row order of L7 have work to do.
def _aligned(spark, sf_dir):
    return page_lines(spark, sf_dir).withColumn("y0", F.lit(40.0) + F.floor((F.col("line_no") % 20) / 4) * 100 + F.when(F.col("line_no") % 4 >= 2, 2.0).otherwise((F.col("line_no") % 4) * 50.0))


ALIGNED_SQL = "al AS (SELECT * REPLACE (40.0 + floor((line_no % 20) / 4.0) * 100 + CASE WHEN line_no % 4 >= 2 THEN 2.0 ELSE (line_no % 4) * 50.0 END AS y0) FROM lines)"


@query(f"WITH {LINES_SQL}, {ALIGNED_SQL} SELECT a.doc, a.page_number, count(DISTINCT a.line_no) AS n_lines, count(DISTINCT CASE WHEN b.line_no IS NOT NULL THEN a.line_no END) AS n_aligned FROM al a LEFT JOIN al b ON a.doc = b.doc AND a.page_number = b.page_number AND b.line_no > a.line_no AND b.x0 <> a.x0 AND abs(a.y0 - b.y0) < 4 GROUP BY 1, 2")
def l6_row_alignment(spark, sf_dir):
    return ln.row_alignment(ln.columns_of(_aligned(spark, sf_dir)))


@query(f"""WITH {LINES_SQL}, {ALIGNED_SQL},
mode AS (SELECT a.doc, a.page_number, count(DISTINCT CASE WHEN b.line_no IS NOT NULL THEN a.line_no END) > count(DISTINCT a.line_no) * 0.2 AS by_rows, count(DISTINCT a.x0) > 1 AS many FROM al a LEFT JOIN al b ON a.doc = b.doc AND a.page_number = b.page_number AND b.line_no > a.line_no AND b.x0 <> a.x0 AND abs(a.y0 - b.y0) < 4 GROUP BY 1, 2)
SELECT l.doc, l.line_no, row_number() OVER (PARTITION BY l.doc, l.page_number ORDER BY CASE WHEN many AND by_rows THEN CASE WHEN (l.y0 - 40) % 100 <= 2 THEN floor((l.y0 - 40) / 100) * 100 ELSE l.y0 END WHEN many THEN l.x0 ELSE l.y0 END, CASE WHEN many AND by_rows THEN l.x0 WHEN many THEN l.y0 ELSE 0 END, l.line_no) - 1 AS position
FROM al l JOIN mode m ON l.doc = m.doc AND l.page_number = m.page_number""")
def l7_reading_order(spark, sf_dir):
    return ln.reading_order(_aligned(spark, sf_dir)).select("doc", "line_no", F.col("position").cast("long").alias("position"))


_BARE = "CASE WHEN length(text) % 3 = 0 THEN CAST(line_no % 20 AS VARCHAR) || '.' || CAST(length(text) % 50 AS VARCHAR) ELSE text END"


@query(f"""WITH {LINES_SQL}, b AS (SELECT doc, page_number, line_no, {_BARE} AS text FROM lines),
m AS (SELECT *, regexp_full_match(text, '[0-9]{{1,2}}[.][0-9]{{1,2}}') AS bare, lead(text) OVER w AS next_text FROM b WINDOW w AS (PARTITION BY doc, page_number ORDER BY line_no)),
g AS (SELECT *, sum(CASE WHEN bare THEN 0 ELSE 1 END) OVER (PARTITION BY doc, page_number ORDER BY line_no) AS g FROM m),
r AS (SELECT *, row_number() OVER (PARTITION BY doc, page_number, g, bare ORDER BY line_no) AS k FROM g),
t AS (SELECT *, bare AND k % 2 = 1 AND next_text IS NOT NULL AS takes FROM r),
u AS (SELECT *, coalesce(lag(takes) OVER (PARTITION BY doc, page_number ORDER BY line_no), false) AS taken FROM t)
SELECT doc, line_no, CASE WHEN takes THEN text || ' ' || next_text ELSE text END AS text FROM u WHERE NOT taken""")
def l8_bare_clause_numbers(spark, sf_dir):
    bare = F.concat_ws(".", (F.col("line_no") % 20).cast("string"), (F.length("text") % 50).cast("string"))
    lines = page_lines(spark, sf_dir).withColumn("text", F.when(F.length("text") % 3 == 0, bare).otherwise(F.col("text")))
    return ln.join_bare_numbers(lines).select("doc", "line_no", "text")


@query(f"WITH {LINES_SQL}, c AS (SELECT doc, round_even(font_size, 0) AS s, count(*) AS n, min(line_no) AS f FROM lines GROUP BY 1, 2) SELECT doc, arg_max(s, n * 1000000 - f) AS body_size FROM c GROUP BY doc")
def c1_body_size(spark, sf_dir):
    return chunking.body_size(page_lines(spark, sf_dir))


_TIERS = f"""{LINES_SQL}, c AS (SELECT doc, round_even(font_size, 0) AS s, count(*) AS n, min(line_no) AS f FROM lines GROUP BY 1, 2),
body AS (SELECT doc, arg_max(s, n * 1000000 - f) AS body_size FROM c GROUP BY doc),
tiers AS (SELECT l.doc, font_size, CAST(row_number() OVER (PARTITION BY l.doc ORDER BY font_size DESC) AS BIGINT) AS level FROM lines l JOIN body b ON l.doc = b.doc WHERE font_size >= body_size * 1.15 GROUP BY l.doc, font_size HAVING sum(length(text)) >= 15)"""


@query(f"WITH {_TIERS} SELECT doc, font_size, level FROM tiers")
def c2_heading_tiers(spark, sf_dir):
    lines = page_lines(spark, sf_dir)
    return chunking.heading_tiers(lines, chunking.body_size(lines))


_LEVELS = f"""{_TIERS}, levels AS (SELECT l.doc, l.page_number, l.line_no, l.text, (SELECT min(level) FROM tiers t WHERE t.doc = l.doc AND abs(t.font_size - l.font_size) < 0.5 AND length(l.text) <= 120 AND regexp_matches(l.text, '[A-Za-z]')) AS level FROM lines l)"""


@query(f"WITH {_LEVELS} SELECT doc, line_no, level FROM levels")
def c3_heading_levels(spark, sf_dir):
    return chunking.heading_levels(page_lines(spark, sf_dir)).select("doc", "line_no", "level")


@query(f"""WITH {_LEVELS}, w AS (SELECT *, level IS NOT NULL AS head, lag(level) OVER (PARTITION BY doc ORDER BY line_no) AS before FROM levels),
g AS (SELECT *, sum(CASE WHEN head AND before IS NOT DISTINCT FROM level THEN 0 ELSE 1 END) OVER (PARTITION BY doc ORDER BY line_no) AS g FROM w)
SELECT doc, min(line_no) AS line_no, min(level) AS level, trim(string_agg(text, ' ' ORDER BY line_no)) AS text FROM g WHERE head GROUP BY doc, g""")
def c4_merged_headings(spark, sf_dir):
    return chunking.merged_headings(chunking.heading_levels(page_lines(spark, sf_dir)))


@query(f"""WITH {_LEVELS}, w AS (SELECT *, level IS NOT NULL AS head, lag(level) OVER (PARTITION BY doc ORDER BY line_no) AS before FROM levels),
g AS (SELECT *, sum(CASE WHEN head AND before IS NOT DISTINCT FROM level THEN 0 ELSE 1 END) OVER (PARTITION BY doc ORDER BY line_no) AS g FROM w),
h AS (SELECT doc, g, min(line_no) AS line_no, min(level) AS level, trim(string_agg(text, ' ' ORDER BY line_no)) AS text FROM g WHERE head GROUP BY doc, g),
s AS (SELECT l.doc, l.page_number, l.line_no, l.text, (SELECT max(h.line_no) FROM h WHERE h.doc = l.doc AND h.line_no < l.line_no) AS under FROM levels l WHERE level IS NULL),
parts AS (SELECT doc, under, min(page_number) AS page_start, max(page_number) AS page_end, string_agg(text, chr(10) ORDER BY line_no) AS body FROM s GROUP BY doc, under)
SELECT b.doc, page_start, page_end,
  coalesce((SELECT string_agg(h.text, ' > ' ORDER BY h.line_no) FROM h WHERE h.doc = b.doc AND h.line_no <= b.under AND NOT EXISTS (SELECT 1 FROM h k WHERE k.doc = h.doc AND k.line_no > h.line_no AND k.line_no <= b.under AND k.level <= h.level)), '') AS breadcrumb,
  length(body) AS n_chars
FROM parts b WHERE trim(body, ' ' || chr(10) || chr(9)) <> ''""")
def c5_sections(spark, sf_dir):
    s = chunking.sections(chunking.heading_levels(page_lines(spark, sf_dir)))
    return s.select("doc", "page_start", "page_end", F.array_join("breadcrumb", " > ").alias("breadcrumb"), F.length("body").cast("long").alias("n_chars"))


@query("SELECT doc_id, CAST(greatest(1, floor(length(coalesce(text, '')) / 4.0)) AS BIGINT) AS token_count FROM documents")
def c9_token_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", fx.token_estimate(F.col("text")).alias("token_count"))


@query("""SELECT doc_id, CAST(i // 1360 AS BIGINT) AS window_no, substr(text, i + 1, 1600) AS piece FROM
(SELECT doc_id, text, unnest(CASE WHEN length(text) <= 1600 THEN [0] ELSE range(0, length(text), 1360) END) AS i FROM documents WHERE text IS NOT NULL)""")
def c10_sliding_windows(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text is not null")
    starts = docs.select("doc_id", "text", F.posexplode(fx.window_starts(F.col("text"), 1600, 240)).alias("window_no", "start"))
    return starts.select("doc_id", F.col("window_no").cast("long").alias("window_no"), F.substring("text", F.col("start") + 1, F.lit(1600)).alias("piece"))


SENTENCES = r"string_split(regexp_replace(text, '([.!?])\s+([A-Z(])', '\1' || chr(1) || '\2', 'g'), chr(1))"


@query(f"SELECT doc_id, unnest(range(len({SENTENCES}))) AS sentence_no, unnest({SENTENCES}) AS sentence FROM documents WHERE text IS NOT NULL")
def c11_sentence_split(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text is not null")
    return docs.select("doc_id", F.posexplode(fx.sentences(F.col("text"))).alias("sentence_no", "sentence")).withColumn("sentence_no", F.col("sentence_no").cast("long"))


@query()
def c12_greedy_packing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text is not null")
    made = chunking.packed(docs.select("doc_id", "text"), ["doc_id"])
    return made.select("doc_id", F.col("piece").cast("int").alias("piece_no"), F.col("text").alias("piece"))


CHUNKS_SQL = "chunks AS (SELECT doc_id, CAST(i // 1360 AS BIGINT) AS chunk_index, substr(text, i + 1, 1600) AS text FROM (SELECT doc_id, text, unnest(CASE WHEN length(text) <= 1600 THEN [0] ELSE range(0, length(text), 1360) END) AS i FROM documents WHERE text IS NOT NULL))"
TOKENS = "CAST(greatest(1, floor(length(text) / 4.0)) AS BIGINT)"


def chunks(spark, sf_dir) -> DataFrame:
    """Chunks of the documents: (doc_id, chunk_index, text), ids by S11."""
    return c10_sliding_windows(spark, sf_dir).select("doc_id", F.col("window_no").alias("chunk_index"), F.col("piece").alias("text"))


@query(f"WITH {CHUNKS_SQL} SELECT doc_id, chunk_index, doc_id || '-' || lpad(CAST(chunk_index AS VARCHAR), 5, '0') AS chunk_id FROM chunks")
def s11_chunk_ids(spark, sf_dir):
    return corpus.with_chunk_ids(chunks(spark, sf_dir)).select("doc_id", "chunk_index", "chunk_id")


@query(f"WITH {CHUNKS_SQL} SELECT count(*) AS chunks, CAST(sum({TOKENS}) AS BIGINT) AS tokens, min({TOKENS}) AS min_tokens, max({TOKENS}) AS max_tokens, count(DISTINCT doc_id) AS documents FROM chunks")
def k1_chunk_statistics(spark, sf_dir):
    c = corpus.with_chunk_ids(chunks(spark, sf_dir))
    return corpus.statistics(c.withColumn("token_count", fx.token_estimate(F.col("text"))))


@query("SELECT doc_id, sha256(coalesce(text, '')) AS sha256, CAST(strlen(coalesce(text, '')) AS BIGINT) AS bytes FROM documents")
def k2_content_hashes(spark, sf_dir):
    return corpus.content_hashes(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("""WITH a AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 10 <> 0), b AS (SELECT doc_id, sha256(CASE WHEN doc_id % 7 = 0 THEN text || '.' ELSE text END) AS h FROM documents WHERE doc_id % 11 <> 0)
SELECT coalesce(a.doc_id, b.doc_id) AS id, CASE WHEN b.doc_id IS NULL THEN 'missing' WHEN a.doc_id IS NULL THEN 'added' WHEN a.h <> b.h THEN 'changed' ELSE 'same' END AS state FROM a FULL JOIN b ON a.doc_id = b.doc_id""")
def k3_manifest_drift(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    frozen = docs.where("doc_id % 10 <> 0")
    now = docs.where("doc_id % 11 <> 0").withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text")))
    return corpus.drift(corpus.content_hashes(frozen, "doc_id", "text"), corpus.content_hashes(now, "doc_id", "text"), "doc_id")


@query(f"""WITH {CHUNKS_SQL}, t AS (SELECT lang, {TOKENS.replace('text', 'c.text')} AS n FROM chunks c JOIN documents d ON c.doc_id = d.doc_id)
SELECT lang, count(*) AS chunks, CAST(sum(n) AS BIGINT) AS tokens, round(avg(n), 6) AS avg_tokens, median(n) AS median_tokens, list_sort(list(n))[CAST(floor((count(*) - 1) * 0.95) AS BIGINT) + 1] AS p95_tokens, count(*) FILTER (n < 40) AS below_min, count(*) FILTER (n > 400) AS above_max FROM t GROUP BY lang""")
def k4_output_manifest(spark, sf_dir):
    lang = table(spark, sf_dir, "documents").select("doc_id", "lang")
    c = chunks(spark, sf_dir).join(lang, "doc_id").withColumn("token_count", fx.token_estimate(F.col("text")))
    return corpus.output_manifest(c, ["lang"], 40, 400)


@query("SELECT source, list_sort(list(length(text)))[CAST(floor((count(*) - 1) * 0.9) AS BIGINT) + 1] AS p90_chars FROM documents WHERE text IS NOT NULL GROUP BY source")
def k5_lower_percentile(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text is not null").withColumn("n", F.length("text").cast("long"))
    return corpus.lower_percentiles(docs, ["source"], "n", 0.9).withColumnRenamed("value", "p90_chars")


@query(f"WITH {CHUNKS_SQL} SELECT doc_id, count(*) AS chunks, CAST(sum({TOKENS}) AS BIGINT) AS tokens, CAST(sum(length(text)) AS BIGINT) AS characters FROM chunks GROUP BY doc_id")
def k6_saved_chunk_summary(spark, sf_dir):
    return corpus.per_artifact(chunks(spark, sf_dir).withColumn("token_count", fx.token_estimate(F.col("text"))), "doc_id")


@query(f"WITH {CHUNKS_SQL} SELECT doc_id, chunk_index FROM chunks WHERE contains(lower(text), 'the re') AND chunk_index BETWEEN 0 AND 2")
def k7_chunk_filter(spark, sf_dir):
    c = chunks(spark, sf_dir).withColumn("page_start", F.col("chunk_index")).withColumn("page_end", F.col("chunk_index"))
    return corpus.filter_chunks(c, pages=(0, 2), search="The Re", fields=["text"]).select("doc_id", "chunk_index")


@query(f"""WITH {CHUNKS_SQL}, n AS (SELECT doc_id, chunk_index, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM chunks)
SELECT doc_id, chunk_index, 'p. ' || (chunk_index + 1) AS page_label, CASE WHEN length(t) <= 180 THEN t ELSE rtrim(left(t, 177)) || '...' END AS preview FROM n""")
def k8_review_rows(spark, sf_dir):
    c = chunks(spark, sf_dir).withColumn("page_start", F.col("chunk_index") + 1).withColumn("page_end", F.col("chunk_index") + 1)
    return corpus.review_rows(c).select("doc_id", "chunk_index", "page_label", "preview")


@query(f"""WITH {CHUNKS_SQL}, t AS (SELECT {TOKENS} AS n FROM chunks), f AS (SELECT min(n) AS lo, max(n) AS hi, least(36, greatest(8, CAST(floor(sqrt(count(*))) AS BIGINT) * 2)) AS bins FROM t)
SELECT CAST(CASE WHEN n = hi THEN bins ELSE floor((n - lo) * bins / CAST(hi - lo AS DOUBLE)) + 1 END AS BIGINT) AS bin, count(*) AS chunks FROM t, f GROUP BY 1""")
def k9_token_histogram(spark, sf_dir):
    return corpus.histogram(chunks(spark, sf_dir).select(fx.token_estimate(F.col("text")).alias("n")), "n")


@query(f"WITH {LINES_SQL}, p AS (SELECT doc, page_number, count(*) AS n, sum(length(text)) AS c FROM lines GROUP BY 1, 2) SELECT doc, count(*) AS pages, CAST(sum(n) AS BIGINT) AS lines, CAST(sum(c) AS BIGINT) AS characters, count(*) FILTER (c < 30) AS low_text_pages FROM p GROUP BY doc")
def k10_extraction_summary(spark, sf_dir):
    return corpus.extraction_summary(page_lines(spark, sf_dir))


@query(f"""WITH {LINES_SQL}, k AS (SELECT {KEY} AS key, doc, page_number FROM lines WHERE {MARGIN} AND {KEY} <> '')
SELECT key, count(*) AS lines, count(DISTINCT doc) AS documents FROM k GROUP BY key ORDER BY lines DESC, key LIMIT 12""")
def k11_boilerplate_examples(spark, sf_dir):
    return corpus.margin_examples(page_lines(spark, sf_dir), 12)
