"""Golden-set curation: alignment, classification, audit, gates, coverage and import review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as fx
from .alignment import aligned

# Terms that make a question worth keeping, fields of a record.
IMPORTANT = ("must", "minimum", "maximum", "require", "why", "how", "what", "frequency", "control", "safeguard", "risk", "define")
REQUIRED = ("query", "relevant_chunk_ids", "reference_answer", "source_text", "verified", "provenance")
OVERLAP_STOP = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "under", "with")
CANDIDATE, PROMOTED = "ui-generated-candidate", "human-reviewed-ui"


def scope(chunk_id: Column) -> Column:
    c = F.coalesce(chunk_id, F.lit("unknown"))
    return (
        F.when(F.contains(c, F.lit("safeguard")), "safeguard").when(F.contains(c, F.lit("overview")), "control overview")
        .when(c.startswith("glossary"), "glossary").when(c.startswith("intro"), "introduction").otherwise("other")
    )


def control_number(chunk_id: Column) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(chunk_id, F.lit("")), r"control(\d{2})", 1), F.lit("")).cast("long")


def answer_type(question: Column) -> Column:
    q = F.lower(F.coalesce(question, F.lit("")))
    begins = lambda *xs: q.rlike("^(" + "|".join(xs) + ")")
    return (
        F.when(begins("how many", "how frequently", "what is the minimum", "what is the maximum"), "numeric / threshold")
        .when(begins("what are", "what two", "what four"), "list")
        .when(begins("how do", "what characterizes", "what data"), "explanation")
        .otherwise("fact")
    )


def audit(records: DataFrame) -> DataFrame:
    """(facet, value, n) of a golden set: totals, scopes, answer types, controls, provenance, and controls 1-18 that are missing."""
    first = F.get("relevant_chunk_ids", F.lit(0))
    r = records.select("*", scope(first).alias("scope"), control_number(first).alias("control"), answer_type(F.col("query")).alias("answer_type"), fx.question_key(F.col("query")).alias("_q"))
    totals = r.agg(F.count("*").alias("records"), F.count_if(F.coalesce("verified", F.lit(False))).alias("verified"), (F.count("*") - F.count_distinct("_q")).alias("duplicate_questions"))
    ids = r.select(F.explode("relevant_chunk_ids").alias("i")).agg(F.count_distinct("i").alias("n")).select(F.lit("total").alias("facet"), F.lit("unique_relevant_ids").alias("value"), "n")
    out = totals.select(F.explode(F.create_map(*[x for c in totals.columns for x in (F.lit(c), F.col(c))])).alias("value", "n")).select(F.lit("total").alias("facet"), "value", "n").unionByName(ids)
    for facet, c in (("scope", F.col("scope")), ("answer_type", F.col("answer_type")), ("control", F.col("control").cast("string")), ("provenance", F.coalesce("provenance", F.lit("unknown")))):
        out = out.unionByName(r.where(c.isNotNull()).groupBy(c.alias("value")).agg(F.count("*").alias("n")).select(F.lit(facet).alias("facet"), "value", "n"))
    every = records.sparkSession.range(1, 19).select(F.col("id").alias("control"))
    return out.unionByName(every.join(r.select("control").where("control is not null").distinct(), "control", "left_anti").select(F.lit("missing_control").alias("facet"), F.col("control").cast("string").alias("value"), F.lit(1).cast("long").alias("n")))


def candidate_reasons(candidates: DataFrame, existing: DataFrame, least: float = 0.50) -> DataFrame:
    """Adds ``reasons`` why a question is no candidate, and ``eligible``."""
    known = existing.select(fx.question_key(F.col("query")).alias("_q")).distinct().withColumn("_known", F.lit(True))
    c = candidates.withColumn("_q", fx.question_key(F.col("question"))).join(known, "_q", "left")
    words = fx.word_count(F.col("question"))
    answer = F.trim(F.coalesce("answer", F.lit("")))
    rules = (
        (~F.coalesce("is_relevant", F.lit(False)), "not grounded in the document"),
        (F.coalesce("top_score", F.lit(0.0)) < least, "retrieval confidence is below the golden-candidate threshold"),
        (F.coalesce("_known", F.lit(False)), "duplicate of an existing golden question"),
        (~words.between(6, 45), "question should contain 6-45 words"),
        ((answer == "") | answer.startswith("Question irrelevant"), "no usable grounded reference answer"),
        (F.coalesce("chunk_id", F.lit("")) == "", "top passage has no stable chunk ID"),
        (~fx.contains_any(F.col("_q"), IMPORTANT), "question does not look decision-relevant or conceptually important"),
    )
    made = c.withColumn("reasons", F.array_compact(F.array(*[F.when(bad, why) for bad, why in rules])))
    return made.withColumn("eligible", F.size("reasons") == 0).drop("_q", "_known")


def appended(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Records whose normalised question is not there yet; the first of equal new ones (by ``seq``)."""
    known = existing.select(fx.question_key(F.col("query")).alias("_q"))
    w = Window.partitionBy("_q").orderBy("seq")
    fresh = new.withColumn("_q", fx.question_key(F.col("query"))).withColumn("_n", F.row_number().over(w)).where("_n = 1").join(known, "_q", "left_anti")
    return fresh.drop("_q", "_n")


def promoted(candidates: DataFrame, decisions: DataFrame, existing: DataFrame) -> DataFrame:
    """Candidates that a reviewer has approved in the decision table (seq, decision) and that are new, as verified records. The table
    may have the reviewer's own ``reference_answer`` and ``source_text``; they replace the candidate's. Nothing is approved by itself."""
    edits = [x for x in ("reference_answer", "source_text") if x in decisions.columns]
    yes = decisions.where("decision = 'approve'").dropDuplicates(["seq"]).select("seq", *[F.col(x).alias(f"_{x}") for x in edits])
    made = candidates.join(yes, "seq")
    for x in ("reference_answer", "source_text"):
        text = F.coalesce(f"_{x}", x) if x in edits and x in candidates.columns else F.col(f"_{x}") if x in edits else F.col(x) if x in candidates.columns else F.lit("")
        made = made.withColumn(x, F.trim(F.coalesce(text, F.lit(""))))
    made = made.withColumn("verified", F.lit(True)).withColumn("provenance", F.lit(PROMOTED)).drop(*[f"_{x}" for x in edits])
    return appended(existing, made)


def coverage(records: DataFrame, target: int = 5) -> DataFrame:
    """(control, records, remaining) for controls 1 to 18."""
    have = records.groupBy(control_number(F.get("relevant_chunk_ids", F.lit(0))).alias("control")).agg(F.count("*").alias("n"))
    every = records.sparkSession.range(1, 19).select(F.col("id").alias("control"))
    n = F.coalesce("n", F.lit(0))
    return every.join(have, "control", "left").select("control", n.alias("records"), F.greatest(F.lit(0), F.lit(target) - n).alias("remaining"))


def overlap(answer: Column, source: Column) -> Column:
    """Share of the answer's words (without stop words) that the source has. A number such as 5.3 is one word."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"([a-z0-9]+(?:\.[0-9]+)?)"), F.lit(1)))
    a = F.array_except(words(answer), F.array(*map(F.lit, OVERLAP_STOP)))
    return F.when(F.size(a) > 0, F.round(F.size(F.array_intersect(a, words(source))) / F.size(a), 6)).otherwise(0.0)


def candidate_records(ranked: DataFrame, answers: DataFrame) -> DataFrame:
    """Golden candidates from each question's best passage, if it has an id; unverified, texts of question and answer trimmed."""
    top = ranked.where("rank = 1 and chunk_id is not null").join(answers.select("query_id", "answer"), "query_id")
    trimmed = lambda c: F.trim(F.coalesce(c, F.lit("")))
    return top.select(
        "query_id", trimmed("question").alias("query"), F.array("chunk_id").alias("relevant_chunk_ids"), trimmed("answer").alias("reference_answer"), F.coalesce("text", F.lit("")).alias("source_text"),
        F.lit(False).alias("verified"), F.lit(CANDIDATE).alias("provenance"),
    )


def normalised_records(records: DataFrame, chunks: DataFrame, least: float = 0.60) -> DataFrame:
    """Records ready for evaluation: those with known ids keep these in their order, others take the chunk their source aligns with;
    ``error`` says why a record cannot be used. Records are (row_key, query, reference_answer, source_text, relevant_chunk_ids)."""
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    given = records.select("row_key", F.posexplode("relevant_chunk_ids").alias("_at", "chunk_id"))
    known = given.join(chunks.select("chunk_id").distinct(), "chunk_id", "left_semi").groupBy("row_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "chunk_id"))), lambda x: x["chunk_id"]).alias("known"))
    rest = records.join(known, "row_key", "left_anti").where(~blank("source_text")).select(F.col("row_key").alias("source_id"), F.col("source_text").alias("text"))
    found = aligned(rest, chunks, least).where("chunk_id is not null").select(F.col("source_id").alias("row_key"), F.array("chunk_id").alias("found"))
    j = records.join(known, "row_key", "left").join(found, "row_key", "left")
    ids = F.coalesce("known", "found")
    error = F.when(blank("query"), "no question").when(blank("reference_answer"), "no answer").when(blank("source_text"), "no source").when(ids.isNull(), "no chunk")
    return j.withColumn("relevant_chunk_ids", ids).withColumn("error", error).drop("known", "found")
