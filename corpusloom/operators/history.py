"""Chat sessions, messages and feedback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as fx

# The reasons a user can give.
REASONS = ("accurate", "helpful", "clear", "incorrect", "incomplete", "unclear", "off_topic", "other")


def sessions_of(sessions: DataFrame, user: str, mode: str) -> DataFrame:
    """A user's sessions of a mode (a missing mode is a document session), the last changed first."""
    return sessions.where((F.col("user_id") == user) & (F.coalesce("mode", F.lit("document")) == mode)).orderBy(F.desc("updated_at"), "id")


def owned_messages(messages: DataFrame, sessions: DataFrame, user: str) -> DataFrame:
    own = sessions.where(F.col("user_id") == user).select(F.col("id").alias("session_id"))
    return messages.join(own, "session_id", "left_semi")


def with_feedback(messages: DataFrame, feedback: DataFrame) -> DataFrame:
    """Every message with the feedback on it, if any."""
    return messages.join(feedback, ["session_id", "message_id"], "left")


def next_versions(replies: DataFrame, answers: DataFrame) -> DataFrame:
    """(reply_to, next_version): one above the highest version so far, 1 at first."""
    top = answers.groupBy("reply_to").agg(F.max("version").alias("v"))
    return replies.join(top, "reply_to", "left").select("reply_to", (F.coalesce("v", F.lit(0)) + 1).alias("next_version"))


def without_sessions(rows: DataFrame, deleted: DataFrame) -> DataFrame:
    """Rows of sessions, messages or feedback that a deletion of sessions leaves."""
    return rows.join(deleted.select("session_id"), "session_id", "left_anti")


def upserted_feedback(feedback: DataFrame, messages: DataFrame) -> DataFrame:
    """The newest feedback on each assistant message by each user; created_at is that of the first."""
    real = feedback.join(messages.where("role = 'assistant'").select("session_id", "message_id"), ["session_id", "message_id"], "left_semi")
    w = Window.partitionBy("user_id", "message_id")
    newest = F.row_number().over(w.orderBy(F.desc("updated_at"), F.desc("feedback_id")))
    return real.withColumn("_n", newest).withColumn("created_at", F.min("updated_at").over(w)).where("_n = 1").drop("_n")


def reasons(chips: Column) -> tuple[Column, Column]:
    """(distinct reasons in order, those that are not known)."""
    once = F.array_distinct(chips)
    return once, F.array_except(once, F.array(*map(F.lit, REASONS)))


def contexts(messages: DataFrame, n: int) -> DataFrame:
    """Adds ``context``: the up to n messages before each one, oldest first."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-n, -1)
    return messages.withColumn("context", F.collect_list(F.concat_ws(": ", "role", "text")).over(w))


def answer_counts(messages: DataFrame, every: int) -> DataFrame:
    """User turns with ``answers``: two on every ``every``-th question of a conversation, else one."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    return messages.where("role = 'user'").withColumn("answers", F.when(F.row_number().over(w) % every == 0, 2).otherwise(1).cast("long"))


def web_sources(pages: DataFrame, limit: int = 420) -> DataFrame:
    """(source_id, url, text) of http and https pages."""
    ok = pages.where(F.col("url").rlike("(?i)^https?://"))
    return ok.select(F.left(F.sha2(F.col("url").cast("binary"), 256), F.lit(24)).alias("source_id"), "url", F.left(fx.normalise(F.col("text")), F.lit(limit)).alias("text"))


def numbered_sources(sources: DataFrame, by: str, order: list[str]) -> DataFrame:
    """``source_no`` goes on across the result batches of a conversation."""
    return sources.withColumn("source_no", F.row_number().over(Window.partitionBy(by).orderBy(*order)).cast("long"))


def markdown(messages: DataFrame) -> DataFrame:
    """(conv_id, document): one markdown document per conversation."""
    head = F.when(F.col("role") == "user", "## Question").otherwise("## Answer")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("turn", F.concat_ws("\n\n", head, F.col("text")).alias("t")))), lambda s: s["t"])
    return messages.groupBy("conv_id").agg(F.array_join(parts, "\n\n").alias("document"))
