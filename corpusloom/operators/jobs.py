"""Job runs, their logs and stage events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..sources.tables import fits, kept
from . import ranks

STAGES = ("extract", "clean", "headings", "tables", "sections", "chunks", "ids")


def latest_states(events: DataFrame, stages: tuple[str, ...] = STAGES) -> DataFrame:
    """(run_id, stage_no, stage, state) for every run and stage; pending where no event has come."""
    last = events.groupBy("run_id", "stage").agg(F.max_by("state", "event_no").alias("state"))
    plan = events.select("run_id").distinct().select("run_id", F.posexplode(F.array(*map(F.lit, stages))).alias("stage_no", "stage"))
    return plan.join(last, ["run_id", "stage"], "left").select("run_id", F.col("stage_no").cast("long").alias("stage_no"), "stage", F.coalesce("state", F.lit("pending")).alias("state"))


def last_marker(log: Column, phase: str | None = None) -> Column:
    """Struct (phase, done, total) of the last [phase n/m] in a log; null if there is none."""
    name = phase or r"\w+"
    pattern = rf"\[{name} \d+/\d+\]"
    last = F.try_element_at(F.regexp_extract_all(log, F.lit(f"({pattern})"), F.lit(1)), F.lit(-1))
    part = lambda i: F.regexp_extract(last, r"\[(\w+) (\d+)/(\d+)\]", i)
    return F.when(last.isNotNull(), F.struct(part(1).alias("phase"), part(2).cast("long").alias("done"), part(3).cast("long").alias("total")))


def median_durations(jobs: DataFrame) -> DataFrame:
    """(id, kind, median_seconds): the median of the other finished runs of the kind; kinds with one run have none.

    Without the run of rank r, ranks above it move down by one, so at most four ranks of a kind matter to all its
    runs; they are found by distributed ranks and joined with the runs.
    """
    d = jobs.where("finished_at is not null and started_at is not null").select("id", "kind", (F.col("finished_at") - F.col("started_at")).alias("d"))
    rows, sizes = ranks.ranked(d, "kind", ["d", "id"])
    rows = kept(rows, "ranked")

    def middle(n: Column) -> list[Column]:
        low, high = ranks.halves(n - 1)
        return [low, low + 1, high, high + 1]

    found = ranks.at_ranks(rows, sizes.where("_n > 1"), "kind", "d", middle).withColumnRenamed("kind", "_kind")
    joined = rows.join(F.broadcast(found) if fits(found, 100_000) else found, F.col("kind").eqNullSafe(F.col("_kind")))
    value = lambda k: F.col("_values")[F.when(k >= F.col("_rank"), k + 1).otherwise(k)]
    low, high = ranks.halves(F.col("_n") - 1)
    return joined.select("id", "kind", ((value(low) + value(high)) / 2).alias("median_seconds"))


def progress(jobs: DataFrame, medians: DataFrame, now: Column) -> DataFrame:
    """(id, fraction, eta_seconds): by the last marker and the phases done before it; without one, by the usual duration, at most 0.95."""
    m = F.col("marker")
    known = F.array_position("phases", m["phase"]) - 1
    by_marker = F.when(m.isNotNull() & (m["total"] > 0) & (known >= 0), (known + m["done"] / m["total"]) / F.size("phases"))
    elapsed = now - F.col("started_at")
    j = jobs.join(medians.select("id", "median_seconds"), "id", "left")
    by_time = F.when(F.col("median_seconds") > 0, F.least(F.lit(0.95), elapsed / F.col("median_seconds")))
    fraction = F.coalesce(by_marker, by_time)
    return j.select("id", F.round(fraction, 6).alias("fraction"), F.round(F.when(fraction > 0, elapsed * (1 - fraction) / fraction), 6).alias("eta_seconds"))


def option(command: Column, name: str) -> Column:
    """The word after an option; null if it is missing or last."""
    at = F.array_position(command, name)
    return F.when(at > 0, F.get(command, at.cast("int")))


def option_values(command: Column, name: str) -> Column:
    """The words after an option up to the next one."""
    at = F.array_position(command, name)
    rest = F.when((at > 0) & (at < F.size(command)), F.slice(command, (at + 1).cast("int"), F.size(command))).otherwise(F.array().cast("array<string>"))
    stop = F.array_position(F.transform(rest, lambda w: w.startswith("--")), True)
    return F.when(stop > 0, F.slice(rest, 1, (stop - 1).cast("int"))).otherwise(rest)


def phases(command: Column) -> Column:
    """The phases that a command's options lead to."""
    has = lambda o: F.array_contains(command, o)
    supplement = F.when(has("--supplement"), F.array(F.lit("mineru"))).otherwise(F.array().cast("array<string>"))
    return F.when(has("ingest"), F.concat(F.array(F.lit("parse")), supplement, F.array(F.lit("embed")))).when(has("eval"), F.array(*map(F.lit, ("retrieve", "rerank", "generate", "judge")))).otherwise(F.array(F.lit("run")))


def ingest_report(logs: DataFrame) -> DataFrame:
    """(job_id, produced, embedded, completed) from log lines "Produced n chunks" and "Embedded n chunks"."""
    total = lambda p: F.aggregate(F.transform(F.regexp_extract_all("log", F.lit(p), F.lit(1)), lambda x: x.cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    return logs.select("job_id", total(r"Produced (\d+) chunks").alias("produced"), total(r"Embedded (\d+) chunks").alias("embedded"), F.contains("log", F.lit("Ingest complete")).alias("completed"))


def phase_report(logs: DataFrame, names: tuple[str, ...] = ("retrieve", "rerank", "generate", "judge")) -> DataFrame:
    """(job_id, phase, done, total) of every phase that a log mentions."""
    rows = logs.select("job_id", F.explode(F.array(*[F.struct(F.lit(n).alias("phase"), last_marker(F.col("log"), n).alias("m")) for n in names])).alias("p"))
    return rows.where("p.m is not null").select("job_id", "p.phase", "p.m.done", "p.m.total")


def listing(jobs: DataFrame, skipped: tuple[str, ...] = ("cache", "eval")) -> DataFrame:
    """Job records, newest first, without files of other kinds."""
    return jobs.where(~F.coalesce("kind", F.lit("")).isin(*skipped)).orderBy(F.desc("created_at"), "id")
