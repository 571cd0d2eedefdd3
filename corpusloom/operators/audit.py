"""Audit records: sanitising, classification, paging and window counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Paths that are audited.
PREFIXES = ("/api/rag", "/api/admin/audit-logs")
EXACT = "/api/auth/me"


def sanitised(c: Column, cap: int) -> Column:
    """Without control characters, trimmed, at most ``cap`` characters; blank is null."""
    return F.nullif(F.left(F.trim(F.regexp_replace(c, r"\p{Cc}", "")), F.lit(cap)), F.lit(""))


def under(path: Column, prefix: str) -> Column:
    """Whether the path is the prefix or goes on after it with a whole segment, in any case."""
    p = F.lower(path)
    return (p == prefix) | p.startswith(prefix + "/")


def is_auditable(path: Column) -> Column:
    found = F.lower(path) == EXACT
    for p in PREFIXES:
        found = found | under(path, p)
    return found


def action(path: Column, method: Column, status: Column) -> Column:
    p, failed = F.lower(path), status >= 400
    auth = F.when(status == 401, "AUTH_UNAUTHORIZED").when(status == 403, "AUTH_FORBIDDEN")
    ok = lambda name, bad="RAG_REQUEST_FAILED": F.when(failed, bad).otherwise(name)
    return (
        F.when(under(path, PREFIXES[1]), "ADMIN_AUDIT_LOG_VIEW")
        .when(p == EXACT, F.coalesce(auth, F.lit("AUTH_PROFILE_VIEW")))
        .when(status.isin(401, 403), auth)
        .when(p.endswith("/general/stream") | p.endswith("/document/stream"), ok("RAG_QUERY", "RAG_QUERY_FAILED"))
        .when(p.endswith("/documents/upload"), ok("RAG_DOCUMENT_UPLOAD"))
        .when(F.upper(method) == "DELETE", ok("RAG_HISTORY_DELETE"))
        .when(F.contains(p, F.lit("/feedback/")), ok("RAG_FEEDBACK_SAVE"))
        .when(F.contains(p, F.lit("{sessionid}")), ok("RAG_HISTORY_GET"))
        .when(p.endswith("/history/sessions"), ok("RAG_HISTORY_LIST"))
        .otherwise("RAG_REQUEST_FAILED")
    )


def failure_code(status: Column, specified: Column, aborted: Column, exception: Column, has_token: Column) -> Column:
    return F.coalesce(
        specified,
        F.when(aborted, "CLIENT_DISCONNECTED")
        .when(exception, "UNHANDLED_EXCEPTION")
        .when(status == 401, F.when(has_token, "INVALID_ACCESS_TOKEN").otherwise("MISSING_ACCESS_TOKEN"))
        .when(status == 403, "INSUFFICIENT_PERMISSION")
        .when(status == 504, "RAG_STREAM_TIMEOUT")
        .when(status >= 500, "RAG_SERVICE_FAILURE")
        .when(status >= 400, "REQUEST_REJECTED"),
    )


def final_status(status: Column, aborted: Column, exception: Column) -> tuple[Column, Column]:
    """(status, succeeded): 499 on an abort, 500 on another exception; 200 to 399 without exception succeed."""
    code = F.when(aborted, 499).when(exception, 500).otherwise(status)
    return code, ~aborted & ~exception & status.between(200, 399)


def page(audit: DataFrame, filters: dict, since=None, until=None, number: int = 1, size: int = 50) -> DataFrame:
    """One page of the records with these values in this time, newest first; ``size`` is held in 1..100. Adds ``total``."""
    size, out = min(100, max(1, size)), audit
    for k, v in filters.items():
        if v is not None:
            out = out.where(F.col(k) == v)
    if since is not None:
        out = out.where(F.col("ts") >= since)
    if until is not None:
        out = out.where(F.col("ts") <= until)
    total = out.agg(F.count("*").alias("total"))
    return out.orderBy(F.desc("ts"), F.desc("id")).offset((max(1, number) - 1) * size).limit(size).crossJoin(F.broadcast(total))  # one row


def over_limit(requests: DataFrame, limits: DataFrame, seconds: int = 60) -> DataFrame:
    """(policy, window_start, requests, over): requests of a policy in each fixed window and those above its limit."""
    counted = requests.groupBy(F.window("ts", f"{seconds} seconds").alias("w"), "policy").agg(F.count("*").alias("requests"))
    return counted.join(F.broadcast(limits), "policy").select("policy", F.col("w.start").alias("window_start"), "requests", F.greatest(F.lit(0), F.col("requests") - F.col("permits")).alias("over"))
