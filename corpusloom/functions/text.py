"""Column expressions shared by the operators; all of them stay inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# Words and patterns of the query rules.
CLAUSE = r"(\d+(?:\.\d+)+)"
CLAUSE_BOUNDED = r"\b\d+(?:\.\d+)+\b"
COMPARISON_WORDS = r"(?i)\b(compare|comparison|contrast|difference|different|versus|vs\.?|across|relationship|combined|multiple|summarize|synthesi[sz]e)\b"
COMPLEX_MARKERS = (
    "compare", "contrast", "analyze", "evaluate", "synthesize", "comprehensive", "in detail", "step by step",
    "across all", "advantages and disadvantages", "pros and cons", "report",
)
WEB_MARKERS = (
    "latest", "current", "currently", "today", "tonight", "tomorrow", "yesterday", "recent", "recently", "news", "price", "weather",
    "forecast", "score", "schedule", "search the web", "search online", "look up", "verify online", "browse", "http://", "https://",
)
TOPIC_STOP_WORDS = ("a", "an", "and", "are", "be", "can", "do", "does", "for", "how", "is", "of", "the", "to", "what", "when", "where", "why")
TOPIC_SUFFIXES = ("ing", "ed", "es", "s")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also where ``body`` uses it inside a lambda."""
    return F.transform(F.array(value), body)[0]


def normalise(c: Column) -> Column:
    """One space for each run of white space, none at either end; null counts as empty."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


def question_key(c: Column) -> Column:
    return normalise(F.lower(c))


def clause_references(c: Column) -> Column:
    """Distinct numbers such as 5.3 in order of first appearance."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(CLAUSE), F.lit(1)))


def bounded_clauses(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(f"({CLAUSE_BOUNDED})"), F.lit(1))))


def asks_comparison(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike(COMPARISON_WORDS)


def contains_any(c: Column, markers: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for m in markers:
        found = found | F.contains(F.lower(c), F.lit(m))
    return F.coalesce(found, F.lit(False))


def word_count(c: Column) -> Column:
    n = normalise(c)
    return F.when(n == "", F.lit(0)).otherwise(F.size(F.split(n, " ")))


def is_complex(c: Column, max_words: int = 24) -> Column:
    """Long, more than one question mark, or a marker of synthesis."""
    return (word_count(c) > max_words) | (F.length(F.coalesce(c, F.lit(""))) - F.length(F.replace(F.coalesce(c, F.lit("")), F.lit("?"), F.lit(""))) > 1) | contains_any(c, COMPLEX_MARKERS)


def topic_tokens(c: Column) -> Column:
    """Sorted distinct alphanumeric tokens of three letters or more without stop words; one ending cut off."""
    tokens = F.regexp_extract_all(question_key(c), F.lit("([a-z0-9]+)"), F.lit(1))
    kept = F.filter(tokens, lambda t: (F.length(t) >= 3) & ~t.isin(*TOPIC_STOP_WORDS))

    def stem(t: Column) -> Column:
        out = F.when(F.lit(False), t)
        for s in TOPIC_SUFFIXES:
            out = out.when(t.endswith(s) & (F.length(t) > len(s) + 3), F.left(t, F.length(t) - len(s)))
        return out.otherwise(t)

    return F.array_sort(F.array_distinct(F.transform(kept, stem)))


def shortened(c: Column, limit: int) -> Column:
    """White space normalised; over the limit, cut so that three dots fit, with no space before them."""
    n = normalise(c)
    return F.when(F.length(n) <= limit, n).otherwise(F.concat(F.rtrim(F.left(n, F.lit(limit - 3))), F.lit("...")))


def session_title(c: Column) -> Column:
    """Over 80 characters, the first 79 (right-trimmed) and three dots: at most 82."""
    n = normalise(c)
    return F.when(F.length(n) <= 80, n).otherwise(F.concat(F.rtrim(F.left(n, F.lit(79))), F.lit("...")))


def token_estimate(c: Column) -> Column:
    """A quarter of the characters, at least 1."""
    return F.greatest(F.lit(1), F.floor(F.length(F.coalesce(c, F.lit(""))) / 4)).cast("long")


def window_starts(c: Column, size: int, overlap: int) -> Column:
    """Array of the places (from 0) at which the windows of a text begin. It needs the text's length alone."""
    return F.when(F.length(c) <= size, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.length(c) - 1, F.lit(max(1, size - overlap))))


def char_windows(c: Column, size: int, overlap: int) -> Column:
    """Array of windows; one window if the text fits. A tail inside the overlap still appears."""
    step = max(1, size - overlap)
    cut = F.transform(F.sequence(F.lit(0), F.length(c) - 1, F.lit(step)), lambda i: F.substring(c, i + 1, F.lit(size)))
    return F.when(F.length(c) <= size, F.array(c)).otherwise(cut)


def sentences(c: Column) -> Column:
    return F.split(c, r"(?<=[.!?])\s+(?=[A-Z(])")


def uuid5(name: Column, namespace_hex: str) -> Column:
    """Name-based UUID (version 5) of a string."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), F.encode(name, "UTF-8")))
    variant = F.substring(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)), 1, 1)
    return F.lower(F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12)))


def lower_percentile(values: Column, p: float) -> Column:
    """Element ``int((n - 1) * p)`` of the sorted values."""
    s = F.array_sort(values)
    return F.get(s, F.floor((F.size(values) - 1) * F.lit(p)).cast("int"))
