"""Cleanup and layout of page lines: (doc, page_number, line_no, text, font_size, x0, y0, is_horizontal)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from ..functions.text import let

TOP, BOTTOM = 70.0, 750.0


def horizontal(lines: DataFrame) -> DataFrame:
    return lines.where("is_horizontal")


def without_near_duplicates(lines: DataFrame, near: float = 1.5) -> DataFrame:
    """Of lines at nearly the same place of a page the longer text stays; lines are taken in order, each against
    those kept so far, and a line that is longer than a kept one takes its place at the end."""

    def step(kept: Column, x: Column) -> Column:
        rival = F.filter(kept, lambda k: (F.abs(k["x0"] - x["x0"]) < near) & (F.abs(k["y0"] - x["y0"]) < near))
        first = F.get(rival, F.lit(0))
        longer = F.length(x["text"]) > F.length(first["text"])
        return (
            F.when(F.size(rival) == 0, F.array_append(kept, x))
            .when(longer, F.array_append(F.filter(kept, lambda k: k["line_no"] != first["line_no"]), x))
            .otherwise(kept)
        )

    cols = ["line_no", *[c for c in lines.columns if c not in ("doc", "page_number", "line_no")]]
    page = lines.groupBy("doc", "page_number").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias("all"))
    kept = page.withColumn("kept", F.aggregate("all", F.slice("all", 1, 0), step))
    return kept.select("doc", "page_number", F.explode("kept").alias("l")).select("doc", "page_number", "l.*")


def columns_of(lines: DataFrame, gap: float = 50.0) -> DataFrame:
    """Adds ``column_no``: distinct rounded x0 of a page more than ``gap`` apart start a new column."""
    xs = lines.select("doc", "page_number", F.bround("x0").alias("x")).distinct()
    w = Window.partitionBy("doc", "page_number").orderBy("x")
    starts = xs.withColumn("new", F.coalesce((F.col("x") - F.lag("x").over(w) > gap).cast("int"), F.lit(0)))
    numbered = starts.withColumn("cluster", F.sum("new").over(w))
    left = numbered.groupBy("doc", "page_number", "cluster").agg(F.min("x").alias("x")).groupBy("doc", "page_number").agg(F.array_sort(F.collect_list("x")).alias("lefts"))
    at = F.size(F.filter("lefts", lambda v: v <= F.col("x0"))) - 1
    # A line left of the first rounded bound belongs to no column by bounds and is taken for the last one.
    return lines.join(left, ["doc", "page_number"]).withColumn("n_columns", F.size("lefts")).withColumn("column_no", F.when(at < 0, F.size("lefts") - 1).otherwise(at)).drop("lefts")


def row_alignment(lines: DataFrame, within: float = 4.0) -> DataFrame:
    """(doc, page_number, n_lines, n_aligned): lines that have a later line of another column at about their height."""
    a, b = lines.alias("a"), lines.alias("b")
    later = b.select(F.col("doc"), F.col("page_number"), F.col("line_no").alias("l2"), F.col("y0").alias("y2"), F.col("column_no").alias("c2"))
    hit = a.join(later, ["doc", "page_number"]).where((F.col("l2") > F.col("line_no")) & (F.col("c2") != F.col("column_no")) & (F.abs(F.col("y0") - F.col("y2")) < within))
    aligned = hit.select("doc", "page_number", "line_no").distinct().groupBy("doc", "page_number").agg(F.count("*").alias("n_aligned"))
    return lines.groupBy("doc", "page_number").agg(F.count("*").alias("n_lines")).join(aligned, ["doc", "page_number"], "left").fillna(0, ["n_aligned"])


def reading_order(lines: DataFrame, share: float = 0.20, within: float = 4.0) -> DataFrame:
    """Adds ``position`` in the page: by height; by rows then x0 where rows align; else column by column."""
    with_columns = columns_of(lines)
    mode = row_alignment(with_columns).select("doc", "page_number", (F.col("n_aligned") > F.col("n_lines") * share).alias("by_rows"))
    joined = with_columns.join(mode, ["doc", "page_number"])
    # Rows: the topmost line not yet taken opens one, and takes all lines within reach.
    ys = joined.groupBy("doc", "page_number").agg(F.array_sort(F.collect_list("y0")).alias("ys"))
    bands = F.aggregate("ys", F.array().cast("array<double>"), lambda acc, y: F.when((F.size(acc) == 0) | (y - F.try_element_at(acc, F.lit(-1)) >= within), F.array_append(acc, y)).otherwise(acc))
    row = joined.join(ys.select("doc", "page_number", bands.alias("bands")), ["doc", "page_number"]).withColumn("band", F.size(F.filter("bands", lambda v: v <= F.col("y0"))))
    many = F.col("n_columns") > 1
    first = F.when(many & F.col("by_rows"), F.col("band").cast("double")).when(many, F.col("column_no").cast("double")).otherwise(F.col("y0"))
    second = F.when(many & F.col("by_rows"), F.col("x0")).when(many, F.col("y0")).otherwise(F.lit(0.0))
    w = Window.partitionBy("doc", "page_number").orderBy(first, second, "line_no")
    return row.withColumn("position", F.row_number().over(w) - 1).select(*lines.columns, "position")


def join_bare_numbers(lines: DataFrame) -> DataFrame:
    """A line that is only a clause number takes the next line of its page into it. In a run of such lines every second
    one is taken by the one before it."""
    w = Window.partitionBy("doc", "page_number").orderBy("line_no")
    bare = F.col("text").rlike(r"^\d{1,2}\.\d{1,2}$")
    marked = lines.withColumn("bare", bare).withColumn("broken", F.sum(F.when(F.col("bare"), 0).otherwise(1)).over(w)).withColumn("next_text", F.lead("text").over(w)).withColumn("next_size", F.lead("font_size").over(w))
    run = Window.partitionBy("doc", "page_number", "broken").orderBy("line_no")
    # The line that opens a run (not bare) has number 0 except where the page starts with bare lines.
    nth = marked.withColumn("nth", F.row_number().over(run) - F.when(F.col("broken") > 0, 1).otherwise(0))
    takes = nth.withColumn("takes", F.col("bare") & (F.col("nth") % 2 == 1) & F.col("next_text").isNotNull())
    kept = takes.withColumn("taken", F.coalesce(F.lag("takes").over(w), F.lit(False))).where(~F.col("taken"))
    return kept.withColumn("text", F.when(F.col("takes"), F.concat_ws(" ", "text", "next_text")).otherwise(F.col("text"))).withColumn("font_size", F.when(F.col("takes"), F.col("next_size")).otherwise(F.col("font_size"))).select(*lines.columns)


def boilerplate_key(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"[0-9]+", "#")))


def in_margin() -> Column:
    return (F.col("y0") < TOP) | (F.col("y0") > BOTTOM)


def boilerplate(lines: DataFrame, at_least: int = 4, share: float = 0.20) -> DataFrame:
    """(doc, key, pages): margin lines on at least max(at_least, int(pages * share)) pages of their document."""
    pages = lines.groupBy("doc").agg(F.count_distinct("page_number").alias("n_pages"))
    keys = lines.where(in_margin()).withColumn("key", boilerplate_key(F.col("text"))).where("key <> ''").groupBy("doc", "key").agg(F.count_distinct("page_number").alias("pages"))
    return keys.join(pages, "doc").where(F.col("pages") >= F.greatest(F.lit(at_least), F.floor(F.col("n_pages") * share))).select("doc", "key", "pages")


def without_boilerplate(lines: DataFrame, found: DataFrame) -> DataFrame:
    keyed = lines.withColumn("key", F.when(in_margin(), boilerplate_key(F.col("text"))))
    return keyed.join(found.select("doc", "key"), ["doc", "key"], "left_anti").drop("key").select(*lines.columns)


def low_text_pages(lines: DataFrame, least: int = 30) -> DataFrame:
    """Pages with too few characters; ``has_image`` of any line tells whether the page may be scanned."""
    return lines.groupBy("doc", "page_number").agg(F.sum(F.length("text")).alias("chars"), F.bool_or("has_image").alias("has_image")).where(F.col("has_image") & (F.col("chars") < least)).select("doc", "page_number", "chars")


def _runs(rows: DataFrame, keys: list[str], values: tuple[str, ...]) -> DataFrame:
    """Neighbouring rows of equal keys as one, with a list of each of ``values``; rows of a key may be in several."""
    made = StructType([rows.schema[k] for k in keys] + [StructField(v, ArrayType(rows.schema[v].dataType)) for v in values])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            cols = {n: b.column(b.schema.get_field_index(n)) for n in (*keys, *values)}
            new = np.ones(b.num_rows, bool)
            new[1:] = ~np.logical_and.reduce([pc.fill_null(pc.equal(cols[k].slice(1), cols[k].slice(0, b.num_rows - 1)), False).to_numpy(zero_copy_only=False) for k in keys])
            at = np.flatnonzero(new)
            ends = pa.array(np.append(at, b.num_rows), pa.int32())
            yield pa.RecordBatch.from_arrays([*(cols[k].take(pa.array(at)) for k in keys), *(pa.ListArray.from_arrays(ends, cols[v]) for v in values)], [*keys, *values])

    return rows.mapInArrow(run, made)


def assemble_spans(spans: DataFrame) -> DataFrame:
    """(doc, page_number, line_no, text, font_size, is_bold) of spans (span_no, text, font_size, is_bold): texts end to
    end, the size with most characters (the first of equals), bold if any span with text is."""
    keys = ["doc", "page_number", "line_no"]
    real = spans.where(F.trim("text") != "").select(*keys, "span_no", "text", "font_size", "is_bold")

    def size(every: Column) -> Column:
        """The spans are sorted by size; each run of one size is summed."""
        at = F.filter(F.sequence(F.lit(0), F.size(every) - 1), lambda i: (i == 0) | ~F.get(every, i - 1)["s"].eqNullSafe(F.get(every, i)["s"]))
        mass = lambda i, n: F.aggregate(F.slice(every, i + 1, n), F.lit(0).cast("long"), lambda m, x: m + x["n"])
        run = lambda ats: F.transform(ats, lambda i, j: F.struct(mass(i, F.coalesce(F.get(ats, j + 1), F.size(every)) - i).alias("m"), (-F.get(every, i)["span_no"]).alias("f"), F.get(every, i)["s"].alias("s")))
        return F.array_max(let(at, run))["s"]

    # all of a line is made from one list, so that spans are shuffled once, as lists of those that stand together
    values = ("span_no", "text", "font_size", "is_bold")
    lists = _runs(real, keys, values).repartition(*keys).groupBy(*keys).agg(F.collect_list(F.struct(*values)).alias("all"))
    lists = lists.select(*keys, *[F.flatten(f"all.{v}").alias(v) for v in values])
    lists = lists.select(*keys, F.sort_array(F.arrays_zip("span_no", "text", "font_size")).alias("all"), F.array_max("is_bold").alias("is_bold"))
    text = F.trim(F.array_join(F.transform("all", lambda s: s["text"]), "")).alias("text")
    sizes = F.sort_array(F.transform("all", lambda x: F.struct(x["font_size"].alias("s"), x["span_no"].alias("span_no"), F.length(x["text"]).alias("n"))))
    return lists.select(*keys, text, "is_bold", let(sizes, size).alias("font_size"))


def without_overlaps(spans: DataFrame, share: float = 0.70) -> DataFrame:
    """Of spans of a line whose boxes overlap by more than ``share`` of the smaller, the longer text stays. Spans are taken in
    order, each against those kept so far. Only spans that are joined by overlaps in x can meet, so a line falls into runs of
    such spans: a span alone in its run stays as it is, and the work grows with the spans and not with the square of a line."""

    def step(kept: Column, s: Column) -> Column:
        def clash(v: Column) -> Column:
            x = F.least(s["x1"], v["x1"]) - F.greatest(s["x0"], v["x0"])
            y = F.least(s["y1"], v["y1"]) - F.greatest(s["y0"], v["y0"])
            area = F.least((s["x1"] - s["x0"]) * (s["y1"] - s["y0"]), (v["x1"] - v["x0"]) * (v["y1"] - v["y0"]))
            return (x > 0) & (y > 0) & (area > 0) & (x * y / area > share)

        rival = F.get(F.filter(kept, clash), F.lit(0))
        longer = F.length(F.trim(s["text"])) > F.length(F.trim(rival["text"]))
        return F.when(rival.isNull(), F.array_append(kept, s)).when(longer, F.array_append(F.filter(kept, lambda v: v["span_no"] != rival["span_no"]), s)).otherwise(kept)

    keys = ["doc", "page_number", "line_no"]
    cols = ["span_no", *[c for c in spans.columns if c not in (*keys, "span_no")]]
    w = Window.partitionBy(*keys).orderBy("_left", "span_no")
    # a box without a right edge, or without a number on the left, may meet any other
    odd = F.isnan("x0")
    left = F.when(odd, F.lit(float("-inf"))).otherwise(F.col("x0"))
    flat = (F.col("y1") <= F.col("y0")) & ~F.isnan("y0")  # meets none
    right = F.when(flat, F.lit(float("-inf"))).when(odd, F.lit(float("inf"))).otherwise(F.coalesce("x1", F.lit(float("inf"))))
    # Spans are shuffled once, as lists of those that stand together; the windows, the runs and both ways below find them dealt by line.
    lists = _runs(spans.where(F.trim("text") != "").select(*keys, *cols), keys, tuple(cols)).repartition(*keys)
    dealt = lists.select(*keys, F.inline(F.arrays_zip(*cols)))
    placed = dealt.withColumn("_left", left).withColumn("_far", F.max(right).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    opens = placed.withColumn("_new", F.coalesce(F.col("_left") >= F.col("_far"), F.col("_far").isNull()))
    runs = opens.withColumn("_alone", F.col("_new") & F.lead("_new", 1, True).over(w)).withColumn("_run", F.sum(F.col("_new").cast("long")).over(w))
    met = runs.where("not _alone").groupBy(*keys, "_run").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias("all"))
    left_over = met.select(*keys, F.explode(F.aggregate("all", F.slice("all", 1, 0), step)).alias("s")).select(*keys, "s.*")
    return runs.where("_alone").select(*keys, *cols).unionByName(left_over)
