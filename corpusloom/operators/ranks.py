"""Order statistics of groups of any size: ranks from range partitions, no task for a whole group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.tables import fits, kept


def ranked(df: DataFrame, group: str, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """``df`` with ``_rank`` (from 1) in the order ``by`` within each group, and (group, _n) with the groups' sizes.

    The table is dealt out by ranges of (group, by), so a hot group lies in many partitions; a row's rank is its place in its
    partition plus the group's rows in the partitions before. Only the counts by group and partition are summed up.
    Null groups are a group; ``by`` should tell rows apart.
    """
    order = [F.col(group), *map(F.col, by)]
    dealt = kept(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "dealt")
    counts = dealt.groupBy(group, "_part").agg(F.count("*").alias("_c"))  # a row for each group and partition
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0))).drop("_c")
    sizes = counts.groupBy(group).agg(F.sum("_c").alias("_n"))
    starts = starts.withColumnRenamed(group, "_g").withColumnRenamed("_part", "_p")
    inside = dealt.withColumn("_at", F.row_number().over(Window.partitionBy("_part", group).orderBy(*by)))
    joined = inside.join(F.broadcast(starts) if fits(starts, 200_000) else starts, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_p")))
    return joined.withColumn("_rank", F.col("_before") + F.col("_at")).drop("_g", "_p", "_part", "_before", "_at"), sizes


def at_ranks(rows: DataFrame, sizes: DataFrame, group: str, value: str, wanted: Callable[[Column], list[Column]]) -> DataFrame:
    """(group, _n, _values): for each group a map from the ranks that ``wanted`` gives for its size to the values there."""
    want = sizes.select(F.col(group).alias("_g"), "_n", F.explode(F.array_distinct(F.array(*wanted(F.col("_n"))))).alias("_r")).where("_r between 1 and _n")
    want = F.broadcast(want) if fits(want, 500_000) else want
    hit = rows.join(want, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_rank") == F.col("_r")))
    found = hit.groupBy("_g", "_n").agg(F.map_from_entries(F.collect_list(F.struct("_r", value))).alias("_values"))
    return found.withColumnRenamed("_g", group)


def halves(n: Column) -> tuple[Column, Column]:
    """The two middle ranks of n (equal if n is odd)."""
    return F.floor((n + 1) / 2), F.floor(n / 2) + 1


def medians(df: DataFrame, group: str, value: str, tie: list[str]) -> DataFrame:
    """(group, median) as the mean of the middle one or two values; rows with a null value don't count."""
    rows, sizes = ranked(df.where(F.col(value).isNotNull()).select(group, value, *tie), group, [value, *tie])
    found = at_ranks(rows, sizes, group, value, lambda n: list(halves(n)))
    low, high = halves(F.col("_n"))
    return found.select(group, ((F.col("_values")[low] + F.col("_values")[high]) / 2).alias("median"))
