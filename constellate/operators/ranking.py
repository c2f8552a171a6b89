"""Total ranks, pages and slices without a single-task window."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from constellate.session import materialize


def global_rank(df: DataFrame, order: list[Column], name: str = "rank", partitions: int | None = None) -> DataFrame:
    """``df`` with the rank of each row from 0 in ``order`` over everything.

    Rows are spread by ranges of the order and written once; the counts of the ranges, one row each, give every range its
    first rank; within a range rows are numbered by one sort.  ``order`` must tell all rows apart for a repeatable result.
    """
    spark = df.sparkSession
    n = partitions or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    spread = materialize(df.repartitionByRange(n, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    before, first = 0, []
    for r in sorted(spread.groupBy("__range").count().collect()):  # one row per range
        first.append((r[0], before))
        before += r[1]
    starts = spark.createDataFrame(first, "__range int, __first bigint")
    rank = F.row_number().over(Window.partitionBy("__range").orderBy(*order)) - 1 + F.col("__first")
    return spread.join(F.broadcast(starts), "__range").withColumn(name, rank.cast("bigint")).drop("__range", "__first")


def rank_within(df: DataFrame, group: str, order: list[Column], name: str = "rank") -> DataFrame:
    """``df`` with the rank from 0 of each row within its group, for few groups that may each be huge.

    One total rank by group and order, less the first rank of the group; no group has to fit one task.  Null is a group.
    """
    ranked = global_rank(df, [F.col(group).asc_nulls_first(), *order], "__rank")
    first = ranked.groupBy(F.col(group).alias("__group")).agg(F.min("__rank").alias("__first"))
    return ranked.join(first, F.col(group).eqNullSafe(F.col("__group"))).withColumn(name, F.col("__rank") - F.col("__first")).drop("__rank", "__first", "__group")


def paginate(df: DataFrame, order: list[Column], size: int = 250) -> DataFrame:
    """``df`` with ``rank`` (from 0) and ``page`` (from 0) of ``size`` rows."""
    return global_rank(df, order).withColumn("page", F.floor(F.col("rank") / size).cast("bigint"))


def page_numbers(pages: int, current: int, around: int = 2) -> list[int | None]:
    """Pages (from 0) that a page bar shows: the first, the last and those near ``current``; None for a gap."""
    shown = [i for i in range(pages) if i in (0, pages - 1) or abs(i - current) <= around]
    out: list[int | None] = []
    for i in shown:
        if out and i - out[-1] > 1:
            out.append(None)
        out.append(i)
    return out


def percent_slice(ranked: DataFrame, count: int, low: float, high: float, rank: str = "rank") -> DataFrame:
    """Rows ranked in the percent range; at least one where there is any."""
    start = math.floor(low / 100 * count + 0.5)
    end = min(count, max(start + 1, math.floor(high / 100 * count + 0.5)))
    return ranked.where((F.col(rank) >= start) & (F.col(rank) < end))


def value_at_share(df: DataFrame, column: str, share: float, ties: list[str]):
    """The value at index floor(share * n), n - 1 at most, of ``column`` in ascending order; None on an empty table."""
    ranked = global_rank(df.select(column, *ties), [F.col(column).asc(), *[F.col(t).asc() for t in ties]])
    n = df.count()
    if not n:
        return None
    return ranked.where(F.col("rank") == min(n - 1, math.floor(share * n))).first()[column]
