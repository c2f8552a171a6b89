"""Incremental twins of the batch operators: capped acceptance, seen sets, running counts over file streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def running_cap(stream: DataFrame, key: str, order: str, cap: int = 2) -> DataFrame:
    """Rows of a stream until ``cap`` rows of their key have passed; the count of each key is state.

    Within a micro-batch rows pass in the order of ``order``.  A null key is a key.
    """
    schema = stream.schema

    def step(_key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        used = state.get[0] if state.exists else 0
        rows = None
        for f in frames:  # never more than one frame and the rows that may still pass
            rows = (f if rows is None else pd.concat([rows, f])).sort_values(order, kind="stable").head(max(0, cap - used))
        state.update((used + len(rows),))
        yield rows

    return stream.groupBy(key).applyInPandasWithState(step, schema, "used long", "append", GroupStateTimeout.NoTimeout)


def unseen(stream: DataFrame, keys: list[str], rejected: DataFrame | None = None, at: str | None = None, late: str = "7 days") -> DataFrame:
    """First row of each key over the whole stream, without keys of a table of rejected ones.

    The state grows with the distinct keys, for ever.  With an event time ``at`` a key is remembered for ``late`` only, which
    bounds the state, and rows that come later than that are left out.
    """
    s = stream.dropDuplicates(keys) if at is None else stream.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)
    return s if rejected is None else s.join(rejected.select(*keys), keys, "left_anti")


def accept_batches(stream: DataFrame, accepted: str, checkpoint: str, key: str, decide) -> None:
    """Micro-batches of new rows judged against the rows accepted so far: ``decide(new, accepted) -> DataFrame``.

    Every batch is appended once under its number, so that a batch repeated after a failure changes nothing; the run
    ends when the input available at its start is used up, and resumes from its checkpoint.
    """

    def each(batch: DataFrame, number: int) -> None:
        spark: SparkSession = batch.sparkSession
        fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(accepted)
        there = fs.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs)
        so_far = spark.read.parquet(accepted).where(F.col("batch") != number).drop("batch") if there else spark.createDataFrame([], batch.schema)
        new = batch.dropDuplicates([key]).join(so_far.select(key), key, "left_anti").select(*batch.columns)
        decide(new, so_far).write.mode("overwrite").parquet(f"{accepted}/batch={number}")

    stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def windowed_counts(stream: DataFrame, at: str, key: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, key, n): counts per window of event time; rows later than ``late`` are left out."""
    return stream.withWatermark(at, late).groupBy(F.window(at, width), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), key, "n")
