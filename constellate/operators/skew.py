"""Per-key results when a few keys hold most rows.

``eager_join_rollup`` never sends raw rows of a key to one task: both inputs of a join are first aggregated by join key
(and grouping columns), the compact states are joined, counts are multiplied and sums combined algebraically, and only
then are the states rolled up, again with map-side partial aggregation.  ``hot_split_join`` joins a skewed input to a
unique-keyed one, broadcasting only the entries of keys that the pigeonhole bound proves to be few.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _taken(df: DataFrame, *names: str) -> None:
    clash = [n for n in names if n in df.columns]
    if clash:
        raise ValueError(f"column names reserved for the result: {clash}")


def eager_join_rollup(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    group_by: Sequence[str],
    left_sums: Sequence[str] = (),
    right_sums: Sequence[str] = (),
) -> DataFrame:
    """``left JOIN right USING (on) GROUP BY group_by``, aggregated before the join.

    ``group_by`` are columns of ``right``.  Result: the grouping columns, ``n_keys`` (distinct join keys of the group),
    ``n_rows`` (rows the plain join would have) and ``sum_<c>`` for each measure.  Because the left state is unique by
    key and the right state by (key, group), ``n_keys`` is a plain count of joined states, ``n_rows`` the sum of
    products of both counts, and a sum of one side is multiplied by the count of the other.

    Nulls: a null in ``on`` joins nothing (SQL equality); a null group forms its own group; null measures are ignored.
    Repeated rows count in ``n_rows`` but not in ``n_keys``.  Empty inputs give an empty result.  Further columns of
    either side, also of equal names, are ignored.
    """
    on, group_by = list(on), list(group_by)
    ls = (
        left.select(*on, *[F.col(c).alias(f"__l_{c}") for c in left_sums])
        .where(_all_set(on))
        .groupBy(*on)
        .agg(F.count(F.lit(1)).alias("__ln"), *[F.sum(f"__l_{c}").alias(f"__l_{c}") for c in left_sums])
    )
    groups = [F.col(c).alias(f"__g_{i}") for i, c in enumerate(group_by)]
    rs = (
        right.select(*on, *groups, *[F.col(c).alias(f"__r_{c}") for c in right_sums])
        .where(_all_set(on))
        .groupBy(*on, *[f"__g_{i}" for i in range(len(group_by))])
        .agg(F.count(F.lit(1)).alias("__rn"), *[F.sum(f"__r_{c}").alias(f"__r_{c}") for c in right_sums])
    )
    return (
        rs.join(ls, on)
        .groupBy(*[F.col(f"__g_{i}").alias(c) for i, c in enumerate(group_by)])
        .agg(
            F.count(F.lit(1)).alias("n_keys"),
            F.sum(F.col("__ln") * F.col("__rn")).alias("n_rows"),
            *[F.sum(F.col(f"__l_{c}") * F.col("__rn")).alias(f"sum_{c}") for c in left_sums],
            *[F.sum(F.col(f"__r_{c}") * F.col("__ln")).alias(f"sum_{c}") for c in right_sums],
        )
    )


def _all_set(cols: Sequence[str]) -> Column:
    out = F.lit(True)
    for c in cols:
        out = out & F.col(c).isNotNull()
    return out


def hot_split_join(
    facts: DataFrame, entries: DataFrame, key: str, weight: str, total: int, hot_keys: int = 2000
) -> DataFrame:
    """Inner join of ``facts`` (any key skew) to ``entries`` (one row per key; ``weight`` = facts rows of that key).

    A key is hot when it holds more than ``total / hot_keys`` of the ``total`` fact rows, so there are fewer than
    ``hot_keys`` hot keys whatever the data: their entries are broadcast, and their rows never move.  All other keys
    hold at most ``total / hot_keys`` rows each and are joined by shuffle.  Null keys join nothing.
    """
    cut = total / hot_keys
    hot = F.broadcast(entries.where(F.col(weight) > cut))
    cold = entries.where(F.col(weight) <= cut)
    hot_keys_only = F.broadcast(entries.where(F.col(weight) > cut).select(key))
    return facts.join(hot, key).unionByName(facts.join(hot_keys_only, key, "left_anti").join(cold, key))


def salted_counts(df: DataFrame, keys: Sequence[str], salts: int = 16) -> DataFrame:
    """Rows per key in two steps, by (key, salt) and then by key.

    Spark's partial aggregation already bounds what one task receives per key; the explicit salt serves inputs whose
    rows arrive unordered in very many tasks, where the final step of a hot key would merge one state from each.
    Null keys form a group; an empty input gives none.
    """
    _taken(df, "__salt", "n")
    return (
        df.select(*keys)
        .withColumn("__salt", F.spark_partition_id() % salts)
        .groupBy(*keys, "__salt")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy(*keys)
        .agg(F.sum("n").alias("n"))
    )


# ---- on the tables of this project ---------------------------------------------------------------------------------


def playlists_per_artist(playlists: DataFrame) -> DataFrame:
    """(artist_id, n_playlists, n_credits): distinct playlist ids of every credited artist, and credits over all rows."""
    per_row = playlists.select(
        "id",
        F.explode(F.array_distinct(F.filter(F.col("tracks.artist_id"), lambda a: a.isNotNull() & (a != "")))).alias("artist_id"),
    )
    out = eager_join_rollup(playlists.select("id"), per_row, ["id"], ["artist_id"])
    return out.select("artist_id", F.col("n_keys").alias("n_playlists"))


def frequent_artists(playlists: DataFrame, one_in: int = 20) -> DataFrame:
    """(artist_id) of artists in at least one of ``one_in`` distinct playlist ids, ids without tracks included.

    A playlist row with a null id is no playlist and counts nowhere; on an empty table the result is empty.
    """
    total = playlists.select("id").where(F.col("id").isNotNull()).distinct().agg(F.count(F.lit(1)).alias("n"))
    return playlists_per_artist(playlists).where(F.col("n_playlists") * one_in >= total.scalar()).select("artist_id")
