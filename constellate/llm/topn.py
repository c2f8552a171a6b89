"""The N best items of every group, by descending score bands."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from constellate.session import materialize


def latest_rows(df: DataFrame, keys: Sequence[str], at: str, ties: Sequence[Column]) -> DataFrame:
    """Of each key the row with the greatest ``at`` (nulls last); equal times are settled by ``ties``, ascending.

    One partially aggregated ``max_by``-like pass over a struct, so that many exports of one key merge in the map tasks.
    """
    rest = [c for c in df.columns if c not in keys]
    order = F.struct(F.col(at).isNotNull().alias("o0"), F.col(at).alias("o1"), *[t.alias(f"o{i + 2}") for i, t in enumerate(ties)])
    return (
        df.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), order).alias("__row"))
        .select(*keys, *[F.col("__row")[c].alias(c) for c in rest])
    )


def top_n(
    df: DataFrame,
    group: str,
    score: str,
    ties: Sequence[Column],
    n: int,
    bands: int = 4,
    relative_error: float = 0.01,
    cuts_from: DataFrame | None = None,
    hot_keys: int = 2000,
) -> DataFrame:
    """The first ``n`` rows of each group by ``score`` descending, then by ``ties``.

    The score range is cut into ``bands`` at quantiles of a distributed sketch, the top band being the narrowest, and the
    rows are written once, partitioned by band, so that each band is read alone.  Bands are processed from the top: groups
    already filled are anti-joined away (those with more than one in ``hot_keys`` rows before anything else, by a
    broadcast that the pigeonhole principle bounds; the many small ones when they are ranked), a group that a band does
    not yet fill keeps the whole band, and in the band that fills it the boundary rows are ranked, exactly, up to what is
    missing.  Ranking limits itself inside the map tasks first, so a group of millions of rows sends at most ``n`` rows
    per task.  ``relative_error`` and ``cuts_from``, a table with the same column to cut by, only move the cuts; results
    are exact.

    Rows with a null score are left out, a null group is a group, repeated rows fill a place each, and an empty input gives
    an empty result.  ``ties`` must tell all rows of a group apart if the result is to be repeatable.
    """
    scored = df.where(F.col(score).isNotNull())
    shares = [1.0 - 0.5 ** (bands - i) for i in range(bands - 1)]  # 15/16, 7/8, 3/4 for four bands
    from_ = scored if cuts_from is None else cuts_from.where(F.col(score).isNotNull())
    cuts = sorted({float(c) for c in from_.approxQuantile(score, shares, relative_error)}, reverse=True) if bands > 1 else []
    at = F.lit(0)
    for c in cuts:
        at = at + (F.col(score) < c).cast("int")
    banded = materialize(scored.withColumn("__band", at), "bands", partition_by=["__band"])
    sizes = materialize(banded.groupBy(group).agg(F.count(F.lit(1)).alias("__size")), "sizes")
    total = sizes.agg(F.sum("__size")).first()[0] or 0
    hot = sizes.where(F.col("__size") * hot_keys > total).select(F.col(group).alias("__g"))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.col(score).desc(), *ties))
    kept: DataFrame | None = None
    have: DataFrame | None = None  # rows that each group has so far
    for k in range(len(cuts) + 1):
        band = banded.where(F.col("__band") == k).drop("__band")
        if have is not None:
            full = have.where(F.col("__have") >= n).join(F.broadcast(hot), "__g", "left_semi")
            band = band.join(F.broadcast(full.select("__g")), F.col(group) == F.col("__g"), "left_anti")
        ranked = band.withColumn("__rank", rank).where(F.col("__rank") <= n)
        if have is not None:
            ranked = ranked.join(have, F.col(group).eqNullSafe(F.col("__g")), "left").where(F.col("__rank") <= F.lit(n) - F.coalesce("__have", F.lit(0)))
        taken = materialize(ranked.select(*df.columns), "band")
        kept = taken if kept is None else kept.unionByName(taken)
        if k < len(cuts):
            have = materialize(kept.groupBy(F.col(group).alias("__g")).agg(F.count(F.lit(1)).alias("__have")), "have")
    return kept


def top_neighbours(neighbours: DataFrame, n: int = 10) -> DataFrame:
    """(id, neighborId): each artist's ``n`` neighbours of the greatest overlap in their latest export.

    Rows without neighborId are ignored (a null id names no artist and is ignored too); a pair whose latest overlap is
    null is out.  Exports of the same time are settled by overlap, then shared playlists, greatest first.
    """
    known = neighbours.select("id", "neighborId", "overlapPercent", "sharedPlaylists", "exported_at").where(
        F.col("id").isNotNull() & F.col("neighborId").isNotNull())
    latest = latest_rows(known, ["id", "neighborId"], "exported_at", [F.col("overlapPercent"), F.col("sharedPlaylists")])
    ties = [F.col("sharedPlaylists").desc_nulls_last(), F.col("neighborId").asc()]
    return top_n(latest.drop("exported_at"), "id", "overlapPercent", ties, n, cuts_from=known).select("id", "neighborId")
