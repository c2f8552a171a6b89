"""Interactive filters over the drawn graph: slices by popularity, strength of links, communities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from constellate.operators.graph import induced
from constellate.operators.ranking import global_rank, percent_slice, value_at_share


def popularity_slice(nodes: DataFrame, low: float, high: float, community=None) -> DataFrame:
    """Nodes ranked by reach (greatest first, then id) in a percent range, of all or of one community.

    ``nodes`` is (id, reach, community).
    """
    scope = nodes if community is None else nodes.where(F.col("community") == community)
    ranked = global_rank(scope.withColumn("reach", F.coalesce("reach", F.lit(0))), [F.desc("reach"), F.asc("id")])
    return percent_slice(ranked, scope.count(), low, high)


def active_selection(artist: Column, on_path: Column, spotlight: Column, slice_: Column, community: Column, strength: Column) -> Column:
    """Which selection a view shows: an artist, but not one on the path that is shown; a spotlight; a popularity slice; a
    community; a strength filter; none.  Arguments are truth values, null being false."""
    on = lambda c: F.coalesce(c, F.lit(False))
    return (
        F.when(on(artist) & ~(on(spotlight) & on(on_path)), "artist").when(on(spotlight), "spotlight").when(on(slice_), "slice")
        .when(on(community), "community").when(on(strength), "strength").otherwise("none")
    )


def qualifying(nodes: DataFrame, chosen: DataFrame | None = None, community=None) -> DataFrame:
    """Nodes that the active filter set (ids, None for no filter) and community let through."""
    out = nodes if community is None else nodes.where(F.col("community") == community)
    return out if chosen is None else out.join(chosen.select("id").distinct(), "id", "left_semi")


def fitted(points: DataFrame) -> DataFrame:
    """(n, x0, y0, x1, y1): the box that a view of ``points`` (x, y) is fitted to; points without a place are left out."""
    p = points.where("x is not null and y is not null")
    return p.agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))


def strength_cutoff(edges: DataFrame, percent: float, strength: str = "playlists") -> int:
    """Least shared count that a link needs at a percentile of all links; a missing count is 1."""
    if percent <= 0:
        return 0
    e = edges.select(F.coalesce(strength, F.lit(1)).alias("s"), "source", "target")
    return value_at_share(e, "s", percent / 100, ["source", "target"]) or 0


def strong_links(edges: DataFrame, cutoff: int, strength: str = "playlists") -> DataFrame:
    return edges.where(F.coalesce(strength, F.lit(1)) >= cutoff)


def with_links(points: DataFrame, links: DataFrame) -> DataFrame:
    """``points`` (id, ...) that are an end of one of ``links``."""
    ends = links.select(F.col("source").alias("id")).union(links.select("target")).distinct()
    return points.join(ends, "id", "left_semi")


def select(nodes: DataFrame, edges: DataFrame, community=None, slice_: tuple[float, float] | None = None, percent: float = 0) -> tuple[DataFrame, DataFrame]:
    """(points, links) of a view: a slice, else a community, else everything, with links above a strength percentile.

    A full slice is none, and an empty one is widened to one percent.  With a strength filter only points that keep a link stay.
    """
    cutoff = strength_cutoff(edges, percent)
    links = strong_links(edges, cutoff) if percent > 0 else edges
    if slice_ is not None and slice_ != (0, 100):
        low, high = max(0, min(slice_[0], slice_[1] - 1)), min(100, slice_[1])
        points = popularity_slice(nodes, low, high, community).select("id")
        links = induced(links, points)
    elif community is not None:
        points = nodes.where(F.col("community") == community).select("id")
        own = points.withColumnRenamed("id", "__c")
        links = links.join(own, links["source"] == own["__c"], "left_semi").unionByName(
            links.join(own, links["target"] == own["__c"], "left_semi")).distinct()
        if percent > 0:
            return with_links(points, links), links
        return points, links
    else:
        points = nodes.select("id")
    return (with_links(points, links) if percent > 0 else points), links
