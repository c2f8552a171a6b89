"""Registered queries of the general data-processing problem, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from constellate.operators import skew


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return skew.frequent_artists(_table(spark, d, "harvested_playlists"), one_in=20)


def p1_counts(spark: SparkSession, d: str) -> DataFrame:
    return skew.playlists_per_artist(_table(spark, d, "harvested_playlists"))


def p1_stated(spark: SparkSession, d: str) -> DataFrame:
    """Counted against stated playlists of each catalogue artist, summed over the artist's channels."""
    counts = skew.playlists_per_artist(_table(spark, d, "harvested_playlists"))
    channels = (
        _table(spark, d, "artist_catalog")
        .select("id", F.explode("credits.channel").alias("channel"))
        .where(F.col("channel").isNotNull())
        .select(F.col("id"), F.concat(F.lit("yt_"), "channel").alias("artist_id"))
        .distinct()
    )
    details = _table(spark, d, "artist_details").groupBy("id").agg(F.max("totalPlaylists").cast("bigint").alias("stated"))
    return (
        channels.join(counts, "artist_id")
        .groupBy("id")
        .agg(F.sum("n_playlists").alias("credited"))
        .join(details, "id", "left")
        .select("id", "credited", "stated", (F.col("credited") - F.col("stated")).alias("behind"))
    )


_INC = "SELECT DISTINCT id, t.artist_id AS artist_id FROM (SELECT id, unnest(tracks) AS t FROM harvested_playlists) WHERE t.artist_id IS NOT NULL AND t.artist_id <> '' AND id IS NOT NULL"
_COUNTS = f"SELECT artist_id, count(*) AS n_playlists FROM ({_INC}) GROUP BY artist_id"

QUERIES = {"p1_found": p1_found, "p1_counts": p1_counts, "p1_stated": p1_stated}
ORACLES = {
    "p1_found": f"SELECT artist_id FROM ({_COUNTS}) WHERE 20 * n_playlists >= (SELECT count(DISTINCT id) FROM harvested_playlists)",
    "p1_counts": _COUNTS,
    "p1_stated": f"""
        SELECT c.id, c.credited, d.stated, c.credited - d.stated AS behind FROM (
          SELECT k.id, CAST(sum(n.n_playlists) AS BIGINT) AS credited
          FROM (SELECT DISTINCT id, 'yt_' || c.channel AS artist_id FROM (SELECT id, unnest(credits) AS c FROM artist_catalog) WHERE c.channel IS NOT NULL) k
          JOIN ({_COUNTS}) n USING (artist_id) GROUP BY k.id) c
        LEFT JOIN (SELECT id, CAST(max(totalPlaylists) AS BIGINT) AS stated FROM artist_details GROUP BY id) d USING (id)""",
}
