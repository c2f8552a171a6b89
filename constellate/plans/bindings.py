"""The driver's tables as containers and members, so that the graph operators run on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def baskets(spark: SparkSession, d: str) -> DataFrame:
    """(container, member, label, unit): parts bought by a customer, with the customer's segment and nation."""
    return (
        table(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey").alias("member"))
        .join(table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("container")), "l_orderkey")
        .join(table(spark, d, "customer").select(F.col("c_custkey").alias("container"), F.col("c_mktsegment").alias("label"), F.col("c_nationkey").cast("bigint").alias("unit")), "container")
        .select("container", "member", "label", "unit").distinct()
    )


BASKETS = """(SELECT DISTINCT o_custkey AS container, l_partkey AS member, c_mktsegment AS label, CAST(c_nationkey AS BIGINT) AS unit
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey)"""


def sessions(spark: SparkSession, d: str) -> DataFrame:
    """(container, member, unit): users active in an hour, and the day."""
    return table(spark, d, "events").select(
        F.date_trunc("hour", "ts").alias("container"), F.col("user_id").alias("member"), F.to_date("ts").alias("unit")).distinct()


SESSIONS = "(SELECT DISTINCT date_trunc('hour', ts) AS container, user_id AS member, CAST(ts AS DATE) AS unit FROM events)"


def atlas_edges(spark: SparkSession, d: str) -> DataFrame:
    """The drawn graph: (source, target, weight, playlists, isBridge), each undirected pair once, source < target."""
    e = table(spark, d, "atlas_edges")
    return e.groupBy(F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target")).agg(
        F.max("weight").alias("weight"), F.max("playlists").alias("playlists"), F.coalesce(F.max("isBridge"), F.lit(False)).alias("isBridge"))


ATLAS_EDGES = """(SELECT least(source, target) AS source, greatest(source, target) AS target, max(weight) AS weight,
    max(playlists) AS playlists, coalesce(bool_or("isBridge"), false) AS "isBridge" FROM atlas_edges GROUP BY 1, 2)"""


def nodes(spark: SparkSession, d: str) -> DataFrame:
    """Nodes, one row per id: (id, label, x, y, size, color, continentId, topSubgenres, image, subscribers)."""
    n = table(spark, d, "atlas_nodes")
    rest = [c for c in n.columns if c != "id"]
    return n.groupBy("id").agg(F.max_by(F.struct(*rest), F.struct("label", "x", "y")).alias("r")).select("id", "r.*")


NODES = """(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY label DESC NULLS LAST, x DESC NULLS LAST, y DESC NULLS LAST) AS rn FROM atlas_nodes) WHERE rn = 1)"""


def playlists(spark: SparkSession, d: str) -> DataFrame:
    """Playlists, one row per id: the latest harvest, ties settled by load time."""
    p = table(spark, d, "harvested_playlists")
    rest = [c for c in p.columns if c != "id"]
    return p.groupBy("id").agg(F.max_by(F.struct(*rest), F.struct("harvested_at", "loaded_at")).alias("r")).select("id", "r.*")


PLAYLISTS = """(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY harvested_at DESC NULLS LAST, loaded_at DESC NULLS LAST) AS rn FROM harvested_playlists) WHERE rn = 1)"""
