"""Tables behind static reports: label overviews, member facts, indexes, density maps, sitemaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from constellate.operators.ranking import global_rank, rank_within


def member_tags(nodes: DataFrame) -> DataFrame:
    """(id, tag) of every distinct tag of a node."""
    return nodes.select("id", F.explode(F.array_distinct("tags")).alias("tag"))


def label_sizes(tags: DataFrame) -> DataFrame:
    return tags.groupBy("tag").agg(F.count(F.lit(1)).alias("size"))


def related_labels(tags: DataFrame, least: int = 2, k: int = 8) -> DataFrame:
    """(tag, other, shared, rank): labels that share the most members for their sizes, by shared / sqrt(size * size)."""
    pair = tags.join(tags.select("id", F.col("tag").alias("other")), "id").where("tag != other").groupBy("tag", "other").agg(F.count(F.lit(1)).alias("shared")).where(F.col("shared") >= least)
    size = label_sizes(tags)
    score = F.round(F.col("shared") / F.sqrt(F.col("a") * F.col("b")), 9)
    s = pair.join(size.toDF("tag", "a"), "tag").join(size.toDF("other", "b"), "other").withColumn("score", score)
    rank = F.row_number().over(Window.partitionBy("tag").orderBy(F.desc("score"), F.desc("shared"), "other"))
    return s.withColumn("rank", rank).where(F.col("rank") <= k).select("tag", "other", "shared", "rank")


def label_communities(tags: DataFrame, membership: DataFrame, k: int = 6) -> DataFrame:
    """(tag, community, n, rank): communities that a label's members live in, largest first."""
    n = tags.join(membership, "id").groupBy("tag", "community").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("rank", F.row_number().over(Window.partitionBy("tag").orderBy(F.desc("n"), "community"))).where(F.col("rank") <= k)


def pairings(edges: DataFrame, nodes: DataFrame, k: int = 10) -> DataFrame:
    """(tag, source, target, playlists, rank): each label's strongest links between members of its own."""
    a = nodes.select(F.col("id").alias("source"), F.col("tags").alias("ta"))
    b = nodes.select(F.col("id").alias("target"), F.col("tags").alias("tb"))
    e = edges.select("source", "target", F.coalesce("playlists", F.lit(0)).alias("playlists")).join(a, "source").join(b, "target")
    e = e.select(F.explode(F.array_intersect("ta", "tb")).alias("tag"), "source", "target", "playlists")
    rank = F.row_number().over(Window.partitionBy("tag").orderBy(F.desc("playlists"), "source", "target"))
    return e.withColumn("rank", rank).where(F.col("rank") <= k)


def bridge_members(related: DataFrame, tags: DataFrame, reach: DataFrame, k: int = 3) -> DataFrame:
    """(tag, other, id, rank): the members of greatest reach that a label shares with a related one."""
    both = related.select("tag", "other").join(tags, "tag").join(tags.toDF("id", "other"), ["id", "other"]).join(reach, "id")
    rank = F.row_number().over(Window.partitionBy("tag", "other").orderBy(F.desc("reach"), "id"))
    return both.withColumn("rank", rank).where(F.col("rank") <= k).select("tag", "other", "id", "rank")


def label_overview(nodes: DataFrame, membership: DataFrame) -> DataFrame:
    """(tag, size, reach, home, home_share): members, summed reach, and the community with the most of them, in percent."""
    tags = member_tags(nodes)
    base = tags.join(nodes.select("id", F.coalesce("reach", F.lit(0)).alias("reach")), "id").groupBy("tag").agg(F.count(F.lit(1)).alias("size"), F.sum("reach").alias("reach"))
    home = label_communities(tags, membership, 1).select("tag", F.col("community").alias("home"), "n")
    return base.join(home, "tag", "left").select("tag", "size", "reach", "home", F.floor(100.0 * F.col("n") / F.col("size") + 0.5).cast("bigint").alias("home_share"))


def dominant_tag(lists: DataFrame, nodes: DataFrame, least: int = 2) -> DataFrame:
    """(id, tag, n): the most common first tag among a node's listed neighbours, if it covers ``least`` of them."""
    first = nodes.select(F.col("id").alias("other"), F.get("tags", F.lit(0)).alias("tag")).where("tag is not null and tag != ''")
    n = lists.select("id", "other").join(first, "other").groupBy("id", "tag").agg(F.count(F.lit(1)).alias("n"))
    best = n.groupBy("id").agg(F.min_by(F.struct("tag", "n"), F.struct(-F.col("n"), "tag")).alias("b"))
    return best.select("id", "b.tag", "b.n").where(F.col("n") >= least)


def neighbour_facts(lists: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, known, top, closest): of each node's ranked neighbours (id, other, rank) those that are nodes: how many, the first three, the first."""
    named = lists.join(nodes.select(F.col("id").alias("other"), "label"), "other")
    rows = named.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", "label"))).alias("r"))
    return rows.select("id", F.size("r").cast("bigint").alias("known"), F.array_join(F.slice(F.col("r.label"), 1, 3), ", ").alias("top"), F.col("r.label")[0].alias("closest"))


def projection(nodes: DataFrame, width: float = 1200.0, padding: float = 20.0) -> DataFrame:
    """(id, px, py): positions fitted into a box ``width`` wide, y downwards."""
    e = nodes.agg(F.struct(F.min("x").alias("x0"), F.max("x").alias("x1"), F.max("y").alias("y1")).alias("e")).scalar()
    scale = (width - 2 * padding) / (e["x1"] - e["x0"])
    return nodes.where("x is not null and y is not null").select("id", (padding + (F.col("x") - e["x0"]) * scale).alias("px"), (padding + (e["y1"] - F.col("y")) * scale).alias("py"))


def density(points: DataFrame, cell: float = 6.0, levels: int = 5) -> DataFrame:
    """(cx, cy, n, level): points per cell, and the level of its logarithm among ``levels``."""
    c = points.groupBy(F.floor(F.col("px") / cell).alias("cx"), F.floor(F.col("py") / cell).alias("cy")).agg(F.count(F.lit(1)).alias("n"))
    most = c.agg(F.max(F.log1p("n"))).scalar()
    return c.withColumn("level", F.least(F.lit(levels - 1), F.floor(F.round(F.log1p("n") / most * levels, 9)).cast("int")))


def letter_pages(nodes: DataFrame, letter: Column, size: int = 250) -> DataFrame:
    """(letter, page, n, first, last): index pages of each letter, labels in order."""
    n = nodes.select(letter.alias("letter"), "label", "id")
    p = rank_within(n, "letter", [F.col("label"), F.col("id")]).withColumn("page", F.floor(F.col("rank") / size).cast("bigint"))
    return p.groupBy("letter", "page").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("first"), F.max("label").alias("last"))


def label_pages(tags: DataFrame, reach: DataFrame, size: int = 250, structured: int = 100, least: int = 5) -> DataFrame:
    """(tag, page, start, n, listed, first): list pages of each label of ``least`` members or more, by reach: rank of the first
    row (from 1), rows, rows with structured data, and the first member."""
    t = tags.join(label_sizes(tags).where(F.col("size") >= least).select("tag"), "tag", "left_semi").join(reach, "id")
    rank = F.row_number().over(Window.partitionBy("tag").orderBy(F.desc("reach"), "id"))
    paged = t.withColumn("rank", rank).withColumn("page", F.floor((F.col("rank") - 1) / size).cast("bigint"))
    return paged.groupBy("tag", "page").agg(F.min("rank").alias("start"), F.count(F.lit(1)).alias("n"), F.min_by("id", "rank").alias("first")).select(
        "tag", "page", "start", "n", F.least(F.col("n"), F.lit(structured)).alias("listed"), "first")


def label_index(sizes: DataFrame, letter: Column) -> DataFrame:
    """(letter, n, labels): labels grouped by first letter, in order."""
    return sizes.groupBy(letter.alias("letter")).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("tag")), "|").alias("labels"))


def label_listing(sizes: DataFrame, query: str = "", by_size: bool = False) -> DataFrame:
    """(tag, size, place): labels that contain ``query``, by name, or by size and name."""
    hit = sizes.where(F.contains(F.lower("tag"), F.lit(query.lower())))
    order = [F.desc("size"), F.asc("tag")] if by_size else [F.asc("tag")]
    return global_rank(hit, order, "place").select("tag", "size", "place")


def footprint(tags: DataFrame, nodes: DataFrame, most: int = 600) -> DataFrame:
    """(tag, color, dots, first): dots of each label's ``most`` members of greatest reach by colour, the least drawn first."""
    rank = F.row_number().over(Window.partitionBy("tag").orderBy(F.desc("reach"), "id"))
    t = tags.join(nodes.select("id", "reach", "color"), "id").withColumn("rank", rank).where(F.col("rank") <= most)
    return t.groupBy("tag", "color").agg(F.count(F.lit(1)).alias("dots"), F.max_by("id", "rank").alias("first"))


def page_registry(*families: DataFrame) -> DataFrame:
    """(family, path, n): all pages of the site by path; ``n`` above 1 tells a path that two pages claim."""
    every = families[0]
    for f in families[1:]:
        every = every.unionByName(f)
    return every.groupBy("family", "path").agg(F.count(F.lit(1)).alias("n"))


def sitemap_files(paths: DataFrame, site: str, lastmod: Column, most: int = 50_000) -> DataFrame:
    """(family, file, urls, bytes) of sitemap files: paths (family, path) in order, ``most`` a file."""
    f = rank_within(paths, "family", [F.col("path")]).withColumn("file", F.floor(F.col("rank") / most).cast("bigint"))
    entry = F.concat(F.lit("  <url><loc>" + site), "path", F.lit("</loc><lastmod>"), lastmod, F.lit("</lastmod></url>"))
    return f.groupBy("family", "file").agg(F.count(F.lit(1)).alias("urls"), F.sum(F.length(entry) + 1).alias("bytes"))
