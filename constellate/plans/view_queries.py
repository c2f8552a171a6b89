"""Registered queries of search, selection, reports and layout, on the drawn graph, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from constellate.functions import text as X
from constellate.operators import layout as L
from constellate.operators import ranking as K
from constellate.operators import report as R
from constellate.operators import search as S
from constellate.operators import selection as C
from constellate.plans.bindings import ATLAS_EDGES, NODES, atlas_edges, nodes, table
from constellate.plans.sql import q
from constellate.plans.text_queries import _PATHS

D = 4  # decimals at which positions are compared


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d)
    c = table(spark, d, "continents").select(F.col("id").alias("continentId"), F.col("name").alias("place"))
    return n.join(c, "continentId", "left").select(
        "id", "label", F.coalesce("topSubgenres", F.array().cast("array<string>")).alias("tags"), "place", F.col("subscribers").alias("reach"),
        F.col("continentId").alias("community"), "x", "y", "size")


def _label_table(spark: SparkSession, d: str) -> DataFrame:
    return R.label_sizes(R.member_tags(_nodes(spark, d))).select(F.col("tag").alias("label"), "size")


_N = f"""(SELECT n.id, label, coalesce("topSubgenres", []) AS tags, c.name AS place, subscribers AS reach, "continentId" AS community, x, y, size
    FROM {NODES} n LEFT JOIN continents c ON c.id = n."continentId")"""
_TAGS = f"(SELECT id, unnest(list_distinct(tags)) AS tag FROM {_N})"
_SIZES = f"(SELECT tag, count(*) AS size FROM {_TAGS} GROUP BY tag)"


# ---- search --------------------------------------------------------------------------------------------------------


def _search_sql(query: str, limit: int = 10, stop: int = 25) -> str:
    x, words = q(query), query.split()
    form = "trim(lower(strip_accents(coalesce(label, ''))))"
    every = " AND ".join(f"contains(form, {q(w)})" for w in words)
    named = f"""CASE WHEN form = {x} THEN 1 WHEN starts_with(form, {x}) THEN 2
        WHEN contains(form, {x}) AND len(list_filter(regexp_split_to_array(form, '[\\s\\-_–—,.''"/]+'), lambda w: starts_with(w, {x}))) > 0 THEN 3
        WHEN contains(form, {x}) AND {len(query)} > 1 THEN 5 {f'WHEN NOT contains(form, {x}) AND {every} THEN 4' if len(words) > 1 else ''} END"""
    tagged = f"CASE WHEN {len(query)} > 2 AND (contains(trim(lower(strip_accents(coalesce(place, '')))), {x}) OR len(list_filter(tags, lambda t: contains(trim(lower(strip_accents(t))), {x}))) > 0) THEN 6 END"
    return f"""SELECT CAST(row_number() OVER (ORDER BY tier, reach DESC, id) AS INT) AS position, id, label, CAST(tier AS INT) AS tier FROM (
        SELECT *, sum(CASE WHEN tier <= 3 THEN 1 ELSE 0 END) OVER (ORDER BY reach DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM (
          SELECT id, label, coalesce(reach, 0) AS reach, coalesce({named}, {tagged}) AS tier FROM (SELECT *, {form} AS form FROM {_N})) WHERE tier IS NOT NULL)
        WHERE coalesce(before, 0) < {stop} QUALIFY position <= {limit}"""


def _search(query: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return S.search_members(S.member_index(_nodes(spark, d)), query)

    return run


SEARCHES = {"search_prefix": "the", "search_word": "dj", "search_two_words": "choir chamber", "search_tag": "moss", "search_letter": "s"}


def search_labels(spark: SparkSession, d: str) -> DataFrame:
    return S.search_labels(_label_table(spark, d), "mo")


def search_all(spark: SparkSession, d: str) -> DataFrame:
    return S.search_all(S.member_index(_nodes(spark, d)), _label_table(spark, d), "mist")


def search_index(spark: SparkSession, d: str) -> DataFrame:
    """Covering index: label, id, first tag, in order of reach."""
    n = _nodes(spark, d).select("label", "id", F.coalesce(F.get("tags", F.lit(0)), F.lit("")).alias("tag"), F.coalesce("reach", F.lit(0)).alias("reach"))
    return K.global_rank(n, [F.desc("reach"), F.asc("id")]).select("label", "id", "tag", "rank")


# ---- selection -----------------------------------------------------------------------------------------------------


def popularity_slice(spark: SparkSession, d: str) -> DataFrame:
    return C.popularity_slice(_nodes(spark, d).select("id", "reach", "community"), 10, 35).select("id", "rank")


def slice_in_community(spark: SparkSession, d: str) -> DataFrame:
    return C.select(_nodes(spark, d).select("id", "reach", "community"), atlas_edges(spark, d), 1, (0, 40))[1].select("source", "target")


def strength_filter(spark: SparkSession, d: str) -> DataFrame:
    return C.select(_nodes(spark, d).select("id", "reach", "community"), atlas_edges(spark, d), percent=75)[0]


def slice_and_strength(spark: SparkSession, d: str) -> DataFrame:
    return C.select(_nodes(spark, d).select("id", "reach", "community"), atlas_edges(spark, d), None, (0, 50), 60)[0]


def community_filter(spark: SparkSession, d: str) -> DataFrame:
    return C.select(_nodes(spark, d).select("id", "reach", "community"), atlas_edges(spark, d), 2, percent=50)[1].select("source", "target")


# ---- reports -------------------------------------------------------------------------------------------------------


def related_labels(spark: SparkSession, d: str) -> DataFrame:
    return R.related_labels(R.member_tags(_nodes(spark, d)))


def label_communities(spark: SparkSession, d: str) -> DataFrame:
    n = _nodes(spark, d)
    return R.label_communities(R.member_tags(n), n.select("id", "community").where("community is not null"))


def pairings_top10(spark: SparkSession, d: str) -> DataFrame:
    return R.pairings(atlas_edges(spark, d), _nodes(spark, d))


def bridge_members(spark: SparkSession, d: str) -> DataFrame:
    n = _nodes(spark, d)
    tags = R.member_tags(n)
    return R.bridge_members(R.related_labels(tags), tags, n.select("id", F.coalesce("reach", F.lit(0)).alias("reach")))


def label_overview(spark: SparkSession, d: str) -> DataFrame:
    n = _nodes(spark, d)
    return R.label_overview(n, n.select("id", "community").where("community is not null"))


def _lists(spark: SparkSession, d: str) -> DataFrame:
    """Ranked neighbour lists: the latest export of each pair."""
    from pyspark.sql import Window

    c = table(spark, d, "crossover_neighbors").where("neighborId is not null")
    last = c.groupBy("id", F.col("neighborId").alias("other")).agg(F.max(F.struct("exported_at", "overlapPercent", "sharedPlaylists")).alias("m"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("o"), F.desc("s"), "other"))
    return last.select("id", "other", F.col("m.overlapPercent").alias("o"), F.col("m.sharedPlaylists").alias("s")).where("o is not null").withColumn("rank", rank)


def dominant_tags(spark: SparkSession, d: str) -> DataFrame:
    return R.dominant_tag(_lists(spark, d), _nodes(spark, d))


def neighbour_facts(spark: SparkSession, d: str) -> DataFrame:
    return R.neighbour_facts(_lists(spark, d), _nodes(spark, d))


def hydrated(spark: SparkSession, d: str) -> DataFrame:
    """Neighbour lists with names and pictures, falling back on the id."""
    n = nodes(spark, d).select(F.col("id").alias("other"), "label", "image")
    return _lists(spark, d).where("rank <= 10").join(n, "other", "left").select("id", "other", F.coalesce("label", "other").alias("name"), F.coalesce("image", F.lit("")).alias("image"))


def bar_scaling(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    from constellate.functions.scalars import bar_percent

    most = F.max("o").over(Window.partitionBy("id"))
    return _lists(spark, d).where("rank <= 10").select("id", "other", bar_percent(F.col("o"), most).cast("bigint").alias("bar"))


def density_grid(spark: SparkSession, d: str) -> DataFrame:
    return R.density(R.projection(_nodes(spark, d)), 24.0)


def bbox_projection(spark: SparkSession, d: str) -> DataFrame:
    return R.projection(_nodes(spark, d)).select("id", F.round("px", D).alias("px"), F.round("py", D).alias("py"))


def letter_pages(spark: SparkSession, d: str) -> DataFrame:
    return R.letter_pages(_nodes(spark, d), X.letter_of(X.search_form(F.col("label"))), 50)


def paginated(spark: SparkSession, d: str) -> DataFrame:
    n = _nodes(spark, d).select("id", F.coalesce("reach", F.lit(0)).alias("reach"))
    return K.paginate(n, [F.desc("reach"), F.asc("id")], 250).select("id", "rank", "page")


def sitemap(spark: SparkSession, d: str) -> DataFrame:
    n = _nodes(spark, d)
    paths = n.select(F.lit("artists").alias("family"), F.concat(F.lit("/artist/"), "id", F.lit("/")).alias("path")).unionByName(
        R.label_sizes(R.member_tags(n)).where("size >= 5").select(F.lit("labels").alias("family"), F.concat(F.lit("/label/"), X.slug(X.search_form(F.col("tag"))), F.lit("/")).alias("path")))
    return R.sitemap_files(paths, "https://atlas.example", F.lit("2026-01-01"), 200)


def vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return R.member_tags(_nodes(spark, d)).select("tag").distinct()


def headline(spark: SparkSession, d: str) -> DataFrame:
    return _nodes(spark, d).agg((F.floor(F.count(F.lit(1)) / 1000) * 1000).cast("bigint").alias("at_least"))


def label_pages(spark: SparkSession, d: str) -> DataFrame:
    n = _nodes(spark, d)
    return R.label_pages(R.member_tags(n), n.select("id", F.coalesce("reach", F.lit(0)).alias("reach")), 20, 8)


def label_index(spark: SparkSession, d: str) -> DataFrame:
    return R.label_index(R.label_sizes(R.member_tags(_nodes(spark, d))), X.letter_of(X.search_form(F.col("tag"))))


def label_listing(spark: SparkSession, d: str) -> DataFrame:
    return R.label_listing(R.label_sizes(R.member_tags(_nodes(spark, d))), "O", by_size=True)


def footprint(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d).select("id", F.coalesce("subscribers", F.lit(0)).alias("reach"), "color")
    return R.footprint(R.member_tags(_nodes(spark, d)), n, 20)


def page_registry(spark: SparkSession, d: str) -> DataFrame:
    from constellate.plans.text_queries import slug_paths

    index = slug_paths(spark, d).select(F.lit("letters").alias("family"), F.concat(F.lit("/index/"), F.lower("letter"), F.lit("/")).alias("path")).distinct()
    artists = slug_paths(spark, d).select(F.lit("artists").alias("family"), "path")
    labels = R.label_sizes(R.member_tags(_nodes(spark, d))).where("size >= 5").select(
        F.lit("labels").alias("family"), F.concat(F.lit("/label/"), X.slug(X.search_form(F.col("tag"))), F.lit("/")).alias("path"))
    return R.page_registry(artists, labels, index)


def member_pages(spark: SparkSession, d: str) -> DataFrame:
    """Nodes with a page of their own: 45 lists or more."""
    return table(spark, d, "artist_details").groupBy("id").agg(F.max("totalPlaylists").alias("lists")).where("lists >= 45")


def label_panel(spark: SparkSession, d: str) -> DataFrame:
    """Members of a label's panel: thirty, and fifty more."""
    n = _nodes(spark, d)
    rank = F.row_number().over(Window.partitionBy("tag").orderBy(F.desc(F.coalesce("reach", F.lit(0))), "id"))
    t = R.member_tags(n).join(n.select("id", "reach"), "id").withColumn("rank", rank).where("rank <= 80")
    return t.select("tag", "id", "rank", F.when(F.col("rank") <= 30, 1).otherwise(2).alias("step"))


def picker(spark: SparkSession, d: str) -> DataFrame:
    """Search as the path picker asks it: six names."""
    return S.search_members(S.member_index(_nodes(spark, d)), "the", limit=6)


def collated(spark: SparkSession, d: str) -> DataFrame:
    """Labels in order regardless of case and accents, numbers by value."""
    n = _nodes(spark, d).where("label is not null").select("id", X.collation_key(F.col("label")).alias("key"))
    return K.global_rank(n, [F.asc("key"), F.asc("id")]).select("id", "rank")


def draw_order(spark: SparkSession, d: str) -> DataFrame:
    return K.global_rank(_nodes(spark, d).select("id", "size"), [F.asc("size"), F.asc("id")]).select("id", "rank")


def strength_summary(spark: SparkSession, d: str) -> DataFrame:
    from constellate.operators.harvest import summary

    return summary(atlas_edges(spark, d), "weight")


def view_links(spark: SparkSession, d: str) -> DataFrame:
    """Links to views, read back."""
    g = table(spark, d, "genres").select("rank", X.map_link({"genre": F.concat("genre", F.lit(" & more=+")), "view": F.lit("map")}).alias("href"))
    view = X.view_of(F.col("href"))
    return g.select("rank", view["genre"].alias("genre"), view["view"].alias("view"), view["path"].alias("path"))


def separations(spark: SparkSession, d: str) -> DataFrame:
    """Links between nodes in words: itself, a neighbour, two steps, none."""
    return table(spark, d, "nation").select("n_nationkey", X.separation(F.when(F.col("n_nationkey") < 4, F.col("n_nationkey"))).alias("text"))


def zoom_scales(spark: SparkSession, d: str) -> DataFrame:
    from constellate.functions.scalars import zoom_scale

    return table(spark, d, "part").select("p_partkey", F.round(zoom_scale(F.when(F.col("p_size") > 1, (F.col("p_size") - 2) / 4)), 6).alias("scale"))


def active_selection(spark: SparkSession, d: str) -> DataFrame:
    """Precedence of selections over all their combinations."""
    bits = spark.range(64).withColumnRenamed("id", "combination")
    on = [F.col("combination").bitwiseAND(F.lit(1 << k)) > 0 for k in range(6)]
    return bits.select("combination", C.active_selection(*on).alias("shown"))


def qualifying_nodes(spark: SparkSession, d: str) -> DataFrame:
    n = _nodes(spark, d).select("id", "reach", "community")
    return C.qualifying(n, C.popularity_slice(n, 0, 40), 1).select("id")


def fitted_view(spark: SparkSession, d: str) -> DataFrame:
    return C.fitted(_nodes(spark, d).where("community = 2").select("x", "y"))


# ---- layout --------------------------------------------------------------------------------------------------------


def _centres(spark: SparkSession, d: str) -> DataFrame:
    return _nodes(spark, d).where("x is not null and community is not null").groupBy("community").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))


def _centre_rows(spark: SparkSession, d: str, centres: DataFrame | None = None) -> DataFrame:
    n = _nodes(spark, d).select("id", "community", F.get("tags", F.lit(0)).alias("tag"))
    return L.micro_centres(n, _centres(spark, d) if centres is None else centres)


def _macro_centres(spark: SparkSession, d: str) -> DataFrame:
    """Places of the communities by their affinities; a table of one row a community, of which there are few."""
    from constellate.operators.graph import affinity

    m = _nodes(spark, d).where("community is not null").select(F.col("id").alias("node"), "community")
    pulls = {(r["a"], r["b"]): r["affinity"] for r in affinity(atlas_edges(spark, d), m, "source", "target").collect()}
    most = max(pulls.values(), default=1.0)
    places = L.macro_layout([r[0] for r in table(spark, d, "continents").select("id").collect()], {k: v / most for k, v in pulls.items()})
    return spark.createDataFrame([(c, x, y) for c, (x, y) in places.items()], "community int, x double, y double")


def micro_centroids(spark: SparkSession, d: str) -> DataFrame:
    return _centre_rows(spark, d).select("id", F.round("cx", D).alias("cx"), F.round("cy", D).alias("cy"))


def _state(spark: SparkSession, d: str) -> DataFrame:
    n = _nodes(spark, d).where("x is not null and y is not null").select("id", "x", "y", "community")
    return n.join(_centre_rows(spark, d), "id").select("id", "x", "y", F.lit(0.0).alias("vx"), F.lit(0.0).alias("vy"), "cx", "cy", "community")


def spring_step(spark: SparkSession, d: str) -> DataFrame:
    return L.spring_step(_state(spark, d), atlas_edges(spark, d)).select("id", F.round("x", D).alias("x"), F.round("y", D).alias("y"))


def springs(spark: SparkSession, d: str) -> DataFrame:
    """Nodes from jittered places around the tags of their communities, which the macro layout has placed, to rest."""
    aims = _centre_rows(spark, d, _macro_centres(spark, d))
    n = _nodes(spark, d).select("id", "community")
    start = L.jitter(aims).join(aims, "id").join(n, "id").withColumn("vx", F.lit(0.0)).withColumn("vy", F.lit(0.0))
    return L.springs(start.select("id", "x", "y", "vx", "vy", "cx", "cy", "community"), atlas_edges(spark, d), 300).select("id", F.round("x", 2).alias("x"), F.round("y", 2).alias("y"))


def normalised_layout(spark: SparkSession, d: str) -> DataFrame:
    return L.normalise(_nodes(spark, d).where("x is not null and y is not null").select("id", "x", "y")).select("id", F.round("x", D).alias("x"), F.round("y", D).alias("y"))


def centred_layout(spark: SparkSession, d: str) -> DataFrame:
    return L.centred(_nodes(spark, d).where("x is not null and y is not null").select("id", "x", "y"))


def radius_pairs(spark: SparkSession, d: str) -> DataFrame:
    return L.radius_pairs(_nodes(spark, d), 40.0).select("a", "b", F.round("d", D).alias("d"))


def clear_overlaps(spark: SparkSession, d: str) -> DataFrame:
    n = _nodes(spark, d).where("x is not null and y is not null").select("id", "x", "y", F.col("size").alias("radius"))
    return L.clear_overlaps(n, 25).select("id", F.round("x", 2).alias("x"), F.round("y", 2).alias("y"))


QUERIES = {f.__name__: f for f in (
    search_labels, search_all, search_index, popularity_slice, slice_in_community, strength_filter, slice_and_strength, community_filter, related_labels,
    label_communities, pairings_top10, bridge_members, label_overview, dominant_tags, neighbour_facts, hydrated, bar_scaling, density_grid, bbox_projection,
    letter_pages, label_pages, label_index, label_listing, footprint, page_registry, member_pages, label_panel, picker, collated, draw_order, strength_summary,
    view_links, separations, zoom_scales, active_selection, qualifying_nodes, fitted_view, centred_layout, paginated, sitemap, vocabulary, headline, micro_centroids, spring_step, springs, normalised_layout, radius_pairs, clear_overlaps)}
QUERIES |= {name: _search(query) for name, query in SEARCHES.items()}


def _labels_sql(query: str, limit: int = 4) -> str:
    x = q(query)
    return f"""(SELECT CAST(row_number() OVER (ORDER BY tier, size DESC, label) AS INT) AS position, label, CAST(tier AS INT) AS tier FROM (
        SELECT label, size, CASE WHEN form = {x} THEN 1 WHEN starts_with(form, {x}) THEN 2 WHEN len(list_filter(regexp_split_to_array(form, '[\\s\\-_/&]+'), lambda w: starts_with(w, {x}))) > 0 THEN 3
          WHEN contains(form, {x}) THEN 4 END AS tier FROM (SELECT tag AS label, size, trim(lower(strip_accents(tag))) AS form FROM {_SIZES})) WHERE tier IS NOT NULL QUALIFY position <= {limit})"""


_RANKED = f"(SELECT id, row_number() OVER (ORDER BY coalesce(reach, 0) DESC, id) - 1 AS rank, count(*) OVER () AS n FROM {_N})"


def _cut(p: float) -> str:
    return f"(SELECT s FROM (SELECT coalesce(playlists, 1) AS s, row_number() OVER (ORDER BY coalesce(playlists, 1), source, target) - 1 AS r, count(*) OVER () AS n FROM {ATLAS_EDGES}) WHERE r = least(n - 1, CAST(floor({p} * n) AS BIGINT)))"


def _strong(p: float) -> str:
    return f"(SELECT * FROM {ATLAS_EDGES} WHERE coalesce(playlists, 1) >= {_cut(p)})"


_RELATED = f"""(SELECT tag, other, shared, rank FROM (SELECT tag, other, shared, CAST(row_number() OVER (PARTITION BY tag ORDER BY score DESC, shared DESC, other) AS INT) AS rank FROM (
    SELECT p.tag, other, shared, round(shared / sqrt(x.size * y.size), 9) AS score FROM (SELECT a.tag AS tag, b.tag AS other, count(*) AS shared FROM {_TAGS} a JOIN {_TAGS} b ON a.id = b.id AND a.tag <> b.tag GROUP BY 1, 2 HAVING count(*) >= 2) p
    JOIN {_SIZES} x ON x.tag = p.tag JOIN {_SIZES} y ON y.tag = other)) WHERE rank <= 8)"""
_LC = f"(SELECT tag, community, n, CAST(row_number() OVER (PARTITION BY tag ORDER BY n DESC, community) AS INT) AS rank FROM (SELECT tag, community, count(*) AS n FROM {_TAGS} JOIN {_N} USING (id) WHERE community IS NOT NULL GROUP BY 1, 2))"
_LISTS = """(SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY o DESC, s DESC NULLS LAST, other) AS INT) AS rank FROM (
    SELECT id, "neighborId" AS other, "overlapPercent" AS o, "sharedPlaylists" AS s FROM (SELECT *, row_number() OVER (PARTITION BY id, "neighborId" ORDER BY exported_at DESC NULLS LAST, "overlapPercent" DESC NULLS LAST, "sharedPlaylists" DESC NULLS LAST) AS k
      FROM crossover_neighbors WHERE "neighborId" IS NOT NULL) WHERE k = 1) WHERE o IS NOT NULL)"""
_PROJ = f"(SELECT id, 20 + (x - x0) * 1160 / (x1 - x0) AS px, 20 + (y1 - y) * 1160 / (x1 - x0) AS py FROM (SELECT id, x, y, min(x) OVER () AS x0, max(x) OVER () AS x1, max(y) OVER () AS y1 FROM {_N}) WHERE x IS NOT NULL AND y IS NOT NULL)"
_LETTER = "CASE WHEN regexp_matches(upper(left(trim(lower(strip_accents(coalesce(label, '')))), 1)), '^[A-Z]$') THEN upper(left(trim(lower(strip_accents(coalesce(label, '')))), 1)) ELSE '#' END"
_CENTRE = f"""(WITH n AS (SELECT id, community, tags[1] AS tag FROM {_N}), c AS (SELECT community, avg(x) AS x, avg(y) AS y FROM {_N} WHERE x IS NOT NULL AND community IS NOT NULL GROUP BY 1),
    g AS (SELECT *, row_number() OVER (PARTITION BY community ORDER BY n DESC, tag) - 1 AS k, count(*) OVER (PARTITION BY community) AS total FROM (SELECT community, tag, count(*) AS n FROM n WHERE tag <> '' GROUP BY 1, 2)),
    h AS (SELECT community, tag, (65.0 + least(160.0, 18.0 * sqrt(n))) * cos(2 * pi() * k / total) AS dx, (65.0 + least(160.0, 18.0 * sqrt(n))) * sin(2 * pi() * k / total) AS dy FROM g WHERE total > 1)
    SELECT id, x + coalesce(dx, 0) AS cx, y + coalesce(dy, 0) AS cy FROM n JOIN c USING (community) LEFT JOIN h ON h.community = n.community AND h.tag = n.tag)"""

ORACLES = {name: _search_sql(query) for name, query in SEARCHES.items()} | {
    "search_labels": f"SELECT position, label, tier FROM {_labels_sql('mo')}",
    "search_all": f"SELECT 'label' AS kind, position, label AS name FROM {_labels_sql('mist')} UNION ALL SELECT 'member', position, label FROM ({_search_sql('mist')})",
    "search_index": f"SELECT label, id, coalesce(tags[1], '') AS tag, row_number() OVER (ORDER BY coalesce(reach, 0) DESC, id) - 1 AS rank FROM {_N}",
    "popularity_slice": f"SELECT id, rank FROM {_RANKED} WHERE rank >= floor(0.1 * n + 0.5) AND rank < floor(0.35 * n + 0.5)",
    "slice_in_community": f"""WITH s AS (SELECT id FROM (SELECT id, row_number() OVER (ORDER BY coalesce(reach, 0) DESC, id) - 1 AS rank, count(*) OVER () AS n FROM {_N} WHERE community = 1) WHERE rank < greatest(1, floor(0.4 * n + 0.5)))
        SELECT source, target FROM {ATLAS_EDGES} WHERE source IN (SELECT id FROM s) AND target IN (SELECT id FROM s)""",
    "strength_filter": f"SELECT id FROM {_N} WHERE id IN (SELECT source FROM {_strong(0.75)} UNION SELECT target FROM {_strong(0.75)})",
    "slice_and_strength": f"""WITH s AS (SELECT id FROM {_RANKED} WHERE rank < greatest(1, floor(0.5 * n + 0.5))), l AS (SELECT source, target FROM {_strong(0.6)} WHERE source IN (SELECT id FROM s) AND target IN (SELECT id FROM s))
        SELECT id FROM s WHERE id IN (SELECT source FROM l UNION SELECT target FROM l)""",
    "community_filter": f"WITH c AS (SELECT id FROM {_N} WHERE community = 2) SELECT source, target FROM {_strong(0.5)} WHERE source IN (SELECT id FROM c) OR target IN (SELECT id FROM c)",
    "related_labels": f"SELECT * FROM {_RELATED}",
    "label_communities": f"SELECT tag, community, n, rank FROM {_LC} WHERE rank <= 6",
    "pairings_top10": f"""SELECT tag, source, target, playlists, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY tag ORDER BY playlists DESC, source, target) AS INT) AS rank FROM (
        SELECT a.tag, source, target, coalesce(playlists, 0) AS playlists FROM {ATLAS_EDGES} JOIN {_TAGS} a ON a.id = source JOIN {_TAGS} b ON b.id = target AND b.tag = a.tag)) WHERE rank <= 10""",
    "bridge_members": f"""SELECT tag, other, id, rank FROM (SELECT r.tag, r.other, a.id, CAST(row_number() OVER (PARTITION BY r.tag, r.other ORDER BY coalesce(n.reach, 0) DESC, a.id) AS INT) AS rank
        FROM {_RELATED} r JOIN {_TAGS} a ON a.tag = r.tag JOIN {_TAGS} b ON b.id = a.id AND b.tag = r.other JOIN {_N} n ON n.id = a.id) WHERE rank <= 3""",
    "label_overview": f"""SELECT t.tag, t.size, t.reach, l.community AS home, CAST(floor(100.0 * l.n / t.size + 0.5) AS BIGINT) AS home_share
        FROM (SELECT tag, count(*) AS size, CAST(sum(coalesce(reach, 0)) AS BIGINT) AS reach FROM {_TAGS} JOIN {_N} USING (id) GROUP BY 1) t LEFT JOIN (SELECT * FROM {_LC} WHERE rank = 1) l USING (tag)""",
    "dominant_tags": f"""SELECT id, tag, n FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, tag) AS r FROM (SELECT l.id, n.tags[1] AS tag, count(*) AS n FROM {_LISTS} l JOIN {_N} n ON n.id = other WHERE n.tags[1] <> '' GROUP BY 1, 2)) WHERE r = 1 AND n >= 2""",
    "neighbour_facts": f"""SELECT id, count(*) AS known, coalesce(string_agg(label, ', ' ORDER BY rank) FILTER (k <= 3), '') AS top, max(label) FILTER (k = 1) AS closest FROM (
        SELECT l.id, rank, label, row_number() OVER (PARTITION BY l.id ORDER BY rank) AS k FROM {_LISTS} l JOIN {_N} n ON n.id = other) GROUP BY id""",
    "hydrated": f"SELECT l.id, other, coalesce(label, other) AS name, coalesce(image, '') AS image FROM {_LISTS} l LEFT JOIN {NODES} n ON n.id = other WHERE rank <= 10",
    "bar_scaling": f"SELECT id, other, CASE WHEN most > 0 THEN CAST(greatest(12, least(100, floor(100.0 * o / most))) AS BIGINT) ELSE 12 END AS bar FROM (SELECT *, max(o) OVER (PARTITION BY id) AS most FROM {_LISTS} WHERE rank <= 10)",
    "density_grid": f"SELECT cx, cy, n, CAST(least(4, floor(round(ln(1 + n) / max(ln(1 + n)) OVER () * 5, 9))) AS INT) AS level FROM (SELECT CAST(floor(px / 24) AS BIGINT) AS cx, CAST(floor(py / 24) AS BIGINT) AS cy, count(*) AS n FROM {_PROJ} GROUP BY 1, 2)",
    "bbox_projection": f"SELECT id, round(px, {D}) AS px, round(py, {D}) AS py FROM {_PROJ}",
    "letter_pages": f"SELECT letter, page, count(*) AS n, min(label) AS first, max(label) AS last FROM (SELECT {_LETTER} AS letter, label, (row_number() OVER (PARTITION BY {_LETTER} ORDER BY label NULLS FIRST, id) - 1) // 50 AS page FROM {_N}) GROUP BY 1, 2",
    "paginated": f"SELECT id, rank, rank // 250 AS page FROM {_RANKED}",
    "sitemap": f"""SELECT family, file, count(*) AS urls, CAST(sum(length('  <url><loc>https://atlas.example' || path || '</loc><lastmod>2026-01-01</lastmod></url>') + 1) AS BIGINT) AS bytes FROM (
        SELECT family, path, (row_number() OVER (PARTITION BY family ORDER BY path) - 1) // 200 AS file FROM (SELECT 'artists' AS family, '/artist/' || id || '/' AS path FROM {_N} UNION ALL
          SELECT 'labels', '/label/' || regexp_replace(regexp_replace(trim(lower(strip_accents(tag))), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') || '/' FROM {_SIZES} WHERE size >= 5)) GROUP BY 1, 2""",
    "label_pages": f"""SELECT tag, page, min(rank) AS start, count(*) AS n, least(count(*), 8) AS listed, arg_min(id, rank) AS first FROM (SELECT *, (rank - 1) // 20 AS page FROM (
        SELECT tag, id, CAST(row_number() OVER (PARTITION BY tag ORDER BY coalesce(reach, 0) DESC, id) AS INTEGER) AS rank FROM {_TAGS} JOIN {_N} USING (id) WHERE tag IN (SELECT tag FROM {_SIZES} WHERE size >= 5))) GROUP BY 1, 2""",
    "label_index": f"""SELECT letter, count(*) AS n, string_agg(tag, '|' ORDER BY tag) AS labels FROM (SELECT tag, CASE WHEN regexp_matches(upper(left(trim(lower(strip_accents(tag))), 1)), '^[A-Z]$')
        THEN upper(left(trim(lower(strip_accents(tag))), 1)) ELSE '#' END AS letter FROM {_SIZES}) GROUP BY 1""",
    "label_listing": f"SELECT tag, size, row_number() OVER (ORDER BY size DESC, tag) - 1 AS place FROM {_SIZES} WHERE contains(lower(tag), 'o')",
    "footprint": f"""SELECT tag, color, count(*) AS dots, arg_max(id, rank) AS first FROM (SELECT tag, t.id, color, row_number() OVER (PARTITION BY tag ORDER BY coalesce(subscribers, 0) DESC, t.id) AS rank
        FROM {_TAGS} t JOIN {NODES} n ON n.id = t.id) WHERE rank <= 20 GROUP BY 1, 2""",
    "page_registry": f"""SELECT family, path, count(*) AS n FROM (SELECT 'artists' AS family, path FROM {_PATHS} UNION ALL SELECT DISTINCT 'letters', '/index/' || lower(letter) || '/' FROM {_PATHS} UNION ALL
        SELECT 'labels', '/label/' || regexp_replace(regexp_replace(trim(lower(strip_accents(tag))), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') || '/' FROM {_SIZES} WHERE size >= 5) GROUP BY 1, 2""",
    "member_pages": 'SELECT id, max("totalPlaylists") AS lists FROM artist_details GROUP BY 1 HAVING max("totalPlaylists") >= 45',
    "label_panel": f"""SELECT tag, id, rank, CASE WHEN rank <= 30 THEN 1 ELSE 2 END AS step FROM (SELECT tag, id, CAST(row_number() OVER (PARTITION BY tag ORDER BY coalesce(reach, 0) DESC, id) AS INTEGER) AS rank
        FROM {_TAGS} JOIN {_N} USING (id)) WHERE rank <= 80""",
    "picker": _search_sql("the", 6),
    "collated": f"""SELECT id, row_number() OVER (ORDER BY regexp_replace(regexp_replace(lower(strip_accents(label)), '(\\d+)', '{"0" * 20}\\1', 'g'), '0+(\\d{{20}})([^\\d]|$)', '\\1\\2', 'g'), id) - 1 AS rank FROM {_N} WHERE label IS NOT NULL""",
    "draw_order": f"SELECT id, row_number() OVER (ORDER BY size NULLS FIRST, id) - 1 AS rank FROM {_N}",
    "strength_summary": f"SELECT count(*) AS n, min(weight) AS least, median(weight) AS middle, max(weight) AS most FROM {ATLAS_EDGES} WHERE weight IS NOT NULL",
    "view_links": "SELECT rank, genre || ' & more=+' AS genre, 'map' AS view, CAST(NULL AS VARCHAR) AS path FROM genres",
    "separations": """SELECT n_nationkey, CASE WHEN n_nationkey = 0 THEN 'Same artist' WHEN n_nationkey = 1 THEN '1 degree of separation' WHEN n_nationkey < 4 THEN n_nationkey || ' degrees of separation'
        ELSE 'No connection found' END AS text FROM nation""",
    "zoom_scales": """SELECT p_partkey, round(CASE WHEN z IS NULL OR z = 0 THEN 1.0 WHEN z >= 2.2 THEN least(3.5, pow(z / 2.2, 0.45)) ELSE greatest(0.15, pow(z / 2.2, 0.75)) END, 6) AS scale
        FROM (SELECT p_partkey, CASE WHEN p_size > 1 THEN (p_size - 2) / 4.0 END AS z FROM part)""",
    "active_selection": """SELECT c AS combination, CASE WHEN c & 1 > 0 AND NOT (c & 4 > 0 AND c & 2 > 0) THEN 'artist' WHEN c & 4 > 0 THEN 'spotlight' WHEN c & 8 > 0 THEN 'slice' WHEN c & 16 > 0 THEN 'community'
        WHEN c & 32 > 0 THEN 'strength' ELSE 'none' END AS shown FROM (SELECT unnest(range(64)) AS c)""",
    "qualifying_nodes": f"SELECT id FROM {_RANKED} WHERE rank < greatest(1, floor(0.4 * n + 0.5)) AND id IN (SELECT id FROM {_N} WHERE community = 1)",
    "fitted_view": f"SELECT count(*) AS n, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM {_N} WHERE community = 2 AND x IS NOT NULL AND y IS NOT NULL",
    "centred_layout": f"SELECT id, round(x - avg(x) OVER (), 2) AS x, round(y - avg(y) OVER (), 2) AS y FROM {_N} WHERE x IS NOT NULL AND y IS NOT NULL",
    "vocabulary": f"SELECT DISTINCT tag FROM {_TAGS}",
    "headline": f"SELECT CAST(count(*) // 1000 * 1000 AS BIGINT) AS at_least FROM {_N}",
    "micro_centroids": f"SELECT id, round(cx, {D}) AS cx, round(cy, {D}) AS cy FROM {_CENTRE}",
    "spring_step": f"""WITH s AS (SELECT n.id, x, y, cx, cy, community FROM {_N} n JOIN {_CENTRE} c ON c.id = n.id WHERE x IS NOT NULL AND y IS NOT NULL),
        e AS (SELECT source, target, 0.04 * weight * CASE WHEN a.community = b.community THEN 1.0 ELSE 0.5 END AS w, b.x - a.x AS dx, b.y - a.y AS dy FROM {ATLAS_EDGES} JOIN s a ON a.id = source JOIN s b ON b.id = target),
        f AS (SELECT id, sum(fx) AS fx, sum(fy) AS fy FROM (SELECT source AS id, w * dx AS fx, w * dy AS fy FROM e UNION ALL SELECT target, -w * dx, -w * dy FROM e) GROUP BY id),
        v AS (SELECT s.*, 0.05 * (coalesce(fx, 0) + 0.035 * (cx - x)) * 0.85 AS vx, 0.05 * (coalesce(fy, 0) + 0.035 * (cy - y)) * 0.85 AS vy FROM s LEFT JOIN f USING (id)),
        u AS (SELECT *, sqrt(vx * vx + vy * vy) + 1e-4 AS l FROM v)
        SELECT id, round(x + vx * least(l, 28.0) / l, {D}) AS x, round(y + vy * least(l, 28.0) / l, {D}) AS y FROM u""",
    "normalised_layout": f"""WITH c AS (SELECT id, x - median(x) OVER () AS x, y - median(y) OVER () AS y FROM {_N} WHERE x IS NOT NULL AND y IS NOT NULL), s AS (SELECT 3200 * 0.92 / quantile_cont(sqrt(x * x + y * y), 0.995) AS k FROM c)
        SELECT id, round(x * k * least(1.0, 3200 * 0.97 / greatest(1e-12, sqrt(x * x + y * y) * k)), {D}) AS x, round(y * k * least(1.0, 3200 * 0.97 / greatest(1e-12, sqrt(x * x + y * y) * k)), {D}) AS y FROM c, s""",
    "radius_pairs": f"SELECT a.id AS a, b.id AS b, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), {D}) AS d FROM {_N} a JOIN {_N} b ON a.id < b.id AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 40",
}
