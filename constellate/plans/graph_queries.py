"""Registered queries of the projection and graph operators, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from constellate.operators import graph as G
from constellate.operators import project as P
from constellate.operators.fill import bounded_links
from constellate.session import materialize
from constellate.plans.bindings import ATLAS_EDGES, BASKETS, NODES, SESSIONS, atlas_edges, baskets, nodes, sessions

R = 6  # decimals at which sums of doubles are compared


# ---- SQL building blocks -------------------------------------------------------------------------------------------


def _marginals_sql(src: str) -> str:
    return f"""(SELECT member, sum(1.0 / log2(greatest(2.0, CAST(n AS DOUBLE)))) AS damped, count(*) AS raw
        FROM {src} JOIN (SELECT container, count(*) AS n FROM {src} GROUP BY container) s USING (container) GROUP BY member)"""


def _projection_sql(src: str) -> str:
    return f"""(SELECT a.member AS i, b.member AS j, sum(1.0 / log2(greatest(2.0, CAST(n AS DOUBLE)))) AS damped, count(*) AS raw
        FROM {src} a JOIN {src} b ON a.container = b.container AND a.member < b.member
        JOIN (SELECT container, count(*) AS n FROM {src} GROUP BY container) s ON s.container = a.container GROUP BY 1, 2)"""


def _similar_sql(src: str, cutoff: float = 0.08) -> str:
    return f"""(SELECT i, j, p.damped / sqrt(x.damped * y.damped) AS similarity, p.raw, round(100.0 * p.raw / x.raw, 1) AS source_percent,
        round(100.0 * p.raw / y.raw, 1) AS target_percent
        FROM {_projection_sql(src)} p JOIN {_marginals_sql(src)} x ON x.member = i JOIN {_marginals_sql(src)} y ON y.member = j
        WHERE ((x.raw < 30 AND y.raw < 30) OR p.raw >= 2) AND p.damped / sqrt(x.damped * y.damped) >= CAST({cutoff} AS DOUBLE))"""


_INC = "(SELECT DISTINCT container, member FROM {})".format(BASKETS)
_SES = "(SELECT DISTINCT container, member FROM {})".format(SESSIONS)
_EDGES = _similar_sql(_INC)
_SES_EDGES = _similar_sql(_SES)


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return P.similar_members(baskets(spark, d), "container", "member")


def _session_edges(spark: SparkSession, d: str) -> DataFrame:
    return P.similar_members(sessions(spark, d), "container", "member")


# ---- projection ----------------------------------------------------------------------------------------------------


def cosine_edges(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d).select("i", "j", F.round("similarity", R).alias("similarity"), "raw", "source_percent", "target_percent",
                                   P.overlap(F.col("source_percent"), F.col("target_percent")).alias("overlap"))


def session_edges(spark: SparkSession, d: str) -> DataFrame:
    return _session_edges(spark, d).select("i", "j", F.round("similarity", R).alias("similarity"), "raw")


def projection(spark: SparkSession, d: str) -> DataFrame:
    return P.project(sessions(spark, d), "container", "member").select("i", "j", F.round("damped", R).alias("damped"), "raw")


def projection_units(spark: SparkSession, d: str) -> DataFrame:
    return P.shared_units(sessions(spark, d), "unit", "member")


def marginals(spark: SparkSession, d: str) -> DataFrame:
    return P.marginals(baskets(spark, d), "container", "member").select("member", F.round("damped", R).alias("damped"), "raw")


def degree_bounds(spark: SparkSession, d: str) -> DataFrame:
    return P.marginals(baskets(spark, d), "container", "member").select("member", P.degree_bound(F.round("damped", R)).alias("bound"))


def normalized_weight(spark: SparkSession, d: str) -> DataFrame:
    e = materialize(_edges(spark, d).select("i", "j", F.round("similarity", R).alias("similarity")), "edges")  # read twice
    return P.normalised_weight(e).select("i", "j", "weight")


def drawn_top6(spark: SparkSession, d: str) -> DataFrame:
    e = _edges(spark, d).withColumn("overlap", P.overlap(F.col("source_percent"), F.col("target_percent"))).select("i", "j", "overlap", "raw")
    return P.top_links(e, 6, [F.desc("overlap"), F.desc("raw"), F.asc("other")])


def drawn_links(spark: SparkSession, d: str) -> DataFrame:
    """Links drawn on the map: the six strongest of each node and all bridges."""
    e = atlas_edges(spark, d).withColumn("playlists", F.coalesce("playlists", F.lit(1)))
    top = P.top_links(e.select("source", "target", "weight", "playlists"), 6, [F.desc("weight"), F.desc("playlists"), F.asc("other")], "source", "target")
    return top.unionByName(e.where("isBridge").select("source", "target")).distinct()


def rank_protected_top4(spark: SparkSession, d: str) -> DataFrame:
    e = _edges(spark, d).select("i", "j", F.round("similarity", R).alias("similarity"))
    return P.top_links(e, 4, [F.desc("similarity"), F.asc("other")])


def strongest_k(spark: SparkSession, d: str) -> DataFrame:
    e = P.both_sides(atlas_edges(spark, d).select("source", "target", "weight"), "source", "target")
    from pyspark.sql import Window

    w = Window.partitionBy("node").orderBy(F.desc("weight"), F.desc("other"))
    return e.withColumn("rank", F.row_number().over(w)).where("rank <= 10").select("node", "other", "rank")


def supported_nodes(spark: SparkSession, d: str) -> DataFrame:
    return P.supported_members(sessions(spark, d), "container", "member", "unit", 2).select("i", "j", "raw")


# ---- graph ---------------------------------------------------------------------------------------------------------


def degree_bounded_graph(spark: SparkSession, d: str) -> DataFrame:
    return bounded_links(sessions(spark, d), "container", "member", lambda damped: P.degree_bound(F.round(damped, R)), 4, R)


_STRONG = "weight >= 0.25 AND NOT \"isBridge\""


def components(spark: SparkSession, d: str) -> DataFrame:
    e = atlas_edges(spark, d).where("weight >= 0.25 AND NOT isBridge")
    m = G.components(e, nodes(spark, d).select("id"), "source", "target")
    return m.join(G.component_sizes(m), "component").select("node", "component", "size")


def bridges_round1(spark: SparkSession, d: str) -> DataFrame:
    e = atlas_edges(spark, d).select(F.col("source").alias("i"), F.col("target").alias("j"), F.col("weight").alias("similarity"), "isBridge")
    return G.bridges(e.where("similarity >= 0.25 AND NOT isBridge"), e)


def bridges_all(spark: SparkSession, d: str) -> DataFrame:
    e = atlas_edges(spark, d).select(F.col("source").alias("i"), F.col("target").alias("j"), F.col("weight").alias("similarity"), "isBridge")
    return G.bridge_satellites(e.where("similarity >= 0.25 AND NOT isBridge"), e, smallest=2)


def shortest_strongest_path(spark: SparkSession, d: str) -> DataFrame:
    e = atlas_edges(spark, d)
    ends = nodes(spark, d).agg(F.min("id"), F.max("id")).first()
    return G.strongest_shortest_path(e, ends[0], ends[1]).select("hop", F.round("score", R).alias("score"))


def neighbourhood(spark: SparkSession, d: str) -> DataFrame:
    e = atlas_edges(spark, d)
    hub = P.both_sides(e.select("source", "target"), "source", "target").groupBy("node").count().agg(F.max_by("node", F.struct("count", "node"))).first()[0]
    return G.neighbourhood(e, hub).select("source", "target", "weight")


def induced_subgraph(spark: SparkSession, d: str) -> DataFrame:
    return G.induced(atlas_edges(spark, d), nodes(spark, d).where("continentId = 1").select("id")).select("source", "target", "weight")


def valid_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges whose ends are both known nodes."""
    return G.induced(atlas_edges(spark, d), nodes(spark, d).select("id")).select("source", "target")


def adjacency(spark: SparkSession, d: str) -> DataFrame:
    return P.both_sides(atlas_edges(spark, d).select("source", "target", "weight"), "source", "target").groupBy("node").agg(
        F.count(F.lit(1)).alias("degree"), F.round(F.sum("weight"), R).alias("strength"))


def _membership(spark: SparkSession, d: str) -> DataFrame:
    return nodes(spark, d).where("continentId IS NOT NULL").select(F.col("id").alias("node"), F.col("continentId").alias("community"))


def community_links(spark: SparkSession, d: str) -> DataFrame:
    return G.community_links(atlas_edges(spark, d), _membership(spark, d))


def community_affinity(spark: SparkSession, d: str) -> DataFrame:
    return G.affinity(atlas_edges(spark, d), _membership(spark, d), "source", "target").select("a", "b", F.round("affinity", R).alias("affinity"))


def top_affinities(spark: SparkSession, d: str) -> DataFrame:
    a = G.affinity(atlas_edges(spark, d), _membership(spark, d), "source", "target").withColumn("affinity", F.round("affinity", R)).where("affinity > 0.25")
    return P.top_links(a, 8, [F.desc("affinity"), F.asc("other")], "a", "b")


def modularity(spark: SparkSession, d: str) -> DataFrame:
    return G.modularity(atlas_edges(spark, d), _membership(spark, d), 1.0, "source", "target").select(F.round("modularity", R).alias("modularity"))


def _graph(spark: SparkSession, d: str) -> DataFrame:
    return atlas_edges(spark, d).select(F.col("source").alias("i"), F.col("target").alias("j"), "weight")


def louvain(spark: SparkSession, d: str) -> DataFrame:
    return G.communities(_graph(spark, d), 1.0, nodes(spark, d).select("id"))


def split_oversize(spark: SparkSession, d: str) -> DataFrame:
    return G.split_oversize(_graph(spark, d), G.communities(_graph(spark, d), 0.5), most=100, least=10)


def merge_communities(spark: SparkSession, d: str) -> DataFrame:
    return G.merge_communities(_graph(spark, d), G.communities(_graph(spark, d), 3.5), target=20, least=10, most=200)


def community_numbers(spark: SparkSession, d: str) -> DataFrame:
    return G.numbered(_membership(spark, d))


def connectivity(spark: SparkSession, d: str) -> DataFrame:
    """Whether the strong links and the bridges of all satellites make one graph of what they link."""
    e = atlas_edges(spark, d).where("weight >= 0.25 AND NOT isBridge").select(F.col("source").alias("i"), F.col("target").alias("j"))
    all_ = e.unionByName(bridges_all(spark, d).select("i", "j"))
    return G.connectivity(all_, all_.select(F.col("i").alias("id")))


def subclass_closure(spark: SparkSession, d: str) -> DataFrame:
    """Closure of the credited-in-a-stronger-playlist hierarchy: each artist's strongest neighbour of more subscribers."""
    from pyspark.sql import Window

    n = nodes(spark, d).select("id", F.coalesce("subscribers", F.lit(0)).alias("s"))
    e = P.both_sides(atlas_edges(spark, d).select("source", "target", "weight"), "source", "target")
    up = e.join(n.toDF("node", "s"), "node").join(n.toDF("other", "t"), "other").where("t > s")
    w = Window.partitionBy("node").orderBy(F.desc("weight"), "other")
    parent = up.withColumn("r", F.row_number().over(w)).where("r = 1").select("node", "other")
    return G.closure(parent, "node", "other")


QUERIES = {f.__name__: f for f in (
    cosine_edges, session_edges, projection, projection_units, marginals, degree_bounds, normalized_weight, drawn_top6, drawn_links, rank_protected_top4,
    strongest_k, supported_nodes, degree_bounded_graph, components, bridges_round1, bridges_all, shortest_strongest_path, neighbourhood, induced_subgraph,
    valid_edges, adjacency, community_links, community_affinity, top_affinities, modularity, louvain, split_oversize, merge_communities, community_numbers, connectivity, subclass_closure)}

_BOTH = f"(SELECT source AS node, target AS other, weight FROM {ATLAS_EDGES} UNION ALL SELECT target, source, weight FROM {ATLAS_EDGES})"
_MEMBER = f'(SELECT id AS node, "continentId" AS community FROM {NODES} WHERE "continentId" IS NOT NULL)'
_UNITS = f"(SELECT a.member AS i, b.member AS j, count(*) AS units FROM (SELECT DISTINCT unit, member FROM {SESSIONS}) a JOIN (SELECT DISTINCT unit, member FROM {SESSIONS}) b ON a.unit = b.unit AND a.member < b.member GROUP BY 1, 2)"


def _top(edges: str, k: int, order: str, i: str = "i", j: str = "j") -> str:
    return f"""SELECT DISTINCT least(node, other) AS {i}, greatest(node, other) AS {j} FROM (
        SELECT *, row_number() OVER (PARTITION BY node ORDER BY {order}) AS rn FROM (
          SELECT {i} AS node, {j} AS other, * FROM {edges} UNION ALL SELECT {j}, {i}, * FROM {edges})) WHERE rn <= {k}"""


_ROUNDED = f"(SELECT i, j, round(similarity, {R}) AS similarity FROM {_EDGES})"
_STRONG_E = f"(SELECT * FROM {ATLAS_EDGES} WHERE {_STRONG})"
# Components by propagating the least label; UNION stops at the fixpoint.
_COMP = f"""comp AS (
    WITH RECURSIVE reach(node, seen) AS (
      SELECT id, id FROM {NODES} UNION
      SELECT r.node, b.other FROM reach r JOIN (SELECT source AS node, target AS other FROM {_STRONG_E} UNION ALL SELECT target, source FROM {_STRONG_E}) b ON b.node = r.seen)
    SELECT node, min(seen) AS component FROM reach GROUP BY node)"""
_AFF = f"""(SELECT least(x.community, y.community) AS a, greatest(x.community, y.community) AS b, round(sum(weight), {R}) AS affinity
    FROM {ATLAS_EDGES} JOIN {_MEMBER} x ON x.node = source JOIN {_MEMBER} y ON y.node = target WHERE x.community <> y.community GROUP BY 1, 2)"""

_BRIDGES_ALL = f"""WITH RECURSIVE {_COMP}, linked AS (SELECT * FROM comp WHERE node IN (SELECT source FROM {_STRONG_E} UNION SELECT target FROM {_STRONG_E})),
        size AS (SELECT component, count(*) AS n FROM linked GROUP BY component), place AS (SELECT component, row_number() OVER (ORDER BY giant DESC, n, component) AS p FROM (
          SELECT *, component = (SELECT component FROM size ORDER BY n DESC, component LIMIT 1) AS giant FROM size) WHERE n >= 2),
        across AS (SELECT CASE WHEN a.p > b.p THEN a.component ELSE b.component END AS component, CASE WHEN a.p > b.p THEN b.component ELSE a.component END AS target, source AS i, e.target AS j, weight AS similarity
          FROM {ATLAS_EDGES} e JOIN linked x ON x.node = source JOIN linked y ON y.node = e.target JOIN place a ON a.component = x.component JOIN place b ON b.component = y.component WHERE a.p <> b.p),
        joined(c) AS (SELECT component FROM place WHERE p = 1 UNION SELECT a.component FROM joined JOIN across a ON a.target = c)
        SELECT component, i, j, greatest(similarity, 0.12) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY component ORDER BY similarity DESC, i, j) AS rn FROM across WHERE target IN (SELECT c FROM joined)) WHERE rn <= 3"""

ORACLES = {
    "cosine_edges": f"SELECT i, j, round(similarity, {R}) AS similarity, raw, source_percent, target_percent, round(sqrt(source_percent * target_percent), 1) AS overlap FROM {_EDGES}",
    "session_edges": f"SELECT i, j, round(similarity, {R}) AS similarity, raw FROM {_SES_EDGES}",
    "projection": f"SELECT i, j, round(damped, {R}) AS damped, raw FROM {_projection_sql(_SES)}",
    "projection_units": f"SELECT i, j, units FROM {_UNITS}",
    "marginals": f"SELECT member, round(damped, {R}) AS damped, raw FROM {_marginals_sql(_INC)}",
    "degree_bounds": f"SELECT member, CAST(least(24, greatest(4, floor(4 * sqrt(greatest(1.0, round(damped, {R})))))) AS BIGINT) AS bound FROM {_marginals_sql(_INC)}",
    "normalized_weight": f"SELECT i, j, round(0.06 + 0.94 * (similarity - lo) / (CASE WHEN hi > lo THEN hi - lo ELSE 1.0 END), 4) AS weight FROM (SELECT *, min(similarity) OVER () AS lo, max(similarity) OVER () AS hi FROM {_ROUNDED})",
    "drawn_top6": _top(f"(SELECT i, j, round(sqrt(source_percent * target_percent), 1) AS overlap, raw FROM {_EDGES})", 6, "overlap DESC, raw DESC, other"),
    "drawn_links": _top(f"(SELECT source, target, weight, coalesce(playlists, 1) AS playlists FROM {ATLAS_EDGES})", 6, "weight DESC, playlists DESC, other", "source", "target")
        + f' UNION SELECT source, target FROM {ATLAS_EDGES} WHERE "isBridge"',
    "rank_protected_top4": _top(_ROUNDED, 4, "similarity DESC, other"),
    "strongest_k": f"SELECT node, other, CAST(rn AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY weight DESC, other DESC) AS rn FROM {_BOTH}) WHERE rn <= 10",
    "supported_nodes": f"""WITH e AS (SELECT i, j, raw FROM {_SES_EDGES}), backed AS (SELECT e.* FROM e JOIN {_UNITS} u ON u.i = e.i AND u.j = e.j WHERE units >= 2),
        m AS (SELECT i AS m FROM backed UNION SELECT j FROM backed) SELECT i, j, raw FROM e WHERE i IN (SELECT m FROM m) AND j IN (SELECT m FROM m)""",
    "components": f"WITH {_COMP} SELECT node, component, CAST(count(*) OVER (PARTITION BY component) AS BIGINT) AS size FROM comp",
    "bridges_round1": f"""WITH {_COMP}, linked AS (SELECT * FROM comp WHERE node IN (SELECT source FROM {_STRONG_E} UNION SELECT target FROM {_STRONG_E})),
        size AS (SELECT component, count(*) AS n FROM linked GROUP BY component),
        giant AS (SELECT component AS g FROM size ORDER BY n DESC, component LIMIT 1),
        across AS (SELECT CASE WHEN x.component = g THEN y.component ELSE x.component END AS component, source AS i, target AS j, weight AS similarity
          FROM {ATLAS_EDGES} JOIN linked x ON x.node = source JOIN linked y ON y.node = target, giant WHERE (x.component = g) <> (y.component = g))
        SELECT component, i, j, similarity FROM (SELECT a.*, row_number() OVER (PARTITION BY a.component ORDER BY similarity DESC, i, j) AS rn
          FROM across a JOIN size USING (component) WHERE n >= 3) WHERE rn <= 3""",
    "bridges_all": _BRIDGES_ALL,
    "shortest_strongest_path": f"""WITH RECURSIVE ends AS (SELECT min(id) AS s, max(id) AS g FROM {NODES}), e AS (SELECT node, other, ln(weight) AS w FROM {_BOTH}),
        level(hop, node, score, seen) AS (
          SELECT 0, s, CAST(0.0 AS DOUBLE), [s] FROM ends UNION ALL
          SELECT hop, node, max(score), any_value(seen) FROM (
            SELECT l.hop + 1 AS hop, e.other AS node, l.score + e.w AS score, l.all_seen AS seen FROM (SELECT *, list_distinct(flatten(list(seen) OVER ())) || list(node) OVER () AS all_seen, max(CASE WHEN node = g THEN 1 ELSE 0 END) OVER () AS done FROM level, ends) l
            JOIN e ON e.node = l.node WHERE l.done = 0 AND NOT list_contains(l.all_seen, e.other)) GROUP BY hop, node),
        back(hop, node, score) AS (SELECT hop, node, score FROM level, ends WHERE node = g UNION ALL
          SELECT hop, node, score FROM (SELECT l.hop, l.node, l.score, row_number() OVER (PARTITION BY b.hop ORDER BY l.score + e.w DESC, l.node) AS r FROM back b JOIN level l ON l.hop = b.hop - 1 JOIN e ON e.node = l.node AND e.other = b.node) WHERE r = 1)
        SELECT hop, round(score, {R}) AS score FROM back""",
    "neighbourhood": f"""WITH hub AS (SELECT node FROM {_BOTH} GROUP BY node ORDER BY count(*) DESC, node DESC LIMIT 1)
        SELECT source, target, weight FROM {ATLAS_EDGES}, hub WHERE source = node OR target = node""",
    "induced_subgraph": f'WITH m AS (SELECT id FROM {NODES} WHERE "continentId" = 1) SELECT source, target, weight FROM {ATLAS_EDGES} WHERE source IN (SELECT id FROM m) AND target IN (SELECT id FROM m)',
    "valid_edges": f"SELECT source, target FROM {ATLAS_EDGES} WHERE source IN (SELECT id FROM atlas_nodes) AND target IN (SELECT id FROM atlas_nodes)",
    "adjacency": f"SELECT node, count(*) AS degree, round(sum(weight), {R}) AS strength FROM {_BOTH} GROUP BY node",
    "community_links": f"""SELECT DISTINCT c AS community, source, target FROM (
        SELECT x.community AS c, source, target FROM {ATLAS_EDGES} JOIN {_MEMBER} x ON x.node = source JOIN {_MEMBER} y ON y.node = target UNION ALL
        SELECT y.community, source, target FROM {ATLAS_EDGES} JOIN {_MEMBER} x ON x.node = source JOIN {_MEMBER} y ON y.node = target)""",
    "community_affinity": f"SELECT a, b, affinity FROM {_AFF}",
    "top_affinities": _top(f"(SELECT * FROM {_AFF} WHERE affinity > 0.25)", 8, "affinity DESC, other", "a", "b"),
    "modularity": f"""WITH e AS (SELECT x.community AS ca, y.community AS cb, weight AS w FROM {ATLAS_EDGES} JOIN {_MEMBER} x ON x.node = source JOIN {_MEMBER} y ON y.node = target),
        s AS (SELECT c, sum(w) AS s FROM (SELECT ca AS c, w FROM e UNION ALL SELECT cb, w FROM e) GROUP BY c)
        SELECT round((SELECT sum(w) FROM e WHERE ca = cb) / (sum(s) / 2) - sum(s * s) / (sum(s) * sum(s)), {R}) AS modularity FROM s""",
    "community_numbers": f"SELECT node, community, number FROM {_MEMBER} JOIN (SELECT community, row_number() OVER (ORDER BY count(*) DESC, community) AS number FROM {_MEMBER} GROUP BY 1) USING (community)",
    "degree_bounded_graph": f"""WITH RECURSIVE e AS (SELECT i, j, round(similarity, {R}) AS similarity FROM {_SES_EDGES}),
        m AS (SELECT member, row_number() OVER (ORDER BY member) AS k, CAST(least(24, greatest(4, floor(4 * sqrt(greatest(1.0, round(damped, {R})))))) AS BIGINT) AS bound FROM {_marginals_sql(_SES)}),
        kept AS ({_top('e', 4, 'similarity DESC, other')}),
        r AS (SELECT row_number() OVER (ORDER BY similarity DESC, i, j) AS n, i, j, a.k AS a, b.k AS b, a.bound AS x, b.bound AS y FROM e JOIN m a ON a.member = i JOIN m b ON b.member = j WHERE (i, j) NOT IN (SELECT (i, j) FROM kept)),
        ends AS (SELECT i AS member FROM kept UNION ALL SELECT j FROM kept),
        step(n, degree, ok, i, j) AS (
          SELECT CAST(0 AS BIGINT), (SELECT list(c ORDER BY k) FROM (SELECT k, count(ends.member) AS c FROM m LEFT JOIN ends USING (member) GROUP BY k)), false, CAST(NULL AS BIGINT), CAST(NULL AS BIGINT) UNION ALL
          SELECT n, CASE WHEN ok THEN list_transform(degree, lambda c, k: CASE WHEN k = a OR k = b THEN c + 1 ELSE c END) ELSE degree END, ok, i, j FROM (
            SELECT r.n, r.i, r.j, r.a, r.b, s.degree, s.degree[r.a] < r.x AND s.degree[r.b] < r.y AS ok FROM step s JOIN r ON r.n = s.n + 1))
        SELECT i, j FROM kept UNION ALL SELECT i, j FROM step WHERE ok""",
    "connectivity": f"""WITH RECURSIVE l AS (SELECT source AS a, target AS b FROM {_STRONG_E} UNION SELECT i, j FROM ({_BRIDGES_ALL})), both_ AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
        reach(node, seen) AS (SELECT a, a FROM both_ UNION SELECT r.node, x.b FROM reach r JOIN both_ x ON x.a = r.seen), c AS (SELECT node, min(seen) AS component FROM reach GROUP BY 1)
        SELECT count(DISTINCT component) AS components, count(DISTINCT component) <= 1 AS connected FROM c""",
    "subclass_closure": f"""WITH RECURSIVE n AS (SELECT id, coalesce(subscribers, 0) AS s FROM {NODES}),
        parent AS (SELECT node, other FROM (SELECT b.*, row_number() OVER (PARTITION BY node ORDER BY weight DESC, other) AS rn
          FROM {_BOTH} b JOIN n x ON x.id = node JOIN n y ON y.id = other WHERE y.s > x.s) WHERE rn = 1),
        up(child, ancestor, depth) AS (SELECT node, other, 1 FROM parent UNION ALL SELECT child, other, depth + 1 FROM up JOIN parent ON node = ancestor)
        SELECT child, ancestor, depth FROM up""",
}
