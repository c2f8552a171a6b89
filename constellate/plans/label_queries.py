"""Registered queries of the guards, identity and label operators, on the harvested lists, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from constellate.functions import text as X
from constellate.operators import harvest as H
from constellate.operators import identity as I
from constellate.operators import project as P
from constellate.operators import quality as Q
from constellate.operators import releases as E
from constellate.operators import report as T
from constellate.operators import votes as V
from constellate.plans.bindings import ATLAS_EDGES, NODES, PLAYLISTS, atlas_edges, nodes, playlists, table
from constellate.session import materialize
from constellate.plans.sql import compat, in_list, q
from constellate.plans.text_queries import _sanitise, content_sql, parts_sql, shown_sql, song_sql, split_sql

R = 6


def _tracks(spark: SparkSession, d: str) -> DataFrame:
    """One row per track of the latest harvest of each list."""
    p = playlists(spark, d).select("id", "genre", "source", "author_id", "anchor_id", "harvested_at", F.posexplode("tracks").alias("pos", "t"))
    return p.select("id", "genre", "source", "author_id", F.coalesce(F.nullif("anchor_id", F.lit("")), F.col("id")).alias("unit"), "harvested_at", "pos", "t.*")


def _members(spark: SparkSession, d: str) -> DataFrame:
    return _tracks(spark, d).where("artist_id is not null and artist_id != ''").select(F.col("id").alias("container"), F.col("artist_id").alias("member")).distinct()


def _containers(spark: SparkSession, d: str) -> DataFrame:
    return playlists(spark, d).select(F.col("id").alias("container"), F.coalesce("genre", F.lit("")).alias("label"), "source", "seed_genre",
                                      F.coalesce(F.nullif("anchor_id", F.lit("")), F.col("id")).alias("unit"), "layer", "title")


_TR = f"""(SELECT id, genre, source, author_id, coalesce(nullif(anchor_id, ''), id) AS unit, harvested_at, pos - 1 AS pos, t.*
    FROM (SELECT *, unnest(tracks) AS t, generate_subscripts(tracks, 1) AS pos FROM {PLAYLISTS}))"""
_M = f"(SELECT DISTINCT id AS container, artist_id AS member FROM {_TR} WHERE artist_id IS NOT NULL AND artist_id <> '')"
_C = f"(SELECT id AS container, coalesce(genre, '') AS label, source, seed_genre, coalesce(nullif(anchor_id, ''), id) AS unit, layer, title FROM {PLAYLISTS})"


# ---- guards --------------------------------------------------------------------------------------------------------


def system_lists(spark: SparkSession, d: str) -> DataFrame:
    return playlists(spark, d).select("id", X.is_system_list(F.col("title"), F.col("author"), F.col("id")).alias("system"))


def no_tracks(spark: SparkSession, d: str) -> DataFrame:
    return _tracks(spark, d).select("title").where("title is not null").distinct().select("title", X.is_no_track(F.col("title")).alias("no_track"))


def size_guard(spark: SparkSession, d: str) -> DataFrame:
    return Q.size_guard(_tracks(spark, d), "id", 10, 150)


def dominant_member_guard(spark: SparkSession, d: str) -> DataFrame:
    return Q.dominant_member_guard(_tracks(spark, d), "id", "artist_id", 0.25).select("id", F.round("share", R).alias("share"))


def curator_cap(spark: SparkSession, d: str) -> DataFrame:
    return Q.cap_per_key(playlists(spark, d).select("id", "author_id", "harvested_at"), "author_id", ["harvested_at", "id"], 2).select("id", "author_id")


def uploader_channels(spark: SparkSession, d: str) -> DataFrame:
    return Q.uploader_channels(_tracks(spark, d), "id", "artist_name", "title")


def consensus_members(spark: SparkSession, d: str) -> DataFrame:
    m = _members(spark, d).join(_containers(spark, d).where("source = 'search' and label != ''").select("container", "label"), "container")
    return Q.consensus(m, "label", "container", "member")


def copy_classes(spark: SparkSession, d: str) -> DataFrame:
    return Q.copies(_tracks(spark, d), "id", "videoId")[0]


def copy_links(spark: SparkSession, d: str) -> DataFrame:
    return Q.copies(_tracks(spark, d), "id", "videoId", 0.9)[1]


def _accepted(spark: SparkSession, d: str, at: str) -> DataFrame:
    membership, links = Q.copies(_tracks(spark, d), "id", "videoId", 0.9)
    rows = playlists(spark, d).select("id", F.struct(at, "id").alias("seq"), F.col("author_id").alias("curator"))
    # A copy is linked to the first of its class, and classes to classes.
    within = membership.where(F.col("id") != F.col("class")).select(F.col("class").alias("a"), F.col("id").alias("b"))
    return Q.accept_in_order(rows, links.select("a", "b").unionByName(within), 2)


def sequential_accept(spark: SparkSession, d: str) -> DataFrame:
    return _accepted(spark, d, "harvested_at")


def reload_replay(spark: SparkSession, d: str) -> DataFrame:
    """Lists that stay when stored ones are loaded again and the guards applied in the order of loading."""
    return _accepted(spark, d, "loaded_at").where("accepted").select("id")


def survivors(spark: SparkSession, d: str) -> DataFrame:
    t = _tracks(spark, d).where("artist_id is not null and artist_id != ''").select("artist_id", "unit").distinct()
    return t.groupBy("artist_id").agg(F.count(F.lit(1)).alias("units")).where("units >= 4")


def provenance(spark: SparkSession, d: str) -> DataFrame:
    c = _containers(spark, d)
    return c.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == "").alias("unlabelled"), F.count_if(F.col("layer") == 2).alias("second_layer"))


def budgeted_expansion(spark: SparkSession, d: str) -> DataFrame:
    c = _containers(spark, d).where("label != ''")
    have = c.where("source = 'search'").groupBy("label").agg(F.count(F.lit(1)).alias("have"))
    more = c.where("source = 'recommended'").join(have, "label").withColumn("budget", F.greatest(F.lit(0), 20 - F.col("have")))
    return Q.budgeted(more, "label", ["container"], "budget").select("label", "container")


def known_ids(spark: SparkSession, d: str) -> DataFrame:
    """Keys still to fetch: credited artists that neither the catalogue's channels nor frequent credits make known."""
    wanted = _tracks(spark, d).where("artist_id is not null and artist_id != ''").select(F.col("artist_id").alias("id"))
    known = table(spark, d, "artist_catalog").select(F.explode("credits.channel").alias("c")).where("c is not null").select(F.concat(F.lit("yt_"), "c").alias("id"))
    frequent = wanted.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n >= 5").select("id")
    return wanted.distinct().join(known, "id", "left_anti").join(frequent, "id", "left_anti")


# ---- identity ------------------------------------------------------------------------------------------------------


def _credits(spark: SparkSession, d: str) -> DataFrame:
    return _tracks(spark, d).where("artist_name is not null and artist_name != ''").select(
        F.col("id").alias("container"), F.lower(F.trim("artist_name")).alias("name"), F.coalesce("channel_id", F.lit("")).alias("channel"), "unit")


def _catalogue(spark: SparkSession, d: str) -> DataFrame:
    low = F.transform("credits", lambda c: F.struct(F.lower(F.trim(c["name"])).alias("name"), c["channel"].alias("channel")))
    return table(spark, d, "artist_catalog").select("id", "name", low.alias("credits"), "subscribers")


def credit_keys(spark: SparkSession, d: str) -> DataFrame:
    return I.credit_keys(_catalogue(spark, d))


def _resolved(spark: SparkSession, d: str) -> DataFrame:
    return I.resolve_credits(_credits(spark, d).select("container", "name", "channel").distinct(), I.credit_keys(_catalogue(spark, d)))


def credit_resolution(spark: SparkSession, d: str) -> DataFrame:
    return _resolved(spark, d).select("container", "name", "channel", "entity")


def joint_credits(spark: SparkSession, d: str) -> DataFrame:
    open_ = _resolved(spark, d).where("entity is null").select("name")
    return I.resolve_parts(open_, "name", I.credit_keys(_catalogue(spark, d)))


def tiered_name_match(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d).select(F.col("id").alias("target"), X.match_form(F.col("label")).alias("form"))
    c = table(spark, d, "artist_catalog").select(F.col("id").alias("candidate"), X.match_form(F.col("name")).alias("form"), F.coalesce("subscribers", F.lit(0)).alias("fans")).distinct()
    return I.tiered_name_match(n, c)


def shared_names(spark: SparkSession, d: str) -> DataFrame:
    return I.shared_names(_credits(spark, d).where("channel != ''"), 2)


def display_case(spark: SparkSession, d: str) -> DataFrame:
    t = _tracks(spark, d).where("artist_name is not null and artist_name != ''")
    return I.display_case(t, F.lower(F.trim("artist_name")), "artist_name", ["harvested_at", "id", "pos"])


def merged_entities(spark: SparkSession, d: str) -> DataFrame:
    r = _resolved(spark, d).where("entity is not null").select(F.col("entity").alias("id"), "name", "container")
    c = table(spark, d, "artist_catalog").select("id", F.coalesce("subscribers", F.lit(0)).alias("fans")).groupBy("id").agg(F.max("fans").alias("fans"))
    records = r.groupBy("id", "name").agg(F.collect_set("container").alias("units")).join(c, "id").withColumn("seq", F.dense_rank().over(Window.partitionBy("id").orderBy(F.desc("name"))))
    return I.merge_entities(records)


def vocabulary_match(spark: SparkSession, d: str) -> DataFrame:
    names = nodes(spark, d).select(F.explode("topSubgenres").alias("name"))
    g = table(spark, d, "genres")
    items = g.select(F.col("rank").alias("item"), F.col("genre").alias("label"), F.array(F.replace("genre", F.lit(" "), F.lit("")), F.substring_index("genre", " ", 1)).alias("aliases"))
    extra = names.select(F.replace("name", F.lit(" "), F.lit("")).alias("name"))
    return I.vocabulary_match(names.unionByName(extra), items)


def names_of_items(spark: SparkSession, d: str) -> DataFrame:
    return I.names_of_items(vocabulary_match(spark, d))


# ---- votes and tags ------------------------------------------------------------------------------------------------


def _search(spark: SparkSession, d: str) -> DataFrame:
    return _containers(spark, d).where("source = 'search' and label != ''").select("container", "label")


def evidence(spark: SparkSession, d: str) -> DataFrame:
    return V.evidence(_search(spark, d).join(_members(spark, d), "container"))


def core_labels(spark: SparkSession, d: str) -> DataFrame:
    return V.core_labels(evidence(spark, d)).select("member", "label", F.round("coverage", R).alias("coverage"), F.round("best", R).alias("best"))


def label_votes(spark: SparkSession, d: str) -> DataFrame:
    return V.votes(_members(spark, d), evidence(spark, d)).select("container", "label", F.round("votes", R).alias("votes"))


def label_votes_leave_one_out(spark: SparkSession, d: str) -> DataFrame:
    s = _search(spark, d)
    return V.votes(_members(spark, d).join(s.select("container"), "container", "left_semi"), evidence(spark, d), s).select("container", "label", F.round("votes", R).alias("votes"))


def judged_labels(spark: SparkSession, d: str) -> DataFrame:
    return V.judged_labels(_containers(spark, d).select("container", "label", "source"), _members(spark, d))


def seed_label(spark: SparkSession, d: str) -> DataFrame:
    seeds = _containers(spark, d).where("source = 'recommended'").select("container", F.col("seed_genre").alias("seed"))
    return V.seed_labels(seeds, _members(spark, d), V.core_labels(evidence(spark, d)))


def _lift(spark: SparkSession, d: str) -> DataFrame:
    return V.lift_table(_containers(spark, d).select("container", "unit", "label").join(_members(spark, d), "container"))


def lift_table(spark: SparkSession, d: str) -> DataFrame:
    return _lift(spark, d).select("member", "label", "c", F.round("lift", R).alias("lift"))


def lift_ranking(spark: SparkSession, d: str) -> DataFrame:
    return V.lift_ranking(_lift(spark, d).withColumn("lift", F.round("lift", R)))


def tag_tiers(spark: SparkSession, d: str) -> DataFrame:
    """Tags of catalogue entities from stated labels, judged and harvested labels."""
    m = materialize(_resolved(spark, d).where("entity is not null").select("container", F.col("entity").alias("member")).distinct(), "members")
    c = materialize(_containers(spark, d).select("container", "label", "source", "unit"), "containers")
    judged = materialize(V.judged_labels(c.select("container", "label", "source"), m), "judged")
    on = lambda labels: V.lift_ranking(V.lift_table(labels.join(m, "container")).withColumn("lift", F.round("lift", R)))
    consensus = on(c.select("container", "unit").join(judged.withColumnRenamed("judged", "label"), "container"))
    fallback = on(c.select("container", "unit", "label"))
    carrying = c.where("label != ''").select("container", "label").join(m, "container").groupBy("member", "label").agg(F.count(F.lit(1)).alias("n"))
    stated = nodes(spark, d).select(F.col("id").alias("member"), F.explode("topSubgenres").alias("label"))
    ranks = table(spark, d, "genres").select(F.col("genre").alias("label"), F.col("rank").alias("place"))
    t = V.tag_tiers(stated, carrying, consensus, fallback, ranks)
    return t.select("member", F.array_join("tags", "|").alias("tags"), "source")


def neighbour_check(spark: SparkSession, d: str) -> DataFrame:
    """Node tags checked against those of the strongest neighbours."""
    n = nodes(spark, d).select(F.col("id").alias("member"), F.coalesce("topSubgenres", F.array().cast("array<string>")).alias("tags"))
    w = Window.partitionBy("node").orderBy(F.desc("weight"), F.desc("other"))
    near = P.both_sides(atlas_edges(spark, d).select("source", "target", "weight"), "source", "target").withColumn("rank", F.row_number().over(w)).select(F.col("node").alias("member"), "other", "rank")
    stated = n.select("member", F.posexplode("tags").alias("place", "label"))
    m = _resolved(spark, d).where("entity is not null").select("container", F.col("entity").alias("member")).distinct()
    lifts = V.lift_table(_containers(spark, d).select("container", "label", "unit").join(m, "container"))
    sure = H.confirmed_facts(stated, lifts.withColumn("lift", F.round("lift", R)))
    return V.neighbour_check(n, near, sure, stated).select("member", F.array_join("tags", "|").alias("tags"))


def anchors(spark: SparkSession, d: str) -> DataFrame:
    s = _containers(spark, d).where("source = 'search' and label != ''").select(
        "container", "label", F.contains(X.phrase_form(F.col("title")), X.phrase_form(F.col("label"))).cast("int").alias("named"))
    size = s.groupBy("label").agg(F.count(F.lit(1)).alias("size"), F.sum("named").alias("named_size"))
    m = s.join(_members(spark, d), "container").groupBy("label", "member").agg(F.count(F.lit(1)).alias("n"), F.sum("named").alias("named"))
    t = _tracks(spark, d).where("artist_id != '' and videoId is not null").select(F.col("id").alias("container"), F.col("artist_id").alias("member"), F.col("videoId").alias("song")).distinct()
    songs = s.join(t, "container").groupBy("label", "member", "song").agg(F.count(F.lit(1)).alias("n"), F.sum("named").alias("named"))
    return V.anchors(m.join(size, "label"), songs, 15)


def round_robin_anchors(spark: SparkSession, d: str) -> DataFrame:
    c = _containers(spark, d).where("source != 'search' and label != ''").select("container", "label", "unit")
    size = _members(spark, d).groupBy("container").agg(F.count(F.lit(1)).alias("size"))
    return V.round_robin(c.join(size, "container"), "label", "unit", [F.desc("size"), F.asc("container")], 10).select("label", "container", "place")


def related_anchors(spark: SparkSession, d: str) -> DataFrame:
    """Each label's own lists that clearly belong to it when judged without themselves, the strongest first."""
    s, m = _search(spark, d), _members(spark, d)
    own = V.ranked_votes(V.votes(m.join(s.select("container"), "container", "left_semi"), evidence(spark, d), s), m)
    b = own.where(V.clear()).join(s, ["container", "label"], "left_semi").withColumn("score", F.round(F.col("votes") / F.col("size"), R))
    rank = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("score"), "container"))
    return b.withColumn("rank", rank).where("rank <= 10").select("label", "container", "score", "rank")


def community_titles(spark: SparkSession, d: str) -> DataFrame:
    """Communities named by the three labels that cover them best for their coverage in all."""
    from constellate.functions.scalars import title_score

    n = nodes(spark, d).where("continentId is not null").select("id", F.col("continentId").alias("community"), F.col("topSubgenres").alias("tags"))
    tags = T.member_tags(n)
    every = n.agg(F.count(F.lit(1)).alias("n")).scalar()
    overall = tags.groupBy("tag").agg(F.count(F.lit(1)).alias("all"))
    size = n.groupBy("community").agg(F.count(F.lit(1)).alias("size"))
    c = tags.join(n.select("id", "community"), "id").groupBy("community", "tag").agg(F.count(F.lit(1)).alias("n")).join(overall, "tag").join(size, "community")
    c = c.withColumn("score", F.round(title_score(F.col("n") / F.col("size"), F.col("all") / every), 9))
    rank = F.row_number().over(Window.partitionBy("community").orderBy(F.desc("score"), F.desc("n"), "tag"))
    top = c.withColumn("rank", rank).where("rank <= 3").groupBy("community").agg(F.array_sort(F.collect_list(F.struct("rank", "tag"))).alias("t"))
    return top.select("community", F.array_join(F.transform("t", lambda x: X.display_name(x["tag"])), " / ").alias("title"))


def _official(spark: SparkSession, d: str) -> DataFrame:
    t = _tracks(spark, d).where("channel_id is not null and channel_id != '' and artist_name is not null and title is not null")
    return t.select(F.lower("artist_name").alias("name"), X.song_key(F.col("title")).alias("song")).distinct()


def frequent_titles(spark: SparkSession, d: str) -> DataFrame:
    t = _tracks(spark, d).where("artist_id like 'name_%'")
    return E.frequent_titles(t, "artist_id").select("artist_id", "title", "n", "rank")


def song_votes(spark: SparkSession, d: str) -> DataFrame:
    """Votes of each name's first five songs, in the order of their most frequent titles."""
    t = _tracks(spark, d).where("artist_id like 'name_%'")
    titles = E.frequent_titles(t, "artist_id", k=None).groupBy(F.col("artist_id").alias("name"), X.song_key(F.col("title")).alias("song")).agg(F.min("rank").alias("rank"))
    return E.song_votes(titles, _official(spark, d).withColumnRenamed("name", "artist"))


def credit_by_title(spark: SparkSession, d: str) -> DataFrame:
    t = _tracks(spark, d).where("(channel_id is null or channel_id = '') and artist_name is not null and artist_name != ''").where(F.contains("title", F.lit(" - ")))
    return E.credit_by_title(t, _official(spark, d))


def shared_word_match(spark: SparkSession, d: str) -> DataFrame:
    words = lambda t, key: t.groupBy(key.alias("k"), F.lower(F.trim("artist_name")).alias("name")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set(X.content_words(F.col("title")))))).alias("words"))
    t = _tracks(spark, d).where("artist_name is not null and artist_name != '' and title is not null")
    targets = words(t.where("artist_id like 'name_%'"), F.col("artist_id")).withColumnRenamed("k", "target")
    known = words(t.where("artist_id like 'yt_%'"), F.col("artist_id")).withColumnRenamed("k", "candidate").withColumn("fans", F.size("words"))
    return E.by_shared_words(targets, known)


def competitors(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d).select("id", X.match_form(F.col("label")).alias("form"), F.coalesce("subscribers", F.lit(0)).alias("fans"))
    return E.competitors(n.where("form != ''").select(F.col("id").alias("target"), "form"), n.withColumnRenamed("id", "candidate"))


QUERIES = {f.__name__: f for f in (
    related_anchors, community_titles, frequent_titles, song_votes, credit_by_title, shared_word_match, competitors, system_lists, no_tracks, size_guard, dominant_member_guard, curator_cap, uploader_channels, consensus_members, copy_classes, copy_links, sequential_accept, reload_replay,
    survivors, provenance, budgeted_expansion, known_ids, credit_keys, credit_resolution, joint_credits, tiered_name_match, shared_names, display_case, merged_entities,
    vocabulary_match, names_of_items, evidence, core_labels, label_votes, label_votes_leave_one_out, judged_labels, seed_label, lift_table, lift_ranking, tag_tiers,
    neighbour_check, anchors, round_robin_anchors)}

_S = f"(SELECT container, label FROM {_C} WHERE source = 'search' AND label <> '')"
_EV = f"""(SELECT member, label, n, size FROM (SELECT member, label, count(*) AS n FROM {_S} JOIN {_M} USING (container) GROUP BY 1, 2)
    JOIN (SELECT label, count(DISTINCT container) AS size FROM {_S} JOIN {_M} USING (container) GROUP BY 1) USING (label))"""
_CORE = f"(SELECT member, label, n / size AS coverage, max(n / size) OVER (PARTITION BY member) AS best FROM {_EV} WHERE n >= 2)"


def _votes(members: str, ev: str, own: str | None = None) -> str:
    less = "CASE WHEN o.label = e.label THEN 1 ELSE 0 END" if own else "0"
    join = f"LEFT JOIN {own} o USING (container)" if own else ""
    return f"""(SELECT container, label, sum(share / total) AS votes FROM (
        SELECT *, sum(share) OVER (PARTITION BY container, member) AS total FROM (
          SELECT container, member, e.label AS label, (n - {less}) / (size - {less}) AS share FROM {members} JOIN {ev} e USING (member) {join} WHERE n - {less} >= 2)) GROUP BY 1, 2)"""


_SIZE = f"(SELECT container, count(*) AS size FROM {_M} GROUP BY container)"


def _ranked(v: str, size: str) -> str:
    return f"""(SELECT *, CASE WHEN rk = 1 THEN coalesce(max(CASE WHEN rk = 2 THEN votes END) OVER (PARTITION BY container), 0.0)
        ELSE max(CASE WHEN rk = 1 THEN votes END) OVER (PARTITION BY container) END AS rival
        FROM (SELECT v.*, size, row_number() OVER (PARTITION BY container ORDER BY votes DESC, label) AS rk FROM {v} v JOIN {size} z USING (container)))"""


_CLEAR = "size >= 5 AND votes / size >= 0.15 AND votes >= 1.5 * rival"


def _judged(m: str, c: str) -> str:
    s = f"(SELECT container, label FROM {c} WHERE source = 'search' AND label <> '')"
    ev = f"""(SELECT member, label, n, size FROM (SELECT member, label, count(*) AS n FROM {s} JOIN {m} USING (container) GROUP BY 1, 2)
        JOIN (SELECT label, count(DISTINCT container) AS size FROM {s} JOIN {m} USING (container) GROUP BY 1) USING (label))"""
    size = f"(SELECT container, count(*) AS size FROM {m} GROUP BY container)"
    own = _ranked(_votes(f"(SELECT * FROM {m} SEMI JOIN {s} USING (container))", ev, s), size)
    rec = _ranked(_votes(f"(SELECT * FROM {m} SEMI JOIN (SELECT container FROM {c} WHERE source = 'recommended') USING (container))", ev), size)
    return f"""(SELECT container, CASE WHEN source IN ('search', 'recommended') THEN coalesce(v.judged, '') ELSE label END AS judged FROM {c} LEFT JOIN (
        SELECT container, label AS judged FROM {own} SEMI JOIN {s} USING (container, label) WHERE {_CLEAR} UNION ALL
        SELECT container, label FROM {rec} WHERE rk = 1 AND {_CLEAR}) v USING (container))"""


def _lift_sql(rows: str) -> str:
    d = f"(SELECT member, label, count(*) AS c FROM (SELECT DISTINCT unit, label, member FROM {rows} WHERE label <> '') GROUP BY 1, 2)"
    return f"""(SELECT member, label, c, round(c * sum(c) OVER () / (sum(c) OVER (PARTITION BY member) * sum(c) OVER (PARTITION BY label)), {R}) AS lift FROM {d})"""


def _ranking(lifts: str) -> str:
    return f"""(SELECT member, label, CAST(row_number() OVER (PARTITION BY member ORDER BY lift DESC, c DESC, label DESC) AS INT) AS rank FROM (
        SELECT *, max(lift) OVER (PARTITION BY member) AS top FROM (SELECT *, max(c) OVER (PARTITION BY member) AS most FROM {lifts}) WHERE c >= greatest(2.0, 0.1 * most))
        WHERE lift >= 1 AND lift >= 0.5 * top)"""


_CRED = f"""(SELECT DISTINCT id AS container, lower(trim(artist_name)) AS name, coalesce(channel_id, '') AS channel, unit FROM {_TR} WHERE artist_name IS NOT NULL AND artist_name <> '')"""
_KEYS0 = "(SELECT name, channel, max(id) AS id FROM (SELECT id, lower(trim(c.name)) AS name, c.channel AS channel FROM (SELECT id, unnest(credits) AS c FROM artist_catalog)) WHERE name IS NOT NULL GROUP BY 1, 2)"
_KEYS = f"""(SELECT * FROM {_KEYS0} UNION ALL SELECT lower(trim(name)), NULL, min(id) FROM artist_catalog WHERE lower(trim(name)) NOT IN (SELECT name FROM {_KEYS0}) GROUP BY 1 HAVING count(DISTINCT id) = 1)"""
_RES = f"""(SELECT c.container, c.name, c.channel, coalesce(x.id, a.id) AS entity FROM (SELECT DISTINCT container, name, channel FROM {_CRED}) c
    LEFT JOIN (SELECT * FROM {_KEYS} WHERE channel IS NOT NULL) x ON x.name = c.name AND x.channel = c.channel LEFT JOIN (SELECT * FROM {_KEYS} WHERE channel IS NULL) a ON a.name = c.name)"""


def _match_sql(col: str) -> str:
    return f"trim(trim(trim(lower(strip_accents({compat(f'translate({col}, ' + q('яЯ$øØ') + ', ' + q('rrsoo') + ')')}))), '.'))"


def _tier_keys(src: str, cols: str) -> str:
    letters, bare = "regexp_replace(form, '[^\\p{L}\\p{N}]+', '', 'g')", "trim(regexp_replace(form, '^(?:the|a)\\s+', ''))"
    return f"""(SELECT {cols}, 1 AS tier, form AS key FROM {src} WHERE form <> '' UNION ALL SELECT {cols}, 2, {letters} FROM {src} WHERE length({letters}) >= 3
        UNION ALL SELECT {cols}, 3, {bare} FROM {src} WHERE length({bare}) >= 3)"""


_TARGETS = f"(SELECT id AS target, coalesce({_match_sql('label')}, '') AS form FROM {NODES})"
_CANDS = f"(SELECT DISTINCT id AS candidate, coalesce({_match_sql('name')}, '') AS form, coalesce(subscribers, 0) AS fans FROM artist_catalog)"
_VOC = f"""(SELECT name, item, matched FROM (SELECT DISTINCT name FROM (SELECT unnest("topSubgenres") AS name FROM {NODES} UNION ALL SELECT replace(n, ' ', '') FROM (SELECT unnest("topSubgenres") AS n FROM {NODES}))) JOIN (
    SELECT genre AS name, min(rank) AS item, 'label' AS matched FROM genres GROUP BY 1 HAVING count(*) = 1 UNION ALL
    SELECT name, min(item), 'alias' FROM (SELECT DISTINCT unnest([replace(genre, ' ', ''), split_part(genre, ' ', 1)]) AS name, rank AS item FROM genres)
      WHERE name NOT IN (SELECT genre FROM genres) GROUP BY 1 HAVING count(*) = 1) USING (name))"""
_SETS = f'(SELECT DISTINCT id AS c, "videoId" AS x FROM {_TR} WHERE "videoId" IS NOT NULL)'
_CLASS = f"(SELECT c AS id, min(c) OVER (PARTITION BY xs) AS class FROM (SELECT c, list(x ORDER BY x) AS xs FROM {_SETS} GROUP BY c))"
_NEAR = f"(SELECT member, other, row_number() OVER (PARTITION BY member ORDER BY weight DESC, other DESC) AS rank FROM (SELECT source AS member, target AS other, weight FROM {ATLAS_EDGES} UNION ALL SELECT target, source, weight FROM {ATLAS_EDGES}))"
_PHRASE = lambda x: f"' ' || trim(regexp_replace(strip_accents(lower({compat(f'coalesce({x}, ' + q('') + ')')})), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) || ' '"
_NAMED = f"(SELECT container, label, CAST(contains({_PHRASE('title')}, {_PHRASE('label')}) AS INT) AS named FROM {_C} WHERE source = 'search' AND label <> '')"
_SYS_T = "lower(trim(coalesce(title, '')))"

_OFF = f"""(SELECT DISTINCT lower(artist_name) AS name, lower(trim({compat("regexp_split_to_array(title, '(?i)\\s*[\\(\\[【]|\\s+(?:ft\\.?|feat\\.?)\\s+')[1]")})) AS song
    FROM {_TR} WHERE channel_id <> '' AND artist_name IS NOT NULL AND title IS NOT NULL)"""
_FREQ = f"""(SELECT artist_id, title, n, CAST(row_number() OVER (PARTITION BY artist_id ORDER BY n DESC, title) AS INT) AS rank FROM (SELECT artist_id, title, count(*) AS n FROM {_TR} WHERE starts_with(artist_id, 'name_') AND title IS NOT NULL GROUP BY 1, 2))"""
_TITLE_SONG = f"""lower(trim({compat("regexp_split_to_array(title, '(?i)\\s*[\\(\\[【]|\\s+(?:ft\\.?|feat\\.?)\\s+')[1]")}))"""
_TAGS = f'(SELECT DISTINCT id, community, unnest(tags) AS tag FROM (SELECT id, "continentId" AS community, "topSubgenres" AS tags FROM {NODES} WHERE "continentId" IS NOT NULL))'
_SHOWN = shown_sql("tag")

def _accept_sql(order: str) -> str:
    """Acceptance row by row in an order: no copies of accepted rows, two of each curator."""
    return f"""WITH RECURSIVE sets AS (SELECT id, list_sort(list(DISTINCT "videoId")) AS xs FROM {_TR} WHERE "videoId" IS NOT NULL GROUP BY 1),
        p AS (SELECT id, coalesce(author_id, '?') AS curator, row_number() OVER (ORDER BY {order}, id) AS n FROM {PLAYLISTS}),
        item AS (SELECT id, unnest(xs) AS v, len(xs) AS n FROM sets),
        pairs AS (SELECT a.id AS x, b.id AS y FROM item a JOIN item b ON a.v = b.v AND a.id < b.id GROUP BY a.id, b.id, a.n, b.n HAVING count(*) >= 0.9 * least(a.n, b.n) - 1e-9),
        class AS (SELECT id, min(id) OVER (PARTITION BY xs) AS head FROM sets),
        linked AS (SELECT x, y FROM pairs WHERE x IN (SELECT head FROM class) AND y IN (SELECT head FROM class) UNION SELECT head, id FROM class WHERE head <> id),
        near AS (SELECT id, list(o) AS others FROM (SELECT x AS id, y AS o FROM linked UNION SELECT y, x FROM linked) GROUP BY 1),
        row AS (SELECT p.n, p.id, p.curator, coalesce(others, []) AS others FROM p LEFT JOIN near USING (id)),
        step(n, accepted, curators, ok, id) AS (
          SELECT CAST(0 AS BIGINT), CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]), false, '' UNION ALL
          SELECT n, CASE WHEN ok THEN list_append(accepted, id) ELSE accepted END, CASE WHEN ok THEN list_append(curators, curator) ELSE curators END, ok, id FROM (
            SELECT r.n, r.id, r.curator, s.accepted, s.curators, NOT list_has_any(r.others, s.accepted) AND len(list_filter(s.curators, lambda c: c = r.curator)) < 2 AS ok FROM step s JOIN row r ON r.n = s.n + 1))
        SELECT id, ok AS accepted FROM step WHERE n > 0"""


ORACLES = {
    "related_anchors": f"""SELECT label, container, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, container) AS rank FROM (
        SELECT label, container, round(votes / size, {R}) AS score FROM {_ranked(_votes(f'(SELECT * FROM {_M} SEMI JOIN {_S} USING (container))', _EV, _S), _SIZE)} SEMI JOIN {_S} USING (container, label) WHERE {_CLEAR})) WHERE rank <= 10""",
    "community_titles": f"""WITH t AS (SELECT * FROM {_TAGS}), n AS (SELECT id, "continentId" AS community FROM {NODES} WHERE "continentId" IS NOT NULL),
        c AS (SELECT community, tag, n, round(pow(n / size, 0.8) * ln(1 + (n / size) / ("all" / (SELECT count(*) FROM n) + 0.02)), 9) AS score FROM (SELECT community, tag, count(*) AS n FROM t GROUP BY 1, 2)
          JOIN (SELECT tag, count(*) AS "all" FROM t GROUP BY 1) USING (tag) JOIN (SELECT community, count(*) AS size FROM n GROUP BY 1) USING (community))
        SELECT community, string_agg({_SHOWN}, ' / ' ORDER BY rank) AS title FROM (SELECT *, row_number() OVER (PARTITION BY community ORDER BY score DESC, n DESC, tag) AS rank FROM c) WHERE rank <= 3 GROUP BY community""",
    "merged_entities": f"""WITH r AS (SELECT entity AS id, name, container FROM {_RES} WHERE entity IS NOT NULL), c AS (SELECT id, max(coalesce(subscribers, 0)) AS fans FROM artist_catalog GROUP BY 1)
        SELECT id, max(name) AS name, max(fans) AS fans, count(DISTINCT container) AS units, count(DISTINCT name) AS records FROM r JOIN c USING (id) GROUP BY id""",
    "joint_credits": f"""WITH k AS (SELECT * FROM {_KEYS}), open AS (SELECT DISTINCT name AS raw FROM {_RES} WHERE entity IS NULL), p AS (SELECT raw, lower(trim(unnest({split_sql('raw')}))) AS name FROM open)
        SELECT DISTINCT raw AS name, coalesce(x.id, a.id) AS entity FROM p LEFT JOIN (SELECT name, id FROM k WHERE channel = '') x USING (name) LEFT JOIN (SELECT name, id FROM k WHERE channel IS NULL) a USING (name)
        WHERE name <> lower(trim(raw)) AND coalesce(x.id, a.id) IS NOT NULL""",
    "credit_by_title": f"""WITH t AS (SELECT id, CAST(pos AS INTEGER) AS pos, trim(regexp_replace(trim(left(title, instr(title, ' - ') - 1)), '^\\d+[\\.\\-_–—]+\\s*', '')) AS l,
          trim(regexp_split_to_array(substr(title, instr(title, ' - ') + 3), '\\s+[-|/]+\\s+|\\s*[\\(\\[【]')[1]) AS r FROM {_TR}
          WHERE coalesce(channel_id, '') = '' AND artist_name <> '' AND contains(title, ' - ')), o AS (SELECT * FROM {_OFF}),
        s AS (SELECT id, pos, 1 AS tier, {song_sql('r')} AS song, {parts_sql('l')} AS parts FROM t UNION ALL SELECT id, pos, 2, {song_sql('l')}, {parts_sql('r')} FROM t),
        b AS (SELECT id, pos, tier, spot, part FROM (SELECT id, pos, tier, song, unnest(parts) AS part, generate_subscripts(parts, 1) AS spot FROM s) WHERE (lower(part), song) IN (SELECT (name, song) FROM o)),
        w AS (SELECT id, pos, 3 AS tier, 0 AS spot, {_sanitise(f"trim({compat('l')})")} AS part FROM t),
        e AS (SELECT * FROM b UNION ALL SELECT * FROM w WHERE lower(part) IN (SELECT name FROM o) AND (id, pos) NOT IN (SELECT (id, pos) FROM (SELECT id, pos, unnest(parts) AS p FROM s WHERE tier = 2) WHERE lower(p) IN (SELECT name FROM o)))
        SELECT id, pos, coalesce(credit, '') AS credit FROM t LEFT JOIN (SELECT id, pos, arg_min(part, (tier, spot)) AS credit FROM e GROUP BY 1, 2) USING (id, pos)""",
    "shared_word_match": f"""WITH w AS (SELECT artist_id, name, list_distinct(flatten(list(words))) AS words FROM (SELECT artist_id, lower(trim(artist_name)) AS name, {content_sql('title')} AS words FROM {_TR}
          WHERE artist_name <> '' AND title IS NOT NULL) GROUP BY 1, 2), c AS (SELECT t.artist_id AS target, k.artist_id AS candidate, t.words, len(list_intersect(t.words, k.words)) AS shared, len(k.words) AS fans, t.name
          FROM w t JOIN w k USING (name) WHERE starts_with(t.artist_id, 'name_') AND starts_with(k.artist_id, 'yt_'))
        SELECT target, candidate, CAST(shared AS INTEGER) AS shared FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY shared DESC, fans DESC, candidate) AS r FROM c
          WHERE shared >= CASE WHEN len(words) = 0 THEN 0 WHEN contains(name, ' ') THEN 1 ELSE 2 END) WHERE r = 1""",
    "sequential_accept": _accept_sql("harvested_at"),
    "reload_replay": f"SELECT id FROM ({_accept_sql('loaded_at')}) WHERE accepted",
    "frequent_titles": f"SELECT artist_id, title, n, rank FROM {_FREQ} WHERE rank <= 5",
    "song_votes": f"""WITH s AS (SELECT name, song FROM (SELECT artist_id AS name, {_TITLE_SONG} AS song, min(rank) AS rank FROM {_FREQ} GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY name ORDER BY rank, song) <= 5),
        v AS (SELECT s.name, o.name AS artist, count(DISTINCT song) AS votes FROM s JOIN {_OFF} o USING (song) GROUP BY 1, 2), b AS (SELECT *, max(votes) OVER (PARTITION BY name) AS best FROM v),
        w AS (SELECT *, count(*) OVER (PARTITION BY name) AS ties FROM b WHERE votes = best)
        SELECT name, artist, votes FROM w JOIN (SELECT name, count(*) AS songs FROM s GROUP BY 1) USING (name) WHERE ties = 1 AND votes >= least(2, songs)""",
    "competitors": f"""WITH n AS (SELECT id, coalesce({_match_sql('label')}, '') AS form, coalesce(subscribers, 0) AS fans FROM {NODES}),
        t AS (SELECT * FROM n WHERE form <> '')
        SELECT target, candidate FROM (SELECT t.id AS target, w.id AS candidate, row_number() OVER (PARTITION BY t.id ORDER BY w.fans DESC, w.id) AS r FROM t JOIN n w
          ON w.fans > 0 AND w.form <> t.form AND (ends_with(w.form, t.form) OR list_contains(regexp_extract_all(w.form, '[a-zA-Z0-9]+'), t.form))) WHERE r <= 5""",
    "system_lists": f"""SELECT id, contains(lower(id), 'rdclak') OR lower(trim(coalesce(author, ''))) IN {in_list(X.SYSTEM_AUTHORS)}
        OR {' OR '.join(f"contains(lower(id), {q(t)}) OR contains({_SYS_T}, {q(t)})" for t in X.SYSTEM_TOKENS)}
        OR {' OR '.join(f"regexp_matches({_SYS_T}, {q(t)})" for t in X.SYSTEM_TITLES)} AS system FROM {PLAYLISTS}""",
    "no_tracks": f"SELECT title, regexp_matches(title, {q('(?i)' + '|'.join(X.NO_TRACK_TITLES))}) AS no_track FROM (SELECT DISTINCT title FROM {_TR} WHERE title IS NOT NULL)",
    "size_guard": f"SELECT id, count(*) AS n FROM {_TR} GROUP BY id HAVING count(*) BETWEEN 10 AND 150",
    "dominant_member_guard": f"SELECT id, round(max(n) / sum(n), {R}) AS share FROM (SELECT id, artist_id, count(*) AS n FROM {_TR} WHERE artist_id <> '' GROUP BY 1, 2) GROUP BY id HAVING max(n) / sum(n) <= 0.25",
    "curator_cap": f"SELECT id, author_id FROM (SELECT id, author_id, row_number() OVER (PARTITION BY author_id ORDER BY harvested_at NULLS FIRST, id) AS r FROM {PLAYLISTS}) WHERE r <= 2",
    "uploader_channels": f"""SELECT id, channel, count(*) AS prefixes FROM (SELECT DISTINCT id, lower(trim(artist_name)) AS channel, lower(trim(split_part(title, ' - ', 1))) AS prefix FROM {_TR} WHERE contains(title, ' - '))
        WHERE channel <> '' AND prefix <> '' AND prefix <> channel GROUP BY 1, 2 HAVING count(*) >= 2""",
    "consensus_members": f"""WITH m AS (SELECT label, container, member FROM {_M} JOIN {_S} USING (container)), shared AS (SELECT label, member FROM m GROUP BY 1, 2 HAVING count(*) >= 2)
        SELECT label, container, count(*) AS score FROM m SEMI JOIN shared USING (label, member) GROUP BY 1, 2 UNION ALL SELECT DISTINCT label, container, 0 FROM m WHERE label NOT IN (SELECT label FROM shared)""",
    "copy_classes": f"SELECT id, class FROM {_CLASS}",
    "copy_links": f"""WITH s AS (SELECT c, x FROM {_SETS} SEMI JOIN (SELECT class AS c FROM {_CLASS}) USING (c)), n AS (SELECT c, count(*) AS n FROM s GROUP BY c)
        SELECT a, b, shared, p.n AS n_a, r.n AS n_b FROM (SELECT y.c AS a, z.c AS b, count(*) AS shared FROM s y JOIN s z ON y.x = z.x AND y.c < z.c GROUP BY 1, 2)
        JOIN n p ON p.c = a JOIN n r ON r.c = b WHERE shared >= 0.9 * least(p.n, r.n) - 1e-9""",
    "survivors": f"SELECT artist_id, count(DISTINCT unit) AS units FROM {_TR} WHERE artist_id <> '' GROUP BY 1 HAVING count(DISTINCT unit) >= 4",
    "provenance": f"SELECT source, count(*) AS n, count(*) FILTER (label = '') AS unlabelled, count(*) FILTER (layer = 2) AS second_layer FROM {_C} GROUP BY source",
    "budgeted_expansion": f"""SELECT label, container FROM (SELECT label, container, row_number() OVER (PARTITION BY label ORDER BY container) AS r, greatest(0, 20 - have) AS budget
        FROM {_C} JOIN (SELECT label, count(*) AS have FROM {_S} GROUP BY label) USING (label) WHERE source = 'recommended') WHERE r <= budget""",
    "known_ids": f"""SELECT artist_id AS id FROM {_TR} WHERE artist_id <> '' AND artist_id NOT IN (SELECT 'yt_' || c.channel FROM (SELECT unnest(credits) AS c FROM artist_catalog) WHERE c.channel IS NOT NULL)
        GROUP BY 1 HAVING count(*) < 5""",
    "credit_keys": f"SELECT name, channel, id FROM {_KEYS}",
    "credit_resolution": f"SELECT container, name, channel, entity FROM {_RES}",
    "tiered_name_match": f"""SELECT target, candidate, tier FROM (SELECT target, candidate, tier, row_number() OVER (PARTITION BY target ORDER BY tier, fans DESC, candidate) AS r
        FROM {_tier_keys(_TARGETS, 'target')} JOIN {_tier_keys(_CANDS, 'candidate, fans')} USING (tier, key)) WHERE r = 1""",
    "shared_names": f"""WITH c AS (SELECT DISTINCT name, channel, unit FROM {_CRED} WHERE channel <> ''), by_channel AS (SELECT name, channel, count(*) AS units FROM c GROUP BY 1, 2 HAVING count(*) >= 2),
        shared AS (SELECT name FROM by_channel GROUP BY 1 HAVING count(*) >= 2)
        SELECT name, channel, units FROM by_channel SEMI JOIN shared USING (name) UNION ALL
        SELECT name, NULL, count(DISTINCT unit) FROM c ANTI JOIN shared USING (name) GROUP BY name HAVING count(DISTINCT unit) >= 2""",
    "display_case": f"""SELECT lower(trim(artist_name)) AS key, coalesce(arg_max(artist_name, (harvested_at, id, pos)) FILTER (regexp_matches(artist_name, '^\\p{{Lu}}')), arg_min(artist_name, (harvested_at, id, pos))) AS shown
        FROM {_TR} WHERE artist_name IS NOT NULL AND artist_name <> '' GROUP BY 1""",
    "vocabulary_match": f"SELECT name, item, matched FROM {_VOC}",
    "names_of_items": f"SELECT item, name FROM (SELECT *, bool_or(matched = 'label') OVER (PARTITION BY item) AS l FROM {_VOC}) WHERE NOT l OR matched = 'label'",
    "evidence": f"SELECT member, label, n, size FROM {_EV}",
    "core_labels": f"SELECT member, label, round(coverage, {R}) AS coverage, round(best, {R}) AS best FROM {_CORE}",
    "label_votes": f"SELECT container, label, round(votes, {R}) AS votes FROM {_votes(_M, _EV)}",
    "label_votes_leave_one_out": f"SELECT container, label, round(votes, {R}) AS votes FROM {_votes(f'(SELECT * FROM {_M} SEMI JOIN {_S} USING (container))', _EV, _S)}",
    "judged_labels": f"SELECT container, judged FROM {_judged(_M, _C)}",
    "seed_label": f"""WITH hits AS (SELECT container, label, count(*) AS hits FROM {_M} JOIN {_CORE} USING (member) GROUP BY 1, 2), best AS (SELECT container, max((hits, label)) AS b FROM hits GROUP BY 1)
        SELECT s.container, CASE WHEN s.seed_genre IS NOT NULL AND coalesce(h.hits, 0) / greatest(1, coalesce(z.size, 0)) >= 0.3 AND coalesce(h.hits, 0) >= 0.5 * coalesce(b[1], 0) THEN s.seed_genre
          WHEN coalesce(b[1], 0) / greatest(1, coalesce(z.size, 0)) >= 0.3 THEN b[2] ELSE '' END AS label
        FROM {_C} s LEFT JOIN {_SIZE} z USING (container) LEFT JOIN best USING (container) LEFT JOIN hits h ON h.container = s.container AND h.label = s.seed_genre WHERE s.source = 'recommended'""",
    "lift_table": f"SELECT member, label, c, lift FROM {_lift_sql(f'(SELECT unit, label, member FROM {_C} JOIN {_M} USING (container))')}",
    "lift_ranking": f"SELECT member, label, rank FROM {_ranking(_lift_sql(f'(SELECT unit, label, member FROM {_C} JOIN {_M} USING (container))'))}",
    "tag_tiers": f"""WITH m AS (SELECT DISTINCT container, entity AS member FROM {_RES} WHERE entity IS NOT NULL), c AS (SELECT * FROM {_C}),
        carrying AS (SELECT member, label, count(*) AS n FROM c JOIN m USING (container) WHERE label <> '' GROUP BY 1, 2),
        stated AS (SELECT DISTINCT id AS member, unnest("topSubgenres") AS label FROM {NODES}),
        one AS (SELECT member, label, row_number() OVER (PARTITION BY member ORDER BY n DESC, coalesce(g.rank, 9999), label) AS rank, 1 AS tier FROM stated JOIN carrying USING (member, label) LEFT JOIN genres g ON g.genre = label),
        two AS (SELECT member, label, rank, 2 AS tier FROM {_ranking(_lift_sql(f"(SELECT unit, judged AS label, member FROM c JOIN {_judged('m', 'c')} USING (container) JOIN m USING (container))"))}),
        three AS (SELECT member, label, rank, 3 AS tier FROM {_ranking(_lift_sql('(SELECT unit, label, member FROM c JOIN m USING (container))'))}),
        tiers AS (SELECT * FROM one WHERE rank <= 3 UNION ALL SELECT * FROM two WHERE rank <= 3 UNION ALL SELECT * FROM three WHERE rank <= 1),
        best AS (SELECT member, min(tier) AS tier FROM tiers GROUP BY 1),
        chosen AS (SELECT member, tier, string_agg(label, '|' ORDER BY rank) AS tags FROM tiers JOIN best USING (member, tier) GROUP BY 1, 2)
        SELECT member, coalesce(tags, '') AS tags, coalesce(['stated', 'consensus', 'fallback'][tier], 'none') AS source
        FROM (SELECT member FROM stated UNION SELECT member FROM carrying) LEFT JOIN chosen USING (member)""",
    "neighbour_check": f"""WITH t AS (SELECT id AS member, unnest("topSubgenres") AS label, generate_subscripts("topSubgenres", 1) AS pos FROM {NODES}),
        carried AS (SELECT n.member, t.label, count(*) AS n FROM {_NEAR} n JOIN t ON t.member = n.other WHERE n.rank <= 10 GROUP BY 1, 2),
        e AS (SELECT DISTINCT container, entity AS member FROM {_RES} WHERE entity IS NOT NULL),
        sure AS (SELECT member, label FROM {_lift_sql(f'(SELECT unit, label, member FROM {_C} JOIN e USING (container))')} WHERE lift >= 1),
        kept AS (SELECT member, string_agg(label, '|' ORDER BY pos) AS tags FROM t WHERE (member, label) IN (SELECT (member, label) FROM carried) OR (member, label) IN (SELECT (member, label) FROM sure) GROUP BY 1),
        first AS (SELECT member, string_agg(label, '|' ORDER BY pos) AS tags FROM t WHERE pos <= 3 GROUP BY 1)
        SELECT id AS member, coalesce(k.tags, f.tags, '') AS tags FROM {NODES} LEFT JOIN kept k ON k.member = id LEFT JOIN first f ON f.member = id""",
    "anchors": f"""WITH s AS (SELECT * FROM {_NAMED}), size AS (SELECT label, count(*) AS size, sum(named) AS named_size FROM s GROUP BY 1),
        m AS (SELECT label, member, count(*) AS n, sum(named) AS named FROM s JOIN {_M} USING (container) GROUP BY 1, 2),
        songs AS (SELECT label, member, song, count(*) AS n, sum(named) AS named FROM s JOIN (SELECT DISTINCT id AS container, artist_id AS member, "videoId" AS song FROM {_TR} WHERE artist_id <> '' AND "videoId" IS NOT NULL) USING (container) GROUP BY 1, 2, 3),
        c AS (SELECT *, CASE WHEN named_size >= 2 THEN named ELSE n END AS used, coalesce(max(CASE WHEN n >= 2 THEN n / size END) OVER (PARTITION BY member), 0.0) AS best FROM m JOIN size USING (label)),
        v AS (SELECT * FROM c WHERE used >= 2 AND n / size >= 0.5 * best),
        song AS (SELECT label, member, song FROM (SELECT *, row_number() OVER (PARTITION BY label, member ORDER BY heard DESC, song) AS r FROM (
          SELECT label, member, song, CASE WHEN named_size >= 2 THEN named ELSE n END AS heard FROM songs JOIN size USING (label)) WHERE heard >= 1) WHERE r = 1)
        SELECT label, member, song, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY used DESC, n DESC, member) AS rank FROM v JOIN song USING (label, member)) WHERE rank <= 15""",
    "round_robin_anchors": f"""SELECT label, container, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY turn, size DESC, container) AS place FROM (
        SELECT *, row_number() OVER (PARTITION BY label, unit ORDER BY size DESC, container) AS turn FROM {_C} JOIN {_SIZE} USING (container) WHERE source <> 'search' AND label <> '')) WHERE place <= 10""",
}
