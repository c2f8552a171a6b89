"""Registered queries of harvests, sources, sinks and streams, with their SQL twins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from constellate.functions import text as X
from constellate.operators import harvest as H
from constellate.operators import quality as Q
from constellate.plans import label_queries as L
from constellate.plans.bindings import NODES, PLAYLISTS, nodes, playlists, table
from constellate.plans.sql import compat, in_list, q
from constellate.plans.text_queries import _sanitise, shown_sql
from constellate.session import shared_dir
from constellate.sources import sinks, tables
from constellate.streaming import incremental

R = 6

# ---- labels and candidates -----------------------------------------------------------------------------------------


def _wide_labels(spark: SparkSession, d: str) -> DataFrame:
    """The labels, with one of each that names no music put among them."""
    g = table(spark, d, "genres").select(F.col("rank"), F.col("genre"))
    noise = spark.createDataFrame([(i * 3, f" {x.title()} ") for i, x in enumerate(H.NO_MUSIC)], "rank int, genre string")
    return g.unionByName(noise)


_WIDE = "(SELECT rank, genre FROM genres UNION ALL SELECT * FROM (VALUES " + ", ".join(f"({i * 3}, {q(f' {x.title()} ')})" for i, x in enumerate(H.NO_MUSIC)) + ") v(rank, genre))"


def musical_labels(spark: SparkSession, d: str) -> DataFrame:
    return H.musical(_wide_labels(spark, d))


def top_labels(spark: SparkSession, d: str) -> DataFrame:
    return H.top_labels(H.musical(_wide_labels(spark, d)), limit=20)


def candidate_lists(spark: SparkSession, d: str) -> DataFrame:
    """Lists found for a label: by its three queries and a fourth one, as lists of the label whose title holds a word of the query."""
    g = table(spark, d, "genres").select("genre", F.array("primary_query", "secondary_query", "tertiary_query", F.concat("genre", F.lit(" songs"))).alias("qs"))
    asked = g.select("genre", F.posexplode("qs").alias("query", "q")).select("genre", "query", F.explode(F.array_distinct(F.split(F.lower("q"), " "))).alias("word")).distinct()
    p = playlists(spark, d).where("title is not null and genre != ''").select("genre", "id", F.explode(F.array_distinct(F.split(F.lower("title"), " "))).alias("word"))
    found = p.join(asked, ["genre", "word"]).select("genre", "query", "id").distinct().withColumn("pos", F.lit(0))
    return H.candidate_lists(found, "genre")


def open_curators(spark: SparkSession, d: str) -> DataFrame:
    p = playlists(spark, d).select("id", "author_id", "source")
    return H.open_curators(p.where("source != 'search'"), p.where("source = 'search'"), "author_id", 2).select("id", "author_id")


def revisited_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels with fewer than fifteen lists by search and recommendation together, but those of second-layer lists."""
    c = playlists(spark, d).where("genre != ''").select(F.col("genre").alias("key"), "source", "layer")
    n = lambda s: c.where(F.col("source") == s).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    found = H.added_counts(n("search"), n("recommended"))
    return H.under_target(found, c.select(F.col("key").alias("label")), c.where("layer = 2").select(F.col("key").alias("label")).distinct(), 15)


def added_counts(spark: SparkSession, d: str) -> DataFrame:
    c = playlists(spark, d).where("genre != ''").select(F.col("genre").alias("key"), "source")
    n = lambda s: c.where(F.col("source") == s).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return H.added_counts(n("search"), n("recommended"), n("search"))


# ---- tracks --------------------------------------------------------------------------------------------------------


def track_credits(spark: SparkSession, d: str) -> DataFrame:
    t = L._tracks(spark, d).select("id", "pos", "title", "artist_name", "channel_id")
    return H.track_credits(t, Q.uploader_channels(t, "id", "artist_name", "title")).select("id", "pos", "credit", "credit_channel")


def kept_tracks(spark: SparkSession, d: str) -> DataFrame:
    """Tracks by title and length; the tables hold no lengths, one is made of place and title."""
    t = L._tracks(spark, d).select("id", "pos", "title", F.when(F.col("pos") % 7 > 0, F.pmod(F.col("pos") * 97 + F.length("title") * 31, F.lit(900))).alias("secs"))
    return H.kept_tracks(t, "title", "secs").select("id", "pos", "catalogue")


# ---- facts ---------------------------------------------------------------------------------------------------------


def item_facts(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d).select(F.col("continentId").alias("item"), F.col("label").alias("alias"), F.floor(F.col("x") / 100).cast("int").alias("year"), F.pmod(F.floor("y").cast("int"), F.lit(3)).alias("precision"))
    return H.item_facts(n).select("item", F.array_join("aliases", "|").alias("aliases"), "year", "precision")


def label_facts(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d).select("id", F.when(F.length("label") % 3 == 0, "Music genre").otherwise(F.col("label")).alias("desc"), F.replace("image", F.lit("https://e"), F.lit("http://e")).alias("wiki"))
    return H.label_facts(n)


def _entity_lifts(spark: SparkSession, d: str) -> DataFrame:
    from constellate.operators import votes as V

    m = L._resolved(spark, d).where("entity is not null").select("container", F.col("entity").alias("member")).distinct()
    return V.lift_table(L._containers(spark, d).select("container", "label", "unit").join(m, "container")).withColumn("lift", F.round("lift", R))


def _stated(spark: SparkSession, d: str) -> DataFrame:
    return nodes(spark, d).select(F.col("id").alias("member"), F.explode("topSubgenres").alias("label"))


def confirmed_facts(spark: SparkSession, d: str) -> DataFrame:
    return H.shown_facts(H.confirmed_facts(_stated(spark, d), _entity_lifts(spark, d))).select("member", F.array_join("facts", "|").alias("facts"))


def dropped_tags(spark: SparkSession, d: str) -> DataFrame:
    """How many of a node's tags the check against its neighbours drops."""
    n = nodes(spark, d).select(F.col("id").alias("member"), F.coalesce("topSubgenres", F.array().cast("array<string>")).alias("had"))
    kept = L.neighbour_check(spark, d).select("member", F.filter(F.split("tags", r"\|"), lambda t: t != "").alias("kept"))
    return n.join(kept, "member").select("member", F.size(F.array_except("had", "kept")).alias("dropped"))


def key_universe(spark: SparkSession, d: str) -> DataFrame:
    """Every node and every entity that some list credits."""
    m = L._resolved(spark, d).where("entity is not null").select(F.col("entity").alias("id"))
    return m.union(nodes(spark, d).select("id")).distinct()


def published(spark: SparkSession, d: str) -> DataFrame:
    """Catalogue entities that are credited in two independent units or more and have a place on the map."""
    c = L._resolved(spark, d).where("entity is not null").select("container", F.col("entity").alias("id")).join(L._containers(spark, d).select("container", "unit"), "container")
    survived = c.groupBy("id").agg(F.countDistinct("unit").alias("units")).where("units >= 2")
    laid_out = nodes(spark, d).where("x is not null and y is not null").select("id")
    return table(spark, d, "artist_catalog").select("id").distinct().join(survived, "id", "left_semi").join(laid_out, "id", "left_semi")


def latest_first(spark: SparkSession, d: str) -> DataFrame:
    """Lists from the last harvested to the first."""
    from constellate.operators import ranking as K

    return K.global_rank(playlists(spark, d).select("id", "harvested_at"), [F.desc("harvested_at"), F.desc("id")]).select("id", "rank")


def positional_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Nodes packed as positional tuples."""
    return nodes(spark, d).select("id", H.positional([F.col("id"), F.col("label"), F.col("continentId"), F.col("subscribers"), F.get("topSubgenres", F.lit(0))]).alias("packed"))


def unpacked_nodes(spark: SparkSession, d: str) -> DataFrame:
    fields = [("id", "string"), ("label", "string"), ("continentId", "int"), ("subscribers", "bigint"), ("tag", "string")]
    return positional_nodes(spark, d).select(*H.unpacked(F.col("packed"), fields))


# ---- sources and sinks ---------------------------------------------------------------------------------------------


def html_listing(spark: SparkSession, d: str) -> DataFrame:
    """Ranked labels read back from one page of table rows among other links."""
    row = F.format_string('<tr><td class="n">%d</td><td><a href="/play/%d">play</a> <a class="x" href="everynoise1d-%s.html"> %s &amp; caf&eacute; </a></td></tr>', "rank", "rank", F.replace("genre", F.lit(" "), F.lit("")), "genre")
    g = table(spark, d, "genres").select(F.lit("live").alias("page"), "rank", row.alias("row"))
    page = g.groupBy("page").agg(F.concat(F.lit("<table><tr><th>no rank</th></tr>"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "row"))), lambda r: r["row"]), "\n")).alias("html"))
    cut = page.select(F.lit("cut").alias("page"), F.substring("html", 1, 200).alias("html"))
    return tables.html_rows(tables.first_available(cut, page), "html", ["page"])


def shelf_ids(spark: SparkSession, d: str) -> DataFrame:
    """Lists on the shelves of labels, each at its first mention; every third shelf is none of lists."""
    p = playlists(spark, d).where("genre != ''").groupBy("genre").agg(F.array_sort(F.collect_list(X.list_key(F.concat(F.lit("PL"), "id")))).alias("entries"))
    r = table(spark, d, "genres").select("genre", F.col("rank").alias("shelf"))
    s = p.join(r, "genre").select("shelf", F.when(F.col("shelf") % 3 == 0, "Artists").otherwise(F.concat("genre", F.lit(" Playlists"))).alias("title"), "entries")
    return tables.listed_ids(s, "title", "entries").select("id", F.col("position.shelf").alias("shelf"), F.col("position.at").alias("at"))


def fetched_keys(spark: SparkSession, d: str) -> DataFrame:
    """Labels in use that the table of labels does not hold as a first choice, fetched in batches."""
    import pandas as pd

    keys = playlists(spark, d).where("genre != ''").select(F.col("genre").alias("key"))
    known = table(spark, d, "genres").where("rank <= 10").select(F.col("genre").alias("key"))
    fetch = lambda f: pd.DataFrame({"key": f["key"], "letters": f["key"].str.len()})
    return tables.fetch_missing(keys, "key", [known], fetch, "key string, letters bigint", batch=7)


def optional_json(spark: SparkSession, d: str) -> DataFrame:
    """Nodes as documents without their null fields."""
    return sinks.documents(nodes(spark, d).select("id", "continentId", "subscribers", F.nullif("image", F.lit("")).alias("image")))


# ---- streams -------------------------------------------------------------------------------------------------------


def _streamed(spark: SparkSession, d: str, columns: list[str]) -> tuple[DataFrame, str]:
    """Events as a file stream of one file, and a new folder beside it."""
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    e = table(spark, d, "events").select(*columns)
    e.coalesce(1).write.parquet(f"{folder}/in")
    return spark.readStream.schema(e.schema).parquet(f"{folder}/in"), folder


def _drained(stream: DataFrame, folder: str) -> DataFrame:
    q_ = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/points").trigger(availableNow=True).start()
    q_.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


def stream_cap(spark: SparkSession, d: str) -> DataFrame:
    s, folder = _streamed(spark, d, ["event_id", "user_id", "event_type"])
    return _drained(incremental.running_cap(s, "user_id", "event_id", 2), folder).select("event_id", "user_id")


def stream_unseen(spark: SparkSession, d: str) -> DataFrame:
    """Users of the stream, each once, but rejected ones."""
    s, folder = _streamed(spark, d, ["user_id"])
    rejected = table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("user_id"))
    return _drained(incremental.unseen(s, ["user_id"], rejected), folder)


def stream_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts of the windows that the watermark has closed."""
    s, folder = _streamed(spark, d, ["ts", "event_type"])
    return _drained(incremental.windowed_counts(s.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type"), folder)


def stream_accept(spark: SparkSession, d: str) -> DataFrame:
    """Events accepted batch by batch: of positive value, and no user twice."""
    s, folder = _streamed(spark, d, ["event_id", "user_id", "value"])

    def decide(new: DataFrame, so_far: DataFrame) -> DataFrame:
        first = Q.cap_per_key(new.where("value > 0"), "user_id", ["event_id"], 1)
        return first.join(so_far.select("user_id"), "user_id", "left_anti").select(*new.columns)

    incremental.accept_batches(s, f"{folder}/out", f"{folder}/points", "event_id", decide)
    return spark.read.parquet(f"{folder}/out").select("event_id", "user_id")


QUERIES = {f.__name__: f for f in (
    musical_labels, top_labels, candidate_lists, open_curators, revisited_labels, added_counts, track_credits, kept_tracks, item_facts, label_facts, confirmed_facts,
    dropped_tags, key_universe, published, latest_first, positional_nodes, unpacked_nodes, html_listing, shelf_ids, fetched_keys, optional_json, stream_cap,
    stream_unseen, stream_counts, stream_accept)}

_P = f"(SELECT * FROM {PLAYLISTS} WHERE genre <> '')"
_MUSIC = f"(SELECT rank, genre FROM {_WIDE} WHERE lower(trim(genre)) NOT IN {in_list(H.NO_MUSIC)})"
_COUNT = lambda s: f"(SELECT genre AS key, count(*) AS n FROM {_P} WHERE source = {q(s)} GROUP BY 1)"
_NO_TRACK = f"coalesce(regexp_matches(title, {q('(?i)' + '|'.join(X.NO_TRACK_TITLES))}), false)"
_UP = f"""(SELECT id, channel FROM (SELECT DISTINCT id, lower(trim(artist_name)) AS channel, lower(trim(left(title, instr(title, ' - ') - 1))) AS prefix FROM {L._TR} WHERE contains(title, ' - '))
    WHERE channel <> '' AND prefix <> '' AND prefix <> channel GROUP BY id, channel HAVING count(*) >= 2)"""
_ENT = f"(SELECT DISTINCT container, entity AS member FROM {L._RES} WHERE entity IS NOT NULL)"
_FIRST_QUERY = f"""(SELECT genre, id, min(query) AS query FROM (
    SELECT DISTINCT p.genre, p.id, a.query FROM (SELECT genre, id, unnest(string_split(lower(title), ' ')) AS word FROM {_P} WHERE title IS NOT NULL) p
    JOIN (SELECT genre, query, unnest(string_split(lower(qs[query + 1]), ' ')) AS word FROM (SELECT genre, [primary_query, secondary_query, tertiary_query, genre || ' songs'] AS qs FROM genres), (SELECT unnest(range(4)) AS query)) a
    ON a.genre = p.genre AND a.word = p.word) GROUP BY 1, 2)"""

ORACLES = {
    "musical_labels": f"SELECT rank, genre FROM {_MUSIC}",
    "top_labels": f"SELECT rank, genre FROM {_MUSIC} ORDER BY rank, genre LIMIT 20",
    "candidate_lists": f"""WITH f AS (SELECT * FROM {_FIRST_QUERY}), k AS (SELECT genre, query, coalesce(sum(n) OVER (PARTITION BY genre ORDER BY query ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
          FROM (SELECT genre, query, count(*) AS n FROM f GROUP BY 1, 2))
        SELECT genre, id, CAST(query AS INTEGER) AS query, CAST(row_number() OVER (PARTITION BY genre ORDER BY query, id) AS INTEGER) AS place FROM f JOIN k USING (genre, query) WHERE before < 35""",
    "open_curators": f"""SELECT id, author_id FROM {PLAYLISTS} WHERE source <> 'search' AND coalesce(author_id, '?') NOT IN (
        SELECT coalesce(author_id, '?') FROM {PLAYLISTS} WHERE source = 'search' GROUP BY 1 HAVING count(*) >= 2)""",
    "revisited_labels": f"""SELECT label FROM (SELECT DISTINCT genre AS label FROM {_P}) LEFT JOIN (SELECT key AS label, sum(n) AS n FROM (SELECT * FROM {_COUNT('search')} UNION ALL SELECT * FROM {_COUNT('recommended')}) GROUP BY 1) USING (label)
        WHERE coalesce(n, 0) < 15 AND label NOT IN (SELECT genre FROM {_P} WHERE layer = 2)""",
    "added_counts": f"SELECT key, CAST(sum(n) AS BIGINT) AS n FROM (SELECT * FROM {_COUNT('search')} UNION ALL SELECT * FROM {_COUNT('recommended')} UNION ALL SELECT * FROM {_COUNT('search')}) GROUP BY 1",
    "kept_tracks": f"""SELECT id, CAST(pos AS INTEGER) AS pos, (secs IS NULL OR secs <= 0 OR secs BETWEEN 30 AND 600) AS catalogue FROM (
        SELECT id, pos, title, CASE WHEN pos % 7 > 0 THEN (pos * 97 + length(title) * 31) % 900 END AS secs FROM {L._TR}) WHERE NOT {_NO_TRACK} AND coalesce(secs <= 600, true)""",
    "item_facts": f"""WITH s AS (SELECT "continentId" AS item, label, CAST(floor(x / 100) AS INTEGER) AS year, CAST(((floor(y) % 3) + 3) % 3 AS INTEGER) AS precision FROM {NODES} WHERE "continentId" IS NOT NULL)
        SELECT a.item, aliases, year, precision FROM (SELECT item, coalesce(string_agg(label, '|' ORDER BY label), '') AS aliases FROM (SELECT DISTINCT item, label FROM s) GROUP BY 1) a
        LEFT JOIN (SELECT item, year, precision FROM s WHERE year IS NOT NULL QUALIFY row_number() OVER (PARTITION BY item ORDER BY year, precision DESC) = 1) d USING (item)""",
    "label_facts": f"""SELECT id, CASE WHEN d <> '' AND lower(d) <> 'music genre' THEN d END AS desc, CASE WHEN w LIKE 'https://%' THEN w END AS wiki
        FROM (SELECT id, CASE WHEN length(label) % 3 = 0 THEN 'Music genre' ELSE label END AS d, replace(image, 'https://e', 'http://e') AS w FROM {NODES})""",
    "track_credits": f"""WITH t AS (SELECT id, CAST(pos AS INTEGER) AS pos, channel_id, trim(artist_name) AS name, (id, lower(trim(artist_name))) IN (SELECT (id, channel) FROM {_UP}) AS up,
          CASE WHEN contains(title, ' - ') THEN trim(regexp_replace(trim(left(title, instr(title, ' - ') - 1)), '^\\d+[\\.\\-_–—]+\\s*', '')) END AS l FROM {L._TR}),
        r AS (SELECT *, nullif(CASE WHEN typed THEN l ELSE name END, '') AS raw FROM (SELECT *, coalesce(up AND length(l) > 1, false) AS typed FROM t))
        SELECT id, pos, {_sanitise('n')} AS credit, CASE WHEN NOT typed AND raw IS NOT NULL THEN channel_id END AS credit_channel FROM (SELECT *, trim({compat('raw')}) AS n FROM r)""",
    "dropped_tags": f"""WITH k AS ({L.ORACLES['neighbour_check']}), h AS (SELECT id AS member, coalesce("topSubgenres", []) AS had FROM {NODES})
        SELECT member, CAST(len(list_filter(list_distinct(had), lambda x: NOT list_contains(string_split(tags, '|'), x))) AS INTEGER) AS dropped FROM h JOIN k USING (member)""",
    "key_universe": f"SELECT member AS id FROM {_ENT} UNION SELECT id FROM {NODES}",
    "published": f"""SELECT DISTINCT id FROM artist_catalog WHERE id IN (SELECT member FROM {_ENT} JOIN {L._C} USING (container) GROUP BY member HAVING count(DISTINCT unit) >= 2)
        AND id IN (SELECT id FROM {NODES} WHERE x IS NOT NULL AND y IS NOT NULL)""",
    "latest_first": f"SELECT id, row_number() OVER (ORDER BY harvested_at DESC, id DESC) - 1 AS rank FROM {PLAYLISTS}",
    "positional_nodes": f"""SELECT id, CAST(json_array(id, label, "continentId", subscribers, "topSubgenres"[1]) AS VARCHAR) AS packed FROM {NODES}""",
    "unpacked_nodes": f"""SELECT id, label, "continentId", subscribers, "topSubgenres"[1] AS tag FROM {NODES}""",
    "html_listing": "SELECT 'live' AS page, rank, lower(genre) || ' & café' AS name FROM genres",
    "shelf_ids": f"""SELECT id, shelf, CAST(row_number() OVER (PARTITION BY shelf ORDER BY id) - 1 AS INTEGER) AS at FROM (SELECT 'VLPL' || p.id AS id, rank AS shelf FROM {_P} p JOIN genres g USING (genre)) WHERE shelf % 3 <> 0""",
    "fetched_keys": f"SELECT DISTINCT genre AS key, CAST(length(genre) AS BIGINT) AS letters FROM {_P} WHERE genre NOT IN (SELECT genre FROM genres WHERE rank <= 10)",
    "optional_json": f"""SELECT '{{"id":"' || id || '"' || coalesce(',"continentId":' || "continentId", '') || coalesce(',"subscribers":' || subscribers, '') || coalesce(',"image":"' || nullif(image, '') || '"', '') || '}}' AS json FROM {NODES}""",
    "stream_cap": "SELECT event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) <= 2",
    "stream_unseen": "SELECT DISTINCT user_id FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)",
    "stream_counts": "SELECT start, event_type, n FROM (SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2) WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 2 HOUR FROM events)",
    "stream_accept": "SELECT event_id, user_id FROM events WHERE value > 0 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1",
    "confirmed_facts": f"""WITH s AS (SELECT DISTINCT id AS member, unnest("topSubgenres") AS label FROM {NODES}), l AS (SELECT * FROM {L._lift_sql(f"(SELECT unit, label, member FROM {L._C} JOIN {_ENT} USING (container))")})
        SELECT member, string_agg(shown, '|' ORDER BY shown) AS facts FROM (SELECT DISTINCT member, {shown_sql('label')} AS shown FROM s JOIN l USING (member, label) WHERE lift >= 1) GROUP BY 1""",
}
