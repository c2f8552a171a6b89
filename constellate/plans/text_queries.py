"""Registered queries of the text and number functions, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from constellate.functions import scalars as S
from constellate.functions import text as X
from constellate.plans.bindings import NODES, PLAYLISTS, nodes, playlists, table
from constellate.plans.sql import compat, in_list, q


def _tracks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "harvested_playlists").select("id", F.explode("tracks").alias("t")).select("id", "t.*")


_T = "(SELECT id, t.* FROM (SELECT id, unnest(tracks) AS t FROM harvested_playlists))"


def clean_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "artist_catalog").select("name").distinct().select("name", X.sanitise_name(F.col("name")).alias("clean"))


def split_names(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "artist_catalog").select("name").distinct()
    return n.select("name", F.array_join(X.split_names(F.col("name")), "|").alias("parts"))


def song_keys(spark: SparkSession, d: str) -> DataFrame:
    return _tracks(spark, d).select("title").where("title is not null").distinct().select("title", X.song_key(F.col("title")).alias("song"))


def artist_keys(spark: SparkSession, d: str) -> DataFrame:
    t = _tracks(spark, d).where("artist_name is not null and artist_name != ''").select("artist_name", "channel_id").distinct()
    return t.select("artist_name", "channel_id", X.artist_key(F.col("artist_name"), F.col("channel_id")).alias("key"))


def title_sides(spark: SparkSession, d: str) -> DataFrame:
    left, right = X.title_sides(F.col("title"))
    return _tracks(spark, d).select("title").where(F.contains("title", F.lit(" - "))).distinct().select("title", left.alias("left_side"), right.alias("right_side"))


def durations(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", F.date_format("ts", "HH:mm:ss").alias("hms"), F.date_format("ts", "mm:ss").alias("ms"))
    return e.select("event_id", X.seconds(F.col("hms")).alias("s3"), X.seconds(F.col("ms")).alias("s2"), X.clock(X.seconds(F.col("hms"))).alias("shown"))


def content_words(spark: SparkSession, d: str) -> DataFrame:
    return _tracks(spark, d).select("title").where("title is not null").distinct().select("title", F.array_join(X.content_words(F.col("title")), " ").alias("words"))


def match_forms(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d).select("id", X.match_form(F.col("label")).alias("form"))
    return n.select("id", "form", X.letters_form(F.col("form")).alias("letters"), X.without_article(F.col("form")).alias("bare"))


def display_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "genres").select("genre", X.display_name(F.col("genre")).alias("shown"))


def reach_formats(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("subscribers")
    return nodes(spark, d).select(
        "id", S.compact_count(s).alias("fans"), S.compact_count_one_decimal(s).alias("listeners"), S.log_popularity(s).cast("bigint").alias("popularity"),
        S.reach_floor(s).cast("bigint").alias("floor"))


def node_sizes(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d).select("id", S.reach_floor(F.col("subscribers")).alias("reach"))
    ends = n.agg(F.struct(F.min("reach").alias("lo"), F.max("reach").alias("hi")).alias("e")).scalar()
    return n.select("id", S.node_size(F.col("reach"), ends["lo"], ends["hi"]).alias("size"), F.round(S.node_radius(F.col("reach"), ends["lo"], ends["hi"]), 4).alias("radius"))


def edge_scalars(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "atlas_edges").select("source", "target", "weight").distinct()
    return e.select("source", "target", S.edge_size(F.col("weight")).alias("size"), F.round(S.link_opacity(F.col("weight")), 6).alias("opacity"),
                    F.round(S.draw_diameter(F.col("weight")), 6).alias("diameter"))


def colours(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "continents").select("id", S.community_colour(F.col("id")).alias("pipeline"), S.community_colour_rounded(F.col("id")).alias("client"))


def slug_paths(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d).select("id", X.search_form(F.col("label")).alias("form")).select("id", X.slug(F.col("form")).alias("slug"), X.letter_of(F.col("form")).alias("letter"))
    repeated = n.groupBy("slug").agg((F.count(F.lit(1)) > 1).alias("repeated"))
    return n.join(repeated, "slug").select("id", "slug", "letter", X.page_path(F.col("id"), F.col("slug"), F.col("repeated")).alias("path"))


def unique_paths(spark: SparkSession, d: str) -> DataFrame:
    """Slugs that break the rule of one page a path, before ids tell them apart; and paths that break it after that, of which
    sound data have none."""
    s = slug_paths(spark, d)
    broken = lambda c, none: s.groupBy(F.col(c).alias("path")).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | (F.col("path") == none))
    return broken("slug", "").unionByName(broken("path", "/artist//"))


def image_urls(spark: SparkSession, d: str) -> DataFrame:
    return nodes(spark, d).select("id", X.thumbnail_url(F.col("image")).alias("small"), X.large_url(F.col("image")).alias("large"))


def html_texts(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.md5(X.escape_html(t)).alias("escaped"), F.md5(X.unescape_html(t)).alias("unescaped"))


def inceptions(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d).where("x is not null and y is not null").select("id", F.col("x").cast("int").alias("year"), (7 + F.pmod(F.col("y").cast("int"), F.lit(3))).alias("p"))
    return n.where("year != 0").select("id", X.inception(F.col("year"), F.col("p")).alias("since"))


def filter_labels(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "genres").select("rank", (F.col("rank") - 5).alias("lo"), (F.col("rank") + 60).alias("hi"), F.pmod(F.col("rank"), F.lit(4)).alias("links"), "genre")
    return g.select("rank", X.filter_label(F.when(F.col("rank") % 3 == 0, F.col("genre")), F.col("lo"), F.col("hi"), F.col("links")).alias("label"))


def map_links(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "genres").select("rank", X.map_link({"genre": F.col("genre"), "view": F.lit("map")}).alias("href"))


def descriptions(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "genres")
    parts = F.array(F.concat(X.display_name(F.col("genre")), F.lit(" on the map.")), F.concat(F.lit("Found by "), F.col("primary_query"), F.lit(" and "), F.col("secondary_query"), F.lit(".")),
                    F.concat(F.lit("Also by "), F.col("tertiary_query"), F.lit(", as far as lists go.")))
    return g.select("rank", X.fit(parts, 80).alias("text"), X.possessive(F.col("genre")).alias("owner"))


def list_forms(spark: SparkSession, d: str) -> DataFrame:
    name, key = X.author_of(F.col("author"), F.col("author_id"), F.col("id"))
    return playlists(spark, d).select("id", X.list_key(F.col("id")).alias("list"), name.alias("author"), key.alias("author_id"),
                                      X.phrase_form(F.col("genre")).alias("phrase"), X.last_path_part(F.concat(F.lit("https://lists.example/"), F.col("id"))).alias("tail"),
                                      X.year_of(F.date_format("harvested_at", "yyyy-MM-dd")).alias("year"))


QUERIES = {f.__name__: f for f in (
    clean_names, split_names, song_keys, artist_keys, title_sides, durations, content_words, match_forms, display_names, reach_formats, node_sizes,
    edge_scalars, colours, slug_paths, unique_paths, image_urls, html_texts, inceptions, filter_labels, map_links, descriptions, list_forms)}


def _sanitise(x: str) -> str:
    cut = f"(CASE WHEN lower({x}) LIKE '% - topic' THEN trim(left({x}, length({x}) - 8)) WHEN lower({x}) LIKE '% topic' THEN trim(left({x}, length({x}) - 6)) ELSE {x} END)"
    return (f"(CASE WHEN length({x}) BETWEEN 1 AND 100 AND regexp_matches({cut}, '\\p{{L}}') AND lower({cut}) NOT IN {in_list(X.PLACEHOLDER_NAMES)} "
            f"AND NOT regexp_matches({cut}, {q(X.DATE_LIKE)}) THEN {cut} END)")


def song_sql(x: str) -> str:
    return f"""lower(trim({compat(f"regexp_split_to_array({x}, '(?i)\\s*[\\(\\[【]|\\s+(?:ft\\.?|feat\\.?)\\s+')[1]")}))"""


def parts_sql(x: str) -> str:
    """The whole side and its parts, cleaned."""
    parts = f"list_concat([{x}], regexp_split_to_array({x}, '(?i)\\s*(?:&|,|\\bx\\b|\\bfeat\\.?|\\bft\\.?)\\s*'))"
    return f"list_filter(list_transform({parts}, lambda p: {_sanitise('trim(p)')}), lambda p: p IS NOT NULL)"


def split_sql(x: str) -> str:
    """Names of a joint credit in order, each once regardless of case."""
    whole = "regexp_matches(trim(p), '(?i)^[^,]+,\\s*(?:the\\s+\\w+|jr\\.?|sr\\.?|ii|iii|iv)$')"
    cut = f"flatten(list_transform(regexp_split_to_array(trim({x}), '(?i)\\s+(?:ft\\.?|feat\\.?)\\s+'), lambda p: CASE WHEN {whole} THEN [trim(p)] ELSE string_split(trim(p), ',') END))"
    clean = f"list_filter(list_transform({cut}, lambda n: {_sanitise('trim(n)')}), lambda n: n IS NOT NULL)"
    return f"list_filter({clean}, lambda n, i: list_position(list_transform({clean}, lambda m: lower(m)), lower(n)) = i)"


def content_sql(x: str) -> str:
    return f"""list_filter(list_distinct(regexp_extract_all(lower(regexp_replace({x}, '[\\(\\[\\{{].*?[\\)\\]\\}}]', '', 'g')), '[a-z]{{3,}}')), lambda w: w NOT IN {in_list(X.STOP_WORDS)})"""


def shown_sql(x: str) -> str:
    table_ = ", ".join(f"{q(k)}: {q(v)}" for k, v in X.ACRONYMS.items())
    return f"""array_to_string(list_transform(list_filter(regexp_split_to_array(trim({x}), '\\s+'), lambda w: w <> ''), lambda w: coalesce(
        MAP {{{table_}}}[lower(w)], array_to_string(list_transform(regexp_extract_all(w, '\\p{{L}}+|\\P{{L}}+'), lambda r: upper(left(r, 1)) || lower(substr(r, 2))), ''))), ' ')"""


_SEARCH = lambda x: f"trim(lower(strip_accents({x})))"
_MATCH = f"trim(trim(trim(lower(strip_accents({compat('translate(label, ' + q('яЯ$øØ') + ', ' + q('rrsoo') + ')')}))), '.'))"
_SLUGS = f"""(SELECT id, form, regexp_replace(regexp_replace(form, '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug,
    CASE WHEN regexp_matches(upper(left(form, 1)), '^[A-Z]$') THEN upper(left(form, 1)) ELSE '#' END AS letter FROM (SELECT id, {_SEARCH("coalesce(label, '')")} AS form FROM {NODES}))"""
_PATHS = f"""(SELECT id, slug, letter, '/artist/' || CASE WHEN slug = '' THEN regexp_replace(id, '^dz_', '')
    WHEN count(*) OVER (PARTITION BY slug) > 1 THEN slug || '-' || regexp_replace(id, '^dz_', '') ELSE slug END || '/' AS path FROM {_SLUGS})"""
_FMT1 = "printf('%.1f', {})"


def _compact(v: str, whole: bool) -> str:
    def unit(u: str, sign: str) -> str:
        one = f"printf('%.1f', {v} / {u})"
        return (f"CASE WHEN {v} / {u} < 10 THEN {one} ELSE CAST(CAST(round_even({v} / {u}, 0) AS BIGINT) AS VARCHAR) END || '{sign}'" if whole else f"{one} || '{sign}'")

    return f"CASE WHEN {v} >= 1e6 THEN {unit('1e6', 'M')} WHEN {v} >= 1e3 THEN {unit('1e3', 'K')} ELSE CAST(CAST({v} AS BIGINT) AS VARCHAR) END"


_V = "CAST(coalesce(subscribers, 0) AS DOUBLE)"


def _share(f: str) -> str:
    return f"CASE WHEN hi > lo THEN greatest(0.0, least(1.0, ({f}(reach) - {f}(lo)) / ({f}(hi) - {f}(lo)))) ELSE 0.0 END"


def _colour(seed: int, angle: float, rounded: bool) -> str:
    hue = f"(CAST(id AS DOUBLE) * {angle} + {seed} * 83.17) % 360.0"
    hue = f"floor({hue} + 0.5)" if rounded else hue
    tier = f"(id + {seed}) % 4 + 1"
    s = f"([{', '.join(str(a / 100) for a, _ in S.TIERS)}])[{tier}]"
    v = f"([{', '.join(str(b / 100) for _, b in S.TIERS)}])[{tier}]"
    inner = f"(SELECT id, {hue} / 60.0 AS h, CAST({s} AS DOUBLE) AS s, CAST({v} AS DOUBLE) AS l FROM continents)"
    inner = f"(SELECT id, h, (1 - abs(2 * l - 1)) * s AS c, l FROM {inner})"
    inner = f"(SELECT id, h, c, c * (1 - abs(h % 2.0 - 1)) AS x, l - c / 2 AS m FROM {inner})"
    sectors = [("c", "x", "0"), ("x", "c", "0"), ("0", "c", "x"), ("0", "x", "c"), ("x", "0", "c"), ("c", "0", "x")]
    channel = []
    for k in range(3):
        e = "CASE " + " ".join(f"WHEN h < {n + 1} THEN {sectors[n][k]}" for n in range(5)) + f" ELSE {sectors[5][k]} END + m"
        number = f"floor(({e}) * 255 + 0.5)" if rounded else f"floor(({e}) * 255 + 1e-9)"
        channel.append(f"printf('%02X', CAST({number} AS BIGINT))")
    return f"(SELECT id, '#' || {' || '.join(channel)} AS colour FROM {inner})"


def _escape(x: str, pairs) -> str:
    for a, b in pairs:
        x = f"replace({x}, {q(a)}, {q(b)})"
    return x


_ESC = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"))
_UNESC = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&apos;", "'"), ("&nbsp;", "\u00a0"), ("&amp;", "&"))
_URL = "CASE WHEN trim(image) LIKE '//%' THEN 'https:' || trim(image) ELSE trim(image) END"

ORACLES = {
    "clean_names": f"SELECT name, {_sanitise('s')} AS clean FROM (SELECT DISTINCT name, trim({compat('name')}) AS s FROM artist_catalog)",
    "song_keys": f"SELECT title, lower(trim({compat('head')})) AS song FROM (SELECT title, regexp_split_to_array(title, '(?i)\\s*[\\(\\[【]|\\s+(?:ft\\.?|feat\\.?)\\s+')[1] AS head FROM (SELECT DISTINCT title FROM {_T} WHERE title IS NOT NULL))",
    "artist_keys": f"""SELECT artist_name, channel_id, CASE WHEN channel_id LIKE 'UC%' THEN 'yt_' || trim(channel_id) ELSE 'name_' || left(md5(lower(trim(artist_name))), 12) END AS key
        FROM (SELECT DISTINCT artist_name, channel_id FROM {_T} WHERE artist_name IS NOT NULL AND artist_name <> '')""",
    "title_sides": f"""SELECT title, trim(regexp_replace(trim(left(title, instr(title, ' - ') - 1)), '^\\d+[\\.\\-_–—]+\\s*', '')) AS left_side,
        trim(regexp_split_to_array(substr(title, instr(title, ' - ') + 3), '\\s+[-|/]+\\s+|\\s*[\\(\\[【]')[1]) AS right_side FROM (SELECT DISTINCT title FROM {_T} WHERE contains(title, ' - '))""",
    "durations": """SELECT event_id, CAST(hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS INTEGER) AS s3, CAST(minute(ts) * 60 + second(ts) AS INTEGER) AS s2,
        CAST(hour(ts) * 60 + minute(ts) AS VARCHAR) || ':' || lpad(CAST(second(ts) AS VARCHAR), 2, '0') AS shown FROM events""",
    "content_words": f"""SELECT title, array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all(lower(regexp_replace(title, '[\\(\\[\\{{].*?[\\)\\]\\}}]', '', 'g')), '[a-z]{{3,}}')),
        lambda w: w NOT IN {in_list(X.STOP_WORDS)})), ' ') AS words FROM (SELECT DISTINCT title FROM {_T} WHERE title IS NOT NULL)""",
    "match_forms": f"""SELECT id, form, regexp_replace(form, '[^\\p{{L}}\\p{{N}}]+', '', 'g') AS letters, trim(regexp_replace(form, '^(?:the|a)\\s+', '')) AS bare
        FROM (SELECT id, coalesce({_MATCH}, '') AS form FROM {NODES})""",
    "display_names": f"""SELECT genre, array_to_string(list_transform(list_filter(regexp_split_to_array(trim(genre), '\\s+'), lambda w: w <> ''), lambda w: coalesce(
        MAP {{{', '.join(f'{q(k)}: {q(v)}' for k, v in X.ACRONYMS.items())}}}[lower(w)],
        array_to_string(list_transform(regexp_extract_all(w, '\\p{{L}}+|\\P{{L}}+'), lambda r: upper(left(r, 1)) || lower(substr(r, 2))), ''))), ' ') AS shown FROM genres""",
    "reach_formats": f"""SELECT id, {_compact(_V, True)} AS fans, {_compact(_V, False)} AS listeners,
        CAST(CASE WHEN {_V} <= 0 THEN 5 ELSE least(100, greatest(5, round_even(100 * log10(greatest(1.0, {_V})) / 8.0, 0))) END AS BIGINT) AS popularity,
        CAST(greatest(1000, coalesce(subscribers, 0)) AS BIGINT) AS floor FROM {NODES}""",
    "node_sizes": f"""SELECT id, round(1.1 + 13.4 * pow({_share('log10')}, 2.6), 1) AS size, round(1.1 + 15.0 * pow({_share('sqrt')}, 1.3), 4) AS radius
        FROM (SELECT id, reach, min(reach) OVER () AS lo, max(reach) OVER () AS hi FROM (SELECT id, CAST(greatest(1000, coalesce(subscribers, 0)) AS DOUBLE) AS reach FROM {NODES}))""",
    "edge_scalars": """SELECT source, target, greatest(0.08, round(0.9 * weight, 2)) AS size, round(0.1 + 0.3 * weight, 6) AS opacity,
        round(7.0 + 5.0 * weight + 0.42 * pow(weight, 1.55), 6) AS diameter FROM (SELECT DISTINCT source, target, weight FROM atlas_edges)""",
    "colours": f"SELECT a.id, a.colour AS pipeline, b.colour AS client FROM {_colour(56, 137.507764, False)} a JOIN {_colour(46, 137.508, True)} b ON a.id = b.id",
    "slug_paths": f"SELECT id, slug, letter, path FROM {_PATHS}",
    "unique_paths": f"SELECT slug AS path, count(*) AS n FROM {_PATHS} GROUP BY 1 HAVING count(*) > 1 OR slug = '' UNION ALL SELECT path, count(*) FROM {_PATHS} GROUP BY 1 HAVING count(*) > 1 OR path = '/artist//'",
    "image_urls": f"""SELECT id, CASE WHEN image IS NULL OR contains(image, '{X.PLACEHOLDER_IMAGE}') THEN '' WHEN contains(u, 'dzcdn.net') THEN regexp_replace(u, '\\d+x\\d+-', '64x64-') ELSE u END AS small,
        CASE WHEN image IS NULL OR image = '' THEN '' WHEN contains(u, 'dzcdn.net') THEN regexp_replace(u, '\\d+x\\d+-', '500x500-')
          WHEN contains(u, 'googleusercontent.com') OR contains(u, 'ggpht.com') THEN split_part(u, '=', 1) || '=s512-c-k-c0x00ffffff-no-rj'
          WHEN contains(u, 'mzstatic.com') THEN regexp_replace(u, '\\d+x\\d+bb', '600x600bb') ELSE u END AS large FROM (SELECT id, image, {_URL} AS u FROM {NODES})""",
    "html_texts": f"SELECT doc_id, md5({_escape('text', _ESC)}) AS escaped, md5({_escape('text', _UNESC)}) AS unescaped FROM documents WHERE text IS NOT NULL",
    "inceptions": f"""SELECT id, CASE WHEN p >= 9 THEN CAST(y AS VARCHAR) || era WHEN p = 8 THEN CAST(y // 10 * 10 AS VARCHAR) || 's' || era
        ELSE CAST(c AS VARCHAR) || CASE WHEN c % 100 BETWEEN 11 AND 13 THEN 'th' WHEN c % 10 = 1 THEN 'st' WHEN c % 10 = 2 THEN 'nd' WHEN c % 10 = 3 THEN 'rd' ELSE 'th' END || ' century' || era END AS since
        FROM (SELECT id, abs(year) AS y, CASE WHEN year < 0 THEN ' BCE' ELSE '' END AS era, CAST(ceil(abs(year) / 100.0) AS INTEGER) AS c, p
          FROM (SELECT id, CAST(trunc(x) AS INTEGER) AS year, 7 + ((CAST(trunc(y) AS INTEGER) % 3) + 3) % 3 AS p FROM {NODES} WHERE x IS NOT NULL AND y IS NOT NULL)) WHERE y <> 0""",
    "filter_labels": """SELECT rank, coalesce(nullif(array_to_string(list_filter([CASE WHEN rank % 3 = 0 THEN genre END,
          CASE WHEN rank - 5 <= 0 AND rank + 60 >= 100 THEN NULL WHEN rank - 5 <= 0 THEN 'Top ' || (rank + 60) || '%' WHEN rank + 60 >= 100 THEN 'Top ' || (rank - 5) || '%–100%' ELSE (rank - 5) || '%–' || (rank + 60) || '%' END,
          CASE WHEN rank % 4 > 0 THEN 'Connections: Top ' || (100 - rank % 4) || '%' END], lambda x: x IS NOT NULL), ' · '), ''), 'Filters') AS label FROM genres""",
    "split_names": f"SELECT name, array_to_string({split_sql('name')}, '|') AS parts FROM (SELECT DISTINCT name FROM artist_catalog)",
    "descriptions": f"""SELECT rank, CASE WHEN length(s[1] || ' ' || s[2]) > 80 THEN s[1] WHEN length(array_to_string(s, ' ')) > 80 THEN s[1] || ' ' || s[2] ELSE array_to_string(s, ' ') END AS text,
          genre || CASE WHEN genre ILIKE '%s' THEN chr(39) ELSE chr(39) || 's' END AS owner FROM (SELECT rank, genre, [shown || ' on the map.', 'Found by ' || primary_query || ' and ' || secondary_query || '.',
          'Also by ' || tertiary_query || ', as far as lists go.'] AS s FROM (SELECT *, {shown_sql('genre')} AS shown FROM genres))""",
    "map_links": "SELECT rank, '/#genre=' || replace(url_encode(genre), '%20', '+') || '&view=map' AS href FROM genres",
    "list_forms": f"""SELECT id, CASE WHEN id LIKE 'VL%' THEN id ELSE 'VL' || id END AS list, coalesce(author, '') AS author, coalesce(nullif(author_id, ''), 'anon_' || left(id, 8)) AS author_id,
        ' ' || trim(regexp_replace(strip_accents(lower(coalesce(genre, ''))), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) || ' ' AS phrase, id AS tail, CAST(year(harvested_at) AS INTEGER) AS year FROM {PLAYLISTS}""",
}
