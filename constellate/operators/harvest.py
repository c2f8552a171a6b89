"""What a harvest works on: labels to search, candidate lists, credits of tracks, facts of labels, resumption."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from constellate.functions import text as X

# Labels that name sounds, not music.
NO_MUSIC = [
    "sound", "white noise", "sleep", "rain", "meditation", "asmr", "pink noise", "nature sounds", "sound effects", "guided meditation",
    "birdsong", "hypnosis", "ocean", "general",
]
# Labels taken in each tier.
TIER_LABELS = {1: 500, 2: 1500, 3: 3000, 4: 6291}


def musical(labels: DataFrame, label: str = "genre") -> DataFrame:
    """``labels`` without those that name no music, regardless of case and blanks; null labels stay out as well."""
    return labels.where(~F.lower(F.trim(label)).isin(*NO_MUSIC))


def top_labels(labels: DataFrame, rank: str = "rank", tier: int = 2, limit: int | None = None) -> DataFrame:
    """The first labels by ``rank``: as many as the tier takes, or ``limit``; equal ranks by all other columns."""
    rest = [F.asc(c) for c in labels.columns if c != rank]
    return labels.orderBy(F.asc_nulls_last(rank), *rest).limit(TIER_LABELS[tier] if limit is None else limit)


def candidate_lists(found: DataFrame, label: str, enough: int = 35) -> DataFrame:
    """(label, id, query, place): lists found for a label by its queries in turn, each once, at its first mention.

    ``found`` is (label, query, pos, id).  A query is asked only while fewer than ``enough`` lists are known, and then taken
    whole; ``place`` is the order of first mention, from 1.  Nulls in label or id are left out.
    """
    first = found.where(F.col(label).isNotNull() & F.col("id").isNotNull()).groupBy(label, "id").agg(F.min(F.struct("query", "pos")).alias("f"))
    first = first.select(label, "id", "f.query", "f.pos")
    w = Window.partitionBy(label).orderBy("query")
    known = first.groupBy(label, "query").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "before", F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    asked = known.where(F.col("before") < enough).select(label, "query")
    place = F.row_number().over(Window.partitionBy(label).orderBy("query", "pos", "id"))
    return first.join(asked, [label, "query"]).withColumn("place", place).select(label, "id", "query", "place")


def track_credits(tracks: DataFrame, uploaders: DataFrame, container: str = "id", channel: str = "artist_name", title: str = "title", channel_id: str = "channel_id") -> DataFrame:
    """``tracks`` with ``credit`` and ``credit_channel``: under an uploader's channel the left side of the title (two
    characters or more) names the artist and has no channel; else the channel does.  Null where neither names one.

    ``uploaders`` is (container, channel) in lower case, as :func:`constellate.operators.quality.uploader_channels` finds them.
    """
    u = uploaders.select(F.col(container).alias("__c"), F.col("channel").alias("__u")).distinct()
    left, _ = X.title_sides(F.col(title))
    name = F.lower(F.trim(channel))
    t = tracks.withColumn("__left", left).join(u, (F.col(container) == F.col("__c")) & (name == F.col("__u")), "left")
    typed = F.col("__u").isNotNull() & (F.length("__left") > 1)
    raw = F.nullif(F.when(typed, F.col("__left")).otherwise(F.trim(channel)), F.lit(""))
    t = t.withColumn("credit", X.sanitise_name(raw)).withColumn("credit_channel", F.when(typed | raw.isNull(), None).otherwise(F.col(channel_id)))
    return t.drop("__left", "__c", "__u")


def kept_tracks(tracks: DataFrame, title: str, seconds: str, longest: int = 600) -> DataFrame:
    """Tracks that are single ones by their title and, where known, no longer than ``longest`` seconds; with ``catalogue``:
    whether they also qualify for the catalogue (:func:`constellate.functions.text.is_catalogue_track`)."""
    short = F.coalesce(F.col(seconds) <= longest, F.lit(True))
    return tracks.where(~X.is_no_track(F.col(title)) & short).withColumn("catalogue", X.is_catalogue_track(F.col(title), F.col(seconds)))


def open_curators(lists: DataFrame, accepted: DataFrame, curator: str, cap: int = 2, exempt: str | None = None) -> DataFrame:
    """Rows of ``lists`` whose curator has fewer than ``cap`` accepted lists: the others are not worth a request."""
    full = accepted.groupBy(curator).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= cap).select(F.col(curator).alias("__full"))
    if exempt is not None:
        full = full.where(F.col("__full") != exempt)
    return lists.join(full, F.col(curator).eqNullSafe(F.col("__full")), "left_anti")


def item_facts(statements: DataFrame) -> DataFrame:
    """(item, aliases, year, precision): sorted distinct aliases, and the earliest inception, of equal years the most precise.

    ``statements`` is (item, alias, year, precision), any of the last three null.
    """
    dated = F.when(F.col("year").isNotNull(), F.struct(F.col("year"), -F.col("precision")))
    return statements.where("item is not null").groupBy("item").agg(
        F.array_sort(F.collect_set("alias")).alias("aliases"), F.min(dated).alias("d")).select(
        "item", "aliases", F.col("d.year").alias("year"), (-F.col("d.col2")).alias("precision"))


def label_facts(items: DataFrame, placeholder: str = "music genre") -> DataFrame:
    """``items`` with ``desc`` null where empty or the placeholder, and ``wiki`` null where it is no https address."""
    desc = F.when((F.lower("desc") != placeholder) & (F.col("desc") != ""), F.col("desc"))
    return items.withColumn("desc", desc).withColumn("wiki", F.when(F.col("wiki").startswith("https://"), F.col("wiki")))


def added_counts(*tables: DataFrame) -> DataFrame:
    """(key, n): the sum of multisets, each (key, n)."""
    every = tables[0]
    for t in tables[1:]:
        every = every.unionByName(t)
    return every.groupBy("key").agg(F.sum("n").alias("n"))


def under_target(found: DataFrame, labels: DataFrame, revisited: DataFrame, target: int) -> DataFrame:
    """(label): labels with fewer than ``target`` lists found that no earlier phase revisited: each is queued again once."""
    n = labels.select("label").distinct().join(found.select(F.col("key").alias("label"), "n"), "label", "left")
    return n.where(F.coalesce("n", F.lit(0)) < target).select("label").join(revisited.select("label"), "label", "left_anti")


def summary(df: DataFrame, column: str) -> DataFrame:
    """(n, least, middle, most) of the values of a column, null ones aside; the median is exact."""
    c = F.col(column)
    return df.where(c.isNotNull()).agg(F.count(F.lit(1)).alias("n"), F.min(c).alias("least"), F.median(c).alias("middle"), F.max(c).alias("most"))


def confirmed_facts(stated: DataFrame, lifts: DataFrame, least: float = 1.0) -> DataFrame:
    """(member, label): stated labels whose lift over the containers that carry them is ``least`` or more."""
    return stated.select("member", "label").distinct().join(lifts.where(F.col("lift") >= least).select("member", "label"), ["member", "label"])


def shown_facts(confirmed: DataFrame) -> DataFrame:
    """(member, facts): confirmed labels as shown, distinct and sorted."""
    return confirmed.groupBy("member").agg(F.array_sort(F.collect_set(X.display_name(F.col("label")))).alias("facts"))


def positional(columns: list[Column]) -> Column:
    """A row as a JSON array of its columns in order, null as ``null``; unpack with :func:`unpacked`."""
    one = [F.regexp_replace(F.to_json(F.array(c), {"ignoreNullFields": "false"}), r"^\[|\]$", "") for c in columns]
    return F.concat(F.lit("["), F.concat_ws(",", *one), F.lit("]"))


def unpacked(text: Column, fields: list[tuple[str, str]]) -> list[Column]:
    """The columns (name, type) of a row packed by :func:`positional`."""
    parts = F.from_json(text, "array<string>")
    return [F.get(parts, F.lit(i)).cast(kind).alias(name) for i, (name, kind) in enumerate(fields)]
