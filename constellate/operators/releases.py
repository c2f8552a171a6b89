"""Credits checked against official releases: who released a song, by votes of songs and by shared words."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from constellate.functions import text as X


def frequent_titles(tracks: DataFrame, key: str = "name", title: str = "title", k: int | None = 5) -> DataFrame:
    """(key, title, n, rank): each key's ``k`` most frequent titles, or with None all; ties by title."""
    n = tracks.where(F.col(title).isNotNull()).groupBy(key, title).agg(F.count(F.lit(1)).alias("n"))
    ranked = n.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), title)))
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def song_votes(titles: DataFrame, released: DataFrame, most: int = 5, least: int = 2) -> DataFrame:
    """(name, artist, votes): the one artist that most of a name's songs were released by.

    ``titles`` is (name, song), ``released`` (artist, song), both distinct.  At least min(``least``, songs) votes are needed, and
    a tie names nobody.
    """
    songs = titles.withColumn("r", F.row_number().over(Window.partitionBy("name").orderBy("rank", "song"))).where(F.col("r") <= most) if "rank" in titles.columns else titles
    count = songs.groupBy("name").agg(F.count(F.lit(1)).alias("songs"))
    v = songs.select("name", "song").join(released, "song").groupBy("name", "artist").agg(F.countDistinct("song").alias("votes"))
    w = Window.partitionBy("name")
    v = v.withColumn("best", F.max("votes").over(w)).where("votes = best").withColumn("ties", F.count(F.lit(1)).over(w))
    return v.join(count, "name").where((F.col("ties") == 1) & (F.col("votes") >= F.least(F.lit(least), F.col("songs")))).select("name", "artist", "votes")


def credit_by_title(tracks: DataFrame, official: DataFrame) -> DataFrame:
    """(id, pos, credit): credits that uploads take from their titles, kept only if official releases back them.

    ``tracks`` is (id, pos, artist_name, title) of tracks without a channel whose name is the left side of their title;
    ``official`` (name, song), lower case.  The first of the joint names on the left that released the right side, else of
    those on the right that released the left; else the whole left if it is official and none on the right is; else ''.
    """
    left, right = X.title_sides(F.col("title"))
    t = tracks.select("id", "pos", "artist_name", left.alias("l"), right.alias("r")).where("l is not null")
    names = official.select("name").distinct()

    def backed(side: str, other: str, tier: int) -> DataFrame:
        parts = t.select("id", "pos", X.song_key(F.col(other)).alias("song"), F.posexplode(X.joint_credit_parts(F.col(side))).alias("at", "part"))
        return parts.withColumn("name", F.lower("part")).join(official, ["name", "song"], "left_semi").select("id", "pos", F.lit(tier).alias("tier"), "at", "part")

    whole = t.select("id", "pos", X.sanitise_name(F.col("l")).alias("part")).withColumn("name", F.lower("part")).join(names, "name", "left_semi")
    on_right = t.select("id", "pos", F.explode(X.joint_credit_parts(F.col("r"))).alias("p")).withColumn("name", F.lower("p")).join(names, "name", "left_semi").select("id", "pos").distinct()
    third = whole.join(on_right, ["id", "pos"], "left_anti").select("id", "pos", F.lit(3).alias("tier"), F.lit(0).alias("at"), "part")
    best = backed("l", "r", 1).unionByName(backed("r", "l", 2)).unionByName(third).groupBy("id", "pos").agg(F.min_by("part", F.struct("tier", "at")).alias("credit"))
    return t.select("id", "pos").join(best, ["id", "pos"], "left").select("id", "pos", F.coalesce("credit", F.lit("")).alias("credit"))


def by_shared_words(targets: DataFrame, candidates: DataFrame, single: int = 2, several: int = 1) -> DataFrame:
    """(target, candidate, shared): the candidate of the same name whose tracks share the most title words with the target's.

    ``targets`` is (target, name, words array), ``candidates`` (candidate, name, words array, fans).  Names of one word need
    ``single`` shared words, others ``several``; a target without words takes the candidate with most fans.
    """
    c = targets.join(candidates.withColumnRenamed("words", "theirs"), "name").withColumn("shared", F.size(F.array_intersect("words", "theirs")))
    need = F.when(F.size("words") == 0, 0).when(F.contains("name", F.lit(" ")), several).otherwise(single)
    rank = F.row_number().over(Window.partitionBy("target").orderBy(F.desc("shared"), F.desc("fans"), "candidate"))
    return c.where(F.col("shared") >= need).withColumn("r", rank).where("r = 1").select("target", "candidate", "shared")


def competitors(targets: DataFrame, candidates: DataFrame, k: int = 5) -> DataFrame:
    """(target, candidate): up to ``k`` candidates of most fans whose name ends with the target's, or holds it as a word.

    ``targets`` is (target, form), ``candidates`` (candidate, form, fans); exploding words and endings of candidates
    makes it an equi-join.  Endings of lengths that no target has are left out before anything moves.
    """
    lengths = [r[0] for r in targets.select(F.length("form").alias("n")).distinct().where("n > 0").collect()]  # as many as names have lengths
    ends = F.transform(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: F.when(n < F.length("form"), F.right(F.col("form"), n)))
    parts = F.filter(F.array_distinct(F.concat(F.regexp_extract_all("form", F.lit("[a-zA-Z0-9]+"), F.lit(0)), ends)), lambda x: x.isNotNull())
    words = candidates.where("fans > 0").select("candidate", F.col("form").alias("whole"), "fans", F.explode(parts).alias("form"))
    hit = targets.join(words, "form").where("whole != form")
    return hit.withColumn("r", F.row_number().over(Window.partitionBy("target").orderBy(F.desc("fans"), "candidate"))).where(F.col("r") <= k).select("target", "candidate")
