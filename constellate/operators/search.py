"""Tiered search over member and label names."""

from __future__ import annotations

import unicodedata as ud

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from constellate.functions import text as X


def query_form(text: str) -> str:
    """The form of a query that is compared with indexed names."""
    return "".join(c for c in ud.normalize("NFD", text) if not "̀" <= c <= "ͯ").lower().strip()


def member_index(nodes: DataFrame) -> DataFrame:
    """(id, label, form, words, tags, place, reach) from (id, label, tags, place, reach): what a search compares."""
    form = X.search_form(F.col("label"))
    n = nodes.select("id", "label", form.alias("form"), "tags", "place", F.coalesce("reach", F.lit(0)).alias("reach"))
    fold = lambda c: F.split(X.search_form(F.array_join(c, "\n")), "\n")
    return n.withColumn("words", F.filter(F.split("form", r"[\s\-_–—,.'\"/]+"), lambda w: w != "")).withColumn(
        "tags", F.filter(fold(F.coalesce("tags", F.array().cast("array<string>"))), lambda t: t != "")).withColumn("place", X.search_form(F.col("place")))


def search_members(index: DataFrame, query: str, limit: int = 10, stop: int = 25) -> DataFrame:
    """(position, id, label, tier): best matches first.

    Tiers: 1 the whole name, 2 its beginning, 3 the beginning of a word, 4 all words of the query, 5 anywhere in it, 6 a tag or
    place.  Within a tier greater reach comes first, then the lesser id.  The scan in that order ends at the row with
    which tiers 1 to 3 hold ``stop`` rows; it is found as the ``stop``-th best of them, so that nothing is sorted as a whole.
    """
    q = query_form(query)
    if not q:
        return index.limit(0).select(F.lit(0).alias("position"), "id", "label", F.lit(0).alias("tier"))
    f, words = F.col("form"), q.split()
    inside = F.contains(f, F.lit(q))
    tier = F.when(f == q, 1).when(f.startswith(q), 2).when(F.exists("words", lambda w: w.startswith(q)), 3)
    named = F.when(inside, F.coalesce(tier, F.lit(5) if len(q) > 1 else F.lit(None)))
    if len(words) > 1:
        every = F.lit(True)
        for w in words:
            every = every & F.contains(f, F.lit(w))
        named = F.coalesce(named, F.when(~inside & every, 4))
    tagged = F.when(F.contains("place", F.lit(q)) | F.exists("tags", lambda t: F.contains(t, F.lit(q))), 6) if len(q) > 2 else F.lit(None)
    hits = index.select("id", "label", "reach", F.coalesce(named, tagged).cast("int").alias("tier")).where("tier is not null")
    order = [F.desc("reach"), F.asc("id")]
    best = hits.where("tier <= 3").orderBy(*order).limit(stop)
    last = best.agg(F.when(F.count(F.lit(1)) == stop, F.min(F.struct("reach", (-F.lit(1)).alias("z")))).alias("e"), F.count(F.lit(1)).alias("n"))
    end = last.select(F.col("e.reach")).scalar()
    last_id = best.groupBy().agg(F.max_by("id", F.struct(-F.col("reach"), "id"))).scalar()
    kept = hits.where(end.isNull() | (F.col("reach") > end) | ((F.col("reach") == end) & (F.col("id") <= last_id)))
    top = kept.orderBy("tier", *order).limit(limit)
    listed = top.agg(F.array_sort(F.collect_list(F.struct("tier", (-F.col("reach")).alias("o"), "id", "label"))).alias("rows"))  # limit rows
    return listed.select(F.posexplode("rows").alias("position", "r")).select((F.col("position") + 1).alias("position"), "r.id", "r.label", "r.tier")


def search_labels(labels: DataFrame, query: str, limit: int = 4) -> DataFrame:
    """(position, label, tier) from (label, size): whole, beginning, beginning of a word, anywhere; larger labels first."""
    q = query_form(query)
    form = X.search_form(F.col("label"))
    words = F.filter(F.split(form, r"[\s\-_/&]+"), lambda w: w != "")
    tier = F.when(form == q, 1).when(form.startswith(q), 2).when(F.exists(words, lambda w: w.startswith(q)), 3).when(F.contains(form, F.lit(q)), 4)
    hits = labels.select("label", "size", tier.alias("tier")).where("tier is not null") if len(q) >= 2 else labels.select("label", "size", F.lit(0).alias("tier")).limit(0)
    top = hits.orderBy("tier", F.desc("size"), "label").limit(limit)
    listed = top.agg(F.array_sort(F.collect_list(F.struct("tier", (-F.col("size")).alias("o"), "label"))).alias("rows"))
    return listed.select(F.posexplode("rows").alias("position", "r")).select((F.col("position") + 1).alias("position"), "r.label", "r.tier")


def search_all(index: DataFrame, labels: DataFrame, query: str, members: int = 10, labels_: int = 4) -> DataFrame:
    """(kind, position, name): labels first, then members."""
    return search_labels(labels, query, labels_).select(F.lit("label").alias("kind"), "position", F.col("label").alias("name")).unionByName(
        search_members(index, query, members).select(F.lit("member").alias("kind"), "position", F.col("label").alias("name")))
