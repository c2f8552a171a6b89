"""Which entity a credited name stands for: tiers of keys, shared names, merging, vocabulary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from constellate.functions import text as X


def credit_keys(catalogue: DataFrame) -> DataFrame:
    """(name, channel, id): the identity map of a catalogue (id, name, credits array of (name, channel)).

    A null channel stands for the name under any channel, an empty one for its credits without channel.  An entity's own
    name is a key, under any channel, only if no credit uses it and no other entity has it.
    """
    keys = catalogue.select("id", F.explode("credits").alias("c")).select(F.col("c.name").alias("name"), F.col("c.channel").alias("channel"), "id").where("name is not null")
    keys = keys.groupBy("name", "channel").agg(F.max("id").alias("id"))
    own = catalogue.select(F.lower(F.trim("name")).alias("name"), "id").where("name is not null").groupBy("name").agg(
        F.min("id").alias("id"), F.countDistinct("id").alias("n")).where("n = 1")
    own = own.join(keys.select("name").distinct(), "name", "left_anti").select("name", F.lit(None).cast("string").alias("channel"), "id")
    return keys.unionByName(own)


def resolve_credits(credits: DataFrame, keys: DataFrame) -> DataFrame:
    """``credits`` (columns name, channel, ...) with ``entity``: by exact (name, channel), else by the name under any
    channel, else by the parts of a joint credit; null where none fits.

    Keys with a null channel and keys with a channel are joined apart, so that null never has to equal null.
    """
    exact = keys.where("channel is not null").select("name", "channel", F.col("id").alias("by_channel"))
    any_ = keys.where("channel is null").select("name", F.col("id").alias("by_name"))
    c = credits.withColumn("channel", F.coalesce("channel", F.lit("")))
    return (
        c.join(exact, ["name", "channel"], "left").join(any_, "name", "left")
        .withColumn("entity", F.coalesce("by_channel", "by_name")).drop("by_channel", "by_name")
    )


def resolve_parts(unresolved: DataFrame, raw: str, keys: DataFrame) -> DataFrame:
    """(raw, entity) by the parts of joint credits that :func:`resolve_credits` left open; a part equal to the whole is none."""
    part = F.explode(X.split_names(F.col("__raw"))).alias("part")
    p = unresolved.select(F.col(raw).alias("__raw")).distinct().select("__raw", part).select("__raw", F.lower(F.trim("part")).alias("name"))
    resolved = resolve_credits(p.where(F.col("name") != F.lower(F.trim("__raw"))).withColumn("channel", F.lit("")), keys)
    return resolved.where("entity is not null").select(F.col("__raw").alias(raw), "entity").distinct()


def tiered_name_match(targets: DataFrame, candidates: DataFrame) -> DataFrame:
    """(target, candidate, tier): exact, then regardless of signs, then of a leading article; most fans wins, then the
    earlier id.  ``targets`` is (target, form), ``candidates`` (candidate, form, fans), forms by ``match_form``."""
    def keyed(df: DataFrame) -> DataFrame:
        f = F.col("form")
        letters, bare = X.letters_form(f), X.without_article(f)
        keys = F.array(
            F.struct(F.lit(1).alias("tier"), F.when(f != "", f).alias("key")),
            F.struct(F.lit(2).alias("tier"), F.when(F.length(letters) >= 3, letters).alias("key")),
            F.struct(F.lit(3).alias("tier"), F.when(F.length(bare) >= 3, bare).alias("key")))
        return df.withColumn("k", F.explode(keys)).select(*[c for c in df.columns if c != "form"], "k.tier", "k.key").where("key is not null")

    hit = keyed(targets).join(keyed(candidates), ["tier", "key"])
    best = F.row_number().over(Window.partitionBy("target").orderBy("tier", F.desc("fans"), "candidate"))
    return hit.withColumn("r", best).where("r = 1").select("target", "candidate", "tier")


def shared_names(credits: DataFrame, least: int = 4) -> DataFrame:
    """(name, channel, units): candidates of resolution from credits (name, channel, unit).

    A name is shared if two or more of its channels each reach ``least`` independent units; then every channel that does is a
    candidate of its own, else the name as a whole (null channel) if it reaches ``least``.
    """
    c = credits.select("name", F.coalesce("channel", F.lit("")).alias("channel"), "unit").distinct()
    by_channel = c.groupBy("name", "channel").agg(F.count(F.lit(1)).alias("units")).where((F.col("units") >= least) & (F.col("channel") != ""))
    shared = by_channel.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("name")
    each = by_channel.join(shared, "name", "left_semi")
    whole = c.select("name", "unit").distinct().groupBy("name").agg(F.count(F.lit(1)).alias("units")).where(F.col("units") >= least).join(shared, "name", "left_anti")
    return each.unionByName(whole.select("name", F.lit(None).cast("string").alias("channel"), "units"))


def display_case(names: DataFrame, key: Column, name: str, order: list) -> DataFrame:
    """(key, shown): of each name the last spelling that begins with a capital, else the first."""
    capital = F.col(name).rlike(r"^\p{Lu}")
    o = F.struct(*order)
    return names.groupBy(key.alias("key")).agg(F.coalesce(F.max_by(name, F.when(capital, o)), F.min_by(name, o)).alias("shown"))


def merge_entities(records: DataFrame, unit: str = "units") -> DataFrame:
    """(id, name, fans, units, records): records of one resolved id merged; the one with most fans (then the earliest) names it."""
    exploded = records.select("id", "seq", "name", "fans", F.explode_outer(unit).alias("u"))
    best = records.groupBy("id").agg(F.max_by(F.struct("name", "fans"), F.struct("fans", -F.col("seq"))).alias("b"), F.count(F.lit(1)).alias("records"))
    return best.join(exploded.groupBy("id").agg(F.countDistinct("u").alias("units")), "id").select("id", "b.name", "b.fans", "units", "records")


def vocabulary_match(names: DataFrame, items: DataFrame) -> DataFrame:
    """(name, item, matched): each name's unique item by label, else by alias if no item has that label.

    ``names`` is (name), ``items`` (item, label, aliases); a name that several items claim in its tier matches none.
    """
    n = names.select("name").distinct()
    labels = items.select(F.col("label").alias("name"), "item").distinct()
    aliases = items.select(F.explode("aliases").alias("name"), "item").distinct().join(labels.select("name").distinct(), "name", "left_anti")
    tier = lambda df, by: df.groupBy("name").agg(F.min("item").alias("item"), F.count(F.lit(1)).alias("n")).where("n = 1").select("name", "item", F.lit(by).alias("matched"))
    return n.join(tier(labels, "label").unionByName(tier(aliases, "alias")), "name")


def names_of_items(matches: DataFrame) -> DataFrame:
    """(item, name): the reverse map, in which an item matched by label loses the names that only aliases give it."""
    by_label = F.max(F.col("matched") == "label").over(Window.partitionBy("item"))
    return matches.withColumn("l", by_label).where("not l or matched = 'label'").select("item", "name")
