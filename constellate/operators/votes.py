"""Labels by evidence: how often members occur under labels, votes of members on containers, lift, tags in tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from constellate.session import materialize


def evidence(labelled: DataFrame) -> DataFrame:
    """(member, label, n, size) from (container, label, member): containers of the label with the member, and in all."""
    d = materialize(labelled.select("container", "label", "member").distinct(), "evidence")
    n = d.groupBy("member", "label").agg(F.count(F.lit(1)).alias("n"))
    size = d.select("container", "label").distinct().groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    return n.join(size, "label").select("member", "label", "n", "size")


def core_labels(evidence_: DataFrame, least: int = 2) -> DataFrame:
    """(member, label, coverage, best): labels in which a member occurs ``least`` times, and its greatest coverage of any."""
    e = evidence_.where(F.col("n") >= least).withColumn("coverage", F.col("n") / F.col("size"))
    return e.withColumn("best", F.max("coverage").over(Window.partitionBy("member"))).select("member", "label", "coverage", "best")


def votes(members: DataFrame, evidence_: DataFrame, own: DataFrame | None = None) -> DataFrame:
    """(container, label, votes): every member has one vote, split by its coverage of the labels it occurs in twice.

    ``members`` is (container, member).  Containers of ``own`` (container, label) are judged as if they were not part of
    the evidence: their label's count and size are one less for their own members.
    """
    m = members.select("container", "member").distinct().join(evidence_, "member")
    if own is not None:
        m = m.join(own.select("container", F.col("label").alias("own")), "container", "left")
        less = F.when(F.col("own").eqNullSafe(F.col("label")), 1).otherwise(0)
        m = m.withColumn("n", F.col("n") - less).withColumn("size", F.col("size") - less)
    m = m.where("n >= 2").withColumn("share", F.col("n") / F.col("size"))
    total = m.groupBy("container", "member").agg(F.sum("share").alias("total"))
    return m.join(total, ["container", "member"]).groupBy("container", "label").agg(F.sum(F.col("share") / F.col("total")).alias("votes"))


def ranked_votes(votes_: DataFrame, members: DataFrame) -> DataFrame:
    """``votes`` with the container's ``size`` (members, voters or not), ``rank`` and the best ``rival`` of each label."""
    size = members.select("container", "member").distinct().groupBy("container").agg(F.count(F.lit(1)).alias("size"))
    w = Window.partitionBy("container").orderBy(F.desc("votes"), "label")
    r = votes_.join(size, "container").withColumn("rank", F.row_number().over(w))
    whole = Window.partitionBy("container")
    first = F.max(F.when(F.col("rank") == 1, F.col("votes"))).over(whole)
    second = F.coalesce(F.max(F.when(F.col("rank") == 2, F.col("votes"))).over(whole), F.lit(0.0))
    return r.withColumn("rival", F.when(F.col("rank") == 1, second).otherwise(first))


def clear(score: float = 0.15, margin: float = 1.5, least: int = 5) -> Column:
    """Whether a ranked label is the container's clear best one: enough members, share of votes, and lead."""
    return (F.col("size") >= least) & (F.col("votes") / F.col("size") >= score) & (F.col("votes") >= margin * F.col("rival"))


def judged_labels(containers: DataFrame, members: DataFrame) -> DataFrame:
    """(container, judged): labels judged anew by the votes of search containers.

    ``containers`` is (container, label, source).  A search container keeps its label only if it clearly belongs to it,
    judged without itself; a recommended one gets its clear best label; others keep theirs; '' is none.
    """
    members = materialize(members.select("container", "member").distinct(), "members")  # these are read four times
    labelled = materialize(containers.select("container", F.coalesce("label", F.lit("")).alias("label"), "source"), "labelled")
    search = labelled.where("source = 'search' and label != ''").select("container", "label")
    e = materialize(evidence(search.join(members, "container")), "evidence")
    own = ranked_votes(votes(members.join(search.select("container"), "container", "left_semi"), e, search), members)
    belongs = own.where(clear()).join(search, ["container", "label"], "left_semi").select("container", F.col("label").alias("judged"))
    other = labelled.where("source = 'recommended'").select("container")
    best = ranked_votes(votes(members.join(other, "container", "left_semi"), e), members).where((F.col("rank") == 1) & clear()).select("container", F.col("label").alias("judged"))
    voted = belongs.unionByName(best)
    kept = F.when(F.coalesce("source", F.lit("")).isin("search", "recommended"), F.coalesce("judged", F.lit(""))).otherwise(F.col("label"))
    return labelled.join(voted, "container", "left").select("container", kept.alias("judged"))


def seed_labels(seeds: DataFrame, members: DataFrame, core: DataFrame, least: float = 0.3, relative: float = 0.5) -> DataFrame:
    """(container, label): the seed label if enough members are core to it and it is near the best, else the best if
    confident, else ''.  ``seeds`` is (container, seed); of equal labels the greatest name is the best."""
    size = members.select("container", "member").distinct().groupBy("container").agg(F.count(F.lit(1)).alias("n"))
    hits = members.select("container", "member").distinct().join(core.select("member", "label"), "member").groupBy("container", "label").agg(F.count(F.lit(1)).alias("hits"))
    best = hits.groupBy("container").agg(F.max(F.struct("hits", "label")).alias("b"))
    s = (
        seeds.join(size, "container", "left").join(best, "container", "left")
        .join(hits.select("container", F.col("label").alias("seed"), F.col("hits").alias("seed_hits")), ["container", "seed"], "left")
    )
    n, top, own = F.greatest(F.lit(1), F.coalesce("n", F.lit(0))), F.coalesce("b.hits", F.lit(0)), F.coalesce("seed_hits", F.lit(0))
    label = F.when(F.col("seed").isNotNull() & (own / n >= least) & (own >= relative * top), F.col("seed")).when(top / n >= least, F.col("b.label")).otherwise("")
    return s.select("container", label.alias("label"))


def lift_table(rows: DataFrame) -> DataFrame:
    """(member, label, c, lift) from (unit, label, member): independent units, and how far they exceed chance."""
    d = rows.where("label is not null and label != ''").select("unit", "label", "member").distinct()
    c = d.groupBy("member", "label").agg(F.count(F.lit(1)).alias("c"))
    by_member = c.groupBy("member").agg(F.sum("c").alias("of_member"))
    by_label = c.groupBy("label").agg(F.sum("c").alias("of_label"))
    total = c.agg(F.sum("c").alias("total")).scalar()
    return (
        c.join(by_member, "member").join(by_label, "label")
        .select("member", "label", "c", (F.col("c") * total / (F.col("of_member") * F.col("of_label"))).alias("lift"))
    )


def lift_ranking(lifts: DataFrame, units: int = 2, floor: float = 0.1, least: float = 1.0, relative: float = 0.5) -> DataFrame:
    """(member, label, rank): labels with enough units and lift, strongest first; ties by count, then name, all descending."""
    w = Window.partitionBy("member")
    e = lifts.withColumn("most", F.max("c").over(w)).where(F.col("c") >= F.greatest(F.lit(float(units)), floor * F.col("most")))
    e = e.withColumn("top", F.max("lift").over(w)).where((F.col("lift") >= least) & (F.col("lift") >= relative * F.col("top")))
    rank = F.row_number().over(w.orderBy(F.desc("lift"), F.desc("c"), F.desc("label")))
    return e.withColumn("rank", rank).select("member", "label", "rank")


def tag_tiers(stated: DataFrame, carrying: DataFrame, consensus: DataFrame, fallback: DataFrame, ranks: DataFrame, most: int = 3) -> DataFrame:
    """(member, tags, source): the first tier with a tag - stated labels that some container carries, the consensus
    ranking, the best label of the fallback ranking - else none.

    ``stated`` is (member, label), ``carrying`` (member, label, n), the rankings (member, label, rank), ``ranks`` (label, place).
    """
    s = stated.distinct().join(carrying, ["member", "label"], "left").join(ranks, "label", "left")
    order = [F.desc(F.coalesce("n", F.lit(0))), F.coalesce("place", F.lit(9999)), F.col("label")]
    s = s.where("n >= 1").withColumn("rank", F.row_number().over(Window.partitionBy("member").orderBy(*order)))
    tiers = (
        s.where(F.col("rank") <= most).select("member", "label", "rank", F.lit(1).alias("tier"))
        .unionByName(consensus.where(F.col("rank") <= most).select("member", "label", "rank", F.lit(2).alias("tier")))
        .unionByName(fallback.where("rank <= 1").select("member", "label", "rank", F.lit(3).alias("tier")))
    )
    best = tiers.groupBy("member").agg(F.min("tier").alias("tier"))
    chosen = tiers.join(best, ["member", "tier"]).groupBy("member", "tier").agg(F.array_sort(F.collect_list(F.struct("rank", "label"))).alias("t"))
    every = stated.select("member").unionByName(carrying.select("member")).distinct()
    source = F.coalesce(F.element_at(F.create_map(F.lit(1), F.lit("stated"), F.lit(2), F.lit("consensus"), F.lit(3), F.lit("fallback")), F.col("tier")), F.lit("none"))
    return every.join(chosen, "member", "left").select("member", F.coalesce(F.col("t.label"), F.array().cast("array<string>")).alias("tags"), source.alias("source"))


def neighbour_check(tags: DataFrame, neighbours: DataFrame, confirmed: DataFrame, stated: DataFrame, k: int = 10, most: int = 3) -> DataFrame:
    """(member, tags): tags that are confirmed or that one of the ``k`` strongest neighbours carries; failing these the
    stated labels most carried by the neighbours, failing these the first stated ones.

    Neighbours are judged on their unchecked tags.  ``tags`` is (member, tags array), ``neighbours`` (member, other, rank),
    ``confirmed`` (member, label), ``stated`` (member, label, place).
    """
    near = neighbours.where(F.col("rank") <= k).select("member", "other")
    carried = near.join(tags.select(F.col("member").alias("other"), F.explode("tags").alias("label")), "other").groupBy("member", "label").agg(F.count(F.lit(1)).alias("n"))
    own = tags.select("member", F.posexplode("tags").alias("pos", "label")).join(carried, ["member", "label"], "left").join(
        confirmed.distinct().withColumn("sure", F.lit(True)), ["member", "label"], "left")
    held = lambda df: F.transform(F.array_sort(F.collect_list(F.struct(*df))), lambda x: x["label"])
    kept = own.where("n >= 1 or sure").groupBy("member").agg(held(["pos", "label"]).alias("kept"))
    s = stated.join(carried, ["member", "label"], "left")
    rescued = s.where("n >= 1").groupBy("member").agg(held([(-F.col("n")).alias("o"), F.col("label")]).alias("rescued"))
    first = s.groupBy("member").agg(held(["place", "label"]).alias("first"))
    empty = F.array().cast("array<string>")
    pick = F.coalesce("kept", F.slice("rescued", 1, most), F.slice("first", 1, most), empty)
    return tags.select("member").join(kept, "member", "left").join(rescued, "member", "left").join(first, "member", "left").select("member", pick.alias("tags"))


def anchors(counts: DataFrame, songs: DataFrame, k: int, home: float = 0.5) -> DataFrame:
    """(label, member, song, rank): verified anchors of each label with their most frequent song.

    ``counts`` is (label, member, n, named, size, named_size): containers of the label with the member, all and those
    named after it.  With two or more named containers these count, else all.  An anchor needs two of them, and its
    coverage of the label must be at least ``home`` of its greatest coverage of any label it is core to.
    ``songs`` is (label, member, song, n, named).
    """
    c = counts.withColumn("by_name", F.col("named_size") >= 2).withColumn("used", F.when(F.col("by_name"), F.col("named")).otherwise(F.col("n")))
    cover = F.col("n") / F.col("size")
    best = F.coalesce(F.max(F.when(F.col("n") >= 2, cover)).over(Window.partitionBy("member")), F.lit(0.0))
    v = c.withColumn("best", best).where((F.col("used") >= 2) & (cover >= home * F.col("best")))
    s = songs.join(c.select("label", "by_name").distinct(), "label").withColumn("heard", F.when(F.col("by_name"), F.col("named")).otherwise(F.col("n"))).where("heard >= 1")
    song = s.withColumn("r", F.row_number().over(Window.partitionBy("label", "member").orderBy(F.desc("heard"), "song"))).where("r = 1").select("label", "member", "song")
    rank = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("used"), F.desc("n"), "member"))
    return v.join(song, ["label", "member"]).withColumn("rank", rank).where(F.col("rank") <= k).select("label", "member", "song", "rank")


def round_robin(rows: DataFrame, group: str, root: str, order: list, k: int) -> DataFrame:
    """The first ``k`` rows of each group, where every root gives one before any gives a second."""
    turn = F.row_number().over(Window.partitionBy(group, root).orderBy(*order))
    place = F.row_number().over(Window.partitionBy(group).orderBy("turn", *order))
    return rows.withColumn("turn", turn).withColumn("place", place).where(F.col("place") <= k).drop("turn")
