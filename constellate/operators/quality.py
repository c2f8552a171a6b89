"""Guards and de-duplication of containers: sizes, dominant members, curator caps, copies, acceptance in order."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from constellate.session import materialize


def size_guard(items: DataFrame, container: str, least: int = 10, most: int = 150) -> DataFrame:
    """(container, n) of containers with ``least`` to ``most`` rows."""
    return items.groupBy(container).agg(F.count(F.lit(1)).alias("n")).where(F.col("n").between(least, most))


def dominant_member_guard(items: DataFrame, container: str, member: str, most: float = 0.5) -> DataFrame:
    """(container, share) where no member holds more than ``most`` of the rows with a member."""
    named = items.where(F.col(member).isNotNull() & (F.col(member) != ""))
    per = named.groupBy(container, member).agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy(container).agg((F.max("n") / F.sum("n")).alias("share")).where(F.col("share") <= most)


def cap_per_key(rows: DataFrame, key: str, order: list, cap: int = 2, exempt: str | None = None) -> DataFrame:
    """The first ``cap`` rows of each key; rows of the ``exempt`` key are all kept.  Null is a key."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    if exempt is None:
        return rows.withColumn("__rank", rank).where(F.col("__rank") <= cap).drop("__rank")
    capped = rows.where(~F.col(key).eqNullSafe(F.lit(exempt))).withColumn("__rank", rank).where(F.col("__rank") <= cap).drop("__rank")
    return capped.unionByName(rows.where(F.col(key).eqNullSafe(F.lit(exempt))))


def uploader_channels(tracks: DataFrame, container: str, channel: str, title: str) -> DataFrame:
    """(container, channel, prefixes): channels under two or more title prefixes that are not their own name."""
    prefix = F.lower(F.trim(F.substring_index(title, " - ", 1)))
    t = tracks.select(container, F.lower(F.trim(channel)).alias("channel"), F.when(F.contains(title, F.lit(" - ")), prefix).alias("prefix"))
    t = t.where("channel != '' and prefix != '' and prefix != channel").distinct()
    return t.groupBy(container, "channel").agg(F.count(F.lit(1)).alias("prefixes")).where("prefixes >= 2")


def consensus(members: DataFrame, group: str, container: str, member: str, least: int = 2) -> DataFrame:
    """(group, container, score): candidates by how many of their members ``least`` candidates of the group share.

    Candidates without such a member are dropped, unless the group has no such member at all.
    """
    m = members.select(group, container, member).where(F.col(member).isNotNull()).distinct()
    shared = m.groupBy(group, member).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select(group, member)
    scored = m.join(shared, [group, member], "left_semi").groupBy(group, container).agg(F.count(F.lit(1)).alias("score"))
    every = m.select(group, container).distinct()
    none = every.join(shared.select(group).distinct(), group, "left_anti").withColumn("score", F.lit(0).cast("bigint"))
    return scored.unionByName(none.select(*scored.columns))


def copies(items: DataFrame, container: str, item: str, overlap: float = 0.9) -> tuple[DataFrame, DataFrame]:
    """Containers that are copies of one another: (membership, links).

    ``membership`` is (container, class): containers of exactly the same items are one class, named by its least
    container.  ``links`` is (a, b, shared, n_a, n_b), a < b: classes that share at least ``overlap`` of the smaller
    one's items.  Exact, by prefix filtering: the smaller of two such sets holds at most floor((1 - overlap) * n) items
    that the other lacks, so one of its first floor((1 - overlap) * n) + 1 items, rarest first, is in the other; only
    these few rare items of each set are looked up, so that frequent items make no pairs.
    """
    inc = items.select(F.col(container).alias("c"), F.col(item).alias("x")).where("c is not null and x is not null").distinct()
    sets = inc.groupBy("c").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    # Equal sets merge in the map tasks, so that very many copies of one set are no hot group.
    sets = materialize(sets.withColumn("h", F.md5(F.to_json(F.struct("xs")))), "sets")
    first = sets.groupBy("h").agg(F.min("c").alias("class"))
    membership = materialize(sets.select("c", "h").join(first, "h").select(F.col("c").alias(container), "class"), "classes")
    heads = membership.select(F.col("class").alias("c")).distinct()
    inc = materialize(inc.join(heads, "c", "left_semi"), "sets")
    count = inc.groupBy("x").agg(F.count(F.lit(1)).alias("df"))
    order = Window.partitionBy("c").orderBy("df", "x")
    ranked = inc.join(count, "x").withColumn("r", F.row_number().over(order)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("c")))
    allowed = F.floor((1.0 - overlap) * F.col("n") + 1e-9) + 1
    prefix = ranked.where((F.col("r") <= allowed) & (F.col("df") > 1)).select("x", F.col("c").alias("s"), F.col("n").alias("n_s"))
    sizes = ranked.select("x", F.col("c").alias("t"), F.col("n").alias("n_t"))
    near = prefix.join(sizes, "x").where("s != t and n_s <= n_t").select(F.least("s", "t").alias("a"), F.greatest("s", "t").alias("b")).distinct()
    arrays = sets.select("c", "xs").join(heads, "c", "left_semi")
    both = near.join(arrays.toDF("a", "xa"), "a").join(arrays.toDF("b", "xb"), "b")
    links = both.select("a", "b", F.size(F.array_intersect("xa", "xb")).cast("bigint").alias("shared"), F.size("xa").cast("bigint").alias("n_a"), F.size("xb").cast("bigint").alias("n_b"))
    return membership, links.where(F.col("shared") >= overlap * F.least("n_a", "n_b") - 1e-9)


def accept_in_order(rows: DataFrame, links: DataFrame, cap: int | None = 2) -> DataFrame:
    """(id, accepted): acceptance one by one in the order of ``seq``, decided in parallel.

    A row is rejected if it is linked to an accepted earlier one (a copy), or if ``cap`` earlier rows of its ``curator``
    are accepted already; rejected rows do not count.  ``rows`` is (id, seq, curator), ``links`` (a, b); a null curator is
    one.  Rounds work on the undecided rows alone: copies of accepted rows and rows of curators at their cap go; of each
    curator the first rows that its cap leaves room for are accepted, unless they wait for an undecided row that they are
    linked to.  Map tasks send at most ``cap`` rows of a curator, however many it has, and the rounds end after the longest
    chain of rows that truly wait for one another.
    """
    every = materialize(rows.select("id", "seq", "curator"), "accept")
    order = every.select("id", "seq")
    e = links.join(order.toDF("a", "sa"), "a").join(order.toDF("b", "sb"), "b").select(
        F.when(F.col("sa") < F.col("sb"), F.col("a")).otherwise(F.col("b")).alias("earlier"),
        F.when(F.col("sa") < F.col("sb"), F.col("b")).otherwise(F.col("a")).alias("id"))
    e = materialize(e.distinct(), "accept")
    todo, accepted = every, materialize(every.select("id", "curator").limit(0), "accept")
    while todo.limit(1).count():
        used = accepted.groupBy(F.col("curator").alias("__c")).agg(F.count(F.lit(1)).alias("used"))
        same = F.col("curator").eqNullSafe(F.col("__c"))
        copies_ = e.join(accepted.select(F.col("id").alias("earlier")), "earlier", "left_semi").select("id").distinct()
        todo = todo.join(copies_, "id", "left_anti")
        if cap is not None:
            todo = todo.join(used.where(F.col("used") >= cap), same, "left_anti")
        todo = materialize(todo.select("id", "seq", "curator"), "accept")
        waits = e.join(todo.select(F.col("id").alias("earlier")), "earlier", "left_semi").select("id").distinct()
        heads = todo
        if cap is not None:
            heads = todo.withColumn("rank", F.row_number().over(Window.partitionBy("curator").orderBy("seq"))).where(F.col("rank") <= cap)
            heads = heads.join(used, same, "left").where(F.col("rank") <= cap - F.coalesce("used", F.lit(0)))
        new = materialize(heads.join(waits, "id", "left_anti").select("id", "curator"), "accept")
        accepted = materialize(accepted.unionByName(new), "accept")
        todo = materialize(todo.join(new.select("id"), "id", "left_anti"), "accept")
    return every.select("id").join(accepted.select("id", F.lit(True).alias("was")), "id", "left").select("id", F.coalesce("was", F.lit(False)).alias("accepted"))


def replay_in_order(rows: Iterator[tuple], links: set, cap: int | None) -> dict:
    """The same acceptance, one by one; the definition that :func:`accept_in_order` is tested against."""
    out: dict = {}
    used: dict = {}
    for i, _, curator in sorted(rows, key=lambda r: r[1]):
        copy = any(out[o] and ((o, i) in links or (i, o) in links) for o in out)
        ok = not copy and (cap is None or used.get(curator, 0) < cap)
        used[curator] = used.get(curator, 0) + ok
        out[i] = ok
    return out


def budgeted(rows: DataFrame, group: str, order: list, budget: str) -> DataFrame:
    """Rows of each group in order while the group's ``budget`` lasts.

    The greatest budget of all is a bound known before the rows move, so that map tasks send no more rows of a group.
    """
    most = int(rows.agg(F.max(budget)).first()[0] or 0)
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return rows.withColumn("__rank", rank).where(F.col("__rank") <= most).where(F.col("__rank") <= F.col(budget)).drop("__rank")

