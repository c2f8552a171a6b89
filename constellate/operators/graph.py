"""Graph operators on edge tables: components, bridges, paths, closures, degree-bounded fill, communities."""

from __future__ import annotations

import math
from collections import defaultdict
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from constellate.operators.project import both_sides
from constellate.operators.ranking import global_rank
from constellate.session import materialize, release


def components(edges: DataFrame, nodes: DataFrame | None = None, i: str = "i", j: str = "j") -> DataFrame:
    """(node, component): connected components, named by their least node.

    Alternates large-star and small-star steps, which contract every component to a star in a logarithmic number of
    rounds, whatever its diameter.  Each round is written to shared storage.  Nodes of ``nodes`` without an edge are
    components of their own; null ends are ignored.
    """
    e = edges.where(F.col(i).isNotNull() & F.col(j).isNotNull() & (F.col(i) != F.col(j))).select(
        F.greatest(i, j).alias("u"), F.least(i, j).alias("v")).distinct()
    e = materialize(e, "components")
    previous = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low2, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
            .unionByName(low2.select("u", F.col("m").alias("v"))).distinct()
        )
        e = materialize(small, "components")
        state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == previous:
            break
        previous = tuple(state)
    found = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = e.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    out = found.unionByName(roots)
    if nodes is not None:
        alone = nodes.select(F.col(nodes.columns[0]).alias("node")).where("node is not null").distinct().join(out, "node", "left_anti")
        out = out.unionByName(alone.withColumn("component", F.col("node")))
    return out


def component_sizes(membership: DataFrame) -> DataFrame:
    """(component, size, giant): sizes, and whether it is the largest (of equals the one named least)."""
    sizes = membership.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    first = sizes.agg(F.min_by("component", F.struct(-F.col("size"), "component")).alias("g")).scalar()
    return sizes.select("component", "size", (F.col("component") == first).alias("giant"))


def bridges(edges: DataFrame, scored: DataFrame, smallest: int = 3, k: int = 3) -> DataFrame:
    """(component, i, j, similarity): up to ``k`` strongest scored pairs joining each satellite to the giant component.

    ``edges`` is the kept graph, ``scored`` all scored pairs (i, j, similarity).  Satellites below ``smallest`` nodes get
    none.  Ties go to the least pair.
    """
    m = components(edges.select("i", "j"))
    s = component_sizes(m)
    tagged = m.join(s, "component")
    left = tagged.select(F.col("node").alias("i"), F.col("component").alias("ci"), F.col("size").alias("si"), F.col("giant").alias("gi"))
    right = tagged.select(F.col("node").alias("j"), F.col("component").alias("cj"), F.col("size").alias("sj"), F.col("giant").alias("gj"))
    across = (
        scored.select("i", "j", "similarity").join(left, "i").join(right, "j").where(F.col("gi") != F.col("gj"))
        .select(F.when(F.col("gi"), F.col("cj")).otherwise(F.col("ci")).alias("component"), F.when(F.col("gi"), F.col("sj")).otherwise(F.col("si")).alias("size"), "i", "j", "similarity")
        .where(F.col("size") >= smallest)
    )
    rank = F.row_number().over(Window.partitionBy("component").orderBy(F.desc("similarity"), "i", "j"))
    return across.withColumn("rank", rank).where(F.col("rank") <= k).select("component", "i", "j", "similarity")


def bridge_satellites(edges: DataFrame, scored: DataFrame, smallest: int = 3, k: int = 3, floor: float = 0.12) -> DataFrame:
    """(component, i, j, similarity): bridges of all satellites, where satellites joined before become targets, too.

    Satellites of ``smallest`` nodes or more are joined from the smallest on (equals by name), each by its ``k`` strongest
    scored pairs to the giant component or to satellites joined before it; similarities are raised to ``floor``.  Which
    satellites join is a search from the giant component over the table of components, a round for each link of the
    longest chain.  Satellites that nothing links stay apart.
    """
    m = components(edges.select("i", "j"))
    t = m.join(component_sizes(m), "component").where(F.col("giant") | (F.col("size") >= smallest))
    side = lambda end: t.select(F.col("node").alias(end), F.struct((~F.col("giant")).alias("satellite"), "size", "component").alias(f"o{end}"))
    pairs = scored.select("i", "j", "similarity").join(side("i"), "i").join(side("j"), "j").where(F.col("oi.component") != F.col("oj.component"))
    # The later of the two in the order (giant first, then by size and name) is the one that is joined.
    rows = materialize(pairs.select(
        F.greatest("oi", "oj")["component"].alias("component"), F.least("oi", "oj")["component"].alias("target"), "i", "j", "similarity"), "bridges")
    joined = materialize(t.where("giant").select(F.col("component").alias("target")).distinct(), "bridges")
    while True:
        new = materialize(rows.join(joined, "target").select(F.col("component").alias("target")).distinct().join(joined, "target", "left_anti"), "bridges")
        if not new.limit(1).count():
            break
        joined = joined.unionByName(new)
    rank = F.row_number().over(Window.partitionBy("component").orderBy(F.desc("similarity"), "i", "j"))
    return rows.join(joined, "target").withColumn("rank", rank).where(F.col("rank") <= k).select(
        "component", "i", "j", F.greatest(F.col("similarity"), F.lit(floor)).alias("similarity"))


def neighbourhood(edges: DataFrame, node, i: str = "source", j: str = "target") -> DataFrame:
    """The links of one node."""
    return edges.where((F.col(i) == node) | (F.col(j) == node))


def induced(edges: DataFrame, members: DataFrame, i: str = "source", j: str = "target") -> DataFrame:
    """Links with both ends among ``members`` (one column)."""
    m = members.select(F.col(members.columns[0]).alias("__m")).distinct()
    return edges.join(m, edges[i] == m["__m"], "left_semi").join(m, F.col(j) == F.col("__m"), "left_semi")


def community_links(edges: DataFrame, membership: DataFrame, i: str = "source", j: str = "target") -> DataFrame:
    """(community, source, target): every link under each distinct community of its ends."""
    a = membership.select(F.col("node").alias(i), F.col("community").alias("ca"))
    b = membership.select(F.col("node").alias(j), F.col("community").alias("cb"))
    return edges.select(i, j).join(a, i).join(b, j).select(F.explode(F.array_distinct(F.array("ca", "cb"))).alias("community"), i, j)


def strongest_shortest_path(edges: DataFrame, start, goal, weight: str = "weight", i: str = "source", j: str = "target") -> DataFrame:
    """(hop, node, score): the path of fewest hops from ``start`` to ``goal``; of several the greatest product of weights.

    Breadth-first by levels; a node's best product (as a sum of logarithms) is final once its level is complete.  Ties
    go to the least parent.  No rows where there is no path; one row where both ends are equal.
    """
    spark = edges.sparkSession
    kind = edges.schema[i].dataType.simpleString()
    schema = f"hop int, node {kind}, score double"
    if start == goal:
        return spark.createDataFrame([(0, start, 0.0)], schema)
    both = materialize(both_sides(edges.select(i, j, F.log(F.col(weight)).alias("w")).where(F.col("w").isNotNull()), i, j), "adjacency")
    seen = spark.createDataFrame([(start, None, 0, 0.0)], f"node {kind}, parent {kind}, hop int, score double")
    levels, hop, reached = [seen], 0, False
    while True:
        hop += 1
        step = (
            levels[-1].select(F.col("node").alias("p"), "score").join(both, F.col("p") == both["node"])
            .select(F.col("other").alias("node"), F.col("p").alias("parent"), (F.col("score") + F.col("w")).alias("score"))
            .join(seen.select("node"), "node", "left_anti")
            .groupBy("node").agg(F.min_by(F.struct("parent", "score"), F.struct(-F.col("score"), "parent")).alias("b"))
            .select("node", F.col("b.parent").alias("parent"), F.lit(hop).alias("hop"), F.col("b.score").alias("score"))
        )
        level = materialize(step, "level")
        seen = levels[-1].unionByName(level)  # neighbours of a level lie in it or in one beside it
        levels.append(level)
        found = level.agg(F.count(F.lit(1)).alias("n"), F.max(F.col("node") == F.lit(goal)).alias("goal")).first()
        reached = bool(found["goal"])
        if reached or not found["n"]:
            break
    if not reached:
        return spark.createDataFrame([], schema)
    rows, at = [], goal
    for h in range(hop, -1, -1):  # one row a level, the path itself; each read stops at the first match
        r = levels[h].where(F.col("node") == F.lit(at)).first()
        rows.append((h, r["node"], r["score"]))
        at = r["parent"]
    return spark.createDataFrame(rows[::-1], schema)


def closure(edges: DataFrame, child: str, parent: str) -> DataFrame:
    """(child, ancestor, depth): transitive closure of a hierarchy with the fewest steps; cycles do no harm."""
    base = edges.select(F.col(child).alias("child"), F.col(parent).alias("ancestor")).where("child is not null and ancestor is not null").distinct()
    known = materialize(base.withColumn("depth", F.lit(1)), "closure")
    fresh, depth = known, 1
    while fresh.limit(1).count():
        depth += 1
        step = fresh.select("child", F.col("ancestor").alias("via")).join(base.toDF("via", "ancestor"), "via").select("child", "ancestor").distinct()
        fresh = materialize(step.join(known, ["child", "ancestor"], "left_anti").withColumn("depth", F.lit(depth)), "closure")
        known = known.unionByName(fresh)
    return known


def fill_within_bounds(candidates: DataFrame, protected: DataFrame, bounds: DataFrame) -> DataFrame:
    """(i, j): protected pairs and the greedy fill, strongest first, of pairs whose ends are both under their bounds.

    Protected pairs count towards the degree and may exceed it.  In each round every pair that ranks within the room left
    at both ends is taken; fewer than that many pairs precede it at either end, so the sequential greedy takes it, too.
    ``candidates`` is (i, j, similarity), ``bounds`` (member, bound); order: similarity descending, i, j.
    """
    bounds = materialize(bounds.select("member", "bound"), "fill")  # read in every round
    taken = materialize(protected.select("i", "j").distinct(), "fill")
    most = int(bounds.agg(F.max("bound")).first()[0] or 0)
    few = F.broadcast if bounds.count() <= 500_000 else lambda df: df
    left, own = candidates.select("i", "j", "similarity"), None
    while True:
        degree = both_sides(taken).groupBy("node").agg(F.count(F.lit(1)).alias("d"))
        room = materialize(bounds.select(F.col("member").alias("node"), "bound").join(degree, "node", "left").select(
            "node", (F.col("bound") - F.coalesce("d", F.lit(0))).alias("room")).where("room > 0"), "fill")
        left = materialize(left.join(few(room.select(F.col("node").alias("i"))), "i").join(few(room.select(F.col("node").alias("j"))), "j").select("i", "j", "similarity"), "fill")
        if own is not None:
            release(own)
        own = left
        # A pair's rank at a node counts all pairs there, in which it may stand first or second.  Room and pairs taken make up
        # the bound, so the first pairs up to the greatest bound hold all that may rank within the room; this fixed number
        # also cuts what is sent before it is sent.
        both = both_sides(left).withColumn("a", F.least("node", "other")).withColumn("b", F.greatest("node", "other"))
        window = Window.partitionBy("node").orderBy(F.desc("similarity"), "a", "b")
        first = both.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= most).drop("rank")
        free = first.join(taken.toDF("a", "b"), ["a", "b"], "left_anti")
        rank = free.withColumn("rank", F.row_number().over(window))
        ok = rank.join(room, "node").where("rank <= room").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where("n = 2")
        accepted = materialize(ok.select(F.col("a").alias("i"), F.col("b").alias("j")), "fill")
        if not accepted.limit(1).count():
            return taken
        taken = materialize(taken.unionByName(accepted), "fill")


def modularity(edges: DataFrame, membership: DataFrame, gamma: float = 1.0, i: str = "i", j: str = "j", weight: str = "weight") -> DataFrame:
    """(modularity): of the given communities (node, community), weighted, with resolution ``gamma``."""
    a = membership.select(F.col("node").alias(i), F.col("community").alias("ca"))
    b = membership.select(F.col("node").alias(j), F.col("community").alias("cb"))
    e = edges.select(i, j, F.col(weight).alias("w")).join(a, i).join(b, j)
    inside = e.groupBy("ca").agg(F.sum(F.when(F.col("ca") == F.col("cb"), F.col("w")).otherwise(0.0)).alias("l")).withColumnRenamed("ca", "c")
    strength = e.select(F.col("ca").alias("c"), "w").unionByName(e.select(F.col("cb").alias("c"), "w")).groupBy("c").agg(F.sum("w").alias("s"))
    per = strength.join(inside, "c", "left").select("s", F.coalesce("l", F.lit(0.0)).alias("l"))
    return per.agg(F.sum("l").alias("l"), F.sum("s").alias("s"), F.sum(F.col("s") * F.col("s")).alias("ss")).select(
        (F.col("l") / (F.col("s") / 2) - gamma * F.col("ss") / (F.col("s") * F.col("s"))).alias("modularity"))


def affinity(edges: DataFrame, membership: DataFrame, i: str = "i", j: str = "j", weight: str = "weight") -> DataFrame:
    """(a, b, affinity), a < b: summed weight of the edges between two communities."""
    x = membership.select(F.col("node").alias(i), F.col("community").alias("ca"))
    y = membership.select(F.col("node").alias(j), F.col("community").alias("cb"))
    return (
        edges.select(i, j, F.col(weight).alias("w")).join(x, i).join(y, j).where(F.col("ca") != F.col("cb"))
        .groupBy(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).agg(F.sum("w").alias("affinity"))
    )


# ---- communities ---------------------------------------------------------------------------------------------------


def _quality(inside: int, squares: int, total: int, gamma: float) -> float:
    """Modularity from whole numbers, so that every way of summing gives the same."""
    return 2 * inside / total - gamma * squares / (total * total)


#: Graphs of at most so many edges are settled in one task.
IN_ONE = 3_500_000
#: A sweep or level counts as growth if modularity gains more than this.
_GROWTH = 1e-7


def _settle(links: pd.DataFrame, total: int, gamma: float, patience: int) -> dict:
    """{node: community}: the sweeps and levels of :func:`communities` on one graph held in memory.

    ``links`` is (a, b, w, ha, hb) with whole weights and the hashes of both ends; a = b is weight inside a node.
    """
    na, nb = links["a"].to_numpy(), links["b"].to_numpy()
    if not len(na):
        return {}
    names, at = np.unique(np.concatenate([na, nb]), return_inverse=True)  # numbers in the order of the names
    n, a, b, w = len(names), at[: len(na)], at[len(na):], links["w"].to_numpy(np.int64)
    turn = np.zeros(n, np.int64)
    turn[a], turn[b] = links["ha"].to_numpy(np.int64), links["hb"].to_numpy(np.int64)
    strength = np.zeros(n, np.int64)
    np.add.at(strength, a, w)
    np.add.at(strength, b, w)
    inner = int(w[a == b].sum())
    own = a != b
    a, b = a.astype(np.int32), b.astype(np.int32)
    src, dst, w = _summed(np.concatenate([a[own], b[own]]), np.concatenate([b[own], a[own]]), np.concatenate([w[own], w[own]]), n)
    active, into = np.arange(n), np.arange(n)

    def state(com: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mass = np.zeros(n, np.int64)
        np.add.at(mass, com[active], strength[active])
        return mass, np.bincount(com[active], minlength=n)

    def quality(com: np.ndarray) -> float:
        inside = inner + int(w[com[src] == com[dst]].sum()) // 2
        return _quality(inside, sum(m * m for m in state(com)[0].tolist()), total, gamma)

    while True:
        com = np.arange(n)
        most, best, stale, k = quality(com), None, 0, 0
        while stale < patience:
            moved = 0
            for half in (0, 1):
                mass, count = state(com)
                on = active[((turn[active] >> (k % 60)) & 1) == half]
                if not len(on):
                    continue
                mine = np.zeros(n, bool)
                mine[on] = True
                go = mine[src]
                v, c, pull = _summed(np.concatenate([src[go], on]), np.concatenate([com[dst[go]], com[on]]), np.concatenate([w[go], np.zeros(len(on), np.int64)]), n)
                same, s = c == com[v], strength[v]
                may = same | (count[com[v]] > 1) | (count[c] > 1) | (c > com[v])
                v, c, pull, same, s = v[may], c[may], pull[may], same[may], s[may]
                gain = pull - gamma * (mass[c] - np.where(same, s, 0)) * s / float(total)
                starts = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
                tops = np.repeat(np.maximum.reduceat(gain, starts), np.diff(np.r_[starts, len(v)]))
                # Of equal gains a node's own community, else the last by name.
                top = np.maximum.reduceat(np.where(gain == tops, np.where(same, n, c), -1), starts)
                v = v[starts]
                goal = np.where(top == n, com[v], top)
                moved += int((goal != com[v]).sum())
                com[v] = goal
            k += 1
            if not moved:
                break
            now = quality(com)
            if now > most + _GROWTH:
                most, best, stale = now, com.copy(), 0
            else:
                stale += 1
        if best is None:
            return dict(zip(names.tolist(), names[into].tolist()))
        into = best[into]
        x, y = best[src], best[dst]
        inner += int(w[x == y].sum()) // 2
        joined = np.zeros(n, np.int64)
        np.add.at(joined, best[active], strength[active])
        strength, active = joined, np.unique(best[active])
        src, dst, w = _summed(x[x != y], y[x != y], w[x != y], n)


def _summed(x: np.ndarray, y: np.ndarray, w: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights summed by (x, y), numbers below ``n``, in their order."""
    if not len(x):
        return x, y, w
    key = x.astype(np.int64) * n + y
    order = np.argsort(key)
    key, w = key[order], w[order]
    del order
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    key, w = key[starts], np.add.reduceat(w, starts)
    return (key // n).astype(np.int32), (key % n).astype(np.int32), w


def _level(g: DataFrame, total: int, gamma: float, patience: int) -> DataFrame | None:
    """(node, community) after the sweeps of one level over the graph (a, b, w), or None where modularity does not grow."""
    both = materialize(both_sides(g.where("a != b"), "a", "b"), "communities")
    inner = g.where("a = b").agg(F.sum("w")).first()[0] or 0
    ends = g.select(F.col("a").alias("node"), "w").unionByName(g.select(F.col("b").alias("node"), "w"))
    label = materialize(ends.groupBy("node").agg(F.sum("w").alias("s")).select(
        "node", "s", F.xxhash64("node").alias("h"), F.col("node").alias("community"), F.lit(False).alias("moved")), "communities")

    def quality() -> float:
        a, b = label.select("node", F.col("community").alias("ca")), label.select(F.col("node").alias("other"), F.col("community").alias("cb"))
        inside = both.join(a, "node").join(b, "other").where("ca = cb").agg(F.sum("w")).first()[0] or 0
        mass = label.groupBy("community").agg(F.sum("s").cast("decimal(19,0)").alias("m"))
        return _quality(inner + inside // 2, int(mass.agg(F.sum(F.col("m") * F.col("m"))).first()[0]), total, gamma)

    most, best, stale, k = quality(), None, 0, 0
    while stale < patience:
        moved = 0
        for half in (0, 1):
            com = label.groupBy("community").agg(F.sum("s").alias("mass"), F.count(F.lit(1)).alias("n"))
            turn = label.where(F.shiftright("h", k % 60).bitwiseAND(F.lit(1)) == half)
            to = (
                both.join(turn.select("node"), "node").join(label.select(F.col("node").alias("other"), "community"), "other").select("node", "community", "w")
                .unionByName(turn.select("node", "community", F.lit(0).cast("bigint").alias("w"))).groupBy("node", "community").agg(F.sum("w").alias("w"))
            )
            own = turn.join(com, "community").select("node", "s", F.col("community").alias("own"), F.col("n").alias("beside"))
            rest = F.col("mass") - F.when(F.col("own") == F.col("community"), F.col("s")).otherwise(0)
            places = to.join(com, "community").join(own, "node").where("community = own or beside > 1 or n > 1 or community > own").withColumn(
                "gain", F.col("w") - gamma * rest * F.col("s") / F.lit(float(total)))
            top = places.groupBy("node").agg(F.max_by("community", F.struct("gain", (F.col("own") == F.col("community")).alias("o"), "community")).alias("top"))
            goal = F.coalesce("top", "community")
            label = materialize(label.join(top, "node", "left").select("node", "s", "h", goal.alias("community"), (goal != F.col("community")).alias("moved")), "communities")
            moved += label.where("moved").count()
        k += 1
        if not moved:
            break
        now = quality()
        if now > most + _GROWTH:
            most, best, stale = now, label, 0
        else:
            stale += 1
    return best


def communities(edges: DataFrame, gamma: float = 1.0, nodes: DataFrame | None = None, rounds: int = 8, small: int = IN_ONE) -> DataFrame:
    """(node, community): communities by modularity, named by their least node.

    Louvain by sweeps: the nodes of one hashed half, then those of the other, join the neighbouring community of greatest
    modularity gain, all at once; of two lone nodes only the lesser joins the other, so that they do not swap.  A level
    ends when a sweep moves no node or ``rounds`` half sweeps bring no growth; its best communities become the nodes of
    the next level, until a level brings none.  Graphs of at most ``small`` edges take the same sweeps in one task: weights
    are whole multiples of 2^-30 of the greatest, so sums are exact and the result does not depend on ``small``.
    Isolated ``nodes`` are communities of their own.
    """
    gamma, patience = float(gamma), max(1, rounds // 2)
    e = edges.where("i is not null and j is not null and i != j").select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), F.col("weight").alias("w"))
    unit = 2.0 ** (30 - math.frexp(e.agg(F.max("w")).first()[0] or 1.0)[1])
    g = materialize(e.groupBy("a", "b").agg(F.sum(F.coalesce(F.round(F.col("w") * unit).cast("bigint"), F.lit(0))).alias("w")), "communities")
    total = 2 * (g.agg(F.sum("w")).first()[0] or 0) or 1
    label = g.select(F.col("a").alias("node")).unionByName(g.select(F.col("b").alias("node"))).distinct().withColumn("community", F.col("node"))
    while True:
        if g.count() <= small:
            def finish(pdf: pd.DataFrame) -> pd.DataFrame:
                out = _settle(pdf, total, gamma, patience)
                return pd.DataFrame({"c": list(out), "x": list(out.values())})

            # Numbers in the order of the names, which take less memory there.
            ends = g.select(F.col("a").alias("name")).unionByName(g.select(F.col("b").alias("name"))).distinct()
            number = materialize(global_rank(ends, [F.asc("name")], "n"), "communities")
            hashed = g.join(number.toDF("a", "na"), "a").join(number.toDF("b", "nb"), "b").select(
                F.col("na").alias("a"), F.col("nb").alias("b"), "w", F.xxhash64("a").alias("ha"), F.xxhash64("b").alias("hb"), F.lit(1).alias("one"))
            found = materialize(hashed.groupBy("one").applyInPandas(finish, "c bigint, x bigint"), "communities")
            step = found.join(number.toDF("community", "c"), "c").join(number.toDF("next", "x"), "x").select("community", "next")
        elif (found := _level(g, total, gamma, patience)) is not None:
            step = found.select(F.col("node").alias("community"), F.col("community").alias("next"))
        else:
            break
        label = materialize(label.join(step, "community").select("node", F.col("next").alias("community")), "communities")
        if g.count() <= small:
            break
        a, b = step.toDF("a", "x"), step.toDF("b", "y")
        g = materialize(g.join(a, "a").join(b, "b").groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.sum("w").alias("w")), "communities")
    least = label.groupBy("community").agg(F.min("node").alias("name"))
    out = label.join(least, "community").select("node", F.col("name").alias("community"))
    if nodes is not None:
        alone = nodes.select(F.col(nodes.columns[0]).alias("node")).where("node is not null").distinct().join(out, "node", "left_anti")
        out = out.unionByName(alone.withColumn("community", F.col("node")))
    return out


def _part_within(inner: DataFrame, small: int) -> DataFrame:
    """(node, part): communities by modularity within each of many graphs (community, i, j, weight), each on its own.

    A graph of at most ``small`` edges takes the sweeps of :func:`communities` in one task, a larger one as Spark jobs; there
    are fewer of these than edges by ``small``.  The result does not depend on it.
    """
    unit = 2.0 ** (30 - math.frexp(inner.agg(F.max("weight")).first()[0] or 1.0)[1])
    w = inner.groupBy("community", F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).agg(
        F.sum(F.coalesce(F.round(F.col("weight") * unit).cast("bigint"), F.lit(0))).alias("w"))
    w = materialize(w, "inner")
    count = w.groupBy("community").agg(F.count(F.lit(1)).alias("n"))
    kind = w.schema["a"].dataType.simpleString()

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        out = _settle(pdf, 2 * int(pdf["w"].sum()) or 1, 1.0, 4)
        return pd.DataFrame({"node": list(out), "part": list(out.values())})

    few = w.join(count.where(F.col("n") <= small), "community", "left_semi").select("community", "a", "b", "w", F.xxhash64("a").alias("ha"), F.xxhash64("b").alias("hb"))
    found = few.groupBy("community").applyInPandas(settle, f"node {kind}, part {kind}")
    for r in count.where(F.col("n") > small).select("community").collect():
        one = w.where(F.col("community") == r[0]).select(F.col("a").alias("i"), F.col("b").alias("j"), F.col("w").alias("weight"))
        found = found.unionByName(communities(one).select("node", F.col("community").alias("part")))
    return found


def split_oversize(edges: DataFrame, membership: DataFrame, most: int = 350, least: int = 25, small: int = 200_000) -> DataFrame:
    """(node, community): communities of more than ``most`` nodes split by modularity within each, again and again until no
    part is larger or none splits.

    Nodes of parts below ``least`` rejoin the part of their community that they are most strongly linked to, those
    linked to none the largest.  A community without two parts of ``least`` nodes or more stays whole.
    """
    current = materialize(membership.select("node", "community"), "split")
    whole = current.select("community").limit(0)
    while True:
        sizes = current.groupBy("community").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).join(whole, "community", "left_anti")
        big = materialize(current.join(sizes.select("community"), "community", "left_semi").select("node", "community"), "split")
        if not big.limit(1).count():
            return current
        x, y = big.toDF("i", "ca"), big.toDF("j", "cb")
        inner = materialize(edges.select("i", "j", "weight").join(x, "i").join(y, "j").where("ca = cb and i != j").select(F.col("ca").alias("community"), "i", "j", "weight"), "split")
        parts = big.join(_part_within(inner, small), "node", "left").select("node", "community", F.coalesce("part", "node").alias("part"))
        parts = materialize(parts, "split")
        size = parts.groupBy("community", "part").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
        divided = size.groupBy("community").agg(F.count(F.lit(1)).alias("k"), F.max(F.struct("n", "part")).alias("top")).where("k >= 2")
        divided = materialize(divided.select("community", F.col("top.part").alias("top")), "split")
        whole = materialize(whole.unionByName(sizes.select("community").join(divided, "community", "left_anti")), "split")
        parts = parts.join(divided.select("community"), "community", "left_semi")
        solid = materialize(parts.join(size.select("community", "part"), ["community", "part"], "left_semi").select("node", "part"), "split")
        loose = materialize(parts.select("node", "community").join(solid, "node", "left_anti"), "split")
        links = both_sides(inner.select("i", "j", "weight"))
        while loose.limit(1).count():  # slivers, from those beside a solid part outwards
            pull = links.join(loose.select("node"), "node").join(solid.toDF("other", "part"), "other").groupBy("node", "part").agg(F.sum("weight").alias("w"))
            joined = materialize(pull.groupBy("node").agg(F.max_by("part", F.struct("w", "part")).alias("part")), "split")
            if not joined.limit(1).count():
                joined = loose.join(divided, "community").select("node", F.col("top").alias("part"))
                solid, loose = solid.unionByName(joined), loose.limit(0)
            else:
                solid, loose = materialize(solid.unionByName(joined), "split"), materialize(loose.join(joined, "node", "left_anti"), "split")
        named = solid.groupBy("part").agg(F.min("node").alias("name"))
        moved = materialize(solid.join(named, "part").select("node", F.col("name").alias("community")), "split")
        current = materialize(current.join(moved.select("node"), "node", "left_anti").unionByName(moved), "split")


def agglomerate(sizes: dict, links: dict, target: int, least: int, most: int) -> dict:
    """{community: kept community}: the smallest community joins the one of greatest link per root of its size, until at
    most ``target`` are left and none is smaller than ``least``; joins that exceed ``most`` are discounted, and one
    without links joins the smallest other.  Runs on the table of communities, not of nodes."""
    size, to = dict(sizes), {c: dict() for c in sizes}
    for (a, b), w in links.items():
        to[a][b] = to[b][a] = w
    into: dict = {}
    queue = [(n, c) for c, n in size.items()]
    heapify(queue)

    def smallest():
        while size.get(queue[0][1]) != queue[0][0]:
            heappop(queue)  # joined or grown since
        return queue[0][1]

    while len(size) > 1 and (len(size) > target or size[smallest()] < least):
        c = smallest()
        heappop(queue)

        def pull(o):
            joined = size[c] + size[o]  # noqa: B023
            return to[c][o] / size[o] ** 0.5 * ((most / joined) ** 2 if joined > most else 1.0)  # noqa: B023

        goal = max(sorted(to[c]), key=pull) if to[c] else smallest()
        size[goal] += size.pop(c)
        heappush(queue, (size[goal], goal))
        for o, w in to.pop(c).items():
            to[o].pop(c)
            if o != goal:
                to[goal][o] = to[o][goal] = to[goal].get(o, 0.0) + w
        into[c] = goal

    def last(c):
        while c in into:
            c = into[c]
        return c

    return {c: last(c) for c in sizes}


def merge_communities(edges: DataFrame, membership: DataFrame, target: int = 256, least: int = 25, most: int = 350, largest_table: int = 50_000) -> DataFrame:
    """(node, community) after :func:`agglomerate`.

    Only the table of communities and their affinities comes to the driver, and no more than ``largest_table`` rows of
    either: beyond that it is an error.  Small communities without any link, of which there may be as many as nodes, are
    gathered before that, in groups of ``least`` nodes or so many that there are no more than ``target`` of them.
    """
    spark = edges.sparkSession
    across = materialize(affinity(edges, membership), "affinity")
    linked = across.select(F.col("a").alias("community")).union(across.select("b")).distinct()
    size = materialize(membership.groupBy("community").agg(F.count(F.lit(1)).alias("n")), "sizes")
    alone = size.where(F.col("n") < least).join(linked, "community", "left_anti")
    groups = int(max(1, min(target, (alone.agg(F.sum("n")).first()[0] or 0) // least)))
    named = alone.withColumn("g", F.pmod(F.xxhash64("community"), F.lit(groups)))
    folded = materialize(named.join(named.groupBy("g").agg(F.min("community").alias("kept")), "g").select("community", "kept"), "folded")
    table = size.join(folded, "community", "left").groupBy(F.coalesce("kept", "community").alias("community")).agg(F.sum("n").alias("n"))

    def bounded(df: DataFrame) -> list:
        rows = df.limit(largest_table + 1).collect()
        if len(rows) > largest_table:
            raise ValueError(f"more than {largest_table} communities or links between them: detect communities at a lower resolution first")
        return rows

    into = agglomerate({r[0]: r[1] for r in bounded(table)}, {(r["a"], r["b"]): r["affinity"] for r in bounded(across)}, target, least, most)
    kind = membership.schema["community"].dataType.simpleString()
    kept = spark.createDataFrame(list(into.items()), f"first {kind}, last {kind}")
    step = membership.join(folded, "community", "left").select("node", F.coalesce("kept", "community").alias("first"))
    return step.join(kept, "first").select("node", F.col("last").alias("community"))


def numbered(membership: DataFrame) -> DataFrame:
    """(node, community, number): communities numbered from 1 by size, the largest first; equals by name."""
    sizes = membership.groupBy("community").agg(F.count(F.lit(1)).alias("n"))
    ranks = global_rank(sizes, [F.desc("n"), F.asc("community")], "number").select("community", (F.col("number") + 1).alias("number"))
    return membership.join(ranks, "community").select("node", "community", "number")


def connectivity(edges: DataFrame, nodes: DataFrame, i: str = "i", j: str = "j") -> DataFrame:
    """(components, connected) of a graph: whether bridging has left one component."""
    n = components(edges, nodes, i, j).agg(F.countDistinct("component").alias("components"))
    return n.select("components", (F.col("components") <= 1).alias("connected"))
