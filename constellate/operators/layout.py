"""Placing nodes on a plane: centres of communities and tags, spring steps, normalisation, clearance."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from constellate.operators.ranking import global_rank
from constellate.session import materialize, release


def macro_layout(communities: list, affinities: dict, bound: float = 3200.0, seed: int = 42, rounds: int = 400) -> dict:
    """{community: (x, y)}: force-directed places of communities, the farthest at 0.7 of ``bound``.

    The published method of Fruchterman and Reingold (Graph drawing by force-directed placement, 1991): all push one
    another off by k * k / d, links pull by the squared affinity times d * d / k, and steps are limited by a falling heat.
    Runs on the table of communities (at most a few hundred), not of nodes.
    """
    order = sorted(communities)
    n = len(order)
    at = {c: i for i, c in enumerate(order)}
    pull = np.zeros((n, n))
    for (a, b), w in affinities.items():
        pull[at[a], at[b]] = pull[at[b], at[a]] = w * w
    pos = np.random.default_rng(seed).random((n, 2))
    k, heat = 3.2 / math.sqrt(max(1, n)), 0.1
    for r in range(rounds):
        delta = pos[:, None, :] - pos[None, :, :]
        dist = np.maximum(np.linalg.norm(delta, axis=-1), 0.01)
        shift = np.einsum("ijk,ij->ik", delta, k * k / dist**2 - pull * dist / k)
        length = np.maximum(np.linalg.norm(shift, axis=-1), 0.01)
        pos += shift * (heat * (1 - r / (rounds + 1)) / length)[:, None]
    pos -= pos.mean(axis=0)
    pos *= bound * 0.7 / max(1e-4, float(np.linalg.norm(pos, axis=1).max()) if n else 1.0)
    return {c: (float(pos[i, 0]), float(pos[i, 1])) for c, i in at.items()}


def micro_centres(nodes: DataFrame, centres: DataFrame) -> DataFrame:
    """(id, cx, cy): the place each node is drawn to: its community's centre or, where that has two or more first tags, its
    tag's place at an even angle and a distance of 65 plus 18 times the root of its members, 225 at most.

    ``nodes`` is (id, community, tag), ``centres`` (community, x, y).
    """
    groups = nodes.where("tag is not null and tag != ''").groupBy("community", "tag").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("community")
    g = groups.withColumn("k", F.row_number().over(w.orderBy(F.desc("n"), "tag")) - 1).withColumn("of", F.count(F.lit(1)).over(w)).where("of > 1")
    angle, r = 2 * math.pi * F.col("k") / F.col("of"), 65.0 + F.least(F.lit(160.0), 18.0 * F.sqrt("n"))
    g = g.select("community", "tag", (r * F.cos(angle)).alias("dx"), (r * F.sin(angle)).alias("dy"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return nodes.join(centres, "community").join(g, ["community", "tag"], "left").select("id", (F.col("x") + zero("dx")).alias("cx"), (F.col("y") + zero("dy")).alias("cy"))


def jitter(places: DataFrame, low: float = 10.0, high: float = 65.0) -> DataFrame:
    """(id, x, y): places moved by a random step that depends on the id alone, and so repeats."""
    u = lambda salt: (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(1 << 40)) / float(1 << 40))
    angle, r = 2 * math.pi * u(1), low + (high - low) * u(2)
    return places.select("id", (F.col("cx") + r * F.cos(angle)).alias("x"), (F.col("cy") + r * F.sin(angle)).alias("y"))


def spring_step(state: DataFrame, edges: DataFrame, share: float = 0.0) -> DataFrame:
    """One step of the spring model: (id, x, y, vx, vy, cx, cy, community) moved; ``share`` of all steps is done.

    Links pull by 0.04 of weight and distance (half between communities), the node's place by 0.035 of the distance;
    speed is damped and capped as the model cools.
    """
    p = lambda end: state.select(F.col("id").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in ("x", "y", "community")])
    e = edges.select("source", "target", "weight").join(p("source"), "source").join(p("target"), "target")
    w = 0.04 * F.col("weight") * F.when(F.col("source_community") == F.col("target_community"), 1.0).otherwise(0.5)
    dx, dy = F.col("target_x") - F.col("source_x"), F.col("target_y") - F.col("source_y")
    e = e.select("source", "target", (w * dx).alias("fx"), (w * dy).alias("fy"))
    force = e.select(F.col("source").alias("id"), "fx", "fy").unionByName(e.select(F.col("target").alias("id"), (-F.col("fx")).alias("fx"), (-F.col("fy")).alias("fy"))).groupBy("id").agg(
        F.sum("fx").alias("fx"), F.sum("fy").alias("fy"))
    heat = 1.0 - share * 0.75
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    s = state.join(force, "id", "left").select(
        "id", "x", "y", "cx", "cy", "community",
        ((F.col("vx") + 0.05 * (zero("fx") + 0.035 * (F.col("cx") - F.col("x")))) * 0.85 * heat).alias("vx"),
        ((F.col("vy") + 0.05 * (zero("fy") + 0.035 * (F.col("cy") - F.col("y")))) * 0.85 * heat).alias("vy"))
    length = F.sqrt(F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy")) + 1e-4
    s = s.withColumn("scale", F.least(length, F.lit(28.0 * heat)) / length)
    s = s.withColumn("vx", F.col("vx") * F.col("scale")).withColumn("vy", F.col("vy") * F.col("scale"))
    return s.select("id", (F.col("x") + F.col("vx")).alias("x"), (F.col("y") + F.col("vy")).alias("y"), "vx", "vy", "cx", "cy", "community")


#: Graphs of at most so many links and nodes take the spring steps in one task, in about 100 bytes each.
IN_ONE = 4_000_000


def _springs_in_one(state: DataFrame, e: DataFrame, steps: int) -> DataFrame:
    """The steps of :func:`spring_step`, on numbers of nodes and in one task, so that nothing is written between them."""
    ranked = materialize(global_rank(state, [F.asc("id")], "n"), "springs")
    at = lambda end: ranked.select(F.col("id").alias(end), F.col("n").alias(end[0]), F.col("community").alias(f"{end}_community"))
    share = F.when(F.col("source_community") == F.col("target_community"), 1.0).otherwise(0.5)
    links = e.where("weight is not null").join(at("source"), "source").join(at("target"), "target").select("s", "t", (0.04 * F.col("weight") * share).alias("w"))
    places = ("x", "y", "vx", "vy", "cx", "cy")

    def run(links: pd.DataFrame, nodes: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values("n")
        x, y, vx, vy, cx, cy = (nodes[c].to_numpy(float) for c in places)
        links = links.sort_values(["s", "t"])
        s, t, w = links["s"].to_numpy(np.int64), links["t"].to_numpy(np.int64), links["w"].to_numpy(float)

        def pulled(z: np.ndarray) -> np.ndarray:
            f = np.nan_to_num(w * (z[t] - z[s]))  # a link to a node without a place does not pull
            return np.bincount(s, f, len(z)) - np.bincount(t, f, len(z))

        for k in range(steps):
            heat = 1.0 - k / steps * 0.75
            fx, fy = pulled(x), pulled(y)
            vx = (vx + 0.05 * (fx + 0.035 * (cx - x))) * 0.85 * heat
            vy = (vy + 0.05 * (fy + 0.035 * (cy - y))) * 0.85 * heat
            length = np.sqrt(vx * vx + vy * vy) + 1e-4
            scale = np.minimum(length, 28.0 * heat) / length
            vx, vy = vx * scale, vy * scale
            x, y = x + vx, y + vy
        return pd.DataFrame({"n": nodes["n"].to_numpy(), "x": x, "y": y, "vx": vx, "vy": vy})

    one = F.lit(1).alias("one")
    moved = links.select(one, "s", "t", "w").groupBy("one").cogroup(ranked.select(one, "n", *places).groupBy("one")).applyInPandas(
        run, "n bigint, x double, y double, vx double, vy double")
    return materialize(moved.join(ranked.select("n", "id", "cx", "cy", "community"), "n").select("id", "x", "y", "vx", "vy", "cx", "cy", "community"), "springs")


def springs(state: DataFrame, edges: DataFrame, steps: int = 30, small: int = IN_ONE) -> DataFrame:
    """``steps`` steps.  Graphs of at most ``small`` links and nodes take them in one task.  In larger ones each is a join and an
    aggregation, which reads its state three times, so every state is written out, and the one before it deleted."""
    e = materialize(edges.select("source", "target", "weight"), "springs")
    if e.count() <= small:
        state = materialize(state, "springs")
        if state.count() <= small:
            return _springs_in_one(state, e, steps)
    for k in range(steps):
        moved = materialize(spring_step(state, e, k / steps), "springs")
        if k:
            release(state)
        state = moved
    return state


def normalise(places: DataFrame, bound: float = 3200.0) -> DataFrame:
    """(id, x, y): centred at the medians, the 99.5th percentile of distances at 0.92 of ``bound``, none beyond 0.97."""
    m = places.agg(F.struct(F.median("x").alias("x"), F.median("y").alias("y")).alias("m")).scalar()
    c = places.select("id", (F.col("x") - m["x"]).alias("x"), (F.col("y") - m["y"]).alias("y"))
    r = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y"))
    far = c.agg(F.percentile(r, 0.995)).scalar()
    scale = bound * 0.92 / F.when(far > 0, far).otherwise(1.0)
    capped = scale * F.least(F.lit(1.0), bound * 0.97 / F.greatest(F.lit(1e-12), r * scale))
    return c.select("id", (F.col("x") * capped).alias("x"), (F.col("y") * capped).alias("y"))


def centred(places: DataFrame) -> DataFrame:
    """(id, x, y): places moved so that their mean is the origin, to two decimals."""
    m = places.agg(F.struct(F.avg("x").alias("x"), F.avg("y").alias("y")).alias("m")).scalar()
    return places.select("id", F.round(F.col("x") - m["x"], 2).alias("x"), F.round(F.col("y") - m["y"], 2).alias("y"))


def radius_pairs(points: DataFrame, radius: float) -> DataFrame:
    """(a, b, d), a < b: points within ``radius`` of each other, by a grid of that cell width and an equi-join on cells.

    Every point lies in one cell and looks into the nine around it; the distance decides.  Points without a place are left out.
    """
    p = points.where("x is not null and y is not null").select("id", "x", "y", F.floor(F.col("x") / radius).alias("gx"), F.floor(F.col("y") / radius).alias("gy"))
    near = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])).alias("o")
    q = p.select(F.col("id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"), "gx", "gy", near).select("b", "bx", "by", (F.col("gx") + F.col("o.i")).alias("gx"), (F.col("gy") + F.col("o.j")).alias("gy"))
    d = F.sqrt(F.pow(F.col("x") - F.col("bx"), F.lit(2.0)) + F.pow(F.col("y") - F.col("by"), F.lit(2.0)))
    return p.join(q, ["gx", "gy"]).where("id < b").select(F.col("id").alias("a"), "b", d.alias("d")).where(F.col("d") <= radius)


def clear_overlaps(places: DataFrame, rounds: int = 25, gap: float = 2.0) -> DataFrame:
    """(id, x, y, radius): discs that overlap pushed apart by 0.28 of their overlap, all pairs of a round at once, until none does."""
    state = materialize(places.select("id", "x", "y", "radius"), "clearance")
    most = state.agg(F.max("radius")).first()[0]
    if most is None:
        return state
    reach = 2.0 * most + gap + 1.0
    for _ in range(rounds):
        at = lambda end: state.select(F.col("id").alias(end), F.col("x").alias(f"{end}x"), F.col("y").alias(f"{end}y"), F.col("radius").alias(f"{end}r"))  # noqa: B023, E731
        p = radius_pairs(state, reach).join(at("a"), "a").join(at("b"), "b").withColumn("need", F.col("ar") + F.col("br") + gap).where("d < need")
        push = 0.28 * (F.col("need") - F.col("d")) / F.greatest(F.col("d"), F.lit(1e-4))
        # Discs on one spot part along a direction that their ids give.
        turn = 2 * math.pi * F.pmod(F.xxhash64("a", "b"), F.lit(4096)) / 4096.0
        ux = F.when(F.col("d") < 1e-3, F.cos(turn) * 1e-4).otherwise(F.col("bx") - F.col("ax"))
        uy = F.when(F.col("d") < 1e-3, F.sin(turn) * 1e-4).otherwise(F.col("by") - F.col("ay"))
        moves = materialize(p.select("a", "b", (push * ux).alias("dx"), (push * uy).alias("dy")), "clearance")
        if not moves.limit(1).count():
            break
        total = moves.select(F.col("a").alias("id"), (-F.col("dx")).alias("dx"), (-F.col("dy")).alias("dy")).unionByName(
            moves.select(F.col("b").alias("id"), "dx", "dy")).groupBy("id").agg(F.sum("dx").alias("dx"), F.sum("dy").alias("dy"))
        zero = lambda c: F.coalesce(c, F.lit(0.0))
        state = materialize(state.join(total, "id", "left").select("id", (F.col("x") + zero("dx")).alias("x"), (F.col("y") + zero("dy")).alias("y"), "radius"), "clearance")
    return state
