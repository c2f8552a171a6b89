import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from constellate.operators import fill
from constellate.operators import graph as G
from constellate.operators import project as P


def bound(damped):
    return P.degree_bound(F.round(damped, 6))


@pytest.fixture(scope="module")
def lists(spark):
    """Members in random containers, some of them alike, so that many pairs tie; and all links by the greedy itself."""
    rng = random.Random(7)
    data = {(f"c{c:02}", f"m{m:03}") for c in range(40) for m in rng.sample(range(150), rng.choice([2, 10, 50, 70]))}
    data |= {(c, f"m{200 + k}") for k in range(25) for c, m in data if m == "m007"}
    df = spark.createDataFrame(sorted(data), "c string, m string")
    edges = [(r.i, r.j, r.s) for r in P.similar_members(df, "c", "m").select("i", "j", F.round("similarity", 6).alias("s")).collect()]
    order = sorted(edges, key=lambda e: (-e[2], e[0], e[1]))
    met, want = {}, set()
    for i, j, _ in order:
        if met.get(i, 0) < 4 or met.get(j, 0) < 4:
            want.add((i, j))
        met[i], met[j] = met.get(i, 0) + 1, met.get(j, 0) + 1
    room = {r.member: r.bound for r in P.marginals(df, "c", "m").select("member", bound(F.col("damped")).alias("bound")).collect()}
    kept = frozenset(want)
    for pair in kept:
        for v in pair:
            room[v] -= 1
    for i, j, _ in order:
        if (i, j) not in kept and room[i] > 0 and room[j] > 0:
            want.add((i, j))
            room[i] -= 1
            room[j] -= 1
    return df, edges, want


@pytest.mark.parametrize("block, entries, short", [(2048, 1_500_000, 24), (40, 0, 4), (64, 1500, 9)])
def test_bounded_links_are_those_of_the_greedy(spark, lists, monkeypatch, block, entries, short):
    df, edges, want = lists
    written, passes, real = [], [], fill.materialize

    def counted(x, name="part", *more):
        out = real(x, name, *more)
        if name == "strongest":
            passes.append(out.where("cut = -1").count())
        written.append(name)
        return out

    monkeypatch.setattr(fill, "materialize", counted)
    got = [(r.i, r.j) for r in fill.bounded_links(df, "c", "m", bound, block=block, entries=entries, short=short).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    if not entries:  # short lists: fewer pairs than edges are written, and open members are counted again
        assert passes[0] < len(edges) / 2 and len(passes) > 1


def test_bounded_links_write_no_edges(spark, lists, monkeypatch):
    """All edges were written, and shuffled from both ends, before the first was taken."""
    from constellate.plans import graph_queries as Q

    monkeypatch.setattr(Q, "sessions", lambda *_: lists[0].toDF("container", "member"))
    monkeypatch.setattr(Q, "_session_edges", lambda *_: pytest.fail("all edges were asked for"))
    assert {(r.i, r.j) for r in Q.degree_bounded_graph(spark, "").collect()} == lists[2]


def test_bounded_links_of_few_or_no_members(spark):
    none = spark.createDataFrame([], "c string, m string")
    assert fill.bounded_links(none, "c", "m", bound).count() == 0
    two = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", None), (None, "y"), ("a", "x")], none.schema)
    assert [tuple(r) for r in fill.bounded_links(two, "c", "m", bound).collect()] == [("x", "y")]


def test_support_is_asked_only_of_members_of_many_containers(spark):
    """A pair that shares one small container is a fluke where an end has many, whatever its similarity."""
    rows = [(f"a{k}", "x") for k in range(30)] + [("a0", "y"), ("a1", "z"), ("a2", "z")]
    df = spark.createDataFrame(rows, "c string, m string")
    assert {(r.i, r.j) for r in fill.bounded_links(df, "c", "m", bound).collect()} == {(r.i, r.j) for r in P.similar_members(df, "c", "m").collect()} == {("x", "z")}


def test_rounding_is_that_of_spark(spark):
    x = np.r_[np.array([0.1015625, 0.0859375, 0.1234565, 0.0000005, 1.0, 0.9999995]), np.random.default_rng(1).integers(0, 10**7, 500) / 1e7]
    df = spark.createDataFrame([(float(v),) for v in x], "x double").select(F.round("x", 6).alias("r"))
    assert fill._rounded(x, 6).tolist() == [round(r.r * 1e6) for r in df.collect()]


def test_dropped_pairs_are_reported(spark, lists):
    """The first pairs of a node up to its cut are all that it has there."""
    _, edges, _ = lists
    s, i, j = np.array([round(e[2] * 1e6) for e in edges]), np.array([int(e[0][1:]) for e in edges]), np.array([int(e[1][1:]) for e in edges])
    keep, full, last = fill._first(s, i, j, 5)
    for node, at in zip(full.tolist(), last.tolist()):
        own = sorted((-s[k], i[k], j[k], k) for k in np.flatnonzero((i == node) | (j == node)))
        assert own[4][3] == at and all(keep[k] for *_, k in own[:5])


def test_fill_agrees_with_the_fill_of_given_edges(spark, lists):
    df, edges, want = lists
    e = spark.createDataFrame([x for x in edges if x[0] < "m040" and x[1] < "m040"], "i string, j string, similarity double")
    small = df.where("m < 'm040'").join(df.groupBy("c").count(), "c").select("c", "m")
    part = P.similar_members(small, "c", "m").select("i", "j", F.round("similarity", 6).alias("similarity"))
    bounds = P.marginals(small, "c", "m").select("member", bound(F.col("damped")).alias("bound"))
    given = G.fill_within_bounds(part, P.top_links(part, 4, [F.desc("similarity"), F.asc("other")]), bounds)
    assert e.count() and {tuple(r) for r in given.collect()} == {tuple(r) for r in fill.bounded_links(small, "c", "m", bound, block=16, short=5, entries=0).select("i", "j").collect()}
