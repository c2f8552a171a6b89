import math
import random

import pytest

from constellate.operators import graph as G
from constellate.operators import project as P


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


D1 = [("P1", m, "u1") for m in "ABC"] + [("P2", m, "u1") for m in "AB"] + [("P3", m, "u2") for m in "BCD"] + [("P4", m, "u3") for m in "ABCD"] + [("P5", m, "u4") for m in "DE"]
WANT = {  # damped, raw, units, cosine, source %, target %
    "AB": (2.130930, 3, 2, 0.878383, 100.0, 75.0), "AC": (1.130930, 2, 2, 0.583667, 66.7, 66.7), "AD": (0.5, 1, 1, 0.234639, 33.3, 33.3),
    "BC": (1.761860, 3, 3, 0.798702, 75.0, 100.0), "BD": (1.130930, 2, 2, 0.466176, 50.0, 66.7), "CD": (1.130930, 2, 2, 0.583667, 66.7, 66.7), "DE": (1.0, 1, 1, 0.685039, 33.3, 100.0),
}


@pytest.mark.parametrize("block", [512, 2])
def test_projection_fixture(spark, block):
    df = frame(spark, D1 + [("P1", "A", "u1"), ("P1", None, "u1"), (None, "A", "u1")], "c string, m string, u string")
    p = {r.i + r.j: (round(r.damped, 6), r.raw) for r in P.project(df, "c", "m", block).collect()}
    assert p == {k: v[:2] for k, v in WANT.items()}
    units = {r.i + r.j: r.units for r in P.shared_units(df, "u", "m", block).collect()}
    assert units == {k: v[2] for k, v in WANT.items()}
    s = {r.i + r.j: (round(r.similarity, 6), r.source_percent, r.target_percent) for r in P.similar_members(df, "c", "m", block=block).collect()}
    assert s == {k: v[3:] for k, v in WANT.items()}
    edges, u = P.similar_members(df, "c", "m"), P.shared_units(df, "u", "m")
    assert {r.i + r.j for r in P.supported_edges(edges, u).collect()} == set(WANT) - {"DE"}
    assert P.project(df.limit(0), "c", "m").count() == 0


def random_edges(rng, n, m):
    return sorted({tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)})


def test_components_against_union_find(spark):
    rng = random.Random(1)
    for n, m in ((40, 25), (60, 90), (30, 0)):
        e = random_edges(rng, n, m) + ([(k, k + 1) for k in range(100, 160)] if m else [])
        root = {v: v for x in e for v in x} | {v: v for v in range(n)}

        def find(v):
            while root[v] != v:  # noqa: B023
                v = root[v]  # noqa: B023
            return v

        for a, b in e:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
        df = frame(spark, [(*x, 0.5) for x in e] + [(None, 1, 0.5), (5, 5, 0.1)], "i int, j int, w double")
        got = {r.node: r.component for r in G.components(df, frame(spark, [(v,) for v in range(n)], "v int")).collect()}
        assert got == {v: find(v) for v in root}


def test_fill_equals_sequential_greedy(spark):
    rng = random.Random(4)
    for _ in range(3):
        e = {x: round(rng.random(), 2) for x in random_edges(rng, 14, 60)}
        bound = {v: rng.randint(1, 4) for v in range(14)}
        safe = set(rng.sample(sorted(e), 8))
        degree = {v: 0 for v in bound}
        taken = set(safe)
        for a, b in safe:
            degree[a] += 1
            degree[b] += 1
        for (a, b), _s in sorted(((x, s) for x, s in e.items() if x not in safe), key=lambda r: (-r[1], r[0])):
            if degree[a] < bound[a] and degree[b] < bound[b]:
                taken.add((a, b))
                degree[a] += 1
                degree[b] += 1
        got = G.fill_within_bounds(
            frame(spark, [(*x, s) for x, s in e.items()], "i int, j int, similarity double"), frame(spark, sorted(safe), "i int, j int"),
            frame(spark, list(bound.items()), "member int, bound int"))
        assert {(r.i, r.j) for r in got.collect()} == taken


def test_path_takes_fewest_hops_then_greatest_product(spark):
    e = frame(spark, [("s", "a", 0.9), ("a", "t", 0.2), ("s", "b", 0.5), ("b", "t", 0.5), ("x", "y", 1.0), ("s", "c", 1.0), ("c", "d", 1.0), ("d", "t", 1.0)], "source string, target string, weight double")
    rows = G.strongest_shortest_path(e, "s", "t").collect()
    assert [r.node for r in rows] == ["s", "b", "t"] and math.isclose(rows[-1].score, math.log(0.25))
    assert [r.node for r in G.strongest_shortest_path(e, "s", "s").collect()] == ["s"]
    assert G.strongest_shortest_path(e, "s", "x").count() == 0


def test_closure_of_a_cyclic_hierarchy(spark):
    e = frame(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), (None, "a")], "child string, parent string")
    assert {(r.child, r.ancestor) for r in G.closure(e, "child", "parent").collect()} == {(x, y) for x in "abcd" for y in "abc"}


def test_communities_of_two_cliques(spark):
    e = [(a, b, 1.0) for g in (range(6), range(10, 16)) for a in g for b in g if a < b] + [(0, 10, 0.1)]
    df = frame(spark, e, "i int, j int, weight double")
    for small in (10_000, 5):
        m = G.communities(df, 1.0, frame(spark, [(99,)], "v int"), rounds=6, small=small)
        got = {r.node: r.community for r in m.collect()}
        assert got[99] == 99 and set(got) == {*range(6), *range(10, 16), 99}
        assert G.modularity(df, m).first()[0] > 0.4
        assert {got[v] for v in range(6)} == {0} and {got[v] for v in range(10, 16)} == {10}


def cliques(sizes, inner=1.0):
    at, out = 0, []
    for n in sizes:
        out += [(a, b, inner) for a in range(at, at + n) for b in range(a + 1, at + n)]
        at += n
    return out


def test_oversize_communities_split_again_and_again(spark):
    # Four cliques in two tightly joined pairs, one community to begin with; a sliver of one node beside the last.
    e = cliques([6, 6, 6, 6]) + [(a, b, 0.4) for a, b in ((0, 6), (1, 7), (2, 8), (12, 18), (13, 19), (14, 20))] + [(5, 12, 0.05), (23, 24, 0.3)]
    df = frame(spark, e, "i int, j int, weight double")
    one = frame(spark, [(v, 0) for v in range(25)] + [(50, 7), (51, 7)], "node int, community int")
    found = []
    for small in (10_000, 5):
        got = {r.node: r.community for r in G.split_oversize(df, one, most=8, least=4, small=small).collect()}
        assert set(got) == {*range(25), 50, 51} and got[50] == got[51] == 7
        assert {tuple(v for v in range(25) if got[v] == c) for c in set(got.values()) - {7}} == {tuple(range(a, a + 6)) for a in (0, 6, 12)} | {tuple(range(18, 25))}
        found.append(got)
    assert found[0] == found[1]
    whole = G.split_oversize(df.where("i < 6 and j < 6"), one.where("node < 6"), most=4, least=4).collect()
    assert {r.community for r in whole} == {0}  # nothing to divide: it stays whole


def test_merging_gathers_lone_nodes_and_refuses_large_tables(spark):
    e = frame(spark, cliques([30, 30]) + [(0, 30, 0.1)], "i int, j int, weight double")
    m = frame(spark, [(v, 0 if v < 30 else 30) for v in range(60)] + [(v, v) for v in range(100, 180)], "node int, community int")
    got = {r.node: r.community for r in G.merge_communities(e, m, target=5, least=25, most=100).collect()}
    size = {c: sum(1 for x in got.values() if x == c) for c in got.values()}
    assert set(got) == {*range(60), *range(100, 180)} and len(size) <= 5 and min(size.values()) >= 25
    with pytest.raises(ValueError, match="more than 1 communities"):
        G.merge_communities(e, m, target=5, least=25, most=100, largest_table=1)


def test_communities_are_numbered_by_size(spark):
    m = frame(spark, [(1, "b"), (2, "b"), (3, "a"), (4, "c"), (5, "c")], "node int, community string")
    assert {(r.community, r.number) for r in G.numbered(m).collect()} == {("b", 1), ("c", 2), ("a", 3)}
    e = frame(spark, [(1, 2), (3, 4)], "i int, j int")
    assert tuple(G.connectivity(e, frame(spark, [(1,), (4,), (9,)], "v int")).first()) == (3, False)


def test_agglomerate_reaches_its_bounds():
    rng = random.Random(2)
    sizes = {c: rng.randint(1, 40) for c in range(30)}
    links = {(a, b): rng.random() for a in range(30) for b in range(a + 1, 30) if rng.random() < 0.2}
    into = G.agglomerate(sizes, links, 6, 25, 350)
    kept = {k: sum(sizes[c] for c in sizes if into[c] == k) for k in set(into.values())}
    assert len(kept) <= 6 and min(kept.values()) >= 25 and sum(kept.values()) == sum(sizes.values())


def test_bridging_equals_one_satellite_after_the_other(spark):
    rng = random.Random(9)
    for _ in range(3):
        groups, at = [], 0
        for n in (8, 2, 3, 4, 3, 5, 3):
            groups.append(list(range(at, at + n)))
            at += n
        edges = [(g[k], g[k + 1], 0.9) for g in groups for k in range(len(g) - 1)]
        scored = sorted({(*sorted(rng.sample(range(at), 2)), round(rng.random() * 0.3, 2)) for _ in range(14)})
        home = {v: g[0] for g in groups for v in g}
        size = {g[0]: len(g) for g in groups}
        inside, want = {0}, set()
        for c in sorted((c for c in size if c and size[c] >= 3), key=lambda c: (size[c], c)):
            links = sorted(((-s, i, j) for i, j, s in scored if {home[i], home[j]} & {c} and (({home[i], home[j]} - {c}) & inside)))[:3]
            if links:
                inside.add(c)
                want |= {(c, i, j, max(0.12, -s)) for s, i, j in links}
        df = lambda rows: frame(spark, rows, "i int, j int, similarity double")
        got = G.bridge_satellites(df(edges), df(scored))
        assert {tuple(r) for r in got.collect()} == want
