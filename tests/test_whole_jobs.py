"""Registered queries do the whole job: no subset of the input, no count of rounds, no bound that changes results."""

import random
from collections import defaultdict
from pathlib import Path

import pytest

from constellate.operators import graph as G
from constellate.operators import layout as L
from constellate.plans import label_queries, view_queries
from constellate.session import materialize

DATA = Path("/root/testdata/sf0.001")
needs_data = pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")


def local_louvain(adjacency: dict, gamma: float = 1.0, passes: int = 20) -> dict:
    """Communities of one graph held in memory ({node: {other: weight}}, symmetric), nodes visited in sorted order."""
    members = {v: {v} for v in sorted(adjacency)}
    graph = {v: dict(adjacency[v]) for v in members}
    total = sum(sum(n.values()) for n in graph.values()) or 1.0
    while True:
        strength = {v: sum(n.values()) for v, n in graph.items()}
        com = {v: v for v in graph}
        weight = dict(strength)
        moved_any = False
        for _ in range(passes):
            moved = False
            for v in sorted(graph):
                to: dict = defaultdict(float)
                for o, w in graph[v].items():
                    if o != v:
                        to[com[o]] += w
                here = com[v]
                weight[here] -= strength[v]
                gain = lambda c: to.get(c, 0.0) - gamma * weight[c] * strength[v] / total  # noqa: B023, E731
                best, most = here, gain(here)
                for c in sorted(to):
                    if (g := gain(c)) > most + 1e-12:
                        best, most = c, g
                weight[best] += strength[v]
                if best != here:
                    com[v] = best
                    moved = moved_any = True
            if not moved:
                break
        if not moved_any:
            break
        joined: dict = defaultdict(set)
        folded: dict = defaultdict(lambda: defaultdict(float))
        for v, n in graph.items():
            joined[com[v]] |= members[v]
            for o, w in n.items():
                folded[com[v]][com[o]] += w
        members, graph = dict(joined), {v: dict(n) for v, n in folded.items()}
    return {x: min(group) for group in members.values() for x in group}


def rows_of_sql(sql):
    import duckdb

    db = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        db.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return {tuple(r) for r in db.execute(sql).fetchall()}


@needs_data
def test_stated_labels_of_nodes_of_every_continent(spark):
    sql = label_queries.ORACLES["tag_tiers"]
    stated = 'unnest("topSubgenres") AS label FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY label DESC NULLS LAST, x DESC NULLS LAST, y DESC NULLS LAST) AS rn FROM atlas_nodes) WHERE rn = 1)'
    assert stated + ")" in sql  # no condition on the nodes
    want = rows_of_sql(sql)
    assert want != rows_of_sql(sql.replace(stated, stated + ' WHERE "continentId" <= 6'))  # nodes of other continents state labels, too
    assert {tuple(r) for r in label_queries.tag_tiers(spark, str(DATA)).select("member", "tags", "source").collect()} == want


def test_communities_do_not_depend_on_the_size_at_which_the_engine_changes(spark):
    rng = random.Random(3)
    group = {v: v // 12 for v in range(48)}
    e = {(a, b): round(rng.random(), 3) for a in group for b in group if a < b and rng.random() < (0.5 if group[a] == group[b] else 0.04)}
    df = spark.createDataFrame([(*x, w) for x, w in e.items()], "i int, j int, weight double")
    one, spread = ({r.node: r.community for r in G.communities(df, 1.0, small=small).collect()} for small in (10_000, 5))
    assert one == spread
    q = G.modularity(df, spark.createDataFrame(list(spread.items()), "node int, community int")).first()[0]
    adj = {v: {b if a == v else a: w for (a, b), w in e.items() if v in (a, b)} for v in group}
    sequential = G.modularity(df, spark.createDataFrame(list(local_louvain(adj).items()), "node int, community int")).first()[0]
    assert q > sequential - 0.02
    cliques = [(a, b, 1.0) for g in (range(6), range(10, 16)) for a in g for b in g if a < b] + [(0, 10, 0.1)]
    got = {r.node: r.community for r in G.communities(spark.createDataFrame(cliques, "i int, j int, weight double"), small=5).collect()}
    assert got == {v: 0 if v < 6 else 10 for v in got} and len(got) == 12


@needs_data
def test_layout_queries_run_the_steps_and_rounds_of_the_reference(spark, monkeypatch):
    asked = {}
    monkeypatch.setattr(L, "springs", lambda state, edges, steps=30: asked.update(steps=steps) or state)
    monkeypatch.setattr(L, "clear_overlaps", lambda places, rounds=25, gap=2.0: asked.update(rounds=rounds) or places)
    view_queries.springs(spark, str(DATA))
    view_queries.clear_overlaps(spark, str(DATA))
    assert asked == {"steps": 300, "rounds": 25}


def test_springs_read_no_state_that_was_deleted(spark):
    state = spark.createDataFrame([(k, 100.0 * k, 0.0, 0.0, 0.0, 0.0, 0.0, 1) for k in (1, 2)], "id int, x double, y double, vx double, vy double, cx double, cy double, community int")
    edges = spark.createDataFrame([(1, 2, 0.5)], "source int, target int, weight double")
    few = L.springs(state, edges, 6)
    assert [r.id for r in few.orderBy("id").collect()] == [1, 2]


def test_springs_of_a_small_graph_write_nothing_between_steps(spark, monkeypatch):
    rng = random.Random(8)
    state = spark.createDataFrame(
        [(f"n{k}", rng.random() * 99, rng.random() * 99, 0.0, 0.0, rng.random() * 9, rng.random() * 9, rng.choice([1, 2, None])) for k in range(30)] + [("lone", 5.0, 5.0, 0.0, 0.0, 0.0, None, 1)],
        "id string, x double, y double, vx double, vy double, cx double, cy double, community int")
    edges = spark.createDataFrame([(f"n{a}", f"n{b}", rng.choice([rng.random(), None])) for a in range(30) for b in range(a) if rng.random() < 0.2] + [("lone", "n1", 0.5), ("n1", "gone", 0.5)], "source string, target string, weight double")
    written = []
    monkeypatch.setattr(L, "materialize", lambda df, *a: written.append(1) or materialize(df, *a))
    one = {r.id: (r.x, r.y) for r in L.springs(state, edges, 12).collect()}
    assert len(written) < 12
    spread = {r.id: (r.x, r.y) for r in L.springs(state, edges, 12, small=0).collect()}
    assert one.keys() == spread.keys() and one["lone"][1] is None
    assert all(a == b or abs(a - b) < 1e-6 for k in one for a, b in zip(one[k], spread[k]))


def test_five_songs_are_counted_after_titles_are_folded(spark, monkeypatch):
    rows = [("name_x", "X", None, f"Sun (Live {k})") for k in range(6) for _ in range(2)] + [("name_x", "X", None, "Rain")]
    rows += [("yt_a", "Ann", "UC1", "Sun"), ("yt_a", "Ann", "UC1", "Rain"), ("yt_b", "Bob", "UC2", "Sun")]
    tracks = spark.createDataFrame(rows, "artist_id string, artist_name string, channel_id string, title string")
    monkeypatch.setattr(label_queries, "_tracks", lambda spark, d: tracks)
    assert [tuple(r) for r in label_queries.song_votes(spark, "").select("name", "artist", "votes").collect()] == [("name_x", "ann", 2)]


def test_a_path_of_more_than_64_links_is_found(spark):
    chain = spark.createDataFrame([(k, k + 1, 1.0) for k in range(66)], "source int, target int, weight double")
    assert [r.node for r in G.strongest_shortest_path(chain, 0, 66).collect()] == list(range(67))


def test_communities_of_many_edges_are_settled_in_one_task(spark, monkeypatch):
    assert G.IN_ONE >= 3_000_000 and G.communities.__defaults__[-1] == G.IN_ONE
    rng = random.Random(2)
    rows = {(f"n{a:06}", f"n{b:06}"): rng.random() for a, b in ((rng.randrange(30_000), rng.randrange(30_000)) for _ in range(210_000)) if a < b}
    rows |= {(f"n{a:06}", f"n{b:06}"): 5.0 for a in range(30_000) for b in range(a + 1, min(a - a % 10 + 10, 30_000))}
    df = spark.createDataFrame([(*x, w) for x, w in rows.items()], "i string, j string, weight double")
    assert len(rows) > 200_000  # was cut into Spark jobs from here on
    monkeypatch.setattr(G, "_level", None)
    got = {r.node: r.community for r in G.communities(df).collect()}
    assert len(got) == 30_000 and all(got[f"n{v:06}"] == got[f"n{v - v % 10:06}"] for v in range(0, 30_000, 7))
