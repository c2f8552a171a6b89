import random
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql.classic.dataframe import DataFrame

from constellate.operators import project as P


def pairs_moved(df) -> bool:
    """Whether anything is shuffled once the pairs of the blocks are out."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan
    return "Exchange" in plan.split("MapInArrow")[0]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    data = {(f"c{c}", f"m{m:03}", f"u{c % 5}") for c in range(60) for m in rng.sample(range(90), rng.choice([1, 3, 40, 60]))}
    return data, spark.createDataFrame(sorted(data), "c string, m string, u string")


def counts(rows, by):
    held = {}
    for r in rows:
        held.setdefault(r[by], set()).add(r[1])
    return Counter(p for ms in held.values() for p in combinations(sorted(ms), 2))


def test_projection_counts_pairs_in_blocks(spark, rows):
    got = P.project(rows[1], "c", "m", block=32)
    assert not pairs_moved(got)
    assert {(r.i, r.j): r.raw for r in got.collect()} == counts(rows[0], 0)


def test_shared_units_are_counted_in_blocks(spark, rows):
    got = P.shared_units(rows[1], "u", "m", block=32)
    assert not pairs_moved(got)
    assert {(r.i, r.j): r.units for r in got.collect()} == counts(rows[0], 2)


def test_similar_members_are_tested_within_blocks(spark, rows):
    got = P.similar_members(rows[1], "c", "m", cutoff=0.3, block=32)
    assert not pairs_moved(got)
    raw, own = counts(rows[0], 0), Counter(m for _, m in {r[:2] for r in rows[0]})
    found = got.collect()
    assert 0 < len(found) < len(raw)
    assert all(r.raw == raw[r.i, r.j] and r.similarity >= 0.3 and r.source_percent == round(100.0 * r.raw / own[r.i] + 1e-9, 1) for r in found)


def test_supported_members_equal_edges_joined_to_units(spark, rows):
    rare = spark.createDataFrame([("x1", "y1", "u9"), ("x1", "y2", "u9")], rows[1].schema)
    df = rows[1].unionByName(rare)
    got = P.supported_members(df, "c", "m", "u", 4, cutoff=0.25, block=32)
    assert not pairs_moved(got)
    want = P.supported_edges(P.similar_members(df, "c", "m", cutoff=0.25), P.shared_units(df, "u", "m"), 4)
    pairs = sorted((r.i, r.j, r.raw) for r in got.collect())
    assert pairs == sorted((r.i, r.j, r.raw) for r in want.collect()) and pairs and ("y1", "y2", 1) not in pairs


@pytest.fixture
def sent(monkeypatch):
    """Numbers of rows that blocks are sent."""
    counts, before = [], DataFrame.mapInArrow
    monkeypatch.setattr(DataFrame, "mapInArrow", lambda df, *rest: counts.append(df.count()) or before(df, *rest))
    return counts


@pytest.fixture(scope="module")
def large(spark):
    """10 containers with all of 400 members."""
    return spark.range(4000).selectExpr("id % 10 as c", "id div 10 as m")


def test_similar_members_are_sent_once_a_group(sent, large):
    P.similar_members(large, "c", "m", block=8)
    assert 0 < sent[0] <= 9 * 50 * (10 + 1)  # 9 groups of the 50 chunks


def test_shared_units_are_sent_once_a_group(sent, large):
    P.shared_units(large, "c", "m", block=8)
    assert 0 < sent[0] <= 9 * 50 * (10 + 1)


@pytest.mark.parametrize("density", [0.01, 0.5])
def test_counts_of_few_and_of_many_members(density):
    rng = np.random.default_rng(5)
    a, b = rng.random((40, 60)) < density, rng.random((40, 50)) < density
    a[:5], b[:5] = True, True
    weights = rng.random(40)
    held = [P._Held(np.arange(40), weights, pa.array([np.flatnonzero(r).astype(np.int16) for r in x], pa.list_(pa.int16()))) for x in (a, b)]
    raw, damped = P._tables(*held, 60, 50, True)
    assert (raw.reshape(60, 50) == a.T.astype(int) @ b.astype(int)).all()
    assert np.allclose(damped.reshape(60, 50), (a * weights[:, None]).T @ b)


def test_blocks_of_groups_of_several_chunks_count_all_pairs(spark):
    rng = random.Random(6)
    data = {(f"c{c}", m, f"u{c % 7}") for c in range(40) for m in rng.sample(range(300), rng.choice([2, 20, 250]))}
    df = spark.createDataFrame(sorted(data), "c string, m int, u string")
    assert {(r.i, r.j): r.raw for r in P.project(df, "c", "m", block=5).collect()} == counts(data, 0)
    assert {(r.i, r.j): r.units for r in P.shared_units(df, "u", "m", block=5).collect()} == counts(data, 2)
    pairs = [sorted((r.i, r.j, r.raw, round(r.similarity, 9)) for r in P.supported_members(df, "c", "m", "u", 6, cutoff=0.6, block=b).collect()) for b in (5, 2048)]
    assert pairs[0] == pairs[1] and 0 < len(pairs[0]) < 44_850
