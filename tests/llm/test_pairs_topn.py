import itertools
import random
from collections import defaultdict

from pyspark.sql import functions as F

from constellate.llm import pairs, topn


def brute(rows, n, least, lift):
    has = defaultdict(set)
    for b, i in rows:
        if b is not None and i:
            has[i].add(b)
    out = {}
    for x, y in itertools.combinations(sorted(has), 2):
        k = len(has[x] & has[y])
        if k >= least and k * n >= lift * len(has[x]) * len(has[y]):
            out[x, y] = (k, len(has[x]), len(has[y]))
    return out


def test_pairs_with_huge_baskets_nulls_and_repeats(spark):
    rng = random.Random(3)
    rows = [(f"b{rng.randint(0, 40)}", f"i{rng.randint(0, 25)}") for _ in range(600)] + [("huge", f"i{k}") for k in range(90)] * 2
    rows += [(None, "i1"), ("b1", None), ("b1", "")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "basket string, item string, code int")
    for least, lift in ((1, 0.0), (2, 1.2), (3, 2.0)):
        got = pairs.pair_association(df, "basket", "item", 42, least, lift, block_pairs=50).collect()
        assert {(r.id_a, r.id_b): (r.n, r.n_a, r.n_b) for r in got} == brute(rows, 42, least, lift)
        assert len({(r.id_a, r.id_b) for r in got}) == len(got)
        assert all(abs(r.lift - r.n * 42 / (r.n_a * r.n_b)) < 1e-9 for r in got)
    assert pairs.pair_association(df.limit(0), "basket", "item", 0).count() == 0


def test_big_baskets_become_blocks(spark):
    coded = spark.createDataFrame([("big", k) for k in range(70)] + [("small", k) for k in range(20)], "basket string, code bigint")
    blocks = [(r.xs, r.ys) for r in pairs._blocks(coded, "basket", 45, 32).collect()]
    assert sum(ys is not None for _, ys in blocks) == 3  # three chunks, each two of them once
    made = [(a, b) for xs, ys in blocks for a, b in (itertools.combinations(xs, 2) if ys is None else itertools.product(xs, ys))]
    assert len(made) == 70 * 69 // 2 + 20 * 19 // 2


def test_shared_playlists_take_all_rows_of_an_id(spark):
    track = "array<struct<artist_id string>>"
    rows = [(f"p{k}", [("a",), ("b",)] if k % 2 else [("a",)]) for k in range(10)] + [(f"p{k}", [("b",), ("",), (None,)]) for k in range(0, 10, 2)]
    rows += [(f"q{k}", None) for k in range(60)] + [(None, [("a",), ("b",)])]
    df = spark.createDataFrame(rows, f"id string, tracks {track}")
    assert [(r.id_a, r.id_b, r.n) for r in pairs.shared_playlists(df).collect()] == [("a", "b", 10)]


def test_top_n_against_brute_force_with_ties_and_a_hot_group(spark):
    rng = random.Random(8)
    rows = [(f"g{rng.randint(0, 30)}" if rng.random() > 0.4 else "hot", f"x{k % 700}", rng.choice([None, *map(float, range(8))]), k) for k in range(2000)]
    rows += [(None, "x", 3.0, 5000 + k) for k in range(20)]
    df = spark.createDataFrame(rows, "g string, x string, score double, k int").withColumn("__have", F.lit("clash")).withColumn("score2", F.col("score"))
    for n, bands, hot in ((3, 4, 2000), (1, 1, 2), (50, 3, 2), (3, 4, 3)):
        got = defaultdict(list)
        for r in topn.top_n(df.drop("__have"), "g", "score", [F.col("x").desc(), F.col("k").asc()], n, bands, hot_keys=hot).collect():
            got[r.g].append(r.k)
        want = defaultdict(list)
        for g, x, s, k in sorted((r for r in rows if r[2] is not None), key=lambda r: r[3]):
            want[g].append((s, x, k))
        for g, v in want.items():
            v.sort(key=lambda r: r[2])
            v.sort(key=lambda r: (r[0], r[1]), reverse=True)
            assert sorted(got[g]) == sorted(k for _, _, k in v[:n])
        assert set(got) == set(want)
    assert topn.top_n(df.limit(0).drop("__have"), "g", "score", [F.col("x")], 3).count() == 0


def test_latest_export_counts(spark):
    rows = [("a", "n1", 5.0, 1, "2026-01-01"), ("a", "n1", None, 1, "2026-01-02"), ("a", "n2", 1.0, None, "2026-01-01"), ("a", "n2", 1.0, None, "2026-01-01"),
            ("a", "n3", 1.0, 0, "2026-01-01"), ("a", None, 9.0, 1, "2026-01-01"), ("a", "n4", 1.0, 0, None), ("b", "n1", 0.0, 1, None)]
    df = spark.createDataFrame(rows, "id string, neighborId string, overlapPercent double, sharedPlaylists int, at string").withColumn("exported_at", F.to_timestamp("at"))
    assert {(r.id, r.neighborId) for r in topn.top_neighbours(df, 2).collect()} == {("a", "n3"), ("a", "n4"), ("b", "n1")}
