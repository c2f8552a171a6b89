from collections import Counter, defaultdict

from pyspark.sql import functions as F

from constellate.operators import skew

TRACK = "array<struct<videoId string, artist_id string>>"


def playlists(spark, rows):
    return spark.createDataFrame(rows, f"id string, title string, tracks {TRACK}")


def test_counts_match_brute_force_with_repeats_nulls_and_empty_lists(spark):
    rows = [
        ("a", "t", [("v", "x"), ("v", "y"), ("v", "x"), ("v", ""), ("v", None)]),
        ("a", "t", [("v", "x"), ("v", "y"), ("v", "x"), ("v", ""), ("v", None), ("v", "z")]),
        ("b", None, [("v", "x")]),
        ("b", None, [("v", "x")]),
        ("c", "t", None),
        ("d", "t", []),
        (None, "t", [("v", "x")]),
    ]
    got = {r.artist_id: r.n_playlists for r in skew.playlists_per_artist(playlists(spark, rows)).collect()}
    want = defaultdict(set)
    for i, _, tr in rows:
        for _, a in tr or []:
            if a and i:
                want[a].add(i)
    assert got == {k: len(v) for k, v in want.items()}
    assert {r.artist_id for r in skew.frequent_artists(playlists(spark, rows), one_in=2).collect()} == {"x"}


def test_empty_table(spark):
    assert skew.frequent_artists(playlists(spark, [])).count() == 0


def test_eager_rollup_equals_plain_join(spark):
    left = spark.createDataFrame([(1, 2.0, "q"), (1, 3.0, "q"), (2, None, "q"), (None, 9.0, "q")], "k int, m double, g string")
    right = spark.createDataFrame([(1, "u", 10), (1, "u", 11), (1, None, 5), (2, "u", None), (3, "w", 1)], "k int, g string, r int")
    got = {r.g: (r.n_keys, r.n_rows, r.sum_m, r.sum_r) for r in skew.eager_join_rollup(left, right, ["k"], ["g"], ["m"], ["r"]).collect()}
    plain = (
        right.alias("r").join(left.alias("l"), "k").groupBy(F.col("r.g").alias("g"))
        .agg(F.countDistinct("k"), F.count("*"), F.sum("l.m"), F.sum("r.r")).collect()
    )
    assert got == {r[0]: tuple(r[1:]) for r in plain}


def test_hot_split_join_keeps_every_row(spark):
    facts = spark.createDataFrame([("h", i) for i in range(500)] + [(f"c{i}", i) for i in range(50)] + [(None, 1)], "k string, v int")
    entries = facts.where("k is not null").groupBy("k").agg(F.count("*").alias("n"))
    out = skew.hot_split_join(facts, entries, "k", "n", 550, hot_keys=10)
    assert Counter(r.k for r in out.collect()) == Counter({"h": 500, **{f"c{i}": 1 for i in range(50)}})


def test_salted_counts(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,)], "k string")
    assert {r.k: r.n for r in skew.salted_counts(df, ["k"]).collect()} == {"a": 2, None: 1}
