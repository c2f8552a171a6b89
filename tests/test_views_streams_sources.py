import random

import pytest
from pyspark.sql import functions as F

from constellate.operators import layout as L
from constellate.operators import ranking as K
from constellate.operators import search as S
from constellate.sources import sinks, tables
from constellate.streaming import incremental as N


def test_early_stop_hides_an_unpopular_exact_match(spark):
    def found(prefixed):
        rows = [(f"n{k:02}", f"a{k:02} x", None, None, 1000 - k) for k in range(prefixed)] + [("exact", "a", None, None, 1)]
        index = S.member_index(spark.createDataFrame(rows, "id string, label string, tags array<string>, place string, reach int"))
        return [r.id for r in S.search_members(index, "A ").orderBy("position").collect()]

    assert "exact" not in found(30) and len(found(30)) == 10
    assert found(20)[0] == "exact"
    empty = S.member_index(spark.createDataFrame([], "id string, label string, tags array<string>, place string, reach int"))
    assert S.search_members(empty, "a").count() == 0 and S.search_members(empty, " ").count() == 0


def test_global_rank_and_pages(spark):
    rng = random.Random(1)
    rows = [(k, rng.randint(0, 9)) for k in range(400)]
    got = {r.id: r.rank for r in K.global_rank(spark.createDataFrame(rows, "id int, v int"), [F.desc("v"), F.asc("id")], partitions=5).collect()}
    assert got == {r[0]: i for i, r in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])))}
    within = {r.id: r.r for r in K.rank_within(spark.createDataFrame(rows, "id int, v int"), "v", [F.desc("id")], "r").collect()}
    assert within == {i: sum(1 for j, w in rows if w == v and j > i) for i, v in rows}
    assert K.page_numbers(26, 5) == [0, None, 3, 4, 5, 6, 7, None, 25] and K.page_numbers(1, 0) == [0]


def test_radius_pairs_and_clearance(spark):
    rng = random.Random(2)
    pts = [(f"p{k:03}", rng.uniform(-50, 50), rng.uniform(-50, 50), 2.0) for k in range(150)] + [("same", 1.0, 1.0, 2.0), ("same2", 1.0, 1.0, 2.0), ("none", None, 1.0, 2.0)]
    df = spark.createDataFrame(pts, "id string, x double, y double, radius double")
    want = {(a[0], b[0]) for a in pts for b in pts if a[0] < b[0] and None not in a + b and (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2 <= 49.0}
    assert {(r.a, r.b) for r in L.radius_pairs(df, 7.0).collect()} == want
    few = df.where("id in ('same', 'same2')")
    out = L.clear_overlaps(few, 40).collect()
    assert ((out[0].x - out[1].x) ** 2 + (out[0].y - out[1].y) ** 2) ** 0.5 > 5.0


def test_macro_layout_is_bounded_and_repeats():
    a = L.macro_layout([1, 2, 3], {(1, 2): 3.0}, rounds=50)
    assert a == L.macro_layout([1, 2, 3], {(1, 2): 3.0}, rounds=50)
    assert abs(max((x * x + y * y) ** 0.5 for x, y in a.values()) - 2240.0) < 1e-6


def test_html_rows_and_json(spark, tmp_path):
    row = '<tr><td class=r>%d</td> <td><a href="play">no</a><a class="x" href="everynoise1d-%d.html">%s</a></td></tr>'
    html = "<table>" + row % (1, 1, "R&amp;B ") + "<tr><td>no</td></tr>" + row % (2, 2, "Pop") + '<tr><td>3</td><td><a href="other">none</a></td></tr></table>'
    pages = spark.createDataFrame([(1, html), (2, None), (3, "")], "page int, html string")
    assert [(r.page, r.rank, r.name) for r in tables.html_rows(pages, "html", ["page"]).orderBy("rank").collect()] == [(1, 1, "r&b"), (1, 2, "pop")]
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    assert [r.json for r in sinks.documents(df).collect()] == ['{"a":1}', '{"a":2,"b":"x"}']
    sinks.json_lines(df, f"{tmp_path}/j", compressed=True)
    assert spark.read.schema(df.schema).json(f"{tmp_path}/j").count() == 2
    assert tables.json_cache(spark, f"{tmp_path}/missing.json", df.schema).count() == 0
    (tmp_path / "bad.json").write_text("{not json")
    assert tables.json_cache(spark, str(tmp_path / "bad.json"), df.schema).count() == 0
    with pytest.raises(Exception):
        tables.json_cache(spark, str(tmp_path / "bad.json"), df.schema, strict=True).collect()
    assert sinks.within_budget(df.select("a"), 2) == 2
    with pytest.raises(ValueError):
        sinks.within_budget(df.select("a"), 1)


def test_partitioned_details_are_pruned(spark, tmp_path):
    sinks.details(spark.createDataFrame([(1, 1), (2, 1), (3, 2)], "id int, continentId int"), f"{tmp_path}/d")
    one = tables.details(spark, f"{tmp_path}/d", 2)
    assert [r.id for r in one.collect()] == [3]
    assert "PartitionFilters: [isnotnull(continentId" in one._jdf.queryExecution().executedPlan().toString()


def test_fetch_missing_skips_known_keys(spark):
    keys = spark.createDataFrame([(k,) for k in (1, 2, 2, 3, None)], "k int")
    got = tables.fetch_missing(keys, "k", [spark.createDataFrame([(1,)], "k int")], lambda f: f.assign(v=f["k"] * 10), "k int, v int", batch=1)
    assert {(r.k, r.v) for r in got.collect()} == {(2, 20), (3, 30)}


def events(spark, tmp_path, parts):
    for n, rows in enumerate(parts):
        spark.createDataFrame(rows, "id int, curator string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return spark.readStream.schema("id int, curator string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")


def test_running_cap_and_seen_set(spark, tmp_path):
    parts = [[(1, "a"), (2, "a"), (3, "b")], [(4, "a"), (5, "b"), (1, "a")], [(6, "b"), (7, "c")]]
    q = N.running_cap(events(spark, tmp_path, parts), "curator", "id", 2).writeStream.format("memory").queryName("capped").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.table("capped").collect()
    assert {c: sum(r.curator == c for r in rows) for c in "abc"} == {"a": 2, "b": 2, "c": 1}
    q = N.unseen(events(spark, tmp_path / "2", parts), ["id"], spark.createDataFrame([(7,)], "id int")).writeStream.format("memory").queryName("seen").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.id for r in spark.table("seen").collect()) == [1, 2, 3, 4, 5, 6]


def test_accepted_batches_resume(spark, tmp_path):
    stream = events(spark, tmp_path, [[(1, "a"), (2, "a")], [(2, "a"), (3, "b")]])
    decide = lambda new, old: new.where("curator != 'b'")
    for _ in range(2):
        N.accept_batches(stream, f"{tmp_path}/out", f"{tmp_path}/cp", "id", decide)
        assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [1, 2]
