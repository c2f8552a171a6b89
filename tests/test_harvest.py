from pyspark.sql import functions as F

from constellate.functions import scalars as S
from constellate.functions import text as X
from constellate.operators import harvest as H
from constellate.operators import releases as E
from constellate.operators import selection as C
from constellate.sources import tables


def test_labels_by_rank_and_kind(spark):
    g = spark.createDataFrame([(1, " ASMR "), (2, "dub"), (2, "dub"), (None, "folk"), (3, None), (4, "jazz")], "rank int, genre string")
    assert sorted(r.genre for r in H.musical(g).collect()) == ["dub", "dub", "folk", "jazz"]
    assert [r.genre for r in H.top_labels(H.musical(g), limit=3).collect()] == ["dub", "dub", "jazz"]
    assert H.top_labels(g.limit(0)).count() == 0


def test_candidates_stop_after_the_query_that_gives_enough(spark):
    rows = [("a", 0, p, f"x{p}") for p in range(3)] + [("a", 1, 0, "x1"), ("a", 1, 1, "y")] + [("a", 2, 0, "z")] + [("b", 0, 0, "x0"), (None, 0, 0, "x0"), ("b", 0, 1, None)]
    f = spark.createDataFrame(rows, "label string, query int, pos int, id string")
    got = {(r.label, r.id, r.query, r.place) for r in H.candidate_lists(f, "label", 4).collect()}
    assert got == {("a", "x0", 0, 1), ("a", "x1", 0, 2), ("a", "x2", 0, 3), ("a", "y", 1, 4), ("b", "x0", 0, 1)}


def test_credits_under_an_uploaders_channel(spark):
    t = spark.createDataFrame(
        [("p", 0, "Ann - Song", "Label", "UC1"), ("p", 1, "X - Song", "Label", "UC1"), ("p", 2, "No sides", "LABEL ", "UC1"), ("p", 3, "Ann - Song", "Bob", "UC2"), ("q", 0, "Ann - Song", "Label", "UC1"),
         ("p", 4, None, None, None), ("p", 5, "t", "", "UC9"), ("p", 6, "t", "unknown", "UC8")],
        "id string, pos int, title string, artist_name string, channel_id string").withColumn("channel", F.lit("clash"))
    u = spark.createDataFrame([("p", "label"), ("p", "label")], "id string, channel string")
    got = {(r.id, r.pos): (r.credit, r.credit_channel) for r in H.track_credits(t, u).collect()}
    assert got == {("p", 0): ("Ann", None), ("p", 1): ("Label", "UC1"), ("p", 2): ("LABEL", "UC1"), ("p", 3): ("Bob", "UC2"), ("q", 0): ("Label", "UC1"),
                   ("p", 4): (None, None), ("p", 5): (None, None), ("p", 6): (None, "UC8")}


def test_tracks_by_length(spark):
    t = spark.createDataFrame([("a", None), ("b", 0), ("c", 29), ("d", 600), ("e", 601), ("Full Album", 100), (None, 50)], "title string, secs int")
    assert {(r.title, r.catalogue) for r in H.kept_tracks(t, "title", "secs").collect()} == {("a", True), ("b", True), ("c", False), ("d", True), (None, True)}


def test_facts_of_items(spark):
    s = spark.createDataFrame([("q", "b", 1990, 9), ("q", "a", 1980, 8), ("q", "a", 1980, 9), ("q", None, None, 9), ("r", "x", None, None), (None, "y", 1, 9)], "item string, alias string, year int, precision int")
    assert {(r.item, tuple(r.aliases), r.year, r.precision) for r in H.item_facts(s).collect()} == {("q", ("a", "b"), 1980, 9), ("r", ("x",), None, None)}
    i = spark.createDataFrame([(1, "Music Genre", "http://x"), (2, "", "https://x"), (3, "dub", None), (4, None, "")], "k int, desc string, wiki string")
    assert {(r.k, r.desc, r.wiki) for r in H.label_facts(i).collect()} == {(1, None, None), (2, None, "https://x"), (3, "dub", None), (4, None, None)}


def test_counts_add_up_and_labels_are_revisited_once(spark):
    n = lambda rows: spark.createDataFrame(rows, "key string, n bigint")
    assert {tuple(r) for r in H.added_counts(n([("a", 1), ("b", 2)]), n([("a", 3)]), n([])).collect()} == {("a", 4), ("b", 2)}
    labels, done = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "label string"), spark.createDataFrame([("c",)], "label string")
    assert {r.label for r in H.under_target(n([("a", 4), ("b", 2)]), labels, done, 3).collect()} == {"b", "d"}


def test_rows_pack_and_unpack(spark):
    rows = [('a "q" , [x]', None, 5, "é\\"), (None, 1.5, None, ""), ("null", 0.0, -1, "日")]
    df = spark.createDataFrame(rows, "a string, b double, c bigint, d string")
    packed = df.select(H.positional([F.col(c) for c in df.columns]).alias("p"))
    back = packed.select(*H.unpacked(F.col("p"), [("a", "string"), ("b", "double"), ("c", "bigint"), ("d", "string")]))
    assert sorted(map(tuple, back.collect()), key=repr) == sorted(rows, key=repr)


def test_competitors_by_word_and_by_ending(spark):
    t = spark.createDataFrame([(1, "star"), (2, "the end"), (3, "zz")], "target int, form string")
    c = spark.createDataFrame([(10, "rock star", 5), (11, "rockstar", 9), (12, "star", 99), (13, "starlight", 3), (14, "this is the end", 1), (15, "a star x", 0), (16, None, 4)], "candidate int, form string, fans int")
    assert {tuple(r) for r in E.competitors(t, c).collect()} == {(1, 10), (1, 11), (2, 14)}
    assert E.competitors(t.limit(0), c).count() == 0


def test_links_scales_and_selection(spark):
    one = spark.range(1)
    view = one.select(X.view_of(F.lit("/#artist=a%20b+c&x=&artist=d%26")).alias("v"), X.view_of(F.lit("/")).alias("none")).first()
    assert view.v == {"x": "", "artist": "d&"} and view.none == {}
    z = spark.createDataFrame([(None,), (0.0,), (2.2,), (0.1,), (100.0,), (float("nan"),)], "z double").select(S.zoom_scale(F.col("z"))).collect()
    assert [round(r[0], 3) for r in z] == [1.0, 1.0, 1.0, 0.15, 3.5, 1.0]
    key = spark.createDataFrame([("Éa 10",), ("ea 9",), ("EA 09b",)], "t string").select("t", X.collation_key(F.col("t")).alias("k")).orderBy("k").collect()
    assert [r.t for r in key] == ["ea 9", "EA 09b", "Éa 10"]
    on = lambda *names: C.active_selection(*[F.lit(n in names) for n in ("artist", "path", "spot", "slice", "community", "strength")])
    row = one.select(on("artist", "spot"), on("artist", "path", "spot"), on("slice", "community"), on("strength"), on(), C.active_selection(*[F.lit(None).cast("boolean")] * 6)).first()
    assert tuple(row) == ("artist", "spotlight", "slice", "strength", "none", "none")


def test_pages_too_short_give_way_to_the_snapshot(spark):
    row = '<tr><td>1</td><td><a href="/play">no</a> <a href="everynoise1d-dub.html">Dub &#38; caf&eacute;</a></td></tr><tr><td>2</td></tr>'
    page = lambda name, html: spark.createDataFrame([(name, html), (name, None)], "page string, html string")
    live, short, kept = page("live", row + " " * 500_000), page("short", row), page("kept", row)
    assert {(r.page, r.rank, r.name) for r in tables.html_rows(tables.first_available(live, kept), "html", ["page"]).collect()} == {("live", 1, "dub & café")}
    assert {r.page for r in tables.html_rows(tables.first_available(short, kept), "html", ["page"]).collect()} == {"kept"}
    assert tables.html_rows(page("x", '<tr><td>1</td><a href="/other">x</a></tr>'), "html", ["page"]).count() == 0
