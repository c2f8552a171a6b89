import random

from pyspark.sql import functions as F

from constellate.functions import scalars as S
from constellate.functions import text as X
from constellate.operators import identity as I
from constellate.operators import quality as Q
from constellate.operators import votes as V


def one(spark, expr, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(expr.alias("v")).first().v


def test_names(spark):
    c = F.col("s")
    forms = {"AC/DC": "acdc", "*NSYNC": "nsync", "KoЯn": "korn", "Ke$ha": "kesha", "MØ": "mo"}
    for k, v in forms.items():
        assert one(spark, X.letters_form(X.match_form(c)), s=k) == v
    assert one(spark, X.match_form(c), s="P.O.D.") == "p.o.d"
    assert one(spark, X.without_article(X.match_form(c)), s="The 1975") == "1975"
    assert one(spark, X.slug(X.search_form(c)), s="R&B") == "r-b"
    for k, v in {"X - Topic": "X", "2020": None, "various artists": None, "May 5, 2020": None, "  Ann ": "Ann", "": None, "ｘ": "x", "a" * 101: None}.items():
        assert one(spark, X.sanitise_name(c), s=k) == v
    assert one(spark, X.split_names(c), s="Tyler, The Creator") == ["Tyler, The Creator"]
    assert one(spark, X.split_names(c), s="A, B feat. C, a") == ["A", "B", "C"]
    assert one(spark, X.split_names(F.lit(None).cast("string"))) == []
    assert one(spark, X.song_key(c), s="Song [Live] ft. X") == "song"
    assert one(spark, X.display_name(c), s="r&b don't k-pop x-y") == "R&B Don'T K-Pop X-Y"


def test_formats(spark):
    c = F.col("n")
    for n, fans, pop in ((0, "0", 5), (1, "1", 5), (999, "999", 37), (1000, "1.0K", 38), (263700, "264K", 68), (9950000, "9.9M", 87), (50200000, "50M", 96)):
        assert (one(spark, S.compact_count(c), n=n), one(spark, S.log_popularity(c), n=n)) == (fans, pop)
    assert [one(spark, S.community_colour(c), n=n) for n in (1, 2, 3)] == ["#23D712", "#7355E6", "#CB843D"]
    for y, p, v in ((1965, 9, "1965"), (1965, 8, "1960s"), (850, 7, "9th century"), (-1999, 9, "1999 BCE"), (1050, 7, "11th century"), (2001, 7, "21st century")):
        assert one(spark, X.inception(F.col("y"), F.col("p")), y=y, p=p) == v
    for d, v in (("3:07", 187), ("1:00:01", 3601), ("x", 0), ("", 0), ("1:x", 0)):
        assert one(spark, X.seconds(F.col("d")), d=d) == v
    from constellate.operators.project import degree_bound

    assert [one(spark, degree_bound(c), n=float(n)) for n in (1, 2, 4, 9, 30, 36, 100)] == [4, 5, 8, 12, 21, 24, 24]


def test_acceptance_equals_replay(spark):
    rng = random.Random(3)
    for _ in range(4):
        rows = [(k, k, rng.choice("abc")) for k in range(25)]
        links = {tuple(sorted(rng.sample(range(25), 2))) for _ in range(18)}
        for cap in (2, None):
            got = Q.accept_in_order(spark.createDataFrame(rows, "id int, seq int, curator string"), spark.createDataFrame(sorted(links), "a int, b int"), cap)
            assert {r.id: r.accepted for r in got.collect()} == Q.replay_in_order(rows, links, cap)
    rows = [(1, 1, "x"), (2, 2, "x"), (3, 3, "y"), (4, 4, "x")]
    got = Q.accept_in_order(spark.createDataFrame(rows, "id int, seq int, curator string"), spark.createDataFrame([(1, 2)], "a int, b int"), 2)
    assert {r.id for r in got.where("accepted").collect()} == {1, 3, 4}


def test_copies_against_brute_force(spark):
    rng = random.Random(6)
    sets = {f"c{k}": set(rng.sample(range(14), rng.randint(1, 12))) for k in range(60)}
    sets["twin"] = set(sets["c0"])
    df = spark.createDataFrame([(c, str(x)) for c, xs in sets.items() for x in xs] + [(None, "1"), ("c0", None)], "c string, x string")
    membership, links = Q.copies(df, "c", "x", 0.9)
    cls = {r.c: r["class"] for r in membership.collect()}
    assert cls == {c: min(o for o in sets if sets[o] == xs) for c, xs in sets.items()}
    heads = sorted(set(cls.values()))
    want = {(a, b) for a in heads for b in heads if a < b and len(sets[a] & sets[b]) >= 0.9 * min(len(sets[a]), len(sets[b])) - 1e-9}
    assert {(r.a, r.b) for r in links.collect()} == want


def test_null_and_empty_channels(spark):
    cat = spark.createDataFrame([("e1", "N", [("n", None)]), ("e2", "M", [("n", "c1")]), ("e3", "K", [("n", "")]), ("e4", "Solo", []), ("e5", "Dup", []), ("e6", "dup ", [])], "id string, name string, credits array<struct<name string, channel string>>")
    keys = I.credit_keys(cat)
    credits = spark.createDataFrame([("n", "c1"), ("n", "c2"), ("n", None), ("solo", "z"), ("dup", None)], "name string, channel string")
    got = {(r.name, r.channel): r.entity for r in I.resolve_credits(credits, keys).collect()}
    assert got == {("n", "c1"): "e2", ("n", "c2"): "e1", ("n", ""): "e3", ("solo", "z"): "e4", ("dup", ""): None}


def test_votes_fixture(spark):
    x = [set("abcde"), set("abcdf"), set("abcgh")]
    y = [set("aefgh"), set("aefij")]
    rows = [(f"x{k}", "x", m) for k, s in enumerate(x) for m in s] + [(f"y{k}", "y", m) for k, s in enumerate(y) for m in s]
    df = spark.createDataFrame(rows, "container string, label string, member string")
    members, search = df.select("container", "member"), df.select("container", "label").distinct()
    e = V.evidence(df)
    own = {(r.container, r.label): r.votes for r in V.votes(members, e, search).collect()}
    whole = {(r.container, r.label): r.votes for r in V.votes(members, e).collect()}
    assert abs(own["x0", "x"] - 2.5) < 1e-9 and abs(own["x0", "y"] - 1.5) < 1e-9
    assert abs(whole["x0", "x"] - 3.5) < 1e-9 and abs(whole["x0", "y"] - 1.5) < 1e-9
    assert ("y0", "y") not in own and abs(whole["y1", "x"] - 0.5) < 1e-9 and abs(whole["y1", "y"] - 2.5) < 1e-9
    lift = {(r.member, r.label): (r.c, round(r.lift, 6)) for r in V.lift_table(df.withColumnRenamed("container", "unit")).collect()}
    assert lift["a", "x"] == (3, 1.0) and lift["a", "y"] == (2, 1.0) and lift["b", "x"] == (3, 1.666667) and lift["e", "x"] == (1, 0.555556) and lift["e", "y"] == (2, 1.666667)
    ranking = {(r.member, r.rank): r.label for r in V.lift_ranking(V.lift_table(df.withColumnRenamed("container", "unit"))).collect()}
    assert ranking["a", 1] == "x" and ranking["a", 2] == "y"
