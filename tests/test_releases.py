from constellate.operators import releases as E


def test_credit_by_title(spark):
    official = spark.createDataFrame([("ann", "sun"), ("bob", "rain"), ("cy", "moon")], "name string, song string")
    rows = [
        ("p", 0, "Ann", "Ann - Sun (Live)"), ("p", 1, "Sun", "Sun - Ann"), ("p", 2, "Ann", "Ann - Unknown song"), ("p", 3, "Ann", "Ann - Bob"),
        ("p", 4, "Zed & Bob", "Zed & Bob - Rain"), ("p", 5, "Nobody", "Nobody - Nothing"), ("p", 6, "X", "no sides"), ("p", 7, "X", None),
    ]
    t = spark.createDataFrame(rows, "id string, pos int, artist_name string, title string")
    assert {r.pos: r.credit for r in E.credit_by_title(t, official).collect()} == {0: "Ann", 1: "Ann", 2: "Ann", 3: "", 4: "Bob", 5: ""}


def test_song_votes_need_a_clear_winner(spark):
    released = spark.createDataFrame([("a", "s1"), ("a", "s2"), ("b", "s2"), ("b", "s3"), ("c", "s4")], "artist string, song string")
    titles = spark.createDataFrame([("n1", "s1"), ("n1", "s2"), ("n2", "s2"), ("n3", "s4"), ("n4", "s1"), ("n4", "zz")], "name string, song string")
    assert {(r.name, r.artist, r.votes) for r in E.song_votes(titles, released).collect()} == {("n1", "a", 2), ("n3", "c", 1)}


def test_shared_words_and_competitors(spark):
    targets = spark.createDataFrame([("t1", "ann lee", ["sun"]), ("t2", "bob", ["sun"]), ("t3", "bob", ["sun", "rain"]), ("t4", "cy", [])], "target string, name string, words array<string>")
    known = spark.createDataFrame([("k1", "ann lee", ["sun", "x"], 1), ("k2", "bob", ["sun", "rain"], 5), ("k3", "bob", ["sun"], 9), ("k4", "cy", ["y"], 1), ("k5", "cy", [], 2)], "candidate string, name string, words array<string>, fans int")
    got = {r.target: (r.candidate, r.shared) for r in E.by_shared_words(targets, known).collect()}
    assert got == {"t1": ("k1", 1), "t3": ("k2", 2), "t4": ("k5", 0)}
    c = spark.createDataFrame([("k1", "ann lee", 5), ("k2", "lee", 9), ("k3", "big lee lee", 7), ("k4", "lee jones", 0)], "candidate string, form string, fans int")
    t = spark.createDataFrame([("t", "lee")], "target string, form string")
    assert {r.candidate for r in E.competitors(t, c).collect()} == {"k1", "k3"}
