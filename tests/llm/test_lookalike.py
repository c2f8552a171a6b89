import pytest

from constellate.llm import lookalike as la

CASES = [
    ("Рорe", "Роре"), ("Рорed", "Poped"), ("гoтoфeдyкa", "готофедука"), ("Тіdеs", "Tides"), ("ﬁfe", "fife"), ("Ｄ．　Ｓａ", "D. Sa"),
    ("sil‍ver", "silver"), ("é", "é"), ("여름", "여름"), ("／", "/"), ("a\u00a0b", "a b"), ("﻿x", "x"), ("x‍", "x"),
]
PLAIN = ["", "abc", "Хор", "KoЯn", "夏の夜", "여름", "👨‍👩‍👧 x", "❤️", "🏳️‍🌈", "10²", "夏！", "é", "می‌خواهم", "ㅋㅋ", "नमस्ते"]


@pytest.mark.parametrize("odd,plain", CASES)
def test_table_form(odd, plain):
    assert la.plain_form(odd) == plain
    assert la.plain_form(plain) == plain


@pytest.mark.parametrize("text", PLAIN)
def test_plain_already(text):
    assert la.plain_form(text) == text


def test_trie_reaches_exactly_the_spellings_that_look_alike():
    words = ["Хор", "Xop", "pope", "silver", "sliver", "кот", "é", "夏！"]
    trie = la.LookAlikeTrie()
    for w in words:
        trie.add(w, 1)
    for w in [*words, "Хоp", "silvеr", "sil\u200dver", "ｐｏｐｅ", "e\u0301"]:
        assert {m for m, _, _ in trie.matches(w)} == {v for v in words if la.skeleton(v) == la.skeleton(w)}
    assert trie.matches("kоt") == [] and trie.matches("kоt", 3) == [("кот", 2, 1)]  # two letters are only roughly alike


def _given(word, around, *attested):
    return la.choose(word, around, [(w, 0, n) for w, n in attested])[0]


def test_words_of_two_readings():
    assert _given("Хор", "C", ("Хор", 3), ("Xop", 9)) == "Хор"
    assert _given("СОРЕ", "L", ("СОРЕ", 1), ("COPE", 2)) == "COPE"
    assert _given("СОРЕ", "", ("СОРЕ", 1)) == "СОРЕ"
    assert _given("Topic", "C", ("Topic", 900), ("Торіс", 5)) == "Topic"
    assert _given("Торіс", "C", ("Topic", 900), ("Торіс", 5)) == "Торіс"
    assert _given("Xop", "C", ("Xop", 1), ("Хор", 5)) == "Хор"


def test_attested_spellings_decide_and_the_table_only_without_any():
    assert la.choose("Рорe", "", []) == (la.plain_form("Рорe"), False) == ("Роре", False)
    assert la.choose("Рорe", "", [("Pope", 0, 2), ("Роре", 0, 1)]) == ("Pope", True)
    assert la.choose("Рорe", "C", [("Pope", 0, 2), ("Роре", 0, 1)]) == ("Роре", True)
    assert la.choose("kоt", "", [("kot", 0, 1), ("кот", 2, 9)]) == ("kot", True)  # the cheaper one


def test_vocabulary_finds_what_the_table_cannot(spark):
    values = spark.createDataFrame([("the COPE song", 3), ("COPE", 5), ("СОРЕ live", 1), ("Рорe", 1), ("Ｚａ", 1)], "value string, n bigint")
    got = {r.token: (r.canonical, r.attested) for r in la.canonical_tokens(values).where("token != canonical").collect()}
    assert la.plain_form("СОРЕ") == "СОРЕ"
    assert got == {"СОРЕ": ("COPE", True), "Рорe": ("Роре", False), "Ｚａ": ("Za", False)}
    assert {r.value: r.canonical for r in la.canonical_values(values).collect()}["СОРЕ live"] == "COPE live"


def test_found_texts(spark):
    track = "array<struct<artist_name string, title string>>"
    playlists = spark.createDataFrame(
        [
            ("p1", "бор и Хор", [("Pope", "ａ"), ("Рорe", "x"), (None, "x"), ("", "x"), ("бор и Хор", "x"), ("бор и Xop", "x"), ("a\u00a0b", "x")], 1),
            ("p1", "бор и Хор", [("Pope", "ａ"), ("Рорe", "x"), (None, "x"), ("", "x"), ("бор и Хор", "x"), ("бор и Xop", "x"), ("a\u00a0b", "x")], 2),
            ("p2", None, None, 1), ("p3", "full　moon ❤️", [], 1), (None, "ｘ", None, 1), ("p4", "long " * 5000 + "х", None, 1), ("p5", "x", None, 1),
        ],
        f"id string, title string, tracks {track}, label int",
    )
    nodes = spark.createDataFrame([("n1", "Ｎ", 1), ("n1", "Ｎ", 1), ("n2", "夜 é", 1), ("n3", None, 1)], "id string, label string, title int")
    got = {(r.field, r.id, r.pos) for r in la.odd_texts(playlists, nodes).collect()}
    assert got == {("artist_name", "p1", 1), ("artist_name", "p1", 5), ("artist_name", "p1", 6), ("title", "p3", -1), ("title", None, -1), ("title", "p4", -1), ("label", "n1", -1)}
    texts = la.canonical_texts(la._identity_texts(playlists, nodes), ["field", "id", "pos"])
    assert {r.value: r.canonical for r in texts.collect()}["full　moon ❤️"] == "full moon ❤️"
    assert la.odd_texts(playlists.limit(0), nodes.limit(0)).count() == 0
