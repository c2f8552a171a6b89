import random
import re

import pytest
from pyspark.sql import functions as F

from constellate.llm import names as N

SAME = [  # typed, label
    ("t. totékumodo", "theodore totékumodo"), ("kathy nesusanady", "katherine nesusanidi"), ("marble loleturefu, the", "the marble loleturefu"),
    ("jazz trio of gubutudiru", "gubutudiru jazz trio"), ("ropulufagu c.c.", "ropulufagu chamber choir"), ("th3 nibinapabe", "the nibinapabe"),
    ("dulep atipo 77", "dulepatipo 77"), ("depo.gulifo", "depogulifo"), ("c. & the lubelutipe stations", "christopher & the lubelutipe stations"),
    ("sofodofago kettles", "robert & the sofodofago kettles"), ("the pefifosidi - topic", "the pefifosidi"), ("dee jay femomukiko", "dj femomukiko"),
    ("pube todibu", "pube todibu collective"), ("samuel t. tenibalotu", "samuel tenibalotu"), ("femiphogudi", "femifogudi"), ("gaemullego jz 3o", "gasemulego jazz trio"),
    ("captain mipirudose vevo", "captain mipirudose"), ("ladybitimoguri", "lady bitimoguri"), ("cafe", "café"),
]
DIFFERENT = [
    ("christopher feborideva", "josephine feborideva"), ("lady radikobogo", "radikobogo chamber choir"), ("fosakinuma 77", "fosakinuma 303"),
    ("lukakunani", "lukakunani sound company"), ("mc rokomadomo", "rokomadomo sound company"), ("the golden mulegavada", "the silver mulegavada"),
]


def telling(label):
    return frozenset(w for w in N.Name(label).words if re.fullmatch("([bcdfgklmnprstv][aeiou])+", w))


@pytest.mark.parametrize("typed,label", SAME)
def test_variants(typed, label):
    assert N.name_cost(N.Name(typed), N.Name(label), telling(label)) is not None


@pytest.mark.parametrize("typed,label", DIFFERENT)
def test_other_artists(typed, label):
    assert N.name_cost(N.Name(typed), N.Name(label), telling(label)) is None


def test_names_of_any_number_of_words_may_be_reordered():
    words = "bamo culiga dofe fago gilu homeda jupo kenila lofimu mitade nogu pesalo".split()
    for n in (8, 9, 12):
        label = " ".join(words[:n])
        for typed in (" ".join(reversed(words[:n])), " ".join([*words[1:n], words[0]])):
            assert N.name_cost(N.Name(typed), N.Name(label), frozenset(words[:1])) == 0.0
        assert N.name_cost(N.Name(" ".join(words[1 : n + 1 - (n == 12)])), N.Name(label), frozenset(words[:1])) is None
    assert N.name_cost(N.Name("la " * 60 + "bamu"), N.Name("bamo " + "la " * 60), frozenset(["bamo"])) == 1.0  # equal words are one choice


def _matches(spark, rows):
    return {(r.form, r.known) for r in N.match_spellings(spark.createDataFrame(rows, "form string, known boolean")).collect()}


def test_a_word_in_very_many_names_makes_few_pairs(spark):
    rng = random.Random(2)
    syllable = lambda k: "".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(k))
    label = [f"{syllable(4)} smith" for _ in range(300)]
    forms = {**{x: True for x in label}, **{f"smith {x.split()[0]}": False for x in label}}
    got = _matches(spark, list(forms.items()))
    assert {(f"smith {x.split()[0]}", x) for x in label} <= got and len(got) < 2 * len(label)


def test_names_of_common_words_need_their_two_rarest(spark):
    known = [f"{a} {b}" for a in ("banoka", "delifu", "gomeri", "kupola") for b in ("walifo", "tenuga", "sorimo", "lapeku", "nifedo")]
    typed = ["walifo banoka", "tenuga delifo", "b. walifo", "banoka"]
    got = _matches(spark, [(k, True) for k in known] + [(t, False) for t in typed])
    assert {g for g in got if g[0] in typed} == {("walifo banoka", "banoka walifo"), ("tenuga delifo", "delifu tenuga")}


def test_merged_names_within_one_edit_and_two_beside_a_telling_word(spark):
    rows = [("banoka delifuro", True), ("bamokadelifuro", False), ("banoka delifurom", False), ("ban oka delifurom", False)]
    assert _matches(spark, rows) == {("bamokadelifuro", "banoka delifuro"), ("banoka delifurom", "banoka delifuro"), ("ban oka delifurom", "banoka delifuro")}


def test_spelling_is_blind_to_case_blanks_and_character_forms_only():
    assert N.spelling("  Ｔｈｅ　Pоpe ") == "the pope" == N.spelling("THE  POPE") == N.spelling("Тhe Роре")
    assert N.spelling("café") == N.spelling("café") != N.spelling("cafe")
    assert N.spelling("Хор") == "хор" and N.spelling("​ ") == ""


def slow_distance(a, b):
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_distance_and_trie_join_against_brute_force(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 10)))
    known, asked = {word() for _ in range(700)}, {word() for _ in range(150)}
    pairs = {(q, w): slow_distance(q, w) for q in asked for w in known}
    assert all(N.distance(q, w, 2) == min(3, d) for (q, w), d in pairs.items())
    index = spark.createDataFrame([("k", w, N.edits_allowed(w)) for w in known], "kind string, word string, most int")
    probes = spark.createDataFrame([("k", q) for q in asked], "kind string, probe string")
    for shard_words in (50, 100_000):
        got = N.trie_join(index, probes, shard_words).collect()
        assert {(r.probe, r.word) for r in got} == {p for p, d in pairs.items() if d <= N.edits_allowed(p[1])}
        assert len(got) == len({(r.probe, r.word) for r in got})


def test_found(spark):
    track = "array<struct<artist_id string, artist_name string>>"
    t = lambda *names: [(f"name_{n}" if not n.startswith("=") else "yt_" + n[1:], n.lstrip("=")) for n in names]
    rows = [
        ("p1", t("=Theodore Totekumodo", "=Samuel Fetunalopi", "T. Totekumodo", "theodore totekumodo", "Ted Totekumdo"), 1),
        ("p1", t("T. Totekumodo"), 1), ("p2", None, 1), ("p3", [], 1), (None, [("", None), (None, ""), ("name_x", None), ("name_y", " ")], 1),
        ("p4", t("Ｔheodore Totekumodo", "Nobody Kalimapudo", "=Bedola Nifapo", "x" * 3000), 1),
    ]
    playlists = spark.createDataFrame(rows, f"id string, tracks {track}, label int")
    nodes = spark.createDataFrame(
        [("dz_1", "Theodore Totekumodo", 1), ("dz_1", "Theodore Totekumodo", 1), ("dz_2", "Totekumodo, Theodore", 1), ("dz_3", "Samuel Fetunalopi", 1), ("dz_4", None, 1), ("dz_5", "", 1)],
        "id string, label string, tracks int")
    got = {(r.id_a, r.id_b) for r in N.same_artists(playlists, nodes).collect()}
    spelt = {"name_T. Totekumodo", "name_Ted Totekumdo"}
    same = {"name_theodore totekumodo", "name_Ｔheodore Totekumodo"}
    assert got == {("dz_1", "dz_2")} | {("dz_1", x) for x in spelt} | {("dz_2", x) for x in spelt | same}
    assert N.same_artists(playlists.limit(0), nodes.limit(0)).count() == 0


def test_tries_find_what_distance_finds():
    rng = random.Random(8)
    word = lambda letters, most: "".join(rng.choice(letters) for _ in range(rng.randint(1, most)))
    for letters in ("ab", "abc", "abcdefghij"):
        words, probes = ({word(letters, 13) for _ in range(400)} for _ in range(2))
        for most in (0, 1, 2):
            near = {(q, w) for q in probes for w in words if N.distance(q, w, most) <= most}
            back = {(q[::-1], w[::-1]) for q, w in N.near_pairs([w[::-1] for w in words], [q[::-1] for q in probes], most)}
            got = set(N.near_pairs(words, probes, most))
            assert got <= near and back <= near and (most > 1 or got | back == near)
            assert all((q, w) in got for q, w in near if q[: len(q) // 2 + 1] == w[: len(q) // 2 + 1])


def test_search_of_a_word_grows_slower_than_the_words():
    rng = random.Random(9)
    syllable = lambda: rng.choice("frktndblgmps") + rng.choice("aeiou")
    words = sorted({"la" + "".join(syllable() for _ in range(4)) for _ in range(60_000)})
    probes = rng.sample(words, 200)
    visited = []
    for some in (words[::20], words):
        trie = N.Trie(some)
        held = [hi - lo for q in probes for lo, hi, _ in trie._ranges(q, 2)]
        visited.append(len(held))
    assert visited[1] < 4 * visited[0]


def test_words_of_a_large_shard_are_not_copied_for_every_few_probes(spark):
    words = [f"l{x:06d}" for x in range(4000)]
    index = spark.createDataFrame([("k", w, 1) for w in words], "kind string, word string, most int")
    probes = spark.createDataFrame([("k", w) for w in words], "kind string, probe string")
    sent = N._shards(index, probes, shard_words=100_000, shard_probes=100).groupBy("way").agg(F.count("word").alias("words"), F.count("probe").alias("probes"))
    assert all(r.probes == 4000 and r.words <= 2 * r.probes for r in sent.collect())
    assert {(r.probe, r.word) for r in N.trie_join(index, probes, shard_probes=100).collect()} >= {(w, w) for w in words}
