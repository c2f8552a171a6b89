import random
from pathlib import Path

import pytest

from constellate.llm import subjects as S

DATA = Path("/root/testdata/sf0.01")


def test_sentences():
    assert S.sentences("") == [] and S.sentences("  \n ") == []
    assert S.sentences("HEADING HERE\nOne two three. Is it so? Ann thinks so.") == [["one", "two", "three"], ["is", "it", "so", "ann", "thinks", "so"]]
    assert S.sentences("a b c\nd e f") == [["a", "b", "c"], ["d", "e", "f"]]
    assert S.sentences("It breaks\nhere now.\nNext one.") == [["it", "breaks", "here", "now"], ["next", "one"]]
    assert S.sentences("Text here.\n```\nlog = 1\n```\nhttps://x.example/t?p=1") == [["text", "here"]]
    assert S.sentences("Ｆｕｌｌ wi​dth.") == [["full", "width"]]


def test_scores_thresholds_and_pieces():
    lex = S.Lexicon(["law", "art"], {"court": (0, 1.0), "oil paint": (1, 2.0), "paint": (1, 0.5)}, [0.4, 1.2], frozenset(["then", "so we"]))
    lines = ["the court met in court", "oil paint", "paint oil", "oil", "paint court", "oil paint court " + "x " * 12 + "x"]
    want = [[1 / 5**0.5, 0], [0, 1.25], [0, 0.25], [0, 0], [0.5, 0.25], [0.25, 0.625]]
    for chunk in (1, 25, 10_000):
        assert abs(lex.scores(lines, chunk) - want).max() < 1e-12
    assert lex.dealt(lines).tolist() == [[True, False], [False, True], [False, False], [False, False], [True, False], [False, False]]
    assert lex.scores([]).shape == (0, 2) and not S.Lexicon(["law"], {}, 0.1).dealt(["court"]).any()
    long = " ".join(["w"] * 12 + ["then"] + ["w"] * 12 + ["so", "we"] + ["w"] * 64)
    pieces = list(lex.split(["a b", long]))
    assert " ".join(pieces[1:]) == long and [p.count(" ") + 1 for p in pieces] == [2, 12, 13, 11, 11, 11, 11, 11, 11]
    by, n = lex.counts([["the court met", "oil paint court x"], [], ["x"]])
    assert by.tolist() == [[2, 1], [0, 0], [0, 0]] and n.tolist() == [2, 0, 1]


def test_a_sentence_has_every_subject_that_reaches_its_own_threshold():
    lexicon = S.Lexicon(["art", "law", "sport"], {"brush": (0, 0.9), "judge": (1, 0.8), "goal": (2, 0.8)}, [0.3, 0.3, 0.5])
    by, n = lexicon.counts([["the judge took a brush goal"] * 4])
    assert n.tolist() == [4] and by.tolist() == [[4, 4, 0]]
    seed = S._seed(["art", "law"], [("art", "easel brush")] * 8 + [("art", "easel")] * 40 + [("law", "judge")] * 40)
    assert seed["brush"][1] > 1.3 * seed["easel"][1]  # as pure, but rarer


def corpus(rng):
    nouns = {"law": ["court", "judge", "clause", "appeal"], "sport": ["coach", "goal", "pitch", "team"], "art": ["brush", "canvas", "easel", "paint"]}
    sentence = lambda s: "They spoke about the {} and then about the {}.".format(*rng.sample(nouns[s], 2))
    filler = "Nobody was there yesterday."
    examples, docs, truth = [], [], set()
    for i in range(60):
        s = rng.choice(list(nouns))
        words = nouns[s][:3]  # the last noun occurs in no example
        examples.append((i, s, " ".join("They spoke about the {} and then about the {}.".format(*rng.sample(words, 2)) for _ in range(3))))
    examples += [(100, None, "They spoke."), (101, "law", None), (102, "unknown", "Nobody was there.")]
    for i in range(300):
        a, b = rng.sample(list(nouns), 2)
        body = [sentence(a) for _ in range(5)] + [sentence(b) for _ in range(rng.choice([0, 1, 3]))] + [filler] * 2
        n = {x: sum(1 for y in body if any(w in y for w in nouns[x])) for x in nouns}
        rng.shuffle(body)
        docs.append((i, " ".join(body)))
        truth |= {(i, x) for x in nouns if n[x] * 4 >= len(body)}
    return examples, docs, truth


def test_planted_subjects_with_words_unknown_to_the_examples(spark):
    examples, docs, truth = corpus(random.Random(5))
    last = max(i for i, _ in docs) + 1
    docs += [(last, None), (last + 1, ""), (last + 2, " \n\t"), (0, docs[0][1]), (last + 3, "Nobody was there yesterday. " * 3000)]
    d = spark.createDataFrame([(k, t, 1) for k, t in docs], "doc_id bigint, text string, subject int")
    e = spark.createDataFrame(examples, "example_id bigint, subject string, text string")
    a = spark.createDataFrame([("law",), ("sport",), ("art",), (None,)], "subject string")
    rows = [(r.doc_id, r.subject) for r in S.document_subjects(d, "doc_id", "text", e, a).collect()]
    assert set(rows) == truth
    assert len(rows) == len(truth) + sum(1 for k, _ in truth if k == 0)  # a repeated row is a row of its own
    assert S.document_subjects(d.limit(0), "doc_id", "text", e, a).count() == 0


@pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")
def test_held_out_examples(spark):
    import duckdb

    rows = duckdb.sql(f"SELECT example_id, subject, text, lang FROM '{DATA}/subject_examples.parquet' WHERE subject IS NOT NULL ORDER BY example_id").fetchall()
    train, held = rows[::2], rows[1::2]
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    e = spark.createDataFrame([(i, s, t) for i, s, t, _ in train], "example_id bigint, subject string, text string")
    areas = sorted({s for _, s, _, _ in rows})
    lexicon = S.learn(S.tokenised(docs, "doc_id", "text"), e, "subject", "text", areas)
    right = 0
    for _, s, t, _ in held:
        by, _ = lexicon.counts([[" ".join(ws) for ws in S.sentences(t)]])
        right += bool(by.any()) and lexicon.subjects[by[0].argmax()] == s
    assert right / len(held) > 0.85  # some labels of the examples are wrong
