import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from constellate.llm import bpe, leakage

MODEL = bpe.ByteBpe(bpe.default_path())
TEXT = st.text(max_size=60)


@pytest.fixture(scope="module")
def published():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(bpe.default_path())
    t.encode_special_tokens = True
    return t


def test_same_ids_as_the_published_implementation(published):
    @settings(max_examples=300, deadline=None)
    @given(TEXT)
    def check(s):
        assert MODEL.encode(s) == published.encode(s, add_special_tokens=False).ids
        assert MODEL.decode(MODEL.encode(s)) == s

    check()
    assert MODEL.encode("<|endoftext|>") == published.encode("<|endoftext|>", add_special_tokens=False).ids


def test_one_long_piece():
    s = "ab" * 100_000
    assert MODEL.decode(MODEL.encode(s)) == s


def test_rows_nulls_empty_texts_and_empty_table(spark):
    rows = [(1, "hello world", "x"), (2, "", "x"), (3, None, "x"), (3, "hello world", None), (None, " ", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = sorted(((r.doc_id, r.ids) for r in bpe.encode(df, "doc_id", "text").collect()), key=repr)
    assert got == sorted(((k, MODEL.encode(t)) for k, t, _ in rows), key=repr)
    back = bpe.decode(bpe.encode(df, "doc_id", "text"), "doc_id", "ids")
    assert sorted((r.doc_id or 0, r.text) for r in back.collect()) == sorted((k or 0, t or "") for k, t, _ in rows)
    assert bpe.encode(df.limit(0), "doc_id", "text").count() == 0


def test_cut_and_unknown_ids_decode():
    ids = MODEL.encode("日本 ok")
    assert MODEL.decode(ids) == "日本 ok" and MODEL.decode(ids[:1]).startswith("\ufffd") and MODEL.decode([]) == ""
    assert MODEL.decode([ids[-1], -5, None, ids[-1]]) == " ok\ufffd\ufffd ok"


def brute(docs, items, n):
    out = set()
    for k, t in docs:
        for i, x in items:
            a, b = leakage.words(t or ""), leakage.words(x or "")
            runs = {tuple(b[j : j + n]) for j in range(len(b) - n + 1)}
            if any(tuple(a[j : j + n]) in runs for j in range(len(a) - n + 1)):
                out.add((k, i))
    return out


def test_automaton_against_brute_force_on_a_tiny_alphabet(spark):
    rng = random.Random(7)
    text = lambda n: " ".join(rng.choice("abc") for _ in range(n))
    items = [(i, text(rng.randint(0, 14))) for i in range(12)] + [(90, None), (91, "")]
    docs = [(k, text(rng.randint(0, 25))) for k in range(60)] + [(900, None), (901, ""), (902, items[0][1])]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    e = spark.createDataFrame(items, "item_id bigint, text string")
    got = leakage.leaks(d, "doc_id", "text", e, "item_id", "text", min_words=4).collect()
    assert {(r.doc_id, r.item_id) for r in got} == brute(docs, items, 4)
    for r in got:  # the longest run is right, too
        assert (r.doc_id, r.item_id) in brute([x for x in docs if x[0] == r.doc_id], [x for x in items if x[0] == r.item_id], r.words)
        assert not brute([x for x in docs if x[0] == r.doc_id], [x for x in items if x[0] == r.item_id], r.words + 1)
    assert leakage.leaks(d.limit(0), "doc_id", "text", e, "item_id", "text", 4).count() == 0
    assert leakage.leaks(d, "doc_id", "text", e.limit(0), "item_id", "text", 4).count() == 0
    # Three blocks, one at a time: the same rows and the same texts.
    size = sum(len(t or "") for _, t in items)
    many = {"block_bytes": -(-size // 3)}
    assert leakage.blocks(e, "item_id", "text", **many)[1] == 3
    assert sorted(leakage.leaks(d, "doc_id", "text", e, "item_id", "text", 4, **many).collect()) == sorted(got)
    clean = lambda **k: sorted(leakage.without_leaks(d, "doc_id", "text", e, "item_id", "text", 4, 0.8, **k).collect(), key=repr)
    assert clean(**many) == clean() and any(r.dropped for r in clean()) and any(r.leaked_words and not r.dropped for r in clean())


def test_character_forms_make_no_difference_and_spans_are_removed(spark):
    item = "one two three four five six seven eight nine ten eleven twelve"
    hidden = "**One** two_three\nfo​ur ｆｉｖｅ SIX, seven; eight (nine) ten eleven\xadx"
    docs = [(1, "before words here " + item.upper() + ". after " + "pad " * 20), (2, hidden), (3, "x " + item), (4, None), (5, "")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    e = spark.createDataFrame([(7, item)], "item_id bigint, text string")
    assert {(r.doc_id, r.item_id) for r in leakage.leaks(d, "doc_id", "text", e, "item_id", "text", 10).collect()} == {(1, 7), (2, 7), (3, 7)}
    out = {r.doc_id: r for r in leakage.without_leaks(d, "doc_id", "text", e, "item_id", "text", 10).collect()}
    assert out[1].text == "before words here . after " + "pad " * 20 and out[1].leaked_words == 12
    assert out[3].dropped and out[3].text is None and out[4].text is None and out[5].text == "" and not out[4].dropped


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aéé １ｂ​\xad _*Кx\n1ﬁ", max_size=40))
def test_spans_name_the_same_words(s):
    ws, spans = leakage.word_spans(s)
    assert len(ws) == len(spans) and all(s[a:b] for a, b in spans)
