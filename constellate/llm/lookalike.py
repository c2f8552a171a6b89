"""Visually identical text with different characters: one consistent form of every text.

Words that hold anything but printable ASCII are looked up in tries of the plain spellings of the corpus, sharded by
their skeleton (every letter replaced by the Latin letter it looks like, ignorable characters left out).  A weighted edit
automaton walks the trie: compatibility forms, ignorables and exact look-alikes cost nothing, rough look-alikes one each up
to a budget, everything else is forbidden, so that exactly the spellings that read the same are reached.  Among them the
canonical one is chosen by cost, by script of the surrounding text and by support; only words without a match are
normalised by table.
"""

from __future__ import annotations

import unicodedata as ud
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from constellate.operators.skew import hot_split_join
from constellate.session import materialize

# Letters of other scripts that cannot be told from a Latin letter, and that Latin letter.
CYRILLIC_AS_LATIN = {
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ї": "Ï", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O",
    "Р": "P", "С": "C", "Т": "T", "У": "Y", "Ү": "Y", "Х": "X", "Ԁ": "D", "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W", "Ё": "Ë",
    "а": "a", "е": "e", "ѕ": "s", "і": "i", "ї": "ï", "ј": "j", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x",
    "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "ё": "ë",
}
GREEK_AS_LATIN = {
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "ϲ": "c", "ϳ": "j",
}
# Looser likenesses, used only to bring a word of mixed scripts back to its own script.
LOOSE_AS_LATIN = {
    "к": "k", "α": "a", "ι": "i", "κ": "k", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "γ": "y", "η": "n", "ω": "w",
    "ε": "e", "м": "m", "т": "t", "в": "b", "н": "h",
}
STRICT = {**CYRILLIC_AS_LATIN, **GREEK_AS_LATIN}
# Characters that show nothing although their category is not "format".
UNSEEN_MARKS = "͏ᅟᅠ឴឵᠋᠌᠍᠏ㅤﾠ"
# Format characters that do show, as number signs of Arabic and Syriac.
SHOWN_FORMATS = "؀؁؂؃؄؅۝܏࢐࢑࣢"

_EMOJI = (
    r"\p{RI}\p{RI}|[0-9#*]️?⃣"
    r"|\p{Extended_Pictographic}(?:\p{EMod}|️⃣?|[\U000E0020-\U000E007F]+)?"
    r"(?:‍\p{Extended_Pictographic}(?:\p{EMod}|️)?)*"
)
EMOJI = regex.compile(_EMOJI)
LETTERS = regex.compile(r"[\p{L}\p{M}]+")
JOINED = regex.compile(r"(?<=[\p{Arabic}\p{Devanagari}\p{Bengali}\p{Tamil}\p{Telugu}\p{Kannada}\p{Malayalam}\p{Sinhala}\p{Khmer}\p{Mongolian}\p{M}])[‌‍]")
EAST_ASIAN = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]")
#: Blanks other than the ordinary one, as a Java and Python character class.
ODD_BLANK = "[\\x00-\\x1f\\x7f-\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u2800\\u3000]"
_BLANK = regex.compile(ODD_BLANK)


@lru_cache(maxsize=65536)
def unseen(ch: str) -> bool:
    if ch in SHOWN_FORMATS:
        return False
    return ud.category(ch) == "Cf" or ch in UNSEEN_MARKS or 0xFE00 <= ord(ch) <= 0xFE0F or 0xE0100 <= ord(ch) <= 0xE01EF


_UNSEEN = regex.compile(rf"[[\p{{Cf}}{UNSEEN_MARKS}\uFE00-\uFE0F\U000E0100-\U000E01EF]--[{SHOWN_FORMATS}]]", regex.V1)


def without_unseen(text: str) -> str:
    """``text`` without the characters that :func:`unseen` names."""
    return _UNSEEN.sub("", text)


@lru_cache(maxsize=65536)
def ordinary(ch: str) -> str:
    """The ordinary form of a compatibility letter, digit or sign; any other character as it is."""
    tag, _, _ = ud.decomposition(ch).partition(" ")
    if not tag.startswith("<"):
        return ch
    out = ud.normalize("NFKC", ch)
    if tag in ("<wide>", "<narrow>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>"):
        return out
    if tag in ("<compat>", "<circle>") and ud.category(ch)[0] in "LN" + "S" * (tag == "<circle>") and out.isascii() and out.isalpha():
        return out
    return ch


@lru_cache(maxsize=65536)
def script(ch: str) -> str:
    if not ch.isalpha():
        return ""
    return ud.name(ch, "").split(" ", 1)[0]


_EUROPEAN = ("LATIN", "CYRILLIC", "GREEK")
_TO_LATIN = {**STRICT, **LOOSE_AS_LATIN}


# Letters of minority languages; they can pass for Latin ones, but no Latin letter is read as one of them.
SELDOM = "ҮԀԌԚԜһԁԛԝӏϲϳ"


def _reverse(table: dict[str, str], loose: str) -> dict[str, str]:
    out = {v: k for k, v in LOOSE_AS_LATIN.items() if script(k) == loose}
    out.update({v: k for k, v in table.items() if k not in SELDOM})
    return out


_FROM_LATIN = {"CYRILLIC": _reverse(CYRILLIC_AS_LATIN, "CYRILLIC"), "GREEK": _reverse(GREEK_AS_LATIN, "GREEK")}


def _has_twin(ch: str) -> bool:
    return ch in _TO_LATIN or ch in _FROM_LATIN["CYRILLIC"] or ch in _FROM_LATIN["GREEK"]


def _exact_twin(ch: str, target: str) -> bool:
    latin = ch if script(ch) == "LATIN" else STRICT.get(ch)
    return latin is not None and (target == "LATIN" or any(v == latin and script(k) == target for k, v in STRICT.items()))


def into(word: str, target: str) -> str | None:
    """``word`` with every letter of another European script replaced by its look-alike in ``target``; None if one has none."""
    out = []
    for ch in word:
        s = script(ch)
        if s == target or s not in _EUROPEAN:
            out.append(ch)
            continue
        as_latin = ch if s == "LATIN" else _TO_LATIN.get(ch)
        put = as_latin if target == "LATIN" else _FROM_LATIN[target].get(as_latin or "")
        if put is None:
            return None
        out.append(put)
    return "".join(out)


@lru_cache(maxsize=65536)
def one_script(word: str) -> str:
    """A word of mixed European scripts in its own script: the one that can spell all of it, most of its letters first.

    Words of one script, and mixtures that no script can spell (which therefore do not look like a word of one
    script), stay as they are.
    """
    found = [s for s in map(script, word) if s in _EUROPEAN]
    kinds = set(found)
    if len(kinds) < 2:
        return word
    strong = {s: sum(1 for ch in word if script(ch) == s and not _has_twin(ch)) for s in kinds}
    # Letters that are only roughly alike speak against a script that would need them.
    rough = {s: sum(1 for ch in word if script(ch) in _EUROPEAN and script(ch) != s and not _exact_twin(ch, s)) for s in kinds}
    for s in sorted(kinds, key=lambda s: (-strong[s], rough[s], -found.count(s), _EUROPEAN.index(s))):
        out = into(word, s)
        if out is not None:
            return out
    return word


def _fold(segment: str) -> str:
    kept = []
    keep_joiners = {m.start() for m in JOINED.finditer(segment)} if "‌" in segment or "‍" in segment else ()
    for i, ch in enumerate(segment):
        if unseen(ch) and i not in keep_joiners:
            continue
        if 0xFF01 <= ord(ch) <= 0xFF65 and not ordinary(ch).isalnum() and (
            EAST_ASIAN.match(segment, i - 1, i) if i else None or EAST_ASIAN.match(segment, i + 1)
        ):
            kept.append(ch)  # full-width signs are the ordinary ones beside East Asian letters
        else:
            kept.append(ordinary(ch))
    return LETTERS.sub(lambda m: one_script(m.group()), ud.normalize("NFC", "".join(kept)))


def plain_form(text: str) -> str:
    """``text`` in plain form as far as tables decide: see the module; whole emoji stay, odd blanks become blanks."""
    if text.isascii() and text.isprintable():
        return text
    text = _BLANK.sub(" ", text)
    out, at = [], 0
    for m in EMOJI.finditer(text):
        out += [_fold(text[at : m.start()]), m.group()]
        at = m.end()
    out.append(_fold(text[at:]))
    return "".join(out)


def skeleton(text: str) -> str:
    """What ``text`` looks like: ordinary characters, taken apart, nothing unseen, every look-alike letter as the Latin one."""
    if text.isascii():
        return text
    seen = ud.normalize("NFD", "".join(ordinary(c) for c in text if not unseen(c)))
    return "".join(_TO_LATIN.get(c, c) for c in seen)


class LookAlikeTrie:
    """Vocabulary trie walked by a weighted edit automaton.

    The trie holds the attested spellings that are plain already, under their decomposed form, so that composed and
    decomposed accents and syllables are one.  Compatibility forms, ignorable characters and exact look-alikes cost
    nothing, a rough look-alike (see ``LOOSE_AS_LATIN``) costs one, any other edit is forbidden.
    """

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, spelling: str, support: int) -> None:
        node = self.root
        for ch in ud.normalize("NFD", spelling):
            node = node.setdefault(ch, {})
        held = node.setdefault("", {})
        held[spelling] = held.get(spelling, 0) + support

    def matches(self, word: str, budget: int = 0) -> list[tuple[str, int, int]]:
        """(spelling, cost, support) of every spelling that reads like ``word`` at a cost of at most ``budget``."""
        left_at: dict[tuple[int, int], int] = {}
        found: dict[str, tuple[int, int]] = {}
        steps = [self._steps(ch) for ch in ud.normalize("NFD", word)]
        stack = [(0, self.root, budget)]
        while stack:
            i, node, left = stack.pop()
            if left_at.get((i, id(node)), -1) >= left:
                continue
            left_at[i, id(node)] = left
            if i == len(steps):
                for spelling, support in node.get("", {}).items():
                    if budget - left < found.get(spelling, (budget + 1, 0))[0]:
                        found[spelling] = (budget - left, support)
            else:
                for cost, out in steps[i]:
                    nxt = node if cost <= left else None
                    for ch in out if nxt is not None else ():
                        nxt = nxt.get(ch)
                        if nxt is None:
                            break
                    if nxt is not None:
                        stack.append((i + 1, nxt, left - cost))
            for ch, nxt in node.items():
                if ch and unseen(ch):
                    stack.append((i, nxt, left))
        return [(w, cost, n) for w, (cost, n) in found.items()]

    @staticmethod
    @lru_cache(maxsize=65536)
    def _steps(ch: str) -> tuple[tuple[int, str], ...]:
        """(cost, what the trie may hold for it) of a character of the word."""
        if unseen(ch):
            return ((0, ""), (0, ch))
        same = ud.normalize("NFD", ordinary(ch))
        if len(same) != 1:
            return tuple(dict.fromkeys([(0, ch), (0, same)]))
        exact, rough = STRICT.get(same, same), _TO_LATIN.get(same, same)
        out = dict.fromkeys([ch, same, exact, *(k for k, v in STRICT.items() if v == exact and k not in SELDOM)], 0)
        for other in (rough, *(k for k, v in _TO_LATIN.items() if v == rough and k not in SELDOM)):
            out.setdefault(other, 1)
        return tuple((cost, to) for to, cost in out.items())


def kinds(word: str) -> list[str]:
    """The European scripts of a word's letters, in order of appearance."""
    return list(dict.fromkeys(s for s in map(script, ud.normalize("NFD", "".join(map(ordinary, word)))) if s in _EUROPEAN))


def choose(word: str, around: str, attested: list[tuple[str, int, int]]) -> tuple[str, bool]:
    """The canonical spelling of ``word``, and whether an attested spelling gives it.

    ``attested`` are the spellings that read like it (see :meth:`LookAlikeTrie.matches`); ``around`` names the scripts of
    the letters in the same text that look like no other script's (C, G, L).  A word in one script takes the spelling in
    that script, itself if that is attested; a word in two takes the cheapest, then one in the script around it, then
    the best attested.  A word in one script all of whose letters could be of another one keeps its own where the text
    around it is in that script; else the better attested spelling wins.  Text in the other script around it lets that
    spelling win with an eighth of the support; without any text around, equal support keeps the word.  Where nothing is
    attested, the table decides (:func:`plain_form`).
    """
    if not attested:
        return plain_form(word), False
    own = kinds(word)
    of = {w: "".join(s[0] for s in kinds(w)) for w, _, _ in attested}
    if len(own) > 1:
        w, _, _ = min(attested, key=lambda m: (m[0] != word, m[1], not set(of[m[0]]) & set(around), sum(map(unseen, m[0])), -m[2], m[0]))
        return w, True
    mine = [m for m in attested if not own or of[m[0]] in ("", own[0][0])]
    kept, support = word, 0
    if mine:
        kept, _, support = min(mine, key=lambda m: (m[0] != word, sum(map(unseen, m[0])), -m[2], m[0]))
    else:
        kept = plain_form(word)
    if not own or (own[0][0] in around and (own[0] != "LATIN" or len(around) == 1)):
        return kept, bool(mine)
    best, most = kept, 0
    for w, cost, n in sorted(attested):
        if cost or of[w] in ("", own[0][0]) or (around and of[w] not in around):
            continue
        # Text in the other script around it speaks for that script, but not against a word that is common in its own.
        if n > most and (n > support or around and n * 8 >= support):
            best, most = w, n
    return best, bool(mine) or best != kept


# ---- distributed part ----------------------------------------------------------------------------------------------

_STRICT_CLASS = "".join(STRICT)
#: Latin letters that a letter of another script can be read as.
TWINS = _LATIN_TWINS = "".join(sorted({v for k, v in STRICT.items() if k not in SELDOM}))


def _scripts_around(value: Column) -> Column:
    """Scripts of letters that look like no other script's."""
    return F.concat(
        F.when(value.rlike(rf"[\p{{IsCyrillic}}&&[^{_STRICT_CLASS}]]"), "C").otherwise(""),
        F.when(value.rlike(rf"[\p{{IsGreek}}&&[^{_STRICT_CLASS}]]"), "G").otherwise(""),
        F.when(value.rlike(rf"[\p{{IsLatin}}&&[^{_LATIN_TWINS}]]"), "L").otherwise(""),
    )


def _tokens(value: Column) -> Column:
    return F.split(F.regexp_replace(value, ODD_BLANK, " "), " +")


def canonical_tokens(values: DataFrame, shard_rows: int = 20000, budget: int = 3) -> DataFrame:
    """(token, around, held, canonical, attested): canonical spelling of every blank-delimited token that is not plain
    ASCII, and of every ASCII token whose letters a rival spelling in another script could have.

    ``values`` has distinct texts ``value`` and how often each occurs, ``n``; ``held`` is the number of texts that hold
    the token, ``attested`` tells tokens decided by the vocabulary from those left to the table.  Tries are sharded by
    skeleton, which all spellings that read alike share; one holds about ``shard_rows`` tokens, whatever the size of the
    corpus.  A word of mixed scripts may have up to ``budget`` roughly alike letters replaced.
    """
    counted = (
        values.select(F.explode(F.array_distinct(_tokens(F.col("value")))).alias("token"), _scripts_around(F.col("value")).alias("around"), "n")
        .where("token != ''").groupBy("token", "around").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("held"))
    )
    odd = F.col("token").rlike("[^\\x21-\\x7e]")
    twin = F.col("token").rlike(rf"^[^\p{{L}}]*[{_LATIN_TWINS}][{_LATIN_TWINS}\P{{L}}]*$")
    skeleton_of = F.pandas_udf(lambda s: s.map(skeleton), "string")
    counted = materialize(counted, "tokens")
    odd_tokens = materialize(counted.where(odd).withColumn("skeleton", skeleton_of("token")), "odd")
    rivals = odd_tokens.select("skeleton").distinct()
    ascii_tokens = counted.where(~odd).withColumn("skeleton", F.col("token")).join(rivals, "skeleton", "left_semi")
    # An ASCII token needs a verdict only where all its letters have twins; else it only attests a spelling.
    work = odd_tokens.withColumn("ask", F.lit(True)).unionByName(ascii_tokens.withColumn("ask", twin))
    work = materialize(work, "work")
    # Work does not follow bytes here: as many shards as there are cores at least, kept apart.
    shards = max(-(-work.count() // shard_rows), 2 * values.sparkSession.sparkContext.defaultParallelism)

    def judge(pdf: pd.DataFrame) -> pd.DataFrame:
        trie = LookAlikeTrie()
        for t, n in pdf.groupby("token")["n"].sum().items():
            if plain_form(t) == t:
                trie.add(t, int(n))
        asked = pdf[pdf["ask"]]
        found = {t: trie.matches(t, budget if len(kinds(t)) > 1 else 0) for t in asked["token"].unique()}
        out = [choose(t, a, found[t]) for t, a in zip(asked["token"], asked["around"])]
        return asked[["token", "around", "held"]].assign(canonical=[c for c, _ in out], attested=[by for _, by in out])

    return (
        work.withColumn("shard", F.pmod(F.xxhash64("skeleton"), F.lit(shards)).cast("int")).repartition(shards, "shard")
        .groupBy("shard").applyInPandas(judge, "token string, around string, held bigint, canonical string, attested boolean")
    )


def _identity_texts(playlists: DataFrame, nodes: DataFrame) -> DataFrame:
    credits = playlists.select("id", F.posexplode(F.col("tracks.artist_name")).alias("pos", "value"))
    return (
        credits.select(F.lit("artist_name").alias("field"), "id", "pos", "value")
        .unionByName(playlists.select(F.lit("title").alias("field"), "id", F.lit(-1).alias("pos"), F.col("title").alias("value")))
        .unionByName(nodes.select(F.lit("label").alias("field"), "id", F.lit(-1).alias("pos"), F.col("label").alias("value")))
        .where(F.col("value").isNotNull() & (F.col("value") != ""))
    )


def canonical_values(values: DataFrame) -> DataFrame:
    """(value, n, canonical) of every distinct text that differs from its consistent form; ``values`` is (value, n)."""
    tokens = materialize(canonical_tokens(values).where(F.col("canonical") != F.col("token")), "changed")
    candidates = values.where(F.col("value").rlike("[^\\x20-\\x7e]") | F.col("value").rlike(rf"(?<!\p{{L}})[{_LATIN_TWINS}]+(?!\p{{L}})"))
    key = F.struct("token", "around").alias("key")
    held = candidates.select("value", "n", F.explode(F.array_distinct(_tokens(F.col("value")))).alias("token"), _scripts_around(F.col("value")).alias("around"))
    total = int(tokens.agg(F.sum("held")).first()[0] or 0)
    hits = (
        hot_split_join(held.select("value", "n", "token", key), tokens.select(key, "held", "canonical"), "key", "held", total)
        .groupBy("value", "n").agg(F.map_from_entries(F.collect_list(F.struct("token", "canonical"))).alias("changed"))
    )
    spaced = F.regexp_replace("value", ODD_BLANK, " ")
    blanks = candidates.where(F.col("value").rlike(ODD_BLANK)).select("value", "n", F.lit(None).cast("map<string,string>").alias("changed"))
    both = hits.unionByName(blanks).groupBy("value", "n").agg(F.first("changed", ignorenulls=True).alias("changed"))
    rebuilt = F.array_join(F.transform(F.split(spaced, " "), lambda t: F.coalesce(F.col("changed")[t], t)), " ")
    return both.select("value", "n", F.when(F.col("changed").isNull(), spaced).otherwise(rebuilt).alias("canonical"))


def canonical_texts(texts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, value, canonical) of every distinct row whose ``value`` differs from its consistent form.

    Every spelling is judged once, however many rows hold it, and the verdicts are joined back to the rows, those of very
    frequent spellings by broadcast.  Null and empty values have no row; repeated rows count once; an empty table gives
    an empty result.  Texts of any length are taken whole.  The blanks of the canonical text are ordinary ones, as many
    as the text has odd ones.
    """
    texts = texts.select(*keys, "value").where(F.col("value").isNotNull() & (F.col("value") != ""))
    values = materialize(texts.groupBy("value").agg(F.count(F.lit(1)).alias("n")), "values")
    made = materialize(canonical_values(values).toDF("value", "__n", "__canonical"), "canonical")
    total = int(made.agg(F.sum("__n")).first()[0] or 0)
    return hot_split_join(texts, made, "value", "__n", total).select(*keys, "value", F.col("__canonical").alias("canonical")).distinct()


def odd_texts(playlists: DataFrame, nodes: DataFrame) -> DataFrame:
    """(field, id, pos) of artist names, playlist titles and node labels stored in other than their plain form."""
    return canonical_texts(_identity_texts(playlists, nodes), ["field", "id", "pos"]).select("field", "id", "pos").distinct()


def plain_texts(df: DataFrame, column: str) -> DataFrame:
    """``df`` with ``column`` in the form that tables alone give, for use where no vocabulary is at hand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i = b.schema.get_field_index(column)
            made = pa.array([None if v is None else plain_form(v) for v in b.column(i).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([made if j == i else b.column(j) for j in range(b.num_columns)], names=b.schema.names)

    return df.mapInArrow(run, df.schema)
