"""Variant spellings of names typed by people: which spellings stand for the same entity.

Names are cut into words; the telling (rare) words of all known names are sharded into tries, once by their first letter
and once, reversed, by their last.  Levenshtein automata (with transpositions) walk the tries and enumerate the words
within a bounded distance of every typed word.  Names that share a telling word this way are then compared as wholes:
over the permutations of their words, where a word may also stand as a nickname, an initial or an abbreviation, and over
their letters without blanks.
"""

from __future__ import annotations

import re
import unicodedata as ud
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from constellate.llm.bpe import spread
from constellate.llm.lookalike import STRICT, TWINS, into, plain_form, script
from constellate.session import materialize

# Everyday short forms of given names.
SHORT_FORMS = {
    "alexander": "alex lex sasha xander alec sandy", "benjamin": "ben benny benji benjy", "christopher": "chris kit topher kris",
    "dorothea": "dora dot dottie dotty thea dory dolly", "elizabeth": "liz lizzy lizzie beth betty bess bessie eliza lisa libby elsie ellie",
    "frederick": "fred freddy freddie rick fritz", "gabriella": "gabi gabby gaby ella brie", "henrietta": "hetty hettie etta hattie henny",
    "isabella": "bella izzy isa belle izzie isabel", "josephine": "jo josie josy jojo posy", "katherine": "kate kathy katie kat kitty kathie kay cathy",
    "leonardo": "leo leon lenny nardo", "margaret": "maggie meg peg peggy greta marge margie madge daisy rita", "nathaniel": "nat nate nathan",
    "patricia": "pat patty patsy tricia trish", "robert": "rob bob bobby robbie bert robby", "samuel": "sam sammy sammie",
    "theodore": "theo ted teddy", "veronica": "vero ronnie nica roni vera ronny", "william": "will bill billy willy liam willie",
    "james": "jim jimmy jamie", "john": "jack johnny jon", "michael": "mike mikey mick", "richard": "dick richie ricky", "charles": "charlie chuck",
    "thomas": "tom tommy", "edward": "ed eddie ned", "anthony": "tony", "andrew": "andy drew", "matthew": "matt", "daniel": "dan danny",
    "joseph": "joe joey", "david": "dave davy", "nicholas": "nick nicky", "rebecca": "becky becca", "susan": "sue susie", "jennifer": "jenny jen",
    "catherine": "cathy cat", "victoria": "vicky tori", "abigail": "abby", "deborah": "deb debbie", "stephen": "steve", "gregory": "greg",
}
FULL_FORM = {short: full for full, shorts in SHORT_FORMS.items() for short in shorts.split()}
# Other written forms of one word.
SAME_WORD = {"da": "the", "emcee": "mc", "deejay": "dj", "capt": "captain", "3o": "trio", "bros": "brothers"}
# Words and signs that join the parts of a name.
JOINERS = {"and", "with", "of", "feat", "ft", "и", "und", "et"}
_ADDED = re.compile(r"(?:\s*[-–—]\s*topic|\s*\(\s*official\s*\)|\s+official|\s*vevo|\s+music)\s*$")
_WORDS = re.compile(r"[^\W_]+")
_LEET = str.maketrans("013457", "oieast")


def spelling(name: str) -> str:
    """What counts as the spelling of a name: character forms, case and blanks at the ends and in rows aside.

    In a name with plainly Latin letters and no plainly Greek or Cyrillic ones, look-alikes are Latin letters; in one with
    plainly Cyrillic and no plainly Latin ones they are Cyrillic.
    """
    form = plain_form(name)
    if not form.isascii():
        alike = "".join(STRICT.get(c, c) for c in form)
        if alike != form and all(script(c) not in ("GREEK", "CYRILLIC") for c in alike):
            if any(script(c) == "LATIN" and c not in TWINS for c in form):
                form = alike
        elif any(script(c) == "CYRILLIC" and c not in STRICT for c in form) and all(script(c) != "LATIN" or c in TWINS for c in form):
            form = into(form, "CYRILLIC") or form
    return re.sub(r"\s+", " ", form).strip().casefold()


class Name:
    """The words of a spelling, as far as comparison goes: without accents and additions, written forms evened out."""

    __slots__ = ("words", "the", "lead", "joined", "numbers")

    def __init__(self, form: str) -> None:
        s = "".join(c for c in ud.normalize("NFD", form) if not ud.combining(c))
        while (cut := _ADDED.sub("", s)) != s and _WORDS.search(cut):
            s = cut
        s = re.sub(r"\bdee jay\b", "dj", re.sub(r"\bw/", " ", s))
        linked = re.search(r"[&+]|\band\b|\bи\b", s)
        self.words: list[str] = []
        self.the = False
        self.lead = 0
        every = []
        for m in _WORDS.finditer(s):
            w = SAME_WORD.get(m.group(), m.group())
            if not w.isdigit() and not w.isalpha():
                w = SAME_WORD.get(w, w.translate(_LEET))
            if w in JOINERS and m.group() != s.strip():
                continue
            every.append(w)
            if w == "the":
                self.the = True
                continue
            self.words.append(w)
            if linked and m.end() <= linked.start():
                self.lead += 1
        if not self.words:
            self.words, self.the = every, False
        self.joined = "".join(every)
        self.numbers = sorted(w for w in self.words if w.isdigit())


def distance(a: str, b: str, most: int) -> int:
    """Edits (transpositions of neighbours are one) between two words, or ``most + 1`` where there are more."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    i = 0
    while i < len(a) and i < len(b) and a[i] == b[i]:
        i += 1
    a, b = a[i:], b[i:]
    if not a or not b:
        return min(most + 1, len(a) + len(b))
    two, one = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = one[j - 1] if x == y else 1 + min(one[j - 1], one[j], row[-1])
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, two[j - 2] + 1)
            row.append(d)
        if min(row) > most and min(one) > most - 1:
            return most + 1
        two, one = one, row
    return min(one[-1], most + 1)


def edits_allowed(word: str) -> int:
    n = len(word)
    return 2 if n >= 7 else 1 if n >= 4 else 0


def _within(short: str, word: str) -> bool:
    it = iter(word)
    return all(c in it for c in short)


def _word_cost(a: str, b: str, telling: bool) -> tuple[float, int] | None:
    """(cost, edits) of typed word ``a`` standing for word ``b`` of a known name; ``telling`` words must be spelt out."""
    if a == b:
        return 0.0, 0
    if a.isdigit() or b.isdigit():
        return None
    if not telling:
        if FULL_FORM.get(a) == b or FULL_FORM.get(b) == a or (a in FULL_FORM and FULL_FORM[a] == FULL_FORM.get(b)):
            return 0.4, 0
        if len(a) == 1 and b[0] == a or len(b) == 1 and a[0] == b:
            return 0.5, 0
        if 1 < len(a) < len(b) and a[0] == b[0] and _within(a, b) or 1 < len(b) < len(a) and a[0] == b[0] and _within(b, a):
            if len(b) > 3 and abs(len(a) - len(b)) > 1:
                return 0.5, 0
    most = edits_allowed(min(a, b, key=len) if len(b) < 7 else b)
    d = distance(a, b, most)
    return (float(d), d) if d <= most else None


def name_cost(a: Name, b: Name, telling: frozenset[str], edits: int = 2) -> float | None:
    """How far typed name ``a`` is from known name ``b``; None where it does not stand for it.

    ``telling`` are the words of ``b`` that single it out.
    """
    if a.numbers != b.numbers:
        return None
    best = None
    d = distance(a.joined, b.joined, 2)
    if d <= 1 and len(b.joined) >= 8 or d == 2 and len(b.joined) >= 12:
        best = (0.0 if a.words == b.words else 0.45) + d
    start = (0.2 if b.the and not a.the else 0.4 if a.the and not b.the else 0.0)

    # Words of b in order, each by a free word of a; of equal ways to come to a place only the cheapest goes on.  A way is
    # the words used (of equal words the first ones), the edits spent, and how many words of b were spelt out.
    n, m = len(a.words), len(b.words)
    same = {w: [i for i, x in enumerate(a.words) if x == w] for w in a.words}
    ways: dict[tuple[int, int, int], float] = {(0, 0, 0): start}
    skip_lead = b.lead if m - b.lead >= 2 else 0
    if n > m + 1 or n < m - max(skip_lead, 1):
        return best
    for k, word in enumerate(b.words):
        fits = [(places, c) for w, places in same.items() if (c := _word_cost(w, word, word in telling)) is not None]
        after: dict[tuple[int, int, int], float] = {}
        for (used, spent, spelt), cost in ways.items():
            steps = []
            for places, (c, d) in fits:
                if spent + d <= edits and (i := next((i for i in places if not used >> i & 1), None)) is not None:
                    steps.append(((used | 1 << i, spent + d, spelt + (c == d)), cost + c))
            if k < skip_lead or (k == m - 1 and k >= 2 and not b.lead and spelt == k and word not in telling):
                steps.append(((used, spent, spelt), cost + 1.0))  # a leading act, or the kind of act, left out
            for way, c in steps:
                if (best is None or c < best) and c < after.get(way, float("inf")):
                    after[way] = c
        if not after:
            return best
        ways = after
    for (used, _, spelt), cost in ways.items():
        rest = [w for i, w in enumerate(a.words) if not used >> i & 1]
        if len(rest) > 1 or rest and len(rest[0]) > 1 or rest and spelt < 2 or not spelt:
            continue
        best = min(cost + 0.6 * len(rest), cost + 0.6 * len(rest) if best is None else best)
    return best


# ---- trie join -----------------------------------------------------------------------------------------------------


def _coded(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points, letters as bits and the last two letters of words of one length."""
    length = len(words[0])
    codes = np.array(words, f"U{length}").view(np.uint32).reshape(len(words), length)
    letters = np.zeros(len(words), np.uint64)
    for k in range(length):
        letters |= np.uint64(1) << (codes[:, k] % 64).astype(np.uint64)
    return codes, letters, codes[:, -1].astype(np.uint64) << np.uint64(32) | codes[:, max(0, length - 2)]


def _close(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Whether the words of each row, given by their code points, are within ``most`` edits (as in :func:`distance`)."""
    rows, n, m, far = len(a), a.shape[1], b.shape[1], most + 1
    a, b = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
    none = np.full(rows, far, np.int8)
    # A row of the table, along the diagonals that the edits can reach.
    two, one = [], [none if o < 0 else np.full(rows, o, np.int8) for o in range(-most, most + 1)]
    for i in range(1, n + 1):
        row: list[np.ndarray] = []
        for o in range(2 * most + 1):
            j = i + o - most
            if not 0 < j <= m:
                row.append(none if j else np.full(rows, min(i, far), np.int8))
                continue
            d = one[o] + (a[i - 1] != b[j - 1])
            if o < 2 * most:
                d = np.minimum(d, one[o + 1] + 1)
            if o:
                d = np.minimum(d, row[-1] + 1)
            if i > 1 and j > 1:
                d = np.where((a[i - 1] == b[j - 2]) & (a[i - 2] == b[j - 1]), np.minimum(d, two[o] + 1), d)
            row.append(np.minimum(d, far).astype(np.int8))
        two, one = one, row
    return one[m - n + most] <= most


class Trie:
    """Words of one length in order; a node [from, to, nodes below] is a range of them, opened when it is first met."""

    def __init__(self, words: list[str], few: int = 16) -> None:
        self.words = sorted(words)
        self.length = len(self.words[0])
        self.codes, self.letters, self.last = _coded(self.words)
        self.few = few
        self.root: list = [0, len(self.words), None]

    def _below(self, node: list, depth: int) -> dict[str, list]:
        if node[2] is None:
            lo, hi, _ = node
            col = self.codes[lo:hi, depth]
            cuts = [0, *(np.flatnonzero(col[1:] != col[:-1]) + 1).tolist(), hi - lo]
            node[2] = {chr(col[a]): [lo + a, lo + b, None] for a, b in zip(cuts, cuts[1:])}
        return node[2]

    def _ranges(self, q: str, most: int) -> list[tuple[int, int, bool]]:
        """Ranges of words, or of those that end like ``q``, with all within ``most`` edits of which at most half are in its first half.

        The automaton walks the first half.  Where one edit is left for five letters or more, it spares the first two of
        them or the last two: the former are walked, the latter make a range of words that end alike.
        """
        n, half, early, few, shift = len(q), len(q) // 2, most // 2, self.few, self.length - len(q)
        out: list[tuple[int, int, bool]] = []
        seen: dict[tuple[int, int], int] = {}
        stack = [(self.root, 0, 0, 0)]
        while stack:
            node, d, i, e = stack.pop()
            while e - most <= shift + i - d <= most - e:  # what is left in the words and in q differs in length by no more than the edits left
                lo, hi, below = node
                if hi - lo <= few or i >= half and (n - i < 5 or most - e > 1):
                    out.append((lo, hi, False))
                    break
                if i >= half:
                    out.append((lo, hi, True))
                    if e < most and (nxt := (below or self._below(node, d)).get(q[i])):
                        if nxt[1] - nxt[0] > few:
                            nxt = self._below(nxt, d + 1).get(q[i + 1])
                        if nxt:
                            out.append((nxt[0], nxt[1], False))
                    break
                at = (id(node), i)
                if seen.get(at, most + 1) <= e:
                    break
                seen[at] = e
                below = below or self._below(node, d)
                c = q[i]
                if e < early:
                    stack.append((node, d, i + 1, e + 1))
                    for ch, nxt in below.items():
                        stack.append((nxt, d + 1, i, e + 1))
                        if ch != c:
                            stack.append((nxt, d + 1, i + 1, e + 1))
                if i + 1 < n and q[i + 1] != c and e < (early if i + 1 < half else most) and (nxt := below.get(q[i + 1])):  # across the middle it is a late edit
                    if nxt[1] - nxt[0] <= few:
                        out.append((nxt[0], nxt[1], False))
                    elif nxt := self._below(nxt, d + 1).get(c):
                        stack.append((nxt, d + 2, i + 2, e + 1))
                node = below.get(c)
                if node is None:
                    break
                d, i = d + 1, i + 1
        return out

    def near(self, probes: list[str], most: int, chunk: int = 200_000) -> Iterator[tuple[str, str]]:
        """(probe, word) within ``most`` edits, all with at most half of them in the first half; the probes are of one length."""
        codes, letters, last = _coded(probes)

        def settle(held: list[tuple[int, int, int, bool]]) -> Iterator[tuple[str, str]]:
            at, lo, hi, ends = np.array(held, np.int64).T
            times = hi - lo
            w = np.arange(times.sum()) + np.repeat(lo - np.cumsum(times) + times, times)
            keep = np.flatnonzero((self.last[w] == np.repeat(last[at], times)) | np.repeat(ends == 0, times))
            p, w = at[np.repeat(np.arange(len(at)), times)[keep]], w[keep]
            a, b = letters[p], self.letters[w]
            keep = (np.bitwise_count(a & ~b) <= most) & (np.bitwise_count(b & ~a) <= most)
            p, w = np.divmod(np.unique(p[keep] * len(self.words) + w[keep]), len(self.words))
            keep = _close(codes[p], self.codes[w], most)
            yield from ((probes[x], self.words[y]) for x, y in zip(p[keep].tolist(), w[keep].tolist()))

        held, n = [], 0
        for k, q in enumerate(probes):
            for lo, hi, ends in self._ranges(q, most):
                held.append((k, lo, hi, ends))
                n += hi - lo
            if n > chunk:
                yield from settle(held)
                held, n = [], 0
        if held:
            yield from settle(held)


def near_pairs(words: Iterable[str], probes: Iterable[str], most: int) -> Iterator[tuple[str, str]]:
    """(probe, word) within ``most`` edits, all with at most half of them in the first half of the probe; a trie for each length of words."""
    known, asked = defaultdict(list), defaultdict(list)
    for group, strings in ((known, words), (asked, probes)):
        for x in strings:
            group[len(x)].append(x)
    for length, ws in known.items():
        trie = Trie(ws)
        for n in range(length - most, length + most + 1):
            if n in asked:
                yield from trie.near(asked[n], most)


def _shards(index: DataFrame, probes: DataFrame, shard_words: int, shard_probes: int) -> DataFrame:
    """(kind, way, letter, wp, pp, word, most, probe): the words and the probes of every part of every shard of :func:`trie_join`."""
    ends = lambda c: F.explode(F.array(
        F.struct(F.lit("f").alias("way"), F.substring(c, 1, 1).alias("letter")),
        F.struct(F.lit("r").alias("way"), F.substring(c, -1, 1).alias("letter")))).alias("end")
    words = index.where(F.length("word") > 0).select("kind", "word", "most", ends("word")).select("kind", "word", "most", "end.way", "end.letter")
    asked = probes.where(F.length("probe") > 0).select("kind", "probe", ends("probe")).select("kind", "probe", "end.way", "end.letter")
    shard = ["kind", "way", "letter"]
    sizes = words.groupBy(*shard).agg(F.count(F.lit(1)).alias("words")).join(asked.groupBy(*shard).agg(F.count(F.lit(1)).alias("probes")), shard).select(
        *shard, F.ceil(F.col("words") / shard_words).cast("int").alias("word_parts"),
        F.ceil(F.col("probes") / F.greatest(F.lit(shard_probes), F.least("words", F.lit(shard_words)) / 2)).cast("int").alias("probe_parts"))
    parts = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    words = words.join(sizes, shard).withColumn("wp", F.pmod(F.xxhash64("word"), F.col("word_parts")).cast("int")).withColumn("pp", parts("probe_parts"))
    asked = asked.join(sizes, shard).withColumn("pp", F.pmod(F.xxhash64("probe"), F.col("probe_parts")).cast("int")).withColumn("wp", parts("word_parts"))
    return words.select(*shard, "wp", "pp", "word", "most", F.lit(None).cast("string").alias("probe")).unionByName(
        asked.select(*shard, "wp", "pp", F.lit(None).cast("string").alias("word"), F.lit(None).cast("int").alias("most"), "probe"))


def trie_join(index: DataFrame, probes: DataFrame, shard_words: int = 200_000, shard_probes: int = 4_000) -> DataFrame:
    """(probe, word) of all words of ``index`` within ``most`` edits of a probe of the same ``kind``.

    ``index`` has columns kind, word, most (0, 1 or 2 edits allowed against the word); ``probes`` has kind, probe.  No
    nulls, both distinct.  Exact: two edits leave the first letter or the last untouched, with at most one edit in the
    half on that side, or else they touch the first and the last letter and leave the middle whole.  Tries are sharded by
    that letter and direction; shards of more than ``shard_words`` words are split by hash and probed in parts.  The probes
    of a letter are split, too, where they are more than ``shard_probes``, but a part has half as many probes as there are
    words, so that the copies of the words never outgrow the probes.
    """
    spark = index.sparkSession
    shard = ["kind", "way", "letter"]
    both = _shards(index, probes, shard_words, shard_probes)
    # Work does not follow bytes here: keep the shards apart rather than let small partitions be joined.
    both = both.repartition(4 * spark.sparkContext.defaultParallelism, *shard, "wp", "pp")

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        known = pdf[pdf["word"].notna()]
        asked = pdf["probe"].dropna().tolist()
        back = pdf["way"].iloc[0] == "r"
        turn = (lambda x: x[::-1]) if back else (lambda x: x)
        asked = [turn(q) for q in asked]
        pairs = [p for m, g in known.groupby("most")["word"] for p in near_pairs(map(turn, g), asked, int(m))]
        return pd.DataFrame({"probe": [turn(p[0]) for p in pairs], "word": [turn(p[1]) for p in pairs]}, dtype=object)

    grouped = both.groupBy(*shard, "wp", "pp").applyInPandas(
        lambda key, pdf: search(pdf).assign(kind=key[0])[["kind", "probe", "word"]], "kind string, probe string, word string")
    # Edits at the first and at the last letter: the middle of the word stands whole in the probe.
    middle = index.where((F.col("most") == 2) & (F.length("word") >= 7)).select("kind", "word", F.expr("substring(word, 3, length(word) - 4)").alias("middle"))
    cuts = [
        F.struct(F.expr(f"substring(probe, {3 + i}, length(probe) - {4 + i + j})").alias("middle"))
        for i in (-1, 0, 1) for j in (-1, 0, 1)
    ]
    around = (
        probes.where(F.length("probe") >= 5).select("kind", "probe", F.explode(F.array_distinct(F.array(*cuts))).alias("cut"))
        .select("kind", "probe", "cut.middle").join(middle, ["kind", "middle"])
        .where(F.abs(F.length("probe") - F.length("word")) <= 2).select("kind", "probe", "word")
    )

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([distance(q, w, 2) <= 2 for q, w in zip(b.column(1).to_pylist(), b.column(2).to_pylist())], pa.bool_()))

    around = around.mapInArrow(near, around.schema)
    return grouped.unionByName(around).distinct()


# ---- on the tables of this project ---------------------------------------------------------------------------------


def _words_of(forms: DataFrame) -> DataFrame:
    """(form, words, joined) of every spelling."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = [Name(f) for f in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([n.words for n in names], pa.list_(pa.string())), pa.array([n.joined for n in names], pa.string())],
                names=["form", "words", "joined"])

    return forms.select("form").mapInArrow(run, "form string, words array<string>, joined string")


def match_spellings(forms: DataFrame, rare: int = 3, max_cost: float = 3.0) -> DataFrame:
    """(form, known, cost): typed or known spellings and the other known spellings they can stand for.

    ``forms`` has distinct rows (form, known): a spelling (see :func:`spelling`) and whether it is a known entity's.
    Words of a known spelling that at most ``rare`` known spellings share are its telling words; where it has none, its
    two rarest words are, and both must be there (a name of one word has only that).  So a word leads to few known
    spellings, however frequent it is, and no word makes all pairs of the names that hold it.  Names written together or
    apart are found within one edit of the whole, or within two where a telling word leads to them.  Spellings without a
    letter or digit match nothing.
    """
    words = materialize(_words_of(spread(forms)).join(forms, "form"), "words")
    tokens = words.where("known").select("form", F.explode(F.array_distinct("words")).alias("word"))
    df = tokens.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    # Given names tell nobody apart, however few known spellings hold them.
    given = F.col("word").isin(*SHORT_FORMS, *FULL_FORM)
    ranked = tokens.join(df, "word").withColumn("given", given).withColumn(
        "rank", F.row_number().over(Window.partitionBy("form").orderBy("given", "df", "word")))
    telling = (
        ranked.groupBy("form").agg(
            F.collect_list(F.when(~F.col("given") & (F.col("df") <= rare), F.col("word"))).alias("few"),
            F.collect_list(F.when(F.col("rank") <= 2, F.col("word"))).alias("rarest"))
        .select("form", (F.size("few") == 0).alias("joint"), F.array_sort(F.when(F.size("few") == 0, F.col("rarest")).otherwise(F.col("few"))).alias("telling"))
    )
    telling = materialize(telling, "telling")
    single = telling.where(~F.col("joint") | (F.size("telling") < 2)).select(F.col("form").alias("other"), F.explode("telling").alias("word"))
    double = telling.where(F.col("joint") & (F.size("telling") == 2)).select(
        F.col("form").alias("other"), F.col("telling")[0].alias("word"), F.col("telling")[1].alias("second"))
    keys = telling.select(F.explode("telling").alias("word")).distinct()
    allowed = F.when(F.length("word") >= 7, 2).when(F.length("word") >= 4, 1).otherwise(0)
    joined = words.where("known").select("joined").distinct()
    index = keys.select(F.lit("word").alias("kind"), "word", allowed.alias("most")).unionByName(
        joined.select(F.lit("name").alias("kind"), F.col("joined").alias("word"), F.lit(1).alias("most")))
    common = df.join(keys, "word", "left_anti").select("word")
    probes = (
        words.select(F.explode("words").alias("word")).distinct().join(common, "word", "left_anti")
        .where((F.length("word") >= 2)).select(F.lit("word").alias("kind"), F.col("word").alias("probe"))
        .unionByName(words.select(F.lit("name").alias("kind"), F.col("joined").alias("probe")).distinct())
    )
    near = materialize(trie_join(index, probes), "near")
    holds = (
        words.select("form", F.explode(F.array_distinct("words")).alias("probe"))
        .join(near.where("kind = 'word'").select("probe", "word"), "probe").select("form", "word")
    )
    both = (
        holds.join(double.select("word").union(double.select("second")).distinct(), "word", "left_semi")
        .groupBy("form").agg(F.array_sort(F.collect_set("word")).alias("xs")).where(F.size("xs") > 1)
        .select("form", "xs", F.posexplode("xs").alias("pos", "word"))
        .select("form", "word", F.explode(F.slice("xs", F.col("pos") + 2, F.size("xs"))).alias("second"))
    )
    by_word = holds.join(single, "word").select("form", "other").unionByName(both.join(double, ["word", "second"]).select("form", "other"))
    by_name = (
        near.where("kind = 'name'").select("probe", "word")
        .join(words.where("known").select(F.col("form").alias("other"), F.col("joined").alias("word")), "word")
        .join(words.select("form", F.col("joined").alias("probe")), "probe").select("form", "other")
    )
    candidates = (
        by_word.unionByName(by_name).where(F.col("form") != F.col("other")).distinct()
        .join(telling.select(F.col("form").alias("other"), "telling"), "other").select("form", "other", "telling")
    )

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parsed: dict[str, Name] = {}

        def name(f: str) -> Name:
            if f not in parsed:
                if len(parsed) > 50_000:
                    parsed.clear()
                parsed[f] = Name(f)
            return parsed[f]

        for b in batches:
            out = []
            for f, o, t in zip(*(c.to_pylist() for c in b.columns)):
                cost = name_cost(name(f), name(o), frozenset(t))
                if cost is not None and cost <= max_cost:
                    out.append((f, o, cost))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.string()), pa.array([x[2] for x in out], pa.float64())],
                names=["form", "known", "cost"])

    return candidates.mapInArrow(weigh, "form string, known string, cost double")


def same_artists(playlists: DataFrame, nodes: DataFrame, twin_cost: float = 3.0) -> DataFrame:
    """(id_a, id_b), id_a < id_b: nodes and typed credits (``name_`` ids), and nodes and nodes, of one artist spelt differently.

    A typed credit stands for the known spelling of least cost; if several artists tie, for none.  Two nodes are one
    artist if their labels stand for each other, but not if both are spellings under which channels of their own are
    credited: those are two artists, however alike their names.  A credit is compared with every node of its artist.  Null and blank names match
    nothing, repeated rows count once.
    """
    credit = playlists.select(F.explode("tracks").alias("t")).select(F.col("t.artist_id").alias("id"), F.col("t.artist_name").alias("name"))
    named = F.col("name").isNotNull() & (F.trim("name") != "") & F.col("id").isNotNull()
    typed = credit.where(F.col("id").startswith("name_") & named).distinct().groupBy("id").agg(F.min("name").alias("name"))
    official = credit.where(F.col("id").startswith("yt_") & named).select("name").distinct().select(F.lit(None).cast("string").alias("id"), "name")
    labels = nodes.select("id", F.col("label").alias("name")).where(named).distinct()
    every = typed.select(F.lit("typed").alias("role"), "id", "name").unionByName(official.select(F.lit("official").alias("role"), "id", "name")).unionByName(
        labels.select(F.lit("node").alias("role"), "id", "name"))
    form_of = F.pandas_udf(lambda s: s.map(spelling), "string")
    every = materialize(every.withColumn("form", form_of("name")).where("form != ''").drop("name"), "names")
    role = lambda r: F.max(F.col("role") == r).alias(r)
    forms = materialize(every.groupBy("form").agg(role("node"), role("typed"), role("official")), "forms")
    hits = match_spellings(forms.where("node or typed").select("form", F.col("node").alias("known")))
    flags = forms.select("form", F.col("node").alias("form_known"), F.col("official").alias("form_own"))
    hits = materialize(hits.join(flags, "form").join(forms.select(F.col("form").alias("known"), F.col("official").alias("known_own")), "known"), "hits")
    # Two names under which channels of their own are credited are two artists.  One direction suffices: an abbreviation
    # stands for its full form, not the other way round.
    twin = _least(hits.where(F.col("form_known") & (F.col("cost") <= twin_cost) & ~(F.col("form_own") & F.col("known_own"))))
    twin_pairs = materialize(twin.select("form", "known").unionByName(twin.select(F.col("known").alias("form"), F.col("form").alias("known"))).distinct(), "twins")
    best = materialize(_least(hits.where("not form_known")), "best")
    first = best.groupBy("form").agg(F.min("known").alias("first"), F.count(F.lit(1)).alias("n"))
    # A tie is none if the tied spellings are twins of one another.
    apart = (
        best.join(first.where("n > 1"), "form").where("known != first")
        .join(twin_pairs.toDF("first", "known"), ["first", "known"], "left_anti").select("form").distinct()
    )
    stands = best.join(apart, "form", "left_anti").select("form", "known").unionByName(forms.where("node").select("form", F.col("form").alias("known")))
    artist = stands.unionByName(stands.join(twin_pairs.toDF("known", "twin"), "known").select("form", F.col("twin").alias("known"))).distinct()
    node = every.where("role = 'node'").select(F.col("id").alias("node"), "form").distinct()
    credits_ = every.where("role = 'typed'").select(F.col("id").alias("credit"), "form")
    credit_pairs = (
        credits_.join(artist, "form").where(F.col("form") != F.col("known"))
        .join(node.toDF("node", "known"), "known").select(F.col("node").alias("a"), F.col("credit").alias("b"))
    )
    node_pairs = (
        node.toDF("a", "form").join(twin_pairs, "form").join(node.toDF("b", "known"), "known").where(F.col("a") != F.col("b")).select("a", "b")
    )
    return credit_pairs.unionByName(node_pairs).select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b")).distinct()


def _least(hits: DataFrame) -> DataFrame:
    """The rows of least cost of each form (equal within rounding)."""
    low = hits.select("form", "cost").groupBy("form").agg(F.min("cost").alias("low"))
    return hits.select("form", "known", "cost").join(low, "form").where(F.col("cost") <= F.col("low") + 1e-9).select("form", "known", "cost")
