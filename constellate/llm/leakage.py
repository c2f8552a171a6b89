"""Evaluation texts leaking into training text.

The test items, normalised to words, form generalised suffix automata, one for each block of items of bounded size.  Every
training text is streamed through a block's automaton word by word; the automaton keeps the longest suffix of the words
read that occurs in some item.  Wherever that match has at least ``min_words`` words, the items that hold its last
``min_words`` words are reported, and the matched spans can be removed from the text.

Blocks are taken one at a time: a block's texts are broadcast, each Python worker builds the automaton from them and holds
no other one, and the broadcast goes before the next pass.  Memory depends on ``block_bytes`` alone, not on the items.
"""

from __future__ import annotations

import unicodedata as ud
import uuid
from array import array
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from constellate.llm.bpe import spread
from constellate.llm.lookalike import one_script, unseen, without_unseen
from constellate.session import materialize

_WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")
_ASCII_WORD = regex.compile(r"[a-z0-9]+")


def words(text: str) -> list[str]:
    """Unbroken runs of letters and digits, without regard to case and character forms."""
    if text.isascii():
        return _ASCII_WORD.findall(text.lower())
    text = ud.normalize("NFKC", without_unseen(text))
    return [one_script(w).casefold() for w in _WORD.findall(text)]


def word_spans(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    """The same words with their spans in ``text`` as stored."""
    shown, at = [], []
    for i, c in enumerate(text):
        if unseen(c):
            continue
        for f in ud.normalize("NFKC", c):
            shown.append(f)
            at.append(i)
    flat = "".join(shown)
    found = list(_WORD.finditer(flat))
    return ([one_script(ud.normalize("NFKC", m.group())).casefold() for m in found], [(at[m.start()], at[m.end() - 1] + 1) for m in found])


class SuffixAutomaton:
    """Generalised suffix automaton over word ids, in arrays.

    Nearly all states have one way on, which two arrays hold; the others have a table each.  The items that hold a state's
    words are those of the states below it in the tree of suffix links, which lie side by side in a tour of that tree.
    """

    def __init__(self, items: list[tuple[object, list[str]]], min_words: int) -> None:
        self.min_words = min_words
        self.names = [i for i, _ in items]
        self.word_ids: dict[str, int] = {}
        self.word, self.to = array("i", [-1]), array("i", [-1])  # the only way on of a state
        self.more: dict[int, dict[int, int]] = {}  # all ways on of states with several
        self.link, self.length = array("i", [-1]), array("i", [0])
        ends: list[tuple[int, int]] = []
        for n, (_, ws) in enumerate(items):
            last = 0
            for w in ws:
                last = self._extend(last, self.word_ids.setdefault(w, len(self.word_ids)))
                if self.length[last] >= min_words:
                    ends.append((last, n))
        self._tour(ends)

    def _next(self, state: int, w: int) -> int:
        if self.word[state] == w:
            return self.to[state]
        ways = self.more.get(state)
        return -1 if ways is None else ways.get(w, -1)

    def _set(self, state: int, w: int, to: int) -> None:
        if state in self.more:
            self.more[state][w] = to
        elif self.word[state] in (-1, w):
            self.word[state], self.to[state] = w, to
        else:
            self.more[state] = {self.word[state]: self.to[state], w: to}
            self.word[state] = -2

    def _state(self, length: int) -> int:
        self.word.append(-1)
        self.to.append(-1)
        self.length.append(length)
        self.link.append(-1)
        return len(self.length) - 1

    def _extend(self, last: int, w: int) -> int:
        q = self._next(last, w)
        if q >= 0:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, w)
        new = self._state(self.length[last] + 1)
        p = last
        while p >= 0 and (q := self._next(p, w)) < 0:
            self._set(p, w, new)
            p = self.link[p]
        self.link[new] = 0 if p < 0 else q if self.length[q] == self.length[p] + 1 else self._split(p, q, w)
        return new

    def _split(self, p: int, q: int, w: int) -> int:
        clone = self._state(self.length[p] + 1)
        self.word[clone], self.to[clone] = self.word[q], self.to[q]
        if q in self.more:
            self.more[clone] = dict(self.more[q])
        self.link[clone] = self.link[q]
        self.link[q] = clone
        while p >= 0 and self._next(p, w) == q:
            self._set(p, w, clone)
            p = self.link[p]
        return clone

    def _tour(self, ends: list[tuple[int, int]]) -> None:
        """Puts the items' ends in the order of a tour of the link tree; ``low`` and ``high`` bound those below a state."""
        n = len(self.length)
        count = array("i", bytes(4 * n))
        for state, _ in ends:
            count[state] += 1
        total = array("i", count)
        order = sorted(range(1, n), key=self.length.__getitem__, reverse=True)
        for v in order:  # longest first: children before parents
            total[self.link[v]] += total[v]
        self.low, self.high = array("i", bytes(4 * n)), array("i", bytes(4 * n))
        free = array("i", bytes(4 * n))  # where the next child's part of a state begins
        self.high[0], free[0] = total[0], count[0]
        for v in reversed(order):
            p = self.link[v]
            self.low[v] = free[p]
            free[p] += total[v]
            self.high[v], free[v] = self.low[v] + total[v], self.low[v] + count[v]
        self.held = array("i", bytes(4 * len(ends)))
        at = array("i", self.low)
        for state, item in ends:
            self.held[at[state]] = item
            at[state] += 1

    def scan(self, ws: list[str]) -> Iterator[tuple[int, int, int]]:
        """(position after the match, length, state) wherever the longest match has ``min_words`` words or more."""
        state = length = 0
        step, link, lengths, ids, least = self._next, self.link, self.length, self.word_ids, self.min_words
        for k, word in enumerate(ws, 1):
            w = ids.get(word)
            if w is None:
                state = length = 0
                continue
            while (to := step(state, w)) < 0 and state:
                state = link[state]
                length = lengths[state]
            if to < 0:
                length = 0
                continue
            state = to
            length += 1
            if length >= least:
                yield k, length, state

    def holders(self, state: int, length: int) -> dict:
        """item -> words of the match that it holds in a row at its end, for every item holding ``min_words`` of them."""
        out: dict[int, int] = {}
        while state > 0 and length >= self.min_words:
            for i in self.held[self.low[state] : self.high[state]]:
                out.setdefault(i, length)
            state = self.link[state]
            length = self.length[state]
        return {self.names[i]: n for i, n in out.items()}


def blocks(items: DataFrame, key: str, text: str, block_bytes: int = 1_000_000) -> tuple[DataFrame, int]:
    """(key, text, block) of the items with a key and a text, and the number of blocks, each of about ``block_bytes``.

    One item alone may have more: it is a block's only large one, as it must be held whole to be matched.
    """
    known = items.select(F.col(key).alias("key"), F.col(text).alias("text")).where("key is not null and text is not null").distinct()
    size = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    return known.withColumn("block", F.pmod(F.xxhash64("key", "text"), F.lit(n)).cast("int")), n


_BUILT: dict = {}


def _automaton(block: _Block, min_words: int) -> SuffixAutomaton:
    """The automaton of a broadcast block, built once in each worker, which holds no other one."""
    at = (block.name, min_words)
    if at not in _BUILT:
        _BUILT.clear()
        _BUILT[at] = SuffixAutomaton([x for x in ((k, words(t)) for k, t in block.sent.value) if len(x[1]) >= min_words], min_words)
    return _BUILT[at]


class _Block:
    """A broadcast block under a name of its own, by which a worker knows the automaton that it has built."""

    def __init__(self, spark: SparkSession, rows: list) -> None:
        self.sent, self.name = spark.sparkContext.broadcast(rows), uuid.uuid4().hex


def _passes(items: DataFrame, key: str, text: str, block_bytes: int) -> Iterator[tuple[_Block, bool]]:
    """The blocks, one broadcast at a time, and whether it is the only one; a block is dropped when the next is asked for."""
    held, n = blocks(items, key, text, block_bytes)
    held = materialize(held, "items", partition_by=["block"]) if n > 1 else held
    for k in range(n):
        rows = [(r["key"], r["text"]) for r in held.where(F.col("block") == k).collect()]  # about block_bytes
        block = _Block(items.sparkSession, rows)
        yield block, n == 1
        if n > 1:
            block.sent.unpersist()


def leaks(
    documents: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, min_words: int = 12, block_bytes: int = 1_000_000,
) -> DataFrame:
    """(key, item_key, words): every document that holds at least ``min_words`` words of an item in a row, and the longest run.

    Words are runs of letters and digits; case, signs, blanks and character forms make no difference.  Null and empty
    texts have no row, items shorter than ``min_words`` are never found, repeated texts are each reported under their
    own key, rows with null keys are left out.  The documents are streamed through the items block by block.
    """
    key_type, item_type = documents.schema[key].dataType, items.schema[item_key].dataType
    schema = T.StructType([T.StructField(key, key_type), T.StructField(item_key, item_type), T.StructField("words", T.IntegerType())])

    def streamed(block: _Block) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = _automaton(block, min_words)
            for b in batches:
                keys, found_items, lengths = [], [], []
                for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    if not t or k is None:
                        continue
                    best: dict = {}
                    for _, length, state in automaton.scan(words(t)):
                        for i, n in automaton.holders(state, length).items():
                            if best.get(i, 0) < n:
                                best[i] = n
                    keys += [k] * len(best)
                    found_items += best
                    lengths += best.values()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, b.column(0).type), pa.array(found_items, _arrow(item_type)), pa.array(lengths, pa.int32())],
                    names=[key, item_key, "words"])

        return spread(documents.select(key, text)).mapInArrow(run, schema)

    found = None
    for block, alone in _passes(items, item_key, item_text, block_bytes):
        one = streamed(block) if alone else materialize(streamed(block), "leaks")
        found = one if found is None else found.unionByName(one)
    return found.groupBy(key, item_key).agg(F.max("words").alias("words"))


def _arrow(t: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(t)


def without_leaks(
    documents: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str,
    min_words: int = 12, max_coverage: float = 0.5, block_bytes: int = 1_000_000,
) -> DataFrame:
    """(key, text, leaked_words, dropped): every document with its leaked spans cut out.

    Spans of at least ``min_words`` words in a row of an item are removed; a document of whose words more than
    ``max_coverage`` are leaked is dropped whole: its text is null and ``dropped`` true.  Null and empty texts stay, and
    so do rows with null or repeated keys.  Spans are gathered block by block and cut at the end.
    """
    key_type = documents.schema[key].dataType
    spans = T.StructType([T.StructField(key, key_type), T.StructField(text, T.StringType()), T.StructField("spans", T.ArrayType(T.IntegerType()))])
    schema = T.StructType([
        T.StructField(key, key_type), T.StructField(text, T.StringType()), T.StructField("leaked_words", T.IntegerType()), T.StructField("dropped", T.BooleanType())])

    def gathered(df: DataFrame, block: _Block) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = _automaton(block, min_words)
            for b in batches:
                out = []
                for t, had in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                    if t and any(True for _ in automaton.scan(words(t))):
                        had = had + [x for k, length, _ in automaton.scan(word_spans(t)[0]) for x in (k - length, k)]
                    out.append(had)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.list_(pa.int32()))], names=[key, text, "spans"])

        return df.mapInArrow(run, spans)

    def cut(t: str | None, found: list[int]) -> tuple[str | None, int, bool]:
        if not found:
            return t, 0, False
        _, at_text = word_spans(t)
        leaked = bytearray(len(at_text))
        for a, b in zip(found[::2], found[1::2]):
            leaked[a:b] = b"\1" * (b - a)
        n = sum(leaked)
        if n > max_coverage * len(at_text):
            return None, n, True
        out, at = [], 0
        for i, (a, b) in enumerate(at_text):
            if leaked[i]:
                out.append(t[at:a] if not (i and leaked[i - 1]) else "")
                at = b
        return "".join(out) + t[at:], n, False

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [cut(t, found) for t, found in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int32()), pa.array([d[2] for d in done], pa.bool_())],
                names=[key, text, "leaked_words", "dropped"])

    state = spread(documents.select(key, text)).withColumn("spans", F.array().cast("array<int>"))
    for block, alone in _passes(items, item_key, item_text, block_bytes):
        state = gathered(state, block) if alone else materialize(gathered(state, block), "spans")
    return state.mapInArrow(clean, schema)
