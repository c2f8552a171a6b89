"""Subject areas of documents: weighted subject terms, matched by a multi-pattern automaton, sentence by sentence.

The lexicon starts from examples labelled by hand and is then curated on the whole corpus: a one- or two-word term
belongs to a subject if the documents that hold it deal with that subject much more than with all others.  A few rounds
carry the lexicon to words that no example uses.  A term's weight grows with how pure it is and, as the logarithm of the
documents to one that holds it, how rare.  A sentence deals with every subject whose weight per square root of its length
exceeds that subject's threshold, found at the valley of its own corpus histogram; a document has every subject that at
least ``share`` of its sentences deal with.
"""

from __future__ import annotations

import math
import re
import unicodedata as ud
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from constellate.llm.bpe import spread
from constellate.llm.lookalike import one_script, without_unseen
from constellate.session import materialize

_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
_ASCII_WORD = re.compile("[a-z]+")
_FENCE = regex.compile(r"```.*?(?:```|\Z)", regex.S)
_URL = regex.compile(r"\b(?:https?://|www\.)\S+")
_ENTITY = regex.compile(r"&(?:amp;)*#?\w{1,8};|<[^<>\n]{0,40}>")
_LINE = re.compile(r"[\r\n\x0b\x0c\x85\u2028\u2029]+")
_END = re.compile(r"(?<=[.!…])[\"'»”’)*_]*\s+")
_QUESTION = re.compile(r"(?<=\?)[\"'»”’)*_]*\s+")
_STOPPED = regex.compile(r"[.!?…:;][\"'»”’)*_\s]*$|[.!?…][^\p{L}\p{N}]*$")
#: No sentence is longer: a longer run of words is text whose stops are missing, cut into pieces of a usual length.
LONGEST, USUAL = 40, 11


def _clean(text: str) -> str:
    if not text.isascii():
        text = ud.normalize("NFKC", without_unseen(text))
    text = _FENCE.sub("\n", text) if "```" in text else text
    text = _URL.sub(" ", text) if "http" in text or "www." in text else text
    return _ENTITY.sub(" ", text) if "&" in text or "<" in text else text


def words(sentence: str) -> list[str]:
    if sentence.isascii():
        return _ASCII_WORD.findall(sentence.lower())
    return [one_script(w).casefold() for w in _WORD.findall(sentence)]


def sentences(text: str) -> list[list[str]]:
    """Words of each sentence.  Headings, log blocks and links are none, and a question and its short answer are one.

    A line without a stop is a heading if the text's other lines have stops; where none has, every line is a sentence.
    """
    lines = [x for x in _LINE.split(_clean(text)) if x.strip()]
    stopped = [bool(_STOPPED.search(x)) for x in lines]
    skip_open = any(stopped)
    if skip_open and not all(stopped):  # line breaks inside sentences
        joined: list[str] = []
        for line in lines:
            first = line.lstrip()[0]
            if joined and not _STOPPED.search(joined[-1]) and (first.islower() or first.isdigit()):
                joined[-1] += " " + line
            else:
                joined.append(line)
        lines, stopped = joined, [bool(_STOPPED.search(x)) for x in joined]
    out: list[list[str]] = []
    for line, full in zip(lines, stopped):
        parts: list[list[str]] = []
        for part in _END.split(line):
            answer = False
            for piece in _QUESTION.split(part) if "?" in part else (part,):
                ws = words(piece)
                if not ws:
                    continue
                if answer and len(ws) <= 8:
                    parts[-1] += ws
                else:
                    parts.append(ws)
                answer = True
        if not full and skip_open and parts and len(parts[-1]) <= 8 and len(parts) == 1:
            continue
        if not full and len(parts) == 1 and len(parts[0]) > LONGEST // 2 and "  " in line.strip():
            parts = [ws for ws in map(words, line.split("  ")) if ws]
        out += parts
    return out


def terms(ws: list[str]) -> set[str]:
    """One- and two-word terms of a sentence."""
    return {*ws, *(f"{a} {b}" for a, b in zip(ws, ws[1:]))}


def _distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


class Lexicon:
    """Subject terms with weights; compiled once per worker into an Aho-Corasick automaton."""

    def __init__(self, subjects: list[str], entries: dict[str, tuple[int, float]], threshold: float | list[float], openers: frozenset[str] = frozenset()) -> None:
        self.subjects, self.entries, self.openers = subjects, entries, openers
        self.thresholds = threshold if isinstance(threshold, list) else [threshold] * len(subjects)
        self._compiled = None

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_compiled"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._compiled = None

    def compiled(self):
        """The automaton over the terms, and subject and weight of each."""
        if self._compiled is None:
            import ahocorasick

            a = ahocorasick.Automaton(ahocorasick.STORE_INTS)
            for i, term in enumerate(self.entries):
                a.add_word(f" {term} ", i)
            a.make_automaton()
            self._compiled = a, np.array([s for s, _ in self.entries.values()], np.int64), np.array([w for _, w in self.entries.values()])
        return self._compiled

    def scores(self, lines: list[str], chunk: int = 4_000_000) -> np.ndarray:
        """Weight of every subject (columns) in every sentence of blank-delimited words, each distinct term of a sentence
        once, per square root of the sentence's words (four at least)."""
        k = len(self.subjects)
        out = np.zeros((len(lines), k))
        if not self.entries or not lines:
            return out
        automaton, subject, weight = self.compiled()
        starts = np.concatenate([[0], np.cumsum(np.fromiter(map(len, lines), np.int64, len(lines)) + 3)])
        at = 0
        while at < len(lines):
            end = max(at + 1, int(np.searchsorted(starts, starts[at] + chunk)))
            hits = list(automaton.iter(f" {' \n '.join(lines[at:end])} "))
            if hits:
                place, term = np.array(hits, np.int64).T
                sentence = np.searchsorted(starts, place + starts[at], "right") - 1
                sentence, term = np.divmod(_distinct(sentence * len(weight) + term), len(weight))
                out += np.bincount(sentence * k + subject[term], weight[term], len(lines) * k).reshape(-1, k)
            at = end
        length = np.fromiter((x.count(" ") + 1 for x in lines), np.int64, len(lines))
        return out / np.sqrt(np.maximum(length, 4))[:, None]

    def dealt(self, lines: list[str]) -> np.ndarray:
        """Whether every sentence deals with every subject: its weight reaches the subject's threshold."""
        return self.scores(lines) >= np.array(self.thresholds)

    def split(self, lines: list[str]) -> Iterator[str]:
        """Sentences of at most ``LONGEST`` words: where stops are missing, cut before the words that elsewhere mostly open
        a sentence, and what is still longer into even pieces of about ``USUAL`` words."""
        for line in lines:
            if line.count(" ") < LONGEST // 2:
                yield line
                continue
            ws = line.split(" ")
            cuts = [0]
            for i in range(3, len(ws) - 2):
                if i - cuts[-1] >= 3 and (ws[i] in self.openers or f"{ws[i]} {ws[i + 1]}" in self.openers):
                    cuts.append(i)
            for at, end in zip(cuts, [*cuts[1:], len(ws)]):
                n = end - at
                pieces = round(n / USUAL) if n > LONGEST else 1
                for k in range(pieces):
                    yield " ".join(ws[at + n * k // pieces : at + n * (k + 1) // pieces])

    def counts(self, documents: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Of every document the sentences by subject (columns), and all sentences."""
        lines = [list(self.split(d)) for d in documents]
        n = np.fromiter(map(len, lines), np.int64, len(lines))
        at, subject = np.nonzero(self.dealt([x for d in lines for x in d]))
        doc, k = np.repeat(np.arange(len(lines)), n), len(self.subjects)
        return np.bincount(doc[at] * k + subject, minlength=len(lines) * k).reshape(-1, k), n


def _rare(held: dict[str, int], documents: int) -> dict[str, float]:
    """Rarity of terms held by so many of ``documents``: the logarithm of documents to one that holds it, 1 on average of holders."""
    raw = {t: math.log(1 + documents / n) for t, n in held.items()}
    mean = sum(raw[t] * n for t, n in held.items()) / max(1, sum(held.values()))
    return {t: x / mean for t, x in raw.items()}


def _seed(subjects: list[str], rows: Iterable[tuple[str | None, str | None]], pure: float = 0.7) -> dict[str, tuple[int, float]]:
    """Terms of the labelled examples that occur at least twice and nearly only under one subject."""
    index = {s: i for i, s in enumerate(subjects)}
    seen: dict[str, Counter] = defaultdict(Counter)
    count = 0
    for subject, text in rows:
        if subject in index and text:
            count += 1
            for t in set().union(*map(terms, sentences(text))) if text else ():
                seen[t][index[subject]] += 1
    out = {}
    for t, by in seen.items():
        n = sum(by.values())
        s, k = min(by.items(), key=lambda x: (-x[1], x[0]))
        p = (k + 0.1) / (n + 0.9)
        if n >= 2 and p >= pure:
            out[t] = (s, p)
    rare = _rare({t: sum(seen[t].values()) for t in out}, count)
    return {t: (s, p * rare[t]) for t, (s, p) in out.items()}


def tokenised(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(key, sentences): the words of each sentence, blank-delimited; parsed and written once for all passes."""
    schema = T.StructType([T.StructField(key, documents.schema[key].dataType), T.StructField("sentences", T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [[" ".join(ws) for ws in sentences(t)] if t else [] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.list_(pa.string()))], names=[key, "sentences"])

    return materialize(spread(documents.select(key, text)).mapInArrow(run, schema), "sentences")


class _Coded:
    """Documents as arrays: the terms of every sentence as numbers that stand for words, or pairs of words, of this slice."""

    def __init__(self, column: pa.Array) -> None:
        self.lines = lines = column.flatten()
        per_doc = pc.list_value_length(column).to_numpy(zero_copy_only=False)
        self.documents = len(column)
        self.doc_of = np.repeat(np.arange(len(column)), per_doc)  # of a sentence
        words_ = pc.split_pattern(lines, " ")
        self.length = pc.list_value_length(words_).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = words_.flatten().dictionary_encode()
        self.words = coded.dictionary
        self.size = len(self.words)
        code = coded.indices.to_numpy().astype(np.int64)
        sentence = np.repeat(np.arange(len(lines)), self.length)
        same = sentence[:-1] == sentence[1:]
        self.term = np.concatenate([code, self.pair(code[:-1][same], code[1:][same])])
        self.sentence = np.concatenate([sentence, sentence[:-1][same]])
        first = np.ones(len(code), bool)
        first[1:] = ~same
        self.opens = np.concatenate([first, first[:-1][same]])

    def pair(self, a, b):
        return self.size + a * self.size + b

    def strings(self, term: np.ndarray) -> pa.Array:
        single = term < self.size
        a, b = np.divmod(term[~single] - self.size, self.size)
        pairs = pc.binary_join_element_wise(self.words.take(pa.array(a)), self.words.take(pa.array(b)), " ")
        out = pa.concat_arrays([self.words.take(pa.array(term[single])), pairs.cast(self.words.type)])
        back = np.empty(len(term), np.int64)
        back[np.concatenate([np.flatnonzero(single), np.flatnonzero(~single)])] = np.arange(len(term))
        return out.take(pa.array(back))


def _slices(batches: Iterator[pa.RecordBatch], most: int = 4_000_000) -> Iterator[_Coded]:
    """The sentences of whole documents in slices of about ``most`` bytes (one document alone may have more)."""
    for b in batches:
        column = b.column(b.num_columns - 1)
        per_doc = pc.list_value_length(column).to_numpy(zero_copy_only=False)
        size = np.concatenate([[0], np.cumsum(pc.binary_length(column.flatten()).to_numpy(zero_copy_only=False))])
        part = size[np.cumsum(per_doc)] // most if len(per_doc) else np.zeros(0)
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(column)]
        for x, y in zip(cuts[:-1], cuts[1:]):
            if y > x:
                yield _Coded(column.slice(x, y - x))


def _openers(parsed: DataFrame, least: int = 8, mostly: float = 0.85, one_in: int = 50_000) -> frozenset[str]:
    """Words and pairs of words that mostly stand at the beginning of a sentence.

    One opens at least ``least`` sentences and at least one in ``one_in`` of all of them, so there are fewer than twice
    ``one_in``, whatever the corpus.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in _slices(batches):
            marked = np.sort(c.term * 2 + c.opens)
            if not len(marked):
                continue
            starts = np.flatnonzero(np.concatenate([[True], marked[1:] // 2 != marked[:-1] // 2]))
            n = np.diff(np.concatenate([starts, [len(marked)]]))
            yield pa.RecordBatch.from_arrays(
                [c.strings(marked[starts] // 2), pa.array(np.add.reduceat(marked % 2, starts)), pa.array(n)], names=["term", "opens", "n"])

    all_ = parsed.agg(F.sum(F.size("sentences"))).first()[0] or 0
    sums = parsed.select("sentences").mapInArrow(run, "term string, opens bigint, n bigint").groupBy("term").agg(F.sum("opens").alias("opens"), F.sum("n").alias("n"))
    kept = sums.where((F.col("opens") >= max(least, all_ / one_in)) & (F.col("opens") >= F.col("n") * mostly))
    return frozenset(r["term"] for r in kept.select("term").collect())


def _round(parsed: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(term, n, by): over all documents with two or more sentences of known subject, documents holding the term, and the
    sum of those documents' subject shares."""
    model = parsed.sparkSession.sparkContext.broadcast(lexicon)
    k = len(lexicon.subjects)
    schema = "term string, n bigint, " + ", ".join(f"s{i} double" for i in range(k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = model.value
        for c in _slices(batches):
            dealt = lex.dealt(c.lines.to_pylist())
            sentence, subject = np.nonzero(dealt)
            share = np.bincount(c.doc_of[sentence] * k + subject, minlength=c.documents * k).reshape(-1, k).astype(float)
            known = np.bincount(c.doc_of, dealt.any(axis=1), c.documents) >= 2
            share /= np.maximum(share.sum(axis=1), 1)[:, None]
            doc = c.doc_of[c.sentence]
            held = _distinct(c.term[known[doc]] * c.documents + doc[known[doc]])  # each term of a document once
            if not len(held):
                continue
            term, doc = np.divmod(held, c.documents)
            starts = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
            sums = np.add.reduceat(share[doc], starts, axis=0)
            n = np.diff(np.concatenate([starts, [len(term)]]))
            yield pa.RecordBatch.from_arrays(
                [c.strings(term[starts]), pa.array(n.astype(np.int64)), *(pa.array(sums[:, i]) for i in range(k))], names=["term", "n", *(f"s{i}" for i in range(k))])

    return (
        parsed.select("sentences").mapInArrow(run, schema)
        .groupBy("term").agg(F.sum("n").alias("n"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(k)])
    )


def _curate(stats: DataFrame, subjects: list[str], purity: float, sure: float, least: float, max_terms: int, documents: int) -> dict[str, tuple[int, float]]:
    k = len(subjects)
    best = F.greatest(*[F.col(f"s{i}") for i in range(k)]) / F.col("n") if k > 1 else F.col("s0") / F.col("n")
    low = F.col("p") - sure * F.sqrt(F.col("p") * (1 - F.col("p")) / F.col("n"))
    found = stats.where(F.col("n") >= least).withColumn("p", best).where(low >= purity).limit(max_terms + 1).collect()
    if len(found) > max_terms:
        raise ValueError(f"more than {max_terms} subject terms: raise max_terms, or least_share, rather than lose some")
    rare = _rare({r["term"]: r["n"] for r in found}, documents)
    out = {}
    for r in found:
        s = max(range(k), key=lambda i: (r[f"s{i}"], -i))
        out[r["term"]] = (s, (r["p"] - purity + 0.1) * rare[r["term"]])
    return out


def _valley(parsed: DataFrame, lexicon: Lexicon, lo: float, hi: float, bins: int = 60) -> list[float]:
    """Of each subject the emptiest place of the histogram of its sentence scores between ``lo`` and ``hi``, over all sentences."""
    model = parsed.sparkSession.sparkContext.broadcast(lexicon)
    width = (hi - lo) / bins

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = model.value
        for c in _slices(batches):
            score = lex.scores(c.lines.to_pylist())
            sentence, s = np.nonzero((score >= lo) & (score < hi))
            at = s * bins + np.minimum(((score[sentence, s] - lo) / width).astype(np.int64), bins - 1)
            kinds, n = np.unique(at, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(kinds.astype(np.int32)), pa.array(n.astype(np.int64))], names=["bin", "n"])

    found = {r["bin"]: r["n"] for r in parsed.select("sentences").mapInArrow(run, "bin int, n bigint").groupBy("bin").agg(F.sum("n").alias("n")).collect()}
    out = []
    for s in range(len(lexicon.subjects)):
        own = [found.get(s * bins + i, 0) for i in range(bins)]
        smooth = [sum(own[max(0, i - 3) : i + 4]) for i in range(bins)]
        out.append(lo + width * (smooth.index(min(smooth)) + 0.5) if any(own) else lo)
    return out


def learn(
    parsed: DataFrame, examples: DataFrame, subject: str, example_text: str, areas: list[str],
    rounds: int = 4, purity: float = 0.4, sure: float = 1.5, least: int = 8, least_share: float = 1e-6, max_examples: int = 100_000,
    max_terms: int = 1_000_000,
) -> Lexicon:
    """The lexicon of ``areas``: from at most ``max_examples`` labelled rows, then ``rounds`` passes over all documents.

    ``parsed`` is the corpus by :func:`tokenised`.  A term is kept if at least ``least`` documents, and a ``least_share`` of
    all, hold it and its share of one subject in them exceeds ``purity`` by ``sure`` standard errors; terms of the
    examples that the corpus does not settle keep a quarter of their weight.  The lexicon is broadcast; learning fails
    rather than leave terms out where there are more than ``max_terms``.
    """
    rows = [(r[0], r[1]) for r in examples.select(subject, example_text).where(F.col(subject).isNotNull() & F.col(example_text).isNotNull()).limit(max_examples).collect()]
    seed = {t: (s, w / 4) for t, (s, w) in _seed(areas, rows).items()}
    openers = _openers(parsed)
    lexicon, documents = Lexicon(areas, seed, 0.1, openers), parsed.count()
    for _ in range(rounds):
        found = _curate(_round(parsed, lexicon), areas, purity, sure, max(least, least_share * documents), max_terms, documents)
        lexicon = Lexicon(areas, seed | found, 0.1, openers)
    return Lexicon(areas, lexicon.entries, _valley(parsed, lexicon, 0.05, 0.4), openers)


def subject_shares(parsed: DataFrame, key: str, lexicon: Lexicon) -> DataFrame:
    """(key, subject, share) of every subject that a sentence of the document deals with.

    Null, empty and blank texts have no row; repeated rows and null keys are kept as they are.
    """
    model = parsed.sparkSession.sparkContext.broadcast(lexicon)
    schema = T.StructType([T.StructField(key, parsed.schema[key].dataType), T.StructField("subject", T.StringType()), T.StructField("share", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = model.value
        for b in batches:
            by, n = lex.counts(b.column(1).to_pylist())
            at, subject = np.nonzero(by)
            share = by[at, subject] / n[at]
            names = pa.array(lex.subjects, pa.string()).take(pa.array(subject))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), names, pa.array(share)], names=[key, "subject", "share"])

    return parsed.select(key, "sentences").mapInArrow(run, schema)


def document_subjects(
    documents: DataFrame, key: str, text: str, examples: DataFrame, areas: DataFrame, share: float = 0.25, **learning
) -> DataFrame:
    """(key, subject): every subject of ``areas`` that at least ``share`` of the document's sentences deal with."""
    names = sorted(r[0] for r in areas.select("subject").where("subject is not null").distinct().collect())
    parsed = tokenised(documents, key, text)
    lexicon = learn(parsed, examples, "subject", "text", names, **learning)
    return subject_shares(parsed, key, lexicon).where(F.col("share") >= share).select(key, "subject")
