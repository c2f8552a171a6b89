"""Encoding of whole texts with a public byte-level BPE vocabulary.

Merging keeps the symbols of a piece in a doubly linked list and the mergeable neighbours in a priority queue by rank;
entries whose symbols have changed since are stale and skipped.  A piece of n bytes costs O(n log n), so that one piece
of a million letters is no problem.  Decoding concatenates the strings of the vocabulary.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Fixed value: the published pattern that cuts text into pieces before merging.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary file: itself where printable, else one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class ByteBpe:
    """Vocabulary, merges and both directions; picklable, and no larger than the vocabulary file."""

    def __init__(self, path: str, cached_pieces: int = 200_000) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab: dict[str, int] = model["vocab"]
        letters = byte_letters()
        self.first = [vocab[c] for c in letters]
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[a] << 24 | vocab[b]] = (rank, vocab[a + b])
        byte_of = {c: b for b, c in enumerate(letters)}
        self.strings = {i: bytes(byte_of[c] for c in token) for token, i in vocab.items() if all(c in byte_of for c in token)}
        self.cached_pieces = cached_pieces
        self._reset()

    def _reset(self) -> None:
        self._cache: dict[str, list[int]] = {}
        self._split = regex.compile(PIECES).findall

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("_cache", "_split")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._reset()

    def merge(self, data: bytes) -> list[int]:
        """Token ids of one piece."""
        sym = [self.first[b] for b in data]
        n = len(sym)
        if n < 2:
            return sym
        merges = self.merges
        after = list(range(1, n + 1))  # n marks the end
        before = list(range(-1, n - 1))
        queue = [(m[0], i) for i in range(n - 1) if (m := merges.get(sym[i] << 24 | sym[i + 1]))]
        heapify(queue)
        while queue:
            rank, i = heappop(queue)
            if sym[i] < 0 or (j := after[i]) == n:
                continue
            m = merges.get(sym[i] << 24 | sym[j])
            if m is None or m[0] != rank:
                continue  # stale: one of the two was merged away
            sym[i], sym[j] = m[1], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if m := merges.get(sym[i] << 24 | sym[k]):
                    heappush(queue, (m[0], i))
            h = before[i]
            if h >= 0 and (m := merges.get(sym[h] << 24 | sym[i])):
                heappush(queue, (m[0], h))
        return [s for s in sym if s >= 0]

    def encode(self, text: str | None) -> list[int]:
        """Token ids of ``text`` as stored, without special tokens; an empty text and None give an empty list."""
        if not text:
            return []
        out: list[int] = []
        cache = self._cache
        for piece in self._split(text):
            ids = cache.get(piece)
            if ids is None:
                ids = self.merge(piece.encode("utf-8", "surrogatepass"))
                if len(piece) <= 64:
                    if len(cache) >= self.cached_pieces:
                        cache.clear()
                    cache[piece] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        """Text of ``ids``.  Bytes that make no character (ids cut in the middle of one) and ids without a string, such as
        special tokens and null, read as U+FFFD."""
        return b"".join(self.strings.get(i, b"\xff") for i in ids).decode("utf-8", "replace")


def spread(df: DataFrame, tasks_per_core: int = 2) -> DataFrame:
    """``df`` in enough partitions for a Python stage: unchanged where the scan gives enough, else spread evenly."""
    want = tasks_per_core * df.sparkSession.sparkContext.defaultParallelism
    have = df._jdf.queryExecution().toRdd().getNumPartitions()  # of the plan at hand
    return df if have >= want // 2 else df.repartition(want)


def encode(df: DataFrame, key: str, text: str, path: str | None = None, ids: str = "ids") -> DataFrame:
    """(key, ids) of every row.  ``path`` is the vocabulary file (default: the installed byte_bpe_50k).

    One row for each row of ``df``, also where the key is null or repeated; null and empty texts give an empty list.
    The vocabulary is broadcast: its size is that of the file, whatever the corpus.
    """
    model = df.sparkSession.sparkContext.broadcast(ByteBpe(path or default_path()))
    key_type = df.schema[key].dataType
    schema = T.StructType([T.StructField(key, key_type), T.StructField(ids, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model.value
        for b in batches:
            lists = [bpe.encode(t) for t in b.column(1).to_pylist()]
            offsets = np.zeros(len(lists) + 1, np.int32)
            np.cumsum([len(x) for x in lists], out=offsets[1:])
            flat = np.fromiter((i for x in lists for i in x), np.int32, int(offsets[-1]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=[key, ids])

    return spread(df.select(key, text)).mapInArrow(run, schema)


def decode(df: DataFrame, key: str, ids: str, path: str | None = None, text: str = "text") -> DataFrame:
    """(key, text) of every row of token ids; a null list gives null, an empty one the empty text."""
    model = df.sparkSession.sparkContext.broadcast(ByteBpe(path or default_path()))
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField(text, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [None if x is None else model.value.decode(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.string())], names=[key, text])

    return spread(df.select(key, ids)).mapInArrow(run, schema)
