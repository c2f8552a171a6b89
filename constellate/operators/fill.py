"""Degree-bounded fill of the similarity graph of a projection, without writing its edges.

A member keeps few links, however many similar members it has.  So each task of the projection hands out only the first
pairs of every member, in the order of the fill, and the place up to which they are all of its pairs there.  One scan in
that order takes what the greedy takes, as long as everything before is known at both ends; the pairs of the members it
leaves open, which are few, are counted again among these alone, with longer lists, until none is left open.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from constellate.operators.project import BLOCK, _Block, _Chunks, _chunked, _in_blocks, _sides, _size, _tables, both_sides, incidence
from constellate.session import materialize, release

#: Pairs in the lists of all members, about; a member has ``SHORT`` in one group of chunks at least, and a third in others.
ENTRIES, SHORT = 1_500_000, 24
#: Cells of a block that are compared at a time, and pairs that are gathered before all but the first are dropped.
CELLS, GATHERED = 500_000, 500_000
_UNKNOWN = 1 << 30


def _rounded(x: np.ndarray, decimals: int) -> np.ndarray:
    """``x`` in units of the last decimal, rounded as Spark rounds doubles: half up by their shortest decimal form."""
    scaled = x * 10.0**decimals
    whole = np.floor(scaled + 0.5).astype(np.int32)
    for k in np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-5):
        whole[k] = int(Decimal(repr(float(x[k]))).scaleb(decimals).quantize(Decimal(1), ROUND_HALF_UP))
    return whole


def _first(s: np.ndarray, i: np.ndarray, j: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which pairs are among the first ``most`` of either end; the nodes that have as many, and the last of these pairs."""
    node, other, at = np.concatenate([i, j]), np.concatenate([j, i]), np.tile(np.arange(len(s)), 2)
    order = np.lexsort((other, -np.concatenate([s, s]), node))  # at one node pairs follow each other as the other ends do
    node, at = node[order], at[order]
    starts = np.flatnonzero(np.r_[True, node[1:] != node[:-1]]) if len(node) else np.zeros(0, np.int64)
    rank = np.arange(len(node)) - np.repeat(starts, np.diff(np.r_[starts, len(node)]))
    keep = np.zeros(len(s), bool)
    keep[at[rank < most]] = True
    last = rank == most - 1
    return keep, node[last], at[last]


def _strongest(chunks: _Chunks, members: DataFrame, most: int, top: int, cutoff: float, support: int, decimals: int) -> DataFrame:
    """(s, i, j, cut): similar pairs by their rounded similarity ``s``, each once, with ``cut`` -1; where a pair is the last that
    is known at a node in its task, the node stands in ``cut`` of another row of it.

    ``members`` is (member, c, k, d, r, taken): numbers for members, ``taken`` those with which it has a link already.
    """

    cutoff = max(cutoff, np.finfo(float).tiny)  # pairs that share nothing are none

    def each(same: bool, blocks: Iterator[_Block]) -> Iterator[pa.RecordBatch]:
        limit = most if same else max(top, most // 3)
        found = [np.zeros(0, np.int32) for _ in range(3)]
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        names: dict[int, np.ndarray] = {}
        least: dict[int, np.ndarray] = {}  # similarity below which a pair is not among the first of a node

        def fold() -> tuple[np.ndarray, np.ndarray]:
            s, i, j = (np.concatenate([f, *p]) for f, p in zip(found, zip(*parts))) if parts else found
            keep, full, at = _first(s, i, j, limit)
            for x, own in names.items():
                lo, hi = np.searchsorted(full, (own[0], own[-1] + 1))
                place = np.searchsorted(own, full[lo:hi])
                near = own[place] == full[lo:hi]
                place = place[near]
                least[x][place] = np.maximum(least[x][place], (s[at[lo:hi][near]] - 1) / 10.0**decimals)
            cut = np.cumsum(keep) - 1
            found[:] = [v[keep] for v in (s, i, j)]
            parts.clear()
            return full, cut[at]

        for x, y, left, right, held in blocks:
            wide, width = len(left.r), len(right.r)
            tables = _tables(held[x, 0], held[y, 0], wide, width, True, False)
            if tables is None:
                continue
            damped, raw = tables[1].reshape(wide, width), None
            for at, side in ((x, left), (y, right)):
                names.setdefault(at, side.member.to_numpy())
                least.setdefault(at, np.full(len(side.r), cutoff))
            i, other = np.repeat(np.arange(wide), np.diff(left.ok.offsets.to_numpy())), left.ok.flatten().to_numpy()
            place = np.minimum(np.searchsorted(names[y], other), width - 1)
            met = names[y][place] == other
            damped[i[met], place[met]] = 0
            # More than the weight of one container is from two or more.
            single = min(held[x, 0].weights.max(), held[y, 0].weights.max())
            step = max(1, CELLS // width)
            for row in range(0, wide, step):
                d, end = damped[row:row + step], min(wide, row + step)
                sim = d / np.sqrt(left.d[row:end, None] * right.d)
                if x == y:
                    sim[np.arange(width) <= np.arange(row, end)[:, None]] = 0
                doubt = (d <= single) & (sim >= cutoff) & ~((left.r[row:end] < support)[:, None] & (right.r < support))
                if doubt.any():
                    if raw is None:
                        raw = _tables(held[x, 0], held[y, 0], wide, width, False)[0].reshape(wide, width)
                    sim[doubt & (raw[row:end] < 2)] = 0
                lx, ly = least[x][row:end], least[y]
                near = sim >= np.minimum(lx[:, None], ly)
                if np.count_nonzero(near) > 2 * limit * (end - row + width):
                    margin = 10.0**-decimals
                    if limit < width:
                        np.maximum(lx, np.partition(sim, width - limit, axis=1)[:, width - limit] - margin, out=lx)
                    new = np.flatnonzero(ly <= cutoff)
                    if limit < end - row and len(new):
                        kth = end - row - limit
                        ly[new] = np.maximum(cutoff, np.partition(np.ascontiguousarray(sim.T[new]), kth, axis=1)[:, kth] - margin)
                    near = sim >= np.minimum(lx[:, None], ly)
                cells = np.flatnonzero(near)
                parts.append((_rounded(sim.ravel()[cells], decimals), names[x][cells // width + row], names[y][cells % width]))
                if sum(len(p[0]) for p in parts) > max(GATHERED, len(found[0])):
                    fold()
        full, last = fold()
        s, i, j = found
        cut = np.r_[np.full(len(s), -1, np.int32), full.astype(np.int32)]
        at = np.r_[np.arange(len(s)), last]
        for lo in range(0, len(at), 500_000):
            part = at[lo:lo + 500_000]
            yield pa.RecordBatch.from_arrays([pa.array(v.astype(np.int32)) for v in (s[part], i[part], j[part], cut[lo:lo + 500_000])], names=["s", "i", "j", "cut"])

    return _in_blocks(chunks, _sides(members, "taken"), chunks.rows[0], each, "s int, i int, j int, cut int")


def _in_order(rows: DataFrame, scan: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``scan`` over the rows of :func:`_strongest` in the order of the fill, in one task that holds only a few numbers a node."""
    return rows.coalesce(1).sortWithinPartitions(F.desc("s"), "i", "j", "cut").mapInArrow(scan, schema)


def _columns(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [batch.column(k).to_numpy() for k in (1, 2, 3)]


def _protected(found: DataFrame, total: int, top: int) -> DataFrame:
    """(i, j): pairs among the first ``top`` of either end."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = array("i", bytes(4 * total))
        now = np.frombuffer(seen, np.int32)
        for batch in batches:
            i, j, cut = _columns(batch)
            may = (cut == -1) & ((now[i] < top) | (now[j] < top))
            out = []
            for a, b in zip(i[may].tolist(), j[may].tolist()):
                if seen[a] < top or seen[b] < top:
                    seen[a] += 1
                    seen[b] += 1
                    out.append((a, b))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int32()) for v in zip(*out)], names=["i", "j"])

    return _in_order(found, scan, "i int, j int")


def _filled(found: DataFrame, room: DataFrame, total: int, top: int) -> DataFrame:
    """(i, j, rank): pairs that the greedy takes for certain; the room left at each node that stays open is -j, ``rank`` its number.

    ``room`` is (node, room).  A pair is taken if each end has room for it and for all undecided pairs before it.  With ``top``
    the pairs among the first so many of either end are passed over.
    """
    rows = room.select(F.lit(2**31 - 1).alias("s"), F.col("node").cast("int").alias("i"), F.col("room").cast("int").alias("j"), F.lit(-2).alias("cut")).unionByName(found)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, before, seen = (array("i", bytes(4 * total)) for _ in range(3))  # room, undecided pairs, pairs met
        l_, b_, s_ = (np.frombuffer(v, np.int32) for v in (left, before, seen))
        l_.flags.writeable = True
        for batch in batches:
            i, j, cut = _columns(batch)
            own = cut == -2
            l_[i[own]] = j[own]
            ends = np.where(cut >= 0, cut, i), np.where(cut >= 0, cut, j)
            may = ~own & (l_[ends[0]] > 0) & (l_[ends[1]] > 0)
            if top:
                may |= (cut == -1) & ((s_[i] < top) | (s_[j] < top))
            out = []
            for a, b, c in zip(i[may].tolist(), j[may].tolist(), cut[may].tolist()):
                if c >= 0:
                    before[c] = _UNKNOWN
                elif seen[a] < top or seen[b] < top:
                    seen[a] += 1
                    seen[b] += 1
                elif left[a] > 0 and left[b] > 0:
                    if left[a] > before[a] and left[b] > before[b]:
                        left[a] -= 1
                        left[b] -= 1
                        out.append((a, b))
                    else:
                        before[a] += 1
                        before[b] += 1
            if out:
                yield pa.RecordBatch.from_arrays([*(pa.array(v, pa.int32()) for v in zip(*out)), pa.array(np.full(len(out), -1, np.int32))], names=["i", "j", "rank"])
        open_ = np.flatnonzero((l_ > 0) & (b_ > 0)).astype(np.int32)
        for lo in range(0, len(open_), 500_000):
            part = open_[lo:lo + 500_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(-l_[part]), pa.array(np.arange(lo, lo + len(part), dtype=np.int32))], names=["i", "j", "rank"])

    return _in_order(rows, scan, "i int, j int, rank int")


def _narrowed(chunks: _Chunks, open_: DataFrame, count: int, block: int) -> _Chunks:
    """The chunks of the members in ``open_`` (node, rank) alone; containers keep their sizes, members their marginals."""
    size = _size(count, block)
    few = F.broadcast if count <= 500_000 else lambda df: df
    members = materialize(chunks.members.toDF("member", "oc", "ok", "d", "r").join(few(open_.withColumnRenamed("node", "member")), "member").select(
        "member", "oc", "ok", F.floor(F.col("rank") / size).cast("int").alias("c"), (F.col("rank") % size).cast("smallint").alias("k"), "d", "r"), "members")
    rows = chunks.rows[0].select("layer", "at", "n", F.col("c").alias("oc"), F.explode("ks").alias("ok")).join(few(members.select("oc", "ok", "c", "k")), ["oc", "ok"])
    rows = rows.groupBy("layer", "at", "n", "c").agg(F.array_sort(F.collect_list("k")).alias("ks"))
    return _Chunks(members.select("member", "c", "k", "d", "r"), [materialize(rows, "chunks")], -(-count // size), size)


def bounded_links(
    df: DataFrame, container: str, member: str, bound: Callable[[Column], Column], top: int = 4, decimals: int = 6, cutoff: float = 0.08, support: int = 30,
    block: int = BLOCK, entries: int = ENTRIES, short: int = SHORT,
) -> DataFrame:
    """(i, j): of the edges of :func:`similar_members` the ``top`` first of each member, and the greedy fill, strongest first,
    of those whose ends are both under their bounds; ``bound`` is made of the damped marginal.

    As ``fill_within_bounds`` with these protected pairs; order: similarity, rounded to ``decimals``, descending, i, j.
    The result does not depend on ``block``, ``entries`` and ``short`` (at least ``top``).
    """
    whole = _chunked([incidence(df, container, member)], block)
    names = whole.members.select((F.col("c") * whole.size + F.col("k")).cast("int").alias("number"), "member", "c", "k", "d", "r")
    chunks = _Chunks(names.select(F.col("number").alias("member"), "c", "k", "d", "r"), whole.rows, whole.count, whole.size)
    total, count = whole.count * whole.size, names.count()

    def strongest(members: DataFrame) -> DataFrame:
        return materialize(_strongest(chunks, members, max(short, top, entries // max(1, count)), max(1, top), cutoff, support, decimals), "strongest")

    found = strongest(chunks.members.withColumn("taken", F.array().cast("array<int>")))
    kept = materialize(_protected(found, total, top), "fill")
    degree = both_sides(kept).groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    room = names.select(F.col("number").alias("node"), bound(F.col("d")).alias("bound")).join(degree, "node", "left").select(
        "node", (F.col("bound") - F.coalesce("n", F.lit(0))).alias("room")).where("room > 0")
    taken, first = kept, True
    while True:
        got = materialize(_filled(found, materialize(room, "room"), total, top if first else 0), "fill")
        release(found)
        new, open_ = got.where("j >= 0").select("i", "j"), got.where("j < 0").select(F.col("i").alias("node"), "j", "rank")
        count, some = open_.count(), first or new.limit(1).count()
        last, taken = taken, materialize(taken.unionByName(new), "fill")
        release(last)
        if count < 2 or not some:  # the first pair of all is always decided, so there is none left
            break
        wider, chunks = chunks, _narrowed(chunks, open_.select("node", "rank"), count, block)
        release(wider.rows[0])
        ends, first = open_.select("node"), False
        beside = both_sides(taken).join(ends, "node", "left_semi").join(ends.toDF("other"), "other", "left_semi").groupBy("node").agg(F.array_sort(F.collect_list("other")).alias("taken"))
        found = strongest(chunks.members.join(beside.toDF("member", "taken"), "member", "left").withColumn("taken", F.coalesce("taken", F.array().cast("array<int>"))))
        room = open_.select("node", (-F.col("j")).alias("room"))
    left, right = names.select(F.col("number").alias("a"), F.col("member").alias("i")), names.select(F.col("number").alias("b"), F.col("member").alias("j"))
    return taken.toDF("a", "b").join(left, "a").join(right, "b").select("i", "j")
