"""Bipartite projection: members that share containers, with damped weights, and the sparse graph made of them.

Members are numbered in their order and cut into chunks, the chunks into groups.  A container's members in one chunk make
one row with a short array, sent to every pair of groups that has the chunk's; there each block of two chunks counts its
pairs in a dense table and hands out each pair once, with all its counts (damped, raw, independent units).  So no pair is
ever shuffled or written before its counts are complete and tested: disk follows the containers' rows, each sent once for
every group, not the pairs, nor the chunks that a container has.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from constellate.operators.ranking import global_rank
from constellate.session import materialize, release


def incidence(df: DataFrame, container: str, member: str) -> DataFrame:
    """Distinct (container, member) without nulls."""
    return df.select(F.col(container).alias("container"), F.col(member).alias("member")).where(
        F.col("container").isNotNull() & F.col("member").isNotNull()).distinct()


#: Members of a chunk at most: a block's tables take 12 bytes for each pair of members of two chunks.
BLOCK = 2048
#: Incidences of a group of chunks, about: a task holds those of two groups.
GROUP = 2_000_000


@dataclass
class _Chunks:
    """``members`` (member, c, k, d, r): chunk, place in it and marginals in the first layer; ``rows`` (layer, at, n, c,
    ks) for each layer: the number of a container, its size and the places of its members in one chunk.  All are written once."""

    members: DataFrame
    rows: list[DataFrame]
    count: int
    size: int


def _size(total: int, block: int) -> int:
    """Members of a chunk; small tables are cut finer, so that there are some blocks to share out."""
    return max(1, min(block, 32_767, max(64, math.ceil(total / 6))))


def _chunked(layers: Sequence[DataFrame], block: int) -> _Chunks:
    """``layers`` are distinct (container, member)."""
    layers = [materialize(x, "incidence") for x in layers]
    every = layers[0].select("member")
    for x in layers[1:]:
        every = every.unionByName(x.select("member"))
    ranked = global_rank(every.distinct(), [F.asc("member")])
    total = ranked.count()
    size = _size(total, block)
    placed = materialize(ranked.select("member", F.floor(F.col("rank") / size).cast("int").alias("c"), (F.col("rank") % size).cast("smallint").alias("k")), "members")

    def rows(inc: DataFrame, layer: int) -> DataFrame:
        inc = inc.join(placed, "member").select("container", "c", "k").repartition("container")
        each = Window.partitionBy("container")
        return inc.groupBy("container", "c").agg(F.array_sort(F.collect_list("k")).alias("ks")).withColumn("at", F.monotonically_increasing_id()).select(
            F.lit(layer).alias("layer"), F.min("at").over(each).alias("at"), F.sum(F.size("ks")).over(each).alias("n"), "c", "ks")

    parts = [materialize(rows(x, n), "chunks") for n, x in enumerate(layers)]
    for x in layers:
        release(x)
    weight = 1.0 / F.log2(F.greatest(F.lit(2.0), F.col("n").cast("double")))
    own = parts[0].select("c", weight.alias("w"), F.explode("ks").alias("k")).groupBy("c", "k").agg(F.sum("w").alias("d"), F.count(F.lit(1)).alias("r"))
    zero = lambda c, v: F.coalesce(c, F.lit(v)).alias(c)
    members = materialize(placed.join(own, ["c", "k"], "left").select("member", "c", "k", zero("d", 0.0), zero("r", 0)), "members")
    return _Chunks(members, parts, -(-total // size), size)


def _add(raw: np.ndarray | None, damped: np.ndarray | None, ka: pa.ListArray, kb: pa.ListArray, weights: np.ndarray, width: int) -> None:
    """Count all pairs of the two arrays of each row in the tables of a block."""
    oa, ob = ka.offsets.to_numpy(), kb.offsets.to_numpy()
    va, vb = (x.values.to_numpy(zero_copy_only=False).astype(np.int64) for x in (ka, kb))
    na, nb = np.diff(oa), np.diff(ob)
    pairs = na.astype(np.int64) * nb
    for r in np.flatnonzero(pairs > 1000):  # places of one row are distinct, and so are their cells
        cells = (va[oa[r]:oa[r + 1], None] * width + vb[None, ob[r]:ob[r + 1]]).ravel()
        if raw is not None:
            raw[cells] += 1
        if damped is not None:
            damped[cells] += weights[r]
    few = np.flatnonzero(pairs <= 1000)
    for part in np.array_split(few, max(1, int(pairs[few].sum()) // 1_000_000)):
        if not len(part):
            continue
        left = np.repeat(part, na[part])  # the row of each left member
        at = np.arange(len(left)) - np.repeat(np.cumsum(na[part]) - na[part], na[part]) + np.repeat(oa[part], na[part])
        times = nb[left]
        within = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        cells = np.repeat(va[at] * width, times) + vb[np.repeat(ob[left], times) + within]
        if raw is not None:
            np.add.at(raw, cells, 1)
        if damped is not None:
            np.add.at(damped, cells, np.repeat(weights[left], times))


@dataclass
class _Held:
    """The rows of a chunk in one layer, by the numbers of their containers."""

    at: np.ndarray
    weights: np.ndarray
    ks: pa.ListArray

    def matrix(self, rows: np.ndarray, width: int) -> np.ndarray:
        """1 where a container (row) has a member (column)."""
        ks = self.ks.take(pa.array(rows))
        out = np.zeros((len(rows), width), np.float32)
        out[np.repeat(np.arange(len(rows)), np.diff(ks.offsets.to_numpy())), ks.flatten().to_numpy(zero_copy_only=False)] = 1
        return out


def _tables(a: _Held, b: _Held, wide: int, width: int, damp: bool, count: bool = True) -> tuple[np.ndarray | None, np.ndarray | None] | None:
    """Raw (``count``) and damped counts of a block; containers that have many of its members are counted by products of matrices."""
    x, y = (np.arange(len(a.at)),) * 2 if a is b else np.intersect1d(a.at, b.at, assume_unique=True, return_indices=True)[1:]
    if not len(x):
        return None
    raw, damped = np.zeros(wide * width, np.int32) if count else None, np.zeros(wide * width) if damp else None
    sizes = [np.diff(h.ks.offsets.to_numpy()).astype(np.int64) for h in (a, b)]
    many = sizes[0][x] * sizes[1][y] > wide * width // (50 if count else 300)  # without raw counts it takes one product
    for rows in np.array_split(np.flatnonzero(many), max(1, -(-int(many.sum()) // 512))):
        if not len(rows):
            continue
        left, right = a.matrix(x[rows], wide), b.matrix(y[rows], width)
        if raw is not None:
            raw += (left.T @ right).ravel().astype(np.int32)
        if damped is not None:
            damped += ((left * a.weights[x[rows], None]).T @ right.astype(np.float64)).ravel()
    if not many.all():
        x, y = x[~many], y[~many]
        _add(raw, damped, a.ks.take(pa.array(x)), b.ks.take(pa.array(y)), a.weights[x], width)
    return raw, damped


@dataclass
class _Side:
    """The members of a chunk, by place: names, marginals, and whether they are among the asked ones, or what else is sent."""

    member: pa.Array
    d: np.ndarray
    r: np.ndarray
    ok: np.ndarray | pa.ListArray


#: Makes the result of pairs (places i and j in two sides, damped, raw, counts in the second layer).
_Emit = Callable[[_Side, _Side, np.ndarray, np.ndarray, np.ndarray | None, np.ndarray, np.ndarray | None], pa.RecordBatch]


#: Two chunks of a task, the members of both, and the rows of all its chunks by chunk and layer.
_Block = tuple[int, int, _Side, _Side, dict[tuple[int, int], _Held]]


def _in_blocks(chunks: _Chunks, sides: DataFrame, rows: DataFrame, each: Callable[[bool, Iterator[_Block]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What ``each`` makes of the blocks of a task, which are those of two groups of chunks (it is told whether of one and
    the same); ``sides`` is (c, s)."""
    total = rows.agg(F.sum(F.size("ks"))).first()[0] or 0
    # As many pairs of groups as tasks are wanted, or more if a group would be too large.
    wanted = math.ceil((math.sqrt(64 * chunks.members.sparkSession.sparkContext.defaultParallelism + 1) - 1) / 2)
    per = max(1, chunks.count // max(wanted, -(-total // GROUP)))  # chunks of a group
    groups = max(1, -(-chunks.count // per))
    own, other = F.floor(F.col("c") / per).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    pair = F.struct(F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"))
    sent = sides.select(F.lit(-1).alias("layer"), F.lit(None).cast("bigint").alias("at"), F.lit(None).cast("bigint").alias("n"), "c", F.lit(None).cast("array<smallint>").alias("ks"), "s").unionByName(
        rows.select("layer", "at", F.col("n").cast("bigint").alias("n"), "c", "ks", F.lit(None).cast(sides.schema["s"].dataType).alias("s")))
    sent = sent.select("*", own.alias("own"), other.alias("other")).withColumn("pair", pair).select("pair.a", "pair.b", "c", "layer", "at", "n", "ks", "s")
    tasks = groups * (groups + 1) // 2

    def side(column: pa.StructArray, row: int) -> _Side:
        v = [column.field(k)[row].values for k in range(4)]
        return _Side(v[0], *[x if isinstance(x, pa.ListArray) else x.to_numpy(zero_copy_only=False) for x in v[1:]])

    def blocks(a: int, b: int, sides: dict[int, _Side], parts: dict[tuple[int, int], list]) -> Iterator[_Block]:
        """All blocks of the groups ``a`` and ``b``."""
        held = {}
        for key, batches in parts.items():
            at, n, ks = (pa.concat_arrays(x) for x in zip(*batches))
            held[key] = _Held(at.to_numpy(), 1.0 / np.log2(np.maximum(2.0, n.to_numpy().astype(float))), ks)
        for x in sorted(sides):
            for y in sorted(sides):
                if x > y or x // per != a or y // per != b or (x, 0) not in held or (y, 0) not in held:
                    continue
                yield x, y, sides[x], sides[y], held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple[int, int] | None = None
        sides: dict[int, _Side] = {}
        parts: dict[tuple[int, int], list] = {}
        for batch in batches:
            a, b, c, layer = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            cuts = np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1]) | (layer[1:] != layer[:-1])) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(a)]):
                if lo == hi:
                    continue
                if at != (a[lo], b[lo]):
                    if at is not None:
                        yield from each(at[0] == at[1], blocks(*at, sides, parts))
                    at, sides, parts = (a[lo], b[lo]), {}, {}
                if layer[lo] < 0:
                    sides[c[lo]] = side(batch.column(7), lo)
                else:
                    parts.setdefault((c[lo], layer[lo]), []).append([pa.concat_arrays([batch.column(k).slice(lo, hi - lo)]) for k in (4, 5, 6)])
        if at is not None:
            yield from each(at[0] == at[1], blocks(*at, sides, parts))

    number = F.expr("cast(b * (b + 1) / 2 as int) + a")
    return sent.repartitionById(tasks, number).sortWithinPartitions("a", "b", "c", "layer", "at").mapInArrow(run, schema)


def _sides(members: DataFrame, last: str) -> DataFrame:
    """(c, s) of members (member, c, k, d, r) and a column ``last``: one row for each chunk, arrays in the order of the places."""
    fields = ("member", "d", "r", last)
    one = members.groupBy("c").agg(F.array_sort(F.collect_list(F.struct("k", *fields))).alias("s"))
    return materialize(one.select("c", F.struct(*[F.col(f"s.{v}").alias(v) for v in fields]).alias("s")), "sides")


def _counted(chunks: _Chunks, emit: _Emit, schema: str, damp: bool = True, second: bool = False, asked: DataFrame | None = None) -> DataFrame:
    """What ``emit`` makes of the pairs of all blocks; ``second`` counts the second layer, too, ``asked`` (member) sets ``ok``."""

    m = chunks.members
    m = m.withColumn("ok", F.lit(True)) if asked is None else m.join(asked.select("member").distinct().withColumn("ok", F.lit(True)), "member", "left").withColumn("ok", F.coalesce("ok", F.lit(False)))

    def finish(a: int, b: int, left: _Side, right: _Side, raw: np.ndarray, damped: np.ndarray | None, units: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        width = len(right.r)
        for top in range(0, len(left.r), max(1, 300_000 // width)):  # some rows of the table at a time
            lo, hi = top * width, min(len(left.r), top + max(1, 300_000 // width)) * width
            cells = np.flatnonzero(raw[lo:hi]) + lo
            i, j = cells // width, cells % width
            if a == b:
                i, j, cells = i[i < j], j[i < j], cells[i < j]
            if len(cells):
                yield emit(left, right, i, j, None if damped is None else damped[cells], raw[cells], None if units is None else units[cells])

    def each(same: bool, blocks: Iterator[_Block]) -> Iterator[pa.RecordBatch]:
        for x, y, left, right, held in blocks:
            shape = len(left.r), len(right.r)
            tables = _tables(held[x, 0], held[y, 0], *shape, damp)
            if tables is None:
                continue
            units = None
            if second:
                got = _tables(held[x, 1], held[y, 1], *shape, False) if (x, 1) in held and (y, 1) in held else None
                units = np.zeros(shape[0] * shape[1], np.int32) if got is None else got[0]
            yield from finish(x, y, left, right, *tables, units)

    return _in_blocks(chunks, _sides(m, "ok"), chunks.rows[0].unionByName(chunks.rows[1]) if second else chunks.rows[0], each, schema)


def _kind(df: DataFrame) -> str:
    return df.schema["member"].dataType.simpleString()


def project(df: DataFrame, container: str, member: str, block: int = BLOCK) -> DataFrame:
    """(i, j, damped, raw), i < j: damped and raw number of containers that two members share.

    Repeated rows count once, nulls not at all; an empty input gives an empty result.
    """
    chunks = _chunked([incidence(df, container, member)], block)

    def emit(left, right, i, j, damped, raw, units) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([left.member.take(pa.array(i)), right.member.take(pa.array(j)), pa.array(damped), pa.array(raw.astype(np.int64))], names=["i", "j", "damped", "raw"])

    kind = _kind(chunks.members)
    return _counted(chunks, emit, f"i {kind}, j {kind}, damped double, raw bigint")


def shared_units(df: DataFrame, unit: str, member: str, block: int = BLOCK) -> DataFrame:
    """(i, j, units): independent units in which both members occur, in the same container or not."""
    chunks = _chunked([incidence(df, unit, member)], block)

    def emit(left, right, i, j, damped, raw, units) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([left.member.take(pa.array(i)), right.member.take(pa.array(j)), pa.array(raw.astype(np.int64))], names=["i", "j", "units"])

    kind = _kind(chunks.members)
    return _counted(chunks, emit, f"i {kind}, j {kind}, units bigint", damp=False)


def _diagonal(inc: DataFrame) -> DataFrame:
    sizes = inc.groupBy("container").agg(F.count(F.lit(1)).alias("n"))
    return (
        inc.join(sizes, "container").groupBy("member")
        .agg(F.sum(1.0 / F.log2(F.greatest(F.lit(2.0), F.col("n").cast("double")))).alias("damped"), F.count(F.lit(1)).alias("raw"))
    )


def marginals(df: DataFrame, container: str, member: str) -> DataFrame:
    """(member, damped, raw): the diagonal of the projection."""
    return _diagonal(incidence(df, container, member))


def degree_bound(damped: Column) -> Column:
    """Links that a member may keep: 4 * sqrt of its damped marginal, between 4 and 24."""
    return F.least(F.lit(24), F.greatest(F.lit(4), F.floor(4 * F.sqrt(F.greatest(F.lit(1.0), damped))))).cast("bigint")


def _similar(chunks: _Chunks, cutoff: float, support: int, asked: DataFrame | None = None) -> DataFrame:
    def emit(left, right, i, j, damped, raw, units) -> pa.RecordBatch:
        keep, sim = _kept(left, right, i, j, damped, raw, cutoff, support)
        i, j = i[keep], j[keep]
        return pa.RecordBatch.from_arrays(
            [left.member.take(pa.array(i)), right.member.take(pa.array(j)), pa.array(sim[keep]), pa.array(raw[keep].astype(np.int64)), pa.array(left.r[i]), pa.array(right.r[j])],
            names=["i", "j", "similarity", "raw", "r_i", "r_j"])

    kind = _kind(chunks.members)
    return _counted(chunks, emit, f"i {kind}, j {kind}, similarity double, raw bigint, r_i bigint, r_j bigint", asked=asked).select(
        "i", "j", "similarity", "raw", F.round(100.0 * F.col("raw") / F.col("r_i"), 1).alias("source_percent"),
        F.round(100.0 * F.col("raw") / F.col("r_j"), 1).alias("target_percent"))


def _kept(left: _Side, right: _Side, i: np.ndarray, j: np.ndarray, damped: np.ndarray, raw: np.ndarray, cutoff: float, support: int) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs are similar and no fluke, with both ends asked for; and all similarities."""
    sim = damped / np.sqrt(left.d[i] * right.d[j])
    return (((left.r[i] < support) & (right.r[j] < support)) | (raw >= 2)) & (sim >= cutoff) & left.ok[i] & right.ok[j], sim


def similar_members(
    df: DataFrame, container: str, member: str, cutoff: float = 0.08, support: int = 30, block: int = BLOCK
) -> DataFrame:
    """(i, j, similarity, raw, source_percent, target_percent): cosine of damped counts, where it is no fluke.

    A pair is kept if its similarity reaches ``cutoff`` and, where either member is in ``support`` containers or more,
    they share at least two.  The percentages are the shared share of each member's containers, to one decimal.
    """
    return _similar(_chunked([incidence(df, container, member)], block), cutoff, support)


def supported_members(
    df: DataFrame, container: str, member: str, unit: str, least: int = 2, cutoff: float = 0.08, support: int = 30, block: int = BLOCK
) -> DataFrame:
    """:func:`similar_members` whose ends both have an edge backed by ``least`` independent units; columns alike.

    The pairs are counted twice, once to find the backed members and once between these, so that neither the edges nor
    their units have to be written and joined.
    """
    chunks = _chunked([incidence(df, container, member), incidence(df, unit, member)], block)

    def emit(left, right, i, j, damped, raw, units) -> pa.RecordBatch:
        keep = _kept(left, right, i, j, damped, raw, cutoff, support)[0] & (units >= least)
        ends = [side.member.take(pa.array(np.unique(at[keep]))) for side, at in ((left, i), (right, j))]
        return pa.RecordBatch.from_arrays([pa.concat_arrays(ends)], names=["member"])

    backed = _counted(chunks, emit, f"member {_kind(chunks.members)}", second=True).distinct()
    return _similar(chunks, cutoff, support, materialize(backed, "backed"))


def overlap(source_percent: Column, target_percent: Column) -> Column:
    """Geometric mean of both percentages, to one decimal."""
    return F.round(F.sqrt(source_percent * target_percent), 1)


def normalised_weight(edges: DataFrame, similarity: str = "similarity") -> DataFrame:
    """``edges`` with ``weight``: similarity scaled to 0.06 ... 1 between the least and the greatest."""
    ends = edges.agg(F.struct(F.min(similarity).alias("lo"), F.max(similarity).alias("hi")).alias("e")).scalar()
    span = F.when(ends["hi"] > ends["lo"], ends["hi"] - ends["lo"]).otherwise(F.lit(1.0))
    return edges.withColumn("weight", F.round(0.06 + 0.94 * (F.col(similarity) - ends["lo"]) / span, 4))


def both_sides(edges: DataFrame, i: str = "i", j: str = "j", rest: list[str] | None = None) -> DataFrame:
    """Each undirected edge from either end: (node, other, rest)."""
    rest = [c for c in edges.columns if c not in (i, j)] if rest is None else rest
    return edges.select(F.col(i).alias("node"), F.col(j).alias("other"), *rest).unionByName(
        edges.select(F.col(j).alias("node"), F.col(i).alias("other"), *rest))


def top_links(edges: DataFrame, k: int, order: list[Column], i: str = "i", j: str = "j") -> DataFrame:
    """Distinct canonical pairs among the ``k`` first links of each node; ``order`` may use ``other`` as the last tie."""
    ranked = both_sides(edges, i, j).withColumn("rank", F.row_number().over(Window.partitionBy("node").orderBy(*order))).where(F.col("rank") <= k)
    return ranked.select(F.least("node", "other").alias(i), F.greatest("node", "other").alias(j)).distinct()


def supported_edges(edges: DataFrame, units: DataFrame, least: int = 2) -> DataFrame:
    """Edges whose ends both have an edge backed by ``least`` independent units."""
    backed = edges.join(units.where(F.col("units") >= least), ["i", "j"], "left_semi")
    nodes = backed.select(F.col("i").alias("m")).union(backed.select("j")).distinct()
    return edges.join(nodes.withColumnRenamed("m", "i"), "i", "left_semi").join(nodes.withColumnRenamed("m", "j"), "j", "left_semi").select(*edges.columns)
