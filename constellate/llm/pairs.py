"""Items that appear together: exact pair counts and association scores by large-basket blocking.

Ordinary baskets become one array each and emit their pairs inside whole-stage codegen.  A huge basket is never one
array: its items are hashed into chunks, every pair of chunks becomes one block of its own, and the blocks are spread over
all tasks; their pairs are combined with the ordinary ones by one partially aggregated count.

Two exact bounds keep hopeless items out before any pair is made.  A pair's count n is at most the smaller of n_a and
n_b, so an item below ``min_count`` has no result; and n * N >= lift * n_a * n_b with n <= min(n_a, n_b) needs
lift * max(n_a, n_b) <= N, so an item in more than N / lift baskets has none either.  Items are coded by support and
number, so that the lift of a counted pair is known from its codes; only the surviving pairs are joined to names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from constellate.operators.skew import hot_split_join
from constellate.session import materialize


def _blocks(coded: DataFrame, basket: str, ordinary: int, chunk: int) -> DataFrame:
    """(xs, ys): pairs to make are all of xs with all of ys, or, where ys is null, all pairs within xs."""
    huge = coded.groupBy(basket).agg(F.count(F.lit(1)).alias("__size")).where(F.col("__size") > ordinary)
    small = (
        coded.join(huge.select(basket), basket, "left_anti")
        .groupBy(basket)
        .agg(F.array_sort(F.collect_list("code")).alias("xs"))
        .where(F.size("xs") > 1)
        .select("xs", F.lit(None).cast("array<bigint>").alias("ys"))
    )
    chunks = (
        coded.join(huge, basket)
        .withColumn("__chunks", F.ceil(F.col("__size") / chunk).cast("int"))
        .withColumn("__chunk", F.pmod(F.xxhash64("code"), F.col("__chunks")).cast("int"))
        .groupBy(basket, "__chunks", "__chunk")
        .agg(F.array_sort(F.collect_list("code")).alias("xs"))
    )
    within = chunks.select("xs", F.lit(None).cast("array<bigint>").alias("ys"))
    other = F.explode(F.sequence(F.lit(0), F.col("__chunks") - 1)).alias("__other")
    sent = chunks.select(basket, "__chunk", "xs", other).where(F.col("__chunk") != F.col("__other"))
    first = sent.where(F.col("__chunk") < F.col("__other")).select(
        basket, F.col("__chunk").alias("i"), F.col("__other").alias("j"), "xs")
    second = sent.where(F.col("__chunk") > F.col("__other")).select(
        basket, F.col("__other").alias("i"), F.col("__chunk").alias("j"), F.col("xs").alias("ys"))
    return small.unionByName(within).unionByName(first.join(second, [basket, "i", "j"]).select("xs", "ys"))


#: Bits of a code that number the item; those above hold its support, so that a pair's bounds need no join.
_NUMBER = 33


def _coded_items(support: DataFrame) -> DataFrame:
    """(item, support, code): items with a code of support and a dense number; fails where either does not fit."""
    items = materialize(support.withColumn("at", F.monotonically_increasing_id()), "items")
    part = F.shiftright("at", 33)
    sizes = items.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.max("support").alias("most")).orderBy("part").collect()  # one row a partition
    if sum(r["n"] for r in sizes) >= 1 << _NUMBER or max((r["most"] for r in sizes), default=0) >= 1 << (63 - _NUMBER):
        raise ValueError("more items, or a more frequent item, than a code of 64 bits can hold")
    starts, at = {}, 0
    for r in sizes:
        starts[r["part"]], at = at, at + r["n"]
    start = F.create_map(*[F.lit(x) for kv in starts.items() for x in kv]) if starts else F.create_map(F.lit(0).cast("bigint"), F.lit(0))
    number = start[part] + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    return items.select("item", "support", (F.shiftleft(F.col("support"), _NUMBER) + number).cast("bigint").alias("code"))


def pair_association(
    df: DataFrame,
    basket: str,
    item: str,
    baskets_in_all: int,
    min_count: int = 1,
    min_lift: float = 0.0,
    block_pairs: int = 1024,
) -> DataFrame:
    """Unordered pairs of different items with the number of baskets they share and how far that exceeds chance.

    Result: ``id_a < id_b``, ``n`` (shared baskets), ``n_a``, ``n_b``, ``lift`` = n * N / (n_a * n_b) and ``npmi``, for
    pairs with n >= ``min_count`` and n * N >= ``min_lift`` * n_a * n_b, where N is ``baskets_in_all``.  Repeated
    rows count once, null or empty items and null baskets not at all; an empty input gives an empty result; further
    columns are ignored.  ``block_pairs`` is the work of one block: a basket with more pairs is huge and cut into
    chunks of which any two have about so many pairs.  It does not change the result.
    """
    ordinary, chunk = max(2, int((2 * block_pairs) ** 0.5)), max(1, int(block_pairs**0.5))
    incidence = materialize(
        df.select(F.col(basket).alias("basket"), F.col(item).alias("item"))
        .where(F.col("basket").isNotNull() & F.col("item").isNotNull() & (F.col("item").cast("string") != ""))
        .distinct(),
        "incidence",
    )
    support = incidence.groupBy("item").agg(F.count(F.lit(1)).alias("support")).where(F.col("support") >= max(1, min_count))
    if min_lift > 0:
        support = support.where(F.col("support") * F.lit(float(min_lift)) <= F.lit(float(baskets_in_all)))
    items = materialize(_coded_items(support), "coded_items")
    total = int(items.agg(F.sum("support")).first()[0] or 0)
    coded = materialize(hot_split_join(incidence, items, "item", "support", total).select("basket", "code"), "coded")  # read three times
    blocks = _blocks(coded, "basket", ordinary, chunk)
    inner = blocks.where(F.col("ys").isNull()).select(
        F.posexplode("xs").alias("pos", "a"), "xs"
    ).select("a", F.explode(F.slice("xs", F.col("pos") + 2, F.size("xs"))).alias("b"))
    outer = blocks.where(F.col("ys").isNotNull()).select(F.explode("xs").alias("x"), "ys").select(
        "x", F.explode("ys").alias("y")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    total_n = F.lit(float(baskets_in_all))
    s_a, s_b = F.shiftright("a", _NUMBER), F.shiftright("b", _NUMBER)
    counts = inner.unionByName(outer).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    # Both supports are in the codes: pairs are tested before anything is joined to them.
    kept = counts.where((F.col("n") >= min_count) & (F.col("n") * total_n >= F.lit(float(min_lift)) * s_a * s_b))
    names = items.select("code", "item", "support")
    named = (
        kept.join(names.toDF("a", "item_a", "s_a"), "a")
        .join(names.toDF("b", "item_b", "s_b"), "b")
        .select(
            F.least("item_a", "item_b").alias("id_a"),
            F.greatest("item_a", "item_b").alias("id_b"),
            "n",
            F.when(F.col("item_a") < F.col("item_b"), F.col("s_a")).otherwise(F.col("s_b")).alias("n_a"),
            F.when(F.col("item_a") < F.col("item_b"), F.col("s_b")).otherwise(F.col("s_a")).alias("n_b"),
        )
    )
    lift = F.col("n") * total_n / (F.col("n_a") * F.col("n_b"))
    npmi = F.when(F.col("n") >= total_n, F.lit(1.0)).otherwise(F.log(lift) / -F.log(F.col("n") / total_n))
    return named.withColumn("lift", lift).withColumn("npmi", npmi)


def shared_playlists(playlists: DataFrame, min_count: int = 5, min_lift: float = 5.0) -> DataFrame:
    """Artists credited in the same playlists; a playlist is its id and credits whom any of its rows credits."""
    n = playlists.where(F.col("id").isNotNull()).select("id").distinct().count()
    per_row = playlists.select(
        "id",
        F.explode(F.array_distinct(F.filter(F.col("tracks.artist_id"), lambda a: a.isNotNull() & (a != "")))).alias("artist_id"),
    )
    return pair_association(per_row, "id", "artist_id", n, min_count, min_lift)
