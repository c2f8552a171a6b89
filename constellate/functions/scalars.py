"""Numbers: popularity, sizes, colours, weights, formats.  Plain column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def compact_count(n: Column) -> Column:
    """264K, 2.3M: one decimal below ten, whole (half to even) from ten on; null counts as 0."""
    v = F.coalesce(n, F.lit(0)).cast("double")

    def scaled(unit: float, sign: str) -> Column:
        x = v / unit
        return F.concat(F.when(x < 10, F.format_number(x, 1)).otherwise(F.bround(x, 0).cast("bigint").cast("string")), F.lit(sign))

    return F.when(v >= 1e6, scaled(1e6, "M")).when(v >= 1e3, scaled(1e3, "K")).otherwise(v.cast("bigint").cast("string"))


def compact_count_one_decimal(n: Column) -> Column:
    """264.0K, 2.3M: always one decimal, grouped digits below a thousand; null counts as 0."""
    v = F.coalesce(n, F.lit(0)).cast("double")
    one = lambda x: F.replace(F.format_number(x, 1), F.lit(","), F.lit(""))
    return F.when(v >= 1e6, F.concat(one(v / 1e6), F.lit("M"))).when(v >= 1e3, F.concat(one(v / 1e3), F.lit("K"))).otherwise(v.cast("bigint").cast("string"))


def log_popularity(n: Column) -> Column:
    """5 to 100: share of log10 in 8 decades, half to even."""
    v = F.coalesce(n, F.lit(0)).cast("double")
    return F.when(v <= 0, F.lit(5)).otherwise(F.least(F.lit(100), F.greatest(F.lit(5), F.bround(100.0 * F.log10(F.greatest(F.lit(1.0), v)) / 8.0, 0).cast("int"))))


def reach_floor(n: Column) -> Column:
    return F.greatest(F.lit(1000), F.coalesce(n, F.lit(0)))


def _share(x: Column, low: Column, high: Column) -> Column:
    return F.when(high > low, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - low) / (high - low)))).otherwise(F.lit(0.0))


def node_size(n: Column, low: Column, high: Column) -> Column:
    """Drawn size by reach: 1.1 to 14.5, along log10 between the least and greatest reach, one decimal."""
    lg = lambda c: F.log10(c.cast("double"))
    return F.round(1.1 + 13.4 * F.pow(_share(lg(n), lg(low), lg(high)), F.lit(2.6)), 1)


def node_radius(n: Column, low: Column, high: Column) -> Column:
    """Layout radius by reach: 1.1 to 16.1, along the square root."""
    rt = lambda c: F.sqrt(c.cast("double"))
    return 1.1 + 15.0 * F.pow(_share(rt(n), rt(low), rt(high)), F.lit(1.3))


def draw_diameter(degree: Column) -> Column:
    return 7.0 + 5.0 * degree + 0.42 * F.pow(degree.cast("double"), F.lit(1.55))


def edge_size(weight: Column) -> Column:
    return F.greatest(F.lit(0.08), F.round(0.9 * weight, 2))


def zoom_scale(zoom: Column) -> Column:
    """Scale of drawn sizes at a zoom level: 1 without one, 0.15 to 3.5, steeper below 2.2 than above."""
    ratio = zoom / 2.2
    scale = F.when(ratio >= 1, F.least(F.lit(3.5), F.pow(ratio, 0.45))).otherwise(F.greatest(F.lit(0.15), F.pow(ratio, 0.75)))
    return F.when(zoom.isNull() | (zoom == 0) | F.isnan(zoom), 1.0).otherwise(scale)


def bar_percent(x: Column, most: Column) -> Column:
    """Length of a bar: 12 to 100 percent of the longest, cut to whole percents."""
    return F.when(most > 0, F.greatest(F.lit(12), F.least(F.lit(100), F.floor(100.0 * x / most).cast("int")))).otherwise(F.lit(12))


def link_opacity(share: Column) -> Column:
    return 0.1 + 0.3 * share


def title_score(coverage: Column, overall: Column) -> Column:
    """How well a label names a community: its coverage there against its coverage in all."""
    return F.pow(coverage, F.lit(0.8)) * F.log(1.0 + coverage / (overall + 0.02))


# Saturation and lightness of the colour tiers.
TIERS = [(55, 72), (84, 46), (75, 62), (58, 52)]


def _pick(values: list[float], at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), (at % len(values) + 1).cast("int"))


def _rgb(hue: Column, saturation: Column, lightness: Column) -> list[Column]:
    """Red, green and blue (0 to 1) of a colour; ``hue`` in degrees."""
    c = (1.0 - F.abs(2.0 * lightness - 1.0)) * saturation
    h = hue / 60.0
    x = c * (1.0 - F.abs(F.pmod(h, F.lit(2.0)) - 1.0))
    m = lightness - c / 2.0
    z = F.lit(0.0)
    by_sector = [(c, x, z), (x, c, z), (z, c, x), (z, x, c), (x, z, c), (c, z, x)]
    out = []
    for k in range(3):
        e = F.when(h < 1, by_sector[0][k])
        for s in range(1, 5):
            e = e.when(h < s + 1, by_sector[s][k])
        out.append(e.otherwise(by_sector[5][k]) + m)
    return out


def _hex(channels: list[Column]) -> Column:
    return F.concat(F.lit("#"), *[F.lpad(F.hex(c.cast("bigint")), 2, "0") for c in channels])


def community_colour(number: Column, seed: int = 56, angle: float = 137.507764) -> Column:
    """Colour of a community by the golden angle, channels cut to whole numbers."""
    n = number.cast("double")
    hue = F.pmod(n * angle + seed * 83.17, F.lit(360.0))
    tier = number.cast("int") + seed
    return _hex([F.floor(c * 255.0 + 1e-9) for c in _rgb(hue, _pick([s / 100 for s, _ in TIERS], tier), _pick([v / 100 for _, v in TIERS], tier))])


def community_colour_rounded(number: Column, seed: int = 46, angle: float = 137.508) -> Column:
    """As :func:`community_colour`, with hue and channels rounded half up, as the map shows it."""
    n = number.cast("double")
    up = lambda c: F.floor(c + 0.5)
    hue = up(F.pmod(n * angle + seed * 83.17, F.lit(360.0)))
    tier = number.cast("int") + seed
    return _hex([up(c * 255.0) for c in _rgb(hue, _pick([s / 100 for s, _ in TIERS], tier), _pick([v / 100 for _, v in TIERS], tier))])
