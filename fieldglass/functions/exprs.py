"""Column expressions with the engine's rules for missing values: unknown is never zero, and nothing divides by zero."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

EARTH_MILES = 3958.8
ColumnOrName = Column | str


def col(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ratio(a: ColumnOrName, b: ColumnOrName, scale: float = 1.0) -> Column:
    """a / b * scale; null where the denominator is missing or not above 0."""
    return F.when(col(b) > 0, col(a) / col(b) * F.lit(float(scale)))


def smoothed(a: ColumnOrName, b: ColumnOrName) -> Column:
    """a for each b, of which one more is counted so that none is no special case."""
    return col(a) / (col(b) + F.lit(1.0))


def half_up(x: ColumnOrName) -> Column:
    """The whole number nearest to x, halves upwards, also below 0."""
    return F.floor(col(x) + F.lit(0.5))


def clamp(x: ColumnOrName, low: float = 0, high: float = 100) -> Column:
    """x within bounds; null stays null."""
    return F.when(col(x).isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), col(x))))


def measured(x: ColumnOrName) -> Column:
    """Text or number as a double; blanks, negative sentinels and what isn't finite are missing."""
    value = F.expr(f"try_cast({x} as double)") if isinstance(x, str) else x.cast("double")
    return F.when((value >= 0) & ~F.isnan(value) & (value < F.lit(float("inf"))), value)


def log_score(n: ColumnOrName, full: float) -> Column:
    """0 to 100, by the logarithm of a count; `full` and more is 100."""
    return F.when(col(n).isNotNull(), F.least(F.lit(100.0), half_up(F.log1p(col(n)) / F.log1p(F.lit(float(full))) * 100).cast("double")))


def agreement(a: ColumnOrName, b: ColumnOrName, weight: float) -> Column:
    """100 less the weighted difference, at least 0; null where either is missing."""
    return F.when(col(a).isNotNull() & col(b).isNotNull(), F.greatest(F.lit(0.0), half_up(100 - F.abs(col(a) - col(b)) * weight).cast("double")))


def consensus(a: ColumnOrName, b: ColumnOrName, within: float = 4) -> Column:
    """The mean of two sources that agree."""
    return F.when(F.abs(col(a) - col(b)) <= within, (col(a) + col(b)) / 2)


def mid_rank(value: ColumnOrName, *groups: ColumnOrName, least: int = 1) -> Column:
    """The share of the group below, with half of the equals, times 100; null in groups of fewer than `least` values."""
    by = Window.partitionBy(*groups)
    below = F.rank().over(by.orderBy(col(value).asc_nulls_last())) - 1
    same = F.count(col(value)).over(Window.partitionBy(*groups, value))
    n = F.count(col(value)).over(by)
    return F.when(col(value).isNotNull() & (n >= least), (below + same / 2) / n * 100)


def lower_rank(value: ColumnOrName, *groups: ColumnOrName) -> Column:
    """The share of the group below, times 100."""
    by = Window.partitionBy(*groups)
    return F.when(col(value).isNotNull(), (F.rank().over(by.orderBy(col(value).asc_nulls_last())) - 1) / F.count(col(value)).over(by) * 100)


def upper_median(value: str) -> Column:
    """Aggregate: the middle value, of two the greater, as a double. Values are counted, not gathered in a list."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {value} DESC)")


def whole_sum(value: ColumnOrName) -> Column:
    """Aggregate: the sum, missing if any addend is."""
    return F.when(F.count(F.lit(1)) == F.count(col(value)), F.sum(col(value)))


def weighted_mean(value: ColumnOrName, weight: ColumnOrName) -> Column:
    """Aggregate: the mean by weight, rounded, weights below 0 as 0; the plain mean, rounded, where all weights are 0."""
    own = F.when(col(value).isNotNull(), F.greatest(col(weight), F.lit(0)))
    total = F.sum(own)
    return half_up(F.when(total > 0, F.sum(col(value) * own) / total).otherwise(F.avg(col(value)))).cast("double")


def miles(lat1: ColumnOrName, lon1: ColumnOrName, lat2: ColumnOrName, lon2: ColumnOrName) -> Column:
    """Great-circle distance."""
    a, b = F.radians(col(lat1)), F.radians(col(lat2))
    h = F.pow(F.sin((b - a) / 2), F.lit(2.0)) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(col(lon2) - col(lon1)) / 2), F.lit(2.0))
    return F.lit(2 * EARTH_MILES) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def disc_weight(distance: ColumnOrName, radius: ColumnOrName, area: ColumnOrName) -> Column:
    """The share of a round area of that size whose centre is so far off that a circle of the radius covers, about.

    It falls linearly from all to nothing while the rims cross; an area larger than the circle never counts for more than
    the circle's share of it. Areas count as 0.05 at least.
    """
    own = F.sqrt(F.greatest(col(area), F.lit(0.05)) / F.lit(3.141592653589793))
    r = col(radius)
    most = F.least(F.lit(1.0), F.pow(r / own, F.lit(2.0)))
    return most * clamp((own + r - col(distance)) / (2 * F.least(own, r)), 0.0, 1.0)
