"""Joins that Spark has no syntax for."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _unused(name: str, *columns: list[str]) -> str:
    """name, with underscores before it until no column has it."""
    taken = {c.lower() for some in columns for c in some}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_on: str, right_on: str, take: list[str]) -> DataFrame:
    """left with the take columns of the last right row of the same key whose right_on is not after left_on, else nulls.

    One shuffle on the key and one sort: both sides lie in one relation in order of time, and each left row takes the
    last right row before it. Of right rows of equal time the greatest by take is the last. Null keys and times match none.
    """
    at, side, row, taken, last = (_unused(n, left.columns, right.columns) for n in ("_at", "_side", "_row", "_take", "_last"))
    r = right.where(F.col(right_on).isNotNull()).select(*by, F.col(right_on).alias(at), F.lit(0).alias(side), F.struct(*take).alias(taken))
    names = [c for c in left.columns if c not in by]
    l = left.select(*by, F.col(left_on).alias(at), F.lit(1).alias(side), F.struct(*names).alias(row))
    both = l.unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy(F.col(at).asc_nulls_first(), side, taken).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn(last, F.last(taken, ignorenulls=True).over(w)).where(F.col(side) == 1)
    known = F.col(at).isNotNull()
    for k in by:
        known &= F.col(k).isNotNull()
    return found.select(*by, *(F.col(f"{row}.{c}").alias(c) for c in names), *(F.when(known, F.col(f"{last}.{c}")).alias(c) for c in take))


def range_join(points: DataFrame, ranges: DataFrame, at: str, start: str, end: str, width: float) -> DataFrame:
    """points with every range that holds them (start <= at < end), as an equality join on bins of the given width.

    A range is copied to each bin that it touches, so width should be about a typical range's length; results don't
    depend on it. Values are numbers; nulls match nothing."""
    own = _unused("_bin", points.columns, ranges.columns)
    bins = F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))
    spread = ranges.where(F.col(start) <= F.col(end)).withColumn(own, F.explode(bins))
    binned = points.withColumn(own, F.floor(F.col(at) / width))
    return binned.join(spread, own).where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop(own)
