"""Trends from blocks, one per day, that late points change one at a time.

A point's position in a series shifts with every point before it, so a late point seems to move all later ones. A block keeps
what does not shift: its number of points n, the sum of their counts y, and the sum of i * y with i counted within the block.
Moved by an offset o, sum (i + o) y is sum i y + o sum y. Blocks therefore combine in order, exactly and associatively, and the
least-squares slope follows from one combined block; only the blocks of changed days are made again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import metrics as M

BLOCKS = "day date, n long, sum_y decimal(38,0), sum_iy decimal(38,0)"
EXACT, SMALL = "decimal(38,0)", "decimal(19,0)"


def _placed(blocks: DataFrame, window) -> DataFrame:
    """The blocks with ``offset``, the points of the blocks before them in the window."""
    before = window.rowsBetween(Window.unboundedPreceding, -1)
    return blocks.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)))


def _sums() -> list[Column]:
    """One block from placed ones."""
    moved = F.col("sum_iy") + (F.col("offset").cast(SMALL) * F.col("sum_y").cast(SMALL)).cast(EXACT)
    return [F.sum("n").cast("long").alias("n"), F.sum("sum_y").cast(EXACT).alias("sum_y"), F.sum(moved).cast(EXACT).alias("sum_iy")]


def date_blocks(daily: DataFrame, period: str, count: str) -> DataFrame:
    """Blocks of a series of days: a point each."""
    return daily.where(F.col(period).isNotNull()).select(
        F.col(period).alias("day"), F.lit(1).cast("long").alias("n"), F.col(count).cast(EXACT).alias("sum_y"), F.lit(0).cast(EXACT).alias("sum_iy"))


def time_blocks(series: DataFrame, period: str, count: str) -> DataFrame:
    """Blocks of a series of distinct times, by way of a block per second; no window is larger than a second or a day of seconds."""
    second = F.date_trunc("second", period)
    points = series.where(F.col(period).isNotNull()).select(
        F.to_date(period).alias("day"), second.alias("second"), F.col(period).alias("at"), F.lit(1).cast("long").alias("n"),
        F.col(count).cast(EXACT).alias("sum_y"), F.lit(0).cast(EXACT).alias("sum_iy"))
    seconds = _placed(points, Window.partitionBy("day", "second").orderBy("at")).groupBy("day", "second").agg(*_sums())
    return _placed(seconds, Window.partitionBy("day").orderBy("second")).groupBy("day").agg(*_sums())


def replaced(blocks: DataFrame, changed: DataFrame) -> DataFrame:
    """``blocks`` with those of the days in ``changed`` in their place; a changed day without points has no block."""
    return blocks.join(changed.select("day"), "day", "left_anti").unionByName(changed).where("n > 0")


def combined(blocks: DataFrame) -> DataFrame:
    """One block for the whole series. The window has a row per day."""
    return _placed(blocks.where("n > 0"), Window.orderBy("day")).agg(*_sums())


def trend_of_blocks(blocks: DataFrame, name: str) -> DataFrame:
    """The least-squares slope of counts over positions, held within [-1, 1]; zero for fewer than two points. One row.

    With positions 0..n-1 the slope is 6 (2 sum i y - (n - 1) sum y) / (n (n^2 - 1)); the numerator is exact.
    """
    rise = F.col("sum_iy") * 2 - (F.col("n") - 1).cast(SMALL) * F.col("sum_y").cast(SMALL)
    n = F.col("n").cast("double")
    slope = F.when(F.col("n") > 1, F.lit(6.0) * rise.cast("double") / (n * (n * n - 1)))
    return combined(blocks).select(M.clamp_trend(F.round(slope, 9)).alias(name))
