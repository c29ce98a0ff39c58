"""Joins of many rows with ranges of a number, without comparing every row with every range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A stretch of the next level holds so many of the one below.
FANOUT = 8


def pieces(ranges: DataFrame, low: str, high: str, width: float) -> DataFrame:
    """ranges, each once for every stretch it touches, with _level and _stretch; those with a null or NaN end, or with none between them, go.

    Stretches of level 0 are ``width`` wide, those of each further level FANOUT times as wide. A range is cut at the level at which it
    is FANOUT stretches long at most, so that it has no more than FANOUT + 1 pieces, however long it is.
    """
    usable = ranges.where((F.col(low) <= F.col(high)) & ~F.isnan(F.col(low).cast("double")) & ~F.isnan(F.col(high).cast("double")))
    length = (F.col(high) - F.col(low)).cast("double") / width
    level = F.when(length <= FANOUT, F.lit(0)).otherwise(F.ceil(F.log(length) / F.log(F.lit(float(FANOUT)))) - 1).cast("int")
    levelled = usable.withColumn("_level", level)
    stretch = lambda c: F.floor(F.col(c).cast("double") / (width * F.pow(F.lit(float(FANOUT)), F.col("_level"))))
    return levelled.withColumn("_stretch", F.explode(F.sequence(stretch(low), stretch(high))))


def in_ranges(rows: DataFrame, value: Column, ranges: DataFrame, low: str, high: str, width: float) -> DataFrame:
    """Inner join of rows with every range low <= value <= high that holds their value.

    A row meets the pieces (see there) of its own stretch by an equi-join, once for each level at which there are ranges, then the
    exact comparison. Pieces are few and broadcast if Spark finds them small; if not, both sides are shuffled by
    stretch, and what falls on a hot one can be split, as nothing of it must stay together. A null or
    NaN value matches nothing. ``ranges`` loses no column; overlaps all match.
    """
    cut = pieces(ranges, low, high, width)
    # One row: the levels, no more than the logarithm of the longest range.
    levels = cut.agg(F.collect_set("_level").alias("_levels"))
    held = rows.withColumn("_value", value.cast("double")).where(F.col("_value").isNotNull() & ~F.isnan("_value"))
    probes = held.join(F.broadcast(levels)).withColumn("_level", F.explode("_levels")).drop("_levels")
    probes = probes.withColumn("_stretch", F.floor(F.col("_value") / (width * F.pow(F.lit(float(FANOUT)), F.col("_level")))))
    joined = probes.join(cut, ["_level", "_stretch"])
    return joined.where((F.col("_value") >= F.col(low)) & (F.col("_value") <= F.col(high))).drop("_level", "_stretch", "_value")
