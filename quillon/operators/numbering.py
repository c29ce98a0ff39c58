"""Numbers of rows in an order, without passing all rows through one task."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators.scratch import Scratch

#: Bits of monotonically_increasing_id that count rows within a partition.
WITHIN = 33


def order_key(df: DataFrame, order: Sequence[Column | str]) -> Column:
    """The columns of the order as one struct; ties by the row's hash, and of rows alike in all columns by where they are read."""
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    columns = [F.col(f"`{c}`") for c in df.columns]
    return F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)], F.xxhash64(*columns).alias("tie"), F.monotonically_increasing_id().alias("at"))


def numbered(df: DataFrame, order: Sequence[Column | str], name: str = "_i") -> DataFrame:
    """df with ``name``, each row's place from 0 in ascending order (nulls first) of the columns given; ties by the row's hash.

    The rows are dealt by ranges of the order, sorted there and written once, each with its range and its place in it.
    Sizes of the ranges, read from that same table, give the offsets; a number for each range is all that reaches the driver.
    """
    scratch = Scratch(df.sparkSession, "numbered")
    dealt = df.withColumn("_key", order_key(df, order)).repartitionByRange("_key").sortWithinPartitions("_key")
    written = scratch.table(dealt.drop("_key").withColumn("_at", F.monotonically_increasing_id()), "rows")
    number = F.shiftright("_at", WITHIN).cast("int")
    sizes = {r["r"]: r["n"] for r in written.groupBy(number.alias("r")).agg(F.count("*").alias("n")).collect()}
    offsets = list(accumulate((sizes.get(i, 0) for i in range(max(sizes, default=0))), initial=0))
    start = F.get(F.array(*[F.lit(x).cast("long") for x in offsets]), number)
    return written.withColumn(name, start + F.col("_at").bitwiseAND(F.lit((1 << WITHIN) - 1))).drop("_at")


def numbered_within(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], name: str = "_i", number: str = "_n") -> DataFrame:
    """df with each row's place from 0 within its group, and the group's number of rows; a group may fill any number of tasks."""
    placed = numbered(df, [*by, *order], name)
    groups = placed.groupBy(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)]).agg(F.min(name).alias("_first"), F.count("*").alias(number))
    same = [F.col(c).eqNullSafe(F.col(f"_by{i}")) for i, c in enumerate(by)]
    joined = placed.join(groups, same)
    return joined.withColumn(name, F.col(name) - F.col("_first")).drop("_first", *[f"_by{i}" for i in range(len(by))])
