"""Rows at given places of an order within groups, without numbering all rows: exact selection of several order statistics.

Splitters drawn from a sample cut the order into ranges. A histogram of the ranges, by group, says in which of
them each wanted place lies, and where in it. Ranges with a wanted place that are small enough are sorted; each larger one
is cut by splitters of its own, and so on. A round reads what the one before left, about a SPLITTERS-th for each wanted place.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.numbering import order_key
from quillon.operators.scratch import Scratch

#: Ranges of a round, rows sampled for each, and the rows of a range that are sorted together.
SPLITTERS, SAMPLED, SMALL = 256, 16, 1 << 16


def splitters(rows: DataFrame) -> DataFrame:
    """One row with one array, _edges: some of the rows' keys (a column _key), ascending, fewer than SPLITTERS."""
    sample = rows.select("_key").orderBy(F.rand(7)).limit(SPLITTERS * SAMPLED).agg(F.sort_array(F.collect_list("_key")).alias("s"))
    return sample.select(F.filter("s", lambda _, i: (i > 0) & (i % SAMPLED == 0)).alias("_edges"))


def splitters_of_cells(rows: DataFrame, cells: DataFrame, seed: int) -> DataFrame:
    """(_c, _edges) for each of the cells (_c, _n: number of its rows), about half of SPLITTERS of its rows' keys."""
    drawn = rows.join(cells.select("_c", "_n"), "_c").where(F.rand(seed) * F.col("_n") < SPLITTERS // 2)
    each = cells.select("_c").join(drawn.groupBy("_c").agg(F.sort_array(F.collect_list("_key")).alias("_edges")), "_c", "left")
    return each.select("_c", F.slice(F.coalesce("_edges", F.array().cast(each.schema["_edges"].dataType)), 1, SPLITTERS - 1).alias("_edges"))


def placed_among(rows: DataFrame) -> DataFrame:
    """rows (_key and ascending _edges) with _r for _edges: how many of these are not above the key, by binary search."""
    step = SPLITTERS // 2
    rows = rows.withColumn("_r", F.lit(0))
    while step:
        # Generated code, a column a step; null beyond the last edge.
        rows = rows.withColumn("_r", F.col("_r") + F.when(F.get("_edges", F.col("_r") + step - 1) <= F.col("_key"), step).otherwise(0))
        step //= 2
    return rows.drop("_edges")


def selected(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], wanted: Callable[[Column], Column]) -> DataFrame:
    """The rows of df at the places (from 0) that ``wanted`` gives, as an array, for the number of rows of their group.

    The order is ascending, nulls first; ties go by the row's hash. Nulls of ``by`` are a group. Places outside the group are passed over.
    """
    scratch = Scratch(df.sparkSession, "selected")
    group = F.struct(*[F.col(c).alias(f"b{i}") for i, c in enumerate(by)]) if by else F.struct(F.lit(0).alias("b0"))
    key = order_key(df, [*by, *order])
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    # Written once: histogram and rows must speak of the same keys.
    rows = scratch.table(df.select(row.alias("_row"), group.alias("_c"), key.alias("_key")), "rows")
    found, wants = [], None
    for i in count():
        if wants is None:
            placed = placed_among(rows.join(F.broadcast(scratch.table(splitters(rows), "edges"))))
        else:
            placed = placed_among(rows.join(scratch.table(splitters_of_cells(rows, wants, i), f"edges-{i}"), "_c"))
        hist = placed.groupBy("_c", "_r").agg(F.count("*").alias("_n"))
        if wants is None:
            wants = hist.groupBy("_c").agg(F.sum("_n").alias("_all")).select("_c", wanted(F.col("_all")).alias("_places"))
        before = F.coalesce(F.sum("_n").over(Window.partitionBy("_c").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        within = F.transform(F.filter("_places", lambda p: (p >= F.col("_before")) & (p < F.col("_before") + F.col("_n"))), lambda p: p - F.col("_before"))
        cells = hist.withColumn("_before", before).join(wants.select("_c", "_places"), "_c").select("_c", "_r", "_n", within.alias("_places")).where(F.size("_places") > 0)
        cells = scratch.table(cells.withColumn("_cell", F.monotonically_increasing_id()), f"cells-{i}")
        small, large = cells.where(F.col("_n") <= SMALL), cells.where(F.col("_n") > SMALL)
        at = F.row_number().over(Window.partitionBy("_c", "_r").orderBy("_key")) - 1
        sorted_ = placed.join(small.select("_c", "_r", "_places"), ["_c", "_r"]).withColumn("_at", at)
        found.append(sorted_.where(F.array_contains("_places", F.col("_at").cast("long"))).select("_row.*"))
        if large.isEmpty():
            break
        left = placed.join(large.select("_c", "_r", "_cell"), ["_c", "_r"]).select("_row", F.col("_cell").alias("_c"), "_key")
        rows, wants = scratch.table(left, f"rows-{i}"), large.select(F.col("_cell").alias("_c"), "_n", "_places")
    out = found[0]
    for more in found[1:]:
        out = out.unionAll(more)
    return out
