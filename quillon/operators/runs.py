"""Masks as runs: (keys, y, x0, x1), a row for each stretch of covered places of a line, both ends included.

Components, areas, boxes, the filters by them, polygons as masks and overlaps of masks are joins and aggregates of runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.graph import components
from quillon.operators.scratch import Scratch


def runs_of_lines(lines: DataFrame, cells: str = "cells") -> DataFrame:
    """The runs of lines (keys, y, an array of booleans); null counts as not covered."""
    on = lambda i: F.coalesce(F.get(cells, i), F.lit(False))
    places = F.sequence(F.lit(0), F.size(cells))
    begins = F.filter(places, lambda i: on(i) & ~on(i - 1))
    ends = F.filter(places, lambda i: on(i) & ~on(i + 1))
    each = lines.where(F.size(cells) > 0).withColumn("_run", F.explode(F.arrays_zip(begins.alias("x0"), ends.alias("x1"))))
    return each.select(*[c for c in lines.columns if c != cells], "_run.x0", "_run.x1")


def merged(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Runs that overlap or adjoin within a line as one. Rows are sorted once, and nothing is held but the line at hand."""
    line = Window.partitionBy(*keys, "y").orderBy("x0", "x1")
    reached = runs.select(*keys, "y", "x0", "x1", F.max("x1").over(line.rowsBetween(Window.unboundedPreceding, 0)).alias("_reach"))
    opens, closes = F.col("x0") > F.lag("_reach").over(line) + 1, F.lead("x0").over(line) > F.col("_reach") + 1
    ends = reached.withColumns({"_opens": F.coalesce(opens, F.lit(True)), "_closes": F.coalesce(closes, F.lit(True))}).where("_opens or _closes")
    whole = ends.withColumn("_end", F.when(F.col("_closes"), F.col("_reach")).otherwise(F.lead("_reach").over(line))).where("_opens")
    return whole.select(*keys, "y", "x0", F.col("_end").alias("x1"))


def labelled(runs: DataFrame, keys: list[str], diagonal: bool = True) -> DataFrame:
    """Runs with ``component``, a number that connected runs of a mask share; with ``diagonal`` a common corner connects.

    Runs of neighbouring lines that overlap are edges, found by an equi-join on the line; components of that graph are the labels.
    """
    scratch, more = Scratch(runs.sparkSession, "runs"), int(diagonal)
    every = scratch.table(runs.select(*keys, "y", "x0", "x1", F.monotonically_increasing_id().alias("run")), "runs")
    above = every.select(*keys, (F.col("y") + 1).alias("y"), F.col("x0").alias("a0"), F.col("x1").alias("a1"), F.col("run").alias("other"))
    edges = every.join(above, [*keys, "y"]).where((F.col("a0") <= F.col("x1") + more) & (F.col("x0") <= F.col("a1") + more))
    labels = components(edges.select(F.col("run").alias("u"), F.col("other").alias("v")), scratch, "labels").withColumnRenamed("node", "run")
    return every.join(labels, "run", "left").select(*keys, "y", "x0", "x1", F.coalesce("component", "run").alias("component"))


def component_table(labels: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, component, area, left, top, right, bottom) of each component, ends included."""
    return labels.groupBy(*keys, "component").agg(
        F.sum(F.col("x1") - F.col("x0") + 1).alias("area"), F.min("x0").alias("left"), F.min("y").alias("top"), F.max("x1").alias("right"), F.max("y").alias("bottom")
    )


def _kept(labels: DataFrame, keys: list[str], boxes: DataFrame, keep: Column) -> DataFrame:
    return labels.join(boxes.where(keep).select("component"), "component", "left_semi").select(*keys, "y", "x0", "x1", "component")


def without_small(labels: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Labelled runs without components of fewer places than ``least``."""
    return labels if least <= 0 else _kept(labels, keys, component_table(labels, keys), F.col("area") >= least)


def without_wall_lines(labels: DataFrame, keys: list[str], width: int | DataFrame, share: float = 0.80, most_height: int = 12) -> DataFrame:
    """Labelled runs without components as wide as ``share`` of the mask and at most ``most_height`` high. ``width``: of all masks, or a table (keys, width)."""
    boxes = component_table(labels, keys)
    boxes = boxes.withColumn("width", F.lit(width)) if isinstance(width, int) else boxes.join(width.select(*keys, "width"), keys)
    wide = F.col("right") - F.col("left") + 1 >= share * F.col("width")
    return _kept(labels, keys, boxes, ~(wide & (F.col("bottom") - F.col("top") + 1 <= most_height)))


def runs_of_places(places: DataFrame, keys: list[str]) -> DataFrame:
    """The runs of covered places (keys, y, x), each given once."""
    island = F.col("x") - F.row_number().over(Window.partitionBy(*keys, "y").orderBy("x"))
    return places.withColumn("_island", island).groupBy(*keys, "y", "_island").agg(F.min("x").cast("int").alias("x0"), F.max("x").cast("int").alias("x1")).drop("_island")


def flipped(runs: DataFrame, frames: DataFrame, keys: list[str]) -> DataFrame:
    """The runs of the places that are not covered, within frames (keys, height, width)."""
    held = runs.groupBy(*keys, "y").agg(F.sort_array(F.collect_list(F.struct("x0", "x1"))).alias("r"))
    lines = frames.select(*keys, F.col("width").alias("w"), F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("y"))
    joined = lines.join(held, [*keys, "y"], "left").withColumn("r", F.coalesce("r", F.array().cast("array<struct<x0: int, x1: int>>")))
    begins = F.concat(F.array(F.lit(0)), F.transform("r", lambda x: x["x1"] + 1))
    ends = F.concat(F.transform("r", lambda x: x["x0"] - 1), F.array(F.col("w") - 1))
    return joined.select(*keys, "y", F.explode(F.arrays_zip(begins.alias("x0"), ends.alias("x1"))).alias("g")).select(*keys, "y", "g.x0", "g.x1").where("x0 <= x1")


def grown(runs: DataFrame, frames: DataFrame, keys: list[str]) -> DataFrame:
    """Runs with the places above, below and beside them that lie within frames."""
    more = F.explode(F.array(*[F.struct((F.col("y") + dy).alias("y"), (F.col("x0") - dx).alias("x0"), (F.col("x1") + dx).alias("x1")) for dy, dx in ((-1, 0), (0, 1), (1, 0))]))
    moved = runs.select(*keys, more.alias("m")).join(frames.select(*keys, "height", "width"), keys).where("m.y >= 0 and m.y < height")
    held = moved.select(*keys, F.col("m.y").alias("y"), F.greatest("m.x0", F.lit(0)).alias("x0"), F.least("m.x1", F.col("width") - 1).alias("x1"))
    return merged(held, keys)


def closed(runs: DataFrame, frames: DataFrame, keys: list[str]) -> DataFrame:
    """Runs after growing and shrinking by a place; what lies beyond the frame doesn't shrink them."""
    return flipped(grown(flipped(grown(runs, frames, keys), frames, keys), frames, keys), frames, keys)


def cleaned(runs: DataFrame, frames: DataFrame, keys: list[str], min_area: int, clear_top: int) -> DataFrame:
    """A predicted mask without its top lines, closed, without small components (that touch by sides) and without wall lines."""
    whole = closed(runs.where(F.col("y") >= clear_top), frames, keys)
    left = without_small(labelled(whole, keys, diagonal=False), keys, min_area).drop("component")
    return without_wall_lines(labelled(left, keys), keys, frames).drop("component")


def column_counts(runs: DataFrame, frames: DataFrame, keys: list[str]) -> DataFrame:
    """frames (keys, height, width) with col_counts: covered places of each column, from the columns where runs begin and end."""
    steps = runs.select(*keys, F.explode(F.array(F.struct(F.col("x0").alias("x"), F.lit(1).alias("n")), F.struct((F.col("x1") + 1).alias("x"), F.lit(-1).alias("n")))).alias("s"))
    each = steps.groupBy(*keys, F.col("s.x").alias("x")).agg(F.sum("s.n").alias("n"))
    held = each.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("x", "n"))).alias("m"))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.array().cast("array<int>").alias("c"))

    def add(s: Column, x: Column) -> Column:
        n = s["n"] + F.coalesce(F.try_element_at("m", x), F.lit(0))
        return F.struct(n.alias("n"), F.concat(s["c"], F.array(n.cast("int"))).alias("c"))

    counts = F.aggregate(F.sequence(F.lit(0), F.col("width") - 1), start, add)["c"]
    return frames.join(held, keys, "left").select(*frames.columns, counts.alias("col_counts"))


def overlap(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, a, b, both): places of two masks whose own runs don't overlap, and places they share; a mask that is missing has none."""
    of = lambda runs, name: runs.groupBy(*keys).agg(F.sum(F.col("x1") - F.col("x0") + 1).alias(name))
    other = b.select(*keys, "y", F.col("x0").alias("b0"), F.col("x1").alias("b1"))
    common = a.join(other, [*keys, "y"]).select(*keys, (F.least("x1", "b1") - F.greatest("x0", "b0") + 1).alias("n")).where("n > 0")
    found = of(a, "a").join(of(b, "b"), keys, "full").join(common.groupBy(*keys).agg(F.sum("n").alias("both")), keys, "left")
    return found.fillna(0, ["a", "b", "both"])


def polygon_runs(polygons: DataFrame, keys: list[str], width: Column, height: Column, points: str = "points") -> DataFrame:
    """The places inside polygons (keys, an array of structs x and y) or on their outlines, within width and height, as merged runs of each set of keys.

    Of every line the crossings with the edges are sorted, and covered from each odd one to the next; outlines are points
    along the edges, a place apart at most. A polygon's own runs are merged in its row, as numbers (line and place, the end
    excluded) in arrays as long as its outline, so that only runs are shuffled. Several polygons under the same keys are united.
    """
    sized = polygons.select(*keys, F.col(points).alias("p"), width.cast("int").alias("w"), height.cast("int").alias("h")).where(F.size("p") > 0)
    following = F.concat(F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(0))), F.slice("p", 1, 1))
    n = lambda a, b: F.floor(F.greatest(F.abs(b["x"] - a["x"]), F.abs(b["y"] - a["y"]))) + 1
    edges = F.zip_with("p", following, lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2"), n(a, b).alias("n")))
    edges = F.transform(edges, lambda e: F.struct(*[e[c].alias(c) for c in ("x1", "y1", "x2", "y2", "n")], ((e["x2"] - e["x1"]) / e["n"]).alias("dx"), ((e["y2"] - e["y1"]) / e["n"]).alias("dy")))
    place = lambda y, x: F.shiftleft(y.cast("long"), 32) + x.cast("long")

    def crossings(e: Column) -> Column:
        first = F.greatest(F.ceil(F.least(e["y1"], e["y2"])), F.lit(0))
        last = F.least(F.ceil(F.greatest(e["y1"], e["y2"])) - 1, F.col("h") - 1)
        at = lambda y: (e["x2"] - e["x1"]) * (y - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"]
        within = lambda y: F.least(F.greatest(F.ceil(at(y)), F.lit(0)), F.col("w"))
        return F.when(first <= last, F.transform(F.sequence(first, last), lambda y: place(y, within(y)))).otherwise(F.array().cast("array<bigint>"))

    def steps(e: Column, a: str, d: str, size: str) -> tuple[Column, Column]:
        """The first and last step along an edge that may lie within the mask, by one coordinate."""
        at = [(F.lit(-1) - e[a]) / e[d], (F.col(size) - e[a]) / e[d]]
        return F.when(e[d] == 0, F.lit(0)).otherwise(F.floor(F.least(*at))), F.when(e[d] == 0, e["n"]).otherwise(F.ceil(F.greatest(*at)))

    def outline(e: Column) -> Column:
        (x0, x1), (y0, y1) = steps(e, "x1", "dx", "w"), steps(e, "y1", "dy", "h")
        first, last = F.greatest(x0, y0, F.lit(0)), F.least(x1, y1, e["n"])
        on = lambda i, a, b, d: F.rint(F.when(i == e["n"], e[b]).otherwise(e[a] + i * e[d]))
        each = F.transform(F.sequence(first, last), lambda i: F.struct(on(i, "y1", "y2", "dy").alias("y"), on(i, "x1", "x2", "dx").alias("x")))
        held = F.filter(each, lambda q: (q["x"] >= 0) & (q["x"] < F.col("w")) & (q["y"] >= 0) & (q["y"] < F.col("h")))
        return F.when(first <= last, F.transform(held, lambda q: place(q["y"], q["x"]))).otherwise(F.array().cast("array<bigint>"))

    of_edges = sized.select(*keys, "w", "h", edges.alias("e"))
    placed = of_edges.select(*keys, F.sort_array(F.flatten(F.transform("e", crossings))).alias("c"), F.flatten(F.transform("e", outline)).alias("o"))
    begins = F.sort_array(F.concat(F.filter("c", lambda _, i: i % 2 == 0), "o"))
    ends = F.sort_array(F.concat(F.filter("c", lambda _, i: i % 2 == 1), F.transform("o", lambda v: v + 1)))
    # Between the i-th end and the next begin in order nothing is covered just where that begin is the larger; the first begin and the last end stand alone.
    gaps = F.filter(F.arrays_zip(begins.alias("b"), F.concat(F.array(F.lit(None).cast("bigint")), ends).alias("e")), lambda g: F.coalesce(g["b"] > g["e"], F.lit(True)))
    whole = F.zip_with("g", F.slice("g", 2, F.size("g")), lambda a, b: F.struct(a["b"].alias("b"), b["e"].alias("e")))
    each = placed.select(*keys, gaps.alias("g")).select(*keys, F.explode(whole).alias("r")).where("r.b < r.e")
    low = lambda c: F.col(c).bitwiseAND(F.lit(2**32 - 1)).cast("int")
    return merged(each.select(*keys, F.shiftright("r.b", 32).cast("int").alias("y"), low("r.b").alias("x0"), (low("r.e") - 1).alias("x1")), keys)
