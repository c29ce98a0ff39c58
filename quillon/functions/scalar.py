"""Column functions: labels, units, bins, polygons, Gaussian scores. All are expressions that Catalyst sees through."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Prefixes of case labels with mass flow (g/s) and nominal subcooling (deg C).
NOMINAL_CASES = (("5gs", 5.0, 22.0), ("10gs", 10.0, 22.0), ("15gs", 15.0, 20.0), ("25gs", 25.0, 20.0))
# Fixed value: what a summary file's name ends in.
SUMMARY_SUFFIX = "_multimodal_state_summary.csv"
# Labels of annotated shapes that count.
SHAPE_LABELS = ("bubble", "bubble_cluster")


def parse_roi(text: Column) -> Column:
    """'x,y,w,h' with blanks allowed as a struct of ints; raises unless there are four."""
    parts = F.transform(F.split(text, ","), lambda p: F.trim(p).cast("int"))
    four = F.when(F.size(parts) == 4, parts).otherwise(F.raise_error(F.lit("a region takes four values: x,y,w,h")).cast("array<int>"))
    return F.struct(*[F.element_at(four, i + 1).alias(n) for i, n in enumerate("xywh")])


def parse_voltage(label: Column) -> Column:
    """The first unsigned decimal number anywhere in a label, null if there is none."""
    return F.nullif(F.regexp_extract(label, r"[0-9]+(?:\.[0-9]+)?", 0), F.lit("")).cast("double")


def safe_name(text: Column) -> Column:
    """Runs of characters that file names shouldn't have, as one underscore."""
    return F.regexp_replace(text, r"[^A-Za-z0-9_.\-]+", "_")


def per_square_cm(column_name: str, flux: Column) -> Column:
    """Heat flux in W/cm2: divided by 10,000 if the column's name gives W/m2."""
    return flux / 10000.0 if "W/m²" in column_name or "W/m2" in column_name else flux


def row_mean(columns: Sequence[Column]) -> Column:
    """Mean of the columns of a row that aren't null; null if none is."""
    known = F.filter(F.array(*columns), lambda x: x.isNotNull())
    return F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(known), F.lit(0))


def no_nan(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def case_label(file_name: Column) -> Column:
    return F.replace(file_name, F.lit(SUMMARY_SUFFIX), F.lit(""))


def nominal(label: Column) -> tuple[Column, Column]:
    """Mass flow and nominal subcooling by the label's prefix; null for others."""
    flow, cooling = F.lit(None).cast("double"), F.lit(None).cast("double")
    for prefix, a, b in reversed(NOMINAL_CASES):
        flow = F.when(label.startswith(prefix), F.lit(a)).otherwise(flow)
        cooling = F.when(label.startswith(prefix), F.lit(b)).otherwise(cooling)
    return flow, cooling


def canonical_label(label: Column) -> Column:
    return F.lower(F.btrim(F.coalesce(label, F.lit("")), F.lit(" \t\n\r\x0b\x0c")))


def bin_edges(width: Column, bins: int) -> Column:
    """bins + 1 integer edges over a width: floor of float steps, the last one the width itself."""
    return F.concat(F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.floor(i * (width.cast("double") / bins)).cast("int")), F.array(width.cast("int")))


def bin_center(start: Column, end: Column) -> Column:
    return 0.5 * (start + end - 1)


def scaled(value: Column, low: Column, high: Column) -> Column:
    """Min-max scaling; 0 where the column is constant, null where the value is."""
    return (value - low) / F.when(high > low, high - low).otherwise(F.lit(1.0))


def display_label(case: Column, state: Column) -> Column:
    return F.concat(case, F.lit(" | "), state)


def marker_size(voltage: Column) -> Column:
    return 40 + 1.2 * voltage


def odd_kernel(size: Column) -> Column:
    least = F.greatest(F.lit(1), size.cast("int"))
    return least + (1 - least % 2)


def axis_limit(highest: Column) -> Column:
    return F.greatest(F.lit(0.05), F.least(F.lit(1.0), 1.2 * highest))


def contact_label(file_name: Column) -> Column:
    return F.element_at(F.split(file_name, r"_192\."), 1)


def polygon_bbox(points: Column) -> Column:
    """[x, y, width, height] of an array of points (x, y)."""
    x, y = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.array(F.array_min(x), F.array_min(y), F.array_max(x) - F.array_min(x), F.array_max(y) - F.array_min(y))


def polygon_area(points: Column) -> Column:
    """Signed area by the shoelace rule; 0 of fewer than three points."""
    next_ = F.concat(F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 1, 1))
    terms = F.zip_with(points, next_, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.when(F.size(points) < 3, F.lit(0.0)).otherwise(0.5 * F.aggregate(terms, F.lit(0.0), lambda s, t: s + t))


def clamp_polygon(points: Column, x: Column, y: Column, w: Column, h: Column) -> Column:
    """Points relative to a region, each clamped into it; null if all lie outside or fewer than three differ afterwards."""
    moved = F.transform(points, lambda p: F.struct((p["x"] - x).alias("x"), (p["y"] - y).alias("y")))
    outside = F.forall(moved, lambda p: (p["x"] < 0) | (p["y"] < 0) | (p["x"] > w) | (p["y"] > h))
    held = F.transform(moved, lambda p: F.struct(F.greatest(F.lit(0.0), F.least(w.cast("double"), p["x"])).alias("x"), F.greatest(F.lit(0.0), F.least(h.cast("double"), p["y"])).alias("y")))
    return F.when(~outside & (F.size(F.array_distinct(held)) >= 3), held)


def polygon_flat(points: Column) -> Column:
    return F.flatten(F.transform(points, lambda p: F.array(p["x"], p["y"])))


def gaussian_log_density(x: Column, mean: Column, std: Column) -> Column:
    """Log density of independent normal components, of arrays of one length."""
    z = F.zip_with(F.zip_with(x, mean, lambda a, m: a - m), std, lambda d, s: F.pow(d / s, F.lit(2)) + 2 * F.log(s) + math.log(2 * math.pi))
    return -0.5 * F.aggregate(z, F.lit(0.0), lambda a, b: a + b)


def posterior(log_foreground: Column, log_background: Column, prior: Column) -> Column:
    """Probability of the foreground; the log odds are held within 60."""
    odds = (log_background + F.log(1 - prior + 1e-9)) - (log_foreground + F.log(prior + 1e-9))
    return 1 / (1 + F.exp(F.greatest(F.lit(-60.0), F.least(F.lit(60.0), odds))))
