"""Frames as counts of vapour pixels a column: metrics, profiles, states, sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import scalar as S
from quillon.operators.selection import selected

#: A column counts as active above this share of its pixels.
ACTIVE = 0.05


def mask_metrics(frames: DataFrame) -> DataFrame:
    """frames (height, width, col_counts) with vapor_area_fraction, active_length_fraction and vapor_front_x_px (null if no column is active)."""
    counts = F.col("col_counts")
    area = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x) / (F.col("height") * F.col("width"))
    active = F.filter(F.transform(counts, lambda x, i: F.when(x / F.col("height") > ACTIVE, i)), lambda i: i.isNotNull())
    return frames.withColumns({"vapor_area_fraction": area, "active_length_fraction": F.size(active) / F.col("width"), "vapor_front_x_px": F.array_max(active).cast("double")})


def state_summary(metrics: DataFrame) -> DataFrame:
    """Frames, means and the sample deviation of each state; the deviation of one frame is null."""
    return metrics.groupBy("state_label", "state_voltage").agg(
        F.count("frame_name").alias("image_frames"), F.avg("vapor_area_fraction").alias("vapor_area_fraction_mean"), F.stddev_samp("vapor_area_fraction").alias("vapor_area_fraction_std"),
        F.avg("active_length_fraction").alias("active_length_fraction_mean"), F.avg("vapor_front_x_px").alias("vapor_front_x_px_mean"),
    )


def error_bars(summary: DataFrame) -> DataFrame:
    """(state_label, state_voltage, vapor_area_fraction_mean, error) for drawing: a state of one frame, without a deviation, has an error of 0."""
    return summary.select("state_label", "state_voltage", "vapor_area_fraction_mean", F.coalesce("vapor_area_fraction_std", F.lit(0.0)).alias("error"))


def profile(frames: DataFrame, bins: int = 64, pixel_size_mm: float | None = None) -> DataFrame:
    """A row for each frame and bin of columns that isn't empty; bin_index keeps the gaps of empty ones."""
    if bins <= 0:
        raise ValueError("bins must be positive")
    edges = S.bin_edges(F.col("width"), bins)
    out = frames.withColumn("_edges", edges).select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin_index"))
    out = out.withColumn("x_start_px", F.get("_edges", F.col("bin_index"))).withColumn("x_end_px", F.get("_edges", F.col("bin_index") + 1)).where("x_end_px > x_start_px")
    cells = F.slice("col_counts", F.col("x_start_px") + 1, F.col("x_end_px") - F.col("x_start_px"))
    out = out.withColumn("x_center_px", S.bin_center(F.col("x_start_px"), F.col("x_end_px")))
    out = out.withColumn("total_area_px", ((F.col("x_end_px") - F.col("x_start_px")) * F.col("height")).cast("long")).withColumn("bubble_area_px", F.aggregate(cells, F.lit(0).cast("long"), lambda a, x: a + x))
    out = out.withColumn("projected_vapor_area_fraction", F.col("bubble_area_px") / F.col("total_area_px"))
    if pixel_size_mm is not None:
        out = out.withColumn("x_center_mm", F.col("x_center_px") * pixel_size_mm)
    return out.drop("_edges", "height", "width", "col_counts")


#: Places of a bitmap.
BLOCK = 1 << 15


def mask_bitmaps(instances: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, block, bits): the places x >= 0 that any instance covers, as bitmaps of BLOCK places; a row a frame and block leaves a task."""
    covered = instances.where("covered and x >= 0").select(*keys, F.floor(F.col("x") / BLOCK).alias("block"), (F.col("x") % BLOCK).cast("long").alias("_bit"))
    return covered.groupBy(*keys, "block").agg(F.bitmap_construct_agg("_bit").alias("bits"))


def united(bitmaps: DataFrame, keys: list[str]) -> DataFrame:
    """Bitmaps (keys, block, bits) that share keys and block as one."""
    return bitmaps.groupBy(*keys, "block").agg(F.bitmap_or_agg("bits").alias("bits"))


def mask_areas(bitmaps: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, area): the number of covered places."""
    return bitmaps.groupBy(*keys).agg(F.sum(F.bitmap_count("bits")).alias("area"))


def union_masks(instances: DataFrame, frames: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, x, mask) of every frame: whether any instance covers the place; frames without instances are empty."""
    places = frames.select(*keys, "x", F.floor(F.col("x") / BLOCK).alias("block"))
    joined = places.join(mask_bitmaps(instances, keys), [*keys, "block"], "left")
    byte = F.conv(F.hex(F.substring("bits", (F.col("x") % BLOCK / 8).cast("int") + 1, 1)), 16, 10).cast("int")
    return joined.select(*keys, "x", (F.coalesce(byte, F.lit(0)).bitwiseAND(F.pow(F.lit(2), F.col("x") % 8).cast("int")) > 0).alias("mask"))


def even_positions(n: Column, count: int) -> Column:
    """Positions of ``count`` rows spread evenly over n, first and last included; all of them if count <= 0 or n <= count."""
    every = F.sequence(F.lit(0).cast("long"), F.greatest(n - 1, F.lit(0)).cast("long"))
    if count <= 0:
        return every
    if count == 1:
        return F.when(n <= 1, every).otherwise(F.array(F.lit(0).cast("long")))
    step = (n - 1).cast("double") / (count - 1)
    spread = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.when(i == count - 1, n - 1).otherwise(F.floor(i * step)).cast("long"))
    return F.when(n <= count, every).otherwise(spread)


def sample_evenly(df: DataFrame, by: list[str], order: list, count: int) -> DataFrame:
    """Of each group ``count`` rows spread evenly over its order; all rows if count <= 0."""
    return df if count <= 0 else selected(df, by, order, lambda n: even_positions(n, count))


def middle(df: DataFrame, by: list[str], order: list) -> DataFrame:
    """The row in the middle of each group's order (of an even number the later one)."""
    return selected(df, by, order, lambda n: F.array(F.floor(n / 2).cast("long")))


def seeded_sample(df: DataFrame, key: str, count: int, seed: int = 7) -> DataFrame:
    """``count`` rows without replacement, those whose key has the smallest digests with the seed; all if there are no more.

    Each task keeps so many rows at most, and these are merged. The same rows come out for the same keys, wherever they are read.
    """
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary")), key).limit(count)


def in_order_of_appearance(df: DataFrame, by: list[str], place: str = "row_idx") -> DataFrame:
    """(by, first_place) of each group, that which appears first at the top; places of rows as numbered at ingest."""
    return df.groupBy(*by).agg(F.min(place).alias("first_place")).orderBy("first_place")
