"""Diagonal Gaussian classifier of pixels as aggregates and a one-row model."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import scalar as S

#: Added to every standard deviation.
FLOOR = 1e-4


def capped(pixels: DataFrame, image: str, foreground: str, per_image: int, seed: int = 7) -> DataFrame:
    """At most ``per_image`` pixels of each image and class, by hash: the sampling that the fit is defined with."""
    rank = F.row_number().over(Window.partitionBy(image, foreground).orderBy(F.xxhash64(F.lit(seed), "pixel"), "pixel"))
    return pixels.withColumn("_rank", rank).where(F.col("_rank") <= per_image).drop("_rank")


def moments(pixels: DataFrame, features: str = "features", foreground: str = "foreground") -> DataFrame:
    """(foreground, i, n, mean, std) of each class and feature; std is that of the population and FLOOR.

    A task keeps one vector of moments for each class and passes on only these, which are then merged. Pixels
    with a null among their features take no part.
    """
    held = pixels.where(F.col(features).isNotNull() & ~F.exists(features, lambda v: v.isNull()))
    vector = array_to_vector(F.transform(features, lambda v: v.cast("double")))
    each = held.groupBy(foreground).agg(Summarizer.metrics("count", "mean", "variance").summary(vector).alias("m"))
    long = each.select(foreground, F.col("m.count").alias("n"), F.posexplode(F.arrays_zip(vector_to_array("m.mean").alias("mean"), vector_to_array("m.variance").alias("var"))).alias("i", "v"))
    # The sample's variance, as that is what is merged, to the population's.
    return long.select(foreground, "i", "n", F.col("v.mean").alias("mean"), (F.sqrt(F.col("v.var") * (F.col("n") - 1) / F.col("n")) + FLOOR).alias("std"))


def fit(pixels: DataFrame, features: str = "features", foreground: str = "foreground") -> DataFrame:
    """The model, one row: means and deviations of both classes by feature, and the foreground's share."""
    each = moments(pixels, features, foreground)
    by_class = each.groupBy(foreground).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("i", "mean", "std"))).alias("f"))
    pick = lambda flag, field: F.max(F.when(F.col(foreground) == flag, F.transform("f", lambda x: x[field])))
    number = lambda flag: F.coalesce(F.max(F.when(F.col(foreground) == flag, F.col("n"))), F.lit(0))
    missing = F.raise_error(F.lit("training takes pixels of both classes")).cast("double")
    return by_class.agg(
        pick(True, "mean").alias("foreground_mean"), pick(True, "std").alias("foreground_std"), pick(False, "mean").alias("background_mean"), pick(False, "std").alias("background_std"),
        F.when((number(True) > 0) & (number(False) > 0), number(True) / (number(True) + number(False))).otherwise(missing).alias("foreground_prior"),
    )


def score(pixels: DataFrame, model: DataFrame, features: str = "features", threshold: float = 0.5) -> DataFrame:
    """pixels with probability of the foreground, and whether it reaches the threshold. The model is one row, sent to all."""
    x = F.transform(features, lambda v: v.cast("double"))
    joined = pixels.join(F.broadcast(model.select("foreground_mean", "foreground_std", "background_mean", "background_std", "foreground_prior")))
    near = lambda c: S.gaussian_log_density(x, F.col(f"{c}_mean"), F.col(f"{c}_std"))
    probability = S.posterior(near("foreground"), near("background"), F.col("foreground_prior"))
    return joined.withColumn("probability", probability).withColumn("predicted", F.col("probability") >= threshold).select(*pixels.columns, "probability", "predicted")


def iou(pairs: DataFrame, by: list[str], predicted: Column, target: Column) -> DataFrame:
    """Intersection over union of two flags in each group; 1 where neither is ever set. Null counts as not set."""
    a, b = F.coalesce(predicted, F.lit(False)), F.coalesce(target, F.lit(False))
    return pairs.groupBy(*by).agg(F.coalesce(F.count_if(a & b) / F.nullif(F.count_if(a | b), F.lit(0)), F.lit(1.0)).alias("iou"))


def iou_summary(each: DataFrame, split: str = "split") -> DataFrame:
    """Of each split the number of images, and the mean and the median of their ``iou``."""
    return each.groupBy(split).agg(F.count("*").alias("images"), F.avg("iou").alias("iou_mean"), F.median("iou").alias("iou_median"))
