"""Annotated shapes as a training set: splits, ids, polygons, the nested document."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import scalar as S
from quillon.operators.numbering import numbered, numbered_within


def holdout(df: DataFrame, order: list[Column], every: int = 5) -> DataFrame:
    """df with ordinal (from 0) and split: val where the ordinal is a multiple of ``every``, else train.

    Rows are numbered by ranges of the order, so that no task sees all of them.
    """
    placed = numbered(df, order, "ordinal")
    return placed.withColumn("split", F.when(F.col("ordinal") % every == 0, "val").otherwise("train"))


def holdout_ids(df: DataFrame, order: list[Column | str], every: int = 5) -> DataFrame:
    """As holdout, with image_id from 1 within each split in that same order: what image_ids gives, without numbering again."""
    split = holdout(df, order, every)
    held = F.floor(F.col("ordinal") / every)
    return split.withColumn("image_id", F.when(F.col("split") == "val", held + 1).otherwise(F.col("ordinal") - held).cast("int"))


def holdout_of_existing(df: DataFrame, existing: DataFrame, key: str, order: list[Column], every: int = 5) -> DataFrame:
    """As holdout, over the rows whose key exists; others are dropped before they are numbered."""
    return holdout(df.join(existing.select(key).distinct(), key, "left_semi"), order, every)


def first_examples(split: DataFrame, count: int = 8) -> DataFrame:
    """The first ``count`` val rows of a split (see holdout), to look at."""
    return split.where("split = 'val'").orderBy("ordinal").limit(count)


def require_existing(df: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """df; a row whose key doesn't exist raises."""
    known = existing.select(key).distinct().withColumn("_known", F.lit(True))
    raised = F.raise_error(F.concat(F.lit("missing: "), F.col(key))).cast("boolean")
    return df.join(known, key, "left").where(F.when(F.col("_known"), F.lit(True)).otherwise(raised)).drop("_known")


def image_ids(df: DataFrame, order: list[Column]) -> DataFrame:
    """image_id from 1 within each split."""
    placed = numbered_within(df, ["split"], order, "image_id", "_images").drop("_images")
    return placed.select(*df.columns, (F.col("image_id") + 1).cast("int").alias("image_id"))


def shapes(documents: DataFrame, roi: tuple[int, int, int, int] | None = None) -> DataFrame:
    """A row for each shape of documents (split, image_id, shapes) that counts: position, segmentation, bbox, area.

    Its label is one of SHAPE_LABELS, it has three points at least, and with a region it is moved and clamped
    into it. Shapes of an area, width or height of 1 or less go.
    """
    each = documents.select("split", "image_id", F.posexplode("shapes").alias("position", "shape"))
    each = each.where(S.canonical_label(F.col("shape.label")).isin(*S.SHAPE_LABELS) & (F.size("shape.points") >= 3))
    points = F.transform("shape.points", lambda p: F.struct(F.get(p, F.lit(0)).cast("double").alias("x"), F.get(p, F.lit(1)).cast("double").alias("y")))
    each = each.select("split", "image_id", "position", points.alias("points"))
    if roi is not None:
        each = each.withColumn("points", S.clamp_polygon(F.col("points"), *[F.lit(v) for v in roi])).where(F.col("points").isNotNull())
    each = each.select("split", "image_id", "position", F.array(S.polygon_flat(F.col("points"))).alias("segmentation"), S.polygon_bbox(F.col("points")).alias("bbox"), F.abs(S.polygon_area(F.col("points"))).alias("area"))
    return each.where((F.col("area") > 1) & (F.get("bbox", F.lit(2)) > 1) & (F.get("bbox", F.lit(3)) > 1))


def annotation_ids(kept: DataFrame) -> DataFrame:
    """id from 1 within each split over the shapes that are left, in the order of images and positions.

    Shapes are numbered by ranges of images and positions, so that no task sees all shapes of a split.
    """
    placed = numbered_within(kept, ["split"], ["image_id", "position"], "id", "_shapes")
    return placed.select(*kept.columns, (F.col("id") + 1).alias("id"))


def coco_documents(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """A row for each split with its document as JSON; one document is one value, so a split must fit a task."""
    pictures = images.groupBy("split").agg(F.array_sort(F.collect_list(F.struct(F.col("image_id").alias("id"), "file_name", "width", "height"))).alias("images"))
    listed = F.struct("id", "image_id", F.lit(1).alias("category_id"), "segmentation", "bbox", "area", F.lit(0).alias("iscrowd"))
    marks = annotations.groupBy("split").agg(F.array_sort(F.collect_list(listed)).alias("annotations"))
    none = F.array().cast(marks.schema["annotations"].dataType)
    document = F.struct(
        F.struct(F.lit("Annotated shapes").alias("description"), F.lit("0.1.0").alias("version")).alias("info"), F.array().cast("array<string>").alias("licenses"), "images",
        F.coalesce("annotations", none).alias("annotations"), F.array(F.struct(F.lit(1).alias("id"), F.lit("bubble").alias("name"), F.lit("bubble").alias("supercategory"))).alias("categories"),
    )
    return pictures.join(marks, "split", "left").select("split", F.to_json(document).alias("document"))


def document_parts(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """(split, part, id, text): the documents of coco_documents in pieces, which by part and id make one of a split when put together.

    No piece holds more than one image or shape; each but the first of its list, which has id 1, begins with a comma.
    """
    splits = images.select("split").distinct()
    info = F.struct(F.lit("Annotated shapes").alias("description"), F.lit("0.1.0").alias("version"))
    kinds = F.array(F.struct(F.lit(1).alias("id"), F.lit("bubble").alias("name"), F.lit("bubble").alias("supercategory")))
    fixed = lambda part, *text: splits.select("split", F.lit(part).alias("part"), F.lit(0).cast("long").alias("id"), F.concat(*text).alias("text"))
    listed = lambda df, part, item: df.select("split", F.lit(part).alias("part"), F.col("id").cast("long").alias("id"), F.concat(F.when(F.col("id") > 1, ",").otherwise(""), F.to_json(item)).alias("text"))
    pictures = images.select("split", F.col("image_id").alias("id"), "file_name", "width", "height")
    marks = F.struct("id", "image_id", F.lit(1).alias("category_id"), "segmentation", "bbox", "area", F.lit(0).alias("iscrowd"))
    pieces = [
        fixed(0, F.lit('{"info":'), F.to_json(info), F.lit(',"licenses":[],"images":[')),
        listed(pictures, 1, F.struct("id", "file_name", "width", "height")),
        fixed(2, F.lit('],"annotations":[')),
        listed(annotations.join(splits, "split", "left_semi"), 3, marks),
        fixed(4, F.lit('],"categories":'), F.to_json(kinds), F.lit("}")),
    ]
    return reduce(DataFrame.unionAll, pieces)


def write_documents(images: DataFrame, annotations: DataFrame, path: str) -> None:
    """The documents as files, a folder split=NAME for each: its files, one after the other by name, are the document.

    Pieces are dealt by ranges of their order, so that a document may fill any number of tasks; Spark's commit
    makes the folder whole or not at all.
    """
    ordered = document_parts(images, annotations).repartitionByRange("split", "part", "id").sortWithinPartitions("split", "part", "id")
    ordered.select("split", "text").write.mode("overwrite").option("lineSep", " ").partitionBy("split").text(path)
