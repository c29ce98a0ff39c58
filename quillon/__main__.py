"""Command line: python -m quillon COMMAND --help."""

from __future__ import annotations

import argparse
import os
import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import scalar as S
from quillon.operators import annotate, frames, fuse, imaging, pixelmodel, runs, synth
from quillon.operators.scratch import Scratch
from quillon.sources import tables
from quillon.sources.copies import copy_files


def region(text: str) -> tuple[int, ...]:
    parts = tuple(int(p) for p in text.split(","))
    if len(parts) != 4:
        raise argparse.ArgumentTypeError("a region takes four values: x,y,w,h")
    return parts


def seeded_positions(n: int, count: int, seed: int) -> list[int]:
    """Positions of a sample without replacement, in order; all if there are no more."""
    return sorted(random.Random(seed).sample(range(n), count)) if count < n else list(range(n))


def segmenter(a: argparse.Namespace, spark: SparkSession) -> imaging.Segmenter:
    if not a.model:
        return imaging.Baseline(roi=a.roi)
    m = tables.read_model(spark, a.model).head()
    roi = a.roi or (tuple(m.roi) if m.roi else None)
    return imaging.PixelModel(tuple(m.foreground_mean), tuple(m.foreground_std), tuple(m.background_mean), tuple(m.background_std), m.foreground_prior, m.threshold, roi, m.min_area_px, m.clear_top_px)


def segmented(a: argparse.Namespace, spark: SparkSession, root: str, paths: list[str] | None = None) -> DataFrame:
    """Frames below a root, or those listed, as counts of vapour pixels a column."""
    counts = imaging.column_counts(tables.read_images(spark, root if paths is None else paths), segmenter(a, spark))
    label = tables.state_folder(os.path.abspath(root) if "://" not in root else root)
    return counts.select("path", label.alias("state_label"), S.parse_voltage(label).alias("state_voltage"), F.element_at(F.split("path", "/"), -1).alias("frame_name"), "height", "width", "col_counts")


def sampled_paths(a: argparse.Namespace, spark: SparkSession) -> list[str] | None:
    """Of each state the paths of so many frames, spread evenly over its listing: names are chosen before any image is read. None: all."""
    if a.frames_per_state <= 0:
        return None
    label = tables.state_folder(os.path.abspath(a.images) if "://" not in a.images else a.images)
    listed = tables.list_images(spark, a.images).select("path", label.alias("state_label")).where(S.parse_voltage(F.col("state_label")).isNotNull())
    return [r.path for r in frames.sample_evenly(listed, ["state_label"], [tables.path_order()], a.frames_per_state).collect()]


def list_images(a, spark) -> None:
    tables.list_images(spark, a.root).show(a.limit, truncate=False)


def sample_frames(a, spark) -> None:
    picked = frames.seeded_sample(tables.list_images(spark, a.root).select("path"), "path", a.count, a.seed)
    picked = Scratch(spark, "frames").table(picked, "picked")
    picked.orderBy(tables.path_order()).coalesce(1).write.mode("overwrite").text(a.out)
    if a.copies:
        copy_files(picked, a.root, a.copies)


def to_coco(a, spark) -> None:
    listed = tables.list_annotations(spark, a.annotation_root)
    docs = tables.read_annotations(spark, [r.path for r in listed.collect()])
    split = annotate.holdout_ids(docs, [tables.path_order("json_path")], a.holdout_every)
    images = split.select("split", "image_id", F.col("image_path").alias("file_name"), *[F.lit(v).alias(n) if a.roi else F.col(c).alias(n) for n, c, v in (("width", "imageWidth", a.roi and a.roi[2]), ("height", "imageHeight", a.roi and a.roi[3]))])
    annotate.write_documents(images, annotate.annotation_ids(annotate.shapes(split, a.roi)), a.out)


def annotated(a, spark) -> tuple[DataFrame, DataFrame]:
    """Annotation documents (json_path, image_path, name, shapes), and the images that they name (path, name, height, width, channels, data)."""
    docs = tables.read_annotations(spark, [r.path for r in tables.list_annotations(spark, a.annotation_root).collect()])
    docs = docs.withColumn("name", F.element_at(F.split("image_path", "/"), -1))
    images = tables.read_images(spark, a.images).withColumn("name", F.element_at(F.split("path", "/"), -1))
    return docs, images.join(docs.select("name").distinct(), "name", "left_semi")


def annotated_runs(docs: DataFrame, images: DataFrame, roi: tuple | None) -> DataFrame:
    """The runs of what annotations cover of each image (path), relative to the region if there is one."""
    shapes = docs.select("name", F.explode("shapes").alias("s")).where(S.canonical_label(F.col("s.label")).isin(*S.SHAPE_LABELS) & (F.size("s.points") >= 3))
    points = F.transform("s.points", lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y")))
    covered = runs.polygon_runs(shapes.select("name", points.alias("points")).join(images.select("path", "name", "height", "width"), "name"), ["path"], F.col("width"), F.col("height"))
    if not roi:
        return covered
    x, y, w, h = roi
    inside = covered.where(F.col("y").between(y, y + h - 1)).select("path", F.col("y") - y, F.greatest(F.col("x0") - x, F.lit(0)), F.least(F.col("x1") - x, F.lit(w - 1)))
    return inside.toDF("path", "y", "x0", "x1").where("x0 <= x1")


def fit_pixels(a, spark) -> None:
    docs, known = annotated(a, spark)
    wide = known.select("path", F.lit(a.roi[2]).alias("w") if a.roi else F.col("width").alias("w"))
    inside = annotated_runs(docs, known, a.roi).join(wide, "path").select("path", F.explode(F.sequence(F.col("y").cast("long") * F.col("w") + F.col("x0"), F.col("y").cast("long") * F.col("w") + F.col("x1"))).alias("pixel"), F.lit(True).alias("foreground"))
    pixels = imaging.pixel_rows(known, a.roi).join(inside, ["path", "pixel"], "left").withColumn("foreground", F.coalesce("foreground", F.lit(False)))
    number = max(1, known.count())
    model = pixelmodel.fit(pixelmodel.capped(pixels, "path", "foreground", a.max_pixels // number, a.seed))
    names = F.array(*[F.lit(n) for n in ("gray", "dark_contrast", "edge", "blackhat", "y")])
    roi = F.array(*[F.lit(v) for v in a.roi]) if a.roi else F.lit(None).cast("array<int>")
    tables.write_model(model.withColumns({"feature_names": names, "threshold": F.lit(a.threshold), "roi": roi, "min_area_px": F.lit(a.min_area_px)}), a.out)


def report(a, spark) -> None:
    """Overlap of predicted with annotated masks, image by image, with the split each is in, and its summary by split."""
    docs, known = annotated(a, spark)
    found = segmenter(a, spark)
    target = annotated_runs(docs, known, found.roi)
    shared = runs.overlap(imaging.mask_runs(known, found), target, ["path"]).withColumn("iou", F.col("both") / (F.col("a") + F.col("b") - F.col("both")))
    placed = annotate.holdout_of_existing(docs.select("json_path", "image_path", "name"), known.select("name"), "name", [tables.path_order("json_path")], a.holdout_every)
    each = placed.join(known.select("name", "path"), "name").join(shared.select("path", "iou"), "path", "left").withColumn("iou", F.coalesce("iou", F.lit(1.0)))
    each = Scratch(spark, "report").table(each.select("split", "ordinal", "json_path", "image_path", "iou"), "iou")
    tables.write_csv(each.orderBy("split", "ordinal").drop("ordinal"), f"{a.out}/iou")
    tables.write_csv(pixelmodel.iou_summary(each).orderBy("split"), f"{a.out}/summary")


def predict(a, spark) -> None:
    """Masks of a folder's images as runs (Parquet), and their metrics (CSV). A model's pixels are scored and cleaned up as tables."""
    paths = [r.path for r in tables.list_images(spark, a.images).limit(a.limit).collect()] if a.limit is not None else a.images
    images, found = tables.read_images(spark, paths), segmenter(a, spark)
    shapes = imaging.frames_of(images, found.roi)
    if a.model:
        model = tables.read_model(spark, a.model)
        scored = pixelmodel.score(imaging.pixel_rows(images, found.roi), model, threshold=found.threshold).where("predicted").join(shapes.select("path", "width"), "path")
        places = scored.select("path", F.floor(F.col("pixel") / F.col("width")).cast("int").alias("y"), (F.col("pixel") % F.col("width")).cast("int").alias("x"))
        masks = runs.cleaned(runs.runs_of_places(places, ["path"]), shapes, ["path"], found.min_area_px, found.clear_top_px)
    else:
        masks = imaging.mask_runs(images, found)
    masks.write.mode("overwrite").parquet(f"{a.out}/masks")
    metrics = frames.mask_metrics(runs.column_counts(spark.read.parquet(f"{a.out}/masks"), shapes, ["path"])).drop("col_counts")
    tables.write_csv(metrics.orderBy(tables.path_order()), f"{a.out}/metrics")


def profile(a, spark) -> None:
    tables.write_csv(frames.profile(segmented(a, spark, a.images).drop("path"), a.bins, a.pixel_size_mm), a.out)


def analyse(a, spark) -> None:
    thermal, power = (tables.read_log(spark, path) for path in (a.thermal, a.thermal_input))
    volts = power.select("row_idx", F.abs(F.col(f"`{fuse.find_column(power.columns, ['Voltage'])}`")).alias("abs_voltage"))
    log = fuse.positional_zip(fuse.thermal_frame(thermal), volts)
    every = segmented(a, spark, a.images, sampled_paths(a, spark)).where("state_voltage is not null").drop("path")
    # Written, so that each image is segmented once.
    metrics = Scratch(spark, "frames").table(frames.mask_metrics(every).drop("height", "width", "col_counts"), "metrics")
    states = metrics.select("state_label", "state_voltage").distinct()
    hits = tables.read_hits(spark, a.hits)
    tables.write_csv(metrics.orderBy("state_voltage", "frame_name"), f"{a.out}/{a.case}_image_frame_metrics")
    tables.write_csv(frames.state_summary(metrics).orderBy("state_voltage"), f"{a.out}/{a.case}_image_state_summary")
    tables.write_csv(fuse.multimodal_summary(metrics, log, hits, states, a.voltage_tolerance), f"{a.out}/{a.case}_multimodal_state_summary")


def synthesise(a, spark) -> None:
    every = tables.read_summaries(spark, a.summary)
    both = synth.with_case(every, S.case_label(F.col("file_name"))).drop("file_name").cache()
    tables.write_csv(synth.combined([both]), f"{a.out}/combined_multimodal_state_summary")
    tables.write_csv(synth.state_map(both), f"{a.out}/state_map")
    lines = synth.key_number_lines(synth.key_numbers(both)).orderBy(F.asc_nulls_last("mass_flow_g_s"), "case_label", "i")
    tables.write_lines(lines, f"{a.out}/key_numbers")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quillon")
    sub = p.add_subparsers(required=True)

    def command(name, run, *options):
        c = sub.add_parser(name)
        c.set_defaults(run=run)
        for flag, kind, default in options:
            many = {"action": "append"} if kind is list else {"type": kind}
            c.add_argument(flag, default=None if default is ... else default, required=default is ..., **many)

    model = (("--model", str, None), ("--roi", region, None))
    command("list-images", list_images, ("--root", str, ...), ("--limit", int, 1000))
    command("sample-frames", sample_frames, ("--root", str, ...), ("--out", str, ...), ("--count", int, 100), ("--seed", int, 7), ("--copies", str, None))
    command("labels-to-coco", to_coco, ("--annotation-root", list, ...), ("--out", str, ...), ("--holdout-every", int, 5), ("--roi", region, None))
    command("fit-pixel-model", fit_pixels, ("--annotation-root", list, ...), ("--images", str, ...), ("--out", str, ...), ("--roi", region, None), ("--threshold", float, 0.5), ("--min-area-px", int, 20), ("--max-pixels", int, 300_000), ("--seed", int, 7))
    command("iou-report", report, ("--annotation-root", list, ...), ("--images", str, ...), ("--out", str, ...), *model, ("--holdout-every", int, 5))
    command("predict", predict, ("--images", str, ...), ("--out", str, ...), *model, ("--limit", int, None))
    command("profile", profile, ("--images", str, ...), ("--out", str, ...), *model, ("--bins", int, 64), ("--pixel-size-mm", float, None))
    command("analyse-case", analyse, ("--case", str, ...), ("--images", str, ...), ("--thermal", str, ...), ("--thermal-input", str, ...), ("--hits", str, ...), ("--out", str, ...), *model, ("--frames-per-state", int, 12), ("--voltage-tolerance", float, 0.75))
    command("synthesise", synthesise, ("--summary", list, ...), ("--out", str, ...))
    return p


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    a.run(a, SparkSession.builder.appName("quillon").getOrCreate())


if __name__ == "__main__":
    main()
