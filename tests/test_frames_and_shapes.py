"""Column counts, bins, sampling, polygons, splits, ids and the pixel model."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import scalar as S
from quillon.operators import annotate, frames, imaging, pixelmodel


def pictures(spark, *rows):
    return spark.createDataFrame([("s", 1.0, f"f{i}", h, len(c), list(c)) for i, (h, c) in enumerate(rows)], "state_label string, state_voltage double, frame_name string, height int, width int, col_counts array<int>")


def test_metrics_of_masks(spark):
    rows = frames.mask_metrics(pictures(spark, (20, [1, 2, 0, 20]), (20, [0, 0, 0, 0]))).orderBy("frame_name").collect()
    assert [(r.vapor_area_fraction, r.active_length_fraction, r.vapor_front_x_px) for r in rows] == [(pytest.approx(0.2875), 0.5, 3.0), (0.0, 0.0, None)]


def test_profiles(spark):
    (a, b) = frames.profile(pictures(spark, (2, [2, 0, 1, 0])), 2, 0.5).orderBy("bin_index").collect()
    assert [(r.bubble_area_px, r.total_area_px, r.projected_vapor_area_fraction) for r in (a, b)] == [(2, 4, 0.5), (1, 4, 0.25)] and b.x_center_mm == 1.25
    gaps = frames.profile(pictures(spark, (1, [1, 1, 1])), 5).orderBy("bin_index").collect()
    assert [(r.bin_index, r.x_start_px, r.x_end_px) for r in gaps] == [(1, 0, 1), (3, 1, 2), (4, 2, 3)]
    for width, bins in ((58, 50), (70, 50), (1024, 64), (100, 7)):
        want = [int(x) for x in np.linspace(0, width, bins + 1)]
        assert spark.range(1).select(S.bin_edges(F.lit(width), bins).alias("e")).head().e == want
    with pytest.raises(ValueError):
        frames.profile(pictures(spark, (1, [1])), 0)


def test_even_sampling_and_middle(spark):
    rows = [(g, i) for g, n in (("a", 10), ("b", 11), ("c", 3), ("d", 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, i int")
    pick = lambda count: {g: sorted(r.i for r in frames.sample_evenly(df, ["g"], ["i"], count).collect() if r.g == g) for g in "abcd"}
    assert pick(4) == {"a": [0, 3, 6, 9], "b": [0, 3, 6, 10], "c": [0, 1, 2], "d": [0]}
    assert pick(1) == {"a": [0], "b": [0], "c": [0], "d": [0]} and pick(0) == {g: [i for x, i in rows if x == g] for g in "abcd"}
    assert {r.g: r.i for r in frames.middle(df, ["g"], ["i"]).collect()} == {"a": 5, "b": 5, "c": 1, "d": 0}


def test_union_of_masks(spark):
    places = spark.createDataFrame([("f", x) for x in range(3)] + [("empty", 0)], "frame string, x int")
    parts = spark.createDataFrame([("f", 0, False), ("f", 0, True), ("f", 1, False)], "frame string, x int, covered boolean")
    assert {(r.frame, r.x): r.mask for r in frames.union_masks(parts, places, ["frame"]).collect()} == {("f", 0): True, ("f", 1): False, ("f", 2): False, ("empty", 0): False}


def test_labels_and_regions(spark):
    labels = {"55 CHF": 55.0, "52.5V": 52.5, "25_ONSET": 25.0, "-25": 25.0, "none": None, "": None}
    df = spark.createDataFrame([(x,) for x in labels], "l string")
    assert {r.l: r.v for r in df.select("l", S.parse_voltage(F.col("l")).alias("v")).collect()} == labels
    assert df.select(S.safe_name(F.lit("55 CHF/a?.b-c")).alias("n")).head().n == "55_CHF_a_.b-c"
    assert tuple(spark.range(1).select(S.parse_roi(F.lit("1, 2, 30, 40")).alias("r")).head().r) == (1, 2, 30, 40)
    with pytest.raises(Exception, match="four values"):
        spark.range(1).select(S.parse_roi(F.lit("1,2,3"))).collect()
    assert [r.k for r in spark.range(-1, 5).select(S.odd_kernel(F.col("id")).alias("k")).collect()] == [1, 1, 1, 3, 3, 5]


def points(*p):
    return F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in p])


def test_polygons(spark):
    roi = [F.lit(v) for v in (2, 2, 4, 4)]
    one = spark.range(1).select(
        S.clamp_polygon(points((0, 0), (10, 0), (10, 10), (0, 10)), *roi).alias("around"),
        S.clamp_polygon(points((3, 3), (5, 3), (20, 5)), *roi).alias("part"),
        S.polygon_area(points((0, 0), (4, 0), (4, 3))).alias("area"),
        S.polygon_bbox(points((1, 5), (4, 2), (2, 9))).alias("box"),
    ).head()
    assert one.around is None and [(p.x, p.y) for p in one.part] == [(1, 1), (3, 1), (4, 3)] and one.area == 6 and one.box == [1, 2, 3, 7]


def test_annotations(spark):
    shape = lambda label, *p: (label, [list(map(float, q)) for q in p])
    square = ((0, 0), (5, 0), (5, 5), (0, 5))
    docs = [("a", [shape("bubble", *square), shape(" Bubble_Cluster ", *square)]), ("b", [shape("wall", *square), shape("bubble", (0, 0), (9, 9))]), ("c", [shape(None, *square), shape("bubble", (0, 0), (1, 0), (1, 1)), shape("bubble", *square)]), ("d", []), ("e", []), ("f", [shape("bubble", *square)])]
    df = spark.createDataFrame(docs, "name string, shapes array<struct<label: string, points: array<array<double>>>>")
    split = annotate.image_ids(annotate.holdout(df, [F.col("name")], 5), [F.col("name")])
    assert {r.name: (r.split, r.image_id) for r in split.collect()} == {"a": ("val", 1), "f": ("val", 2), "b": ("train", 1), "c": ("train", 2), "d": ("train", 3), "e": ("train", 4)}
    kept = annotate.annotation_ids(annotate.shapes(split))
    assert sorted((r.split, r.image_id, r.id, r.area) for r in kept.collect()) == [("train", 2, 1, 25.0), ("val", 1, 1, 25.0), ("val", 1, 2, 25.0), ("val", 2, 3, 25.0)]
    images = split.select("split", "image_id", F.col("name").alias("file_name"), F.lit(10).alias("width"), F.lit(20).alias("height"))
    coco = {r.split: json.loads(r.document) for r in annotate.coco_documents(images, kept).collect()}
    assert [i["file_name"] for i in coco["train"]["images"]] == ["b", "c", "d", "e"] and coco["val"]["annotations"][2]["bbox"] == [0, 0, 5, 5]
    assert coco["val"]["categories"] == [{"id": 1, "name": "bubble", "supercategory": "bubble"}]
    some = spark.createDataFrame([("b",), ("c",)], "name string")
    assert [(r.name, r.split) for r in annotate.holdout_of_existing(df, some, "name", [F.col("name")]).orderBy("name").collect()] == [("b", "val"), ("c", "train")]
    with pytest.raises(Exception, match="missing"):
        annotate.require_existing(df, some, "name").collect()


def test_pixel_model(spark):
    df = spark.createDataFrame([(0, True, [1.0]), (1, True, [3.0]), (2, False, [0.0]), (3, False, [0.0])], "pixel long, foreground boolean, features array<double>")
    model = pixelmodel.fit(df).head()
    assert (model.foreground_mean, model.background_mean, model.foreground_prior) == ([2.0], [0.0], 0.5)
    assert model.foreground_std == [pytest.approx(1.0001)] and model.background_std == [pytest.approx(0.0001)]
    got = {r.pixel: (r.probability, r.predicted) for r in pixelmodel.score(df, pixelmodel.fit(df)).collect()}
    assert got[0][1] and got[1][1] and not got[2][1] and got[1][0] == pytest.approx(1.0) and got[2][0] < 1e-3
    with pytest.raises(Exception, match="both classes"):
        pixelmodel.fit(df.where("foreground")).collect()
    pairs = spark.createDataFrame([("disjoint", True, False), ("disjoint", False, True), ("equal", True, True), ("empty", False, False), ("empty", None, False)], "g string, a boolean, b boolean")
    assert {r.g: r.iou for r in pixelmodel.iou(pairs, ["g"], F.col("a"), F.col("b")).collect()} == {"disjoint": 0.0, "equal": 1.0, "empty": 1.0}
    many = spark.range(100).select(F.lit("i").alias("image"), (F.col("id") < 30).alias("foreground"), F.col("id").alias("pixel"))
    assert {r.foreground: r["count"] for r in pixelmodel.capped(many, "image", "foreground", 40).groupBy("foreground").count().collect()} == {True: 30, False: 40}


def test_components():
    mask = np.array([[1, 0, 0, 0, 1], [0, 1, 0, 0, 1], [0, 0, 0, 0, 0], [1, 1, 1, 1, 1]], bool)
    assert len(np.unique(imaging.components(mask, True))) == 4 and len(np.unique(imaging.components(mask, False))) == 5
    assert imaging.without_small(mask, 2, True)[0, 0] and not imaging.without_small(mask, 2, False)[0, 0] and (imaging.without_small(mask, 0, True) == mask).all()
    assert not imaging.without_wall_lines(mask)[3].any() and imaging.without_wall_lines(mask)[0, 0]
    snake = np.ones((15, 15), bool)
    snake[1::4, :-1] = snake[3::4, 1:] = False
    assert len(np.unique(imaging.components(snake, False))) == 2 and imaging.components(np.ones((3, 3), bool), False).min() == 1


def test_arrays():
    a = np.zeros((5, 5), np.uint8)
    a[2, 2] = 9
    assert imaging.dilated(a, imaging.ellipse(3)).sum() == 9 * 5 and (imaging.closed(a, imaging.disk(1)) == a).all()
    assert imaging.otsu(np.array([[0, 0, 200, 210]], np.uint8)) in range(0, 200)
    with pytest.raises(ValueError):
        imaging.crop(a, (3, 3, 4, 4))
    square = imaging.polygon_mask([(1, 1), (4, 1), (4, 3), (1, 3)], 6, 6)
    assert square.sum() == 12 and square[1:4, 1:5].all()
    assert imaging.grey(np.full((2, 2, 3), 255, np.uint8)).max() == 255 and imaging.features(np.full((20, 30), 128, np.uint8)).shape == (20, 30, 5)
    assert math.isclose(imaging.features(np.full((20, 30), 51, np.uint8))[3, 3, 0], 0.2)
    flat = imaging.equalised(np.full((70, 100), 128, np.uint8))
    assert flat.shape == (70, 100) and flat.std() == 0


def test_segmented_images(spark):
    rng = np.random.default_rng(3)
    bright = rng.integers(200, 210, (64, 128, 3)).astype(np.uint8)
    dark = bright.copy()
    dark[20:30, 40:60] = 30
    rows = [(n, 64, 128, 3, bytearray(x.tobytes())) for n, x in (("bright", bright), ("dark", dark))]
    images = spark.createDataFrame(rows, "path string, height int, width int, channels int, data binary")
    got = {r.path: r for r in imaging.column_counts(images, imaging.Baseline(min_area_px=40)).collect()}
    inside = sum(got["dark"].col_counts[40:60])
    assert (got["dark"].height, got["dark"].width) == (64, 128) and inside >= 100
    pixels = imaging.pixel_rows(images).withColumn("foreground", (F.col("path") == "dark") & F.floor(F.col("pixel") / 128).between(20, 29) & (F.col("pixel") % 128).between(40, 59))
    m = pixelmodel.fit(pixels).head()
    model = imaging.PixelModel(tuple(m.foreground_mean), tuple(m.foreground_std), tuple(m.background_mean), tuple(m.background_std), m.foreground_prior)
    counts = {r.path: r.col_counts for r in imaging.column_counts(images, model).collect()}
    assert sum(counts["bright"]) == 0 and 150 <= sum(counts["dark"]) <= 260
