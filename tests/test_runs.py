"""Masks as runs and bitmaps, polygons as masks, documents in parts, copies with a commit."""

import json
import os
import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import annotate, frames, imaging, pixelmodel, runs
from quillon.sources.copies import copy_files


def lines_of(spark, masks):
    return spark.createDataFrame([(k, y, [bool(c) for c in line]) for k, m in masks.items() for y, line in enumerate(m)], "frame string, y int, cells array<boolean>")


def mask_of(rows, shape):
    out = np.zeros(shape, bool)
    for r in rows:
        assert not out[r.y, r.x0 : r.x1 + 1].any()
        out[r.y, r.x0 : r.x1 + 1] = True
    return out


@pytest.fixture(scope="module")
def masks():
    rng = np.random.default_rng(3)
    found = {f"m{i}": rng.random((24, 30)) < p for i, p in enumerate((0.05, 0.3, 0.45, 0.6))}
    wall = np.zeros((24, 30), bool)
    wall[3:9, 2:28] = True
    wall[15, :] = True
    wall[18:20, 4:9] = True
    return found | {"wall": wall, "none": np.zeros((24, 30), bool), "all": np.ones((24, 30), bool)}


@pytest.mark.parametrize("diagonal", [True, False])
def test_components_of_runs(spark, masks, diagonal):
    made = runs.runs_of_lines(lines_of(spark, masks))
    labels = runs.labelled(made, ["frame"], diagonal)
    boxes = sorted((r.frame, r.area, r.left, r.top, r.right, r.bottom) for r in runs.component_table(labels, ["frame"]).collect())
    want = []
    for k, m in masks.items():
        label = imaging.components(m, diagonal)
        for i in range(1, label.max() + 1):
            y, x = np.nonzero(label == i)
            want.append((k, len(y), x.min(), y.min(), x.max(), y.max()))
    assert boxes == sorted(want)
    small = runs.without_small(labels, ["frame"], 12)
    for k, m in masks.items():
        assert (mask_of(made.where(F.col("frame") == k).collect(), m.shape) == m).all()
        assert (mask_of(small.where(F.col("frame") == k).collect(), m.shape) == imaging.without_small(m, 12, diagonal)).all()
        if diagonal:
            left = runs.without_wall_lines(small, ["frame"], 30).where(F.col("frame") == k).collect()
            assert (mask_of(left, m.shape) == imaging.without_wall_lines(imaging.without_small(m, 12, True))).all()


def test_column_counts_and_overlaps_of_runs(spark, masks):
    made = runs.runs_of_lines(lines_of(spark, masks))
    sizes = spark.createDataFrame([(k, 24, 30) for k in masks], "frame string, height int, width int")
    counts = {r.frame: r.col_counts for r in runs.column_counts(made, sizes, ["frame"]).collect()}
    assert counts == {k: m.sum(axis=0).tolist() for k, m in masks.items()}
    other = {k: np.roll(m, 3, axis=1) for k, m in masks.items() if k not in ("m1", "none")}
    got = {r.frame: (r.a, r.b, r.both) for r in runs.overlap(made, runs.runs_of_lines(lines_of(spark, other)), ["frame"]).collect()}
    zero = np.zeros((24, 30), bool)
    assert got == {k: (int(m.sum()), int(other.get(k, zero).sum()), int((m & other.get(k, zero)).sum())) for k, m in masks.items() if m.any()}


def test_cleaning_of_runs(spark, masks):
    """Growing, closing and all steps of cleaning as the array versions, up to the frame's edges."""
    made = runs.runs_of_lines(lines_of(spark, masks))
    sizes = spark.createDataFrame([(k, 24, 30) for k in masks], "frame string, height int, width int")
    every = [runs.grown(made, sizes, ["frame"]), runs.flipped(made, sizes, ["frame"]), runs.closed(made, sizes, ["frame"]), runs.cleaned(made, sizes, ["frame"], 9, 3)]
    grown, flipped, closed, cleaned = ([r for r in df.collect()] for df in every)
    own = lambda rows, k: mask_of([r for r in rows if r.frame == k], (24, 30))
    for k, m in masks.items():
        assert (own(grown, k) == imaging.dilated(m, imaging.disk(1))).all()
        assert (own(flipped, k) == ~m).all()
        assert (own(closed, k) == imaging.closed(m, imaging.disk(1))).all()
        top = m.copy()
        top[:3] = False
        assert (own(cleaned, k) == imaging.without_wall_lines(imaging.without_small(imaging.closed(top, imaging.disk(1)), 9, False))).all()
    places = made.withColumn("x", F.explode(F.sequence("x0", "x1"))).drop("x0", "x1")
    back = runs.runs_of_places(places, ["frame"]).collect()
    assert all((own(back, k) == m).all() for k, m in masks.items())


def test_polygons_as_runs(spark):
    """As the array version: odd rule inside, outlines, several polygons under a key, points outside the mask."""
    rng = random.Random(4)
    shapes = [("a", [(2.0, 2.0), (20.5, 3.0), (15.0, 18.0)]), ("a", [(10.0, 10.0), (25.0, 10.0), (25.0, 15.0), (10.0, 15.0)]), ("line", [(3.0, 3.0), (9.0, 3.0), (3.0, 3.0)]), ("out", [(-50.0, -50.0), (-40.0, -45.0), (-45.0, -40.0)]), ("point", [(5.5, 5.5)])]
    shapes += [(f"r{i}", [(round(rng.uniform(-5, 35), 3), round(rng.uniform(-5, 25), 3)) for _ in range(rng.randint(3, 9))]) for i in range(25)]
    df = spark.createDataFrame([*shapes, ("empty", [])], "k string, points array<struct<x: double, y: double>>")
    rows = runs.polygon_runs(df, ["k"], F.lit(30), F.lit(20)).collect()
    for k in {k for k, _ in shapes} | {"empty"}:
        want = np.zeros((20, 30), bool)
        for key, p in shapes:
            if key == k:
                want |= imaging.polygon_mask(p, 20, 30)
        assert (mask_of([r for r in rows if r.k == k], want.shape) == want).all(), k


def shuffled_rows(df):
    """Rows that each exchange of an executed plan has written."""
    df.collect()
    found, left = [], [df._jdf.queryExecution().executedPlan()]
    while left:
        node = left.pop()
        name = node.getClass().getSimpleName()
        if name == "ShuffleExchangeExec":
            found.append(node.metrics().apply("shuffleRecordsWritten").value())
        inner = [node.executedPlan()] if name == "AdaptiveSparkPlanExec" else [node.plan()] if name.endswith("QueryStageExec") else [node.children().apply(i) for i in range(node.children().size())]
        left += inner
    return found


def test_polygons_are_shuffled_as_runs(spark):
    """Neither crossings nor points of the outline are shuffled, and merging holds no table of runs."""
    rng = random.Random(5)
    shapes = [(k, [(round(rng.uniform(-5, 45), 3), round(rng.uniform(-5, 45), 3)) for _ in range(32)]) for k in range(20)]
    df = runs.polygon_runs(spark.createDataFrame(shapes, "k int, points array<struct<x: double, y: double>>"), ["k"], F.lit(40), F.lit(40))
    assert shuffled_rows(df) == [df.count()]
    assert "Aggregate" not in df._jdf.queryExecution().executedPlan().toString()


def test_polygons_far_outside(spark):
    """Edges may be longer than any array; what they cover within the mask is all that is made."""
    far = 6e9
    shapes = [("all", [(-far, -far), (far, -far), (far, far), (-far, far)]), ("left", [(-far, 4.0), (7.0, 4.0), (7.0, 9.0), (-far, 9.0)]), ("none", [(30.0, -far), (40.0, -far), (40.0, far), (30.0, far)])]
    df = spark.createDataFrame(shapes, "k string, points array<struct<x: double, y: double>>")
    rows = runs.polygon_runs(df, ["k"], F.lit(30), F.lit(20)).collect()
    want = [("all", y, 0, 29) for y in range(20)] + [("left", y, 0, 7) for y in range(4, 10)]
    assert sorted((r.k, r.y, r.x0, r.x1) for r in rows) == want


def test_merged_runs(spark):
    """Runs within others, equal ones, adjoining ones and gaps of a place; lines and keys stay apart."""
    rng = random.Random(8)
    rows = [(k, y, a, a + rng.choice([0, 0, 1, 3, 12])) for k in range(3) for y in range(6) for a in [rng.randint(-4, 60) for _ in range(rng.randint(1, 14))]]
    rows += [(9, 0, 0, 20), (9, 0, 1, 2), (9, 0, 5, 5), (9, 0, 5, 5), (9, 0, 21, 21), (9, 0, 23, 24), (9, 1, 25, 25)]
    got = runs.merged(spark.createDataFrame(rows, "k int, y int, x0 int, x1 int"), ["k"]).collect()
    want = []
    for k, y in sorted({r[:2] for r in rows}):
        on = {x for r in rows if r[:2] == (k, y) for x in range(r[2], r[3] + 1)}
        want += [(k, y, a, next(b for b in range(a, 200) if b + 1 not in on)) for a in sorted(on) if a - 1 not in on]
    assert sorted(tuple(r) for r in got) == want


def test_bitmaps_of_masks(spark):
    rng = random.Random(6)
    rows = [(f"f{i % 3}", i % 7, rng.choice([0, 7, 8, 32767, 32768, 70_000, rng.randint(0, 200_000)]), rng.random() < 0.7) for i in range(400)] + [("f0", 1, -4, True), ("f0", 1, None, True), ("f0", 1, 5, None)]
    parts = spark.createDataFrame(rows, "frame string, part int, x int, covered boolean")
    places = parts.where("x >= 0").select("frame", "x").distinct()
    on = {(f, x) for f, _, x, c in rows if c and x is not None and x >= 0}
    assert {(r.frame, r.x): r.mask for r in frames.union_masks(parts, places, ["frame"]).collect()} == {(r.frame, r.x): (r.frame, r.x) in on for r in places.collect()}
    each = frames.mask_bitmaps(parts, ["frame", "part"])
    areas = {r.frame: r.area for r in frames.mask_areas(frames.united(each, ["frame"]), ["frame"]).collect()}
    assert areas == {f: sum(g == f for g, _ in on) for f in ("f0", "f1", "f2")}


def test_moments_pass_on_a_row_for_each_class(spark):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((500, 4)) * [1, 10, 0.1, 3] + [0, 100, -1, 1e4]
    df = spark.createDataFrame([(i, bool(i % 3 == 0), v.tolist()) for i, v in enumerate(x)] + [(900, True, [1.0, None, 2.0, 3.0]), (901, True, None)], "pixel long, foreground boolean, features array<double>").repartition(6)
    got = {(r.foreground, r.i): r for r in pixelmodel.moments(df).collect()}
    for flag in (True, False):
        own = x[np.arange(500) % 3 == 0] if flag else x[np.arange(500) % 3 != 0]
        for i in range(4):
            r = got[flag, i]
            assert r.n == len(own) and r.mean == pytest.approx(own[:, i].mean()) and r.std == pytest.approx(own[:, i].std() + 1e-4)
    (single,) = pixelmodel.moments(df.where("pixel = 3").withColumn("features", F.slice("features", 1, 1))).collect()
    assert single.n == 1 and single.std == pytest.approx(1e-4)


def test_documents_in_parts(spark, tmp_path):
    rng = random.Random(2)
    pictures = [(s, i + 1, f"{s}{i}.png", 10, 5) for s, n in (("train", 40), ("val", 1), ("none", 2)) for i in range(n)]
    shapes = [(s, i, p, [[1.0 * p, 2.0, 3.5]], [0.0, 1.0, 2.0, 3.0], rng.random()) for s, i, *_ in pictures if s != "none" for p in range(rng.randint(1, 5))]
    images = spark.createDataFrame(pictures, "split string, image_id int, file_name string, width int, height int").repartition(3)
    marks = annotate.annotation_ids(spark.createDataFrame(shapes, "split string, image_id int, position int, segmentation array<array<double>>, bbox array<double>, area double"))
    annotate.write_documents(images, marks, f"{tmp_path}/out")
    whole = {r.split: json.loads(r.document) for r in annotate.coco_documents(images, marks).collect()}
    assert set(whole) == {"train", "val", "none"}
    for split, document in whole.items():
        files = sorted(Path(f"{tmp_path}/out/split={split}").glob("part-*"))
        assert json.loads("".join(f.read_text() for f in files)) == document
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        annotate.write_documents(images, marks, f"{tmp_path}/spread")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    files = sorted(Path(f"{tmp_path}/spread/split=train").glob("part-*"))
    assert len(files) > 1 and json.loads("".join(f.read_text() for f in files)) == whole["train"]


def test_copies_are_whole_or_absent(spark, tmp_path):
    for name in ("a/x.bin", "b/x.bin", "b/deep/y[1].bin"):
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_bytes(name.encode() * 1000)
    names = ["a/x.bin", "b/x.bin", "b/deep/y[1].bin"]
    listed = lambda more: spark.createDataFrame([(f"{tmp_path}/in/{n}",) for n in (*names, *more)], "path string")
    with pytest.raises(Exception, match="missing.bin"):
        copy_files(listed(["missing.bin"]), f"{tmp_path}/in", f"{tmp_path}/out")
    assert [p for p in (tmp_path / "out").rglob("*") if p.is_file()] == []
    assert copy_files(listed([names[0]]), f"{tmp_path}/in", f"{tmp_path}/out") == 3
    assert sorted(str(p.relative_to(tmp_path / "out")) for p in (tmp_path / "out").rglob("*") if p.is_file()) == sorted(names)
    assert all((tmp_path / "out" / n).read_bytes() == n.encode() * 1000 for n in names)
    (tmp_path / "in" / "a" / "x.bin").write_bytes(b"new")
    assert copy_files(listed([]), f"{tmp_path}/in/", f"{tmp_path}/out") == 3 and (tmp_path / "out" / "a" / "x.bin").read_bytes() == b"new"
    assert os.listdir(tmp_path / "out") in (["a", "b"], ["b", "a"])
