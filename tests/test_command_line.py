"""The commands end to end, over a small made-up case."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.__main__ import main, seeded_positions
from quillon.operators import imaging
from quillon.sources import tables
from tests.test_sources import bitmap


def picture(dark):
    rows = [[(200 + (x * y) % 7,) * 3 for x in range(64)] for y in range(40)]
    for y in range(15, 25):
        for x in dark:
            rows[y][x] = (20, 20, 20)
    return bitmap(rows)


@pytest.fixture()
def case(tmp_path):
    for state, dark in (("25", range(10, 20)), ("50 CHF", range(10, 40)), ("notes", range(1))):
        (tmp_path / "img" / state).mkdir(parents=True)
        for i in range(3):
            (tmp_path / "img" / state / f"{state}_{i}.bmp").write_bytes(picture(dark))
    (tmp_path / "ann").mkdir()
    for state, dark in (("25", (10, 19)), ("50 CHF", (10, 39))):
        shape = {"label": "bubble", "points": [[dark[0], 15], [dark[1], 15], [dark[1], 24], [dark[0], 24]]}
        (tmp_path / "ann" / f"{state}_0.json").write_text(json.dumps({"imageWidth": 64, "imageHeight": 40, "imagePath": f"{state}_0.bmp", "shapes": [shape]}))
    (tmp_path / "thermal.csv").write_text("row_idx,Time [s],Power,Heat Flux [W/m2],Inlet Subcooling,Inlet Pressure,Outlet Pressure\n" + "\n".join(f"{i},{i},10,{1000 * i},5,110,100" for i in range(10)))
    (tmp_path / "volts.csv").write_text("row_idx,Voltage\n" + "\n".join(f"{i},{25 if i < 5 else -50}" for i in range(10)))
    (tmp_path / "hits.txt").write_text("ID SSSSSSSS.mmmuuun CH AMP ABS-ENERGY\n" + "\n".join(f"{i} {i * 0.5} {1 + i % 2} 40 2" for i in range(20)))
    return tmp_path


def test_case_and_synthesis(spark, case):
    out = str(case / "out")
    main(["analyse-case", "--case", "5gs_22C", "--images", f"{case}/img", "--thermal", f"{case}/thermal.csv", "--thermal-input", f"{case}/volts.csv", "--hits", f"{case}/hits.txt", "--out", out, "--frames-per-state", "2"])
    rows = spark.read.csv(f"{out}/5gs_22C_multimodal_state_summary", header=True, inferSchema=True).collect()
    assert [(r.state_voltage, r.image_frames, r.thermal_rows, r.ae_hits) for r in rows] == [(25.0, 2, 5, 9), (50.0, 2, 5, 9)]
    assert rows[0].vapor_area_fraction_mean < rows[1].vapor_area_fraction_mean
    main(["synthesise", "--summary", f"{out}/5gs_22C_multimodal_state_summary", "--out", f"{out}/all"])
    assert spark.read.csv(f"{out}/all/combined_multimodal_state_summary", header=True).count() == 2
    assert spark.read.text(f"{out}/all/key_numbers").count() == 5


def test_only_sampled_images_are_read(spark, case, monkeypatch):
    """Names are chosen first: the segmenter sees each sampled image once, and a file that can't be decoded does no harm unless it is sampled."""
    (case / "img" / "25" / "nested").mkdir()
    (case / "img" / "25" / "25_0x[1].bmp").write_bytes(b"no picture")
    for i in range(6):
        (case / "img" / "25" / "nested" / f"z{{{i}}}.bmp").write_bytes(picture(range(30)))
    calls = case / "calls"
    calls.mkdir()

    def watched(image):
        import tempfile

        tempfile.mkstemp(dir=calls)
        return image[..., 0] < 100

    monkeypatch.setattr("quillon.__main__.segmenter", lambda a, spark: watched)
    main(["analyse-case", "--case", "5gs_22C", "--images", f"{case}/img", "--thermal", f"{case}/thermal.csv", "--thermal-input", f"{case}/volts.csv", "--hits", f"{case}/hits.txt", "--out", f"{case}/out", "--frames-per-state", "2"])
    rows = spark.read.csv(f"{case}/out/5gs_22C_image_frame_metrics", header=True).collect()
    assert sorted((r.state_label, r.frame_name) for r in rows) == [("25", "25_0.bmp"), ("25", "z{5}.bmp"), ("50 CHF", "50 CHF_0.bmp"), ("50 CHF", "50 CHF_2.bmp")]
    assert len(list(calls.iterdir())) == 4


def test_model_and_profile(spark, case):
    main(["fit-pixel-model", "--annotation-root", f"{case}/ann", "--images", f"{case}/img", "--out", f"{case}/model"])
    main(["profile", "--images", f"{case}/img", "--out", f"{case}/profile", "--model", f"{case}/model", "--bins", "8"])
    rows = spark.read.csv(f"{case}/profile", header=True, inferSchema=True).where("state_label = '50 CHF'").collect()
    by_bin = {r.bin_index: r.projected_vapor_area_fraction for r in rows}
    assert len(rows) == 24 and by_bin[3] > 0.2 and by_bin[7] == 0 and by_bin[0] == 0
    main(["labels-to-coco", "--annotation-root", f"{case}/ann", "--out", f"{case}/coco", "--holdout-every", "2", "--roi", "0,0,64,40"])
    document = json.loads(spark.read.text(f"{case}/coco/split=val").head()[0])
    assert document["annotations"][0]["bbox"] == [10, 15, 9, 9] and document["images"][0]["width"] == 64
    main(["sample-frames", "--root", f"{case}/img", "--out", f"{case}/picked", "--count", "4"])
    assert spark.read.text(f"{case}/picked").count() == 4
    main(["sample-frames", "--root", f"{case}/img", "--out", f"{case}/again", "--count", "4", "--copies", f"{case}/copies"])
    names = [r.value for r in spark.read.text(f"{case}/again").collect()]
    assert names == [r.value for r in spark.read.text(f"{case}/picked").collect()]
    assert sorted(str(p) for p in (case / "copies").rglob("*.bmp")) == sorted(n.replace(f"{case}/img", f"{case}/copies") for n in names)


def test_report_and_prediction(spark, case):
    main(["fit-pixel-model", "--annotation-root", f"{case}/ann", "--images", f"{case}/img", "--out", f"{case}/model"])
    main(["iou-report", "--annotation-root", f"{case}/ann", "--images", f"{case}/img", "--out", f"{case}/report", "--model", f"{case}/model", "--holdout-every", "2"])
    rows = spark.read.csv(f"{case}/report/iou", header=True, inferSchema=True).collect()
    assert [(r.split, r.image_path.rsplit("/", 1)[-1]) for r in rows] == [("train", "50 CHF_0.bmp"), ("val", "25_0.bmp")] and all(0.5 < r.iou <= 1 for r in rows)
    summary = spark.read.csv(f"{case}/report/summary", header=True, inferSchema=True).collect()
    assert [(r.split, r.images) for r in summary] == [("train", 1), ("val", 1)] and summary[1].iou_median == rows[1].iou
    main(["predict", "--images", f"{case}/img", "--out", f"{case}/predicted", "--model", f"{case}/model", "--limit", "4"])
    masks = spark.read.parquet(f"{case}/predicted/masks")
    metrics = {r.path: r for r in spark.read.csv(f"{case}/predicted/metrics", header=True, inferSchema=True).collect()}
    area = {r.path: r.n for r in masks.groupBy("path").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("n")).collect()}
    assert len(metrics) == 4 and all(area.get(p, 0) == round(r.vapor_area_fraction * r.height * r.width) for p, r in metrics.items())
    # As the model behind the map over whole images.
    m = tables.read_model(spark, f"{case}/model").head()
    model = imaging.PixelModel(tuple(m.foreground_mean), tuple(m.foreground_std), tuple(m.background_mean), tuple(m.background_std), m.foreground_prior, m.threshold, None, m.min_area_px, m.clear_top_px)
    counted = imaging.mask_runs(tables.read_images(spark, list(metrics)), model)
    assert sorted(map(tuple, counted.collect())) == sorted(tuple(r[c] for c in ("path", "y", "x0", "x1")) for r in masks.collect())


def test_seeded_positions():
    assert seeded_positions(5, 9, 1) == [0, 1, 2, 3, 4] and seeded_positions(100, 3, 7) == seeded_positions(100, 3, 7) and len(set(np.array(seeded_positions(100, 30, 7)))) == 30
