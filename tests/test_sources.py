"""Listings, text formats and tables as files."""

import json
import struct

import pytest

from quillon.operators import frames, imaging
from quillon.sources import tables


def test_listing_of_images(spark, tmp_path):
    (tmp_path / "nested").mkdir()
    for name in ("a.bmp", "b.txt", "nested/c.JPG"):
        (tmp_path / name).write_bytes(b"")
    assert [r.name for r in tables.list_images(spark, str(tmp_path)).collect()] == ["a.bmp", "c.JPG"]


def test_listing_by_tasks(spark, tmp_path):
    """Folders of any depth, odd names, empty ones; in the order of path components."""
    names = ["b/x.png", "a/z.bmp", "a b/c%20d/é[1].TIF", "a-/y.jpeg", "a/deep/deeper/deepest/w.jpg", "a/.hidden.png", "top.png"]
    for n in names:
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_bytes(b"")
    (tmp_path / "empty" / "inner").mkdir(parents=True)
    (tmp_path / "folder.png").mkdir()
    (tmp_path / "a" / "n.json").write_text("{}")
    for root in (str(tmp_path), f"{tmp_path}/", f"file://{tmp_path}"):
        got = [r.path for r in tables.list_images(spark, root).collect()]
        assert got == [f"{tmp_path}/{n}" for n in sorted(names, key=lambda n: n.split("/"))]
    assert [r.path for r in tables.list_annotations(spark, [str(tmp_path), f"{tmp_path}/a"]).collect()] == [f"{tmp_path}/a/n.json"] * 2
    assert tables.list_images(spark, f"{tmp_path}/empty").count() == 0


def test_order_of_appearance(spark):
    df = spark.createDataFrame([("b", 3), ("a", 5), ("b", 9), ("c", 0), (None, 1)], "g string, row_idx long")
    assert [tuple(r) for r in frames.in_order_of_appearance(df, ["g"]).collect()] == [("c", 0), (None, 1), ("b", 3), ("a", 5)]


def test_hits(spark, tmp_path):
    text = "Some preamble \xb5V\n\n ID SSSSSSSS.mmmuuun CH RISE SIG STRENGTH AMP ABS-ENERGY\n\n  1   12.5  1  3  4.5e2  40 1.25\n  2  13.0001 2 3 1 41 2\n broken line\n"
    (tmp_path / "hits.txt").write_bytes(text.encode("latin-1"))
    df = tables.read_hits(spark, str(tmp_path / "hits.txt"))
    assert "SIG-STRENGTH" in df.columns
    assert [(r.ch, r.time_s, r.amp, r.abs_energy, r["SIG-STRENGTH"]) for r in df.orderBy("time_s").collect()] == [(1, 12.5, 40.0, 1.25, "4.5e2"), (2, 13.0001, 41.0, 2.0, "1")]
    (tmp_path / "none.txt").write_text("nothing here")
    with pytest.raises(ValueError):
        tables.read_hits(spark, str(tmp_path / "none.txt"))


def test_annotation_documents(spark, tmp_path):
    (tmp_path / "x.json").write_text(json.dumps({"imageWidth": 10, "imageHeight": 5, "imagePath": "p.png", "shapes": [{"label": "bubble", "points": [[0, 1], [2.5, 3]]}]}, indent=1))
    (tmp_path / "y.json").write_text(json.dumps({"imageWidth": 10, "imageHeight": 5, "shapes": []}))
    listed = [r.path for r in tables.list_annotations(spark, [str(tmp_path), str(tmp_path)]).collect()]
    assert len(listed) == 4
    rows = {r.json_path.rsplit("/", 1)[-1]: r for r in tables.read_annotations(spark, sorted(set(listed))).collect()}
    assert rows["x.json"].image_path.endswith("/p.png") and rows["y.json"].image_path == f"{tmp_path}/y.bmp" and rows["x.json"].shapes[0].points == [[0, 1], [2.5, 3]]


def test_states_and_summaries(spark, tmp_path):
    images = spark.createDataFrame([("/r/25_ONSET/a.bmp",), ("/r/25_ONSET/b.bmp",), ("/r/9.5V/a.bmp",), ("/r/other/a.bmp",)], "path string")
    assert [tuple(r) for r in tables.states_of(images).collect()] == [("9.5V", 9.5), ("25_ONSET", 25.0)]
    metrics = frames.mask_metrics(spark.createDataFrame([("25", 25.0, "f", 10, 2, [5, 0])], "state_label string, state_voltage double, frame_name string, height int, width int, col_counts array<int>"))
    tables.write_csv(metrics.select("state_label", "state_voltage", "frame_name", "vapor_area_fraction", "active_length_fraction", "vapor_front_x_px"), f"{tmp_path}/m")
    assert tables.read_frame_metrics(spark, [f"{tmp_path}/m"]).head().vapor_area_fraction == 0.25
    head = [c.split()[0] for c in tables.STATE_SUMMARY.split(", ")]
    (tmp_path / "5gs_22C_multimodal_state_summary.csv").write_text(",".join(head) + "\n" + ",".join(["25", "25.0"] + [""] * (len(head) - 8) + ["7.0"] + [""] * 5) + "\n")
    row = tables.read_summaries(spark, [f"{tmp_path}/5gs_22C_multimodal_state_summary.csv"]).head()
    assert row.state_label == "25" and row.ae_hits == 7 and row.file_name.startswith("5gs")


def test_model_files(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"feature_names": ["a"], "foreground_mean": [1], "foreground_std": [1], "background_mean": [0], "background_std": [1], "foreground_prior": 0.5, "threshold": 0.45, "roi": None, "min_area_px": 20}, indent=2))
    model = tables.read_model(spark, str(tmp_path / "m.json"))
    assert model.head().clear_top_px == 6
    tables.write_model(model, f"{tmp_path}/out")
    assert spark.read.json(f"{tmp_path}/out").head().threshold == 0.45


def bitmap(rows):
    """A 24-bit BMP of rows of (b, g, r), the first row on top."""
    pad = b"\0" * (-3 * len(rows[0]) % 4)
    body = b"".join(b"".join(bytes(p) for p in row) + pad for row in reversed(rows))
    return b"BM" + struct.pack("<IHHI", 54 + len(body), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, len(rows[0]), len(rows), 1, 24, 0, len(body), 2835, 2835, 0, 0) + body


def test_images(spark, tmp_path):
    (tmp_path / "a.bmp").write_bytes(bitmap([[(1, 2, 3), (4, 5, 6)], [(7, 8, 9), (10, 11, 12)]]))
    r = tables.read_images(spark, str(tmp_path)).head()
    assert (r.height, r.width, r.channels, list(r.data[:6])) == (2, 2, 3, [1, 2, 3, 4, 5, 6])


def test_grey_and_rgb(spark, tmp_path):
    (tmp_path / "a.bmp").write_bytes(bitmap([[(1, 2, 3), (255, 255, 255)], [(0, 0, 0), (10, 200, 90)]]))
    images = tables.read_images(spark, str(tmp_path))
    r = imaging.grey_images(images).head()
    levels = [0.299 * c[2] + 0.587 * c[1] + 0.114 * c[0] for c in ((1, 2, 3), (255, 255, 255), (0, 0, 0), (10, 200, 90))]
    assert (r.height, r.width) == (2, 2) and r.levels == pytest.approx([int(x + 0.5) / 255 for x in levels], abs=1e-6)
    assert list(imaging.rgb_images(images).head().data) == [3, 2, 1, 255, 255, 255, 0, 0, 0, 90, 200, 10]
    one = spark.createDataFrame([("g", 1, 2, 1, bytearray([7, 9])), ("f", 1, 1, 4, bytearray([1, 2, 3, 4]))], "path string, height int, width int, channels int, data binary")
    assert {x.path: list(x.data) for x in imaging.rgb_images(one).collect()} == {"g": [7, 7, 7, 9, 9, 9], "f": [3, 2, 1]}
    assert {x.path: len(x.levels) for x in imaging.grey_images(one).collect()} == {"g": 2, "f": 1}
