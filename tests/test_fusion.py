"""States, thermal log and hits fused, with figures worked out by hand."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quillon.functions import scalar as S
from quillon.operators import frames, fuse, synth
from quillon.operators.range_join import FANOUT, in_ranges, pieces

LOG = [  # row, time, voltage, power, flux (W/m2), subcooling, p in, p out, two transfer coefficients, quality
    (0, 0.0, -25.0, 10.0, 100000.0, 20.0, 110.0, 108.0, 1000.0, 3000.0, -0.2),
    (1, 0.1, 25.75, 12.0, 120000.0, 22.0, 111.0, None, 2000.0, None, -0.1),
    (2, 1.0, 49.5, 50.0, 300000.0, 20.0, 120.0, 110.0, 4000.0, 6000.0, 0.1),
    (3, 2.0, 50.5, 52.0, 320000.0, 21.0, 122.0, 110.0, 5000.0, 7000.0, 0.2),
    (4, 9.0, 25.0, 11.0, 110000.0, 21.0, 109.0, 105.0, 1000.0, 1000.0, -0.3),
]
NAMES = ("row_idx", "Time [s]", "V", "Power [W]", "Heat Flux [W/m2]", "Inlet Subcooling [C]", "Inlet Pressure", "Outlet Pressure", "Heat Transfer Coefficient 1", "Heat Transfer Coefficient 2", "Quality at x7")
HITS = [(0.0, 1, 40.0, 10.0), (0.5, 2, 42.0, 20.0), (1.0, 1, 44.0, 30.0), (2.0, 3, 46.0, 40.0), (9.0, 2, 48.0, 50.0), (9.1, 1, 99.0, 999.0)]


@pytest.fixture()
def parts(spark):
    schema = ", ".join(f"`{n}` {'long' if n == 'row_idx' else 'double'}" for n in NAMES)
    log = spark.createDataFrame(LOG, schema)
    thermal = fuse.positional_zip(fuse.thermal_frame(log.drop("V")), log.select("row_idx", F.abs("V").alias("abs_voltage")))
    states = spark.createDataFrame([("25_ONSET",), ("49",), ("50",), ("60 CHF",)], "state_label string").withColumn("state_voltage", S.parse_voltage(F.col("state_label")))
    return thermal, states, spark.createDataFrame(HITS, "time_s double, ch int, amp double, abs_energy double")


def test_thermal_and_acoustic_states(parts):
    thermal, states, hits = parts
    heat = fuse.thermal_summary(thermal, states)
    got = {r.state_label: r for r in heat.collect()}
    a = got["25_ONSET"]
    assert (a.thermal_rows, a.time_start_s, a.time_end_s) == (3, 0.0, 9.0)
    assert a.voltage_mean_v == pytest.approx(25.25) and a.heat_flux_mean_w_cm2 == pytest.approx(11) and a.pressure_drop_mean_kpa == pytest.approx(3) and a.htc_mean_w_m2k == pytest.approx(5000 / 3)
    assert got["49"].thermal_rows == 1 and got["50"].thermal_rows == 2 and got["50"].htc_mean_w_m2k == pytest.approx(5500)
    assert got["60 CHF"].thermal_rows == 0 and got["60 CHF"].time_start_s is None
    sound = {r.state_label: r for r in fuse.acoustic_summary(hits, heat).collect()}
    assert set(sound) == {"25_ONSET", "49", "50"}
    a, b, c = sound["25_ONSET"], sound["49"], sound["50"]
    assert a.ae_hits == 5 and a.ae_hit_rate_hz == pytest.approx(5 / 9) and a.ae_abs_energy_rate == pytest.approx(150 / 9) and a.ae_amp_mean_db == pytest.approx(44)
    assert a.ae_ch1_hit_rate_hz == pytest.approx(2 / 9) and a.ae_ch2_hit_rate_hz == pytest.approx(2 / 9)
    assert b.ae_hits == 1 and b.ae_hit_rate_hz == pytest.approx(1e9) and b.ae_ch2_hit_rate_hz == 0
    assert (c.ae_hits, c.ae_hit_rate_hz, c.ae_abs_energy_rate, c.ae_amp_mean_db) == (2, 2, 70, 45)


def test_window_without_hits_and_summary(spark, parts):
    thermal, states, hits = parts
    empty = spark.createDataFrame([("quiet", 100.0, 110.0), ("open", None, 3.0)], "state_label string, time_start_s double, time_end_s double")
    (r,) = fuse.acoustic_summary(hits, empty).collect()
    assert (r.ae_hits, r.ae_hit_rate_hz, r.ae_abs_energy_rate, r.ae_amp_mean_db) == (0, 0, 0.0, None)
    pictures = spark.createDataFrame([("49", 49.0, "f1", 10, 4, [0, 1, 2, 0]), ("none", None, "f2", 10, 4, [0, 0, 0, 0])], "state_label string, state_voltage double, frame_name string, height int, width int, col_counts array<int>")
    rows = fuse.multimodal_summary(frames.mask_metrics(pictures), thermal, hits, states).collect()
    assert [r.state_label for r in rows] == ["25_ONSET", "49", "50", "60 CHF", "none"]
    assert rows[1].image_frames == 1 and rows[1].vapor_area_fraction_std is None and rows[1].ae_hits == 1
    assert rows[3].ae_hits is None and rows[4].thermal_rows is None and rows[4].vapor_front_x_px_mean is None
    assert len(rows[0].asDict()) == 23


def test_positional_zip_of_other_length_raises(spark):
    with pytest.raises(Exception, match="differ in length"):
        fuse.positional_zip(spark.range(3).withColumnRenamed("id", "row_idx"), spark.range(4).withColumnRenamed("id", "row_idx")).collect()


def test_columns_by_fragment():
    assert fuse.find_column(["a", "Heat Flux [W/m2]", "Heat Flux 2"], ["Heat Flux"]) == "Heat Flux [W/m2]"
    with pytest.raises(KeyError):
        fuse.find_column(["a"], ["Power"])
    assert fuse.resolve_thermal(["Time [s]", "Power", "Heat Flux", "Inlet Subcooling", "Inlet Pressure", "Outlet Pressure", "Quality at x1", "Quality at x7"])["quality"] == "Quality at x7"


def test_ranges_include_both_ends_and_overlap(spark):
    rows = spark.createDataFrame([(float(v),) for v in (-3, 0, 1, 2.5, 10)] + [(None,), (math.nan,)], "v double")
    ranges = spark.createDataFrame([("a", 0.0, 1.0), ("b", 1.0, 10.0), ("c", None, 1.0), ("d", 5.0, 4.0), ("e", -3.0, -3.0)], "name string, lo double, hi double")
    got = sorted((r.name, r.v) for r in in_ranges(rows, F.col("v"), ranges, "lo", "hi", 2.0).collect())
    assert got == [("a", 0.0), ("a", 1.0), ("b", 1.0), ("b", 2.5), ("b", 10.0), ("e", -3.0)]


def test_synthesis(spark):
    schema = "state_label string, state_voltage double, heat_flux_mean_w_cm2 double, vapor_area_fraction_mean double, ae_abs_energy_rate double"
    a = spark.createDataFrame([("30", 30.0, 8.005, 0.1235, 5.25), ("25", 25.0, 7.5, 0.1, None), ("x", None, None, None, 9.0)], schema)
    b = spark.createDataFrame([("40", 40.0, 3.0, 0.5, 1.0)], schema).drop("ae_abs_energy_rate")
    both = synth.combined([synth.with_case(a, F.lit("15gs_20C")), synth.with_case(b, F.lit("5gs_22C")), synth.with_case(b, F.lit("7gs_1C"))])
    rows = both.collect()
    assert [(r.case_label, r.state_label, r.mass_flow_g_s, r.subcooling_nominal_c) for r in rows] == [("5gs_22C", "40", 5.0, 22.0), ("15gs_20C", "25", 15.0, 20.0), ("15gs_20C", "30", 15.0, 20.0), ("15gs_20C", "x", 15.0, 20.0), ("7gs_1C", "40", None, None)]
    scaled = {(r.case_label, r.state_label): r for r in synth.state_map(both, ("heat_flux_mean_w_cm2", "ae_abs_energy_rate")).collect()}
    assert scaled["5gs_22C", "40"].heat_flux_mean_w_cm2 == 0 and scaled["15gs_20C", "x"].heat_flux_mean_w_cm2 is None and scaled["15gs_20C", "x"].ae_abs_energy_rate == 1
    lines = [r.line for r in synth.key_number_lines(synth.key_numbers(synth.with_case(a, F.lit("15gs_20C")))).orderBy("i").collect()]
    assert lines == ["15gs_20C", "  heat flux range: 7.50 to 8.00 W/cm2", "  vapor area fraction range: 0.100 to 0.124", lines[3], lines[4]] and lines[4] is None  # the last state has no vapour figure
    constant = spark.createDataFrame([(2.0,), (2.0,)], "m double")
    assert [r.m for r in synth.state_map(constant, ("m",)).collect()] == [0.0, 0.0]


def test_ranges_have_few_pieces_however_long(spark):
    """A year over stretches of a minute, among short ranges: all matches, few rows added."""
    year = 365 * 86400.0
    rng = random.Random(5)
    ranges = [("year", 0.0, year), ("point", 100.0, 100.0), ("back", 9.0, 1.0), ("open", None, 1.0), ("nan", float("nan"), 1.0)] + [(f"r{i}", a, a + 10 ** rng.uniform(0, 7)) for i in range(60) for a in [rng.uniform(-1e6, year)]]
    values = [rng.uniform(-1e6, year + 1e6) for _ in range(800)] + [0.0, year, 100.0, 60.0, -60.0, None, float("nan")]
    windows = spark.createDataFrame(ranges, "label string, a double, b double")
    cut = pieces(windows, "a", "b", 60.0)
    held = {r.label: r["count"] for r in cut.groupBy("label").count().collect()}
    assert held["year"] <= FANOUT + 1 and max(held.values()) <= FANOUT + 1 and set(held) == {"year", "point"} | {f"r{i}" for i in range(60)}
    rows = spark.createDataFrame(list(enumerate(values)), "i int, v double")
    got = in_ranges(rows, F.col("v"), windows, "a", "b", 60.0)
    assert got.columns == ["i", "v", "label", "a", "b"]
    want = sorted((i, n) for i, v in enumerate(values) if v is not None for n, a, b in ranges if a is not None and a <= v <= b)
    assert sorted((r.i, r.label) for r in got.collect()) == want and len(want) > 900
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert in_ranges(rows, F.col("v"), windows, "a", "b", 60.0).count() == len(want)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert in_ranges(rows, F.col("v"), windows.limit(0), "a", "b", 60.0).count() == 0
