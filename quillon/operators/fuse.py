"""One case: states, thermal log and acoustic hits fused into a table of states."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import scalar as S
from quillon.operators.numbering import numbered, numbered_within
from quillon.operators.range_join import in_ranges
from quillon.operators.scratch import Scratch


def find_column(columns: Sequence[str], fragments: Sequence[str]) -> str:
    """The first column whose name holds all fragments; KeyError if none does."""
    for name in columns:
        if all(f in name for f in fragments):
            return name
    raise KeyError(f"no column holds {list(fragments)}")


def resolve_thermal(columns: Sequence[str]) -> dict:
    """Names of the thermal log's columns by what they hold."""
    roles = {"time": "Time [s]", "power": "Power", "flux": "Heat Flux", "subcooling": "Inlet Subcooling", "p_in": "Inlet Pressure", "p_out": "Outlet Pressure"}
    found: dict = {role: find_column(columns, [fragment]) for role, fragment in roles.items()}
    found["htc"] = [c for c in columns if "Heat Transfer Coefficient" in c]
    quality = [c for c in columns if c.startswith("Quality at x")]
    found["quality"] = quality[-1] if quality else None
    return found


def thermal_frame(log: DataFrame, **also: Column) -> DataFrame:
    """The log under common names: row_idx, time_s, power_w, heat_flux_w_cm2, subcooling_c, pressure_drop_kpa, htc, quality; NaN is null.

    ``also`` are further columns of the log itself, which then need no positional join.
    """
    names = resolve_thermal(log.columns)
    value = lambda c: S.no_nan(F.col(f"`{c}`").cast("double"))
    none = F.lit(None).cast("double")
    return log.select(
        "row_idx",
        value(names["time"]).alias("time_s"),
        value(names["power"]).alias("power_w"),
        S.per_square_cm(names["flux"], value(names["flux"])).alias("heat_flux_w_cm2"),
        value(names["subcooling"]).alias("subcooling_c"),
        (value(names["p_in"]) - value(names["p_out"])).alias("pressure_drop_kpa"),
        (S.row_mean([value(c) for c in names["htc"]]) if names["htc"] else none).alias("htc"),
        (value(names["quality"]) if names["quality"] else none).alias("quality"),
        *[c.alias(n) for n, c in also.items()],
    )


def positional_zip(left: DataFrame, right: DataFrame, order: str = "row_idx") -> DataFrame:
    """left with right's columns, row by row as numbered at ingest; raises unless both have the same rows."""
    joined = left.withColumn("_l", F.lit(1)).join(right.withColumn("_r", F.lit(1)), order, "full")
    paired = F.when(F.col("_l").isNotNull() & F.col("_r").isNotNull(), F.lit(True)).otherwise(F.raise_error(F.lit("the tables differ in length")).cast("boolean"))
    return joined.where(paired).drop("_l", "_r")


def band_join(thermal: DataFrame, states: DataFrame, tolerance: float = 0.75) -> DataFrame:
    """Thermal rows with each state whose voltage is within the tolerance of their own, both ends included."""
    bands = states.withColumn("_low", F.col("state_voltage") - tolerance).withColumn("_high", F.col("state_voltage") + tolerance)
    wide = bands.withColumn("_low", F.col("_low") - 1e-6).withColumn("_high", F.col("_high") + 1e-6)
    near = in_ranges(thermal, F.col("abs_voltage"), wide, "_low", "_high", 4 * max(tolerance, 1e-3))
    return near.where(F.abs(F.col("abs_voltage") - F.col("state_voltage")) <= tolerance).drop("_low", "_high")


THERMAL_MEANS = (("abs_voltage", "voltage_mean_v"), ("power_w", "power_mean_w"), ("heat_flux_w_cm2", "heat_flux_mean_w_cm2"), ("subcooling_c", "inlet_subcooling_mean_c"), ("pressure_drop_kpa", "pressure_drop_mean_kpa"), ("htc", "htc_mean_w_m2k"), ("quality", "quality_x7_mean"))


def thermal_summary(thermal: DataFrame, states: DataFrame, tolerance: float = 0.75) -> DataFrame:
    """A row for each state: number of matched rows (0 if none), first and last time, means."""
    # The states themselves go along as rows without a measurement, so that one aggregate serves and no join brings back those without rows.
    matched = band_join(thermal, states, tolerance).unionByName(states.select("state_label", "state_voltage"), allowMissingColumns=True)
    return matched.groupBy("state_label", "state_voltage").agg(
        F.count("row_idx").alias("thermal_rows"), F.min("time_s").alias("time_start_s"), F.max("time_s").alias("time_end_s"), *[F.avg(a).alias(b) for a, b in THERMAL_MEANS]
    )


def acoustic_summary(hits: DataFrame, windows: DataFrame, stretch_s: float = 60.0) -> DataFrame:
    """A row for each window (state_label, time_start_s, time_end_s): hits, rates by its length, mean amplitude.

    Without hits numbers and rates are 0 and the amplitude null; lengths count as 1e-9 s at least.
    """
    windows = windows.dropna(how="any", subset=["state_label", "time_start_s", "time_end_s"]).select("state_label", "time_start_s", "time_end_s")
    # As in thermal_summary, windows go along as rows without a hit.
    inside = in_ranges(hits, F.col("time_s"), windows, "time_start_s", "time_end_s", stretch_s).unionByName(windows, allowMissingColumns=True)
    sums = inside.groupBy("state_label", "time_start_s", "time_end_s").agg(
        F.count("time_s").alias("n"), F.sum("abs_energy").alias("energy"), F.avg("amp").alias("ae_amp_mean_db"), F.count_if(F.col("ch") == 1).alias("n1"), F.count_if(F.col("ch") == 2).alias("n2")
    )
    length = F.greatest(F.col("time_end_s") - F.col("time_start_s"), F.lit(1e-9))
    rate = lambda c: F.coalesce(c, F.lit(0)) / length
    return sums.select(
        "state_label", F.coalesce("n", F.lit(0)).alias("ae_hits"), rate("n").alias("ae_hit_rate_hz"), rate("energy").alias("ae_abs_energy_rate"), "ae_amp_mean_db", rate("n1").alias("ae_ch1_hit_rate_hz"), rate("n2").alias("ae_ch2_hit_rate_hz")
    )


def fused(image: DataFrame, thermal: DataFrame, acoustic: DataFrame) -> DataFrame:
    """Image states outer-joined with thermal states, with what the acoustic windows have; by voltage, nulls last."""
    both = image.join(thermal, ["state_label", "state_voltage"], "full").join(acoustic, "state_label", "left")
    return both.orderBy(F.asc_nulls_last("state_voltage"), F.asc_nulls_last("state_label"))


def multimodal_summary(frames: DataFrame, thermal: DataFrame, hits: DataFrame, states: DataFrame, tolerance: float = 0.75, stretch_s: float = 60.0) -> DataFrame:
    """The fused table of one case from frame metrics, thermal log, hits and states."""
    from quillon.operators.frames import state_summary

    # Written, as it is read twice, once as a table of windows: a row a state.
    heat = Scratch(thermal.sparkSession, "states").table(thermal_summary(thermal, states, tolerance), "heat")
    return fused(state_summary(frames), heat, acoustic_summary(hits, heat, stretch_s))


def ordinal(df: DataFrame, *order, by: Sequence[str] = ()) -> DataFrame:
    """df with _i, the place of each row from 0 in ascending order, within ``by`` if given."""
    return numbered_within(df, by, order).drop("_n") if by else numbered(df, order)
