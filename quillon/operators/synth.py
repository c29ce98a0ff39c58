"""Several cases: union of state tables, nominal conditions, normalised map, key numbers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions import scalar as S

#: The metrics of the state map, in order.
MAP_METRICS = ("heat_flux_mean_w_cm2", "vapor_area_fraction_mean", "active_length_fraction_mean", "ae_abs_energy_rate", "htc_mean_w_m2k")


def with_case(summary: DataFrame, label) -> DataFrame:
    """A case's state table with case_label, mass_flow_g_s and subcooling_nominal_c."""
    flow, cooling = S.nominal(label)
    return summary.withColumns({"case_label": label, "mass_flow_g_s": flow, "subcooling_nominal_c": cooling})


def combined(cases: list[DataFrame]) -> DataFrame:
    """All cases one after the other, by name, columns that a case lacks null; by mass flow and voltage, nulls last."""
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), cases)
    return every.orderBy(F.asc_nulls_last("mass_flow_g_s"), F.asc_nulls_last("state_voltage"), F.asc_nulls_last("state_label"))


def state_map(data: DataFrame, metrics: tuple[str, ...] = MAP_METRICS) -> DataFrame:
    """Each metric scaled by its least and largest value over all rows. The two are one row, sent to all."""
    ends = data.agg(*[F.min(m).alias(f"_lo_{m}") for m in metrics], *[F.max(m).alias(f"_hi_{m}") for m in metrics])
    wide = data.join(F.broadcast(ends))
    return wide.withColumns({m: S.scaled(F.col(m), F.col(f"_lo_{m}"), F.col(f"_hi_{m}")) for m in metrics}).select(*data.columns)


def key_numbers(data: DataFrame) -> DataFrame:
    """Of each case the ranges of heat flux and vapour fraction, and what its first and last state (by voltage, then label) have."""
    place = F.struct(F.coalesce("state_voltage", F.lit(float("inf"))), "state_label")
    of = lambda f, c: f(c, place)
    return data.groupBy("case_label").agg(
        F.min("heat_flux_mean_w_cm2").alias("flux_min"), F.max("heat_flux_mean_w_cm2").alias("flux_max"), F.min("vapor_area_fraction_mean").alias("vapor_min"), F.max("vapor_area_fraction_mean").alias("vapor_max"),
        of(F.min_by, "state_label").alias("first_state"), of(F.min_by, "vapor_area_fraction_mean").alias("first_vapor"), of(F.min_by, "ae_abs_energy_rate").alias("first_energy_rate"),
        of(F.max_by, "state_label").alias("last_state"), of(F.max_by, "vapor_area_fraction_mean").alias("last_vapor"), of(F.max_by, "ae_abs_energy_rate").alias("last_energy_rate"), F.min("mass_flow_g_s").alias("mass_flow_g_s"),
    )


def key_number_lines(numbers: DataFrame) -> DataFrame:
    """Key numbers as text (the words and digits are fixed values): (mass_flow_g_s, case_label, i, line), five lines a case; figures are rounded half to even."""
    text = lambda c, d: F.bround(F.col(c).cast("decimal(30,12)"), d).cast(f"decimal(30,{d})").cast("string")
    lines = F.array(
        F.col("case_label"),
        F.concat(F.lit("  heat flux range: "), text("flux_min", 2), F.lit(" to "), text("flux_max", 2), F.lit(" W/cm2")),
        F.concat(F.lit("  vapor area fraction range: "), text("vapor_min", 3), F.lit(" to "), text("vapor_max", 3)),
        F.concat(F.lit("  first state "), F.col("first_state"), F.lit(": vapor="), text("first_vapor", 3), F.lit(", AE energy rate="), text("first_energy_rate", 1)),
        F.concat(F.lit("  final state "), F.col("last_state"), F.lit(": vapor="), text("last_vapor", 3), F.lit(", AE energy rate="), text("last_energy_rate", 1)),
    )
    return numbers.select("mass_flow_g_s", "case_label", F.posexplode(lines).alias("i", "line"))
