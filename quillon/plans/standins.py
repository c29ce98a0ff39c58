"""The driver's tables in the roles of the experiment's: events as logs and hits, embeddings as frames and pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import scalar as S

#: Labels of states: two with overlapping bands, one without rows, one without a number.
STATES = ("25_ONSET", "30", "49", "50", "500 CHF", "none")
STATES_SQL = ", ".join(f"('{s}')" for s in STATES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def states(spark: SparkSession) -> DataFrame:
    labels = spark.createDataFrame([(s,) for s in STATES], "state_label string")
    return labels.withColumn("state_voltage", S.parse_voltage(F.col("state_label"))).where("state_voltage is not null")


def seconds(ts="ts"):
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', {ts})") / 1e6


def thermal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log rows of half the event types, with pressures and two transfer coefficients that are null here and there."""
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("view", "signup", "purchase"))
    null_if = lambda cond, v: F.when(~cond, v)
    return e.select(
        F.col("event_id").alias("row_idx"),
        seconds().alias("Time [s]"),
        F.when(F.col("event_id") % 2 == 0, -F.col("value")).otherwise(F.col("value")).alias("Voltage [V]"),
        (F.col("value") * 2).alias("Power [W]"),
        (F.col("value") * 1000).alias("Heat Flux [W/m2]"),
        (F.col("user_id") % 30).cast("double").alias("Inlet Subcooling [C]"),
        (100 + F.col("user_id") % 10).cast("double").alias("Inlet Pressure [kPa]"),
        null_if(F.col("event_id") % 11 == 0, (90 + F.col("user_id") % 7).cast("double")).alias("Outlet Pressure [kPa]"),
        null_if(F.col("event_id") % 5 == 0, F.col("value") + 10).alias("Heat Transfer Coefficient x1"),
        null_if(F.col("event_id") % 7 == 0, F.col("value") + 30).alias("Heat Transfer Coefficient x2"),
        ((F.col("event_id") % 100) / 100.0).alias("Quality at x7"),
    )


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("click", "error"))
    return e.select(seconds().alias("time_s"), F.when(F.col("event_type") == "click", F.col("user_id") % 2 + 1).otherwise(F.lit(3)).cast("int").alias("ch"), (F.col("value") / 10).alias("amp"), F.col("value").alias("abs_energy"))


def frame_label():
    named = F.when(F.col("label") < 5, F.element_at(F.array(*[F.lit(s) for s in STATES[:5]]), F.least(F.col("label"), F.lit(4)) + 1))
    return named.otherwise(F.concat(F.lit("S"), F.col("label")))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frame for each label and rest of vec_id by 4: a pixel row for each vector, a column for each component, vapour where it is above 0.1."""
    e = table(spark, sf_dir, "embeddings").select("label", (F.col("vec_id") % 4).cast("int").alias("part"), F.posexplode("embedding").alias("i", "v"))
    cells = e.groupBy("label", "part", "i").agg(F.count("*").alias("h"), F.count_if(F.col("v").cast("double") > 0.1).cast("int").alias("c"))
    whole = cells.groupBy("label", "part").agg(F.max("h").cast("int").alias("height"), F.count("*").cast("int").alias("width"), F.array_sort(F.collect_list(F.struct("i", "c"))).alias("cc"))
    label = frame_label()
    return whole.select(label.alias("state_label"), S.parse_voltage(label).alias("state_voltage"), F.concat(F.lit("frame_"), F.col("part")).alias("frame_name"), "height", "width", F.transform("cc", lambda x: x["c"]).alias("col_counts"))


STATES_CTE = f"states AS (SELECT s AS state_label, CAST(nullif(regexp_extract(s, '[0-9]+(?:[.][0-9]+)?'), '') AS DOUBLE) AS state_voltage FROM (VALUES {STATES_SQL}) t(s) WHERE regexp_extract(s, '[0-9]+(?:[.][0-9]+)?') <> '')"
THERMAL_CTE = """thermal AS (
  SELECT event_id AS row_idx, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) / 1e6 AS time_s, abs(value) AS abs_voltage, value * 2 AS power_w, value * 1000 / 10000.0 AS heat_flux_w_cm2,
    CAST(user_id % 30 AS DOUBLE) AS subcooling_c, CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST(100 + user_id % 10 AS DOUBLE) - CAST(90 + user_id % 7 AS DOUBLE) END AS pressure_drop_kpa,
    list_avg(list_filter([CASE WHEN event_id % 5 = 0 THEN NULL ELSE value + 10 END, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value + 30 END], lambda x: x IS NOT NULL)) AS htc, (event_id % 100) / 100.0 AS quality
  FROM events WHERE event_type IN ('view', 'signup', 'purchase'))"""
HITS_CTE = "hits AS (SELECT (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) / 1e6 AS time_s, CASE WHEN event_type = 'click' THEN user_id % 2 + 1 ELSE 3 END AS ch, value / 10 AS amp, value AS abs_energy FROM events WHERE event_type IN ('click', 'error'))"
FRAMES_CTE = f"""cells AS (
  SELECT label, vec_id % 4 AS part, i, count(*) AS h, count(*) FILTER (CAST(v AS DOUBLE) > 0.1) AS c FROM (SELECT label, vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) GROUP BY ALL
), frames AS (
  SELECT l AS state_label, CAST(nullif(regexp_extract(l, '[0-9]+(?:[.][0-9]+)?'), '') AS DOUBLE) AS state_voltage, 'frame_' || part AS frame_name, height, width, cc FROM (
    SELECT CASE WHEN label < 5 THEN [{', '.join(f"'{s}'" for s in STATES[:5])}][label + 1] ELSE 'S' || label END AS l, part, max(h) AS height, count(*) AS width, list(c ORDER BY i) AS cc FROM cells GROUP BY label, part)
), metrics AS (
  SELECT state_label, state_voltage, frame_name, height, width, cc, list_sum(cc) / (height * width) AS vapor_area_fraction,
    len(list_filter(cc, lambda x: x / height > 0.05)) / width AS active_length_fraction,
    CAST(list_max(list_filter(range(0, width), lambda i: cc[i + 1] / height > 0.05)) AS DOUBLE) AS vapor_front_x_px FROM frames
)"""
SUMMARY_CTE = """image AS (
  SELECT state_label, state_voltage, count(frame_name) AS image_frames, avg(vapor_area_fraction) AS vapor_area_fraction_mean, stddev_samp(vapor_area_fraction) AS vapor_area_fraction_std,
    avg(active_length_fraction) AS active_length_fraction_mean, avg(vapor_front_x_px) AS vapor_front_x_px_mean FROM metrics GROUP BY ALL)"""
HEAT_CTE = """heat AS (
  SELECT s.state_label, s.state_voltage, count(t.row_idx) AS thermal_rows, min(time_s) AS time_start_s, max(time_s) AS time_end_s, avg(abs_voltage) AS voltage_mean_v, avg(power_w) AS power_mean_w, avg(heat_flux_w_cm2) AS heat_flux_mean_w_cm2,
    avg(subcooling_c) AS inlet_subcooling_mean_c, avg(pressure_drop_kpa) AS pressure_drop_mean_kpa, avg(htc) AS htc_mean_w_m2k, avg(quality) AS quality_x7_mean
  FROM states s LEFT JOIN thermal t ON abs(t.abs_voltage - s.state_voltage) <= 0.75 GROUP BY ALL)"""
ACOUSTIC_CTE = """acoustic AS (
  SELECT w.state_label, count(h.time_s) AS ae_hits, count(h.time_s) / greatest(w.time_end_s - w.time_start_s, 1e-9) AS ae_hit_rate_hz, coalesce(sum(abs_energy), 0) / greatest(w.time_end_s - w.time_start_s, 1e-9) AS ae_abs_energy_rate, avg(amp) AS ae_amp_mean_db,
    count(*) FILTER (ch = 1) / greatest(w.time_end_s - w.time_start_s, 1e-9) AS ae_ch1_hit_rate_hz, count(*) FILTER (ch = 2) / greatest(w.time_end_s - w.time_start_s, 1e-9) AS ae_ch2_hit_rate_hz
  FROM (SELECT * FROM heat WHERE time_start_s IS NOT NULL) w LEFT JOIN hits h ON h.time_s >= w.time_start_s AND h.time_s <= w.time_end_s GROUP BY w.state_label, w.time_start_s, w.time_end_s)"""
