"""The registered queries over the driver's tables and their SQL, by what they compute."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import scalar as S
from quillon.operators import annotate, frames, fuse, pixelmodel, runs, synth
from quillon.plans import standins as I
from quillon.sources import tables

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) by its name, with its SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to so many digits: sums differ in their last bits with the order of rows."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def sql_rounded(columns: str, source: str) -> str:
    """SELECT of columns, those with a trailing ~ rounded to 6 digits."""
    return "SELECT " + ", ".join(f"round({c[:-1]}, 6) AS {c[:-1]}" if c.endswith("~") else c for c in columns.split()) + f" FROM {source}"


def thermal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuse.thermal_frame(I.thermal(spark, sf_dir), abs_voltage=F.abs("Voltage [V]"))


HEAT = "state_label state_voltage thermal_rows time_start_s~ time_end_s~ voltage_mean_v~ power_mean_w~ heat_flux_mean_w_cm2~ inlet_subcooling_mean_c~ pressure_drop_mean_kpa~ htc_mean_w_m2k~ quality_x7_mean~"
IMAGE = "state_label state_voltage image_frames vapor_area_fraction_mean~ vapor_area_fraction_std~ active_length_fraction_mean~ vapor_front_x_px_mean~"
ACOUSTIC = "state_label ae_hits ae_hit_rate_hz~ ae_abs_energy_rate~ ae_amp_mean_db~ ae_ch1_hit_rate_hz~ ae_ch2_hit_rate_hz~"
FUSED = f"{IMAGE} {HEAT.removeprefix('state_label state_voltage ')} {ACOUSTIC.removeprefix('state_label ')}"
CTES = ",\n".join((I.STATES_CTE, I.THERMAL_CTE, I.HITS_CTE, I.FRAMES_CTE, I.SUMMARY_CTE, I.HEAT_CTE, I.ACOUSTIC_CTE))
FUSED_SOURCE = "(SELECT coalesce(i.state_label, h.state_label) AS state_label, coalesce(i.state_voltage, h.state_voltage) AS state_voltage, i.* EXCLUDE (state_label, state_voltage), h.* EXCLUDE (state_label, state_voltage), a.* EXCLUDE (state_label) FROM image i FULL JOIN heat h ON i.state_label = h.state_label AND i.state_voltage = h.state_voltage LEFT JOIN acoustic a ON a.state_label = coalesce(i.state_label, h.state_label))"


@query(f"WITH {CTES}\n{sql_rounded(FUSED, FUSED_SOURCE)}")
def fuse_flagship(spark, sf_dir):
    metrics = frames.mask_metrics(I.frames(spark, sf_dir))
    return rounded(fuse.multimodal_summary(metrics, thermal(spark, sf_dir), I.hits(spark, sf_dir), I.states(spark), stretch_s=86400.0))


@query(f"WITH {CTES}\nSELECT s.state_label, t.row_idx FROM states s JOIN thermal t ON abs(t.abs_voltage - s.state_voltage) <= 0.75")
def band_join_states(spark, sf_dir):
    return fuse.band_join(thermal(spark, sf_dir), I.states(spark)).select("state_label", "row_idx")


@query(f"WITH {CTES}\n{sql_rounded(HEAT, 'heat')}")
def thermal_summary(spark, sf_dir):
    return rounded(fuse.thermal_summary(thermal(spark, sf_dir), I.states(spark)))


@query(f"WITH {CTES}\n{sql_rounded(ACOUSTIC, 'acoustic')}")
def acoustic_rates(spark, sf_dir):
    heat = fuse.thermal_summary(thermal(spark, sf_dir), I.states(spark))
    return rounded(fuse.acoustic_summary(I.hits(spark, sf_dir), heat, 86400.0))


@query(f"WITH {CTES}\nSELECT w.state_label, count(h.time_s) AS n FROM (SELECT state_label, time_start_s AS a, time_start_s + 3600 AS b FROM heat WHERE time_start_s IS NOT NULL) w LEFT JOIN hits h ON h.time_s BETWEEN w.a AND w.b GROUP BY 1")
def interval_join_hits(spark, sf_dir):
    heat = fuse.thermal_summary(thermal(spark, sf_dir), I.states(spark)).withColumn("time_end_s", F.col("time_start_s") + 3600)
    return fuse.acoustic_summary(I.hits(spark, sf_dir), heat, 600.0).select("state_label", F.col("ae_hits").alias("n"))


@query(f"WITH {CTES}\n{sql_rounded('state_label state_voltage frame_name vapor_area_fraction~ active_length_fraction~ vapor_front_x_px', 'metrics')}")
def mask_metrics(spark, sf_dir):
    return rounded(frames.mask_metrics(I.frames(spark, sf_dir)).drop("height", "width", "col_counts"))


@query(f"WITH {CTES}\n{sql_rounded(IMAGE, 'image')}")
def frame_state_summary(spark, sf_dir):
    return rounded(frames.state_summary(frames.mask_metrics(I.frames(spark, sf_dir))))


@query(f"WITH {CTES}\nSELECT state_label, state_voltage, round(vapor_area_fraction_mean, 6) AS vapor_area_fraction_mean, round(coalesce(vapor_area_fraction_std, 0), 6) AS error FROM image")
def state_error_bars(spark, sf_dir):
    return rounded(frames.error_bars(frames.state_summary(frames.mask_metrics(I.frames(spark, sf_dir)))))


PROFILE_SQL = """, edges AS (
  SELECT *, unnest(range(0, {bins})) AS bin_index FROM frames
), bins AS (
  SELECT *, CAST(floor(bin_index * (width / {bins}.0)) AS INT) AS x_start_px, CAST(CASE WHEN bin_index = {bins} - 1 THEN width ELSE floor((bin_index + 1) * (width / {bins}.0)) END AS INT) AS x_end_px FROM edges
)
SELECT state_label, frame_name, CAST(bin_index AS INT) AS bin_index, x_start_px, x_end_px, 0.5 * (x_start_px + x_end_px - 1)::DOUBLE AS x_center_px, CAST((x_end_px - x_start_px) * height AS BIGINT) AS total_area_px,
  CAST(list_sum(cc[x_start_px + 1:x_end_px]) AS BIGINT) AS bubble_area_px, round(list_sum(cc[x_start_px + 1:x_end_px]) / ((x_end_px - x_start_px) * height), 6) AS projected_vapor_area_fraction
FROM bins WHERE x_end_px > x_start_px"""


@query(f"WITH {CTES}{PROFILE_SQL.format(bins=10)}")
def streamwise_profile(spark, sf_dir):
    return rounded(frames.profile(I.frames(spark, sf_dir), 10).drop("state_voltage"))


@query(f"WITH {CTES}{PROFILE_SQL.format(bins=100)}")
def streamwise_profile_gaps(spark, sf_dir):
    return rounded(frames.profile(I.frames(spark, sf_dir), 100).drop("state_voltage"))


@query(f"WITH {CTES}, p AS (SELECT * FROM ({PROFILE_SQL.format(bins=10).lstrip(', ').replace('edges AS', 'WITH edges AS', 1)})) SELECT state_label, frame_name, round(avg(projected_vapor_area_fraction), 5) AS mean_fraction FROM p GROUP BY ALL")
def profile_mean(spark, sf_dir):
    profile = rounded(frames.profile(I.frames(spark, sf_dir), 10))
    return profile.groupBy("state_label", "frame_name").agg(F.round(F.avg("projected_vapor_area_fraction"), 5).alias("mean_fraction"))


@query("""WITH i AS (SELECT label, vec_id % 4 AS part, generate_subscripts(embedding, 1) - 1 AS x, CAST(unnest(embedding) AS DOUBLE) > 0.2 AS covered FROM embeddings WHERE label > 2),
f AS (SELECT label, part, x FROM (SELECT DISTINCT label, vec_id % 4 AS part FROM embeddings), (SELECT unnest(range(0, 64)) AS x))
SELECT f.label, f.part, f.x, coalesce(bool_or(covered), false) AS mask FROM f LEFT JOIN i USING (label, part, x) GROUP BY ALL""")
def or_reduce_masks(spark, sf_dir):
    e = I.table(spark, sf_dir, "embeddings").withColumn("part", F.col("vec_id") % 4)
    instances = e.where("label > 2").select("label", "part", F.posexplode("embedding").alias("x", "v")).select("label", "part", F.col("x").cast("long").alias("x"), (F.col("v").cast("double") > 0.2).alias("covered"))
    places = e.select("label", "part").distinct().select("label", "part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(63).cast("long"))).alias("x"))
    return frames.union_masks(instances, places, ["label", "part"])


@query("""SELECT coalesce(c.n_nationkey, s.n_nationkey) AS n_nationkey, c.customers, round(s.balance, 4) AS balance FROM
(SELECT c_nationkey AS n_nationkey, count(*) AS customers FROM customer WHERE c_nationkey % 3 <> 0 GROUP BY 1) c FULL JOIN (SELECT s_nationkey AS n_nationkey, sum(s_acctbal) AS balance FROM supplier WHERE s_nationkey % 4 <> 0 GROUP BY 1) s ON c.n_nationkey = s.n_nationkey""")
def outer_merge(spark, sf_dir):
    c = I.table(spark, sf_dir, "customer").where("c_nationkey % 3 <> 0").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("customers"))
    s = I.table(spark, sf_dir, "supplier").where("s_nationkey % 4 <> 0").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.round(F.sum("s_acctbal"), 4).alias("balance"))
    return c.join(s, "n_nationkey", "full")


@query("""SELECT CAST(row_number() OVER (ORDER BY s.n ASC NULLS LAST, n.n_name) AS INT) AS place, n.n_name, s.n FROM nation n LEFT JOIN (SELECT s_nationkey, count(*) AS n FROM supplier WHERE s_nationkey % 4 <> 0 GROUP BY 1) s ON n.n_nationkey = s.s_nationkey""")
def left_merge_nulls_last(spark, sf_dir):
    s = I.table(spark, sf_dir, "supplier").where("s_nationkey % 4 <> 0").groupBy("s_nationkey").agg(F.count("*").alias("n"))
    joined = I.table(spark, sf_dir, "nation").join(s, F.col("n_nationkey") == F.col("s_nationkey"), "left")
    return fuse.ordinal(joined, F.col("n").isNull(), "n", "n_name").select((F.col("_i") + 1).cast("int").alias("place"), "n_name", "n")


@query("SELECT o_orderkey AS row_idx, o_totalprice AS a, abs(o_totalprice) AS b FROM orders")
def positional_zip(spark, sf_dir):
    o = I.table(spark, sf_dir, "orders")
    return fuse.positional_zip(o.select(F.col("o_orderkey").alias("row_idx"), F.col("o_totalprice").alias("a")), o.select(F.col("o_orderkey").alias("row_idx"), F.abs("o_totalprice").alias("b")))


@query("SELECT row_number() OVER () - 1 AS row_idx, ts AS a, abs(value) AS b FROM events")
def ingest_zip(spark, sf_dir):
    """Two logs without a column in common, zipped by the order in which their rows stand in the files."""
    left = tables.in_file_order(I.table(spark, sf_dir, "events").select(F.col("ts").alias("a"), "_metadata"))
    right = tables.in_file_order(I.table(spark, sf_dir, "events").select(F.abs("value").alias("b"), "_metadata"))
    return fuse.positional_zip(left.drop("_metadata"), right.drop("_metadata")).select("row_idx", "a", "b")


@query("SELECT user_id, min(i) AS first_place FROM (SELECT user_id, row_number() OVER () - 1 AS i FROM events) GROUP BY 1")
def appearance_order(spark, sf_dir):
    """Groups by where they appear first in a log's files."""
    return frames.in_order_of_appearance(tables.in_file_order(I.table(spark, sf_dir, "events").select("user_id", "_metadata")), ["user_id"])


@query("""SELECT l_returnflag, round(avg(m), 6) AS mean_of_means FROM (SELECT l_returnflag, CASE WHEN l_discount <> 0 AND l_tax <> 0 THEN (l_discount + l_tax) / 2 WHEN l_discount <> 0 THEN l_discount WHEN l_tax <> 0 THEN l_tax END AS m FROM lineitem) GROUP BY 1""")
def row_mean_of_columns(spark, sf_dir):
    zero = lambda c: F.nullif(F.col(c), F.lit(0.0))
    return I.table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(F.avg(S.row_mean([zero("l_discount"), zero("l_tax")])), 6).alias("mean_of_means"))


@query(f"WITH {CTES}\nSELECT round(avg(pressure_drop_kpa), 6) AS pressure_drop, count(pressure_drop_kpa) AS n, count(*) AS n_all FROM thermal")
def pressure_drop_mean(spark, sf_dir):
    return thermal(spark, sf_dir).agg(F.round(F.avg("pressure_drop_kpa"), 6).alias("pressure_drop"), F.count("pressure_drop_kpa").alias("n"), F.count("*").alias("n_all"))


CASE_SQL = "CASE WHEN {c} LIKE '5gs%' THEN 5.0 WHEN {c} LIKE '10gs%' THEN 10.0 WHEN {c} LIKE '15gs%' THEN 15.0 WHEN {c} LIKE '25gs%' THEN 25.0 END"
COOL_SQL = "CASE WHEN {c} LIKE '5gs%' OR {c} LIKE '10gs%' THEN 22.0 WHEN {c} LIKE '15gs%' OR {c} LIKE '25gs%' THEN 20.0 END"
LABEL_SQL = "((o_orderkey % 6) * 5) || 'gs_' || o_orderpriority"


@query(f"SELECT l AS case_label, count(*) AS n, any_value(CAST({CASE_SQL.format(c='l')} AS DOUBLE)) AS mass_flow_g_s, any_value(CAST({COOL_SQL.format(c='l')} AS DOUBLE)) AS subcooling_nominal_c FROM (SELECT replace({LABEL_SQL} || '_multimodal_state_summary.csv', '_multimodal_state_summary.csv', '') AS l FROM orders) GROUP BY 1")
def nominal_case_map(spark, sf_dir):
    name = F.concat((F.col("o_orderkey") % 6 * 5).cast("string"), F.lit("gs_"), F.col("o_orderpriority"), F.lit(S.SUMMARY_SUFFIX))
    flow, cooling = S.nominal(F.col("case_label"))
    return I.table(spark, sf_dir, "orders").select(S.case_label(name).alias("case_label")).groupBy("case_label").agg(F.count("*").alias("n")).select("case_label", "n", flow.alias("mass_flow_g_s"), cooling.alias("subcooling_nominal_c"))


# A state table out of orders: a case for each priority, a state for each quarter of a key.
STATE_TABLE_SQL = "states AS (SELECT (CAST(substr(o_orderpriority, 1, 1) AS INT) * 5) || 'gs_' || o_orderstatus AS case_label, 'Q' || (o_custkey % 7) AS state_label, CAST(o_custkey % 7 AS DOUBLE) AS state_voltage, avg(o_totalprice) / 10000 AS heat_flux_mean_w_cm2, avg(o_orderkey % 100) / 100 AS vapor_area_fraction_mean, 0.5 AS active_length_fraction_mean, sum(o_totalprice) / 1000 AS ae_abs_energy_rate, CASE WHEN o_custkey % 7 = 3 THEN NULL ELSE max(o_totalprice) END AS htc_mean_w_m2k FROM orders GROUP BY 1, 2, 3, o_custkey % 7)"


def state_table(spark, sf_dir) -> DataFrame:
    o = I.table(spark, sf_dir, "orders")
    label = F.concat((F.substring("o_orderpriority", 1, 1).cast("int") * 5).cast("string"), F.lit("gs_"), F.col("o_orderstatus"))
    o = o.select(label.alias("case_label"), F.concat(F.lit("Q"), F.col("o_custkey") % 7).alias("state_label"), (F.col("o_custkey") % 7).cast("double").alias("state_voltage"), "o_totalprice", "o_orderkey")
    s = o.groupBy("case_label", "state_label", "state_voltage").agg(
        (F.avg("o_totalprice") / 10000).alias("heat_flux_mean_w_cm2"), (F.avg(F.col("o_orderkey") % 100) / 100).alias("vapor_area_fraction_mean"), F.lit(0.5).alias("active_length_fraction_mean"),
        (F.sum("o_totalprice") / 1000).alias("ae_abs_energy_rate"), F.max("o_totalprice").alias("htc_mean_w_m2k"),
    )
    return s.withColumn("htc_mean_w_m2k", F.when(F.col("state_voltage") != 3, F.col("htc_mean_w_m2k")))


@query(f"WITH {STATE_TABLE_SQL} SELECT *, CAST({CASE_SQL.format(c='case_label')} AS DOUBLE) AS mass_flow_g_s, CAST({COOL_SQL.format(c='case_label')} AS DOUBLE) AS subcooling_nominal_c FROM (SELECT case_label, state_label, state_voltage, round(heat_flux_mean_w_cm2, 6) AS heat_flux_mean_w_cm2, CASE WHEN case_label LIKE '5gs%' THEN round(htc_mean_w_m2k, 6) END AS htc_mean_w_m2k FROM states WHERE case_label LIKE '5gs%' OR case_label LIKE '10gs%' OR case_label LIKE '20gs%')")
def union_cases(spark, sf_dir):
    base = rounded(state_table(spark, sf_dir)).select("case_label", "state_label", "state_voltage", "heat_flux_mean_w_cm2", "htc_mean_w_m2k")
    cases = [base.where(F.col("case_label").startswith(p)) for p in ("5gs", "10gs", "20gs")]
    cases[1:] = [c.drop("htc_mean_w_m2k") for c in cases[1:]]
    return synth.combined([synth.with_case(c, F.col("case_label")) for c in cases])


MAP_SQL = ", ".join(f"round(({m} - min({m}) OVER ()) / CASE WHEN max({m}) OVER () > min({m}) OVER () THEN max({m}) OVER () - min({m}) OVER () ELSE 1 END, 6) AS {m}" for m in synth.MAP_METRICS)


@query(f"WITH {STATE_TABLE_SQL} SELECT case_label || ' | ' || state_label AS label, {MAP_SQL} FROM states")
def minmax_state_map(spark, sf_dir):
    data = synth.state_map(state_table(spark, sf_dir))
    return rounded(data.select(S.display_label(F.col("case_label"), F.col("state_label")).alias("label"), *[m for m in synth.MAP_METRICS]))


@query(f"WITH {STATE_TABLE_SQL} SELECT case_label, round(min(heat_flux_mean_w_cm2), 6) AS flux_min, round(max(heat_flux_mean_w_cm2), 6) AS flux_max, round(min(vapor_area_fraction_mean), 6) AS vapor_min, round(max(vapor_area_fraction_mean), 6) AS vapor_max, arg_min(state_label, state_voltage) AS first_state, round(arg_min(vapor_area_fraction_mean, state_voltage), 6) AS first_vapor, round(arg_min(ae_abs_energy_rate, state_voltage), 6) AS first_energy_rate, arg_max(state_label, state_voltage) AS last_state, round(arg_max(vapor_area_fraction_mean, state_voltage), 6) AS last_vapor, round(arg_max(ae_abs_energy_rate, state_voltage), 6) AS last_energy_rate FROM states GROUP BY 1")
def key_numbers(spark, sf_dir):
    data = state_table(spark, sf_dir)
    return rounded(synth.key_numbers(synth.with_case(data, F.col("case_label"))).drop("mass_flow_g_s"))


@query("SELECT l, CAST(nullif(regexp_extract(l, '[0-9]+(?:[.][0-9]+)?'), '') AS DOUBLE) AS voltage, count(*) AS n FROM (SELECT p_brand || ' ' || (p_retailprice - 900)::DECIMAL(12,2) AS l FROM part UNION ALL SELECT o_orderpriority FROM orders UNION ALL SELECT o_orderstatus FROM orders) GROUP BY ALL")
def parse_state_voltage(spark, sf_dir):
    part = I.table(spark, sf_dir, "part").select(F.concat("p_brand", F.lit(" "), (F.col("p_retailprice") - 900).cast("decimal(12,2)").cast("string")).alias("l"))
    orders = I.table(spark, sf_dir, "orders")
    every = part.unionAll(orders.select("o_orderpriority")).unionAll(orders.select("o_orderstatus"))
    return every.groupBy("l").agg(F.count("*").alias("n")).select("l", S.parse_voltage(F.col("l")).alias("voltage"), "n")


@query("SELECT regexp_replace(o_orderpriority || ' / ' || o_orderstatus, '[^A-Za-z0-9_.\\-]+', '_', 'g') AS name, count(*) AS n FROM orders GROUP BY 1")
def safe_name(spark, sf_dir):
    name = S.safe_name(F.concat("o_orderpriority", F.lit(" / "), "o_orderstatus"))
    return I.table(spark, sf_dir, "orders").groupBy(name.alias("name")).agg(F.count("*").alias("n"))


@query("SELECT p_partkey, CAST(p_partkey % 50 AS INT) AS x, CAST(p_size AS INT) AS y, CAST(p_size + 10 AS INT) AS w, 7 AS h FROM part")
def parse_roi(spark, sf_dir):
    text = F.concat_ws(",", (F.col("p_partkey") % 50).cast("string"), F.concat(F.lit(" "), F.col("p_size")), F.concat(F.col("p_size") + 10, F.lit(" ")), F.lit(" 7 "))
    roi = S.parse_roi(text)
    return I.table(spark, sf_dir, "part").select("p_partkey", roi.alias("r")).select("p_partkey", "r.*")


@query("SELECT p_partkey, greatest(1, p_size - 3) + (1 - greatest(1, p_size - 3) % 2) AS kernel, greatest(0.05, least(1.0, 1.2 * (p_retailprice / 2000))) AS axis_limit, CAST(round(40 + 1.2 * p_size, 6) AS DOUBLE) AS marker FROM part")
def plot_scalars(spark, sf_dir):
    return rounded(I.table(spark, sf_dir, "part")).select("p_partkey", S.odd_kernel(F.col("p_size") - 3).alias("kernel"), S.axis_limit(F.col("p_retailprice") / 2000).alias("axis_limit"), F.round(S.marker_size(F.col("p_size")).cast("double"), 6).alias("marker"))


@query("SELECT label, count(*) AS n FROM (SELECT lower(trim(coalesce(l, ''))) AS label FROM (SELECT '  ' || o_orderpriority || ' ' AS l FROM orders UNION ALL SELECT NULL)) GROUP BY 1")
def canonical_label(spark, sf_dir):
    l = I.table(spark, sf_dir, "orders").select(F.concat(F.lit("  "), "o_orderpriority", F.lit(" ")).alias("l")).unionAll(spark.range(1).select(F.lit(None).cast("string")))
    return l.groupBy(S.canonical_label(F.col("l")).alias("label")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, i AS ordinal, CASE WHEN i % 5 = 0 THEN 'val' ELSE 'train' END AS split FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents)")
def holdout_split(spark, sf_dir):
    return annotate.holdout(I.table(spark, sf_dir, "documents").select("doc_id"), [F.col("doc_id")])


@query("SELECT doc_id, i AS ordinal, CASE WHEN i % 5 = 0 THEN 'val' ELSE 'train' END AS split FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents SEMI JOIN labels USING (doc_id))")
def holdout_of_existing(spark, sf_dir):
    docs, labels = (I.table(spark, sf_dir, t).select("doc_id") for t in ("documents", "labels"))
    return annotate.holdout_of_existing(docs, labels, "doc_id", [F.col("doc_id")])


@query("SELECT doc_id, i AS ordinal FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents) WHERE i % 5 = 0 AND i < 40")
def validation_examples(spark, sf_dir):
    split = annotate.holdout(I.table(spark, sf_dir, "documents").select("doc_id"), [F.col("doc_id")])
    return annotate.first_examples(split, 8).select("doc_id", "ordinal")


@query("SELECT 'with' AS side, count(*) AS n FROM documents SEMI JOIN labels USING (doc_id) UNION ALL SELECT 'without', count(*) FROM documents ANTI JOIN labels USING (doc_id)")
def semi_anti_missing(spark, sf_dir):
    docs, labels = (I.table(spark, sf_dir, t) for t in ("documents", "labels"))
    count = lambda how, side: docs.join(labels, "doc_id", how).agg(F.lit(side).alias("side"), F.count("*").alias("n"))
    return count("left_semi", "with").unionAll(count("left_anti", "without"))


EVEN_SQL = """WITH o AS (SELECT o_orderpriority AS g, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders),
p AS (SELECT DISTINCT g, CASE WHEN k = {k} - 1 THEN n - 1 ELSE CAST(floor(k * ((n - 1) / ({k} - 1.0))) AS BIGINT) END AS i FROM o, (SELECT unnest(range(0, {k})) AS k))
SELECT g, o_orderkey FROM o SEMI JOIN p USING (g, i)"""


@query(EVEN_SQL.format(k=12))
def sample_evenly(spark, sf_dir):
    return frames.sample_evenly(I.table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("g"), "o_orderkey"), ["g"], ["o_orderkey"], 12)


@query("SELECT g, o_orderkey FROM (SELECT o_orderpriority AS g, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders) WHERE i = n // 2")
def middle_frame(spark, sf_dir):
    return frames.middle(I.table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("g"), "o_orderkey"), ["g"], ["o_orderkey"])


@query("SELECT p_partkey FROM part ORDER BY p_partkey LIMIT 17")
def limit_listing(spark, sf_dir):
    return I.table(spark, sf_dir, "part").select("p_partkey").orderBy("p_partkey").limit(17)


SEEDED = (4, 9, 27, 58, 77, 93, 121, 160)


@query(f"SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents) WHERE i IN {SEEDED}")
def seeded_sample(spark, sf_dir):
    """The rows at positions drawn on the driver by a seeded generator; here the positions are given."""
    return fuse.ordinal(I.table(spark, sf_dir, "documents").select("doc_id"), "doc_id").where(F.col("_i").isin(*SEEDED)).select("doc_id")


@query("SELECT doc_id, source FROM documents ORDER BY md5('7:' || doc_id), doc_id LIMIT 40")
def seeded_bottom_sample(spark, sf_dir):
    return frames.seeded_sample(I.table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", 40)


def polygons(spark, sf_dir) -> DataFrame:
    """Of each vector 32 points, in hundredths."""
    e = I.table(spark, sf_dir, "embeddings")
    at = lambda i: F.round(F.get("embedding", i).cast("double") * 100, 3)
    return e.select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.struct(at(2 * i).alias("x"), at(2 * i + 1).alias("y"))).alias("points"))


POLYGON_SQL = "polygons AS (SELECT vec_id, list_transform(range(0, 32), lambda i: {'x': round(CAST(embedding[2 * i + 1] AS DOUBLE) * 100, 3), 'y': round(CAST(embedding[2 * i + 2] AS DOUBLE) * 100, 3)}) AS p FROM embeddings)"
AREA_SQL = "0.5 * list_sum(list_transform(range(1, len({p}) + 1), lambda i: {p}[i].x * {p}[CASE WHEN i = len({p}) THEN 1 ELSE i + 1 END].y - {p}[CASE WHEN i = len({p}) THEN 1 ELSE i + 1 END].x * {p}[i].y))"
BBOX_SQL = "round(list_min(list_transform({p}, lambda q: q.x)), 4) AS x, round(list_min(list_transform({p}, lambda q: q.y)), 4) AS y, round(list_max(list_transform({p}, lambda q: q.x)) - list_min(list_transform({p}, lambda q: q.x)), 4) AS w, round(list_max(list_transform({p}, lambda q: q.y)) - list_min(list_transform({p}, lambda q: q.y)), 4) AS h"


def bbox_columns(points):
    box = S.polygon_bbox(points)
    return [F.round(F.get(box, F.lit(i)), 4).alias(n) for i, n in enumerate("xywh")]


@query(f"WITH {POLYGON_SQL} SELECT vec_id, {BBOX_SQL.format(p='p')}, round({AREA_SQL.format(p='p')}, 4) AS area FROM polygons")
def polygon_bbox_area(spark, sf_dir):
    p = F.col("points")
    return polygons(spark, sf_dir).select("vec_id", *bbox_columns(p), F.round(S.polygon_area(p), 4).alias("area"))


@query(f"WITH {POLYGON_SQL}, moved AS (SELECT vec_id, list_transform(p, lambda q: {{'x': q.x - 2, 'y': q.y - 1}}) AS p FROM polygons), held AS (SELECT vec_id, list_transform(p, lambda q: {{'x': least(greatest(q.x, 0.0), 9.0), 'y': least(greatest(q.y, 0.0), 6.0)}}) AS p, len(list_filter(p, lambda q: NOT (q.x < 0 OR q.x > 9 OR q.y < 0 OR q.y > 6))) AS inside FROM moved) SELECT vec_id, {BBOX_SQL.format(p='p')}, round({AREA_SQL.format(p='p')}, 4) AS area, CAST(2 * len(p) AS INT) AS n_flat FROM held WHERE inside > 0 AND len(list_distinct(p)) >= 3")
def polygon_roi_clamp(spark, sf_dir):
    held = polygons(spark, sf_dir).withColumn("points", S.clamp_polygon(F.col("points"), *[F.lit(v) for v in (2, 1, 9, 6)])).where("points is not null")
    p = F.col("points")
    return held.select("vec_id", *bbox_columns(p), F.round(S.polygon_area(p), 4).alias("area"), F.size(S.polygon_flat(p)).alias("n_flat"))


# Twenty vectors are the shapes of an image; every ninth has two points, every fourth another label.
ANNOTATED_SQL = f"""{POLYGON_SQL}, shapes AS (
  SELECT CASE WHEN (o - 1) % 5 = 0 THEN 'val' ELSE 'train' END AS split, image, vec_id, p[:CASE WHEN vec_id % 9 = 0 THEN 2 ELSE 32 END] AS p FROM polygons JOIN (SELECT i AS image, row_number() OVER (ORDER BY i) AS o FROM (SELECT DISTINCT vec_id // 20 AS i FROM embeddings)) ON image = vec_id // 20 WHERE vec_id % 4 <> 1
), measured AS (SELECT *, abs({AREA_SQL.format(p='p')}) AS area, list_max(list_transform(p, lambda q: q.x)) - list_min(list_transform(p, lambda q: q.x)) AS w, list_max(list_transform(p, lambda q: q.y)) - list_min(list_transform(p, lambda q: q.y)) AS h FROM shapes WHERE len(p) >= 3),
images AS (SELECT image, split, CAST(row_number() OVER (PARTITION BY split ORDER BY image) AS INT) AS image_id FROM (SELECT DISTINCT image, split FROM shapes))"""


@query(f"WITH {ANNOTATED_SQL} SELECT split, image_id, row_number() OVER (PARTITION BY split ORDER BY image_id, vec_id) AS id, vec_id, round(area, 8) AS area FROM measured JOIN images USING (image, split) WHERE area > 1 AND w > 1 AND h > 1")
def coco_ids(spark, sf_dir):
    """Annotation ids over the shapes left, of documents of twenty shapes."""
    points = F.transform(F.slice("points", F.lit(1), F.when(F.col("vec_id") % 9 == 0, 2).otherwise(32)), lambda p: F.array(p["x"], p["y"]))
    shape = F.struct(F.when(F.col("vec_id") % 4 == 1, "wall").otherwise(" Bubble ").alias("label"), points.alias("points"))
    listed = polygons(spark, sf_dir).groupBy(F.floor(F.col("vec_id") / 20).alias("image")).agg(F.array_sort(F.collect_list(F.struct("vec_id", shape.alias("shape")))).alias("s"))
    docs = annotate.holdout_ids(listed, ["image"])
    vec = docs.select("split", "image_id", F.posexplode(F.transform("s", lambda x: x["vec_id"])).alias("position", "vec_id"))
    kept = annotate.shapes(docs.select("split", "image_id", F.transform("s", lambda x: x["shape"]).alias("shapes")))
    return annotate.annotation_ids(kept).join(vec, ["split", "image_id", "position"]).select("split", "image_id", "id", "vec_id", F.round("area", 8).alias("area"))


@query("SELECT split, CAST(row_number() OVER (PARTITION BY split ORDER BY doc_id) AS INT) AS image_id, doc_id FROM (SELECT doc_id, source AS split FROM documents WHERE source IS NOT NULL)")
def ids_by_split(spark, sf_dir):
    """Ids from 1 within splits that are given."""
    d = I.table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("split")).where("split is not null")
    return annotate.image_ids(d, ["doc_id"]).select("split", "image_id", "doc_id")


FIT_SQL = "fit AS (SELECT label = 0 AS foreground, i, count(*) AS n, avg(v) AS mean, stddev_pop(v) + 1e-4 AS std FROM (SELECT label, generate_subscripts(embedding, 1) - 1 AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) GROUP BY 1, 2)"


def pixels(spark, sf_dir) -> DataFrame:
    return I.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pixel"), (F.col("label") == 0).alias("foreground"), F.col("embedding").alias("features"))


@query(f"WITH {FIT_SQL} SELECT foreground, CAST(i AS INT) AS i, n, round(mean, 6) AS mean, round(std, 6) AS std FROM fit")
def gaussian_fit(spark, sf_dir):
    return rounded(pixelmodel.moments(pixels(spark, sf_dir)))


@query(f"""WITH {FIT_SQL}, prior AS (SELECT max(n) FILTER (foreground) / (max(n) FILTER (foreground) + max(n) FILTER (NOT foreground)) AS p FROM fit),
x AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
d AS (SELECT vec_id, foreground, -0.5 * sum(pow((v - mean) / std, 2) + 2 * ln(std) + ln(2 * pi())) AS l FROM x JOIN fit USING (i) GROUP BY 1, 2),
o AS (SELECT vec_id, max(l) FILTER (foreground) + ln(p + 1e-9) AS f, max(l) FILTER (NOT foreground) + ln(1 - p + 1e-9) AS b FROM d, prior GROUP BY vec_id, p)
SELECT vec_id AS pixel, round(1 / (1 + exp(greatest(-60.0, least(60.0, b - f)))), 6) AS probability FROM o""")
def gaussian_score(spark, sf_dir):
    x = pixels(spark, sf_dir)
    return rounded(pixelmodel.score(x, pixelmodel.fit(x)).select("pixel", "probability"))


@query("SELECT lang, coalesce(round(count(*) FILTER (quality = 1 AND toxic = 1) / nullif(count(*) FILTER (quality = 1 OR toxic = 1), 0), 6), 1.0) AS iou FROM documents JOIN labels USING (doc_id) WHERE lang <> 'de' OR (quality = 0 AND toxic = 0) GROUP BY 1")
def iou_by_group(spark, sf_dir):
    d = I.table(spark, sf_dir, "documents").select("doc_id", "lang").join(I.table(spark, sf_dir, "labels"), "doc_id").where("lang <> 'de' or (quality = 0 and toxic = 0)")
    return rounded(pixelmodel.iou(d, ["lang"], F.col("quality") == 1, F.col("toxic") == 1))


@query("SELECT CAST(round(v * 10) AS INT) AS tenth, count(*) AS n FROM (SELECT CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) / 10.0 AS v FROM events) GROUP BY 1")
def json_scalar(spark, sf_dir):
    k = F.from_json("props", "k int")["k"]
    return I.table(spark, sf_dir, "events").groupBy(k.alias("tenth")).agg(F.count("*").alias("n"))


IOU_SQL = "each AS (SELECT CASE WHEN lang IN ('en', 'de') THEN 'train' ELSE 'val' END AS split, source, lang, coalesce(count(*) FILTER (quality = 1 AND toxic = 1) / nullif(count(*) FILTER (quality = 1 OR toxic = 1), 0), 1.0) AS iou FROM documents JOIN labels USING (doc_id) GROUP BY ALL)"


@query(f"WITH {IOU_SQL} SELECT split, count(*) AS images, round(avg(iou), 6) AS iou_mean, round(median(iou), 6) AS iou_median FROM each GROUP BY 1")
def iou_report(spark, sf_dir):
    """A report of overlaps by image and its summary by split; here an image is a source's documents of one language."""
    d = I.table(spark, sf_dir, "documents").select("doc_id", "source", "lang").join(I.table(spark, sf_dir, "labels"), "doc_id")
    d = d.withColumn("split", F.when(F.col("lang").isin("en", "de"), "train").otherwise("val"))
    return rounded(pixelmodel.iou_summary(pixelmodel.iou(d, ["split", "source", "lang"], F.col("quality") == 1, F.col("toxic") == 1)))


@query("SELECT label, count(*) AS n FROM (SELECT split_part(c_mktsegment || '_192.168.' || c_nationkey, '_192.', 1) AS label FROM customer) GROUP BY 1")
def contact_label(spark, sf_dir):
    """Labels from file names of a camera, which end in its address."""
    name = F.concat("c_mktsegment", F.lit("_192.168."), F.col("c_nationkey").cast("string"))
    return I.table(spark, sf_dir, "customer").groupBy(S.contact_label(name).alias("label")).agg(F.count("*").alias("n"))


PATH_SQL = "paths AS (SELECT '/data/' || o_orderpriority || '/' || o_orderkey || '.png' AS path FROM orders UNION ALL SELECT '/data/none/1.png')"


def image_paths(spark, sf_dir) -> DataFrame:
    path = F.concat(F.lit("/data/"), "o_orderpriority", F.lit("/"), F.col("o_orderkey").cast("string"), F.lit(".png")).alias("path")
    return I.table(spark, sf_dir, "orders").select(path).unionAll(spark.range(1).select(F.lit("/data/none/1.png")))


@query(f"WITH {PATH_SQL} SELECT path, row_number() OVER (ORDER BY string_split(path, '/')) - 1 AS place FROM paths")
def path_order(spark, sf_dir):
    return fuse.ordinal(image_paths(spark, sf_dir), tables.path_order()).select("path", F.col("_i").alias("place"))


@query(f"WITH {PATH_SQL} SELECT l AS state_label, CAST(regexp_extract(l, '[0-9]+(?:[.][0-9]+)?') AS DOUBLE) AS state_voltage FROM (SELECT DISTINCT string_split(path, '/')[-2] AS l FROM paths) WHERE l <> 'none'")
def states_of_paths(spark, sf_dir):
    return tables.states_of(image_paths(spark, sf_dir))


@query(f"""WITH {STATE_TABLE_SQL}, k AS (SELECT case_label, min(heat_flux_mean_w_cm2) AS a, max(heat_flux_mean_w_cm2) AS b, min(vapor_area_fraction_mean) AS c, max(vapor_area_fraction_mean) AS d, arg_min(state_label, state_voltage) AS s, arg_min(vapor_area_fraction_mean, state_voltage) AS e, arg_min(ae_abs_energy_rate, state_voltage) AS f, arg_max(state_label, state_voltage) AS t, arg_max(vapor_area_fraction_mean, state_voltage) AS g, arg_max(ae_abs_energy_rate, state_voltage) AS h FROM states GROUP BY 1)
SELECT case_label, CAST(unnest(range(0, 5)) AS INT) AS i, unnest([case_label, format('  heat flux range: {{:.2f}} to {{:.2f}} W/cm2', a, b), format('  vapor area fraction range: {{:.3f}} to {{:.3f}}', c, d), format('  first state {{}}: vapor={{:.3f}}, AE energy rate={{:.1f}}', s, e, f), format('  final state {{}}: vapor={{:.3f}}, AE energy rate={{:.1f}}', t, g, h)]) AS line FROM k""")
def key_number_text(spark, sf_dir):
    data = state_table(spark, sf_dir)
    return synth.key_number_lines(synth.key_numbers(synth.with_case(data, F.col("case_label")))).select("case_label", "i", "line")


@query(f"""WITH {FIT_SQL}, prior AS (SELECT max(n) FILTER (foreground) / (max(n) FILTER (foreground) + max(n) FILTER (NOT foreground)) AS p FROM fit),
x AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
d AS (SELECT vec_id, foreground, -0.5 * sum(pow((v - mean) / std, 2) + 2 * ln(std) + ln(2 * pi())) AS l FROM x JOIN fit USING (i) GROUP BY 1, 2),
o AS (SELECT vec_id, max(l) FILTER (foreground) + ln(p + 1e-9) AS f, max(l) FILTER (NOT foreground) + ln(1 - p + 1e-9) AS b FROM d, prior GROUP BY vec_id, p)
SELECT vec_id AS pixel, b - f <= ln(1 / 0.45 - 1) AS predicted FROM o""")
def pixel_decision(spark, sf_dir):
    x = pixels(spark, sf_dir)
    return pixelmodel.score(x, pixelmodel.fit(x), threshold=0.45).select("pixel", "predicted")


# Masks out of vectors: fifty of them are the lines of a frame, covered where a component is above 0.1.
RUNS_SQL = """cells AS (SELECT vec_id // 50 AS frame, vec_id % 50 AS y, generate_subscripts(embedding, 1) - 1 AS x, CAST(unnest(embedding) AS DOUBLE) > 0.1 AS covered FROM embeddings),
runs AS (SELECT frame, y, min(x) AS x0, max(x) AS x1 FROM (SELECT frame, y, x, x - row_number() OVER (PARTITION BY frame, y ORDER BY x) AS island FROM cells WHERE covered) GROUP BY frame, y, island),
edges AS (SELECT a.frame, a.y AS ay, a.x0 AS ax, b.y AS b_y, b.x0 AS bx FROM runs a JOIN runs b ON a.frame = b.frame AND abs(a.y - b.y) = 1 AND a.x0 <= b.x1 + 1 AND b.x0 <= a.x1 + 1),
reach(frame, y, x0, ry, rx) AS (SELECT frame, y, x0, y, x0 FROM runs UNION SELECT r.frame, r.y, r.x0, e.b_y, e.bx FROM reach r JOIN edges e ON e.frame = r.frame AND e.ay = r.ry AND e.ax = r.rx),
labels AS (SELECT frame, y, x0, min(ry * 1000 + rx) AS root FROM reach GROUP BY frame, y, x0),
boxes AS (SELECT frame, root, sum(x1 - x0 + 1) AS area, min(x0) AS l, min(y) AS t, max(x1) AS r, max(y) AS b FROM runs JOIN labels USING (frame, y, x0) GROUP BY frame, root)"""


def mask_runs(spark, sf_dir) -> DataFrame:
    lines = I.table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 50).alias("frame"), (F.col("vec_id") % 50).alias("y"), F.transform("embedding", lambda v: v.cast("double") > 0.1).alias("cells"))
    return runs.runs_of_lines(lines)


def mask_frames(spark, sf_dir) -> DataFrame:
    lines = I.table(spark, sf_dir, "embeddings").groupBy(F.floor(F.col("vec_id") / 50).alias("frame"))
    return lines.agg(F.count("*").cast("int").alias("height"), F.lit(64).alias("width"))


@query(f"WITH RECURSIVE {RUNS_SQL} SELECT frame, CAST(area AS BIGINT) AS area, CAST(l AS BIGINT) AS l, CAST(t AS BIGINT) AS t, CAST(r AS BIGINT) AS r, CAST(b AS BIGINT) AS b FROM boxes")
def mask_components(spark, sf_dir):
    boxes = runs.component_table(runs.labelled(mask_runs(spark, sf_dir), ["frame"]), ["frame"])
    return boxes.select("frame", "area", *[F.col(c).cast("long").alias(n) for c, n in (("left", "l"), ("top", "t"), ("right", "r"), ("bottom", "b"))])


@query(f"WITH RECURSIVE {RUNS_SQL} SELECT frame, count(*) AS n_runs, CAST(sum(x1 - x0 + 1) AS BIGINT) AS places FROM runs JOIN labels USING (frame, y, x0) JOIN boxes USING (frame, root) WHERE area >= 12 AND NOT (r - l + 1 >= 0.8 * 64 AND b - t + 1 <= 12) GROUP BY frame")
def mask_filters(spark, sf_dir):
    """Masks without small components and without wide, low ones."""
    labels = runs.labelled(mask_runs(spark, sf_dir), ["frame"])
    left = runs.without_wall_lines(runs.without_small(labels, ["frame"], 12), ["frame"], 64)
    return left.groupBy("frame").agg(F.count("*").alias("n_runs"), F.sum(F.col("x1") - F.col("x0") + 1).cast("long").alias("places"))


@query("SELECT frame, list(n ORDER BY x) AS col_counts FROM (SELECT frame, x, CAST(count(*) FILTER (covered) AS INT) AS n FROM (SELECT vec_id // 50 AS frame, generate_subscripts(embedding, 1) - 1 AS x, CAST(unnest(embedding) AS DOUBLE) > 0.1 AS covered FROM embeddings) GROUP BY frame, x) GROUP BY frame")
def mask_column_counts(spark, sf_dir):
    return runs.column_counts(mask_runs(spark, sf_dir), mask_frames(spark, sf_dir), ["frame"]).select("frame", "col_counts")


@query("""WITH cells AS (SELECT vec_id // 50 AS frame, vec_id % 50 AS y, generate_subscripts(embedding, 1) - 1 AS x, CAST(unnest(embedding) AS DOUBLE) > 0.1 AS covered FROM embeddings),
grown AS (SELECT frame, y, x, covered OR coalesce(lag(covered) OVER h, false) OR coalesce(lead(covered) OVER h, false) OR coalesce(lag(covered) OVER v, false) OR coalesce(lead(covered) OVER v, false) AS c FROM cells WINDOW h AS (PARTITION BY frame, y ORDER BY x), v AS (PARTITION BY frame, x ORDER BY y)),
shrunk AS (SELECT frame, y, x, c AND coalesce(lag(c) OVER h, true) AND coalesce(lead(c) OVER h, true) AND coalesce(lag(c) OVER v, true) AND coalesce(lead(c) OVER v, true) AS covered FROM grown WINDOW h AS (PARTITION BY frame, y ORDER BY x), v AS (PARTITION BY frame, x ORDER BY y))
SELECT frame, count(*) AS places, CAST(sum(x * (y + 1)) AS BIGINT) AS moment FROM shrunk WHERE covered GROUP BY frame""")
def mask_closing(spark, sf_dir):
    whole = runs.closed(mask_runs(spark, sf_dir), mask_frames(spark, sf_dir), ["frame"])
    each = whole.withColumn("x", F.explode(F.sequence("x0", "x1")))
    return each.groupBy("frame").agg(F.count("*").alias("places"), F.sum(F.col("x") * (F.col("y") + 1)).cast("long").alias("moment"))


@query(f"""WITH {POLYGON_SQL}, edges AS (SELECT vec_id, p[i].x + 20 AS x1, p[i].y + 20 AS y1, p[i % 32 + 1].x + 20 AS x2, p[i % 32 + 1].y + 20 AS y2 FROM (SELECT vec_id, p, unnest(range(1, 33)) AS i FROM polygons)),
grid AS (SELECT unnest(range(0, 40)) AS y),
crossed AS (SELECT vec_id, y, (x2 - x1) * (y - y1) / (y2 - y1) + x1 AS c FROM edges JOIN grid ON (y1 > y) <> (y2 > y)),
inside AS (SELECT vec_id, y, x FROM crossed, (SELECT unnest(range(0, 40)) AS x) WHERE x < c GROUP BY ALL HAVING count(*) % 2 = 1),
outline AS (SELECT vec_id, CAST(round_even(CASE WHEN i = n THEN y2 ELSE y1 + i * ((y2 - y1) / n) END, 0) AS INT) AS y, CAST(round_even(CASE WHEN i = n THEN x2 ELSE x1 + i * ((x2 - x1) / n) END, 0) AS INT) AS x FROM (SELECT *, unnest(range(0, n + 1)) AS i FROM (SELECT *, CAST(floor(greatest(abs(x2 - x1), abs(y2 - y1))) AS INT) + 1 AS n FROM edges))),
covered AS (SELECT vec_id, y, x FROM inside UNION SELECT vec_id, y, x FROM outline WHERE x BETWEEN 0 AND 39 AND y BETWEEN 0 AND 39)
SELECT vec_id, count(*) AS places, CAST(sum(x) AS BIGINT) AS sum_x, CAST(sum(y * y) AS BIGINT) AS sum_yy FROM covered GROUP BY 1""")
def polygon_places(spark, sf_dir):
    """Polygons as masks of 40 x 40 places."""
    moved = polygons(spark, sf_dir).withColumn("points", F.transform("points", lambda p: F.struct((p["x"] + 20).alias("x"), (p["y"] + 20).alias("y"))))
    each = runs.polygon_runs(moved, ["vec_id"], F.lit(40), F.lit(40)).withColumn("x", F.explode(F.sequence("x0", "x1")))
    return each.groupBy("vec_id").agg(F.count("*").alias("places"), F.sum("x").cast("long").alias("sum_x"), F.sum(F.col("y") * F.col("y")).cast("long").alias("sum_yy"))


@query("SELECT label, CAST(count(DISTINCT x) AS BIGINT) AS area FROM (SELECT label, generate_subscripts(embedding, 1) - 1 AS x, CAST(unnest(embedding) AS DOUBLE) > 0.2 AS covered FROM embeddings) WHERE covered GROUP BY 1")
def mask_areas(spark, sf_dir):
    """Bitmaps of each vector's mask, united by label."""
    each = I.table(spark, sf_dir, "embeddings").select("label", "vec_id", F.posexplode("embedding").alias("x", "v")).select("label", "vec_id", "x", (F.col("v").cast("double") > 0.2).alias("covered"))
    return frames.mask_areas(frames.united(frames.mask_bitmaps(each, ["label", "vec_id"]), ["label"]), ["label"])
