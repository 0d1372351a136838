"""Registered queries: scans, sinks and panel building (S, B)."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from foresift.functions import scores as S
from foresift.operators import panel as P
from foresift.plans import ctes as C
from foresift.plans import inputs as I
from foresift.plans.registry import query
from foresift.sources import storage
from foresift.sources import tables as T
from foresift.sources.storage import materialise

KEYS = "station_id:i valid_time:t step_hours:d"
WIDE = " ".join(f"q{k}:d" for k in range(10, 100, 10))
SQL_WIDE = ", ".join(f"q[{i + 1}] AS q{10 * (i + 1)}" for i in range(9))


@query("s1_scan", "l_suppkey:i l_shipdate:t l_extendedprice:d",
       "SELECT l_suppkey, l_shipdate, l_extendedprice FROM lineitem WHERE l_returnflag = 'R'")
def scan(spark, sf):
    li = T.read_table(spark, sf, "lineitem").where(F.col("l_returnflag") == "R")
    return li.select("l_suppkey", F.col("l_shipdate").cast("timestamp_ntz").alias("l_shipdate"), "l_extendedprice")


@query("s2_explode_members", "station_id:i issue_time:t step_hours:d member:i t2m_forecast:d",
       """SELECT station_id, issue_time, step_hours, row_number() OVER (PARTITION BY station_id, issue_time, step_hours
       ORDER BY ord) - 1 AS member, CASE WHEN line <> 7 THEN f END AS t2m_forecast FROM am""")
def explode_members(spark, sf):
    m = T.archive_members(spark, sf)
    # line 7 stands for a member that was not delivered (NaN)
    value = F.when(F.col("line") == 7, F.lit(float("nan"))).otherwise(F.col("t2m_forecast"))
    cube = m.groupBy("station_id", "issue_time", "step_hours").agg(
        F.array_sort(F.collect_list(F.struct("member_order", value.alias("f")))).alias("m"))     # one ensemble per row
    return P.explode_members(cube.withColumn("members", F.col("m.f")).drop("m"))


@query("s3_split_sources", "split:s station_id:i n:i mean_forecast:d mean_obs:d",
       """SELECT 'train' AS split, station_id, count(*) AS n, avg(ens_mean) AS mean_forecast, avg(t2m_obs) AS mean_obs
       FROM train GROUP BY station_id UNION ALL
       SELECT 'test', station_id, count(*), avg(ens_mean), avg(t2m_obs) FROM test GROUP BY station_id""")
def split_sources(spark, sf):
    both = (I.train(spark, sf).select(F.lit("train").alias("split"), "station_id", "ens_mean", "t2m_obs")
            .unionByName(I.test(spark, sf).select(F.lit("test").alias("split"), "station_id", "ens_mean", "t2m_obs")))
    return both.groupBy("split", "station_id").agg(F.count(F.lit(1)).alias("n"), F.avg("ens_mean").alias("mean_forecast"),
                                                   F.avg("t2m_obs").alias("mean_obs"))


@query("s4_stored_aggregate", f"{KEYS} ens_mean:d ens_var:d n_members:i t2m_obs:d",
       "SELECT station_id, valid_time, step_hours, ens_mean, ens_var, n_members, t2m_obs FROM test")
def stored_aggregate(spark, sf):
    return I.test(spark, sf).select(*T.KEY, "ens_mean", "ens_var", "n_members", "t2m_obs")


@query("s5_result_sink", "config_hash:s model_version:s n:i mean_crps:d",
       f"""SELECT substr(sha256('{{"levels": 9, "window": [5, 10]}}'), 1, 16) AS config_hash, 'v1' AS model_version,
       count(*) AS n, avg(c) AS mean_crps FROM pl WHERE method = 'inflation_fixed'""")
def result_sink(spark, sf):
    preds = I.predictions(spark, sf, ("inflation_fixed",)).withColumn("crps", S.crps("obs", "q"))
    folder = f"{storage.shared_dir(spark)}/results-{uuid.uuid4().hex}"
    storage.write_result(preds, "inflation_fixed", "v1", {"window": [5, 10], "levels": 9}, folder)
    table, meta = storage.read_result(spark, "inflation_fixed", folder)
    stats = table.agg(F.count(F.lit(1)).alias("n"), F.avg("crps").alias("mean_crps"))
    return meta.crossJoin(F.broadcast(stats))     # one row each


@query("s6_upsert_by_method", "method:s n:i crps:d",
       f"""SELECT method, count(*) AS n, avg({C.crps()}) AS crps FROM (
       SELECT method, obs, q FROM preds WHERE method NOT IN ('gaussian_ensemble', 'climatology') UNION ALL
       SELECT 'gaussian_ensemble', t2m_obs, {C.gaussian('ens_mean', '2.0*sqrt(ens_var)')} FROM test) GROUP BY method""")
def upsert(spark, sf):
    old = I.predictions(spark, sf)
    te = I.test(spark, sf)
    new = te.select(F.lit("gaussian_ensemble").alias("method"), *T.KEY, F.col("t2m_obs").alias("obs"),
                    I.gaussian_quantiles("ens_mean", "2D*sqrt(ens_var)").alias("q"))
    out = P.upsert_by_method(old, new, ["gaussian_ensemble", "climatology"])
    return out.groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.avg(S.crps("obs", "q")).alias("crps"))


@query("s6_stored_replacement", "method:s n:i crps:d same_files:b",
       f"""SELECT method, count(*) AS n, avg({C.crps()}) AS crps, method <> 'gaussian_ensemble' AS same_files FROM (
       SELECT method, obs, q FROM preds WHERE method NOT IN ('gaussian_ensemble', 'climatology') UNION ALL
       SELECT 'gaussian_ensemble', t2m_obs, {C.gaussian('ens_mean', '2.0*sqrt(ens_var)')} FROM test) GROUP BY method""")
def stored_replacement(spark, sf):
    """Two methods replaced in storage, one of them by nothing; files of the other methods stay untouched."""
    path = f"{storage.shared_dir(spark)}/predictions-{uuid.uuid4().hex}"
    columns = ["method", *T.KEY, "obs", "q"]
    storage.write_by_method(I.predictions(spark, sf).select(*columns), path)
    files = lambda: spark.read.parquet(path).groupBy("method").agg(F.sort_array(F.collect_set(F.struct(
        F.col("_metadata.file_path"), F.col("_metadata.file_modification_time")))).alias("files"))
    before = materialise(files())
    te = I.test(spark, sf)
    new = te.select(F.lit("gaussian_ensemble").alias("method"), *T.KEY, F.col("t2m_obs").alias("obs"),
                    I.gaussian_quantiles("ens_mean", "2D*sqrt(ens_var)").alias("q"))
    storage.replace_methods(new, ["gaussian_ensemble", "climatology"], path)
    scored = spark.read.parquet(path).groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.avg(S.crps("obs", "q")).alias("crps"))
    after = files().withColumnRenamed("files", "now")
    return scored.join(after, "method").join(before, "method").withColumn("same_files", F.col("now") == F.col("files"))


@query("s7_optional_union", "run:s n:i crps:d",
       f"""SELECT 'ctx4' AS run, count(*) AS n, avg({C.crps()}) AS crps FROM runs r WHERE model = 'context_climatology'
       AND context_steps = 4 AND EXISTS (SELECT 1 FROM runs k WHERE k.model = 'persistence' AND k.context_steps = 8
       AND k.station_id = r.station_id AND k.valid_time = r.valid_time AND k.step_hours = r.step_hours)
       UNION ALL SELECT 'ctx8', count(*), avg({C.crps()}) FROM runs WHERE model = 'context_climatology'
       AND context_steps = 8""")
def optional_union(spark, sf):
    runs = I.context_runs(spark, sf)
    pick = lambda c: runs.where((F.col("model") == "context_climatology") & (F.col("context_steps") == c))
    reference = runs.where((F.col("model") == "persistence") & (F.col("context_steps") == 8))
    out = P.union_complete({"ctx4": pick(4), "ctx8": pick(8), "ctx16": pick(16), "absent": None}, reference)
    return out.groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.avg(S.crps("obs", "q")).alias("crps"))


@query("b1_ensemble_stats", f"{KEYS} ens_mean:d ens_var:d ens_sd:d n_members:i t2m_obs:d",
       """SELECT station_id, valid_time, step_hours, ens_mean, ens_var, sqrt(ens_var) AS ens_sd, n_members, t2m_obs
       FROM ac""")
def ensemble_stats(spark, sf):
    return I.cells(spark, sf).withColumn("ens_sd", F.sqrt("ens_var"))


@query("b2_nonoverlapping_cases", "year_idx:i time_idx:i last_valid:t case_date:t",
       """SELECT year_idx, time_idx, max(valid_time) AS last_valid, min(valid_time)::DATE AS case_date FROM am GROUP BY ALL
       HAVING max(valid_time) < TIMESTAMP '1999-12-01 12:00:00'""")
def nonoverlapping(spark, sf):
    # the cutoff falls inside a case: its last lead verifies exactly then, so the case is dropped
    return I.cases(spark, sf, "1999-12-01 12:00:00")


def _panel(spark, sf, shape):
    members = T.archive_members(spark, sf)
    keys = ["station_id", "year_idx", "time_idx", "step_hours"]
    stats = P.ensemble_stats(members, keys)
    obs = members.where(F.col("verifying").isNotNull()).groupBy(*keys).agg(
        F.min_by("verifying", "member_order").alias("t2m_obs"))
    return P.training_panel(stats, obs, storage.materialise(I.cases(spark, sf)), shape)


@query("b3_panel_stats", "station_id:i ens_mean:d ens_var:d t2m_obs:d",
       "SELECT station_id, ens_mean, ens_var, t2m_obs FROM train")
def panel_stats(spark, sf):
    return _panel(spark, sf, "stats")


@query("b3_panel_cases", "station_id:i time_idx:i year_idx:i case_date:t ens_mean:d ens_var:d t2m_obs:d",
       "SELECT station_id, time_idx, year_idx, case_date, ens_mean, ens_var, t2m_obs FROM train")
def panel_cases(spark, sf):
    return _panel(spark, sf, "cases")


@query("b3_panel_lead", "station_id:i time_idx:i year_idx:i case_date:t step_hours:d ens_mean:d ens_var:d t2m_obs:d",
       "SELECT station_id, time_idx, year_idx, case_date, step_hours, ens_mean, ens_var, t2m_obs FROM train")
def panel_lead(spark, sf):
    return _panel(spark, sf, "lead")


def _long(spark, sf):
    members = T.archive_members(spark, sf, since=T.TEST_START)
    obs = members.where(F.col("verifying").isNotNull()).groupBy(*T.KEY).agg(
        F.min_by("verifying", "member_order").alias("t2m_obs"))
    return members.withColumnRenamed("member_order", "member"), obs


@query("b4_long_test_table", f"{KEYS} member:i t2m_forecast:d t2m_obs:d",
       """SELECT a.station_id, a.valid_time, a.step_hours, ord AS member, f AS t2m_forecast, c.t2m_obs
       FROM am a JOIN ac c USING (station_id, issue_time, step_hours)
       WHERE a.issue_time >= TIMESTAMP '2000-01-01' AND c.t2m_obs IS NOT NULL""")
def long_test_table(spark, sf):
    return P.long_test_table(*_long(spark, sf))


@query("b4_renamed_valid_time", "station_id:i n:i last_valid:t",
       """SELECT a.station_id, count(*) AS n, max(a.valid_time) AS last_valid
       FROM am a JOIN ac c USING (station_id, issue_time, step_hours)
       WHERE a.issue_time >= TIMESTAMP '2000-01-01' AND c.t2m_obs IS NOT NULL GROUP BY a.station_id""")
def renamed_valid_time(spark, sf):
    members, obs = _long(spark, sf)
    out = P.long_test_table(members.withColumnRenamed("valid_time", "time"), obs)
    return out.groupBy("station_id").agg(F.count(F.lit(1)).alias("n"), F.max("valid_time").alias("last_valid"))


@query("b5_issue_time", f"{KEYS} issue_time:t issue_date:t",
       f"SELECT station_id, valid_time, step_hours, {C.ISSUE} AS issue_time, ({C.ISSUE})::DATE AS issue_date FROM ei")
def issue_time(spark, sf):
    return P.with_issue_time(I.event_cells(spark, sf).dropna(subset=["ens_var"]).drop("issue_time"))


@query("b6_season", "season:s station_id:i n:i mean_obs:d",
       f"""SELECT {C.season('month(case_date)')} AS season, station_id, count(*) AS n, avg(t2m_obs) AS mean_obs FROM train
       GROUP BY ALL""")
def season(spark, sf):
    return (I.train(spark, sf).withColumn("season", P.season(F.month("case_date"))).groupBy("season", "station_id")
            .agg(F.count(F.lit(1)).alias("n"), F.avg("t2m_obs").alias("mean_obs")))


@query("b7_index_to_date", "station_id:i time_idx:i template_date:t n:i",
       """SELECT station_id, time_idx, make_date(2016, time_idx, 1) AS template_date, count(*) AS n FROM train GROUP BY ALL""")
def index_to_date(spark, sf):
    dates = spark.range(1).select(F.sequence(F.lit("2016-01-01").cast("date"), F.lit("2016-12-01").cast("date"),
                                             F.expr("INTERVAL 1 MONTH")).alias("dates"))
    rows = I.train(spark, sf).groupBy("station_id", "time_idx").agg(F.count(F.lit(1)).alias("n"))
    return P.lookup_dates(rows.withColumn("pos", F.col("time_idx") - 1), "pos", dates, "template_date")


@query("b8_lead_bucket", "step_hours:d closed:s half_open:s n:i",
       f"""SELECT step_hours, {C.BUCKET} AS closed, {C.HALF_OPEN} AS half_open, count(*) AS n FROM (
       SELECT step_hours + 5.0*(station_id % 7)::DOUBLE AS step_hours FROM ai) GROUP BY ALL""")
def lead_bucket(spark, sf):
    step = F.col("step_hours") + 5.0 * (F.col("station_id") % 7)     # leads off the 6-hour grid too
    rows = I.instances(spark, sf).select(step.alias("step_hours"))
    return (rows.withColumn("closed", P.lead_bucket(F.col("step_hours")))
            .withColumn("half_open", P.lead_bucket(F.col("step_hours"), True))
            .groupBy("step_hours", "closed", "half_open").agg(F.count(F.lit(1)).alias("n")))


@query("b9_matched_set", f"{KEYS} t2m_obs:d",
       """SELECT DISTINCT e.station_id, e.valid_time, e.step_hours, e.t2m_obs FROM ei e JOIN runs r
       ON r.station_id = e.station_id AND r.valid_time = e.valid_time AND r.step_hours = e.step_hours
       AND r.model = 'persistence' AND r.context_steps = 16""")
def matched_set(spark, sf):
    ref = I.context_runs(spark, sf, (16,)).where("model = 'persistence'")
    return P.matched(I.event_instances(spark, sf), ref)


@query("b9_coverage_check", "n_reference:i n_covered:i complete:b",
       """SELECT count(*) AS n_reference, count(b.s) AS n_covered, count(*) = count(b.s) AS complete FROM
       (SELECT DISTINCT station_id, valid_time, step_hours FROM runs WHERE context_steps = 4) a LEFT JOIN
       (SELECT DISTINCT station_id, valid_time, step_hours, 1 AS s FROM runs WHERE context_steps = 16) b
       USING (station_id, valid_time, step_hours)""")
def coverage_check(spark, sf):
    runs = I.context_runs(spark, sf, (4, 16))
    return P.match_report(runs.where("context_steps = 16"), runs.where("context_steps = 4"))


@query("b10_identical_key_sets", "n_keys:i min_methods:i max_methods:i identical:b",
       """SELECT count(*) AS n_keys, min(m) AS min_methods, max(m) AS max_methods, min(m) = max(m) AS identical FROM (
       SELECT station_id, valid_time, step_hours, count(DISTINCT method) AS m FROM preds GROUP BY ALL)""")
def identical_key_sets(spark, sf):
    return P.key_set_report(I.predictions(spark, sf))


@query("b11_common_set", "n:i first_issue:t last_issue:t first_valid:t last_valid:t",
       f"""SELECT count(*) AS n, min({C.ISSUE}) AS first_issue, max({C.ISSUE}) AS last_issue, min(valid_time) AS first_valid,
       max(valid_time) AS last_valid FROM (SELECT station_id, valid_time, step_hours FROM runs
       GROUP BY ALL HAVING count(DISTINCT (model, context_steps)) = 6)""")
def common_set(spark, sf):
    common = P.with_issue_time(P.common_keys(I.context_runs(spark, sf), ["model", "context_steps"], 6))
    return common.agg(F.count(F.lit(1)).alias("n"), F.min("issue_time").alias("first_issue"),
                      F.max("issue_time").alias("last_issue"), F.min("valid_time").alias("first_valid"),
                      F.max("valid_time").alias("last_valid"))


@query("b12_deduplicate", "station_id:i step_hours:d issue_time:t ens_mean:d",
       """SELECT station_id, step_hours, max(issue_time) AS issue_time, arg_max(ens_mean, issue_time) AS ens_mean FROM ai
       GROUP BY ALL""")
def deduplicate(spark, sf):
    rows = I.instances(spark, sf).select("station_id", "step_hours", "issue_time", "ens_mean")
    return P.latest_per(rows, ["station_id", "step_hours"], F.col("issue_time"))


@query("b13_reference_alignment", f"{KEYS} t2m_obs:d {WIDE}",
       f"""SELECT t.station_id, t.valid_time, t.step_hours, t.t2m_obs, {SQL_WIDE} FROM test t JOIN preds p
       USING (station_id, valid_time, step_hours) WHERE p.method = 'inflation_fitted'""")
def reference_alignment(spark, sf):
    aligned = P.align(I.test(spark, sf).select(*T.KEY, "t2m_obs"), I.predictions(spark, sf, ("inflation_fitted",)))
    return P.quantile_columns(aligned)


@query("b14_common_mask", "model:s context_steps:i n_predicted:i n_common:i",
       """SELECT r.model, r.context_steps, count(*) AS n_predicted, count(k.one) AS n_common FROM runs r
       LEFT JOIN (SELECT DISTINCT station_id, valid_time, step_hours, 1 AS one FROM runs WHERE context_steps = 16) k
       USING (station_id, valid_time, step_hours) GROUP BY ALL""")
def common_mask(spark, sf):
    runs = I.context_runs(spark, sf)
    common = runs.where("context_steps = 16 AND model = 'persistence'").select(*T.KEY)
    mask = P.common_mask(I.event_instances(spark, sf), runs, ["model", "context_steps"], common)
    return mask.groupBy("model", "context_steps").agg(F.count(F.lit(1)).alias("n_predicted"),
                                                      F.count_if("in_common").alias("n_common"))


@query("b15_season_counts",
       "season:s n_labels:i n_cases:i n_rows:i first_date:t last_date:t obs_mean:d obs_std:d n_issue_dates:i n_instances:i",
       f"""SELECT * FROM (SELECT {C.season('month(case_date)')} AS season, count(DISTINCT time_idx) AS n_labels,
       count(DISTINCT (year_idx, time_idx)) AS n_cases, count(*) AS n_rows, min(case_date) AS first_date,
       max(case_date) AS last_date, avg(t2m_obs) AS obs_mean, stddev_samp(t2m_obs) AS obs_std FROM train GROUP BY ALL)
       JOIN (SELECT {C.season('month(issue_time)')} AS season, count(DISTINCT issue_time) AS n_issue_dates,
       count(*) AS n_instances FROM test GROUP BY ALL) USING (season)""")
def season_counts(spark, sf):
    return P.season_counts(I.train(spark, sf)).join(P.test_season_counts(I.test(spark, sf)), "season")


def _stations(spark, sf):
    return P.flag_used_stations(T.station_metadata(spark, sf), I.test(spark, sf))


USED = "(SELECT DISTINCT station_id FROM test)"


@query("b16_station_flag", "station_id:i station_name:s station_altitude:d used_in_study:b",
       f"""SELECT station_id, station_name, alt AS station_altitude, station_id IN {USED} AS used_in_study FROM stn""")
def station_flag(spark, sf):
    return _stations(spark, sf)


@query("b17_station_extent",
       "n_used:i lat_min:d lat_max:d lon_min:d lon_max:d alt_min:d alt_max:d alt_median:d highest:s n_high:i",
       f"""SELECT count(*) AS n_used, min(lat) AS lat_min, max(lat) AS lat_max, min(lon) AS lon_min, max(lon) AS lon_max,
       min(alt) AS alt_min, max(alt) AS alt_max, median(alt) AS alt_median, arg_max(station_name, alt) AS highest,
       count(*) FILTER (alt > 500) AS n_high FROM stn WHERE station_id IN {USED}""")
def station_extent(spark, sf):
    return P.station_extent(_stations(spark, sf))


@query("b18_excluded_names", "station_name:s",
       f"SELECT station_name FROM stn WHERE station_id NOT IN {USED}")
def excluded_names(spark, sf):
    return _stations(spark, sf).where(~F.col("used_in_study"))


@query("b18_issue_subset", "station_id:i step_hours:d issue_time:t ens_mean:d",
       """SELECT station_id, step_hours, issue_time, ens_mean FROM (SELECT *, row_number() OVER (PARTITION BY station_id,
       step_hours ORDER BY issue_time) - 1 AS pos FROM ei) WHERE pos % 3 = 0""")
def issue_subset(spark, sf):
    rows = I.event_instances(spark, sf).select("station_id", "step_hours", "issue_time", "ens_mean")
    return P.every_nth_issue(rows, ["station_id", "step_hours"], 3)


@query("b18_first_stations", "station_id:i n:i",
       """SELECT station_id, count(*) AS n FROM ai WHERE station_id IN (SELECT DISTINCT station_id FROM ai ORDER BY 1 LIMIT 5)
       GROUP BY station_id""")
def first_stations(spark, sf):
    return P.first_stations(I.instances(spark, sf), 5).groupBy("station_id").agg(F.count(F.lit(1)).alias("n"))
