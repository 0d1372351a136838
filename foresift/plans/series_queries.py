"""Registered queries: time series and sampling (T, P)."""
from __future__ import annotations

from pyspark.sql import functions as F

from foresift.functions import scores as S
from foresift.functions.hashing import hash_key
from foresift.operators import panel as P
from foresift.operators import sampling as SM
from foresift.operators import timeseries as TS
from foresift.plans import ctes as C
from foresift.plans import inputs as I
from foresift.plans.registry import query
from foresift.sources import tables as T

JOB = ("station_id:i issue_time:t n_context:i first:d last:d weighted:d n_cov:i cov_weighted:d horizon:i n_leads:i "
       "first_pos:i obs_sum:d")
FULL_GRID = """(SELECT series_id, unnest(generate_series(min(ts), max(ts), INTERVAL 6 HOUR)) AS ts FROM ser
    GROUP BY series_id)"""


def weighted(arr: str):
    """Position-weighted sum: checks values and order of an array in one number."""
    return F.expr(f"aggregate(transform({arr}, (v, i) -> v * (i + 1)), 0D, (s, v) -> s + v)")


def weighted_sql(arr: str) -> str:
    return f"list_sum(list_transform({arr}, lambda v, i: v * i))"


def job_summary(jobs, cov="covariate"):
    has = cov in jobs.columns
    return jobs.select(
        "station_id", "issue_time", F.size("context").alias("n_context"), F.col("context")[0].alias("first"),
        F.element_at("context", -1).alias("last"), weighted("context").alias("weighted"),
        (F.size(cov) if has else F.lit(0)).alias("n_cov"), (weighted(cov) if has else F.lit(0.0)).alias("cov_weighted"),
        "horizon", F.size("steps").alias("n_leads"), F.col("lead_pos")[0].alias("first_pos"),
        F.expr("aggregate(obs, 0D, (s, v) -> s + v)").alias("obs_sum"))


def job_sql(length: int, gap: int = 0, cov: bool = True) -> str:
    where = " WHERE steps = list_transform(range(len(steps)), lambda i: (i*6)::DOUBLE)" if gap else ""
    both = "list_concat(past, means)"
    return f"""SELECT station_id, issue_time, len(context) AS n_context, context[1] AS first, context[-1] AS last,
        {weighted_sql('context')} AS weighted, {f'len({both})' if cov else '0'} AS n_cov,
        {weighted_sql(both) if cov else '0.0'} AS cov_weighted, len(steps) + {gap} AS horizon, len(steps) AS n_leads,
        {gap} AS first_pos, list_sum(obs) AS obs_sum FROM ({C.jobs(length, gap)}){where}"""


@query("t1_gap_detection", "series_id:i ts:t",
       f"SELECT g.series_id, g.ts FROM {FULL_GRID} g ANTI JOIN ser s ON s.series_id = g.series_id AND s.ts = g.ts")
def gap_detection(spark, sf):
    return TS.detect_gaps(T.event_series(spark, sf), ["series_id"], 6)


@query("t2_utc", "event_id:i ts:t",
       """SELECT event_id, (ts::TIMESTAMP AT TIME ZONE 'Europe/Berlin') AT TIME ZONE 'UTC' AS ts FROM events""")
def utc(spark, sf):
    ev = T.read_table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"))
    return TS.to_utc(ev, "ts", "Europe/Berlin")


@query("t3_interpolation", "series_id:i ts:t value:d",
       f"""SELECT g.series_id, g.ts, CASE WHEN s.value IS NOT NULL THEN s.value ELSE p.value + (n.value - p.value) *
       (epoch(g.ts) - epoch(p.ts)) / (epoch(n.ts) - epoch(p.ts)) END AS value FROM {FULL_GRID} g
       LEFT JOIN ser s ON s.series_id = g.series_id AND s.ts = g.ts
       ASOF LEFT JOIN ser p ON p.series_id = g.series_id AND p.ts <= g.ts
       ASOF LEFT JOIN ser n ON n.series_id = g.series_id AND n.ts >= g.ts""")
def interpolation(spark, sf):
    return TS.interpolate_gaps(T.event_series(spark, sf), ["series_id"], 6)


@query("t4_daily_calendar", "station_id:i step_hours:d day:t x:d y:d",
       """SELECT c.station_id, c.step_hours, c.day, e.ens_mean AS x, e.t2m_obs AS y FROM (
       SELECT station_id, step_hours, unnest(generate_series(lo, hi, INTERVAL 1 DAY))::DATE AS day FROM (SELECT station_id,
       step_hours, min(issue_time) AS lo, max(issue_time) AS hi FROM ei GROUP BY ALL)) c LEFT JOIN ei e ON e.station_id = c.station_id AND e.step_hours = c.step_hours
       AND e.issue_time::DATE = c.day""")
def daily_calendar(spark, sf):
    ei = I.event_instances(spark, sf).withColumnsRenamed({"ens_mean": "x", "t2m_obs": "y"})
    return TS.daily_calendar(ei, ["station_id", "step_hours"], ["x", "y"], "valid_time")


@query("t5_known_offset", "step_hours:d k:i n:i",
       "SELECT step_hours, floor(step_hours/24) + 1 AS k, count(*) AS n FROM ei GROUP BY ALL")
def known_offset(spark, sf):
    return (I.event_instances(spark, sf).groupBy("step_hours").agg(F.count(F.lit(1)).alias("n"))
            .withColumn("k", TS.known_offset(F.col("step_hours"))))


LM_SPEC = "station_id:i step_hours:d idx:i horizon:i n_context:i n_cov:i weighted:d cov_weighted:d obs:d"


def lm_summary(df):
    return df.select("station_id", "step_hours", "idx", "horizon", F.size("context").alias("n_context"),
                     F.size("covariate").alias("n_cov"), weighted("context").alias("weighted"),
                     weighted("covariate").alias("cov_weighted"), "obs")


@query("t6_lead_matched", LM_SPEC,
       f"""SELECT station_id, step_hours, day AS idx, k AS horizon, len(context) AS n_context, len(covariate) AS n_cov,
       {weighted_sql('context')} AS weighted, {weighted_sql('covariate')} AS cov_weighted, obs FROM lm5""")
def lead_matched(spark, sf):
    return lm_summary(TS.lead_matched(I.daily(spark, sf), ["station_id", "step_hours"], "step_hours", 5, max_offset=2))


# every second scored day of each series, with the spread as second channel
SCORED_SQL = """(SELECT station_id, step_hours, day FROM (SELECT *, row_number() OVER (PARTITION BY station_id, step_hours ORDER BY day)
    - 1 AS pos FROM dly WHERE y IS NOT NULL) WHERE pos % 2 = 0)"""
C.CTES["lm2"] = f"""SELECT t.station_id, t.step_hours, t.day, t.k, list(c.y ORDER BY c.day) FILTER (c.day <= t.day - t.k) AS context,
    list(c.x ORDER BY c.day) AS covariate, list(c.x_sd ORDER BY c.day) AS covariate2, any_value(t.y) AS obs
    FROM dly t SEMI JOIN {SCORED_SQL} s ON s.station_id = t.station_id AND s.step_hours = t.step_hours AND s.day = t.day
    JOIN dly c ON c.station_id = t.station_id AND c.step_hours = t.step_hours AND c.day BETWEEN t.day - t.k - 4 AND t.day
    WHERE t.y IS NOT NULL GROUP BY ALL HAVING count(c.x) = 5 + t.k AND count(c.x_sd) = 5 + t.k
    AND count(*) FILTER (c.day <= t.day - t.k AND c.y IS NOT NULL) = 5"""


def scored_matches(spark, sf):
    daily = I.daily(spark, sf)
    scored = P.every_nth_issue(daily.where("y IS NOT NULL").withColumn("issue_time", F.col("day").cast("timestamp_ntz")),
                               ["station_id", "step_hours"], 2)
    return TS.lead_matched(daily, ["station_id", "step_hours"], "step_hours", 5, x2="x_sd", max_offset=2, scored=scored)


@query("t6_scored_two_channel", LM_SPEC + " sd_weighted:d",
       f"""SELECT station_id, step_hours, day AS idx, k AS horizon, len(context) AS n_context, len(covariate) AS n_cov,
       {weighted_sql('context')} AS weighted, {weighted_sql('covariate')} AS cov_weighted, obs,
       {weighted_sql('covariate2')} AS sd_weighted FROM lm2""")
def lead_matched_scored(spark, sf):
    got = scored_matches(spark, sf)
    return got.select("station_id", "step_hours", "idx", "horizon", F.size("context").alias("n_context"),
                      F.size("covariate").alias("n_cov"), weighted("context").alias("weighted"),
                      weighted("covariate").alias("cov_weighted"), "obs", weighted("covariate2").alias("sd_weighted"))


@query("t12_lead_matched", "station_id:i issue_time:t step_hours:d obs:d median:d upper:d",
       """SELECT station_id, DATE '1970-01-01' + CAST(day AS INT) AS issue_time, step_hours, obs,
       context[-1] + 0.5*(covariate[-1]-list_avg(covariate)) AS median,
       context[-1] + 0.5*(covariate[-1]-list_avg(covariate)) + 1.2*covariate2[-1] AS upper FROM lm2""")
def forecaster_lead_matched(spark, sf):
    """The two-channel stand-in over lead-matched jobs; only the last step of a job is its lead."""
    jobs = TS.lead_matched_jobs(scored_matches(spark, sf))
    out = TS.apply_forecaster(jobs, spread_sensitive, 9, last_step_only=True)
    return out.select("station_id", F.date_format("issue_time", "yyyy-MM-dd").alias("issue_time"), "step_hours", "obs",
                      F.col("q")[4].alias("median"), F.col("q")[8].alias("upper"))


@query("t7_freshest", "station_id:i valid_time:t freshest_step:d x:d x_sd:d",
       "SELECT station_id, valid_time, freshest_step, x, x_sd FROM fresh")
def freshest(spark, sf):
    return I.freshest(spark, sf, spread=True)


@query("t8_asof_context", JOB, job_sql(8))
def asof_context(spark, sf):
    return job_summary(I.context_jobs(spark, sf, 8))


@query("t9_gap_context", JOB, job_sql(8, 4))
def gap_context(spark, sf):
    return job_summary(I.context_jobs(spark, sf, 8, gap=4))


@query("t10_no_covariate", JOB, job_sql(16, cov=False))
def no_covariate(spark, sf):
    return job_summary(I.context_jobs(spark, sf, 16, use_covariate=False))


@query("t11_two_channel", "station_id:i issue_time:t n_channels:i mean_weighted:d sd_weighted:d horizon:i",
       f"""SELECT station_id, issue_time, 2 AS n_channels, {weighted_sql('list_concat(past, means)')} AS mean_weighted,
       {weighted_sql('list_concat(past_sd, sds)')} AS sd_weighted, len(steps) AS horizon FROM ({C.jobs(8)})
       WHERE len(list_filter(past_sd, lambda x: x IS NULL)) = 0 AND len(list_filter(sds, lambda x: x IS NULL)) = 0""")
def two_channel(spark, sf):
    jobs = I.context_jobs(spark, sf, 8, two_channel=True)
    both = jobs.withColumn("c0", F.col("covariate")[0]).withColumn("c1", F.col("covariate")[1])
    return both.select("station_id", "issue_time", F.size("covariate").alias("n_channels"),
                       weighted("c0").alias("mean_weighted"), weighted("c1").alias("sd_weighted"), "horizon")


PRED = "station_id:i issue_time:t step_hours:d obs:d median:d upper:d"


@query("t12_forecaster", PRED,
       f"""SELECT station_id, issue_time, unnest(steps) AS step_hours, unnest(obs) AS obs, context[-1] AS median,
       context[-1] AS upper FROM ({C.jobs(8)})""")
def forecaster(spark, sf):
    jobs = I.context_jobs(spark, sf, 8)
    out = TS.apply_forecaster(jobs, TS.persistence_forecaster(9), 9)
    return out.select("station_id", "issue_time", "step_hours", "obs", F.col("q")[4].alias("median"),
                      F.col("q")[8].alias("upper"))


def spread_sensitive(contexts, covariates, horizon):
    """Stand-in forecaster that uses both channels: last value shifted by the mean channel, widened by the spread channel."""
    import numpy as np
    cov = np.stack(covariates)
    mean, sd = (cov[:, 0], cov[:, 1]) if cov.ndim == 3 else (cov, np.zeros_like(cov))
    centre = contexts[:, -1:] + 0.5 * (mean[:, -horizon:] - mean.mean(axis=1, keepdims=True))
    return centre[..., None] + sd[:, -horizon:, None] * np.linspace(-1.2, 1.2, 9)


# the spread channel of each variant, from the context and the leads; its mean absolute change times the mean |z| of the levels
SPREADS = f"""(SELECT station_id, issue_time, len(steps) AS h, list_concat(past_sd, sds) AS c, list_transform(list_sort(
    list_transform(range(len(past_sd)+len(sds)), lambda i: {{'h': md5(CAST(i AS VARCHAR)), 'i': i}})), lambda p: p.i) AS o
    FROM ({C.jobs(8)}) WHERE len(list_filter(past_sd, lambda x: x IS NULL)) = 0 AND len(list_filter(sds, lambda x: x IS NULL)) = 0)"""


def change_sql(name: str, other: str) -> str:
    return f"""SELECT '{name}' AS variant, station_id, (2.0/3.0)*abs(c[k]-{other}) AS d FROM (SELECT *,
        unnest(range(len(c)-h+1, len(c)+1)) AS k FROM {SPREADS})"""


@query("t13_sensitivity", "variant:s n_series:i max_mean_change:d passes:b",
       f"""SELECT variant, count(*) AS n_series, max(d) AS max_mean_change, max(d) > 1e-3 AS passes FROM (SELECT variant, station_id,
       avg(d) AS d FROM ({change_sql('permuted', 'c[o[k]+1]')} UNION ALL {change_sql('constant', 'list_avg(c)')} UNION ALL
       {change_sql('mean_only', '0.0')}) GROUP BY ALL) GROUP BY variant""")
def sensitivity(spark, sf):
    jobs = I.context_jobs(spark, sf, 8, two_channel=True)
    c0, c1 = F.col("covariate")[0], F.col("covariate")[1]
    # a fixed permutation: positions in hashed order of their index
    order = F.transform(F.array_sort(F.transform(F.sequence(F.lit(0), F.size(c1) - 1),
                                                 lambda i: F.struct(F.md5(i.cast("string")).alias("h"), i.alias("i")))),
                        lambda s: s["i"])
    permuted = F.transform(F.col("_order"), lambda i: F.element_at(F.col("_c1"), i + 1))
    mean = F.expr("aggregate(_c1, 0D, (s, v) -> s + v) / size(_c1)")
    base = jobs.withColumn("_order", order).withColumn("_c1", c1)
    forms = {"permuted": F.array(c0, permuted), "constant": F.array(c0, F.array_repeat(mean, F.size(c1))),
             "mean_only": F.array(c0, F.transform(c1, lambda v: F.lit(0.0)))}
    run = lambda j: TS.apply_forecaster(j, spread_sensitive, 9)
    variants = {n: run(base.withColumn("covariate", c)) for n, c in forms.items()}
    return TS.sensitivity_check(run(jobs), variants, ["station_id", "issue_time", "step_hours"])


@query("t14_rolling_history", "window_days:i at:t n:i sum_obs:d first_issue:t last_valid:t",
       """SELECT w AS window_days, i.issue_time AS at, count(*) AS n, sum(h.t2m_obs) AS sum_obs,
       min(h.issue_time) AS first_issue, max(h.valid_time) AS last_valid FROM (SELECT DISTINCT issue_time FROM ei) i
       CROSS JOIN (SELECT unnest([5, 10, 20]) AS w) JOIN ei h ON h.issue_time >= i.issue_time - to_days(CAST(w AS INT))
       AND h.issue_time < i.issue_time AND h.valid_time < i.issue_time GROUP BY ALL""")
def rolling_history(spark, sf):
    ei = I.event_instances(spark, sf)
    pairs = TS.rolling_pairs(ei, ei.select("issue_time").distinct(), [5, 10, 20])
    return pairs.groupBy("window_days", "at").agg(
        F.count(F.lit(1)).alias("n"), F.sum("t2m_obs").alias("sum_obs"), F.min("issue_time").alias("first_issue"),
        F.max("valid_time").alias("last_valid"))


# ---- sampling -------------------------------------------------------------------------------------------------------------
RANKED = """(SELECT *, row_number() OVER (ORDER BY case_date DESC, year_idx, time_idx) - 1 AS r FROM cases)"""


def random_rank(seed: str) -> str:
    key = f"CAST({seed} AS VARCHAR) || ':' || CAST(year_idx AS VARCHAR) || ':' || CAST(time_idx AS VARCHAR)"
    return f"row_number() OVER (PARTITION BY {seed} ORDER BY md5({key}), year_idx, time_idx) - 1"


@query("p1_days_cases", "label:s n:i k:i days:i exact:d",
       f"""SELECT label, n, CASE WHEN label = 'full' THEN n ELSE least(CAST(round_even(TRY_CAST(label AS DOUBLE) /
       ({SM.CASE_SPAN_DAYS}::DOUBLE/{SM.CASE_INTERVALS}), 0) AS BIGINT), n) END AS k,
       CAST(round_even(n * ({SM.CASE_SPAN_DAYS}::DOUBLE/{SM.CASE_INTERVALS}), 0) AS BIGINT) AS days,
       n * ({SM.CASE_SPAN_DAYS}::DOUBLE/{SM.CASE_INTERVALS}) AS exact
       FROM (SELECT unnest(['7', '14', '30', '90', '365', 'full']) AS label), (SELECT count(DISTINCT (year_idx, time_idx)) AS n FROM train)""")
def days_cases(spark, sf):
    labels = F.explode(F.array(*[F.lit(x) for x in ("7", "14", "30", "90", "365", "full")]))
    rows = I.train(spark, sf).agg(F.countDistinct(*SM.CASE).alias("n")).withColumn("label", labels)
    return rows.select("label", "n", SM.k_for_label(F.col("label"), F.col("n")).alias("k"),
                       SM.cases_to_days(F.col("n")).alias("days"), SM.exact_days(F.col("n")).alias("exact"))


SAMPLED = "year_idx:i time_idx:i n:i sum_obs:d"


def sampled(df):
    return df.groupBy("year_idx", "time_idx").agg(F.count(F.lit(1)).alias("n"), F.sum("t2m_obs").alias("sum_obs"))


@query("p2_recent_cases", SAMPLED,
       f"""SELECT t.year_idx, t.time_idx, count(*) AS n, sum(t2m_obs) AS sum_obs FROM train t JOIN {RANKED} c
       USING (year_idx, time_idx) WHERE r < 17 GROUP BY ALL""")
def recent_cases(spark, sf):
    return sampled(SM.k_recent(I.train(spark, sf), 17))


@query("p3_random_cases", SAMPLED,
       f"""SELECT t.year_idx, t.time_idx, count(*) AS n, sum(t2m_obs) AS sum_obs FROM train t JOIN (
       SELECT *, {random_rank('s')} AS r FROM (SELECT *, 42 AS s FROM cases)) c USING (year_idx, time_idx) WHERE r < 17
       GROUP BY ALL""")
def random_cases(spark, sf):
    return sampled(SM.k_random(I.train(spark, sf), 17, 42))


SWEEP_SETS = f"""(SELECT 'contiguous' AS arm, -1 AS seed, k, year_idx, time_idx FROM {RANKED}, (SELECT unnest([1,3,7,17,50])
    AS k) WHERE r < k UNION ALL SELECT 'random', s, k, year_idx, time_idx FROM (SELECT *, {random_rank('s')} AS r
    FROM (SELECT *, unnest([0,1,2]) AS s FROM cases)), (SELECT unnest([1,3,7,17,50]) AS k) WHERE r < k)"""


@query("p4_sweep", "arm:s seed:i k:i n_cases:i n_rows:i n_stations:i mean_obs:d",
       f"""SELECT arm, seed, k, count(DISTINCT (year_idx, time_idx)) AS n_cases, count(*) AS n_rows,
       count(DISTINCT station_id) AS n_stations, avg(t2m_obs) AS mean_obs FROM train JOIN {SWEEP_SETS} USING
       (year_idx, time_idx) GROUP BY ALL""")
def sweep(spark, sf):
    """Set sizes from sums per case and station: the panel is aggregated once, before any set is formed."""
    tr = I.train(spark, sf)
    sums = tr.groupBy("station_id", *SM.CASE).agg(F.count(F.lit(1)).alias("n"), F.sum("t2m_obs").alias("s"))
    sets = SM.sweep_cases(SM.distinct_cases(tr), [1, 3, 7, 17, 50], [0, 1, 2])
    joined = SM.sweep_panel(sums, sets)
    return joined.groupBy("arm", "seed", "k").agg(
        F.countDistinct(*SM.CASE).alias("n_cases"), F.sum("n").alias("n_rows"),
        F.countDistinct("station_id").alias("n_stations"), (F.sum("s") / F.sum("n")).alias("mean_obs"))


@query("p5_leave_one_out", "target:i n_train:i n_stations:i mean_forecast:d mean_obs:d mean_var:d",
       """SELECT s.station_id AS target, count(*) AS n_train, count(DISTINCT t.station_id) AS n_stations,
       avg(t.ens_mean) AS mean_forecast, avg(t.t2m_obs) AS mean_obs, avg(t.ens_var) AS mean_var
       FROM (SELECT DISTINCT station_id FROM train) s JOIN train t ON t.station_id <> s.station_id GROUP BY ALL""")
def leave_one_out(spark, sf):
    return SM.leave_one_out_stats(I.train(spark, sf))


@query("p6_validation_split", "is_val:b n_cases:i n_rows:i sum_obs:d",
       """SELECT r < least(greatest(1, CAST(round_even(0.1*m, 0) AS BIGINT)), m-1) AS is_val,
       count(DISTINCT (year_idx, time_idx)) AS n_cases, count(*) AS n_rows, sum(t2m_obs) AS sum_obs FROM train JOIN (
       SELECT year_idx, time_idx, row_number() OVER (ORDER BY md5('0:' || year_idx || ':' || time_idx), year_idx, time_idx) - 1
       AS r, count(*) OVER () AS m FROM cases) USING (year_idx, time_idx) GROUP BY ALL""")
def validation_split(spark, sf):
    return SM.validation_split(I.train(spark, sf)).groupBy("is_val").agg(
        F.countDistinct(*SM.CASE).alias("n_cases"), F.count(F.lit(1)).alias("n_rows"), F.sum("t2m_obs").alias("sum_obs"))
