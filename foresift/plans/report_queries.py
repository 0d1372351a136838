"""Registered queries: report aggregates (R)."""
from __future__ import annotations

from pyspark.sql import functions as F

from foresift.functions import scores as S
from foresift.operators import baselines as B
from foresift.operators import emos as E
from foresift.operators import panel as P
from foresift.operators import reports as R
from foresift.operators import rolling as RO
from foresift.operators import sampling as SM
from foresift.operators import significance as G
from foresift.operators import timeseries as TS
from foresift.operators.leave_one_out import fit_leave_one_out
from foresift.plans import ctes as C
from foresift.plans import fit_sql as X
from foresift.plans import inputs as I
from foresift.plans import significance_queries as H
from foresift.plans.registry import query
from foresift.plans.score_queries import BUNDLE, PIT_SQL
from foresift.plans.series_queries import SWEEP_SETS, spread_sensitive
from foresift.sources import tables as T
from foresift.sources.storage import materialise

RUN = "model:s context_steps:i"
B_CRPS = "crps_0-24h:d crps_24-72h:d crps_72-120h:d"


def bucket_sql(which: str, what: str) -> str:
    agg = f"avg({C.crps()})" if what == "crps" else "count(*)"
    return ", ".join(f"{agg} FILTER (({which}) = '{b}') AS \"{what}_{b}\"" for b in P.BUCKETS)


SEASON_SQL = ", ".join(f"avg({C.crps()}) FILTER (({C.season('month(' + C.ISSUE + ')')}) = '{s}') AS crps_{s}"
                       for s in P.SEASONS)
RANK_SQL = ", ".join(f"avg(CASE WHEN {C.rank()} = {i} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS rank_bin_{i}" for i in range(10))
MATCHED = "(SELECT DISTINCT station_id, valid_time, step_hours FROM runs WHERE context_steps = 8)"
COMMON = "(SELECT DISTINCT station_id, valid_time, step_hours FROM runs WHERE context_steps = 16)"
C.CTES["ref_scores"] = " UNION ALL ".join(
    f"""SELECT model, context_steps, '{name}' AS eval_set, {C.bundle()}, {C.errors()}, {bucket_sql(C.BUCKET, 'crps')},
    {SEASON_SQL}, {RANK_SQL} FROM runs SEMI JOIN {keys} k USING (station_id, valid_time, step_hours)
    GROUP BY model, context_steps HAVING count(*) = (SELECT count(*) FROM {keys})"""
    for name, keys in (("matched", MATCHED), ("common", COMMON)))
REF_SPEC = (f"{RUN} eval_set:s {BUNDLE} bias:d mae:d rmse:d {B_CRPS} " + " ".join(f"crps_{s}:d" for s in P.SEASONS) + " "
            + " ".join(f"rank_bin_{i}:d" for i in range(10)))


def reference_rows(spark, sf):
    runs = I.context_runs(spark, sf)
    sets = {"matched": runs.where("context_steps = 8"), "common": runs.where("context_steps = 16")}
    return R.reference_scores(runs, ["model", "context_steps"], sets)


@query("r1_reference_scores", REF_SPEC, "SELECT * FROM ref_scores")
def reference_scores(spark, sf):
    return reference_rows(spark, sf)


ALL_RUNS = """(SELECT station_id, valid_time, step_hours FROM runs GROUP BY ALL
    HAVING count(DISTINCT (model, context_steps)) = 6)"""


def context_sql(name: str, source: str, own: bool) -> str:
    first = f"min({C.ISSUE})" if own else "NULL::TIMESTAMP"
    valid = "min(valid_time)" if own else "NULL::TIMESTAMP"
    return f"""SELECT model, context_steps, '{name}' AS eval_set, {C.bundle()}, {bucket_sql(C.HALF_OPEN, 'crps')},
        {bucket_sql(C.HALF_OPEN, 'n')}, {first} AS first_issue, {valid} AS first_valid FROM {source} GROUP BY ALL"""


@query("r2_context_summary", f"{RUN} eval_set:s {BUNDLE} {B_CRPS} n_0-24h:i n_24-72h:i n_72-120h:i first_issue:t first_valid:t",
       context_sql("own", "runs", True) + " UNION ALL " + context_sql(
           "common", f"(SELECT * FROM runs SEMI JOIN {ALL_RUNS} k USING (station_id, valid_time, step_hours))", False))
def context_summary(spark, sf):
    return R.context_summary(I.context_runs(spark, sf), ["model", "context_steps"], 6)


@query("r3_common_set_summary", f"{RUN} n_instances:i n_own:i crps:d coverage_80pct:d interval_width:d",
       f"""SELECT r.model, r.context_steps, count(k.one) AS n_instances, count(*) AS n_own,
       avg({C.crps()}) FILTER (one = 1) AS crps, avg({C.cover()}) FILTER (one = 1) AS coverage_80pct,
       avg({C.width()}) FILTER (one = 1) AS interval_width FROM runs r LEFT JOIN (SELECT *, 1 AS one FROM {ALL_RUNS}) k
       USING (station_id, valid_time, step_hours) GROUP BY ALL""")
def common_set_summary(spark, sf):
    return R.common_set_summary(I.context_runs(spark, sf), ["model", "context_steps"], 6)


def _lm(window: int) -> str:
    return f"""SELECT {window} AS w, 'lead_matched' AS model, station_id, (DATE '1970-01-01' + CAST(day AS INT))::TIMESTAMP +
        to_hours(CAST(step_hours AS BIGINT)) AS valid_time, step_hours, obs, {C.list_quantiles('context')} AS q FROM lm{window}"""


C.CTES["lmruns"] = (" UNION ALL ".join(_lm(w) for w in (5, 10)) + " UNION ALL " + " UNION ALL ".join(
    f"SELECT {w}, 'context_climatology', station_id, valid_time, step_hours, obs, q FROM runs "
    "WHERE model = 'context_climatology' AND context_steps = 8" for w in (5, 10)))
C.CTES["lmref"] = "SELECT DISTINCT station_id, valid_time, step_hours FROM runs WHERE context_steps = 4"


@query("r4_lead_matched_summary", f"window:i model:s {BUNDLE} {B_CRPS} n_reference:i share_of_reference:d",
       f"""SELECT w AS "window", model, {C.bundle()}, {bucket_sql(C.BUCKET, 'crps')}, (SELECT count(*) FROM lmref) AS n_reference,
       count(*)/(SELECT count(*) FROM lmref)::DOUBLE AS share_of_reference FROM lmruns SEMI JOIN (
       SELECT w, station_id, valid_time, step_hours FROM lmruns SEMI JOIN lmref USING (station_id, valid_time, step_hours)
       GROUP BY ALL HAVING count(DISTINCT model) = 2) k USING (w, station_id, valid_time, step_hours) GROUP BY ALL""")
def lead_matched_summary(spark, sf):
    base = I.context_runs(spark, sf, (4, 8)).where("model = 'context_climatology'")
    lm = I.lead_matched_runs(spark, sf)
    six_hourly = base.where("context_steps = 8").withColumn(
        "window", F.explode(F.array(F.lit(5), F.lit(10)))).select(*lm.columns)
    return R.windowed_common_summary(lm.unionByName(six_hourly), base.where("context_steps = 4"), "window", ["model"], 2)


C.CTES["gapsum"] = f"""SELECT model, variant, CASE WHEN grouping(step_hours) = 1 THEN 'all' ELSE CAST(step_hours AS VARCHAR) END
    AS lead, {C.bundle()} FROM gapruns SEMI JOIN (SELECT model, station_id, valid_time, step_hours FROM gapruns GROUP BY ALL
    HAVING count(DISTINCT variant) = 2) k USING (model, station_id, valid_time, step_hours)
    GROUP BY GROUPING SETS ((model, variant, step_hours), (model, variant))"""


@query("r5_gap_control", f"model:s variant:s lead:s {BUNDLE}", "SELECT * FROM gapsum")
def gap_control(spark, sf):
    return R.variant_summary(I.gap_runs(spark, sf))


@query("r5_gap_delta", "model:s lead:s nogap:d gap4:d delta:d",
       """SELECT *, gap4 - nogap AS delta FROM (SELECT model, lead, any_value(crps) FILTER (variant = 'nogap') AS nogap,
       any_value(crps) FILTER (variant = 'gap4') AS gap4 FROM gapsum GROUP BY ALL)""")
def gap_delta(spark, sf):
    return R.variant_delta(R.variant_summary(I.gap_runs(spark, sf)), ["model"], "nogap", "gap4")


@query("r6_seasonal_errors", "method:s season:s n:i bias:d mae:d rmse:d",
       f"""SELECT method, CASE WHEN grouping(season) = 1 THEN 'all' ELSE season END AS season, count(*) AS n, {C.errors()} FROM (
       SELECT *, {C.season('month(issue_time)')} AS season FROM pl) GROUP BY GROUPING SETS ((method, season), (method))""")
def seasonal_errors(spark, sf):
    return R.seasonal_errors(I.predictions(spark, sf))


SIZE = ("method:s arm:s seed:i k:i n:i crps:d upper_crps:d coverage_80pct:d interval_width:d n_stations:i crps_std:d "
        "coverage_80pct_std:d n_days:s calendar_days:i")


@query("r7_training_size", SIZE)
def training_size(spark, sf):
    """Main sizes: EMOS, inflation and the network on recent cases, EMOS on random cases, references."""
    tr, te = I.train(spark, sf), I.test(spark, sf)
    return R.training_size_table(tr, te, [0, 7, 17, 50], [0, 1, 2])


@query("r8_small_sizes", SIZE)
def small_sizes(spark, sf):
    """Small sizes, and the whole archive next to them."""
    tr, te = I.train(spark, sf), I.test(spark, sf)
    return R.training_size_table(tr, te, [1, 2, 3, 5, 7], [0, 1, 2])


RAND_SQL = f"""SELECT k, seed, {C.bundle('q', 't2m_obs')} FROM (SELECT k, seed, t2m_obs,
    {C.gaussian('ens_mean', 'm*sqrt(ens_var)')} AS q FROM test, (SELECT seed, k,
    sqrt(sum((t2m_obs-ens_mean)*(t2m_obs-ens_mean))/sum(ens_var)) AS m FROM train JOIN {SWEEP_SETS} USING (year_idx, time_idx)
    WHERE arm = 'random' GROUP BY ALL)) GROUP BY ALL"""
STD = "crps_std:d coverage_80pct_std:d interval_width_std:d"


@query("r9_random_arm", f"k:i population:b n_seeds:i crps:d coverage_80pct:d interval_width:d {STD}",
       " UNION ALL ".join(
           f"""SELECT k, {flag} AS population, count(*) AS n_seeds, avg(crps) AS crps, avg(coverage_80pct) AS coverage_80pct,
           avg(interval_width) AS interval_width, {fn}(crps) AS crps_std, {fn}(coverage_80pct) AS coverage_80pct_std,
           {fn}(interval_width) AS interval_width_std FROM ({RAND_SQL}) GROUP BY k"""
           for flag, fn in (("false", "stddev_samp"), ("true", "stddev_pop"))))
def random_arm(spark, sf):
    """Random-arm mean and SD of the fitted inflation: sample SD (year-round) and population SD (seasonal)."""
    tr = I.train(spark, sf)
    sets = SM.sweep_cases(SM.distinct_cases(tr), [1, 3, 7, 17, 50], [0, 1, 2]).where("arm = 'random'")
    models = R.sweep_inflation(sets.join(R.case_sums(tr), SM.CASE))
    q = I.gaussian_quantiles("ens_mean", "multiplier*sqrt(ens_var)")
    scored = materialise(R.score_models(I.test(spark, sf).withColumnRenamed("t2m_obs", "obs"), models, R.FIT, q))
    metrics = ["crps", "coverage_80pct", "interval_width"]
    out = None
    for pop in (False, True):
        part = R.random_arm(scored, ["k"], metrics, pop).withColumn("population", F.lit(pop))
        out = part if out is None else out.unionByName(part)
    return out


@query("r10_breakpoint_table", "axis:s method:s n_points:i slope:d breakpoint:d days:i verdict:s",
       f"""SELECT a.axis, d.*, CAST(round_even(breakpoint * ({SM.CASE_SPAN_DAYS}::DOUBLE/{SM.CASE_INTERVALS}), 0) AS BIGINT) AS days
       FROM ({H.DIRECTION_SQL}) d, (SELECT 'combined' AS axis) a UNION ALL
       SELECT 'main', d.*, CAST(round_even(breakpoint * ({SM.CASE_SPAN_DAYS}::DOUBLE/{SM.CASE_INTERVALS}), 0) AS BIGINT)
       FROM ({H.DIRECTION_SQL.replace('FROM curves', 'FROM curves WHERE n >= 7')}) d""")
def breakpoint_table(spark, sf):
    """Crossings per metric on the combined axis (small and main sizes) and on the main sizes alone."""
    c = materialise(H.curves(spark, sf))
    out = None
    for axis, part in (("combined", c), ("main", c.where("n >= 7"))):
        for name, metric in (("crps", "crps"), ("coverage", "coverage_80pct")):
            row = G.crossing_with_direction(part.where(F.col("method") == name), ["method"], metric).select(
                F.lit(axis).alias("axis"), "*", SM.cases_to_days(F.col("breakpoint")).alias("days"))
            out = row if out is None else out.unionByName(row)
    return out


SMALL_KS, MAIN_KS = [1, 2, 3, 5, 7], [7, 17, 50]
_RECENT = """(SELECT year_idx, time_idx, row_number() OVER (ORDER BY case_date DESC, year_idx, time_idx) - 1 AS r,
    count(*) OVER () AS n_full FROM cases)"""
C.CTES["fit_sets"] = f"""SELECT DISTINCT least(k, n_full) AS k, year_idx, time_idx FROM {_RECENT}, (SELECT unnest({SMALL_KS + MAIN_KS}
    || [1000000000]) AS k) WHERE r < k"""
C.CTES["fit_rows"] = "SELECT s.k, t.* FROM train t JOIN fit_sets s USING (year_idx, time_idx)"
_scored = f"""avg({C.crps('q', 't2m_obs')}) AS crps, avg({C.cover('q', 't2m_obs')}) AS coverage_80pct"""
_gauss = C.gaussian("(f.a+f.b*t.ens_mean)", "sqrt(exp(f.c)+exp(f.d)*t.ens_var)")
for _name, _keys, _least in (("emos_pooled", ["k"], 1), ("emos_local", ["k", "station_id"], 5)):
    _on = "ON t.station_id = f.station_id" if len(_keys) > 1 else "ON true"
    C.CTES[f"scored_{_name}"] = f"""SELECT k, {_scored} FROM (SELECT f.k, t.t2m_obs, {_gauss} AS q FROM
        {X.emos_fits('fit_rows', _keys, _least)} f JOIN test t {_on}) GROUP BY k"""
C.CTES["fixed_line"] = f"""SELECT {_scored} FROM (SELECT t2m_obs, {C.gaussian('ens_mean', f'{B.LAMBDA_CLIM}*sqrt(ens_var)')} AS q
    FROM test)"""


def fitted_sql(axis: str, method: str) -> str:
    sizes = f"WHERE k IN (SELECT least(unnest({MAIN_KS} || [1000000000]), (SELECT count(*) FROM cases)))" if axis == "main" else ""
    c = f"""(SELECT 'crps' AS method, k AS n, s.crps AS value, l.crps AS ref FROM scored_{method} s, fixed_line l {sizes} UNION ALL
        SELECT 'coverage', k, s.coverage_80pct, l.coverage_80pct FROM scored_{method} s, fixed_line l {sizes})"""
    return f"""SELECT '{axis}' AS axis, '{method}' AS method, CASE WHEN d.method = 'crps' THEN 'crps' ELSE 'coverage_80pct' END AS metric,
        (SELECT CASE WHEN d.method = 'crps' THEN crps ELSE coverage_80pct END FROM fixed_line) AS reference, n_points, breakpoint,
        CAST(round_even(breakpoint * ({SM.CASE_SPAN_DAYS}::DOUBLE/{SM.CASE_INTERVALS}), 0) AS BIGINT) AS days, verdict
        FROM ({H.DIRECTION_SQL.replace('FROM curves', f'FROM {c}')}) d"""


@query("r10_fitted_breakpoints", "axis:s method:s metric:s reference:d n_points:i breakpoint:d days:i verdict:s",
       " UNION ALL ".join(f"SELECT * EXCLUDE (breakpoint, reference), round(breakpoint, 4) AS breakpoint, round(reference, 4) AS reference "
                          f"FROM ({fitted_sql(a, m)})" for a in ("main", "combined") for m in ("emos_pooled", "emos_local")))
def fitted_breakpoints(spark, sf):
    """Crossings of fitted EMOS with the fixed inflation, on the main sizes and on small and main sizes together."""
    tr, te = I.train(spark, sf), I.test(spark, sf)
    table = materialise(R.emos_by_size(tr, te, {"small": SMALL_KS, "main": MAIN_KS}))
    found = R.fitted_breakpoints(table, "inflation_fixed", ["emos_pooled", "emos_local"])
    return found.withColumns({c: F.round(c, 4) for c in ("breakpoint", "reference")})


SEASON_KS = [1, 2, 3, 5, 7, 9, 13, 26]


def _season_table(spark, sf):
    def build():
        fixed = I.gaussian_quantiles("ens_mean", f"{B.LAMBDA_CLIM}D*sqrt(ens_var)")
        tr, te = I.train(spark, sf), I.test(spark, sf, S.LEVELS)
        return R.seasonal_sweep(tr, te, SEASON_KS, {"fixed": fixed, "raw": F.col("raw_q")}, [0, 1, 2])
    return I.stored(spark, sf, "seasonal", build)


@query("r11_seasonal_sweep", "season:s arm:s k:i method:s n:i crps:d coverage_80pct:d interval_width:d crps_std:d coverage_80pct_std:d "
       "interval_width_std:d n_stations:i n_blocks:i t_pvalue:d hac_fixed_mean_diff:d hac_fixed_dm_pvalue:d hac_fixed_ci_low:d "
       "hac_fixed_ci_high:d hac_raw_mean_diff:d hac_raw_dm_pvalue:d hac_raw_ci_low:d hac_raw_ci_high:d")
def seasonal_sweep(spark, sf):
    """Recent and random cases of each season, three EMOS variants, tests against two references."""
    return _season_table(spark, sf)


@query("r11_seasonal_breakpoints", "season:s method:s arm:s metric:s reference:d n_points:i breakpoint:d days:i verdict:s first_k:i "
       "first_days:i")
def seasonal_breakpoints(spark, sf):
    """Sizes at which a season's EMOS crosses the fixed inflation, and from which it is significantly better for good."""
    return R.seasonal_breakpoints(_season_table(spark, sf), "fixed")


C.CTES["leadc"] = f"SELECT method, step_hours, count(*) AS n, avg(c) AS crps FROM pl GROUP BY ALL"


@query("r12_lead_curves", "method:s step_hours:d n:i crps:d", "SELECT * FROM leadc")
def lead_curves(spark, sf):
    return R.lead_curves(I.predictions(spark, sf))


@query("r13_difference_curve", "method:s step_hours:d crps:d base_crps:d difference:d",
       """SELECT a.method, step_hours, a.crps, b.crps AS base_crps, a.crps - b.crps AS difference FROM leadc a JOIN
       (SELECT step_hours, crps FROM leadc WHERE method = 'raw_ensemble') b USING (step_hours)
       WHERE a.method <> 'raw_ensemble'""")
def difference_curve(spark, sf):
    return R.difference_curve(materialise(R.lead_curves(I.predictions(spark, sf))), "raw_ensemble")


@query("r13_winning_leads", "method:s leads:s n_leads:i",
       """SELECT a.method, coalesce(string_agg(CAST(CAST(step_hours AS INT) AS VARCHAR), ', ' ORDER BY step_hours)
       FILTER (a.crps < b.crps), '') AS leads, count(*) FILTER (a.crps < b.crps) AS n_leads FROM leadc a JOIN
       (SELECT step_hours, crps FROM leadc WHERE method = 'raw_ensemble') b USING (step_hours)
       WHERE a.method <> 'raw_ensemble' GROUP BY a.method""")
def winning_leads(spark, sf):
    return R.winning_leads(materialise(R.lead_curves(I.predictions(spark, sf))), "raw_ensemble")




VARIANT = ("method:s k:i least:i n_instances:i covered_fraction:d crps:d covered:d width:d crps_short:d vs_fixed_mean_diff:d "
           "vs_fixed_dm_pvalue:d vs_fixed_ci_low:d vs_fixed_ci_high:d vs_fixed_day_t_pvalue:d vs_raw_mean_diff:d vs_raw_dm_pvalue:d "
           "crps_common:d crps_fixed_common:d vs_fixed_common_mean_diff:d vs_fixed_common_dm_pvalue:d crps_raw_common:d "
           "vs_raw_common_mean_diff:d vs_raw_common_dm_pvalue:d")
GUARDS = [100, G.MIN_INSTANCES]


def reference_columns(df):
    """Adds the scores of both references. They depend on the instance alone, so they come before a row meets its models."""
    df = df.withColumn("fixed", I.gaussian_quantiles("ens_mean", f"{B.LAMBDA_CLIM}D*sqrt(ens_var)"))
    df = df.withColumn("raw", I.gaussian_quantiles("ens_mean", "sqrt(ens_var)"))
    return df.withColumns({f"crps_{r}": S.crps("t2m_obs", r) for r in ("fixed", "raw")}).drop("fixed", "raw")


def scored_rows(df, keys):
    """Instance rows for the guarded score table: score columns next to those of the references, and the mask of their key sets:
    instances with at least three and at least four members."""
    y, have = "t2m_obs", F.col("q").isNotNull()
    mask = F.when(F.col("n_members") >= 3, 1).otherwise(0) + F.when(F.col("n_members") >= 4, 2).otherwise(0)
    return df.select(*keys, *T.KEY, F.when(have, S.crps(y, "q")).alias("crps"),
                     F.when(have, S.upper_crps(y, "q")).alias("upper_crps"),
                     F.when(have, S.covered(y, "q")).alias("covered"), F.when(have, S.width("q")).alias("width"),
                     "crps_fixed", "crps_raw",
                     mask.cast("bigint").alias("members"))


def variant_scores(rows, keys):
    return G.guarded_scores(scored_rows(rows, keys), keys, ["fixed", "raw"], {"short": (0, 6)}, GUARDS, ["fixed", "raw"])


@query("r14_emos_variants", VARIANT)
def emos_variants(spark, sf):
    """Four EMOS variants at nine training sizes and the whole archive, and two kinds of leave-one-station-out.

    Rows appear at the least number of instances of the operator and at a lower one, for archives as small as these tables.
    """
    tr, te = I.train(spark, sf), materialise(reference_columns(I.test(spark, sf).drop("raw_q")))
    cases = SM.distinct_cases(tr)
    sets = materialise(SM.full_and_smaller(cases, [1, 2, 3, 5, 7, 17, 50, 204, 611], [0]).where("arm = 'contiguous'"))
    ks = sorted(r["k"] for r in sets.select("k").distinct().collect())      # ten at most
    panel = materialise(SM.sweep_panel(tr, sets).select("k", "station_id", "step_hours", "ens_mean", "ens_var", "t2m_obs"))
    rows = te.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
    k, lead, stn, cell = ["k"], ["k", "step_hours"], ["k", "station_id"], ["k", "station_id", "step_hours"]
    m = {"pooled": E.fit_emos(panel, k), "lead": E.fit_emos(panel, lead, min_rows=20),
         "local": E.fit_emos(panel, stn, min_rows=5), "cell": E.fit_emos(panel, cell, min_rows=5)}
    models = {"pooled": (m["pooled"], k), "lead": (m["lead"], lead), "local": (m["local"], stn), "cell": (m["cell"], cell)}
    out = E.predict_variants(rows, models, {
        "emos_pooled": [("pooled", 1)], "emos_local": [("local", 5)],
        "emos_pooled_leadspec": [("lead", 20), ("pooled", 1)], "emos_local_leadspec": [("cell", 5)]})
    one, own = te.withColumn("k", F.lit(-1)), (fit_leave_one_out(tr), ["station_id"], 1)
    by_lead = (fit_leave_one_out(tr, lead_specific=True), ["station_id", "step_hours"], 20)
    for name, tiers in (("emos_loso", [own]), ("emos_loso_leadspec", [by_lead, own])):
        out = out.unionByName(E.predict_tiers(one, tiers).withColumn("method", F.lit(name)).select(*out.columns))
    return variant_scores(out, ["method", "k"])


WINDOWS = [2, 3, 5, 7, 10, 14, 20, 30, 40, 160]


@query("r15_rolling_table", VARIANT.replace("k:i", "window_days:i"))
def rolling_table(spark, sf):
    """Four rolling variants with ten windows, at both least numbers of instances."""
    ei = I.event_instances(spark, sf)
    scored = materialise(reference_columns(ei))
    return variant_scores(RO.rolling_predictions(ei, scored, WINDOWS), ["method", "window_days"])


@query("r16_append_runs", f"{RUN} eval_set:s crps:d coverage_80pct:d interval_width:d",
       f"""SELECT model, context_steps, eval_set, crps, coverage_80pct, interval_width FROM ref_scores UNION ALL
       SELECT m, context_steps, e, crps, coverage_80pct, interval_width FROM (SELECT model || '_nocov' AS m, context_steps, e,
       avg({C.crps()}) AS crps, avg({C.cover()}) AS coverage_80pct, avg({C.width()}) AS interval_width FROM runs,
       (SELECT unnest(['matched', 'common']) AS e) WHERE model = 'persistence' GROUP BY ALL) UNION ALL
       SELECT m, context_steps, e, crps, coverage_80pct, interval_width FROM (SELECT model AS m, context_steps, e, avg({C.crps()}) AS crps,
       avg({C.cover()}) AS coverage_80pct, avg({C.width()}) AS interval_width FROM runs, (SELECT unnest(['matched', 'common'])
       AS e) WHERE model = 'context_climatology' GROUP BY ALL) x
       ANTI JOIN ref_scores r ON r.model = x.m AND r.context_steps = x.context_steps""")
def append_runs(spark, sf):
    runs = I.context_runs(spark, sf)
    sets = {"matched": runs.where("context_steps = 8"), "common": runs.where("context_steps = 16")}
    have = R.reference_scores(runs, ["model", "context_steps"], sets)
    have = materialise(have.select("model", "context_steps", "eval_set", "crps", "coverage_80pct", "interval_width"))
    extra = runs.groupBy("model", "context_steps").agg(
        F.avg(S.crps("obs", "q")).alias("crps"), F.avg(S.covered("obs", "q")).alias("coverage_80pct"),
        F.avg(S.width("q")).alias("mean_width_80pct")).withColumn("covariate", F.col("model") != "persistence")
    return R.append_missing_runs(have, extra)


@query("r17_wide_scores", "method:s step_hours_0:d step_hours_6:d step_hours_12:d",
       """SELECT method, any_value(crps) FILTER (step_hours = 0) AS step_hours_0, any_value(crps) FILTER (step_hours = 6)
       AS step_hours_6, any_value(crps) FILTER (step_hours = 12) AS step_hours_12 FROM leadc GROUP BY method""")
def wide_scores(spark, sf):
    curves = R.lead_curves(I.predictions(spark, sf)).withColumn("step_hours", F.col("step_hours").cast("int"))
    return R.wide_scores(curves, "step_hours", [0, 6, 12])


@query("r17_seasonal_table", "method:s season_DJF:d season_MAM:d season_JJA:d season_SON:d season_all:d",
       "SELECT method, " + ", ".join(f"avg(c) FILTER (({C.season('month(issue_time)')}) = '{s}') AS season_{s}"
                                     for s in P.SEASONS) + ", avg(c) AS season_all FROM pl GROUP BY method")
def seasonal_table(spark, sf):
    rows = P.with_issue_time(I.predictions(spark, sf)).withColumn("season", P.season(F.month("issue_date")))
    by = ["method", "season"]
    totals = rows.groupingSets([by, ["method"]], *by).agg(
        F.grouping("season").alias("_all"), F.avg(S.crps("obs", "q")).alias("crps")).withColumn(
        "season", F.when(F.col("_all") == 1, "all").otherwise(F.col("season")))
    return R.wide_scores(totals, "season", [*P.SEASONS, "all"])


@query("r18_latest_row", "model:s context_steps:i n:i crps:d",
       f"""SELECT model, context_steps, count(*) AS n, avg({C.crps()}) AS crps FROM runs WHERE context_steps = 16
       GROUP BY ALL""")
def latest_row(spark, sf):
    s = I.context_runs(spark, sf).groupBy("model", "context_steps").agg(
        F.count(F.lit(1)).alias("n"), F.avg(S.crps("obs", "q")).alias("crps"))
    return P.latest_per(s, ["model"], F.col("context_steps"))


@query("r19_nearest_row", "multiplier:d coverage_80pct:d interval_width:d crps:d",
       """SELECT * FROM curve ORDER BY abs(multiplier - (SELECT lam FROM lam)), multiplier LIMIT 1""")
def nearest_row(spark, sf):
    """Curve row nearest to the fitted multiplier; the multiplier stays a one-row table."""
    curve = B.inflation_curve(I.test(spark, sf))
    fitted = B.fit_inflation(I.train(spark, sf)).select(F.col("multiplier").alias("fitted"))
    near = curve.crossJoin(F.broadcast(fitted)).withColumn("gap", F.col("multiplier") - F.col("fitted"))     # one row
    return R.nearest_row(near, "gap", 0.0)


EMOS_Q = X.tiered("(SELECT *, 0 AS _one FROM test)", [(X.emos_fits("(SELECT *, 0 AS _one FROM train)", ["_one"]), ["_one"], 1)])
C.CTES["quick"] = f"""SELECT method, obs, q FROM preds WHERE method IN ('raw_ensemble', 'climatology') UNION ALL
    SELECT 'emos', t2m_obs, q FROM ({EMOS_Q})"""
C.CTES["quick_pit"] = f"SELECT method, {PIT_SQL} AS pit FROM quick"


@query("r20_quick_check", "method:s n:i crps:d skill:d reliability:d",
       f"""SELECT method, n, crps, 1 - crps/(SELECT avg({C.crps()}) FROM quick WHERE method = 'raw_ensemble') AS skill, reliability FROM
       (SELECT method, count(*) AS n, avg({C.crps()}) AS crps FROM quick GROUP BY method) JOIN
       (SELECT g.method, sqrt(avg((coalesce(c.c, 0)/g.n::DOUBLE-0.1)*(coalesce(c.c, 0)/g.n::DOUBLE-0.1))) AS reliability FROM
       (SELECT method, count(*) AS n, unnest(range(10)) AS b FROM quick_pit GROUP BY method) g LEFT JOIN
       (SELECT method, least(floor(pit*10), 9)::BIGINT AS b, count(*) AS c FROM quick_pit GROUP BY ALL) c USING (method, b)
       GROUP BY g.method) USING (method)""")
def quick_check(spark, sf):
    """Raw ensemble, pooled EMOS and climatology: CRPS, improvement over the raw ensemble, PIT reliability."""
    tr, te = I.train(spark, sf), I.test(spark, sf)
    preds = I.predictions(spark, sf, ("raw_ensemble", "climatology"))
    emos = E.emos_predict(te, E.fit_emos(tr)).select(F.lit("emos").alias("method"), *T.KEY,
                                                     F.col("t2m_obs").alias("obs"), "q")
    both = materialise(preds.unionByName(emos))
    return R.skill_table(both, "raw_ensemble").join(R.reliability(R.pit_histogram(both)), "method")


@query("r21_two_covariates", f"method:s {BUNDLE}",
       f"""SELECT method, {C.bundle()} FROM (SELECT 'mean_only' AS method, station_id, issue_time, unnest(steps) AS s, unnest(obs)
       AS obs, unnest(list_transform(means, lambda m: list_transform({C.LIST_LEVELS}, lambda t: context[8] + 0.5*(m - list_avg(
       list_concat(past, means)))))) AS q FROM ({C.jobs(8)} AND len(list_filter(h.sds[idx-7:idx], lambda x: x IS NULL)) = 0) UNION ALL
       SELECT 'two_covariates', station_id, issue_time, unnest(steps), unnest(obs), unnest(list_transform(list_zip(means, sds),
       lambda p: list_transform([-1.2,-0.9,-0.6,-0.3,0.0,0.3,0.6,0.9,1.2]::DOUBLE[], lambda z: context[8] + 0.5*(p[1] - list_avg(list_concat(
       past, means))) + z*p[2]))) FROM ({C.jobs(8)} AND len(list_filter(h.sds[idx-7:idx], lambda x: x IS NULL)) = 0)) GROUP BY method""")
def two_covariates(spark, sf):
    """Scores of the two-channel run and of the mean-only run on the same keys."""
    two = I.context_jobs(spark, sf, 8, two_channel=True)
    one = two.withColumn("covariate", F.col("covariate")[0])
    run = lambda j, name: TS.apply_forecaster(j, spread_sensitive, 9).withColumn("method", F.lit(name))
    both = run(two, "two_covariates")
    mean = P.matched(run(one, "mean_only"), both)
    return mean.unionByName(both).groupBy("method").agg(*S.bundle("obs", "q"))
