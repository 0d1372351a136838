"""Registered queries: models (M)."""
from __future__ import annotations

from pyspark.sql import functions as F

from foresift.functions import scores as S
from foresift.functions.normal import cdf_sql, crps_sql, gaussian_crps, phi_sql
from foresift.operators import baselines as B
from foresift.operators import emos as E
from foresift.operators import panel as P
from foresift.operators import reports as R
from foresift.operators import rolling as RO
from foresift.operators import sampling as SM
from foresift.operators.leave_one_out import fit_leave_one_out
from foresift.operators.leave_one_out import refit_in_place as refit_in_place_of
from foresift.operators.models import Climatology, Emos, RawEnsemble, VarianceInflation
from foresift.operators.network import fit_networks
from foresift.plans import ctes as C
from foresift.plans import fit_sql as X
from foresift.plans import inputs as I
from foresift.plans.panel_queries import KEYS, SQL_WIDE, WIDE
from foresift.plans.registry import query
from foresift.sources import tables as T
from foresift.sources.storage import materialise

def pred_sql(method: str) -> str:
    return f"SELECT station_id, valid_time, step_hours, {SQL_WIDE} FROM preds WHERE method = '{method}'"


def wide(df):
    return P.quantile_columns(df.select(*T.KEY, "q"))


@query("m0_interface", "method:s n:i crps:d",
       f"""SELECT method, count(*) AS n, avg({C.crps()}) AS crps FROM preds
       WHERE method IN ('climatology', 'raw_ensemble', 'inflation_fitted') GROUP BY method""")
def interface(spark, sf):
    """The same evaluation through the model interface."""
    tr, te = I.train(spark, sf), I.test(spark, sf, S.LEVELS)
    models = {"climatology": Climatology(), "raw_ensemble": RawEnsemble(), "inflation_fitted": VarianceInflation()}
    out = None
    for name, model in models.items():
        part = model.fit(tr).transform(te).agg(F.count(F.lit(1)).alias("n"), F.avg(S.crps("t2m_obs", "q")).alias("crps"))
        part = part.withColumn("method", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


@query("m1_climatology", f"{KEYS} {WIDE}", pred_sql("climatology"))
def climatology(spark, sf):
    return wide(B.apply_constant(I.test(spark, sf), B.climatology(I.train(spark, sf))))


@query("m2_raw_quantiles", f"{KEYS} n_members:i {WIDE}",
       f"SELECT station_id, valid_time, step_hours, n_members, {SQL_WIDE} FROM (SELECT *, raw_q AS q FROM ac)")
def raw_quantiles(spark, sf):
    members = T.archive_members(spark, sf)
    got = B.raw_quantiles(members, T.KEY, extra=[F.count("t2m_forecast").alias("n_members")])
    return P.quantile_columns(got)


@query("m3_persistence", "station_id:i issue_time:t step_hours:d obs:d q10:d q50:d q90:d",
       f"""SELECT station_id, issue_time, unnest(steps) AS step_hours, unnest(obs) AS obs, context[-1] AS q10,
       context[-1] AS q50, context[-1] AS q90 FROM ({C.jobs(4)})""")
def persistence(spark, sf):
    return P.quantile_columns(B.persistence(I.context_jobs(spark, sf, 4)))


@query("m4_gaussian_crps", f"{KEYS} crps:d pdf:d cdf:d",
       f"""SELECT station_id, valid_time, step_hours, {crps_sql('z', 'sg')} AS crps, {phi_sql('z')} AS pdf,
       {cdf_sql('z')} AS cdf FROM (SELECT *, sqrt(ens_var) AS sg, (t2m_obs-ens_mean)/sqrt(ens_var) AS z FROM ai
       WHERE ens_var > 0)""")
def gaussian_crps_query(spark, sf):
    rows = I.instances(spark, sf).where(F.col("ens_var") > 0).withColumn("sg", F.sqrt("ens_var")).withColumn("z", (F.col("t2m_obs") - F.col("ens_mean")) / F.col("sg"))
    return rows.select(*T.KEY, gaussian_crps("ens_mean", "sg", "t2m_obs").alias("crps"),
                       F.expr(phi_sql("z")).alias("pdf"), F.expr(cdf_sql("z")).alias("cdf"))


FIT_OUT = "n_rows:i loss:d raw_loss:d"
RAW_SQL = crps_sql("((t2m_obs-ens_mean)/sqrt(1.0+ens_var))", "sqrt(1.0+ens_var)")
ONE = "(SELECT *, 0 AS _one FROM {})"
CELL, STN = ["station_id", "step_hours"], ["station_id"]


def fit_sql(keys: list[str], min_rows: int = 1) -> str:
    """Loss of each converged fit next to that of the raw Gaussian on the same rows."""
    if not keys:
        return f"SELECT * FROM {X.emos_fits('train', [])} f, (SELECT avg({RAW_SQL}) AS raw_loss FROM train)"
    k = ", ".join(keys)
    return (f"SELECT * FROM {X.emos_fits('train', keys, min_rows)} f JOIN (SELECT {k}, avg({RAW_SQL}) AS raw_loss FROM train "
            f"GROUP BY {k}) USING ({k})")


def tier_sql(tiers) -> str:
    return f"""SELECT tier, count(*) AS n, avg({C.crps('q', 't2m_obs')}) AS crps FROM (
        {X.tiered(ONE.format('test'), tiers)}) GROUP BY tier"""


def tier(source: str, keys: list[str], least: int) -> tuple[str, list[str], int]:
    """Fits with exact parameters: their predictions are compared to six digits."""
    return X.refined(X.emos_fits(source, keys, least), source, keys), keys, least


POOLED = tier(ONE.format("train"), ["_one"], 1)
OTHERS = "(SELECT o.station_id AS target, t.* EXCLUDE (station_id) FROM (SELECT DISTINCT station_id FROM train) o JOIN train t ON t.station_id <> o.station_id)"
LOSO = (f"(SELECT target AS station_id, * EXCLUDE (target) FROM {X.emos_fits(OTHERS, ['target'])})", STN, 1)
LOSO_LEAD = (f"(SELECT target AS station_id, * EXCLUDE (target) FROM {X.emos_fits(OTHERS, ['target', 'step_hours'], 20)})", CELL, 20)


def fit_summary(models, panel, keys):
    """Loss of the fit next to that of the raw Gaussian on the same rows: compare losses, never parameters."""
    raw = panel.withColumn("sg", F.sqrt(F.lit(1.0) + F.col("ens_var")))
    start = raw.groupBy(*keys).agg(F.avg(gaussian_crps("ens_mean", "sg", "t2m_obs")).alias("raw_loss"))
    if not keys:
        return models.crossJoin(F.broadcast(start))      # one row each
    return models.join(start, keys)


@query("m5_emos_pooled", FIT_OUT, fit_sql([]))
def emos_pooled(spark, sf):
    """Pooled fit by lockstep aggregation: the mode for fits of unlimited size."""
    tr = I.train(spark, sf)
    return fit_summary(E.fit_emos(tr, max_group_rows=0), tr, [])


@query("m5_emos_by_source", f"year_idx:i {FIT_OUT}", fit_sql(["year_idx"]))
def emos_by_year(spark, sf):
    """Packed mode: one fit per archive year."""
    tr = I.train(spark, sf)
    return fit_summary(E.fit_emos(tr, ["year_idx"]), tr, ["year_idx"])


@query("m6_emos_local", f"station_id:i {FIT_OUT} covered_stations:d",
       f"""SELECT *, (SELECT count(*) FILTER (n >= 5)::DOUBLE/count(*) FROM (SELECT DISTINCT station_id FROM test) LEFT JOIN
       (SELECT station_id, count(*) AS n FROM train GROUP BY 1) USING (station_id)) AS covered_stations FROM ({fit_sql(STN, 5)})""")
def emos_local(spark, sf):
    tr = I.train(spark, sf)
    models = E.fit_emos(tr, ["station_id"], min_rows=5)
    stations = I.test(spark, sf).select("station_id").distinct()
    share = (stations.join(models.select("station_id", F.lit(1).alias("one")), "station_id", "left")
             .agg((F.count("one") / F.count(F.lit(1))).alias("covered_stations")))
    return fit_summary(models, tr, ["station_id"]).crossJoin(F.broadcast(share))     # one row


def tiered_scores(spark, sf, tiers):
    out = E.predict_tiers(I.test(spark, sf), tiers)
    return out.groupBy("tier").agg(F.count(F.lit(1)).alias("n"), F.avg(S.crps("t2m_obs", "q")).alias("crps"))


@query("m7_emos_lead", "tier:i n:i crps:d", tier_sql([tier("train", ["step_hours"], 20), POOLED]))
def emos_lead(spark, sf):
    tr = I.train(spark, sf)
    pooled = E.fit_emos(tr.withColumn("_one", F.lit(1)), ["_one"])
    by_lead = E.fit_emos(tr, ["step_hours"], min_rows=20)
    te = I.test(spark, sf).withColumn("_one", F.lit(1))
    out = E.predict_tiers(te, [(by_lead, ["step_hours"], 20), (pooled, ["_one"], 1)])
    return out.groupBy("tier").agg(F.count(F.lit(1)).alias("n"), F.avg(S.crps("t2m_obs", "q")).alias("crps"))


@query("m8_emos_local_lead", f"station_id:i step_hours:d {FIT_OUT}", fit_sql(CELL, 5))
def emos_local_lead(spark, sf):
    tr = I.train(spark, sf)
    keys = ["station_id", "step_hours"]
    return fit_summary(E.fit_emos(tr, keys, min_rows=5), tr, keys)


@query("m9_emos_adaptive", "tier:i n:i crps:d",
       tier_sql([tier("train", CELL, 20), tier("train", STN, 5), POOLED]))
def emos_adaptive(spark, sf):
    tr = I.train(spark, sf)
    one = tr.withColumn("_one", F.lit(1))
    cell, stn = ["station_id", "step_hours"], ["station_id"]
    out = E.predict_tiers(I.test(spark, sf).withColumn("_one", F.lit(1)),
                          [(E.fit_emos(tr, cell, min_rows=20), cell, 20), (E.fit_emos(tr, stn, min_rows=5), stn, 5),
                           (E.fit_emos(one, ["_one"]), ["_one"], 1)])
    return out.groupBy("tier").agg(F.count(F.lit(1)).alias("n"), F.avg(S.crps("t2m_obs", "q")).alias("crps"))


C.CTES["event_last"] = f"""SELECT e.*, j.last_obs FROM ei e JOIN (SELECT station_id, issue_time, context[-1] AS last_obs
    FROM ({C.jobs(4)})) j USING (station_id, issue_time)"""


@query("m10_emos_last_obs", "predictors:i n_rows:i loss:d",
       f"""SELECT 2 AS predictors, n_rows, loss FROM {X.emos_fits('event_last', [], predictors=('ens_mean', 'last_obs'))} UNION ALL
       SELECT 1, n_rows, loss FROM {X.emos_fits('event_last', [])}""")
def emos_last_obs(spark, sf):
    """EMOS with and without the last observation on the operational stream."""
    jobs = I.context_jobs(spark, sf, 4)
    last = jobs.select("station_id", "issue_time", F.element_at("context", -1).alias("last_obs"))
    panel = materialise(I.event_instances(spark, sf).join(last, ["station_id", "issue_time"]))
    with_last = E.fit_emos(panel, predictors=("ens_mean", "last_obs"))
    without = E.fit_emos(panel)
    return with_last.select(F.lit(2).alias("predictors"), "n_rows", "loss").unionByName(
        without.select(F.lit(1).alias("predictors"), "n_rows", "loss"))


FIXED = {"a": 1.5, "b": 0.9, "c": 1.2, "d": 0.3}


@query("m11_emos_predict", f"{KEYS} {WIDE}",
       f"""SELECT station_id, valid_time, step_hours, {SQL_WIDE} FROM (SELECT *, {C.gaussian(
           f"({FIXED['a']}+{FIXED['b']}*ens_mean)", f"sqrt(exp({FIXED['c']}::DOUBLE)+exp({FIXED['d']}::DOUBLE)*ens_var)")} AS q
       FROM test)""")
def emos_predict(spark, sf):
    model = spark.range(1).select(*[F.lit(v).alias(k) for k, v in FIXED.items()])
    return wide(E.emos_predict(I.test(spark, sf), model))


BUNDLE_OUT = "crps:d coverage_80pct:d interval_width:d upper_crps:d"


def coarse_sql(body: str, keys: str) -> str:
    """Scores to 4 digits: the fits start elsewhere or sum in another order, and their parameters agree to 6 or so."""
    return f"SELECT {keys}, {', '.join(f'round({c.split(":")[0]}, 4) AS {c.split(":")[0]}' for c in BUNDLE_OUT.split())} FROM ({body})"


def coarse(df, *keys):
    return df.select(*keys, *[F.round(c.split(":")[0], 4).alias(c.split(":")[0]) for c in BUNDLE_OUT.split()])


@query("m12_leave_one_out", f"variant:s n:i {BUNDLE_OUT}",
       coarse_sql(f"""SELECT 'loso' AS variant, {C.bundle('q', 't2m_obs')} FROM ({X.tiered('test', [LOSO])}) UNION ALL
       SELECT 'loso_leadspec', {C.bundle('q', 't2m_obs')} FROM ({X.tiered('test', [LOSO_LEAD, LOSO])})""", "variant, n"))
def leave_one_out(spark, sf):
    tr, te = I.train(spark, sf), I.test(spark, sf)
    out = None
    pooled = fit_leave_one_out(tr)
    leads = fit_leave_one_out(tr, lead_specific=True)
    for name, tiers in (("loso", [(pooled, ["station_id"], 1)]),
                        ("loso_leadspec", [(leads, ["station_id", "step_hours"], 20), (pooled, ["station_id"], 1)])):
        part = E.predict_tiers(te, tiers).agg(*S.bundle("t2m_obs", "q")).withColumn("variant", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return coarse(out, "variant", "n")


# history rows of each issue time and window, and the fits on them
C.CTES["rolled"] = """SELECT w AS window_days, i.issue_time AS issued, h.station_id, h.step_hours, h.ens_mean, h.ens_var, h.t2m_obs
    FROM (SELECT DISTINCT issue_time FROM ei) i CROSS JOIN (SELECT unnest([5, 10, 20]) AS w) JOIN ei h
    ON h.issue_time >= i.issue_time - to_days(CAST(w AS INT)) AND h.issue_time < i.issue_time AND h.valid_time < i.issue_time"""
ROLL = ["window_days", "issued"]
for _name, _keys, _least in (("pooled", [], RO.MIN_HISTORY), ("lead", ["step_hours"], RO.MIN_LEAD), ("station", STN, 1),
                             ("cell", CELL, 1)):
    C.CTES[f"rolled_{_name}"] = f"SELECT * FROM {X.emos_fits('rolled', [*ROLL, *_keys], _least)}"
_ROLLED_KEYS = {"pooled": ROLL, "lead": [*ROLL, "step_hours"], "station": [*ROLL, *STN], "cell": [*ROLL, *CELL]}


def rolled_sql(name: str, chain) -> str:
    tiers = [(f"rolled_{m}", _ROLLED_KEYS[m], n) for m, n in chain]
    return f"""SELECT '{name}' AS method, window_days, {C.bundle('q', 't2m_obs')}, count(q) AS covered FROM (
        {X.tiered('(SELECT * FROM (SELECT *, issue_time AS issued FROM ei, (SELECT unnest([5, 10, 20]) AS window_days)) SEMI JOIN '
                  'rolled_pooled USING (window_days, issued))', tiers)}) GROUP BY window_days"""


@query("m13_rolling_emos", f"method:s window_days:i n:i covered:i {BUNDLE_OUT}",
       coarse_sql(" UNION ALL ".join(rolled_sql(n, c) for n, c in RO.VARIANTS.items()), "method, window_days, n, covered"))
def rolling_emos(spark, sf):
    ei = I.event_instances(spark, sf)
    out = RO.rolling_predictions(ei, ei, [5, 10, 20])
    scored = out.groupBy("method", "window_days").agg(*S.bundle("t2m_obs", "q"), F.count("q").alias("covered"))
    return coarse(scored, "method", "window_days", "n", "covered")


@query("m14_inflation_fitted", "station_id:i n_rows:i multiplier:d",
       """SELECT station_id, count(*) AS n_rows, sqrt(avg((t2m_obs-ens_mean)*(t2m_obs-ens_mean))/avg(ens_var)) AS multiplier
       FROM train GROUP BY station_id""")
def inflation_fitted(spark, sf):
    return B.fit_inflation(I.train(spark, sf), ["station_id"])


@query("m15_inflation_fixed", f"{KEYS} {WIDE}", pred_sql("inflation_fixed"))
def inflation_fixed(spark, sf):
    model = VarianceInflation(multiplier=B.LAMBDA_CLIM).fit(I.train(spark, sf))
    return wide(model.transform(I.test(spark, sf)))


def need_sql(source: str) -> str:
    z = C.z_values(S.LEVELS)
    return (f"SELECT CASE WHEN t2m_obs = ens_mean THEN 0.0 WHEN ens_var = 0 THEN 'inf'::DOUBLE WHEN t2m_obs > ens_mean THEN "
            f"(t2m_obs-ens_mean)/(sqrt(ens_var)*({z[8]!r})::DOUBLE) ELSE (t2m_obs-ens_mean)/(sqrt(ens_var)*({z[0]!r})::DOUBLE) "
            f"END AS need FROM {source}")


@query("m16_inflation_coverage", "source:s target:d multiplier:d",
       " UNION ALL ".join(
           f"SELECT '{s}' AS source, {t} AS target, quantile_disc(need, {t}) AS multiplier FROM ({need_sql(s)})"
           for s in ("train", "test") for t in (0.7, 0.8)))
def inflation_coverage(spark, sf):
    """Coverage targets on the training set, and on the test set as the leaky bound."""
    out = None
    for name, rows in (("train", I.train(spark, sf)), ("test", I.test(spark, sf))):
        for target in (0.7, 0.8):
            part = B.coverage_inflation(rows, target).select(
                F.lit(name).alias("source"), F.lit(target).alias("target"), "multiplier")
            out = part if out is None else out.unionByName(part)
    return out


@query("m17_inflation_predict", f"{KEYS} {WIDE}", pred_sql("inflation_fitted"))
def inflation_predict(spark, sf):
    return wide(B.inflation_predict(I.test(spark, sf), B.fit_inflation(I.train(spark, sf))))


CURVE_SQL = f"""SELECT multiplier, avg({C.cover('q', 't2m_obs')}) AS coverage_80pct, avg({C.width('q')}) AS interval_width,
    avg({C.crps('q', 't2m_obs')}) AS crps FROM (SELECT l/100.0::DOUBLE AS multiplier, t2m_obs,
    {C.gaussian('ens_mean', '(l/100.0::DOUBLE)*sqrt(ens_var)')} AS q FROM test, (SELECT unnest(range(50, 301, 5)) AS l))
    GROUP BY multiplier"""
C.CTES["curve"] = CURVE_SQL


@query("m18_inflation_curve", "multiplier:d coverage_80pct:d interval_width:d crps:d", "SELECT * FROM curve")
def inflation_curve(spark, sf):
    return B.inflation_curve(I.test(spark, sf))


@query("m19_network", "fit_id:s n:i crps:d coverage_80pct:d interval_width:d upper_crps:d")
def network(spark, sf):
    tr = I.train(spark, sf).withColumn("fit_id", F.lit("all"))
    model = fit_networks(tr, {"all": 0})
    return model.transform(I.test(spark, sf)).groupBy("fit_id").agg(*S.bundle("t2m_obs", "q"))


@query("m20_network_seeds", "k:i n_seeds:i crps:d crps_std:d coverage_80pct:d coverage_80pct_std:d")
def network_seeds(spark, sf):
    """Three seeds for two training sizes, trained together; mean and population standard deviation of the scores."""
    tr = I.train(spark, sf)
    ranked = SM.rank_recent(SM.distinct_cases(tr))
    cases = materialise(ranked.withColumn("k", F.explode(F.filter(F.array(F.lit(12), F.lit(36)),
                                                                  lambda k: k > F.col("rank")))))
    tr = tr.join(cases.select(*SM.CASE, "k"), SM.CASE)
    seeds = F.explode(F.array(*[F.lit(s) for s in range(3)]))
    tr = materialise(tr.withColumn("seed", seeds).withColumn("fit_id", F.concat_ws("-", "k", "seed")))
    model = fit_networks(tr, {f"{k}-{s}": s for k in (12, 36) for s in range(3)}, use_lead=False)
    scored = model.transform(I.test(spark, sf)).groupBy("fit_id").agg(*S.bundle("t2m_obs", "q"))
    scored = scored.withColumn("k", F.split("fit_id", "-")[0].cast("int"))
    return R.random_arm(scored, ["k"], ["crps", "coverage_80pct"], population=True)


REFIT = X.tiered(ONE.format("test"), [POOLED])


@query("m21_refit_in_place", "method:s n:i crps:d mean_abs_change:d",
       f"""SELECT *, (SELECT avg(abs(t.q[5]-p.q[5])) FROM preds p JOIN ({REFIT}) t USING (station_id, valid_time, step_hours)
       WHERE p.method = 'gaussian_ensemble') AS mean_abs_change FROM (SELECT method, count(*) AS n, avg({C.crps()}) AS crps FROM (
       SELECT method, obs, q FROM preds WHERE method = 'inflation_fixed' UNION ALL SELECT 'gaussian_ensemble', t2m_obs, q
       FROM ({REFIT})) GROUP BY method)""")
def refit_in_place(spark, sf):
    tr, te = I.train(spark, sf), I.test(spark, sf)
    preds = I.predictions(spark, sf, ("gaussian_ensemble", "inflation_fixed"))
    out, change = refit_in_place_of(preds, "gaussian_ensemble", te, tr, T.KEY)
    scored = out.groupBy("method").agg(F.count(F.lit(1)).alias("n"),
                                       F.avg(S.crps("obs", "q")).alias("crps"))
    return scored.crossJoin(F.broadcast(change.select("mean_abs_change")))     # one row
