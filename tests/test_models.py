from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from foresift.functions.normal import cdf_np
from foresift.functions import scores as S
from foresift.operators import baselines as B
from foresift.operators import emos as E
from foresift.operators import leave_one_out as L
from foresift.operators import rolling as RO
from foresift.operators.leave_one_out import fit_leave_one_out
from foresift.operators.models import Climatology, Emos, NotFitted, Persistence, Postprocessor, RawEnsemble, VarianceInflation


def crps_np(mu, sg, y):
    z = (y - mu) / sg
    return sg * (z * (2 * cdf_np(z) - 1) + 2 * np.exp(-z * z / 2) / np.sqrt(2 * np.pi) - 1 / np.sqrt(np.pi))


def panel_pdf(n=1500, seed=42, stations=3):
    rng = np.random.default_rng(seed)
    m, v = rng.normal(280, 5, n), rng.uniform(0.5, 3, n)
    st = np.arange(n) % stations
    y = rng.normal(m + st, np.sqrt(v))
    return pd.DataFrame({"station_id": st.astype("int64"), "step_hours": np.where(np.arange(n) % 2, 6.0, 0.0), "ens_mean": m,
                         "ens_var": v, "t2m_obs": y})


@pytest.fixture(scope="module")
def panel(spark):
    pdf = panel_pdf()
    return spark.createDataFrame(pdf), pdf


def loss_of(row, pdf):
    mu = row["a"] + row["b"] * pdf["ens_mean"]
    return crps_np(mu, np.sqrt(np.exp(row["c"]) + np.exp(row["d"]) * pdf["ens_var"]), pdf["t2m_obs"]).mean()


def test_pooled_fit_is_a_minimum(panel):
    df, pdf = panel
    row = E.fit_emos(df).first()
    assert row["n_rows"] == len(pdf)
    assert abs(row["loss"] - loss_of(row, pdf)) < 1e-9
    assert abs(row["b"] - 1) < 0.02
    rng = np.random.default_rng(0)
    for _ in range(60):
        step = rng.normal(0, 1, 4) * np.array([0.3, 1e-3, 0.1, 0.1])
        near = {k: row[k] + s for k, s in zip("abcd", step)}
        near["a"] -= 280 * step[1]
        assert loss_of(near, pdf) >= row["loss"] - 1e-8


def test_lockstep_equals_packed(panel):
    df, pdf = panel
    for keys in ([], ["station_id"], ["station_id", "step_hours"]):
        packed = E.fit_emos(df, keys).toPandas()
        lock = E.fit_emos(df, keys, max_group_rows=0).toPandas()
        both = packed.merge(lock, on=keys, suffixes=("", "_l")) if keys else pd.concat(
            [packed, lock.add_suffix("_l")], axis=1)
        assert len(both) == len(packed) == len(lock)
        np.testing.assert_allclose(both["loss"], both["loss_l"], atol=1e-7)
        assert (both["n_rows"] == both["n_rows_l"]).all()


def test_mixed_sizes_keep_every_fit(spark):
    pdf = pd.concat([panel_pdf(900, 1, 1), panel_pdf(40, 2, 1).assign(station_id=7), panel_pdf(3, 3, 1).assign(station_id=8)])
    got = E.fit_emos(spark.createDataFrame(pdf), ["station_id"], min_rows=5, max_group_rows=500).toPandas()
    assert sorted(got["station_id"]) == [0, 7]
    assert sorted(got["n_rows"]) == [40, 900]


def test_last_observation_predictor(spark):
    rng = np.random.default_rng(7)
    n = 3000
    m, last = rng.normal(280, 5, n), rng.normal(280, 5, n)
    y = rng.normal(0.4 * m + 0.6 * last, 1.0)
    pdf = pd.DataFrame({"ens_mean": m, "last_obs": last, "ens_var": 1.0, "t2m_obs": y, "noise": rng.normal(280, 5, n)})
    df = spark.createDataFrame(pdf)
    row = E.fit_emos(df, predictors=("ens_mean", "last_obs")).first()
    assert abs(row["b"] - 0.4) < 0.05 and abs(row["e"] - 0.6) < 0.05
    lock = E.fit_emos(df, predictors=("ens_mean", "last_obs"), max_group_rows=0).first()
    assert abs(lock["loss"] - row["loss"]) < 1e-7
    noise = E.fit_emos(df, predictors=("ens_mean", "noise")).first()
    assert abs(noise["e"]) < 0.2


def left_out(df, station, lead=None):
    rest = df.where(F.col("station_id") != station)
    return E.fit_emos(rest if lead is None else rest.where(F.col("step_hours") == lead)).first()


def test_leave_one_out_equals_filtered_fits_and_does_not_leak(spark, panel):
    df, pdf = panel
    got = fit_leave_one_out(df).toPandas().set_index("station_id")
    for s in (0, 1, 2):
        want = left_out(df, s)
        assert abs(got.loc[s, "loss"] - want["loss"]) < 1e-9
        assert got.loc[s, "n_rows"] == want["n_rows"] and got.loc[s, "status"] == E.CONVERGED
        assert abs(loss_of(got.loc[s], pdf[pdf["station_id"] != s]) - got.loc[s, "loss"]) < 1e-9
    changed = df.withColumn("t2m_obs", F.when(F.col("station_id") == 1, F.col("t2m_obs") + 50).otherwise(F.col("t2m_obs")))
    again = fit_leave_one_out(changed).toPandas().set_index("station_id")
    assert abs(again.loc[1, "loss"] - got.loc[1, "loss"]) < 1e-9
    assert abs(again.loc[0, "loss"] - got.loc[0, "loss"]) > 0.1
    leads = fit_leave_one_out(df, lead_specific=True).toPandas()
    assert len(leads) == 6
    for r in leads.itertuples():
        assert abs(r.loss - left_out(df, r.station_id, r.step_hours)["loss"]) < 1e-9


def test_leave_one_out_with_a_hot_station_and_constant_variance(spark):
    """A station with most of the rows, unlike the others, moves the fit far; without spread of the variance c or d is undetermined."""
    pdf = panel_pdf(1600, 5, 8)
    hot = panel_pdf(2500, 6, 1).assign(station_id=100)
    hot["t2m_obs"] = 40 + 0.8 * hot["ens_mean"] + 6 * (hot["t2m_obs"] - hot["ens_mean"])
    for rows in (pd.concat([pdf, hot]), pdf.assign(ens_var=1.0)):
        df = spark.createDataFrame(rows)
        want = {s: left_out(df, s)["loss"] for s in (0, 100) if (rows["station_id"] == s).any()}
        # open fits directly, or expanded until they settle
        for how in ({}, {"direct_rows": 0}) if 100 in want else ({},):
            got = fit_leave_one_out(df, **how).toPandas().set_index("station_id")
            assert set(got["status"]) <= {E.CONVERGED, E.AT_BOUND} and len(got) == rows["station_id"].nunique()
            for s, loss in want.items():
                assert abs(got.loc[s, "loss"] - loss) < 1e-9


def test_leave_one_out_of_little_or_nothing(spark):
    schema = "station_id bigint, step_hours double, ens_mean double, ens_var double, t2m_obs double"
    assert fit_leave_one_out(spark.createDataFrame([], schema)).count() == 0
    one = spark.createDataFrame([(1, 0.0, 1.0, 1.0, float(i)) for i in range(30)] + [(1, 0.0, None, 1.0, 1.0)], schema)
    assert fit_leave_one_out(one).count() == 0          # without its only station nothing is left to fit on
    two = one.unionByName(one.withColumn("station_id", F.lit(2).cast("bigint")).limit(10))
    assert sorted(r["n_rows"] for r in fit_leave_one_out(two).collect()) == [10, 30]
    assert [r["station_id"] for r in fit_leave_one_out(two, True).collect()] == [2]      # 10 rows are too few for a lead


def test_expansion_equals_the_loss_nearby():
    pdf = panel_pdf(400)
    x, v, y = (pdf[c].to_numpy() for c in ("ens_mean", "ens_var", "t2m_obs"))
    centre = np.array([281.0, 1.01, 0.4, 1.1, 280.0])
    coef = L.expansion(centre, x, v, y).sum(axis=0)
    change = np.array([0.02, 1e-3, 0.01, -0.02])
    a, b, big_a, big_b = centre[:4] + change
    want = crps_np(a + b * (x - 280), np.sqrt(big_a + big_b * v), y).sum()
    assert abs(L._value(coef[None], L._powers(change[None]))[0] - want) < 1e-7


def test_fallback_chain(spark):
    rows = spark.createDataFrame([(1, 0.0), (2, 0.0), (3, 0.0)], "s long, l double").withColumns(
        {"ens_mean": F.lit(1.0), "ens_var": F.lit(1.0), "one": F.lit(1)})
    model = lambda data, key: spark.createDataFrame(data, f"{key} long, a double, b double, c double, d double, n_rows long")
    cell = model([(1, 1.0, 0.0, 0.0, 0.0, 30), (2, 1.0, 0.0, 0.0, 0.0, 6)], "s")
    stn = model([(2, 2.0, 0.0, 0.0, 0.0, 6), (3, 2.0, 0.0, 0.0, 0.0, 2)], "s")
    pooled = model([(1, 3.0, 0.0, 0.0, 0.0, 100)], "one")
    got = {r["s"]: (r["tier"], r["q"][4]) for r in E.predict_tiers(
        rows, [(cell, ["s"], 20), (stn, ["s"], 5), (pooled, ["one"], 1)]).collect()}
    assert got == {1: (0, 1.0), 2: (1, 2.0), 3: (2, 3.0)}
    none = E.predict_tiers(rows, [(stn, ["s"], 5)]).where("q is null").count()
    assert none == 2


def operational(spark, days=24, shift_from=None, shift=0.0, only_station=None):
    rng = np.random.default_rng(0)
    rows = []
    for d in range(days):
        for s in (1, 2):
            for step in (0, 6, 24):
                m = 280 + rng.normal(0, 3)
                y = m + s + rng.normal(0, 1)
                valid = pd.Timestamp("2017-01-01") + pd.Timedelta(days=d, hours=step)
                if shift_from is not None and valid >= pd.Timestamp(shift_from) and only_station in (None, s):
                    y += shift
                rows.append((s, float(step), (pd.Timestamp("2017-01-01") + pd.Timedelta(days=d)).to_pydatetime(),
                             valid.to_pydatetime(), m, 1.0, y))
    return spark.createDataFrame(rows, "station_id long, step_hours double, issue_time timestamp_ntz, valid_time timestamp_ntz, "
                                       "ens_mean double, ens_var double, t2m_obs double")


def test_rolling_fits_match_brute_force_windows_and_do_not_leak(spark):
    ops = operational(spark)
    windows = [5, 9]
    out = RO.rolling_predictions(ops, ops, windows).toPandas()
    hist = ops.toPandas()
    assert set(out["method"]) == set(RO.VARIANTS)
    # issue times with fewer than 20 verified pairs get no forecast
    for w in windows:
        for t in hist["issue_time"].unique():
            h = hist[(hist.issue_time >= t - pd.Timedelta(days=w)) & (hist.issue_time < t) & (hist.valid_time < t)]
            part = out[(out.window_days == w) & (out.issue_time == t)]
            assert (len(part) > 0) == (len(h) >= RO.MIN_HISTORY)
            if len(part) and len(h) > 24:
                row = E.fit_frame(h.assign(k=0), ["k"], ("ens_mean",), "ens_var", "t2m_obs", 60).iloc[0]
                mean = part[part.method == "rolling_pooled_leadspec"]
                use = mean[mean.tier == 1]
                want = row["a"] + row["b"] * use["ens_mean"]
                got = use["q"].map(lambda q: q[4])
                np.testing.assert_allclose(got, want, atol=5e-3)
    # windows that reach back to the first day share its fit, and get what they would get alone
    wide = RO.rolling_predictions(ops, ops, [5, 9, 90, 200]).toPandas()
    by = ["method", "station_id", "valid_time", "step_hours"]
    far, further = (wide[wide.window_days == w].set_index(by).sort_index() for w in (90, 200))
    alone = RO.rolling_predictions(ops, ops, [200]).toPandas().set_index(by).sort_index()
    assert len(far) == len(further) == len(alone) > 0
    for a, b in ((far, further), (further, alone)):
        assert max(abs(x[4] - y[4]) for x, y in zip(a["q"], b["q"]) if x is not None) < 1e-6
    # observations that verify on or after the 15th must not change forecasts issued up to the 15th
    moved = RO.rolling_predictions(operational(spark, shift_from="2017-01-15", shift=40.0), ops, windows).toPandas()
    cols = ["method", "window_days", "station_id", "valid_time", "step_hours"]
    both = out.merge(moved, on=cols, suffixes=("", "_m"))
    early = both[both.issue_time <= pd.Timestamp("2017-01-15")]
    late = both[both.issue_time > pd.Timestamp("2017-01-17")]
    diff = lambda d: np.array([abs(a[4] - b[4]) for a, b in zip(d["q"], d["q_m"])])
    assert len(early) > 50 and diff(early).max() < 1e-9
    assert diff(late).mean() > 1


def test_inflation(spark):
    rng = np.random.default_rng(0)
    n = 6000
    m, v = rng.normal(280, 5, n), rng.uniform(0.5, 3, n)
    y = rng.normal(m, 2 * np.sqrt(v))
    df = spark.createDataFrame(pd.DataFrame({"ens_mean": m, "ens_var": v, "t2m_obs": y}))
    assert abs(B.fit_inflation(df).first()["multiplier"] - 2) < 0.05
    lam = B.coverage_inflation(df, 0.8).first()["multiplier"]
    assert abs(lam - 2) < 0.1
    q = B.inflation_predict(df, B.coverage_inflation(df, 0.8))
    assert abs(q.agg(F.avg(S.covered("t2m_obs", "q"))).first()[0] - 0.8) < 1e-3
    with pytest.raises(PySparkException):
        B.coverage_inflation(df.withColumn("t2m_obs", F.col("ens_mean") + 1e6), 0.8).collect()


def test_model_interface(spark, panel):
    df, pdf = panel
    with pytest.raises(TypeError):
        Postprocessor()
    for model in (Climatology(), Emos(), VarianceInflation()):
        with pytest.raises(NotFitted):
            model.transform(df)
        q = model.fit(df).transform(df).select("q").first()["q"]
        assert len(q) == 9 and q == sorted(q)
    fixed = VarianceInflation(multiplier=1.5)
    assert fixed.fit(df).transform(df).first()["q"] == VarianceInflation(multiplier=1.5).transform(df).first()["q"]
    chosen = VarianceInflation.for_coverage(df, 0.8)
    before = chosen.model.first()["multiplier"]
    assert chosen.fit(df.limit(20)).model.first()["multiplier"] == before
    raw = df.withColumn("raw_q", F.array(*[F.lit(float(i)) for i in range(9)])).withColumn("last_obs", F.lit(4.0))
    assert RawEnsemble().fit(df).transform(raw).first()["q"] == [float(i) for i in range(9)]
    assert Persistence().fit(df).transform(raw).first()["q"] == [4.0] * 9


def test_fits_run_to_convergence(spark):
    """Every (station, lead) fit has the loss of a run that only stops when no step gains anything."""
    from foresift.plans import inputs as I
    rows = I.train(spark, "/root/testdata/sf0.01").select("station_id", "step_hours", "ens_mean", "ens_var", "t2m_obs").toPandas()
    rows = rows.sort_values(["station_id", "step_hours"]).reset_index(drop=True)
    fit = rows.groupby(["station_id", "step_hours"]).ngroup().to_numpy()
    x = np.column_stack([np.ones(len(rows)), rows["ens_mean"]])
    args = (x, rows["ens_var"].to_numpy(), rows["t2m_obs"].to_numpy(), fit, int(fit[-1]) + 1)
    state = E.fit_segments(*args, 5000)
    far = E.Scoring(args[-1], 2, tol=0.0)
    ids, starts = np.arange(args[-1]), np.flatnonzero(np.r_[True, fit[1:] != fit[:-1]])
    with np.errstate(all="ignore"):
        for i in range(2000):
            far.update(ids, np.add.reduceat(E.row_terms(far.trial[fit], *args[:3]), starts, axis=0))
            far.damp = np.minimum(far.damp, 1e100)
            if i % 60 == 59:                    # begin again from little damping
                far.damp[:] = 1e-3
                far._propose(ids)
    assert (state.loss - far.loss < 1e-9).all()


def test_fits_that_do_not_converge_keep_their_best_and_say_so(spark):
    x = np.column_stack([np.ones(50), np.arange(50.0)])
    state = E.fit_segments(x, np.ones(50), np.sin(np.arange(50.0)), np.zeros(50, int), 1, 2)
    assert state.status().tolist() == [E.STOPPED] and np.isfinite(state.loss).all()
    rows = panel_pdf(60, 3, 2)
    exact = rows.assign(t2m_obs=2 + 0.5 * rows["ens_mean"]).iloc[:8].assign(station_id=9)      # no error: no variance either
    got = E.fit_emos(spark.createDataFrame(pd.concat([rows, exact])), ["station_id"]).toPandas().set_index("station_id")
    assert (got.loc[[0, 1], "status"] == E.CONVERGED).all() and got.loc[9, "status"] in (E.AT_BOUND, E.STOPPED)
    assert got.loc[9, "loss"] < 1e-6
    few = E.fit_emos(spark.createDataFrame(rows), ["station_id"], max_iter=3).toPandas()
    assert (few["status"] == E.STOPPED).all() and (few["loss"] < 10).all()


def test_small_groups_are_not_fitted(monkeypatch):
    """Groups under the least number of rows never reach the fit, and a pass over the terms is short."""
    rng = np.random.default_rng(3)
    sizes = [2, 6, 1, 9, 4]
    pdf = pd.DataFrame({"k": np.repeat(np.arange(5), sizes), "ens_mean": rng.normal(size=22), "ens_var": rng.gamma(2.0, size=22),
                        "t2m_obs": rng.normal(size=22)})
    seen, fit = [], E.fit_segments
    monkeypatch.setattr(E, "fit_segments", lambda x, *rest: (seen.append(len(x)), fit(x, *rest))[1])
    got = E.fit_frame(pdf, ["k"], ("ens_mean",), "ens_var", "t2m_obs", 5000, 5)
    assert seen == [15] and got["k"].tolist() == [1, 3] and got["n_rows"].tolist() == [6, 9]
    assert E.fit_frame(pdf, ["k"], ("ens_mean",), "ens_var", "t2m_obs", 5000, 50).empty
    assert E.CHUNK_ROWS * 8 * 60 <= 4 << 20


def test_stages_of_scores_are_compiled(spark):
    """Wide rows of scores must not become one method that HotSpot never compiles; the session's own setting is kept."""
    from foresift.sources import storage
    spark.conf.set(storage.HUGE_METHOD, "50000")
    try:
        with storage.compiled_methods(spark):
            assert spark.conf.get(storage.HUGE_METHOD) == "8000"
        assert spark.conf.get(storage.HUGE_METHOD) == "50000"
    finally:
        spark.conf.unset(storage.HUGE_METHOD)


def cases_pdf(n=24_000, seed=7):
    """Two groups of six and four cases."""
    rng = np.random.default_rng(seed)
    g = (np.arange(n) % 5 > 2).astype(int)
    part = rng.integers(0, np.where(g, 4, 6))
    m, v = rng.normal(10, 4, n), rng.gamma(2.0, 2.0, n) + 0.1
    return pd.DataFrame({"grp": np.where(g, "b", "a"), "part": part, "n_parts": np.where(g, 4, 6), "station_id": rng.integers(0, 40, n),
                         "step_hours": rng.choice([0.0, 6.0], n), "ens_mean": m, "ens_var": v,
                         "t2m_obs": rng.normal(0.3 + 1.02 * m, np.sqrt(0.5 + 0.8 * v))})


def test_unions_of_cases_are_fitted_from_sums(spark, monkeypatch):
    pdf = cases_pdf()
    sets = [(g, k, p) for g, n in (("a", 6), ("b", 4)) for k in (1, 2, 4, n) for p in range(k)]
    sets = spark.createDataFrame(sorted(set(sets)), "grp string, k int, part bigint")
    df = spark.createDataFrame(pdf).withColumn("part", F.col("part").cast("bigint"))
    direct = []
    monkeypatch.setattr(L, "fit_emos", lambda rows, *a, **kw: direct.append(rows.count()) or E.fit_emos(rows, *a, **kw))
    got = L.fit_unions(df, sets, ["grp"], ["part"], ["grp", "k"], direct_rows=4000).toPandas()
    expanded = E.fit_emos(df.join(sets, ["grp", "part"]), ["grp", "k"]).toPandas()
    both = got.merge(expanded, on=["grp", "k"], suffixes=("", "_d"))
    assert len(got) == len(both) == len(expanded) and (both["n_rows"] == both["n_rows_d"]).all()
    np.testing.assert_allclose(both["loss"], both["loss_d"], atol=1e-9)
    np.testing.assert_allclose(both[["a", "b", "c", "d"]], both[["a_d", "b_d", "c_d", "d_d"]], atol=2e-4)
    # rows are not repeated by set, but for the small sets
    assert max(direct) <= len(pdf) and sum(direct[1:]) < len(pdf)


@pytest.mark.parametrize("bound", [1_000_000, 100])
def test_nested_fits_meet_their_sets_in_tasks(spark, bound):
    pdf = cases_pdf(6000)
    df, ks = spark.createDataFrame(pdf), [1, 2, 4, 9]
    got = E.fit_nested(df, ["grp", "station_id"], {"all": ([], 1), "lead": (["step_hours"], 2)}, ks, "part", "n_parts", min_rows=5,
                       max_group_rows=bound).toPandas()
    whole = pd.concat([*[pdf[(pdf["part"] < k) & (k < pdf["n_parts"])].assign(k=k) for k in ks], pdf.assign(k=pdf["n_parts"])])
    for tier, own, least in (("all", [], 1), ("lead", ["step_hours"], 2)):
        keys = ["grp", "station_id", "k", *own]
        want = E.fit_frame(whole[whole["k"] >= least], keys, ("ens_mean",), "ens_var", "t2m_obs", 5000, 5)
        part = got[got["tier"] == tier].drop(columns=[] if own else ["step_hours"])
        both = part.merge(want, on=keys, suffixes=("", "_d"))
        assert len(part) == len(both) == len(want) and (both["n_rows"] == both["n_rows_d"]).all()
        np.testing.assert_allclose(both["loss"], both["loss_d"], atol=1e-9)


def test_expansions_are_summed_without_being_written(spark, monkeypatch):
    """Long segments of rows are products, short ones sums of rows; a task passes on one row per group and not one per slice."""
    rng = np.random.default_rng(4)
    n = 900
    x, v = rng.normal(30, 9, n), rng.gamma(2.0, 20, n)
    y = x + rng.normal(0, 9, n)
    centre = np.tile([30.0, 0.9, 20.0, 0.5, 30.0], (n, 1))
    each = L.expansion(centre, x, v, y)
    for start in (np.array([0, 300, 310, 800]), np.arange(0, n, 3)):
        want = np.add.reduceat(each, start, axis=0)
        size = np.add.reduceat(np.abs(each), start, axis=0)
        monkeypatch.setattr(L, "expansion", lambda *a: pytest.fail("written")) if len(start) == 4 else monkeypatch.undo()
        assert (np.abs(L.expansion_sums(centre, x, v, y, start) - want) <= 1e-13 * size).all()
    monkeypatch.undo()
    pdf = pd.DataFrame(centre, columns=L.CENTRE).assign(part=np.arange(n) % 4, ens_mean=x, ens_var=v, t2m_obs=y)
    monkeypatch.setattr(L, "SLICE_ROWS", 100)
    got = {}
    for held in (8192, 5):
        monkeypatch.setattr(L, "HELD_SUMS", held)
        got[held] = L._group_sums(spark.createDataFrame(pdf).coalesce(1), ["part"]).toPandas().sort_values("part")
    assert got[5]["n"].tolist() == [225] * 4
    np.testing.assert_allclose(got[5][L.SUMS], got[8192][L.SUMS], rtol=1e-9)
    np.testing.assert_allclose(got[5][L.SUMS], np.stack([each[i::4].sum(axis=0) for i in range(4)]), rtol=1e-7, atol=1e-7)
