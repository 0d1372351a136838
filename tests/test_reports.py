from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from foresift.functions import scores as S
from foresift.operators import reports as R
from foresift.operators import sampling as SM
from foresift.operators import significance as G
from foresift.sources import storage


def panel(n_cases=40, stations=3, seed=0):
    """Two cases in each month; the later half of the stations' bias differs by season."""
    rng = np.random.default_rng(seed)
    days = pd.date_range("2015-01-05", periods=n_cases, freq="15D")
    rows = [(s, c % 4, c // 4, day, h, m, v, m + s + rng.normal(0, 1.5 * np.sqrt(v))) for c, day in enumerate(days)
            for s in range(stations) for h in (6.0, 12.0) for m, v in [(rng.normal(280, 5), rng.uniform(0.5, 3))]]
    pdf = pd.DataFrame(rows, columns=["station_id", "year_idx", "time_idx", "day", "step_hours", "ens_mean", "ens_var", "t2m_obs"])
    pdf["valid_time"] = pdf["day"] + pd.to_timedelta(pdf["step_hours"], "h")
    return pdf.assign(case_date=pdf["day"].dt.date).drop(columns="day")


@pytest.fixture(scope="module")
def tables(spark):
    train = spark.createDataFrame(panel()).withColumn("valid_time", F.col("valid_time").cast("timestamp_ntz"))
    test = spark.createDataFrame(panel(30, seed=1)).withColumn("valid_time", F.col("valid_time").cast("timestamp_ntz"))
    return train, test


def test_training_size_table_has_network_rows_and_days(tables):
    train, test = tables
    got = R.training_size_table(train, test, [5, 0], [0, 1], network_seeds=(0, 1), rounds=1, local_steps=5).toPandas()
    net = got[got.method == "network"].set_index("k").sort_index()
    assert list(net.index) == [0, 5, 40] and set(net["arm"]) == {"contiguous"}
    assert net.loc[5, "calendar_days"] == round(5 * SM.DAYS_PER_CASE) and np.isnan(net.loc[40, "calendar_days"])
    assert net.loc[40, "n_days"] == "full" and float(net.loc[5, "n_days"]) == round(5 * SM.DAYS_PER_CASE, 4)
    assert net.loc[5, "crps"] > 0 and net.loc[5, "crps_std"] >= 0 and np.isnan(net.loc[0, "crps"])
    inst = test.withColumnRenamed("t2m_obs", "obs")
    sets = SM.full_and_smaller(SM.distinct_cases(train), [5], [0])
    runs = R.network_scores(SM.sweep_panel(train, sets), inst, [5], (0, 1), {"rounds": 1, "local_steps": 5}).toPandas()
    assert abs(net.loc[5, "crps"] - runs["crps"].mean()) < 1e-6 and abs(net.loc[5, "crps_std"] - runs["crps"].std(ddof=0)) < 1e-6


def test_sizes_below_the_whole_of_each_group(spark):
    cases = spark.createDataFrame([(g, 0, i, f"2015-01-{i + 1:02d}") for g, n in (("a", 3), ("b", 8)) for i in range(n)],
                                  "g string, year_idx int, time_idx int, d string").withColumn("case_date", F.to_date("d")).drop("d")
    got = SM.full_and_smaller(cases, [2, 5], [7], ["g"]).groupBy("g", "arm", "k").count().collect()
    assert {(r["g"], r["arm"], r["k"]): r["count"] for r in got} == {
        ("a", "contiguous", 2): 2, ("a", "random", 2): 2, ("a", "contiguous", 3): 3, ("b", "contiguous", 2): 2, ("b", "random", 2): 2,
        ("b", "contiguous", 5): 5, ("b", "random", 5): 5, ("b", "contiguous", 8): 8}


def test_seasonal_sweep_and_breakpoints(tables):
    train, test = tables
    from foresift.operators.emos import fit_emos, gaussian_quantiles
    refs = {"raw": gaussian_quantiles("ens_mean", "sqrt(ens_var)"), "wide": gaussian_quantiles("ens_mean", "3D*sqrt(ens_var)")}
    table = R.seasonal_sweep(train, test, [2, 6], refs, [0, 1])
    stored = storage.materialise(table)
    got = stored.toPandas()
    assert set(got["arm"]) == {"contiguous", "random", "n_independent"}
    cases = {s: len(p[["year_idx", "time_idx"]].drop_duplicates()) for s, p in
             panel().assign(season=lambda d: pd.to_datetime(d["case_date"]).dt.month.map(lambda m: ["DJF", "MAM", "JJA", "SON"][m % 12 // 3])).groupby("season")}
    for season, n in cases.items():
        own = got[(got.season == season) & (got.method == "emos_pooled")]
        below = [k for k in (2, 6) if k < n]
        assert sorted(own[own.arm == "contiguous"]["k"]) == [*below, n] and sorted(own[own.arm == "random"]["k"]) == below
    assert set(got[got.method == "emos_local_leadspec"]["k"]) == {float(k) for n in cases.values() for k in (6, n) if 5 <= k <= n}
    assert cases["JJA"] > 6
    tested = got[got.arm == "contiguous"]
    for r in ("raw", "wide"):
        line = got[(got.arm == "n_independent") & (got.method == r)].set_index("season")["crps"]
        pooled = tested[tested.method == "emos_pooled"]
        # daily means weigh days equally, all days hold as many rows
        np.testing.assert_allclose(pooled[f"hac_{r}_mean_diff"], pooled["crps"] - pooled["season"].map(line), atol=0.2)
    # the random arm against fits of each seed
    te = test.toPandas()
    te["season"] = pd.to_datetime(te["case_date"]).dt.month.map(lambda m: ["DJF", "MAM", "JJA", "SON"][m % 12 // 3])
    te = te[te.season == "JJA"]
    in_season = train.where(F.month("case_date").isin(6, 7, 8))
    scores = []
    for seed in (0, 1):
        row = fit_emos(SM.k_random(in_season, 6, seed)).first()
        mu, sg = row["a"] + row["b"] * te["ens_mean"], np.sqrt(np.exp(row["c"]) + np.exp(row["d"]) * te["ens_var"])
        from statistics import NormalDist
        q = np.stack([mu + sg * NormalDist().inv_cdf(t) for t in S.LEVELS])
        d = te["t2m_obs"].to_numpy() - q
        scores.append(2 * np.mean([np.maximum(t * x, (t - 1) * x) for t, x in zip(S.LEVELS, d)]))
    own = got[(got.season == "JJA") & (got.arm == "random") & (got.k == 6)].iloc[0]
    assert abs(own["crps"] - np.mean(scores)) < 1e-6 and abs(own["crps_std"] - np.std(scores)) < 1e-6
    points = R.seasonal_breakpoints(stored, "wide").toPandas()
    assert len(points) == len(points.drop_duplicates(["season", "arm", "method", "metric"]))
    assert {"breakpoint", "days", "verdict", "first_k", "first_days", "reference"} <= set(points.columns)
    assert points[points.arm == "random"]["first_k"].isna().all()


def test_seasonal_tests_start_from_daily_rows(tables, monkeypatch):
    """Scored rows are read once: the tests get one row per comparison and day, not the instances again."""
    from foresift.operators.emos import gaussian_quantiles
    seen, robust = [], G.robust_comparison

    def spy(losses, keys, diff):
        seen.append((losses.count(), losses.select(*keys, "valid_time").distinct().count()))
        return robust(losses, keys, diff)

    monkeypatch.setattr(G, "robust_comparison", spy)
    R.seasonal_sweep(*tables, [2], {"raw": gaussian_quantiles("ens_mean", "sqrt(ens_var)")}, [0])
    assert len(seen) == 1 and seen[0][0] == seen[0][1] > 0


def test_common_sets_by_bit_mask(spark):
    keys = ["station_id"]
    rows = spark.createDataFrame([(i, "m", 1.0 + i, 2.0, 3.0 + i, 0.5) for i in range(6)],
                                 "station_id int, method string, crps double, crps_a double, crps_b double, upper_crps double")
    rows = rows.withColumns({"covered": F.lit(1.0), "width": F.lit(1.0), "step_hours": F.lit(0.0),
                             "valid_time": F.expr("make_timestamp_ntz(2017, 1, 1 + station_id, 0, 0, 0)")})
    sets = {"a": rows.where("station_id < 4").select(*keys), "b": rows.where("station_id >= 3").select(*keys)}
    masked = G.membership_mask(rows, sets, keys)
    assert [r["members"] for r in masked.orderBy("station_id").collect()] == [1, 1, 1, 3, 2, 2]
    got = {r["least"]: r for r in G.guarded_scores(masked, ["method"], ["a", "b"], {"all": (0, 1)}, [2, 4, 7], ["a", "b"]).collect()}
    assert got[2]["crps_common"] == 5.0 and got[2]["crps_a_common"] == 2.0 and got[2]["vs_a_common_mean_diff"] == 0.5
    assert got[4]["crps_common"] == 2.5 and got[4]["crps_b_common"] is None and got[4]["crps"] == 3.5
    assert got[7]["crps"] is None and got[7]["n_instances"] == 6


def test_replacement_in_storage_checks_its_rows(spark):
    path = f"{storage.shared_dir(spark)}/by-method-{uuid.uuid4().hex}"
    old = spark.createDataFrame([("a", 1), ("b", 2), ("c d/e", 3)], "method string, x int")
    storage.write_by_method(old, path)
    with pytest.raises(ValueError, match="not to be replaced"):
        storage.replace_methods(old.where("x < 3"), ["a"], path)
    with pytest.raises(ValueError, match="same columns"):
        storage.replace_methods(old.withColumn("y", F.lit(1)), ["a"], path)
    storage.replace_methods(spark.createDataFrame([("a", 9), ("a", 8)], "method string, x int"), ["a", "c d/e", "absent"], path)
    assert sorted(tuple(r) for r in spark.read.parquet(path).select("method", "x").collect()) == [("a", 8), ("a", 9), ("b", 2)]


def test_sizes_on_several_axes_are_fitted_once(tables, monkeypatch):
    """The rows are those of the whole table, and each size is fitted once, on recent cases only."""
    train, test = tables
    fitted, fit = [], R.fit_emos

    def spy(rows, keys, **options):
        fitted.append(rows.select("arm", "k").distinct().count())
        return fit(rows, keys, **options)

    monkeypatch.setattr(R, "fit_emos", spy)
    got = R.emos_by_size(train, test, {"small": [2, 5], "main": [5, 20]}).toPandas()
    assert fitted == [4, 4]
    monkeypatch.undo()
    keys = ["method", "arm", "k", "axis"]
    for axis, ks in (("small", [2, 5]), ("main", [5, 20])):
        want = R.training_size_table(train, test, ks, [0], network_seeds=()).toPandas().assign(axis=axis)
        want = want[(want["method"] == "inflation_fixed") | (want["method"].isin(["emos_pooled", "emos_local"]) & (want["arm"] == "contiguous"))]
        both = want.merge(got, on=keys, suffixes=("", "_got"))
        assert len(both) == len(want) == (got["axis"] == axis).sum()
        for c in ("crps", "coverage_80pct"):
            np.testing.assert_allclose(both[c], both[f"{c}_got"], atol=1e-9)


def test_size_table_fits_pooled_sets_from_cases_and_scores_them_once(tables, monkeypatch):
    """Panel rows are not repeated for the pooled sets, and stations of a fit are those of its models."""
    train, test = tables
    seen, unions = [], R.fit_unions
    monkeypatch.setattr(R, "fit_unions", lambda rows, *rest: (seen.append(rows.count()), unions(rows, *rest))[1])
    got = R.training_size_table(train, test.where("station_id < 3"), [5], [0], network_seeds=()).toPandas()
    assert seen == [train.count()]
    fits = got[got["arm"].isin(["contiguous", "random"])]
    assert len(fits) == 7 and (fits["n_stations"] == 3).all()
    from foresift.operators.emos import emos_quantiles, fit_emos
    alone = fit_emos(SM.k_recent(train, 5).where("station_id < 3"), ["station_id"])
    q = test.join(alone.select("station_id", "a", "b", "c", "d"), "station_id").withColumn("q", emos_quantiles())
    row = got[(got["method"] == "emos_local") & (got["k"] == 5)].iloc[0]
    assert abs(row["crps"] - q.agg(F.avg(S.crps("t2m_obs", "q"))).first()[0]) < 1e-6
