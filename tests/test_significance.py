from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from foresift.operators import significance as G


def series(spark, values, key="m"):
    days = pd.date_range("2017-01-01", periods=len(values)).date
    return spark.createDataFrame(pd.DataFrame({"method": key, "day": days, "d": np.asarray(values, dtype=float)}))


def lrv_np(d, lag):
    e = d - d.mean()
    n = len(e)
    return (e @ e + sum(2 * (1 - k / (lag + 1)) * (e[k:] @ e[:-k]) for k in range(1, min(lag, n - 1) + 1))) / n


def test_long_run_variance(spark):
    rng = np.random.default_rng(1)
    d = np.zeros(200)
    for i in range(1, 200):
        d[i] = 0.8 * d[i - 1] + rng.normal()
    for lag in (0, 5):
        got = G.long_run_variance(series(spark, d), ["method"], lag).first()["lrv"]
        assert abs(got - lrv_np(d, lag)) < 1e-10
    assert lrv_np(d, 5) > 2 * d.var()
    short = np.array([1.0, 3.0, 2.0])
    assert abs(G.long_run_variance(series(spark, short), ["method"], 5).first()["lrv"] - lrv_np(short, 5)) < 1e-12


def test_hac_detects_a_shift_and_not_noise(spark):
    rng = np.random.default_rng(0)
    both = series(spark, rng.normal(-0.5, 1, 300), "shift").unionByName(series(spark, rng.normal(0, 1, 300), "null"))
    got = {r["method"]: r for r in G.hac_test(both, ["method"]).collect()}
    assert got["shift"]["dm_pvalue"] < 1e-4 and got["shift"]["mean_diff"] < 0
    assert got["null"]["dm_pvalue"] > 0.05
    assert got["null"]["n_days"] == 300


def test_block_bootstrap_brackets_the_mean_and_is_reproducible(spark):
    rng = np.random.default_rng(2)
    d = rng.normal(0.3, 1, 150)
    run = lambda seed: G.moving_block_ci(series(spark, d), ["method"], seed=seed).first()
    a, b, c = run(0), run(0), run(1)
    # sums of the same draws may be added in another order
    assert all(abs(x - y) < 1e-9 for x, y in zip(a[1:], b[1:])) and abs(a["ci_low"] - c["ci_low"]) > 1e-9
    assert a["ci_low"] < d.mean() < a["ci_high"]
    assert 0.1 < a["ci_high"] - a["ci_low"] < 0.6
    assert G.moving_block_ci(series(spark, d[:5]), ["method"]).count() == 0


def panel(spark, shift):
    rng = np.random.default_rng(0)
    rows = [(s, float(x), float(x + e + shift)) for s in range(10) for x, e in zip(rng.gamma(2, 1, 200), rng.normal(0, 1, 200))]
    return spark.createDataFrame(rows, "station long, b double, a double").withColumn("method", F.lit("m"))


def test_blocked_tests(spark):
    df = panel(spark, -0.5)
    got = G.paired_block_test(G.block_means(df, ["method"], F.col("station"), F.col("a") - F.col("b")), ["method"]).first()
    assert got["n_blocks"] == 10 and got["t_pvalue"] < 1e-3
    assert got["wilcoxon_statistic"] == 0.0 and abs(got["wilcoxon_pvalue"] - 2 / 1024) < 1e-12
    null = panel(spark, 0.0)
    got = G.paired_block_test(G.block_means(null, ["method"], F.col("station"), F.col("a") - F.col("b")), ["method"]).first()
    assert got["t_pvalue"] > 0.05 and got["wilcoxon_pvalue"] > 0.05


def wilcoxon_brute(d):
    d = np.asarray([x for x in d if x != 0])
    ranks = pd.Series(np.abs(d)).rank().to_numpy()
    w = min(ranks[d > 0].sum(), ranks[d < 0].sum())
    n = len(d)
    sums = [sum(r for i, r in enumerate(range(1, n + 1)) if m >> i & 1) for m in range(1 << n)]
    return w, min(1.0, 2 * np.mean(np.asarray(sums) <= w))


def test_signed_rank_exact_and_ties(spark):
    d = [0.3, -1.2, 2.5, 0.7, -0.1, 4.0, 1.1, -2.2, 3.3]
    frame = lambda v: spark.createDataFrame([("m", i, float(x)) for i, x in enumerate(v)], "method string, block_id long, d double")
    got = G.paired_block_test(frame(d), ["method"]).first()
    w, p = wilcoxon_brute(d)
    assert got["wilcoxon_statistic"] == w and abs(got["wilcoxon_pvalue"] - p) < 1e-12
    tied = [1.0, -1.0, 2.0, 2.0, 0.0, 3.0, -4.0, 5.0]
    got = G.paired_block_test(frame(tied), ["method"]).first()
    assert got["wilcoxon_statistic"] == wilcoxon_brute(tied)[0]
    same = G.paired_block_test(frame([0.0, 0.0, 0.0]), ["method"]).first()
    assert same["wilcoxon_pvalue"] is None and same["t_statistic"] is None


def test_bootstrap_skill(spark):
    df = panel(spark, -0.5)
    got = G.block_bootstrap_skill(df, ["method"], F.col("station"), F.col("a"), F.col("b"), n_boot=400).first()
    tot = df.agg(F.sum("a"), F.sum("b")).first()
    assert abs(got["skill"] - (1 - tot[0] / tot[1])) < 1e-12
    assert got["ci_low"] < got["skill"] < got["ci_high"] and got["ci_low"] > 0


def curve(spark, rows, ref=1.0):
    return spark.createDataFrame([("c", float(n), None if v is None else float(v), ref) for n, v in rows],
                                 "method string, n double, value double, ref double")


@pytest.mark.parametrize("rows,better,want", [
    ([(1, 2.0), (3, 0.0)], "lower", 2.0),
    ([(3, 0.0), (1, 2.0)], "lower", 2.0),
    ([(1, 0.5), (3, 0.2)], "lower", None),
    ([(1, 2.0), (3, 1.5)], "lower", None),
    ([(1, 2.0), (2, float("nan")), (3, 0.0)], "lower", None),
    ([(1, 2.0), (2, None), (3, 1.5), (4, 0.5)], "lower", 3.5),
    ([(1, 0.0), (3, 2.0)], "higher", 2.0),
    ([(1, 2.0), (2, 0.0), (3, 2.0), (4, 0.0)], "lower", 1.5),
    ([(1, 5.0)], "lower", None),
])
def test_first_crossing(spark, rows, better, want):
    assert G.first_crossing(curve(spark, rows), ["method"], better=F.lit(better)).first()["breakpoint"] == want


def test_direction_verdicts(spark):
    run = lambda rows, metric: G.crossing_with_direction(curve(spark, rows), ["method"], metric).first()
    assert run([(1, 2.0), (3, 0.0)], "crps")["verdict"] == "crossed downward"
    assert run([(1, 0.5), (3, 0.2)], "crps")["verdict"] == "already better"
    assert run([(1, 3.0), (3, 2.0)], "crps")["verdict"] == "never"
    assert run([(1, None)], "crps")["verdict"] == "too few points"
    up = run([(1, 0.5), (2, 0.8), (3, 1.2)], "coverage_80pct")
    assert up["verdict"] == "crossed upward" and abs(up["breakpoint"] - 2.5) < 1e-12
    assert run([(1, 1.5), (2, 1.4), (3, 0.9)], "coverage_80pct")["verdict"] == "crossed downward"
    assert run([(1, 0.5)], "coverage_80pct")["verdict"] == "too few points"
    with pytest.raises(ValueError):
        run([(1, 0.5)], "interval_width")


def test_durable_significance(spark):
    rows = lambda data: spark.createDataFrame([("m", *r) for r in data], "method string, k long, diff double, p double")
    f = lambda data: G.first_durable_significance(rows(data), ["method"], "k", "diff", "p").first()["first_k"]
    assert f([(1, -1.0, 0.01), (2, -1.0, 0.2), (5, -1.0, 0.01), (9, -1.0, 0.001)]) == 5
    assert f([(1, -1.0, 0.01), (2, 1.0, 0.01)]) is None
    assert f([(1, -1.0, 0.01), (2, -1.0, 0.01)]) == 1
    assert f([(1, -1.0, None), (2, -1.0, 0.01)]) == 2


def test_last_durable_crossing(spark):
    f = lambda rows: G.last_durable_crossing(curve(spark, rows), ["method"]).first()
    assert f([(1, 0.5), (2, 0.4)])["status"] == "<first"
    assert f([(1, 0.5), (2, 1.4)])["status"] == "none"
    got = f([(1, 2.0), (2, 0.5), (3, 1.5), (5, 0.5)])
    assert got["status"] == "crossed" and got["crossing"] == 4.0


def test_scores_are_withheld_below_the_minimum(spark):
    rows = spark.createDataFrame([("m", f"2017-01-{d:02d}", float(d % 3), 1.0 if d % 2 else None, 1.5) for d in range(1, 21)],
                                 "method string, day string, step_hours double, crps double, crps_r double").select(
        "*", F.col("day").cast("timestamp_ntz").alias("valid_time"), F.lit(1.0).alias("upper_crps"),
        F.lit(1.0).alias("covered"), F.lit(2.0).alias("width"))
    few = G.guarded_scores(rows, ["method"], ["r"], {"b": (0, 1)}, min_instances=11).first()
    assert few["n_instances"] == 10 and few["covered_fraction"] == 0.5 and few["crps"] is None
    enough = G.guarded_scores(rows, ["method"], ["r"], {"b": (0, 1)}, min_instances=10).first()
    assert enough["crps"] == 1.0 and enough["vs_r_mean_diff"] == -0.5


def test_losses_lie_beside_the_reference(spark, sf):
    """All methods of an instance are scored in one row: no keyed join brings the score of the reference."""
    from foresift.plans import inputs as I
    plan = I._losses(spark, sf, "raw_ensemble")._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Join " in line and "station_id" in line]


def test_guarded_scores_read_their_rows_once(spark, monkeypatch):
    """All scores and tests start from sums by day, lead and mask: the tests get one row per comparison and day, not the instances."""
    rows = spark.range(4000).select(
        F.lit("a").alias("method"), F.expr("make_timestamp_ntz(2020, 1, 1 + int(id % 20), int(id % 2) * 6, 0, 0)").alias("valid_time"),
        (F.col("id") % 2 * 6.0).cast("double").alias("step_hours"), F.when(F.col("id") % 7 > 0, F.col("id") % 11 * 1.0).alias("crps"),
        F.lit(1.0).alias("upper_crps"), F.lit(1.0).alias("covered"), F.lit(2.0).alias("width"),
        F.when(F.col("id") % 5 > 0, F.col("id") % 3 * 2.0).alias("crps_r"), (F.col("id") % 4).cast("bigint").alias("members"))
    seen, robust = [], G.robust_comparison

    def spy(losses, keys, diff):
        seen.append((losses.count(), losses.select(*keys, "valid_time").distinct().count()))
        return robust(losses, keys, diff)

    monkeypatch.setattr(G, "robust_comparison", spy)
    got = G.guarded_scores(rows, ["method"], ["r"], {"short": (0, 0)}, 10, ["r"]).first()
    # the reference is missing on four of the 20 days, two of them among the ten days with rows of the common set
    assert seen == [(16 + 8, 16 + 8)]
    pdf = rows.toPandas()
    have = pdf[pdf["crps"].notna()]
    assert got["n_instances"] == len(have) and got["covered_fraction"] == pytest.approx(len(have) / len(pdf))
    assert got["crps_r_short"] == pytest.approx(have[have["step_hours"] == 0]["crps_r"].mean())
    inside = have[have["members"] % 2 == 1]
    assert got["crps_common"] == pytest.approx(inside["crps"].mean()) and got["crps_r_common"] == pytest.approx(inside["crps_r"].mean())
    for part, name in ((have, "vs_r_mean_diff"), (inside, "vs_r_common_mean_diff")):
        daily = (part["crps"] - part["crps_r"]).groupby(part["valid_time"].dt.date).mean()
        assert got[name] == pytest.approx(daily.mean())


def test_guarded_input_lies_beside_the_references(spark, sf):
    """The rows of the guarded table come without a keyed join of predictions."""
    from foresift.plans import significance_queries as H
    plan = H.guarded_input(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Join " in line and "station_id" in line]
