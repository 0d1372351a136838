from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from foresift.operators import panel as P
from foresift.operators import reports as R
from foresift.operators import sampling as SM
from foresift.operators import timeseries as TS
from foresift.plans import inputs as I
from foresift.sources import storage


def ts(text):
    return dt.datetime.fromisoformat(text)


def test_members_nan_and_alignment(spark):
    cube = spark.createDataFrame([(1, [1.0, float("nan"), 3.0])], "station_id long, members array<double>")
    rows = P.explode_members(cube).orderBy("member").collect()
    assert [r["t2m_forecast"] for r in rows] == [1.0, None, 3.0]
    got = P.ensemble_stats(P.explode_members(cube), ["station_id"]).first()
    assert (got["ens_mean"], got["ens_var"], got["n_members"]) == (2.0, 2.0, 2)


def test_overlapping_case_is_dropped(spark):
    rows = spark.createDataFrame([(0, 0, ts("2016-12-20 06:00")), (0, 0, ts("2016-12-20 00:00")), (0, 1, ts("2016-12-31 18:00")),
                                  (0, 1, ts("2017-01-01 00:00"))], "year_idx int, time_idx int, valid_time timestamp_ntz")
    got = P.nonoverlapping_cases(rows, "2017-01-01").collect()
    assert [(r["time_idx"], str(r["case_date"])) for r in got] == [(0, "2016-12-20")]


def test_season_and_buckets(spark):
    months = spark.range(1, 13).select(P.season(F.col("id")).alias("s")).collect()
    assert [m[0] for m in months] == ["DJF", "DJF", "MAM", "MAM", "MAM", "JJA", "JJA", "JJA", "SON", "SON", "SON", "DJF"]
    with pytest.raises(PySparkException):
        spark.range(13, 14).select(P.season(F.col("id"))).collect()
    leads = spark.createDataFrame([(float(v),) for v in (0, 24, 27, 30, 72, 75, 120, 126)], "h double")
    got = leads.select(P.lead_bucket(F.col("h")), P.lead_bucket(F.col("h"), True)).collect()
    assert [r[0] for r in got] == ["0-24h", "0-24h", None, "24-72h", "24-72h", None, "72-120h", None]
    assert [r[1] for r in got] == ["0-24h", "0-24h", "24-72h", "24-72h", "24-72h", "72-120h", "72-120h", None]


def test_alignment_is_strict(spark):
    inst = spark.createDataFrame([(1, ts("2017-01-01"), 0.0), (2, ts("2017-01-01"), 0.0)],
                                 "station_id long, valid_time timestamp_ntz, step_hours double")
    preds = inst.where("station_id = 1").withColumn("q", F.array(F.lit(1.0)))
    with pytest.raises(PySparkException):
        P.align(inst, preds).collect()
    assert P.align(inst, preds, strict=False).where("q is null").count() == 1
    with pytest.raises(ValueError):
        P.upsert_by_method(inst.withColumn("method", F.lit("a")), preds.withColumn("method", F.lit("a")), ["a"])


def test_index_lookup_passes_dates_through(spark):
    df = spark.createDataFrame([(dt.date(2017, 1, 2),)], "d date")
    assert P.lookup_dates(df, "d", None).first()["case_date"] == dt.date(2017, 1, 2)


def series(spark, values):
    rows = [(1, ts("2017-01-01") + dt.timedelta(hours=h), v) for h, v in values]
    return spark.createDataFrame(rows, "series_id long, ts timestamp_ntz, value double")


def test_gaps_and_interpolation(spark):
    s = series(spark, [(0, 1.0), (1, 2.0), (3, 4.0), (4, 5.0)])
    assert [r["ts"] for r in TS.detect_gaps(s, ["series_id"], 1).collect()] == [ts("2017-01-01 02:00")]
    filled = TS.interpolate_gaps(s, ["series_id"], 1).orderBy("ts").collect()
    assert [r["value"] for r in filled] == [1.0, 2.0, 3.0, 4.0, 5.0]
    # gap across a month boundary, and an explicit missing value inside
    s = series(spark, [(24 * 30, 0.0), (24 * 30 + 10, None), (24 * 32, 48.0)])
    filled = TS.interpolate_gaps(s, ["series_id"], 1).orderBy("ts").collect()
    assert [r["value"] for r in filled] == [float(i) for i in range(49)]
    with pytest.raises(PySparkException):
        TS.interpolate_gaps(series(spark, [(0, 1.0), (1, None)]), ["series_id"], 1).collect()


def test_utc_needs_a_zone_and_has_no_gap_at_the_spring_jump(spark):
    berlin = [ts("2017-03-26 00:00"), ts("2017-03-26 01:00"), ts("2017-03-26 03:00"), ts("2017-03-26 04:00")]
    df = spark.createDataFrame([(1, t) for t in berlin], "series_id long, ts timestamp_ntz")
    with pytest.raises(ValueError):
        TS.to_utc(df, "ts", None)
    assert TS.detect_gaps(df, ["series_id"], 1).count() == 1
    assert TS.detect_gaps(TS.to_utc(df, "ts", "Europe/Berlin"), ["series_id"], 1).count() == 0


@pytest.mark.parametrize("lead,missing", [(6.0, None), (30.0, None), (6.0, 30), (126.0, 12)])
def test_lead_matched_equals_slices(spark, lead, missing):
    n, w = 60, 10
    days = [dt.date(2017, 1, 1) + dt.timedelta(days=i) for i in range(n) if i != missing]
    rows = [(1, lead, d, float((d - days[0]).days), 1000.0 + (d - days[0]).days) for d in days]
    df = spark.createDataFrame(rows, "s long, lead double, day date, y double, x double")
    got = {r["idx"]: r for r in TS.lead_matched(df, ["s", "lead"], "lead", w).collect()}
    k = int(lead // 24) + 1
    base = (days[0] - dt.date(1970, 1, 1)).days
    want = {}
    for t in range(n):
        need = range(t - k - w + 1, t + 1)
        if need[0] >= 0 and missing not in need:
            want[base + t] = ([float(d) for d in range(t - k - w + 1, t - k + 1)], [1000.0 + d for d in need])
    assert set(got) == set(want)
    for i, (ctx, cov) in want.items():
        assert got[i]["context"] == ctx and got[i]["covariate"] == cov and got[i]["horizon"] == k
        assert max(got[i]["context"]) <= (i - base) - k      # nothing verified after the issue day
    if k > 1:      # a lead beyond the offsets that were planned is an error, never dropped
        with pytest.raises(PySparkException):
            TS.lead_matched(df, ["s", "lead"], "lead", w, max_offset=k - 1).collect()


def instances(spark, n_days=12, station=1):
    rows = []
    for d in range(n_days):
        issue = ts("2017-01-01") + dt.timedelta(days=d)
        for step in (0, 6, 12, 18):
            v = issue + dt.timedelta(hours=step)
            rows.append((station, issue, float(step), v, 100.0 + d * 4 + step / 6, 1.0, float(d * 4 + step / 6)))
    return spark.createDataFrame(rows, "station_id long, issue_time timestamp_ntz, step_hours double, valid_time timestamp_ntz, "
                                       "ens_mean double, ens_var double, t2m_obs double")


def positions(inst):
    cov = inst.select("station_id", "valid_time", F.col("ens_mean").alias("x"))
    return TS.asof_positions(inst, cov)


@pytest.mark.parametrize("length,gap", [(4, 0), (9, 0), (4, 3)])
def test_contexts_end_before_the_issue_time(spark, length, gap):
    inst = instances(spark)
    got = TS.asof_contexts(inst, positions(inst), length, gap).orderBy("issue_time").collect()
    first = -(-(length + gap) // 4)
    assert len(got) == 12 - first
    for r, d in zip(got, range(first, 12)):
        end = d * 4 - gap
        assert r["context"] == [float(i) for i in range(end - length, end)]
        assert r["covariate"] == [100.0 + i for i in range(end - length, d * 4 + 4)]
        assert r["horizon"] == 4 + gap and r["lead_pos"] == [gap + i for i in range(4)]
        assert r["obs"] == [float(d * 4 + i) for i in range(4)]


def test_contexts_do_not_see_the_future(spark):
    inst = instances(spark)
    cut = ts("2017-01-08")
    moved = inst.withColumn("t2m_obs", F.when(F.col("valid_time") >= F.lit(cut), 9e9).otherwise(F.col("t2m_obs")))
    a = {r["issue_time"]: r["context"] for r in TS.asof_contexts(inst, positions(inst), 6).collect()}
    b = {r["issue_time"]: r["context"] for r in TS.asof_contexts(moved, positions(moved), 6).collect()}
    assert all(a[t] == b[t] for t in a if t <= cut) and any(a[t] != b[t] for t in a if t > cut)


def test_incomplete_lead_grid_is_skipped_with_a_gap(spark):
    inst = instances(spark).where("NOT (issue_time = '2017-01-09 00:00:00' AND step_hours = 6)")
    with_gap = {r["issue_time"] for r in TS.asof_contexts(inst, positions(inst), 4, 2).collect()}
    without = {r["issue_time"] for r in TS.asof_contexts(inst, positions(inst), 4).collect()}
    assert ts("2017-01-09") in without and ts("2017-01-09") not in with_gap


def test_forecaster_checks_shape_and_keeps_lead_positions(spark):
    inst = instances(spark)
    jobs = TS.asof_contexts(inst, positions(inst), 4, 2)
    step_number = lambda ctx, cov, h: np.broadcast_to(np.arange(h, dtype=float)[None, :, None], (len(ctx), h, 3))
    got = TS.apply_forecaster(jobs, step_number, 3).collect()
    assert all(r["q"] == [r["step_hours"] / 6 + 2] * 3 for r in got)
    last = TS.apply_forecaster(jobs, step_number, 3, last_step_only=True).collect()
    want = {(r["station_id"], r["issue_time"]): (r["steps"][-1], r["obs"][-1], r["horizon"] - 1) for r in jobs.collect()}
    assert {(r["station_id"], r["issue_time"]): (r["step_hours"], r["obs"], r["q"][0]) for r in last} == want
    assert len(last) == len(want)
    with pytest.raises(PySparkException):
        TS.apply_forecaster(jobs, lambda c, x, h: np.zeros((len(c), h, 2)), 3).collect()


def test_rolling_pairs_equal_brute_force(spark):
    inst = instances(spark, 20)
    pairs = TS.rolling_pairs(inst, inst.select("issue_time"), [3, 7])
    got = {(r["window_days"], r["at"]): r["n"] for r in pairs.groupBy("window_days", "at").agg(F.count("*").alias("n")).collect()}
    pdf = inst.toPandas()
    for w in (3, 7):
        for t in pdf["issue_time"].unique():
            n = ((pdf.issue_time >= t - pd.Timedelta(days=w)) & (pdf.issue_time < t) & (pdf.valid_time < t)).sum()
            assert got.get((w, t.to_pydatetime()), 0) == n


def test_days_and_cases(spark):
    df = spark.createDataFrame([("7",), ("30",), ("full",)], "label string").withColumn("n", F.lit(4072))
    got = [r[0] for r in df.select(SM.k_for_label(F.col("label"), F.col("n"))).collect()]
    assert got == [round(7 / SM.DAYS_PER_CASE), round(30 / SM.DAYS_PER_CASE), 4072]
    back = spark.range(1, 300).select("id", SM.days_to_cases(SM.exact_days(F.col("id"))).alias("k"))
    assert back.where("id <> k").count() == 0


def cases(spark):
    return spark.createDataFrame([(0, 0, dt.date(2000, 1, 1)), (1, 0, dt.date(2001, 1, 1)), (0, 1, dt.date(2000, 6, 1)),
                                  (1, 1, dt.date(2001, 6, 1))], "year_idx int, time_idx int, case_date date")


def test_recent_and_random_cases(spark):
    got = SM.k_recent(cases(spark), 2).collect()
    assert {(r["year_idx"], r["time_idx"]) for r in got} == {(1, 0), (1, 1)}
    a, b = SM.k_random(cases(spark), 2, 1), SM.k_random(cases(spark), 2, 1)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect())) and a.count() == 2
    assert SM.k_random(cases(spark), 99, 1).count() == 4
    sets = SM.sweep_cases(cases(spark), [1, 3], [0, 1])
    sizes = {(r["arm"], r["seed"], r["k"]): r["count"] for r in sets.groupBy("arm", "seed", "k").count().collect()}
    assert sizes == {(a, s, k): k for a, s in (("contiguous", -1), ("random", 0), ("random", 1)) for k in (1, 3)}


def test_validation_split(spark):
    rows = spark.range(400).select((F.col("id") % 4).cast("int").alias("year_idx"), (F.col("id") % 10).cast("int").alias("time_idx"),
                                   F.col("id").alias("station_id"), F.lit(6.0).alias("step_hours"))
    out = SM.validation_split(rows)
    both = out.groupBy("year_idx", "time_idx").agg(F.countDistinct("is_val").alias("n"))
    assert both.where("n > 1").count() == 0
    n_cases = both.count()
    held = out.where("is_val").select("year_idx", "time_idx").distinct().count()
    assert held == max(1, round(0.1 * n_cases))
    assert SM.validation_split(rows.limit(100)).where("is_val").count() == 0
    by_row = SM.validation_split(rows.drop("year_idx"), row_key=["station_id"])
    assert by_row.where("is_val").count() == 40


def test_result_sink(spark, tmp_path):
    df = spark.range(3).toDF("x")
    a, b = storage.config_hash({"a": 1, "b": [2]}), storage.config_hash({"b": [2], "a": 1})
    assert a == b != storage.config_hash({"a": 2, "b": [2]}) and len(a) == 16
    out = str(tmp_path / "new" / "dir")
    storage.write_result(df, "t", "v1", {"a": 1}, out)
    table, meta = storage.read_result(spark, "t", out)
    row = meta.first()
    assert table.count() == 3 and row["model_version"] == "v1" and row["config_hash"] == storage.config_hash({"a": 1})
    with pytest.raises(PySparkException):
        storage.write_result(df, "t", "v1", {"a": 1}, out)


def test_stored_tables_use_the_shared_folder(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    stored = storage.materialise(spark.range(5))
    assert all(f.split("file://")[-1].startswith(folder.rstrip("/")) for f in stored.inputFiles())
    assert stored.count() == 5


def test_tables_of_rows_are_never_broadcast(spark, sf):
    # stored tables looked small by their bytes: 600 MB were broadcast on a copy of the events at 60 times sf0.1
    runs = I.context_runs(spark, sf)
    event_rows = I.event_instances(spark, sf)
    counted = TS.asof_positions(event_rows, I.freshest(spark, sf))
    plans = [counted, TS.asof_contexts(event_rows, counted, 4),
             P.matched(event_rows, runs), R.context_summary(runs, ["model", "context_steps"], 6),
             R.common_set_summary(runs, ["model", "context_steps"], 6)]
    for df in plans:
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
