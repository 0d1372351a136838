"""Panel building: from ensemble members and observations to training and test tables."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foresift.functions import scores as S
from foresift.operators.spread import grouped_quantiles, position, row_sized
from foresift.sources.tables import KEY

# Lead buckets (both bounds inclusive), their half-open form, and the meteorological seasons.
BUCKETS = {"0-24h": (0, 24), "24-72h": (30, 72), "72-120h": (78, 120)}
HALF_OPEN_BUCKETS = {"0-24h": (0, 24), "24-72h": (24, 72), "72-120h": (72, 120)}
SEASONS = {"DJF": (12, 1, 2), "MAM": (3, 4, 5), "JJA": (6, 7, 8), "SON": (9, 10, 11)}


def null_if_nan(c: Column) -> Column:
    return F.nanvl(c, F.lit(None).cast("double"))


def explode_members(cube: DataFrame, members: str = "members", out: str = "t2m_forecast") -> DataFrame:
    """One row per member of an array column; NaN becomes NULL."""
    return (cube.select(*[c for c in cube.columns if c != members], F.posexplode(members).alias("member", out))
            .withColumn(out, null_if_nan(F.col(out))))


def ensemble_stats(members: DataFrame, keys: list[str], forecast: str = "t2m_forecast", extra=()) -> DataFrame:
    """Mean, variance (ddof 1) and size of each ensemble, with further aggregates."""
    return members.groupBy(*keys).agg(
        F.avg(forecast).alias("ens_mean"), F.var_samp(forecast).alias("ens_var"),
        F.count(forecast).alias("n_members"), *extra)


def first_in_order(value: str, order: str) -> Column:
    """Value of the first row, in explicit order, that has one."""
    return F.min_by(value, F.when(F.col(value).isNotNull(), F.col(order)))


def nonoverlapping_cases(rows: DataFrame, cutoff: str) -> DataFrame:
    """Cases (year_idx, time_idx) whose last valid time is strictly before the test period, with their date."""
    return (rows.groupBy("year_idx", "time_idx")
            .agg(F.max("valid_time").alias("last_valid"), F.to_date(F.min("valid_time")).alias("case_date"))
            .where(F.col("last_valid") < F.lit(cutoff).cast("timestamp_ntz")))


def training_panel(stats: DataFrame, obs: DataFrame, cases: DataFrame, shape: str = "lead") -> DataFrame:
    """Statistics joined to observations and kept cases, nulls dropped.

    shape: "stats" (4 columns), "cases" (with case ids, the lead column dropped), "lead" (with ids and lead).
    """
    columns = {"stats": ["station_id"],
               "cases": ["station_id", "time_idx", "year_idx", "case_date"],
               "lead": ["station_id", "time_idx", "year_idx", "case_date", "step_hours"]}[shape]
    joined = (stats.join(obs, ["station_id", "year_idx", "time_idx", "step_hours"])
              .join(cases.select("year_idx", "time_idx", "case_date"), ["year_idx", "time_idx"]))
    return joined.select(*columns, "ens_mean", "ens_var", "t2m_obs").dropna(subset=["ens_mean", "ens_var", "t2m_obs"])


def long_test_table(members: DataFrame, obs: DataFrame) -> DataFrame:
    """One row per member with its observation. Without a `valid_time` column the issue column stands in for it."""
    if "valid_time" not in members.columns:
        members = members.withColumnRenamed("time", "valid_time")
    return (members.join(obs, KEY, "left")
            .select("station_id", "valid_time", "step_hours", "member", "t2m_forecast", "t2m_obs")
            .dropna(subset=["t2m_forecast", "t2m_obs"]))


def with_issue_time(df: DataFrame) -> DataFrame:
    issue = F.timestamp_add("HOUR", (-F.col("step_hours")).cast("bigint"), F.col("valid_time"))
    return df.withColumn("issue_time", issue).withColumn("issue_date", F.to_date("issue_time"))


def season(month: Column) -> Column:
    out = F.raise_error(F.lit("month outside 1-12"))
    for name, months in SEASONS.items():
        out = F.when(month.isin(*months), F.lit(name)).otherwise(out)
    return out


def lookup_dates(df: DataFrame, index_col: str, dates: DataFrame, out: str = "case_date") -> DataFrame:
    """Date at a 0-based position of a one-row table with an array `dates`; date columns pass through."""
    if df.schema[index_col].dataType.typeName() in ("date", "timestamp", "timestamp_ntz"):
        return df.withColumn(out, F.col(index_col))
    table = dates.select(F.posexplode("dates").alias(index_col, out))
    return df.join(table, index_col)


def lead_bucket(step: Column, half_open: bool = False) -> Column:
    out = F.lit(None).cast("string")
    for i, (name, (lo, hi)) in enumerate((HALF_OPEN_BUCKETS if half_open else BUCKETS).items()):
        above = (step > lo) | ((step == 0) if i == 0 else F.lit(False)) if half_open else step >= lo
        out = F.when(above & (step <= hi), F.lit(name)).otherwise(out)
    return out


def matched(df: DataFrame, reference: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """Rows whose key occurs in the reference set."""
    return df.join(row_sized(reference.select(*keys)), keys, "left_semi")


def match_report(df: DataFrame, reference: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """Counts of the reference set and of its covered part, for the complete-coverage check."""
    ref = reference.select(*keys).distinct()
    have = df.select(*keys).distinct().withColumn("_have", F.lit(1))
    return (ref.join(have, keys, "left")
            .agg(F.count(F.lit(1)).alias("n_reference"), F.count("_have").alias("n_covered"))
            .withColumn("complete", F.col("n_reference") == F.col("n_covered")))


def key_set_report(predictions: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """Whether all methods share exactly the same keys."""
    per_key = predictions.select(*keys, "method").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("m"))
    per_count = per_key.groupBy("m").agg(F.count(F.lit(1)).alias("n_keys"))
    return per_count.agg(F.sum("n_keys").alias("n_keys"), F.min("m").alias("min_methods"),
                         F.max("m").alias("max_methods")).withColumn(
        "identical", F.col("min_methods") == F.col("max_methods"))


def common_keys(runs: DataFrame, run_cols: list[str], n_runs: int, keys: list[str] = KEY) -> DataFrame:
    """Keys present in every one of `n_runs` runs."""
    return (runs.select(*keys, *run_cols).distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("_runs"))
            .where(F.col("_runs") == n_runs).drop("_runs"))


def latest_per(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """Last row per key in `order`, as an aggregate: map-side combined, so a hot key does not gather its rows."""
    rest = [c for c in df.columns if c not in keys]
    return (df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r"))
            .select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest]))


def align(instances: DataFrame, predictions: DataFrame, keys: list[str] = KEY, strict: bool = True) -> DataFrame:
    """Predictions placed on the instance keys; a missing one is an error in strict mode."""
    out = instances.join(predictions.select(*keys, F.col("q").alias("_q")), keys, "left")
    q = F.col("_q")
    if strict:
        q = F.coalesce(q, F.raise_error(F.lit("prediction missing for a matched instance")).cast("array<double>"))
    return out.withColumn("q", q).drop("_q")


def common_mask(instances: DataFrame, runs: DataFrame, run_cols: list[str], common: DataFrame) -> DataFrame:
    """Per run and instance: has a prediction and belongs to the common key set."""
    return (runs.join(instances.select(*KEY), KEY, "left_semi")
            .join(common.withColumn("_common", F.lit(True)), KEY, "left")
            .select(*run_cols, *KEY, F.coalesce("_common", F.lit(False)).alias("in_common")))


def season_counts(train: DataFrame) -> DataFrame:
    """Labels, cases, rows, date range and observation spread of the training rows of each season."""
    labelled = train.withColumn("season", season(F.month("case_date")))
    rows = labelled.groupBy("season").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("case_date").alias("first_date"), F.max("case_date").alias("last_date"),
        F.avg("t2m_obs").alias("obs_mean"), F.stddev_samp("t2m_obs").alias("obs_std"))
    cases = (labelled.select("season", "year_idx", "time_idx").distinct().groupBy("season")
             .agg(F.count(F.lit(1)).alias("n_cases"), F.countDistinct("time_idx").alias("n_labels")))
    return rows.join(cases, "season")


def test_season_counts(test: DataFrame) -> DataFrame:
    days = with_issue_time(test).withColumn("season", season(F.month("issue_date")))
    per_day = days.groupBy("season", "issue_date").agg(F.count(F.lit(1)).alias("n"))
    return per_day.groupBy("season").agg(F.count(F.lit(1)).alias("n_issue_dates"), F.sum("n").alias("n_instances"))


def flag_used_stations(stations: DataFrame, test: DataFrame) -> DataFrame:
    used = test.select("station_id").distinct().withColumn("_used", F.lit(True))
    return (stations.join(used, "station_id", "left")
            .withColumn("used_in_study", F.coalesce("_used", F.lit(False))).drop("_used"))


def station_extent(stations: DataFrame, high: float = 500.0) -> DataFrame:
    """Extent of the used stations; names of the unused ones."""
    used = F.col("used_in_study")
    alt = F.when(used, F.col("station_altitude"))
    summary = stations.agg(
        F.count(F.when(used, 1)).alias("n_used"),
        F.min(F.when(used, F.col("station_latitude"))).alias("lat_min"),
        F.max(F.when(used, F.col("station_latitude"))).alias("lat_max"),
        F.min(F.when(used, F.col("station_longitude"))).alias("lon_min"),
        F.max(F.when(used, F.col("station_longitude"))).alias("lon_max"),
        F.min(alt).alias("alt_min"), F.max(alt).alias("alt_max"),
        F.max_by("station_name", alt).alias("highest"),
        F.count(F.when(alt > high, 1)).alias("n_high"))
    half = grouped_quantiles(stations.where(used).withColumn("_all", F.lit(1)), ["_all"], "station_altitude", [0.5])
    return summary.crossJoin(F.broadcast(half.select(F.col("q")[0].alias("alt_median"))))   # one row each


def first_stations(df: DataFrame, n: int) -> DataFrame:
    """Rows of the first n stations in id order; the n smallest ids come from a bounded top-k."""
    ids = df.select("station_id").distinct().orderBy("station_id").limit(n)
    return df.join(ids, "station_id", "left_semi")


def every_nth_issue(df: DataFrame, series: list[str], n: int) -> DataFrame:
    """Every n-th issue of each series, by position."""
    pos = position(df, series, F.date_trunc("MONTH", F.col("issue_time")), [F.col("issue_time")], "_pos")
    return pos.where(F.pmod(F.col("_pos"), F.lit(n)) == 0).drop("_pos")


def upsert_by_method(old: DataFrame, new: DataFrame, methods: list[str]) -> DataFrame:
    """Replaces all rows of the given methods; the column order of `old` is kept and schemas must agree."""
    if sorted(old.columns) != sorted(new.columns):
        raise ValueError("both tables must have the same columns")
    return old.where(~F.col("method").isin(methods)).unionByName(new)


def union_complete(runs: dict[str, DataFrame | None], reference: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """Union of the runs that exist and cover every reference key; others are skipped."""
    present = [df.withColumn("run", F.lit(name)) for name, df in runs.items() if df is not None]
    everything = reduce(DataFrame.unionByName, present)
    hits = matched(everything, reference, keys)
    n_ref = reference.select(*keys).distinct().agg(F.count(F.lit(1)).alias("_n_ref"))
    complete = (hits.select("run", *keys).distinct().groupBy("run").agg(F.count(F.lit(1)).alias("_n"))
                .crossJoin(F.broadcast(n_ref)).where(F.col("_n") == F.col("_n_ref")).select("run"))
    return hits.join(complete, "run", "left_semi")


def quantile_columns(df: DataFrame, levels=S.LEVELS) -> DataFrame:
    """Wide form with columns q10 ... q90."""
    return df.select(*[c for c in df.columns if c != "q"],
                     *[F.col("q")[i].alias(f"q{round(100 * t)}") for i, t in enumerate(levels)])
