"""Series operators: gaps, calendars, leak-free contexts, rolling windows."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foresift.operators.spread import row_sized, running_sum, trailing_lists
from foresift.sources.storage import materialise
from foresift.sources.tables import plus_hours

EPOCH = "1970-01-01"


def day_number(ts: str) -> Column:
    return F.datediff(F.to_date(ts), F.lit(EPOCH).cast("date"))


def slot_number(ts: str, hours: int) -> Column:
    return F.floor(F.timestamp_diff("HOUR", F.lit(EPOCH).cast("timestamp_ntz"), F.col(ts)) / hours)


def _grid(series: DataFrame, keys: list[str], ts: str, hours: int) -> DataFrame:
    ends = series.groupBy(*keys).agg(F.min(ts).alias("_lo"), F.max(ts).alias("_hi"))
    step = F.expr(f"INTERVAL {hours} HOURS")
    return ends.select(*keys, F.explode(F.sequence("_lo", "_hi", step)).alias(ts))


def detect_gaps(series: DataFrame, keys: list[str], hours: int, ts: str = "ts") -> DataFrame:
    """Grid times between the first and last time of each series that have no row."""
    return _grid(series, keys, ts, hours).join(series.select(*keys, ts), [*keys, ts], "left_anti")


def to_utc(df: DataFrame, ts: str, zone: str | Column | None) -> DataFrame:
    """Wall-clock times of a named zone (or of a zone column) as UTC; the zone is mandatory."""
    if zone is None:
        raise ValueError("the source time zone must be given; wall-clock times alone are ambiguous")
    source = zone if isinstance(zone, Column) else F.lit(zone)
    return df.withColumn(ts, F.convert_timezone(source, F.lit("UTC"), F.col(ts)))


def interpolate_gaps(series: DataFrame, keys: list[str], hours: int, ts: str = "ts",
                     value: str = "value") -> DataFrame:
    """Series on its full grid, inner gaps filled linearly; a missing first or last value is an error.

    Each known point carries its successor's slot and value, found inside month blocks plus the first point of the next
    non-empty block, and then fills the slots up to it. No window ever spans a whole series.
    """
    known = (series.where(F.col(value).isNotNull() & ~F.isnan(value))
             .select(*keys, F.col(ts).alias("_t0"), F.col(value).alias("_v0"), F.date_trunc("MONTH", ts).alias("_blk")))
    heads = known.groupBy(*keys, "_blk").agg(F.min(F.struct("_t0", "_v0")).alias("_head"))
    w_blocks = Window.partitionBy(*keys).orderBy("_blk")
    heads = heads.select(*keys, "_blk", F.lead("_head").over(w_blocks).alias("_next_head"))
    w_in = Window.partitionBy(*keys, "_blk").orderBy("_t0")
    nxt = F.coalesce(F.lead(F.struct("_t0", "_v0")).over(w_in), F.col("_next_head"))
    seg = known.join(heads, [*keys, "_blk"]).withColumn("_n", nxt)
    span = F.timestamp_diff("HOUR", F.col("_t0"), F.col("_n._t0")) / hours
    n_fill = F.greatest(F.coalesce(span.cast("int"), F.lit(1)), F.lit(1))
    rows = seg.withColumn("_i", F.explode(F.sequence(F.lit(0), n_fill - 1))).withColumn("_span", span)
    filled = F.when(F.col("_i") == 0, F.col("_v0")).otherwise(
        F.col("_v0") + (F.col("_n._v0") - F.col("_v0")) * F.col("_i") / F.col("_span"))
    out = rows.select(*keys, plus_hours(F.col("_t0"), F.col("_i") * hours).alias(ts), filled.alias(value))
    ends = series.groupBy(*keys).agg(
        F.min(ts).alias("_lo"), F.max(ts).alias("_hi"),
        F.min(F.when(F.col(value).isNotNull() & ~F.isnan(value), F.col(ts))).alias("_klo"),
        F.max(F.when(F.col(value).isNotNull() & ~F.isnan(value), F.col(ts))).alias("_khi"))
    bad = ends.where((F.col("_lo") != F.col("_klo")) | (F.col("_hi") != F.col("_khi")) | F.col("_klo").isNull())
    checked = bad.select(*keys, F.raise_error(F.lit("series starts or ends with a missing value"))
                         .cast("timestamp_ntz").alias(ts), F.lit(None).cast("double").alias(value))
    return out.unionByName(checked)


def daily_calendar(df: DataFrame, keys: list[str], columns: list[str], order: str,
                   issue: str = "issue_time") -> DataFrame:
    """Values on a complete daily calendar, NULL on missing days; the first row in `order` wins within a day."""
    daily = (df.withColumn("day", F.to_date(issue)).groupBy(*keys, "day")
             .agg(*[F.min_by(c, order).alias(c) for c in columns]))
    ends = daily.groupBy(*keys).agg(F.min("day").alias("_lo"), F.max("day").alias("_hi"))
    cal = ends.select(*keys, F.explode(F.sequence("_lo", "_hi")).alias("day"))
    return cal.join(daily, [*keys, "day"], "left")


def known_offset(lead: Column) -> Column:
    """Days between the issue day and the last day whose target is known."""
    return F.floor(lead / 24) + 1


def lead_matched(daily: DataFrame, keys: list[str], lead: str, window: int, y: str = "y", x: str = "x",
                 x2: str | None = None, day: str = "day", max_offset: int = 6, scored: DataFrame | None = None) -> DataFrame:
    """Instances of one context per (series, issue day): W known targets, W + k covariates, the scored target.

    With `scored` (keys and day) only the listed instances are returned; their contexts still come from all days.

    Offsets k take few values, so each gets one pair of frames. A frame is valid when it holds exactly as many non-null
    values as days; days without a row therefore need not be inserted.
    """
    clean = daily
    for c in [y, x] + ([x2] if x2 else []):
        clean = clean.withColumn(c, F.nanvl(F.col(c), F.lit(None).cast("double")))
    parts = None
    k_of = known_offset(F.col(lead)).cast("int")
    indexed = clean.withColumn("idx", F.datediff(F.col(day), F.lit(EPOCH).cast("date"))).withColumn(
        "horizon", F.when(k_of <= max_offset, k_of).otherwise(F.raise_error(F.lit("lead beyond max_offset"))))
    for k in range(1, max_offset + 1):
        frames = {"context": (y, -(k + window - 1), -k), "covariate": (x, -(k + window - 1), 0)}
        if x2:
            frames["covariate2"] = (x2, -(k + window - 1), 0)
        got = trailing_lists(indexed.where(F.col("horizon") == k), keys, "idx", frames)
        ok = (F.size("context") == window) & (F.size("covariate") == window + k) & F.col(y).isNotNull()
        if x2:
            ok = ok & (F.size("covariate2") == window + k)
        got = got.where(ok)
        if scored is not None:
            got = got.join(scored.select(*keys, day), [*keys, day], "left_semi")
        parts = got if parts is None else parts.unionByName(got)
    return parts.withColumnRenamed(y, "obs")


def lead_matched_jobs(matched: DataFrame, lead: str = "step_hours", day: str = "day") -> DataFrame:
    """Lead-matched instances as forecaster jobs of one lead, whose value is the last step: the offset is the horizon.

    Covariates keep the days that a job of this context and horizon has; a second channel is stacked below the first.
    """
    channels = [F.col(c) for c in ("covariate", "covariate2") if c in matched.columns]
    return matched.select("station_id", F.col(day).cast("timestamp_ntz").alias("issue_time"), "context",
                          (F.array(*channels) if len(channels) > 1 else channels[0]).alias("covariate"), "horizon",
                          F.array(F.col(lead).cast("double")).alias("steps"), F.array(F.col("horizon") - 1).alias("lead_pos"),
                          F.array("obs").alias("obs"))


def freshest(members: DataFrame, keys: list[str] = ("station_id", "valid_time"), forecast: str = "t2m_forecast",
             spread: bool = False) -> DataFrame:
    """Ensemble mean (and spread) at the shortest lead available for each valid time.

    Aggregated per lead first, then reduced with min_by: two combinable aggregates instead of a window.
    """
    per_lead = members.groupBy(*keys, "step_hours").agg(
        F.avg(forecast).alias("m"), F.stddev_samp(forecast).alias("s"))
    pick = per_lead.groupBy(*keys).agg(F.min_by(F.struct("m", "s"), "step_hours").alias("_f"),
                                       F.min("step_hours").alias("freshest_step"))
    out = pick.select(*keys, "freshest_step", F.col("_f.m").alias("x"), F.col("_f.s").alias("x_sd"))
    return out if spread else out.drop("x_sd")


def observed_series(instances: DataFrame) -> DataFrame:
    """One observation per station and valid time, from the shortest lead."""
    return instances.groupBy("station_id", "valid_time").agg(F.min_by("t2m_obs", "step_hours").alias("y"))


def asof_positions(instances: DataFrame, covariate: DataFrame) -> DataFrame:
    """Observations and issue times of each station on one axis, with the number of observations up to them.

    The count runs over the merged events, cut into days: the as-of match becomes an equi-join on (station, position).
    Context jobs of any length start from this table, so it is worth storing.
    """
    series = observed_series(instances).join(row_sized(covariate), ["station_id", "valid_time"], "left")
    cols = ["y", "x"] + (["x_sd"] if "x_sd" in covariate.columns else [])
    null = F.lit(None).cast("double")
    obs_ev = series.select("station_id", F.col("valid_time").alias("at"), F.lit(1).alias("is_obs"),
                           *[F.nanvl(F.col(c), null).alias(c) for c in cols])
    issues = instances.select("station_id", F.col("issue_time").alias("at")).distinct()
    issue_ev = issues.select("station_id", "at", F.lit(0).alias("is_obs"), *[null.alias(c) for c in cols])
    # issues sort before observations of the same time: only strictly earlier observations count
    return running_sum(obs_ev.unionByName(issue_ev), ["station_id"], F.to_date("at"),
                       [F.col("at"), F.col("is_obs")], F.col("is_obs"), "n_before")


def asof_contexts(instances: DataFrame, counted: DataFrame, length: int, gap: int = 0, step: int = 6,
                  use_covariate: bool = True, two_channel: bool = False) -> DataFrame:
    """Forecast jobs per (station, issue time): the last `length` observations before the issue time, by row position.

    `counted` comes from `asof_positions`. With a gap the context ends `gap` rows earlier, the covariate stays complete,
    and lead l maps to step l / 6 + gap, which needs the complete lead grid.
    """
    frames = {"context": ("y", -(gap + length - 1), -gap), "past": ("x", -(gap + length - 1), 0)}
    if two_channel:
        frames["past_sd"] = ("x_sd", -(gap + length - 1), 0)
    ends = trailing_lists(counted.where("is_obs = 1").withColumn("pos", F.col("n_before")), ["station_id"], "pos",
                          frames)
    ends = ends.select("station_id", "pos", *frames)
    starts = (counted.where("is_obs = 0").where(F.col("n_before") >= length + gap)
              .select("station_id", F.col("at").alias("issue_time"), F.col("n_before").alias("pos")))
    lead_cols = [F.col("step_hours"), F.col("ens_mean"), F.col("t2m_obs")]
    if two_channel:
        lead_cols.append(F.sqrt("ens_var").alias("ens_sd"))
    # leads of one issue are a bounded set (one entry per forecast step)
    future = (instances.groupBy("station_id", "issue_time")
              .agg(F.array_sort(F.collect_list(F.struct(*lead_cols))).alias("leads")))
    jobs = starts.join(row_sized(ends), ["station_id", "pos"]).join(row_sized(future), ["station_id", "issue_time"])
    jobs = jobs.where(F.size("past") == length + gap).where(F.size("context") == length)
    steps = F.col("leads.step_hours")
    n = F.size("leads")
    if gap:
        grid = F.transform(F.sequence(F.lit(0), n - 1), lambda i: (i * step).cast("double"))
        jobs = jobs.where(steps == grid)
    out = [F.col("station_id"), F.col("issue_time"), F.col("context")]
    if use_covariate:
        if two_channel:
            jobs = jobs.where(F.size("past_sd") == length + gap).where(
                ~F.exists("leads.ens_sd", lambda v: v.isNull()))
            out.append(F.array(F.concat("past", F.col("leads.ens_mean")),
                               F.concat("past_sd", F.col("leads.ens_sd"))).alias("covariate"))
        else:
            out.append(F.concat("past", F.col("leads.ens_mean")).alias("covariate"))
    return jobs.select(*out, (n + gap).alias("horizon"), steps.alias("steps"),
                       F.transform(F.sequence(F.lit(0), n - 1), lambda i: i + gap).alias("lead_pos"),
                       F.col("leads.t2m_obs").alias("obs"))


def window_fits(history: DataFrame, issues: DataFrame, windows: list[int]) -> DataFrame:
    """at, window_days, fit_days: all windows of an issue that reach back to the first row of the history hold the same rows,
    and the shortest of them, `fit_days`, stands for all."""
    first = history.agg(F.min("issue_time")).first()[0]
    sizes = F.array(*[F.lit(w) for w in sorted(windows)])
    whole = F.array_min(F.filter(sizes, lambda w: F.timestamp_add("DAY", -w, F.col("at")) <= F.lit(first)))
    asked = issues.select(F.col("issue_time").alias("at")).distinct().withColumn("window_days", F.explode(sizes))
    return asked.withColumn("fit_days", F.least("window_days", whole))


def rolling_pairs(history: DataFrame, issues: DataFrame, windows: list[int], keys: list[str] = ()) -> DataFrame:
    """(window, issue, history row) with issue - W <= row's issue < issue and the row verified before the issue.

    `issues` has an issue_time for all windows, or `at` and `window_days` for the pairs that are wanted. A range join made an
    equi-join: issues and rows are cut into blocks of W days, each issue looks at the two blocks its window can touch, and the
    exact bounds are applied afterwards.
    """
    sizes = F.array(*[F.lit(w) for w in windows])
    rows = (history.withColumn("window_days", F.explode(sizes))
            .withColumn("_blk", F.floor(day_number("issue_time") / F.col("window_days"))))
    if "window_days" not in issues.columns:
        issues = issues.select(*keys, F.col("issue_time").alias("at")).distinct().withColumn("window_days", F.explode(sizes))
    at = F.floor(day_number("at") / F.col("window_days"))
    # one row per issue time, window and block: stored, so that its size is known when the join is planned
    targets = materialise(issues.select(*keys, "at", "window_days").withColumn("_blk", F.explode(F.array(at - 1, at))))
    lower = F.timestamp_add("DAY", -F.col("window_days"), F.col("at"))
    return (rows.join(targets, [*keys, "window_days", "_blk"])
            .where((F.col("issue_time") >= lower) & (F.col("issue_time") < F.col("at"))
                   & (F.col("valid_time") < F.col("at")))
            .drop("_blk"))


PREDICTION_SCHEMA = T.StructType([
    T.StructField("station_id", T.LongType()), T.StructField("issue_time", T.TimestampNTZType()),
    T.StructField("step_hours", T.DoubleType()), T.StructField("obs", T.DoubleType()),
    T.StructField("q", T.ArrayType(T.DoubleType()))])


def apply_forecaster(jobs: DataFrame, forecaster, n_levels: int, last_step_only: bool = False) -> DataFrame:
    """Runs a batched forecaster over context jobs and re-emits one row per lead.

    `forecaster(contexts, covariates, horizon)` gets the jobs of one Arrow batch that share a horizon and returns an array
    (jobs, horizon, levels). Batches are processed where they lie; no shuffle is needed.
    """
    import numpy as np
    has_cov = "covariate" in jobs.columns
    wide = jobs.select("station_id", "issue_time", "context", *(["covariate"] if has_cov else []), "horizon",
                       "steps", "lead_pos", "obs")
    def run(batches):
        for pdf in batches:
            for horizon, part in pdf.groupby("horizon", sort=True):
                ctx = np.stack(part["context"].to_list())
                cov = [np.asarray(c.tolist(), dtype=float) for c in part["covariate"]] if has_cov else None
                pred = np.asarray(forecaster(ctx, cov, int(horizon)), dtype=float)
                if pred.shape != (len(part), horizon, n_levels):
                    raise ValueError(f"forecaster returned shape {pred.shape}")
                # one output row per lead, or for the last lead alone
                leads = [slice(-1, None) if last_step_only else slice(None)] * len(part)
                steps, obs, pos = ([np.asarray(v)[s] for v, s in zip(part[c], leads)] for c in ("steps", "obs", "lead_pos"))
                job = np.repeat(np.arange(len(part)), [len(s) for s in steps])
                at = np.full(len(job), int(horizon) - 1) if last_step_only else np.concatenate(pos).astype(int)
                out = part[["station_id", "issue_time"]].iloc[job].reset_index(drop=True)
                out["step_hours"] = np.concatenate(steps).astype(float)
                out["obs"] = np.concatenate(obs).astype(float)
                out["q"] = list(pred[job, at])
                yield out

    return wide.mapInPandas(run, PREDICTION_SCHEMA).withColumn(
        "valid_time", plus_hours(F.col("issue_time"), F.col("step_hours")))


def persistence_forecaster(n_levels: int):
    """Repeats the last observed value over all steps and levels."""
    def run(contexts, covariates, horizon):
        import numpy as np
        return np.repeat(np.repeat(contexts[:, -1:, None], horizon, axis=1), n_levels, axis=2)
    return run


def sensitivity_check(base: DataFrame, variants: dict[str, DataFrame], keys: list[str],
                      threshold: float = 1e-3) -> DataFrame:
    """Mean absolute prediction change of each variant per series, its maximum, and whether it passes the threshold."""
    out = None
    for name, df in variants.items():
        other = df.select(*keys, F.col("q").alias("_q"))
        both = base.select(*keys, "q").join(other, keys)
        change = F.expr("aggregate(zip_with(q, _q, (a, b) -> abs(a - b)), 0D, (s, v) -> s + v) / size(q)")
        per_series = both.groupBy(keys[0]).agg(F.avg(change).alias("d"))
        row = per_series.agg(F.max("d").alias("max_mean_change"), F.count(F.lit(1)).alias("n_series")).withColumn(
            "variant", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out.withColumn("passes", F.col("max_mean_change") > threshold)
