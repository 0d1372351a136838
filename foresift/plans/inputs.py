"""Shared inputs of the registered queries."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foresift.functions.scores import LEVELS, crps
from foresift.operators import baselines as B
from foresift.operators import panel as P
from foresift.operators import timeseries as TS
from foresift.operators.emos import gaussian_quantiles
from foresift.operators.spread import largest_group
from foresift.sources import tables as T
from foresift.sources.storage import materialise

KEY = T.KEY
CONTEXTS = (4, 8, 16)

# Inputs built once per session and folder, as stored tables: panels, prediction tables, run tables.
_STORED: dict[tuple, object] = {}


def stored(spark: SparkSession, sf: str, name: str, build):
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _STORED:
        got = build()
        _STORED[key] = materialise(got) if isinstance(got, DataFrame) else got
    return _STORED[key]


def forget() -> None:
    """Drops the built inputs, so that the next query builds its own."""
    _STORED.clear()


def largest_ensemble(spark: SparkSession, sf: str) -> int:
    """Checked once: the size of the largest archive ensemble, or a bound of it, decides how quantiles are computed."""
    return stored(spark, sf, "largest", lambda: largest_group(T.archive_members(spark, sf), T.KEY, ["station_id"]))


def cells(spark: SparkSession, sf: str, levels=(), since: str | None = None, before: str | None = None) -> DataFrame:
    """Archive cells: statistics and observation, optionally the ensemble quantiles, in one grouping."""
    members = T.archive_members(spark, sf, since, before)
    obs = P.first_in_order("verifying", "member_order").alias("t2m_obs")
    if not levels:
        return P.ensemble_stats(members, T.CELL, extra=[obs])
    stats = [F.avg("t2m_forecast").alias("ens_mean"), F.var_samp("t2m_forecast").alias("ens_var"),
             F.count("t2m_forecast").alias("n_members"), obs]
    return B.raw_quantiles(members, T.CELL, levels, stats, "raw_q", largest_ensemble(spark, sf))


def instances(spark: SparkSession, sf: str, levels=(), since: str | None = None, before: str | None = None) -> DataFrame:
    return cells(spark, sf, levels, since, before).dropna(subset=["ens_var", "t2m_obs"])


def cases(spark: SparkSession, sf: str, cutoff: str = T.TEST_START) -> DataFrame:
    return P.nonoverlapping_cases(T.archive_members(spark, sf), cutoff)


def train(spark: SparkSession, sf: str) -> DataFrame:
    """Training panel. A case is one month here, so its dates follow from its rows and no join is needed."""
    return stored(spark, sf, "train", lambda: _train(spark, sf))


def _train(spark, sf):
    rows = instances(spark, sf, before=T.TEST_START)
    return rows.withColumn("case_date", F.to_date("issue_time"))


def test(spark: SparkSession, sf: str, levels=()) -> DataFrame:
    """Test panel with the raw ensemble quantiles (`raw_q`) next to the statistics."""
    return stored(spark, sf, "test", lambda: instances(spark, sf, LEVELS, since=T.TEST_START))


METHODS = ("raw_ensemble", "gaussian_ensemble", "inflation_fixed", "inflation_fitted", "climatology")


def predictions(spark: SparkSession, sf: str, methods=METHODS) -> DataFrame:
    """Prediction table of the closed-form methods, stored once; a subset of methods is a pushed-down filter."""
    table = stored(spark, sf, "predictions", lambda: _predictions(spark, sf, METHODS))
    return table if tuple(methods) == METHODS else table.where(F.col("method").isin(*methods))


def _quantiles_beside(spark, sf, methods):
    """The test panel with what the methods need, and the quantile array of each method as a column of it."""
    te = test(spark, sf, LEVELS if "raw_ensemble" in methods else ())
    tr = train(spark, sf)
    if "inflation_fitted" in methods:
        te = te.crossJoin(F.broadcast(B.fit_inflation(tr).select("multiplier")))      # one row
    if "climatology" in methods:
        te = te.crossJoin(F.broadcast(B.climatology(tr).withColumnRenamed("q", "clim_q")))     # one row
    options = {"raw_ensemble": lambda: F.col("raw_q"),
               "gaussian_ensemble": lambda: gaussian_quantiles("ens_mean", "sqrt(ens_var)"),
               "inflation_fixed": lambda: gaussian_quantiles("ens_mean", f"{B.LAMBDA_CLIM}D*sqrt(ens_var)"),
               "inflation_fitted": lambda: gaussian_quantiles("ens_mean", "multiplier*sqrt(ens_var)"),
               "climatology": lambda: F.col("clim_q")}
    return te, {m: options[m]() for m in methods}


def losses(spark: SparkSession, sf: str, reference: str) -> DataFrame:
    """CRPS of each method next to that of the reference (`ref`) on the same instance, stored once.

    All methods of an instance are scored beside each other, so no score has to be shuffled to that of the reference.
    """
    return stored(spark, sf, f"losses-{reference}", lambda: _losses(spark, sf, reference))


def _losses(spark, sf, reference):
    te, q = _quantiles_beside(spark, sf, METHODS)
    te = te.select(*KEY, "t2m_obs", *[q[m].alias(f"_q_{m}") for m in METHODS])
    scored = te.select(*KEY, *[crps("t2m_obs", f"_q_{m}").alias(f"_c_{m}") for m in METHODS])
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.col(f"_c_{m}").alias("crps")) for m in METHODS if m != reference]))
    return scored.select(*KEY, F.col(f"_c_{reference}").alias("ref"), each.alias("_p")).select("_p.method", *KEY, "_p.crps", "ref")


def _predictions(spark, sf, methods):
    """All quantile arrays are computed next to each other from one scan of the test panel."""
    te, q = _quantiles_beside(spark, sf, methods)
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("method"), q[m].alias("q")) for m in methods]))
    return te.select(*KEY, F.col("t2m_obs").alias("obs"), each.alias("_p")).select(
        "_p.method", *KEY, "obs", "_p.q")


# ---- operational stream -------------------------------------------------------------------------------------------------
def event_cells(spark: SparkSession, sf: str) -> DataFrame:
    members = T.event_members(spark, sf)
    return P.ensemble_stats(members, ["station_id", "issue_time", "step_hours", "valid_time"],
                            extra=[F.min_by("t2m_forecast", "member_order").alias("t2m_obs")])


def event_instances(spark: SparkSession, sf: str) -> DataFrame:
    return stored(spark, sf, "event_instances", lambda: event_cells(spark, sf).dropna(subset=["ens_var", "t2m_obs"]))


def freshest(spark: SparkSession, sf: str, spread: bool = False) -> DataFrame:
    table = stored(spark, sf, "freshest", lambda: TS.freshest(T.event_members(spark, sf), spread=True))
    return table if spread else table.drop("x_sd")


def context_jobs(spark: SparkSession, sf: str, length: int, **kw) -> DataFrame:
    ei = event_instances(spark, sf)
    counted = stored(spark, sf, "positions", lambda: TS.asof_positions(
        ei, freshest(spark, sf, True).drop("freshest_step")))
    return TS.asof_contexts(ei, counted, length, **kw)


def array_quantiles(sorted_values: str, size: int, levels=LEVELS) -> Column:
    """Linear quantiles of a sorted array of known length."""
    out = []
    for t in levels:
        h = t * (size - 1)
        lo = min(int(h), size - 1)
        hi = min(lo + 1, size - 1)
        s = sorted_values
        out.append(f"{s}[{lo}] + {h - lo!r}D*({s}[{hi}] - {s}[{lo}])")
    return F.expr(f"array({', '.join(out)})")


def job_rows(jobs: DataFrame) -> DataFrame:
    z = jobs.withColumn("_z", F.explode(F.arrays_zip("steps", "obs")))
    return z.select("station_id", "issue_time", T.plus_hours(F.col("issue_time"), F.col("_z.steps")).alias("valid_time"),
                    F.col("_z.steps").alias("step_hours"), F.col("_z.obs").alias("obs"), "context")


def context_runs(spark: SparkSession, sf: str, lengths=CONTEXTS) -> DataFrame:
    """Two forecasters (climatology of the context, persistence) for several context lengths."""
    table = stored(spark, sf, "context_runs", lambda: _context_runs(spark, sf, CONTEXTS))
    return table if tuple(lengths) == CONTEXTS else table.where(F.col("context_steps").isin(*lengths))


def _context_runs(spark, sf, lengths):
    parts = []
    for n in lengths:
        rows = job_rows(context_jobs(spark, sf, n)).withColumn("sorted", F.array_sort("context"))
        both = F.explode(F.array(
            F.struct(F.lit("context_climatology").alias("model"), array_quantiles("sorted", n).alias("q")),
            F.struct(F.lit("persistence").alias("model"),
                     F.array_repeat(F.element_at("context", -1), len(LEVELS)).alias("q"))))
        parts.append(rows.withColumn("_m", both).select(
            "_m.model", F.lit(n).alias("context_steps"), *KEY, "obs", "_m.q"))
    return reduce(DataFrame.unionByName, parts)


def gap_runs(spark: SparkSession, sf: str, length: int = 8, gap: int = 4) -> DataFrame:
    return stored(spark, sf, "gap_runs", lambda: _gap_runs(spark, sf, length, gap))


def _gap_runs(spark, sf, length, gap):
    parts = []
    for name, g in (("nogap", 0), (f"gap{gap}", gap)):
        rows = job_rows(context_jobs(spark, sf, length, gap=g)).withColumn("sorted", F.array_sort("context"))
        parts.append(rows.select(F.lit("context_climatology").alias("model"), F.lit(name).alias("variant"), *KEY, "obs",
                                 array_quantiles("sorted", length).alias("q")))
    return reduce(DataFrame.unionByName, parts)


def daily(spark: SparkSession, sf: str) -> DataFrame:
    ei = event_instances(spark, sf)
    return ei.select("station_id", "step_hours", F.to_date("issue_time").alias("day"), F.col("t2m_obs").alias("y"),
                     F.col("ens_mean").alias("x"), F.sqrt("ens_var").alias("x_sd"))


def lead_matched_runs(spark: SparkSession, sf: str, windows=(5, 10)) -> DataFrame:
    parts = []
    for w in windows:
        got = TS.lead_matched(daily(spark, sf), ["station_id", "step_hours"], "step_hours", w, max_offset=2)
        got = got.withColumn("sorted", F.array_sort("context"))
        valid = T.plus_hours(F.col("day").cast("timestamp_ntz"), F.col("step_hours"))
        parts.append(got.select(F.lit("lead_matched").alias("model"), F.lit(w).alias("window"), "station_id",
                                valid.alias("valid_time"), "step_hours", "obs",
                                array_quantiles("sorted", w).alias("q")))
    return reduce(DataFrame.unionByName, parts)
