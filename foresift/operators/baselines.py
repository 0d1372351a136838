"""Baseline models in closed form: climatology, raw ensemble, persistence, variance inflation."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foresift.functions import scores as S
from foresift.functions.normal import z_values
from foresift.operators.emos import gaussian_quantiles
from foresift.operators.spread import grouped_quantiles, split_quantiles

# Climatological inflation factor, coverage bracket, and the grid of the inflation curve.
LAMBDA_CLIM = 1.5
COVERAGE_BRACKET = (0.1, 10.0)
CURVE_STEPS = (50, 300, 5)      # hundredths


def climatology(train: DataFrame, levels=S.LEVELS, obs: str = "t2m_obs") -> DataFrame:
    """One row with the empirical quantiles of all training observations, found without gathering them."""
    return split_quantiles(train, [], obs, levels)


def apply_constant(test: DataFrame, model: DataFrame) -> DataFrame:
    return test.crossJoin(F.broadcast(model))     # the model is one row


def raw_quantiles(members: DataFrame, keys: list[str], levels=S.LEVELS, extra=(), out: str = "q",
                  largest: int | None = None) -> DataFrame:
    """Ensemble quantiles per key; `largest` is the checked largest ensemble, if known."""
    return grouped_quantiles(members, keys, "t2m_forecast", levels, out, extra, largest=largest)


def persistence(jobs: DataFrame, n_levels: int = len(S.LEVELS)) -> DataFrame:
    """Last value of the context for every lead and level, as one row per lead."""
    last = F.element_at("context", -1)
    z = jobs.withColumn("_z", F.explode(F.arrays_zip("steps", "obs")))
    return z.select("station_id", "issue_time", F.col("_z.steps").alias("step_hours"), F.col("_z.obs").alias("obs"),
                    F.array_repeat(last, n_levels).alias("q"))


def fit_inflation(train: DataFrame, keys: list[str] = ()) -> DataFrame:
    err = F.col("t2m_obs") - F.col("ens_mean")
    return train.groupBy(*keys).agg(F.sqrt(F.avg(err * err) / F.avg("ens_var")).alias("multiplier"),
                                    F.count(F.lit(1)).alias("n_rows"))


def fixed_inflation(df: DataFrame, multiplier: float = LAMBDA_CLIM) -> DataFrame:
    return df.sparkSession.range(1).select(F.lit(multiplier).alias("multiplier"))


def coverage_inflation(train: DataFrame, target: float, band=S.BAND) -> DataFrame:
    """Multiplier whose training coverage of the band is the target.

    Each row has the smallest multiplier that covers it, and coverage is their distribution function, so the answer is an
    order statistic. Targets outside the coverage reached within the bracket are an error.
    """
    z_lo, z_hi = z_values(band)
    err, sd = F.col("t2m_obs") - F.col("ens_mean"), F.sqrt("ens_var")
    need = F.when(err == 0, F.lit(0.0)).when(sd == 0, F.lit(float("inf"))).when(
        err > 0, err / F.nullif(sd * F.lit(z_hi), F.lit(0.0))).otherwise(err / F.nullif(sd * F.lit(z_lo), F.lit(0.0)))
    rows = train.select(need.alias("need"))
    lo, hi = COVERAGE_BRACKET
    ends = rows.agg(F.avg(F.when(F.col("need") <= lo, 1.0).otherwise(0.0)).alias("c_lo"),
                    F.avg(F.when(F.col("need") <= hi, 1.0).otherwise(0.0)).alias("c_hi"))
    picked = split_quantiles(rows, [], "need", [target], kind="inverted").crossJoin(F.broadcast(ends))    # one row each
    inside = (F.col("c_lo") < target) & (F.col("c_hi") > target)
    return picked.select(F.when(inside, F.col("q")[0]).otherwise(F.raise_error(F.lit(
        "bracket does not enclose the target coverage")).cast("double")).alias("multiplier"))


def inflation_predict(test: DataFrame, model: DataFrame, keys: list[str] = (), levels=S.LEVELS) -> DataFrame:
    m = model.select(*keys, "multiplier")
    joined = test.join(m, list(keys)) if keys else test.crossJoin(F.broadcast(m))    # one row without keys
    return joined.withColumn("q", gaussian_quantiles("ens_mean", "multiplier*sqrt(ens_var)", levels)).drop("multiplier")


def inflation_curve(test: DataFrame, levels=S.LEVELS) -> DataFrame:
    """Coverage, width and CRPS of N(mean, lambda^2 var) over the multiplier grid; the expansion is combined map-side."""
    lo, hi, step = CURVE_STEPS
    grid = test.withColumn("_l", F.explode(F.sequence(F.lit(lo), F.lit(hi), F.lit(step))))
    q = grid.withColumn("q", gaussian_quantiles("ens_mean", "(_l/100D)*sqrt(ens_var)", levels))
    return (q.groupBy("_l").agg(F.avg(S.covered("t2m_obs", "q", levels)).alias("coverage_80pct"),
                                F.avg(S.width("q", levels)).alias("interval_width"),
                                F.avg(S.crps("t2m_obs", "q", levels)).alias("crps"))
            .select((F.col("_l") / F.lit(100.0)).alias("multiplier"), "coverage_80pct", "interval_width", "crps"))
