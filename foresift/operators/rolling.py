"""Rolling EMOS: at each issue time, models fitted on the verified pairs of the last W days."""
from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foresift.operators.emos import BUCKET_ROWS, fit_emos, fit_packed, predict_variants
from foresift.operators.timeseries import day_number, rolling_pairs, window_fits
from foresift.sources.storage import materialise

# Minimum rows of a history, of a lead-specific, a station, and an adaptive (station, lead) fit.
MIN_HISTORY = 20
MIN_LEAD = 20
MIN_LOCAL = 5
MIN_ADAPTIVE = 20
FIT = ["window_days", "at"]
# Fallback chains: (models, minimum rows) in order of preference.
VARIANTS = {
    "rolling_pooled_leadspec": [("lead", MIN_LEAD), ("pooled", MIN_HISTORY)],
    "rolling_local": [("station", MIN_LOCAL), ("pooled", MIN_HISTORY)],
    "rolling_local_leadspec": [("cell", MIN_LOCAL), ("station", MIN_LOCAL), ("pooled", MIN_HISTORY)],
    "rolling_local_adaptive": [("cell", MIN_ADAPTIVE), ("station", MIN_LOCAL), ("pooled", MIN_HISTORY)],
}


def local_models(history: DataFrame, fits: DataFrame, windows: list[int], keys: list[str]) -> DataFrame:
    """Rolling fits per station (and lead) with MIN_LOCAL rows, for the pairs of `at` and `window_days` in `fits`.

    History rows are shuffled once, two copies each: by series, window and block of W days, hashed into buckets. The issues
    of a block are joined in place and the fits of a bucket run together, so the pairs (about W per row) exist only inside
    tasks, and a long series is spread over its blocks.
    """
    sizes = F.array(*[F.lit(w) for w in windows])
    n_buckets = max(math.ceil(history.count() * sum(windows) / BUCKET_ROWS),
                    history.sparkSession.sparkContext.defaultParallelism)
    blk = F.floor(day_number("issue_time") / F.col("window_days"))
    rows = (history.withColumn("window_days", F.explode(sizes))
            .withColumn("_blk", F.explode(F.array(blk, blk + 1)))
            .withColumn("_bucket", F.pmod(F.hash(*keys, "window_days", "_blk"), F.lit(n_buckets))))
    targets = materialise(fits.select("at", "window_days").withColumn("_blk", F.floor(day_number("at") / F.col("window_days"))))
    # An issue of day t looks back to day t - W, which lies in its own or the previous block. The issue list is one row per
    # issue time and window and has a known size; while it is small the rows stay where the first shuffle put them.
    spread = rows.repartition(n_buckets, F.col("_bucket"))
    pairs = spread.join(targets, ["window_days", "_blk"]).where(
        (F.col("issue_time") >= F.timestamp_add("DAY", -F.col("window_days"), F.col("at")))
        & (F.col("issue_time") < F.col("at")) & (F.col("valid_time") < F.col("at")))
    cols = pairs.select("_bucket", *keys, *FIT, "ens_mean", "ens_var", "t2m_obs")
    return materialise(fit_packed(cols, [*keys, *FIT], ["_bucket"], ("ens_mean",), "ens_var", "t2m_obs", 5000, MIN_LOCAL))


def rolling_predictions(history: DataFrame, test: DataFrame, windows: list[int]) -> DataFrame:
    """All four variants for all windows: columns of `test`, window_days, method, tier, q.

    Local variants fall back to the station's all-lead fit, then to the pooled one. Issue times with fewer than
    MIN_HISTORY verified pairs get no forecast. Windows that hold the same rows share one fit.
    """
    hist = history.select("station_id", "step_hours", "issue_time", "valid_time", "ens_mean", "ens_var", "t2m_obs")
    shared = materialise(window_fits(hist, test, windows))
    fits = materialise(shared.select("at", F.col("fit_days").alias("window_days")).distinct())
    used = sorted(r["window_days"] for r in fits.select("window_days").distinct().collect())      # some of `windows`
    pairs = rolling_pairs(hist, fits, used)
    models = {
        "pooled": (fit_emos(pairs, FIT, min_rows=MIN_HISTORY), FIT),
        "lead": (fit_emos(pairs, [*FIT, "step_hours"], min_rows=MIN_LEAD), [*FIT, "step_hours"]),
        "station": (local_models(hist, fits, used, ["station_id"]), [*FIT, "station_id"]),
        "cell": (local_models(hist, fits, used, ["station_id", "step_hours"]), [*FIT, "station_id", "step_hours"]),
    }
    # the models are keyed by the window that was fitted
    asked = shared.select("at", F.col("window_days").alias("_asked"), F.col("fit_days").alias("window_days"))
    rows = test.withColumn("at", F.col("issue_time")).join(asked, "at")
    enough = rows.join(models["pooled"][0].select(*FIT), FIT, "left_semi")
    return predict_variants(enough, models, VARIANTS).drop("at", "window_days").withColumnRenamed("_asked", "window_days")
