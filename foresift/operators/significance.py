"""Tests of score differences and curve crossings, for any number of comparisons at once.

Rows are reduced to day or block means first; everything after that works on one short series per comparison.
"""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foresift.functions.hashing import draw, hash_key
from foresift.functions.normal import cdf_sql, t_two_sided_p
from foresift.operators.spread import position, running_sum
from foresift.sources.storage import materialise

# HAC lag, bootstrap block (days), replicates, confidence level, significance level, exact-test limit.
HAC_LAG = 5
BLOCK_DAYS = 7
N_BOOT = 2000
CI = 0.95
ALPHA = 0.05
EXACT_LIMIT = 50
MIN_INSTANCES = 1000
DRAWS_PER_TASK = 2_000_000


def daily_series(losses: DataFrame, keys: list[str], diff: Column, time: str = "valid_time") -> DataFrame:
    """Mean loss difference per comparison and valid date."""
    return losses.groupBy(*keys, F.to_date(time).alias("day")).agg(F.avg(diff).alias("d"))


def long_run_variance(daily: DataFrame, keys: list[str], lag: int = HAC_LAG) -> DataFrame:
    """n, mean and Bartlett-weighted long-run variance; lags count rows, gaps in the dates are not filled."""
    whole = Window.partitionBy(*keys)
    in_order = whole.orderBy("day")
    e = daily.withColumn("e", F.col("d") - F.avg("d").over(whole))
    lagged = [F.lag("e", k).over(in_order).alias(f"e{k}") for k in range(1, lag + 1)]
    wide = e.select(*keys, "d", "e", *lagged)
    total = F.sum(F.col("e") * F.col("e"))
    for k in range(1, lag + 1):
        total = total + 2.0 * (1.0 - k / (lag + 1.0)) * F.coalesce(F.sum(F.col("e") * F.col(f"e{k}")), F.lit(0.0))
    return wide.groupBy(*keys).agg(F.count("d").alias("n_days"), F.avg("d").alias("mean_diff"),
                                   (total / F.count("d")).alias("lrv"))


def hac_test(daily: DataFrame, keys: list[str], lag: int = HAC_LAG) -> DataFrame:
    """Diebold-Mariano test with HAC variance and small-sample correction (Harvey et al. 1997)."""
    v = long_run_variance(daily, keys, lag)
    n, h = F.col("n_days"), lag + 1
    # both factors are square roots of quantities that may be non-positive for very short series
    scale = (n + 1 - 2 * h + F.lit(float(h * (h - 1))) / n) / n
    stat = F.when((F.col("lrv") > 0) & (scale >= 0),
                  F.col("mean_diff") / F.sqrt(F.nullif(F.abs(F.col("lrv")), F.lit(0.0)) / n) * F.sqrt(F.abs(scale)))
    out = v.withColumn("dm_stat", stat)
    return out.withColumn("dm_pvalue", t_two_sided_p(F.col("dm_stat"), n - 1)).withColumn("hac_lag", F.lit(lag)).drop(
        "lrv")


def moving_block_ci(daily: DataFrame, keys: list[str], block: int = BLOCK_DAYS, n_boot: int = N_BOOT,
                    ci: float = CI, seed: int = 0) -> DataFrame:
    """Percentile interval of the mean from blocks of consecutive rows, with hashed block starts.

    Block sums are taken once per start; a replicate is a sum of looked-up block sums, the last one cut to length.
    """
    w = Window.partitionBy(*keys).orderBy("day")
    sums = F.array(*[F.sum("d").over(w.rowsBetween(0, k)) for k in range(block)])
    size = daily.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= block)
    starts = daily.select(*keys, (F.row_number().over(w) - 1).alias("start"), sums.alias("sums"))
    n_blocks = F.ceil(F.col("n") / block)
    draws = (size.withColumn("n_blocks", n_blocks)
             .withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))))
             .withColumn("b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_blocks") - 1)))
             .withColumn("start", draw(F.col("n") - (block - 1), F.lit(seed), F.col("rep"), F.col("b")).cast("int")))
    length = F.when(F.col("b") < F.col("n_blocks") - 1, F.lit(block)).otherwise(
        F.col("n") - block * (F.col("n_blocks") - 1)).cast("int")
    means = (draws.join(starts, [*keys, "start"])
             .groupBy(*keys, "rep").agg((F.sum(F.element_at("sums", length)) / F.first("n")).alias("m")))
    tails = [(1.0 - ci) / 2, (1.0 + ci) / 2]
    q = F.percentile("m", F.array(*[F.lit(t) for t in tails]))
    return means.groupBy(*keys).agg(q.alias("_q")).select(
        *keys, F.col("_q")[0].alias("ci_low"), F.col("_q")[1].alias("ci_high"))


def robust_comparison(losses: DataFrame, keys: list[str], diff: Column, seed: int = 0) -> DataFrame:
    daily = materialise(daily_series(losses, keys, diff))
    return hac_test(daily, keys).join(moving_block_ci(daily, keys, seed=seed), keys, "left").withColumn(
        "block_days", F.lit(BLOCK_DAYS))


def block_means(losses: DataFrame, keys: list[str], block: Column, diff: Column) -> DataFrame:
    return losses.groupBy(*keys, block.alias("block_id")).agg(F.avg(diff).alias("d"))


@F.pandas_udf(T.DoubleType())
def _exact_signed_rank_p(n: pd.Series, w: pd.Series) -> pd.Series:
    """Two-sided exact p of the smaller signed-rank sum, one row per comparison."""
    def one(size, stat):
        if pd.isna(size) or pd.isna(stat) or size > EXACT_LIMIT or size < 1:
            return None
        ways = np.zeros(int(size * (size + 1) // 2) + 1)
        ways[0] = 1.0
        for r in range(1, int(size) + 1):
            ways[r:] = ways[r:] + ways[:-r]
        return float(min(1.0, 2.0 * ways[: int(np.floor(stat)) + 1].sum() / 2.0 ** int(size)))
    return pd.Series([one(a, b) for a, b in zip(n, w)], dtype="float64")


def paired_block_test(blocks: DataFrame, keys: list[str], exact: bool = True) -> DataFrame:
    """One-sample t and Wilcoxon signed-rank test on block means.

    Ranks of |d| come from counts of equal values and their running sum, cut by magnitude, so the number of blocks is not
    limited by one task. The rank test is exact for up to 50 blocks without zeros or ties, else a normal approximation with
    tie correction.
    """
    blocks = materialise(blocks)
    t_part = blocks.groupBy(*keys).agg(
        F.count("d").alias("n_blocks"), F.avg("d").alias("block_mean_diff"), F.stddev_samp("d").alias("_sd"),
        F.count(F.when(F.col("d") == 0, 1)).alias("_zeros"))
    nonzero = blocks.where(F.col("d") != 0)
    ties = nonzero.groupBy(*keys, F.abs("d").alias("a")).agg(
        F.count(F.lit(1)).alias("c"), F.count(F.when(F.col("d") > 0, 1)).alias("pos"))
    ranked = running_sum(ties, keys, F.floor(F.log2("a") * 16), [F.col("a")], F.col("c"), "cum")
    avg_rank = F.col("cum") - (F.col("c") - 1) / 2.0
    w_part = ranked.groupBy(*keys).agg(
        F.sum(avg_rank * F.col("pos")).alias("_plus"), F.sum(avg_rank * (F.col("c") - F.col("pos"))).alias("_minus"),
        F.sum("c").alias("_n"), F.sum(F.col("c") * F.col("c") * F.col("c") - F.col("c")).alias("_ties"))
    both = t_part.join(w_part, keys, "left")
    n = F.col("_n").cast("double")
    stat = F.least("_plus", "_minus")
    se2 = n * (n + 1) * (2 * n + 1) / 24.0 - F.col("_ties") / 48.0
    both = (both.withColumn("t_statistic", F.col("block_mean_diff") / F.nullif(
                F.col("_sd") / F.sqrt(F.col("n_blocks").cast("double")), F.lit(0.0)))
            .withColumn("wilcoxon_statistic", stat)
            .withColumn("_z", (stat - n * (n + 1) / 4.0) / F.nullif(F.sqrt(se2), F.lit(0.0))))
    p_norm = F.when(F.col("_z").isNotNull(), F.least(F.lit(1.0), 2.0 * F.expr(cdf_sql("(-abs(_z))"))))
    p_rank = p_norm
    if exact:
        small = (F.col("_n") <= EXACT_LIMIT) & (F.col("_ties") == 0) & (F.col("_zeros") == 0)
        p_rank = F.when(small, _exact_signed_rank_p(F.col("_n"), stat)).otherwise(p_norm)
    return both.withColumn("t_pvalue", t_two_sided_p(F.col("t_statistic"), F.col("n_blocks") - 1)).withColumn(
        "wilcoxon_pvalue", p_rank).select(*keys, "n_blocks", "block_mean_diff", "t_statistic", "t_pvalue",
                                          "wilcoxon_statistic", "wilcoxon_pvalue")


def block_bootstrap_skill(losses: DataFrame, keys: list[str], block: Column, a: Column, b: Column,
                          n_boot: int = N_BOOT, ci: float = CI, seed: int = 0) -> DataFrame:
    """Skill 1 - mean(a) / mean(b) with an interval from resampling whole blocks; only block sums are resampled."""
    sums = losses.groupBy(*keys, block.alias("block_id")).agg(F.sum(a).alias("sa"), F.sum(b).alias("sb"))
    sums = materialise(sums.withColumn("_h", hash_key(F.col("block_id"))))
    # one row per block: stored, so that the join of the draws is planned with its size
    numbered = materialise(position(sums, keys, F.substring("_h", 1, 2), [F.col("_h"), F.col("block_id")], "idx").select(
        *keys, "idx", "sa", "sb"))
    totals = numbered.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_blocks"), F.sum("sa").alias("_ta"),
                                     F.sum("sb").alias("_tb"))
    slots = numbered.select(*keys, F.col("idx").alias("slot")).join(totals.select(*keys, "n_blocks"), keys)
    # the draws multiply the rows: spread the slots over enough tasks first
    tasks = max(losses.sparkSession.sparkContext.defaultParallelism, math.ceil(numbered.count() * n_boot / DRAWS_PER_TASK))
    slots = slots.repartition(tasks)
    draws = (slots.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))))
             .withColumn("idx", draw(F.col("n_blocks"), F.lit(seed), F.col("rep"), F.col("slot"))))
    reps = (draws.join(numbered, [*keys, "idx"]).groupBy(*keys, "rep")
            .agg((1.0 - F.sum("sa") / F.sum("sb")).alias("skill")))
    tails = F.array(F.lit((1.0 - ci) / 2), F.lit((1.0 + ci) / 2))
    band = reps.groupBy(*keys).agg(F.percentile("skill", tails).alias("_q"))
    return totals.join(band, keys).select(*keys, "n_blocks", (1.0 - F.col("_ta") / F.col("_tb")).alias("skill"),
                                          F.col("_q")[0].alias("ci_low"), F.col("_q")[1].alias("ci_high"))


def _segments(curve: DataFrame, keys: list[str], n: str, value: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(n)
    clean = curve.withColumn("_v0", F.nanvl(F.col(value), F.lit(None).cast("double")))
    return (clean.withColumn("_n1", F.lead(n).over(w)).withColumn("_v1", F.lead("_v0").over(w))
            .withColumn("_n0", F.col(n).cast("double")))


def _at_crossing(ref: Column) -> Column:
    return F.col("_n0") + (ref - F.col("_v0")) / F.nullif(F.col("_v1") - F.col("_v0"), F.lit(0.0)) * (
        F.col("_n1") - F.col("_n0"))


def first_crossing(curve: DataFrame, keys: list[str], ref: str = "ref", n: str = "n", value: str = "value",
                   better: Column | None = None) -> DataFrame:
    """First segment that starts worse than the reference and ends at least as good, interpolated; NULL if none.

    `better` is 'lower' (default) or 'higher'. Segments that touch a missing value are skipped.
    """
    s = _segments(curve, keys, n, value)
    r = F.col(ref)
    low = (better if better is not None else F.lit("lower")) == "lower"
    worse = F.when(low, F.col("_v0") > r).otherwise(F.col("_v0") < r)
    ends = F.when(low, F.col("_v1") <= r).otherwise(F.col("_v1") >= r)
    hit = worse & ends & (F.col("_v0") != F.col("_v1"))
    return s.groupBy(*keys).agg(
        F.min_by(F.when(hit, _at_crossing(r)), F.when(hit, F.col("_n0"))).alias("breakpoint"))


def crossing_with_direction(curve: DataFrame, keys: list[str], metric: str, ref: str = "ref", n: str = "n",
                            value: str = "value") -> DataFrame:
    """First crossing with the direction rule of the metric and a verdict."""
    if metric not in ("crps", "coverage_80pct"):
        raise ValueError(f"no direction rule for metric {metric!r}")
    v = F.nanvl(F.col(value), F.lit(None).cast("double"))
    known = v.isNotNull()
    base = curve.groupBy(*keys).agg(
        F.count(v).alias("n_points"), F.min_by(v, F.when(known, F.col(n))).alias("_first"), F.first(ref).alias("_ref"),
        F.regr_slope(v, F.when(known, F.col(n).cast("double"))).alias("slope"))
    if metric == "crps":
        base = base.withColumn("better", F.lit("lower"))
    else:
        base = base.withColumn("better", F.when(F.col("slope") > 0, "higher").otherwise("lower"))
    joined = curve.join(base.select(*keys, "better"), keys)
    cross = first_crossing(joined, keys, ref, n, value, F.col("better"))
    out = base.join(cross, keys)
    ahead = F.when(F.col("better") == "lower", F.col("_first") <= F.col("_ref")).otherwise(
        F.col("_first") >= F.col("_ref"))
    too_few = F.col("n_points") < (1 if metric == "crps" else 2)
    verdict = (F.when(too_few, "too few points").when(F.col("breakpoint").isNotNull(), F.concat(
        F.lit("crossed "), F.when(F.col("better") == "lower", "downward").otherwise("upward")))
        .when(ahead, "already better").otherwise("never"))
    return out.select(*keys, "n_points", "slope", F.when(~too_few, F.col("breakpoint")).alias("breakpoint"),
                      verdict.alias("verdict"))


def first_durable_significance(rows: DataFrame, keys: list[str], k: str, diff: str, p: str,
                               alpha: float = ALPHA) -> DataFrame:
    """Smallest k such that at it and at every larger k the difference is negative and significant; NULL if none."""
    good = F.coalesce((F.col(diff) < 0) & (F.col(p) < alpha), F.lit(False))
    w = Window.partitionBy(*keys)
    marked = rows.withColumn("_last_bad", F.max(F.when(~good, F.col(k))).over(w))
    ok = F.col("_last_bad").isNull() | (F.col(k) > F.col("_last_bad"))
    return marked.groupBy(*keys).agg(F.min(F.when(ok, F.col(k))).alias("first_k"))


def last_durable_crossing(curve: DataFrame, keys: list[str], ref: str = "ref", n: str = "n",
                          value: str = "value") -> DataFrame:
    """Where the curve falls below the reference for good: '<first' if always below, 'none' if not below at the end."""
    s = _segments(curve, keys, n, value)
    better = F.coalesce(F.col("_v0") < F.col(ref), F.lit(False))
    w = Window.partitionBy(*keys)
    s = s.withColumn("_worse", F.max(F.when(~better, F.col("_n0"))).over(w))
    agg = s.groupBy(*keys).agg(
        F.max("_worse").alias("_worse"), F.max("_n0").alias("_end"),
        F.max(F.when(F.col("_n0") == F.col("_worse"), _at_crossing(F.col(ref)))).alias("_cross"))
    status = (F.when(F.col("_worse").isNull(), "<first").when(F.col("_worse") == F.col("_end"), "none")
              .otherwise("crossed"))
    return agg.select(*keys, status.alias("status"),
                      F.when(status == "crossed", F.col("_cross")).alias("crossing"))


def membership_mask(rows: DataFrame, sets: dict[str, DataFrame], keys: list[str], out: str = "members") -> DataFrame:
    """Adds a bit mask of the key sets that hold the key of a row: bit i for the i-th set. All sets meet the rows in one join."""
    marked = None
    for i, df in enumerate(sets.values()):
        part = df.select(*keys, F.lit(1 << i).cast("bigint").alias("_bit"))
        marked = part if marked is None else marked.unionByName(part)
    masks = marked.groupBy(*keys).agg(F.bit_or("_bit").alias(out))
    return rows.join(masks, keys, "left").withColumn(out, F.coalesce(out, F.lit(0).cast("bigint")))


def guarded_scores(rows: DataFrame, keys: list[str], references: list[str], buckets: dict[str, tuple[float, float]],
                   min_instances: int | list[int] = MIN_INSTANCES, common: list[str] = (), members: str = "members") -> DataFrame:
    """Score row per method (and per least number, if several are given, in column `least`): NULL scores below `min_instances` covered rows, bucket CRPS, tests against references.

    `rows` has one row per instance: keys, valid_time, step_hours, crps (NULL if uncovered), upper_crps, covered, width, and
    crps_<reference> columns. `common` names references that are compared on the instances of their own key set only, bit i of
    the mask `members` for the i-th: scores of both on that set, mean difference and p-value, NULL below `min_instances` covered
    rows of the set; `crps_common` is that of the last reference with enough. The rows are read once: they are summed by day, lead
    and mask, and all scores and daily series start from these sums.
    """
    have = F.col("crps").isNotNull()
    inside_set = {r: F.col(members).bitwiseAND(1 << i) != 0 for i, r in enumerate(common)}
    by = [*keys, F.to_date("valid_time").alias("day"), "step_hours", *([members] if common else [])]
    sums = [F.count(F.lit(1)).alias("_rows")]
    for c in ["crps", "upper_crps", "covered", "width", *[f"crps_{r}" for r in references]]:
        sums += [F.count(F.when(have, F.col(c))).alias(f"n_{c}"), F.sum(F.when(have, F.col(c))).alias(f"s_{c}")]
    sums += [F.sum(F.when(have, F.col("crps") - F.col(f"crps_{r}"))).alias(f"d_{r}") for r in references]
    days = materialise(rows.groupBy(*by).agg(*sums))
    total = lambda c, where: F.sum(F.when(where, F.col(c)))
    mean = lambda c, where=F.lit(True): total(f"s_{c}", where) / F.nullif(total(f"n_{c}", where), F.lit(0))
    gap = lambda r, where=F.lit(True): total(f"d_{r}", where) / F.nullif(total(f"n_crps_{r}", where), F.lit(0))
    aggs = [F.sum("n_crps").alias("n_instances"), (F.sum("n_crps") / F.sum("_rows")).alias("covered_fraction")]
    aggs += [mean(c).alias(c) for c in ("crps", "upper_crps", "covered", "width")]
    for name, (lo, hi) in buckets.items():
        inside = F.col("step_hours").between(lo, hi)
        aggs.append(mean("crps", inside).alias(f"crps_{name}"))
        aggs += [mean(f"crps_{r}", inside).alias(f"crps_{r}_{name}") for r in references]
    for r, where in inside_set.items():
        aggs += [F.coalesce(total("n_crps", where), F.lit(0)).alias(f"_n_{r}"), mean("crps", where).alias(f"_crps_{r}"),
                 mean(f"crps_{r}", where).alias(f"crps_{r}_common")]
    out = days.groupBy(*keys).agg(*aggs)
    gaps = {r: gap(r) for r in references} | {f"{r}:common": gap(r, where) for r, where in inside_set.items()}
    each = days.groupBy(*keys, F.col("day").alias("valid_time")).agg(
        F.array(*[F.struct(F.lit(name).alias("ref"), d.alias("d")) for name, d in gaps.items()]).alias("_p"))
    each = each.select(*keys, "valid_time", F.explode("_p").alias("_p")).select(
        *keys, "valid_time", F.col("_p.ref").alias("_ref"), F.col("_p.d").alias("_d")).where(F.col("_d").isNotNull())
    robust = robust_comparison(each, [*keys, "_ref"], F.col("_d"))
    measures = [c for c in robust.columns if c not in [*keys, "_ref"]]
    pick = lambda ref, c, to: F.max(F.when(F.col("_ref") == ref, F.col(c))).alias(to)
    wide = [pick(r, c, f"vs_{r}_{c}") for r in references for c in measures]
    wide += [pick(f"{r}:common", c, f"vs_{r}_common_{c}") for r in common for c in ("mean_diff", "dm_pvalue")]
    out = out.join(robust.groupBy(*keys).agg(*wide), keys, "left")
    first = references[0]
    day = paired_block_test(block_means(each.where(F.col("_ref") == first), keys, F.to_date("valid_time"), F.col("_d")), keys,
                            exact=False)
    out = out.join(day.select(*keys, F.col("t_pvalue").alias(f"vs_{first}_day_t_pvalue")), keys, "left")
    several = not isinstance(min_instances, int)
    out = out.withColumn("least", F.explode(F.array(*[F.lit(n) for n in (min_instances if several else [min_instances])])))
    last = F.lit(None).cast("double")
    for r in common:
        enough = F.col(f"_n_{r}") >= F.col("least")
        last = F.when(enough, F.col(f"_crps_{r}")).otherwise(last)
        out = out.withColumns({c: F.when(enough, F.col(c)) for c in
                               (f"crps_{r}_common", f"vs_{r}_common_mean_diff", f"vs_{r}_common_dm_pvalue")})
    if common:
        out = out.withColumn("crps_common", last).drop(*[f"{c}_{r}" for r in common for c in ("_n", "_crps")])
    enough = F.col("n_instances") >= F.col("least")
    kept = [*keys, *(["least"] if several else []), "n_instances", "covered_fraction"]
    return out.select(*kept, *[F.when(enough, F.col(c)).alias(c) for c in out.columns if c not in [*kept, "least"]])
