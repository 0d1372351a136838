"""Summary tables of a method comparison.

Inputs are prediction tables: run columns (method, or model and context), station_id, valid_time, step_hours, obs, q.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foresift.functions import scores as S
from foresift.operators import panel as P
from foresift.operators import significance as G
from foresift.operators.baselines import LAMBDA_CLIM, coverage_inflation, fit_inflation
from foresift.operators.emos import emos_quantiles, fit_emos, fit_nested, gaussian_quantiles
from foresift.operators.leave_one_out import fit_unions
from foresift.operators.network import fit_networks
from foresift.operators.sampling import CASE, cases_to_days, exact_days, full_and_smaller, rank_recent, sweep_cases, sweep_panel
from foresift.operators.spread import row_sized
from foresift.sources.storage import materialise
from foresift.sources.tables import KEY


def crps_by_bucket(half_open: bool = False) -> list[Column]:
    b = P.lead_bucket(F.col("step_hours"), half_open)
    return [F.avg(F.when(b == name, S.crps("obs", "q"))).alias(f"crps_{name}") for name in P.BUCKETS]


def counts_by_bucket(half_open: bool = False) -> list[Column]:
    b = P.lead_bucket(F.col("step_hours"), half_open)
    return [F.count(F.when(b == name, 1)).alias(f"n_{name}") for name in P.BUCKETS]


def crps_by_season() -> list[Column]:
    s = P.season(F.month("issue_date"))
    return [F.avg(F.when(s == name, S.crps("obs", "q"))).alias(f"crps_{name}") for name in P.SEASONS]


def rank_fractions() -> list[Column]:
    r = S.quantile_rank("obs", "q")
    return [F.avg(F.when(r == i, 1.0).otherwise(0.0)).alias(f"rank_bin_{i}") for i in range(len(S.LEVELS) + 1)]


def lead_curves(predictions: DataFrame) -> DataFrame:
    """Mean CRPS by method and lead."""
    return predictions.groupBy("method", "step_hours").agg(F.count(F.lit(1)).alias("n"),
                                                           F.avg(S.crps("obs", "q")).alias("crps"))


def in_sets(runs: DataFrame, run_cols: list[str], sets: dict[str, DataFrame]) -> DataFrame:
    """Run rows labelled by evaluation set; a run that does not cover a whole set is left out of it."""
    keys, sizes = None, None
    for name, df in sets.items():
        k = df.select(*KEY).distinct().withColumn("eval_set", F.lit(name))
        keys = k if keys is None else keys.unionByName(k)
    sizes = keys.groupBy("eval_set").agg(F.count(F.lit(1)).alias("_size"))
    rows = runs.join(row_sized(keys), KEY)
    full = (rows.groupBy(*run_cols, "eval_set").agg(F.count(F.lit(1)).alias("_n")).join(sizes, "eval_set")
            .where(F.col("_n") == F.col("_size")).select(*run_cols, "eval_set"))
    return rows.join(full, [*run_cols, "eval_set"], "left_semi")


def reference_scores(runs: DataFrame, run_cols: list[str], sets: dict[str, DataFrame]) -> DataFrame:
    """One wide row per run and evaluation set, in a single conditional aggregation."""
    rows = P.with_issue_time(in_sets(runs, run_cols, sets))
    return rows.groupBy(*run_cols, "eval_set").agg(
        *S.bundle("obs", "q"), *S.error_bundle("obs", "q"), *crps_by_bucket(), *crps_by_season(), *rank_fractions())


def context_summary(runs: DataFrame, run_cols: list[str], n_runs: int) -> DataFrame:
    """Scores of every run on the common key set and on its own, with the own set's first issue and valid time."""
    common = P.common_keys(runs, run_cols, n_runs)
    marked = P.with_issue_time(runs.join(row_sized(common.withColumn("_c", F.lit(True))), KEY, "left"))
    sets = F.when(F.col("_c"), F.array(F.lit("common"), F.lit("own"))).otherwise(F.array(F.lit("own")))
    rows = marked.withColumn("eval_set", F.explode(sets))
    own = F.col("eval_set") == "own"
    return rows.groupBy(*run_cols, "eval_set").agg(
        *S.bundle("obs", "q"), *crps_by_bucket(True), *counts_by_bucket(True),
        F.min(F.when(own, F.col("issue_time"))).alias("first_issue"),
        F.min(F.when(own, F.col("valid_time"))).alias("first_valid"))


def common_set_summary(runs: DataFrame, run_cols: list[str], n_runs: int) -> DataFrame:
    """Scores of every run on the n-way common set, with own and common counts."""
    common = P.common_keys(runs, run_cols, n_runs)
    marked = runs.join(row_sized(common.withColumn("_c", F.lit(True))), KEY, "left")
    c = F.col("_c")
    return marked.groupBy(*run_cols).agg(
        F.count(c).alias("n_instances"), F.count(F.lit(1)).alias("n_own"),
        F.avg(F.when(c, S.crps("obs", "q"))).alias("crps"), F.avg(F.when(c, S.covered("obs", "q"))).alias("coverage_80pct"),
        F.avg(F.when(c, S.width("q"))).alias("interval_width"))


def windowed_common_summary(runs: DataFrame, reference: DataFrame, window: str, run_cols: list[str],
                            runs_per_window: int) -> DataFrame:
    """Per window: keys common to its runs and the reference set, scores on them, and the share of the reference."""
    ref = reference.select(*KEY).distinct()
    hits = runs.join(row_sized(ref), KEY, "left_semi")
    common = (hits.select(window, *run_cols, *KEY).distinct().groupBy(window, *KEY).agg(F.count(F.lit(1)).alias("_m"))
              .where(F.col("_m") == runs_per_window).drop("_m"))
    n_ref = ref.agg(F.count(F.lit(1)).alias("n_reference"))
    scored = hits.join(row_sized(common), [window, *KEY], "left_semi").groupBy(window, *run_cols).agg(
        *S.bundle("obs", "q"), *crps_by_bucket())
    return scored.crossJoin(F.broadcast(n_ref)).withColumn("share_of_reference", F.col("n") / F.col("n_reference"))


def variant_summary(runs: DataFrame, run_cols: list[str] = ("model",), variant: str = "variant") -> DataFrame:
    """Per run, variant and lead plus an 'all' row, on the keys both variants share: grouping sets, one pass."""
    cols = list(run_cols)
    both = (runs.select(*cols, variant, *KEY).distinct().groupBy(*cols, *KEY).agg(F.count(F.lit(1)).alias("_m"))
            .where(F.col("_m") == 2).drop("_m"))
    rows = runs.join(row_sized(both), [*cols, *KEY], "left_semi")
    by = [*cols, variant, "step_hours"]
    return (rows.groupingSets([by, by[:-1]], *by)
            .agg(F.grouping("step_hours").alias("_all"), *S.bundle("obs", "q"))
            .withColumn("lead", F.when(F.col("_all") == 1, "all").otherwise(F.col("step_hours").cast("string")))
            .drop("_all", "step_hours"))


def variant_delta(summary: DataFrame, run_cols: list[str], base: str, other: str) -> DataFrame:
    """CRPS of the two variants side by side and their difference."""
    wide = summary.groupBy(*run_cols, "lead").pivot("variant", [base, other]).agg(F.first("crps"))
    return wide.withColumn("delta", F.col(other) - F.col(base))


def seasonal_errors(predictions: DataFrame) -> DataFrame:
    """Error metrics per method for each season and for all seasons together."""
    rows = P.with_issue_time(predictions).withColumn("season", P.season(F.month("issue_date")))
    by = ["method", "season"]
    return (rows.groupingSets([by, ["method"]], *by)
            .agg(F.grouping("season").alias("_all"), F.count(F.lit(1)).alias("n"), *S.error_bundle("obs", "q"))
            .withColumn("season", F.when(F.col("_all") == 1, "all").otherwise(F.col("season"))).drop("_all"))


def rank_histogram(predictions: DataFrame) -> DataFrame:
    """Fractions per method and bin, empty bins included."""
    counts = predictions.groupBy("method", S.quantile_rank("obs", "q").alias("bin_index")).agg(F.count(F.lit(1)).alias("c"))
    totals = counts.groupBy("method").agg(F.sum("c").alias("n_instances"))
    spine = totals.withColumn("bin_index", F.explode(F.sequence(F.lit(0), F.lit(len(S.LEVELS)))))
    return spine.join(counts, ["method", "bin_index"], "left").select(
        "method", "bin_index", (F.col("bin_index") / F.lit(10.0)).alias("bin_lo"),
        ((F.col("bin_index") + 1) / F.lit(10.0)).alias("bin_hi"),
        (F.coalesce("c", F.lit(0)) / F.col("n_instances")).alias("fraction"), "n_instances")


def pit_histogram(predictions: DataFrame, bins: int = 10) -> DataFrame:
    """Relative frequencies of the PIT per method; the last bin is closed."""
    b = F.least(F.floor(S.pit("obs", "q") * bins), F.lit(bins - 1)).cast("int")
    counts = predictions.groupBy("method", b.alias("bin_index")).agg(F.count(F.lit(1)).alias("c"))
    totals = counts.groupBy("method").agg(F.sum("c").alias("n"))
    spine = totals.withColumn("bin_index", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return spine.join(counts, ["method", "bin_index"], "left").select(
        "method", "bin_index", (F.coalesce("c", F.lit(0)) / F.col("n")).alias("frequency"))


def reliability(histogram: DataFrame, bins: int = 10) -> DataFrame:
    d = F.col("frequency") - F.lit(1.0 / bins)
    return histogram.groupBy("method").agg(F.sqrt(F.avg(d * d)).alias("reliability"))


def random_arm(scores: DataFrame, keys: list[str], metrics: list[str], population: bool = False) -> DataFrame:
    """Mean and SD of the metrics over seeds."""
    sd = F.stddev_pop if population else F.stddev_samp
    return scores.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_seeds"),
                                     *[F.avg(m).alias(m) for m in metrics],
                                     *[sd(m).alias(f"{m}_std") for m in metrics])


def difference_curve(curves: DataFrame, baseline: str) -> DataFrame:
    """CRPS difference of each method to the baseline, per lead."""
    base = curves.where(F.col("method") == baseline).select("step_hours", F.col("crps").alias("base_crps"))
    return curves.where(F.col("method") != baseline).join(base, "step_hours").select(
        "method", "step_hours", "crps", "base_crps", (F.col("crps") - F.col("base_crps")).alias("difference"))


def winning_leads(curves: DataFrame, baseline: str) -> DataFrame:
    """Leads (a bounded set) at which each method beats the baseline, and their number."""
    d = difference_curve(curves, baseline)
    won = F.when(F.col("difference") < 0, F.col("step_hours").cast("int"))
    return d.groupBy("method").agg(F.array_join(F.sort_array(F.collect_list(won)), ", ").alias("leads"),
                                   F.count(won).alias("n_leads"))


def append_missing_runs(scores: DataFrame, extra: DataFrame, sets=("matched", "common")) -> DataFrame:
    """Adds rows of runs not yet scored, once per evaluation set; runs without covariate get a suffix."""
    label = F.concat(F.col("model"), F.when(F.col("covariate"), "").otherwise("_nocov"))
    new = extra.withColumn("model", label).withColumnRenamed("mean_width_80pct", "interval_width")
    missing = new.join(scores.select("model", "context_steps").distinct(), ["model", "context_steps"], "left_anti")
    doubled = missing.withColumn("eval_set", F.explode(F.array(*[F.lit(s) for s in sets])))
    return scores.unionByName(doubled.select(*scores.columns))


def wide_scores(scores: DataFrame, column: str, values: list, metric: str = "crps") -> DataFrame:
    """method x column table; missing cells stay NULL."""
    wide = scores.groupBy("method").pivot(column, values).agg(F.first(metric))
    return wide.select("method", *[F.col(f"`{v}`").alias(f"{column}_{v}") for v in values])


def nearest_row(grid: DataFrame, column: str, target: float) -> DataFrame:
    """The grid row nearest to a value; the smaller one on ties."""
    best = grid.agg(F.min_by(F.struct(*grid.columns), F.struct(F.abs(F.col(column) - target), F.col(column))).alias("r"))
    return best.select("r.*")


def interpolate_at(curve: DataFrame, x: str, y: str, targets: DataFrame, at: str = "at") -> DataFrame:
    """y at each target by linear interpolation over x, clipped to the ends of the curve.

    The curve is a parameter grid, so it becomes one array of segments that every target is matched to.
    """
    pts = curve.agg(F.array_sort(F.collect_list(F.struct(F.col(x).alias("x"), F.col(y).alias("y")))).alias("_p"))
    p, t = F.col("_p"), F.col(at)
    i = F.size(F.filter(p, lambda s: s["x"] <= t))
    lo, hi = F.element_at(p, F.greatest(i, F.lit(1))), F.element_at(p, F.least(i + 1, F.size(p)))
    frac = (t - lo["x"]) / F.nullif(hi["x"] - lo["x"], F.lit(0.0))
    inner = lo["y"] + frac * (hi["y"] - lo["y"])
    value = F.when(i == 0, p[0]["y"]).when(i == F.size(p), lo["y"]).otherwise(inner)
    return targets.crossJoin(F.broadcast(pts)).withColumn("value", value).drop("_p")     # one row with the grid


def skill_table(predictions: DataFrame, reference: str) -> DataFrame:
    """Mean CRPS per method and the improvement over one of them."""
    per = predictions.groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.avg(S.crps("obs", "q")).alias("crps"))
    ref = per.where(F.col("method") == reference).select(F.col("crps").alias("ref_crps"))
    return per.crossJoin(F.broadcast(ref)).select("method", "n", "crps",     # one reference row
                                                  S.skill("crps", "ref_crps").alias("skill"))


FIT = ["arm", "seed", "k"]


def sweep_inflation(sets_by_case: DataFrame) -> DataFrame:
    """Fitted multipliers of every training set from per-case sums: panel rows are never replicated."""
    return sets_by_case.groupBy(*FIT).agg(
        F.sqrt(F.sum("sse") / F.sum("svar")).alias("multiplier"), F.sum("n").alias("n_train"),
        F.count(F.lit(1)).alias("n_cases"))


def case_sums(train: DataFrame) -> DataFrame:
    err = F.col("t2m_obs") - F.col("ens_mean")
    return train.groupBy(*CASE).agg(F.sum(err * err).alias("sse"), F.sum("ens_var").alias("svar"),
                                    F.count(F.lit(1)).alias("n"))


def score_models(test: DataFrame, models: DataFrame, fit_cols: list[str], q: Column, join_on: list[str] = ()) -> DataFrame:
    """Scores of every fitted model on the whole test set: one row per fit, combined map-side.

    Models without further keys apply to every test row. Their number is the size of the sweep's parameter grid, so they
    travel as one array and are expanded next to the aggregation.
    """
    if join_on:
        rows = test.join(models, list(join_on))
    else:
        grid = models.agg(F.collect_list(F.struct(*models.columns)).alias("_grid"))
        rows = (test.crossJoin(F.broadcast(grid)).withColumn("_m", F.explode("_grid"))     # one row holding the grid
                .select(*test.columns, "_m.*"))
    scored = rows.withColumn("q", q).groupBy(*fit_cols).agg(*S.bundle("obs", "q"))
    # stations of a fit: from its models, not from its scored rows
    cells = test.select("station_id", *[c for c in join_on if c != "station_id"]).distinct()
    n_stations = F.countDistinct("station_id").alias("n_stations")
    if join_on:
        return scored.join(cells.join(models.select(*fit_cols, *join_on), list(join_on)).groupBy(*fit_cols).agg(n_stations), list(fit_cols))
    return scored.crossJoin(F.broadcast(cells.agg(n_stations)))     # one row


def training_size_table(train: DataFrame, test: DataFrame, ks: list[int], seeds: list[int], target_coverage: float = 0.8,
                        network_seeds: tuple[int, ...] = (0, 1, 2), **network) -> DataFrame:
    """Scores by training size: pooled and local EMOS, fitted inflation and the network on recent cases, pooled EMOS on random
    cases, the mean over seeds, and the references that do not depend on size, repeated for each size.

    `n_days` is the span that maps back to exactly k cases, 'full' for the whole archive; `calendar_days` the days that k cases
    span, NULL for the whole archive. All sizes and seeds of the network are trained together; its scores are means over
    `network_seeds` with the standard deviation of the population (those of random cases: of the sample). A size with no
    training rows emits NULL scores. The whole archive is fitted once and stands for every seed. Further arguments go to
    `fit_networks`.
    """
    cases = train.groupBy(*CASE).agg(F.min("case_date").alias("case_date"))
    n_full = cases.count()
    sizes = sorted({min(k, n_full) for k in ks if k > 0} | {n_full})
    sets = sweep_cases(cases, sizes, seeds)
    # the full archive is the same set in every arm: fit it once
    sets = materialise(sets.where((F.col("arm") == "contiguous") | (F.col("k") < n_full)).select(*FIT, *CASE))
    panel = sweep_panel(train, sets)
    inst = test.select("station_id", "ens_mean", "ens_var", F.col("t2m_obs").alias("obs"))
    # only cases are expanded to sets: a pooled fit starts from sums by case, and stations meet their sets inside tasks
    one = F.lit(0)
    pooled = fit_unions(train.withColumn("_one", one), sets.withColumn("_one", one), ["_one"], CASE, ["_one", *FIT]).drop("_one")
    scored = score_models(inst, pooled, FIT, emos_quantiles()).withColumn("method", F.lit("emos_pooled"))
    ranked = materialise(rank_recent(cases).select(*CASE, "rank").withColumn("n_cases", F.lit(n_full)))
    local = fit_nested(train.join(ranked, CASE), ["station_id"], {"emos_local": ([], 1)}, sizes, "rank", "n_cases", min_rows=5)
    local = local.withColumns({"arm": F.lit("contiguous"), "seed": F.lit(-1)})
    scored = scored.unionByName(score_models(inst, local, FIT, emos_quantiles(), ["station_id"])
                                .withColumn("method", F.lit("emos_local")))
    vi = sweep_inflation(sets.where("arm = 'contiguous'").join(case_sums(train), CASE))
    vi_q = gaussian_quantiles("ens_mean", "multiplier*sqrt(ens_var)")
    scored = scored.unionByName(score_models(inst, vi, FIT, vi_q).withColumn("method", F.lit("inflation_fitted")))
    scored = materialise(scored)        # read by the rows of each fit and by the means over seeds
    metrics = ["crps", "upper_crps", "coverage_80pct", "interval_width"]
    spread = [f"{m}_std" for m in metrics]
    base = scored.select("method", *FIT, "n", *metrics, "n_stations",
                         *[F.lit(None).cast("double").alias(s) for s in spread])
    seeded = scored.where("arm = 'random'")
    full = scored.where((F.col("k") == n_full) & (F.col("method") == "emos_pooled")).select(
        "method", F.lit("random_mean").alias("arm"), F.lit(-1).alias("seed"), "k", "n", *metrics, "n_stations",
        *[F.lit(0.0).alias(s) for s in spread])
    mean = random_arm(seeded, ["method", "k"], metrics).select(
        "method", F.lit("random_mean").alias("arm"), F.lit(-1).alias("seed"), "k",
        F.lit(None).cast("bigint").alias("n"), *metrics, F.lit(None).cast("bigint").alias("n_stations"), *spread)
    net = network_scores(panel, inst, sizes, network_seeds, network) if network_seeds else None
    refs = size_independent(train, inst, target_coverage)
    size_rows = refs.withColumn("k", F.explode(F.array(*[F.lit(int(k)) for k in sizes]))).select(
        "method", F.lit("n_independent").alias("arm"), F.lit(-1).alias("seed"), "k", "n", *metrics,
        F.lit(None).cast("bigint").alias("n_stations"), *[F.lit(None).cast("double").alias(s) for s in spread])
    out = base.unionByName(mean).unionByName(full).unionByName(size_rows)
    if net is not None:
        out = out.unionByName(random_arm(net, ["k"], metrics, population=True).select(
            F.lit("network").alias("method"), F.lit("contiguous").alias("arm"), F.lit(-1).alias("seed"), "k",
            F.lit(None).cast("bigint").alias("n"), *metrics, F.lit(None).cast("bigint").alias("n_stations"), *spread))
    empty = [k for k in ks if k <= 0]
    if empty:
        methods = ["emos_pooled", "emos_local", "inflation_fitted", *(["network"] if network_seeds else [])]
        rows = [(m, "contiguous", -1, int(k)) for k in empty for m in methods]
        blanks = train.sparkSession.createDataFrame(rows, "method string, arm string, seed int, k int")
        out = out.unionByName(blanks, allowMissingColumns=True)
    label = F.when(F.col("k") == n_full, F.lit("full")).otherwise(F.round(exact_days(F.col("k")), 4).cast("string"))
    return out.withColumns({"n_days": label, "calendar_days": F.when(F.col("k") != n_full, cases_to_days(F.col("k")))})


def emos_by_size(train: DataFrame, test: DataFrame, axes: dict[str, list[int]]) -> DataFrame:
    """The rows of `training_size_table` that the crossings of EMOS with the fixed inflation need, for several axes of sizes.

    Only recent cases are fitted. A size that lies on several axes has one training set, so it is fitted and scored once and stands
    on each of them.
    """
    cases = train.groupBy(*CASE).agg(F.min("case_date").alias("case_date"))
    n_full = cases.count()
    on = {name: sorted({min(k, n_full) for k in ks if k > 0} | {n_full}) for name, ks in axes.items()}
    sizes = sorted(set().union(*on.values()))
    panel = sweep_panel(train, sweep_cases(cases, sizes, [0]).where("arm = 'contiguous'"))
    inst = test.select("station_id", "ens_mean", "ens_var", F.col("t2m_obs").alias("obs"))
    pooled = fit_emos(panel, FIT, cheap_scan=True)
    local = fit_emos(panel, [*FIT, "station_id"], min_rows=5, cheap_scan=True)
    grid = pooled.agg(F.collect_list(F.struct("k", "a", "b", "c", "d")).alias("_models"))
    of_station = local.groupBy("station_id").agg(F.collect_list(F.struct("k", "a", "b", "c", "d")).alias("_models"))     # one for each size
    line = gaussian_quantiles("ens_mean", f"{LAMBDA_CLIM!r}D*sqrt(ens_var)")
    crossed = [F.avg(S.crps("obs", "q")).alias("crps"), F.avg(S.covered("obs", "q")).alias("coverage_80pct")]
    out = inst.withColumn("q", line).agg(*crossed).select(
        F.lit("inflation_fixed").alias("method"), F.lit("n_independent").alias("arm"), F.explode(F.array(*[F.lit(k) for k in sizes])).alias("k"),
        *CROSSED)
    for name, rows in (("emos_pooled", inst.crossJoin(F.broadcast(grid))), ("emos_local", inst.join(of_station, "station_id"))):     # grid: one row
        rows = rows.withColumn("_m", F.explode("_models")).select("obs", "ens_mean", "ens_var", "_m.*").withColumn("q", emos_quantiles())
        out = out.unionByName(rows.groupBy("k").agg(*crossed).select(
            F.lit(name).alias("method"), F.lit("contiguous").alias("arm"), "k", *CROSSED))
    places = F.array_compact(F.array(*[F.when(F.col("k").isin(ks), F.lit(name)) for name, ks in on.items()]))
    return out.withColumns({"axis": F.explode(places), "n_stations": F.lit(None).cast("bigint")})


def network_scores(panel: DataFrame, inst: DataFrame, sizes: list[int], seeds: tuple[int, ...], options: dict) -> DataFrame:
    """Scores of networks on the recent cases of every size and seed, trained in one grouped run.

    The sets are nested: the rows of the largest one hold those of all, and stand in the others by their cases.
    """
    recent = panel.where("arm = 'contiguous'")
    sets = recent.select("k", *CASE).distinct().withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
    sets = materialise(sets.select(F.concat_ws("-", "k", "seed").alias("fit_id"), *CASE))
    train = recent.where(F.col("k") == max(sizes)).select("station_id", "step_hours", *CASE, "ens_mean", "ens_var", "t2m_obs")
    model = fit_networks(train, {f"{k}-{s}": s for k in sizes for s in seeds}, use_lead=False, sets=sets, **options)
    inst = inst.select("station_id", F.col("obs").alias("t2m_obs"), "ens_mean", "ens_var")
    out = model.transform(inst).groupBy("fit_id").agg(*S.bundle("t2m_obs", "q"))
    return out.withColumn("k", F.split("fit_id", "-")[0].cast("int"))


def fitted_breakpoints(table: DataFrame, reference: str, methods: list[str], keys: list[str] = ()) -> DataFrame:
    """Where the scores of fitted methods cross those of a reference, on axes of training sizes.

    `table` has rows of `training_size_table`, with a column `axis` ('small', 'main'); both together are the 'combined' axis,
    the main row counting where both have a size. Rows without covered stations are no points of a curve.
    """
    curve = table.where((F.col("arm") == "contiguous") & F.col("method").isin(methods) & (F.col("k") > 0)
                        & (F.col("n_stations").isNull() | (F.col("n_stations") > 0)))
    both = curve.groupBy(*keys, "method", "k").agg(*[F.max_by(m, F.col("axis") == "main").alias(m) for m in CROSSED])
    axes = curve.where("axis = 'main'").select(*keys, "axis", "method", "k", *CROSSED).unionByName(
        both.withColumn("axis", F.lit("combined")).select(*keys, "axis", "method", "k", *CROSSED))
    line = table.where((F.col("method") == reference) & (F.col("axis") == "main")).groupBy(*keys).agg(
        *[F.first(m).alias(f"_ref_{m}") for m in CROSSED])
    return crossings(axes.join(line, list(keys)) if keys else axes.crossJoin(F.broadcast(line)),      # one row
                     [*keys, "axis", "method"])


CROSSED = ["crps", "coverage_80pct"]


def crossings(curve: DataFrame, keys: list[str]) -> DataFrame:
    """Crossing of each metric with its reference (columns `_ref_<metric>`) over k, with days and verdict."""
    out = None
    for m in CROSSED:
        points = curve.select(*keys, F.col("k").alias("n"), F.col(m).alias("value"), F.col(f"_ref_{m}").alias("ref"))
        row = G.crossing_with_direction(points, keys, m).join(points.groupBy(*keys).agg(F.first("ref").alias("reference")), keys)
        row = row.withColumns({"metric": F.lit(m), "days": cases_to_days(F.col("breakpoint"))})
        out = row if out is None else out.unionByName(row)
    return out


def size_independent(train: DataFrame, inst: DataFrame, target_coverage: float) -> DataFrame:
    """Raw Gaussian, fixed, coverage-matched and (as an upper bound) test-fitted inflation."""
    leaky = inst.withColumnRenamed("obs", "t2m_obs")
    one = train.sparkSession.range(1)
    models = (one.select(F.lit("raw_gaussian").alias("method"), F.lit(1.0).alias("multiplier"))
              .unionByName(one.select(F.lit("inflation_fixed").alias("method"), F.lit(LAMBDA_CLIM).alias("multiplier")))
              .unionByName(coverage_inflation(train, target_coverage).withColumn("method", F.lit("inflation_coverage")))
              .unionByName(coverage_inflation(leaky, target_coverage).withColumn("method", F.lit("inflation_leaky"))))
    q = gaussian_quantiles("ens_mean", "multiplier*sqrt(ens_var)")
    return score_models(inst, models, ["method"], q)


def seasonal_sweep(train: DataFrame, test: DataFrame, ks: list[int], references: dict[str, Column], seeds: list[int],
                   min_lead_specific: int = 5) -> DataFrame:
    """Season-matched training: per season, arm, size and method, scores and tests of the difference to the references.

    Cases are ranked within their season and all seasons, arms, sizes and methods are fitted together; sizes from the number of
    cases of a season on stand for all of them. Only cases are expanded to sets: pooled fits start from sums by case, and those of a
    station meet their sets inside tasks. On recent cases: pooled, local and, from `min_lead_specific` cases on, local
    lead-specific EMOS, tested by day against the first reference and by daily series against each, all references in one
    pass. On random cases: pooled EMOS, mean and population standard deviation over seeds. Rows of arm 'n_independent' hold the
    scores of the references themselves.
    """
    tr = train.withColumn("season", P.season(F.month("case_date")))
    te = P.with_issue_time(test).withColumn("season", P.season(F.month("issue_date"))).withColumnRenamed("t2m_obs", "obs")
    cases = materialise(tr.groupBy("season", *CASE).agg(F.min("case_date").alias("case_date")))
    fit = ["season", "arm", "seed", "k"]
    sets = materialise(full_and_smaller(cases, ks, seeds, ["season"]).select(*fit, *CASE))
    ranked = materialise(rank_recent(cases, ["season"]).join(cases.groupBy("season").agg(F.count(F.lit(1)).alias("n_cases")), "season")
                         .select("season", *CASE, "rank", "n_cases"))
    of_station = fit_nested(tr.join(ranked, ["season", *CASE]), ["season", "station_id"],
                            {"emos_local": ([], 1), "emos_local_leadspec": (["step_hours"], min_lead_specific)}, ks, "rank", "n_cases",
                            min_rows=5).withColumns({"arm": F.lit("contiguous"), "seed": F.lit(-1)})
    parts = [("emos_pooled", fit_unions(tr, sets, ["season"], CASE, fit), []),
             ("emos_local", of_station.where("tier = 'emos_local'"), ["station_id"]),
             ("emos_local_leadspec", of_station.where("tier = 'emos_local_leadspec'"), ["station_id", "step_hours"])]
    keys = ["season", "arm", "seed", "k", "method"]
    metrics = ["crps", "coverage_80pct", "interval_width"]
    # the references depend on the instance alone: scored once, before a row meets the models of all sets
    base = te
    for name, q in references.items():
        base = base.withColumn("_r", q).withColumn(f"crps_{name}", S.crps("obs", "_r")).drop("_r")
    base = materialise(base.select("season", "station_id", "step_hours", F.to_date("valid_time").alias("day"), "ens_mean", "ens_var",
                                   "obs", *[f"crps_{r}" for r in references]))
    rows, counts = None, None
    for name, models, own in parts:
        part = base.join(models.select(*fit, *own, "a", "b", "c", "d"), ["season", *own]).withColumn("method", F.lit(name))
        rows = part if rows is None else rows.unionByName(part)
        # stations of a fit: from its models, not from its scored rows
        cells = base.select("season", "station_id", *[c for c in own if c != "station_id"]).distinct()
        part = cells.join(models.select(*fit, *own), ["season", *own]).withColumn("method", F.lit(name))
        part = part.groupBy(*keys).agg(F.countDistinct("station_id").alias("n_stations"))
        counts = part if counts is None else counts.unionByName(part)
    # all scores and tests start from one pass: sums by day
    one = F.col("crps")
    rows = rows.withColumn("q", emos_quantiles()).withColumn("crps", S.crps("obs", "q"))
    days = materialise(rows.groupBy(*keys, "day").agg(
        F.count("obs").alias("n"), F.sum(one).alias("crps"), F.sum(S.covered("obs", "q")).alias("coverage_80pct"),
        F.sum(S.width("q")).alias("interval_width"),
        *[F.avg(one - F.col(f"crps_{r}")).alias(f"d_{r}") for r in references]))
    scored = materialise(days.groupBy(*keys).agg(F.sum("n").alias("n"), *[(F.sum(m) / F.sum("n")).alias(m) for m in metrics])
                         .join(counts, keys))
    diffs = F.explode(F.array(*[F.struct(F.lit(r).alias("ref"), F.col(f"d_{r}").alias("d")) for r in references]))
    each = days.where("arm = 'contiguous'").select(*keys, "day", diffs.alias("_p")).select(
        *keys, F.col("day").alias("valid_time"), "_p.ref", "_p.d")
    hac = G.robust_comparison(each, [*keys, "ref"], F.col("d"))
    names = [c for c in hac.columns if c not in [*keys, "ref"]]
    wide = hac.groupBy(*keys).agg(*[F.max(F.when(F.col("ref") == r, F.col(c))).alias(f"hac_{r}_{c}") for r in references for c in names])
    day = G.paired_block_test(G.block_means(each.where(F.col("ref") == list(references)[0]), keys, F.to_date("valid_time"), F.col("d")),
                              keys)
    spread = [F.lit(None).cast("double").alias(f"{m}_std") for m in metrics]
    kept = ["season", "arm", "k", "method", "n", *metrics, *[f"{m}_std" for m in metrics], "n_stations"]
    out = scored.where("arm = 'contiguous'").select("*", *spread).join(day, keys, "left").join(wide, keys, "left").drop("seed")
    means = random_arm(scored.where("arm = 'random'"), ["season", "k", "method"], metrics, population=True).withColumns(
        {"arm": F.lit("random"), "n": F.lit(None).cast("bigint"), "n_stations": F.lit(None).cast("bigint")}).select(*kept)
    lines = None
    for name, q in references.items():
        part = te.withColumn("q", q).groupBy("season").agg(*S.bundle("obs", "q")).withColumn("method", F.lit(name))
        lines = part if lines is None else lines.unionByName(part)
    lines = lines.withColumns({"arm": F.lit("n_independent"), "k": F.lit(None).cast("int"), "n_stations": F.lit(None).cast("bigint")}) \
        .select("*", *spread).select(*kept)
    return out.unionByName(means, allowMissingColumns=True).unionByName(lines, allowMissingColumns=True)


def seasonal_breakpoints(table: DataFrame, reference: str, alpha: float = 0.05) -> DataFrame:
    """Crossings of a seasonal sweep with a reference by season, method, arm and metric, and the least size from which the CRPS is
    lower and significantly so (recent cases)."""
    curve = table.where("arm <> 'n_independent'").select("season", "arm", "method", "k", *CROSSED)
    line = table.where((F.col("arm") == "n_independent") & (F.col("method") == reference)).select(
        "season", *[F.col(m).alias(f"_ref_{m}") for m in CROSSED])
    found = crossings(curve.join(line, "season"), ["season", "arm", "method"])
    durable = G.first_durable_significance(table.where("arm = 'contiguous'"), ["season", "method"], "k", f"hac_{reference}_mean_diff",
                                           f"hac_{reference}_dm_pvalue", alpha)
    durable = durable.withColumns({"arm": F.lit("contiguous"), "metric": F.lit("crps"), "first_days": cases_to_days(F.col("first_k"))})
    return found.join(durable, ["season", "method", "arm", "metric"], "left")
