"""Distributional regression N(a + b mean [+ e last_obs], exp(c) + exp(d) var) by minimum CRPS, for many fits at once.

A step is damped Fisher scoring, and Newton's near the minimum. It needs only per-fit sums of loss, gradient, expected and exact
curvature. Two ways to get the sums:

* small fits are packed into hash buckets of bounded size, and a task runs all fits of its bucket to convergence;
* a fit with more than `max_group_rows` rows never meets in one task: each iteration is one aggregation with map-side
  combine, and only the sums of these few large fits (at most rows / max_group_rows) reach the driver.
"""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foresift.functions.normal import INV_SQRT_PI, SQRT_2PI, cdf_np, cdf_sql, phi_sql, z_values
from foresift.functions.scores import LEVELS
from foresift.sources.storage import materialise

MAX_GROUP_ROWS = 1_000_000
WARM_ROWS = 20_000
BUCKET_ROWS = 250_000
# rows of a pass over all terms: their lines stay in the cache of a core
CHUNK_ROWS = 1 << 12
LOG_BOUND = 40.0
# gain, as part of the loss, below which Newton steps are taken
NEAR = 1e-4
# a fit met the stop rule, met it with a log variance at its bound, or kept its best parameters when iterations ran out
CONVERGED, AT_BOUND, STOPPED = "converged", "bound", "stopped"


def param_names(predictors) -> list[str]:
    return ["a", "b", "c", "d"] + (["e"] if len(predictors) > 1 else [])


class Scoring:
    """State of all fits of one task or one lockstep run: damping, best parameters, and the sums at them."""

    def __init__(self, n_fits: int, n_loc: int, tol: float = 1e-13, start: np.ndarray | None = None):
        self.p, self.tol = n_loc, tol
        self.patience = 3           # small gains in a row that end a fit
        self.best = np.zeros((n_fits, n_loc + 2))
        self.best[:, 1] = 1.0
        if start is not None:
            self.best[:] = start
        self.trial = self.best.copy()
        self.loss = np.full(n_fits, np.inf)
        self.damp = np.full(n_fits, 1e-3)
        self.sums = None
        self.active = np.ones(n_fits, dtype=bool)
        self.calm = np.zeros(n_fits, dtype=int)
        self.near = np.zeros(n_fits, dtype=bool)        # the last step gained little: scoring has found the valley
        self.n_rows = np.zeros(n_fits)

    def update(self, ids: np.ndarray, sums: np.ndarray) -> None:
        """Takes the sums at the trial parameters of fits `ids` (columns: n, loss, gradient, both curvatures)."""
        if self.sums is None:
            self.sums = np.zeros((len(self.loss), sums.shape[1]))
        n = sums[:, 0]
        self.n_rows[ids] = n
        mean = sums / n[:, None]
        loss = mean[:, 1]
        old = self.loss[ids]
        ok = np.isfinite(mean).all(axis=1) & (loss <= old)
        gain = np.where(np.isfinite(old), old - loss, np.inf)
        good = ids[ok]
        self.best[good] = self.trial[good]
        self.loss[good] = loss[ok]
        self.sums[good] = mean[ok]
        self.damp[good] = np.maximum(self.damp[good] * 0.2, 1e-8)
        self.damp[ids[~ok]] *= 8.0
        # near the minimum the sums of a better step may come out higher by rounding
        small = np.abs(gain) <= self.tol * (1.0 + np.abs(loss))
        self.near[ids] = ok & (gain <= NEAR * (1.0 + np.abs(loss)))
        self.calm[ids[small]] += 1
        self.calm[ids[ok & ~small]] = 0
        self.active[ids] = (self.calm[ids] < self.patience) & (self.damp[ids] < 1e8)
        self._propose(ids[self.active[ids]])

    def status(self) -> np.ndarray:
        """Of each fit: whether it met the stop rule, and with a log variance at its bound, or ran out of iterations."""
        bound = (np.abs(self.best[:, self.p:]) >= LOG_BOUND).any(axis=1)
        return np.where(self.active, STOPPED, np.where(bound, AT_BOUND, CONVERGED))

    def _propose(self, ids: np.ndarray) -> None:
        """Next trial: a scoring step, or a Newton step where the fit is near a minimum and the exact curvature positive definite.

        Scoring finds the valley, and takes the long steps of a log variance that runs off to its bound; near the minimum, Newton
        needs a few steps where scoring may creep for thousands.
        """
        if not len(ids):
            return
        p, s, lam = self.p, self.sums[ids], self.damp[ids]
        g = s[:, 2:4 + p]
        pairs = p * (p + 1) // 2
        k = 4 + p
        h_loc = _symmetric(s[:, k:k + pairs], p)
        h_sc = _symmetric(s[:, k + pairs:k + pairs + 3], 2)
        k += pairs + 3
        exact = np.zeros((len(ids), p + 2, p + 2))
        exact[:, :p, :p] = _symmetric(s[:, k:k + pairs], p)
        mixed = s[:, k + pairs:k + pairs + 2 * p].reshape(-1, 2, p)
        exact[:, p:, :p] = mixed
        exact[:, :p, p:] = mixed.transpose(0, 2, 1)
        exact[:, p:, p:] = _symmetric(s[:, k + pairs + 2 * p:], 2)
        step = np.concatenate([_damped(h_loc, g[:, :p], lam), np.clip(_damped(h_sc, g[:, p:], lam), -3.0, 3.0)], axis=1)
        unit = np.sqrt(np.concatenate([np.einsum("fii->fi", h_loc), np.einsum("fii->fi", h_sc)], axis=1) + 1e-300)
        fine = np.flatnonzero(self.near[ids] & (np.abs(step[:, p:]) < 3.0).all(axis=1))
        exact, unit = exact[fine], unit[fine]
        scaled = exact / (unit[:, :, None] * unit[:, None, :]) + lam[fine, None, None] * np.eye(p + 2)
        finite = np.isfinite(scaled).all(axis=(1, 2))
        value, vector = np.linalg.eigh(np.where(finite[:, None, None], scaled, np.eye(p + 2)))
        newton = np.einsum("fij,fj->fi", vector, np.einsum("fji,fj->fi", vector, g[fine] / unit) / np.maximum(value, 1e-9)) / unit
        good = finite & (value[:, 0] > 1e-9) & np.isfinite(newton).all(axis=1) & (np.abs(newton[:, p:]) < 3.0).all(axis=1)
        step[fine[good]] = newton[good]
        self.trial[ids] = self.best[ids] - step
        self.trial[ids, p:] = np.clip(self.trial[ids, p:], -LOG_BOUND, LOG_BOUND)


def _symmetric(upper: np.ndarray, n: int) -> np.ndarray:
    """Symmetric matrices from their upper triangles, row by row."""
    out = np.zeros((len(upper), n, n))
    i, j = np.triu_indices(n)
    out[:, i, j] = out[:, j, i] = upper
    return out


def _damped(h: np.ndarray, g: np.ndarray, lam: np.ndarray) -> np.ndarray:
    diag = np.einsum("fii->fi", h)
    ridge = diag * lam[:, None] + 1e-14 * (1.0 + diag.max(axis=1, keepdims=True))
    if h.shape[1] == 2:
        # elimination by hand: a library call per fit costs more than the rows of a small fit
        mixed, first = h[:, 0, 1], h[:, 0, 0] + ridge[:, 0]
        ratio = mixed / first
        second = (g[:, 1] - ratio * g[:, 0]) / (h[:, 1, 1] + ridge[:, 1] - ratio * mixed)
        step = np.stack([(g[:, 0] - mixed * second) / first, second], axis=1)
        if np.isfinite(step).all():
            return step
    m = h + np.einsum("fi,ij->fij", ridge, np.eye(h.shape[1]))
    try:
        return np.linalg.solve(m, g[..., None])[..., 0]
    except np.linalg.LinAlgError:
        return np.einsum("fij,fj->fi", np.linalg.pinv(m), g)


def row_terms(theta: np.ndarray, x: np.ndarray, v: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Per-row loss, gradient, expected and exact curvature terms; `theta` has one parameter row per data row."""
    p = x.shape[1]
    return _term_lines(theta.T[:p], np.exp(theta[:, p]), np.exp(theta[:, p + 1]), x.T, v, y).T


def _term_lines(loc, ec: np.ndarray, ed: np.ndarray, x, v: np.ndarray, y: np.ndarray) -> np.ndarray:
    """`row_terms` with a line per term; `loc` and `x` have a line per location parameter, the first of `x` holds ones."""
    p = len(x)
    edv = ed * v
    sg = np.sqrt(ec + edv + 1e-300)
    mu = loc[0] + loc[1] * x[1]
    for i in range(2, p):
        mu += loc[i] * x[i]
    z = np.clip((y - mu) / sg, -1e150, 1e150)
    bell = np.exp(-0.5 * z * z)
    cdf, pdf = cdf_np(z, bell), bell / SQRT_2PI
    g_mu, g_sg = 1.0 - 2.0 * cdf, 2.0 * pdf - INV_SQRT_PI
    half = 0.5 / sg
    jc, jd = ec * half, edv * half
    cc, cd, dd = jc * jc, jc * jd, jd * jd
    w, mm = INV_SQRT_PI / sg, 2.0 * pdf / sg
    ms = mm * z
    turn = ms * z - g_sg / sg
    s_c, s_d = g_sg * jc, g_sg * jd
    times = lambda f, i: f * x[i] if i else f       # noqa: E731
    products = [times(x[j], i) for i in range(p) for j in range(i, p)]
    lines = [sg * (g_sg - z * g_mu), *(times(g_mu, i) for i in range(p)), s_c, s_d, w, *(w * s for s in products[1:]),
             0.5 * w * cc, 0.5 * w * cd, 0.5 * w * dd, mm, *(mm * s for s in products[1:])]
    lines += [times(ms * j, i) for j in (jc, jd) for i in range(p)]
    lines += [turn * cc + s_c, turn * cd, turn * dd + s_d]
    out = np.empty((len(lines) + 1, len(y)))
    out[0] = 1.0
    for i, line in enumerate(lines):
        out[i + 1] = line
    return out


def fit_segments(x: np.ndarray, v: np.ndarray, y: np.ndarray, fit: np.ndarray, n_fits: int,
                 max_iter: int) -> Scoring:
    """All fits of one task; `fit` is the ascending fit number of each row."""
    p = x.shape[1]
    state = Scoring(n_fits, p)
    x = np.ascontiguousarray(x.T)
    with np.errstate(all="ignore"):
        for _ in range(max_iter):
            ids = np.flatnonzero(state.active)
            if not len(ids):
                break
            going = state.active[fit]
            if not going.all():         # rows of ended fits leave
                x, v, y, fit = x[:, going], v[going], y[going], fit[going]
            theta = np.array(state.trial.T, order="C")        # a copy: both log variances are replaced
            theta[p:] = np.exp(theta[p:])
            sums = None
            for lo in range(0, len(fit), CHUNK_ROWS):
                f = fit[lo:lo + CHUNK_ROWS]
                t = theta[:, f]
                terms = _term_lines(t[:p], t[p], t[p + 1], x[:, lo:lo + CHUNK_ROWS], v[lo:lo + CHUNK_ROWS], y[lo:lo + CHUNK_ROWS])
                starts = np.flatnonzero(np.r_[True, f[1:] != f[:-1]])
                part = np.add.reduceat(terms, starts, axis=1)
                if sums is None:
                    sums = np.zeros((n_fits, len(part)))
                sums[f[starts]] += part.T
            state.update(ids, sums[ids])
    return state


def fit_frame(pdf: pd.DataFrame, keys: list[str], predictors, var: str, obs: str, max_iter: int,
              min_rows: int = 1) -> pd.DataFrame:
    """Fits every key group of one pandas frame with at least `min_rows` rows; one output row per group.

    Groups of a few rows are left out before the fit: they are met exactly, and run off for hundreds of iterations.
    """
    return _fit_sorted(pdf.sort_values(keys, kind="stable"), keys, predictors, var, obs, max_iter, min_rows)


def _fit_sorted(pdf: pd.DataFrame, keys: list[str], predictors, var: str, obs: str, max_iter: int, min_rows: int) -> pd.DataFrame:
    """`fit_frame` of rows that lie together by key."""
    names = param_names(predictors)
    changed = np.zeros(len(pdf), dtype=bool)
    changed[:1] = True
    for k in keys:
        col = pdf[k].to_numpy()
        changed[1:] |= col[1:] != col[:-1]
    if min_rows > 1:
        sizes = np.diff(np.append(np.flatnonzero(changed), len(pdf)))
        enough = np.repeat(sizes >= min_rows, sizes)
        pdf, changed = pdf[enough], changed[enough]
    fit = np.cumsum(changed) - 1
    x = np.column_stack([np.ones(len(pdf))] + [pdf[c].to_numpy(dtype=float) for c in predictors])
    state = fit_segments(x, pdf[var].to_numpy(dtype=float), pdf[obs].to_numpy(dtype=float), fit, int(changed.sum()),
                         max_iter)
    out = pdf.loc[changed, keys].reset_index(drop=True)
    for name, col in zip(names, _ordered(state.best, len(predictors))):
        out[name] = col
    out["n_rows"] = state.n_rows.astype("int64")
    out["loss"], out["status"] = state.loss, state.status()
    return out


def _ordered(theta: np.ndarray, n_pred: int) -> list[np.ndarray]:
    """Columns in the order a, b, c, d[, e] from (location parameters..., c, d)."""
    p = n_pred + 1
    cols = [theta[:, 0], theta[:, 1], theta[:, p], theta[:, p + 1]]
    return cols + ([theta[:, 2]] if n_pred > 1 else [])


def model_schema(panel: DataFrame, keys: list[str], predictors) -> T.StructType:
    fields = [panel.schema[k] for k in keys]
    fields += [T.StructField(n, T.DoubleType()) for n in param_names(predictors)]
    return T.StructType(fields + [T.StructField("n_rows", T.LongType()), T.StructField("loss", T.DoubleType()),
                                  T.StructField("status", T.StringType())])


def fit_packed(panel: DataFrame, keys: list[str], group: list, predictors, var: str, obs: str,
               max_iter: int, min_rows: int = 1) -> DataFrame:
    """Runs the fits inside groups of bounded size (`group` columns must be functions of the fit keys)."""
    schema = model_schema(panel, keys, predictors)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return fit_frame(pdf, keys, predictors, var, obs, max_iter, min_rows)

    return panel.groupBy(*group).applyInPandas(run, schema)


def _sum_terms(predictors, var: str, obs: str, rows: DataFrame) -> DataFrame:
    mu = "_a + _b*" + predictors[0] + (f" + _e*{predictors[1]}" if len(predictors) > 1 else "")
    t = (rows.withColumn("_ec", F.exp("_c")).withColumn("_edv", F.exp("_d") * F.col(var))
         .withColumn("_sg", F.sqrt(F.col("_ec") + F.col("_edv") + F.lit(1e-300)))
         .withColumn("_z", F.expr(f"({obs} - ({mu})) / _sg"))
         .withColumn("_cdf", F.expr(cdf_sql("_z"))).withColumn("_pdf", F.expr(phi_sql("_z"))))
    return t


def _lockstep_aggregates(predictors) -> list[Column]:
    x = ["1D", *predictors]
    g_mu, g_sg = "(1D - 2D*_cdf)", f"(2D*_pdf - {INV_SQRT_PI!r}D)"
    jc, jd, w = "(_ec/(2D*_sg))", "(_edv/(2D*_sg))", f"({INV_SQRT_PI!r}D/_sg)"
    terms = ["1D", f"_sg*(_z*(2D*_cdf - 1D) + {g_sg})"]
    terms += [f"{g_mu}*{c}" for c in x] + [f"{g_sg}*{jc}", f"{g_sg}*{jd}"]
    terms += [f"{w}*{x[i]}*{x[j]}" for i in range(len(x)) for j in range(i, len(x))]
    terms += [f"0.5D*{w}*{jc}*{jc}", f"0.5D*{w}*{jc}*{jd}", f"0.5D*{w}*{jd}*{jd}"]
    mm, ms, turn = "(2D*_pdf/_sg)", "(2D*_pdf*_z/_sg)", f"((2D*_pdf*_z*_z - {g_sg})/_sg)"
    terms += [f"{mm}*{x[i]}*{x[j]}" for i in range(len(x)) for j in range(i, len(x))]
    terms += [f"{ms}*{c}*{j}" for j in (jc, jd) for c in x]
    terms += [f"{turn}*{jc}*{jc} + {g_sg}*{jc}", f"{turn}*{jc}*{jd}", f"{turn}*{jd}*{jd} + {g_sg}*{jd}"]
    return [F.expr(f"sum({t})").alias(f"_s{i}") for i, t in enumerate(terms)]


def drive(n_fits: int, n_loc: int, evaluate, max_iter: int, start: np.ndarray | None = None) -> Scoring:
    """Lockstep loop on the driver: one distributed evaluation per iteration, only sums come back."""
    state = Scoring(n_fits, n_loc, start=start)
    state.patience = 2          # each try is a pass over all rows, and near the minimum the steps are Newton's
    with np.errstate(all="ignore"):
        for _ in range(max_iter):
            ids = np.flatnonzero(state.active)
            if not len(ids):
                break
            state.update(ids, evaluate(ids, state.trial[ids]))
    return state


def status_of(settled: str, c: Column, d: Column) -> Column:
    """Status of fits whose convergence is a column of theirs."""
    bound = (F.abs(c) >= LOG_BOUND - 1e-9) | (F.abs(d) >= LOG_BOUND - 1e-9)
    return F.when(~F.col(settled), STOPPED).when(bound, AT_BOUND).otherwise(CONVERGED)


def _loc_scale(models: pd.DataFrame, predictors) -> np.ndarray:
    """Parameter matrix (location parameters..., c, d) of a model frame."""
    names = ["a", "b"] + (["e"] if len(predictors) > 1 else []) + ["c", "d"]
    return models[names].to_numpy(dtype=float)


def _warm_start(panel: DataFrame, keys: list[str], fits: pd.DataFrame, predictors, var: str, obs: str) -> np.ndarray:
    # every fit gives about WARM_ROWS rows, however much larger than the others it is
    sizes = F.broadcast(panel.sparkSession.createDataFrame(fits[[*keys, "_n"]]))         # one row per large fit
    draw = F.pmod(F.xxhash64(*panel.columns), F.lit(1 << 30)) / float(1 << 30)
    some = panel.join(sizes, keys).where(draw < F.lit(float(WARM_ROWS)) / F.col("_n")).select(*panel.columns)
    start = np.zeros((len(fits), len(predictors) + 3))
    start[:, 1] = 1.0
    bucketed = some.withColumn("_bucket", F.pmod(F.hash(*keys), F.lit(max(1, len(fits)))))
    got = fit_packed(bucketed, keys, ["_bucket"], predictors, var, obs, 5000).toPandas()
    at = {tuple(k): i for i, k in enumerate(fits[keys].itertuples(index=False, name=None))}
    for k, row in zip(got[keys].itertuples(index=False, name=None), _loc_scale(got, predictors)):
        if np.isfinite(row).all():
            start[at[tuple(k)]] = row
    return start


def fit_lockstep(panel: DataFrame, keys: list[str], fits: pd.DataFrame, predictors, var: str, obs: str,
                 max_iter: int) -> DataFrame:
    """Fits of any size. `panel` should be a stored table, since every iteration scans it.

    A first fit on a hashed part of the rows only supplies the starting point; it saves most of the full scans.
    """
    spark = panel.sparkSession
    start = _warm_start(panel, keys, fits, predictors, var, obs)
    names = ["_" + n for n in param_names(predictors)]
    key_schema = T.StructType([panel.schema[k] for k in keys] + [T.StructField("_fit", T.LongType())]
                              + [T.StructField(n, T.DoubleType()) for n in names])

    def evaluate(ids, theta):
        params = fits.loc[ids, keys].copy()
        params["_fit"] = ids
        for n, col in zip(names, _ordered(theta, len(predictors))):
            params[n] = col
        local = F.broadcast(spark.createDataFrame(params, key_schema))    # one row per large fit: bounded, see module text
        rows = _sum_terms(predictors, var, obs, panel.join(local, keys))
        got = rows.groupBy("_fit").agg(*_lockstep_aggregates(predictors)).toPandas()
        got = got.set_index("_fit").loc[ids]
        return got[[f"_s{i}" for i in range(got.shape[1])]].to_numpy(dtype=float)

    state = drive(len(fits), len(predictors) + 1, evaluate, max_iter, start)
    out = fits[keys].copy()
    for n, col in zip(param_names(predictors), _ordered(state.best, len(predictors))):
        out[n] = col
    out["n_rows"], out["loss"], out["status"] = state.n_rows.astype("int64"), state.loss, state.status()
    return spark.createDataFrame(out, model_schema(panel, keys, predictors))


def fit_emos(panel: DataFrame, keys: list[str] = (), predictors=("ens_mean",), var: str = "ens_var",
             obs: str = "t2m_obs", min_rows: int = 1, max_group_rows: int = MAX_GROUP_ROWS,
             max_iter: int = 5000, lockstep_iter: int = 500, cheap_scan: bool = False) -> DataFrame:
    """One model row (keys, a, b, c, d[, e], n_rows, loss, status) per key group with at least `min_rows` rows.

    The models are stored, so that every use reads parameters instead of fitting again, and the join to the rows to predict
    is planned with their true size. `cheap_scan` says that the panel is a stored table behind narrow steps: large fits then
    rescan it instead of storing their own copy of the rows.
    """
    keys = list(keys) or ["_all"]
    rows = panel if keys != ["_all"] else panel.withColumn("_all", F.lit(0))
    rows = rows.select(*keys, *predictors, var, obs).dropna()
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_rows)
    large = sizes.where(F.col("_n") > max_group_rows)
    total = sizes.agg(F.sum("_n").alias("rows"), F.count(F.lit(1)).alias("fits"), F.max("_n").alias("top")).first()
    if total["rows"] is None:
        return panel.sparkSession.createDataFrame([], model_schema(rows, keys, predictors)).drop("_all")
    out = None
    has_large = total["top"] > max_group_rows
    n_buckets = int(max(math.ceil(total["rows"] / BUCKET_ROWS),
                        min(total["fits"], panel.sparkSession.sparkContext.defaultParallelism)))
    if not has_large or total["fits"] > 1:
        small = rows
        if has_large:
            small = small.join(large.select(*keys), keys, "left_anti")
        # as many partitions as buckets: merged by bytes there would be fewer tasks than cores
        bucketed = small.withColumn("_bucket", F.pmod(F.hash(*keys), F.lit(n_buckets))).repartition(n_buckets, "_bucket")
        # groups below the minimum are dropped in their bucket, which saves a join of the panel
        out = materialise(fit_packed(bucketed, keys, ["_bucket"], predictors, var, obs, max_iter, min_rows))
    if has_large:
        fits = large.toPandas()
        of_large = rows.join(large.select(*keys), keys, "left_semi") if out is not None else rows
        stored = of_large if cheap_scan else materialise(of_large)
        big = fit_lockstep(stored, keys, fits, predictors, var, obs, lockstep_iter)
        out = big if out is None else out.unionByName(big)
    return out.drop("_all")


def fit_nested(panel: DataFrame, keys: list[str], tiers: dict[str, tuple[list[str], int]], ks: list[int], rank: str, total: str,
               min_rows: int = 1, max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Fits on the first k of the ranked parts of every key group, for each size and several tiers of further keys.

    A tier names its keys and its least size. Sizes from the number of parts (`total`) on stand for all of them. Rows are shuffled
    once by `keys`, and the sets of a row exist only inside tasks. One model row per fit: `tier`, keys, k, the further keys of all
    tiers (NULL where a tier has none), parameters. Key groups of more than `max_group_rows` rows are expanded and fitted by `fit_emos`.
    """
    further = list(dict.fromkeys(c for own, _ in tiers.values() for c in own))
    cols = [*keys, *further, rank, total, "ens_mean", "ens_var", "t2m_obs"]
    rows = panel.select(*cols).dropna()
    # the sets of a row: sizes above its rank and below the number of parts, and the whole
    sets = F.filter(F.array(*[F.lit(int(k)) for k in ks]), lambda k: (k > F.col(rank)) & (k < F.col(total)))
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.sum(F.size(sets) + 1).alias("_rows"))
    found = sizes.agg(F.max("_n").alias("top"), F.sum("_rows").alias("rows"), F.count(F.lit(1)).alias("groups")).first()
    fields = [T.StructField("tier", T.StringType()), *[rows.schema[k] for k in keys], T.StructField("k", T.IntegerType()),
              *[rows.schema[c] for c in further]]
    schema = T.StructType(fields + model_schema(rows, [], ("ens_mean",)).fields)
    if found["rows"] is None:
        return panel.sparkSession.createDataFrame([], schema)
    out = None
    if found["top"] > max_group_rows:
        large = sizes.where(F.col("_n") > max_group_rows).select(*keys)
        each = F.explode(F.concat(sets, F.array(F.col(total).cast("int"))))
        of_large = materialise(rows.join(large, keys, "left_semi").withColumn("k", each))
        for name, (own, least) in tiers.items():
            part = fit_emos(of_large.where(F.col("k") >= least), [*keys, "k", *own], min_rows=min_rows, cheap_scan=True)
            part = part.withColumns({"tier": F.lit(name), **{c: F.lit(None).cast(rows.schema[c].dataType) for c in further if c not in own}})
            part = part.select(*schema.names)
            out = part if out is None else out.unionByName(part)
        rows = rows.join(large, keys, "left_anti")
    n_buckets = int(max(math.ceil(found["rows"] / BUCKET_ROWS), min(found["groups"], panel.sparkSession.sparkContext.defaultParallelism)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        # keys as numbers: a comparison of strings row by row costs more than the sort
        codes = {c: pd.factorize(pdf[c]) for c in keys}
        pdf = pdf.assign(**{c: code for c, (code, _) in codes.items()}).sort_values([*keys, *further], kind="stable")
        at, n = pdf[rank].to_numpy(), pdf[total].to_numpy()
        whole = pd.concat([*[pdf[(at < k) & (k < n)].assign(k=k) for k in sorted(ks)], pdf.assign(k=n)], ignore_index=True)
        got = []
        for name, (own, least) in tiers.items():
            of = ["k", *keys, *own]
            part = whole[whole["k"] >= least] if least > 1 else whole
            if own != further[:len(own)]:
                part = part.sort_values(of, kind="stable")
            got.append(_fit_sorted(part, of, ("ens_mean",), "ens_var", "t2m_obs", 5000, min_rows).assign(tier=name))
        out = pd.concat(got, ignore_index=True)
        return out.assign(**{c: values.take(out[c].to_numpy()) for c, (_, values) in codes.items()}).reindex(columns=schema.names)

    # the number of partitions is named: by bytes Spark would merge them into fewer tasks than cores, and fits take time, not bytes
    bucketed = rows.withColumn("_bucket", F.pmod(F.hash(*keys), F.lit(n_buckets))).repartition(n_buckets, "_bucket")
    small = materialise(bucketed.groupBy("_bucket").applyInPandas(run, schema))
    return small if out is None else small.unionByName(out)


def gaussian_quantiles(mu: str, sigma: str, levels=LEVELS) -> Column:
    """Quantiles of N(mu, sigma^2) from the SQL text of both parameters."""
    return F.expr("array(" + ", ".join(f"({mu}) + ({sigma})*({z!r}D)" for z in z_values(levels)) + ")")


def emos_quantiles(predictors=("ens_mean",), var: str = "ens_var", levels=LEVELS) -> Column:
    """Quantiles from parameter columns a, b, c, d[, e] next to the predictors."""
    mu = f"a + b*{predictors[0]}" + (f" + e*{predictors[1]}" if len(predictors) > 1 else "")
    return gaussian_quantiles(mu, f"sqrt(exp(c) + exp(d)*{var})", levels)


def emos_predict(test: DataFrame, models: DataFrame, keys: list[str] = (), predictors=("ens_mean",),
                 var: str = "ens_var", levels=LEVELS, keep_uncovered: bool = False) -> DataFrame:
    """Adds `q`; rows without a model are dropped, or kept with NULL."""
    names = param_names(predictors)
    m = models.select(*keys, *names)
    joined = test.join(m, list(keys), "left" if keep_uncovered else "inner") if keys else test.crossJoin(
        F.broadcast(m))                                              # the pooled model is one row
    return joined.withColumn("q", F.when(F.col("a").isNotNull(), emos_quantiles(predictors, var, levels))).drop(*names)


def attach_models(test: DataFrame, models: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """Left-joins each model table once, as a struct column `_m_<name>`."""
    out = test
    for name, (table, keys) in models.items():
        m = table.select(*keys, F.struct("a", "b", "c", "d", "n_rows").alias(f"_m_{name}"))
        out = out.join(m, list(keys), "left")
    return out


def choose_tier(tiers: list[tuple[str, int]]) -> Column:
    """Parameters of the first attached model with at least its minimum rows, with the tier number; NULL if none."""
    options = []
    for i, (name, min_rows) in enumerate(tiers):
        m = F.col(f"_m_{name}")
        options.append(F.when(m["n_rows"] >= min_rows, F.struct(
            F.lit(i).alias("tier"), m["a"].alias("a"), m["b"].alias("b"), m["c"].alias("c"), m["d"].alias("d"))))
    return F.coalesce(*options)


def predict_variants(test: DataFrame, models: dict[str, tuple[DataFrame, list[str]]],
                     variants: dict[str, list[tuple[str, int]]], var: str = "ens_var", levels=LEVELS) -> DataFrame:
    """All variants (fallback chains over shared models) in one pass: adds method, tier and q."""
    joined = attach_models(test, models)
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("method"), choose_tier(t).alias("m")) for n, t in variants.items()]))
    out = joined.withColumn("_v", each).select(*test.columns, "_v.method", "_v.m.tier", "_v.m.a", "_v.m.b", "_v.m.c", "_v.m.d")
    # both moments first: inside the condition each quantile would compute them anew
    out = out.withColumns({"_mu": F.expr("a + b*ens_mean"), "_sg": F.expr(f"sqrt(exp(c) + exp(d)*{var})")})
    return out.withColumn("q", F.when(F.col("a").isNotNull(), gaussian_quantiles("_mu", "_sg", levels))).drop(
        "a", "b", "c", "d", "_mu", "_sg")


def predict_tiers(test: DataFrame, tiers: list[tuple[DataFrame, list[str], int]], var: str = "ens_var",
                  levels=LEVELS) -> DataFrame:
    """First tier whose model exists and was fitted on at least its minimum rows; NULL when none applies.

    Adds `q` and `tier` (0-based). Only parameters are joined per tier, the quantiles are computed once.
    """
    models = {str(i): (m, keys) for i, (m, keys, _) in enumerate(tiers)}
    return predict_variants(test, models, {"": [(str(i), t[2]) for i, t in enumerate(tiers)]}, var, levels).drop("method")
