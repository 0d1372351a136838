"""Standard normal and Student t expressions.

The texts built here are valid in Spark SQL and in any ANSI engine, so a query and its cross-check can share the
same arithmetic; `tests/test_normal.py` checks them against the standard library.
"""
from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Rational approximation of the normal distribution function (Hart 1968; West 2005).
HART_NUM = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383,
            112.079291497871, 221.213596169931, 220.206867912376)
HART_DEN = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461,
            296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
HART_SPLIT = 7.07106781186547
SQRT_2PI = math.sqrt(2.0 * math.pi)
INV_SQRT_PI = 1.0 / math.sqrt(math.pi)


def _lit(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def _horner(coefs, x: str) -> str:
    text = _lit(coefs[0])
    for c in coefs[1:]:
        text = f"({text}*{x}+{_lit(c)})"
    return text


def phi_sql(z: str) -> str:
    """Normal density of column `z`."""
    return f"(exp(-0.5*{z}*{z})/{_lit(SQRT_2PI)})"


def cdf_sql(z: str) -> str:
    """Normal distribution function of column `z`."""
    a = f"abs({z})"
    body = f"exp(-0.5*{z}*{z})*{_horner(HART_NUM, a)}/{_horner(HART_DEN, a)}"
    tail = f"exp(-0.5*{z}*{z})/({a}+1.0/({a}+2.0/({a}+3.0/({a}+4.0/({a}+0.65)))))/{_lit(SQRT_2PI)}"
    lower = f"CASE WHEN {a} > 37 THEN 0.0 WHEN {a} < {HART_SPLIT} THEN {body} ELSE {tail} END"
    return f"(CASE WHEN {z} > 0 THEN 1.0-({lower}) ELSE ({lower}) END)"


def crps_sql(z: str, sigma: str) -> str:
    """CRPS of N(mu, sigma^2) at y, given z = (y - mu) / sigma."""
    return f"({sigma}*({z}*(2.0*{cdf_sql(z)}-1.0)+2.0*{phi_sql(z)}-{_lit(INV_SQRT_PI)}))"


def gaussian_crps(mu: str, sigma: str, y: str) -> Column:
    """CRPS of a normal forecast from column names."""
    z = f"(({y}-{mu})/{sigma})"
    return F.expr(crps_sql(z, sigma))


def z_values(levels) -> list[float]:
    nd = NormalDist()
    return [nd.inv_cdf(t) for t in levels]


def _horner_np(coefs, x: np.ndarray) -> np.ndarray:
    out = coefs[0] * x
    for c in coefs[1:-1]:
        out += c
        out *= x
    out += coefs[-1]
    return out


def cdf_np(z: np.ndarray, bell: np.ndarray | None = None) -> np.ndarray:
    """Vectorised counterpart of `cdf_sql` for the grouped fits; `bell` is exp(-z * z / 2), if known."""
    a = np.abs(np.atleast_1d(z))
    e = np.exp(-0.5 * a * a) if bell is None else bell
    low = e * _horner_np(HART_NUM, a) / _horner_np(HART_DEN, a)
    far = a >= HART_SPLIT
    if far.any():
        b = a[far]
        low[far] = e[far] / (b + 1 / (b + 2 / (b + 3 / (b + 4 / (b + 0.65))))) / SQRT_2PI
    return np.where(z > 0, 1.0 - low, low)


def t_two_sided_p(t: Column, dof: Column) -> Column:
    """Two-sided Student t p-value for an integer number of degrees of freedom.

    Uses the finite trigonometric series of the t distribution, evaluated with array functions: it runs on one row
    per comparison, after all aggregation.
    """
    v = dof.cast("int")
    theta = F.atan(F.abs(t) / F.sqrt(v.cast("double")))
    c, s = F.cos(theta), F.sin(theta)
    odd = (v % 2) == 1
    steps = F.when(v >= 4 + (v % 2), F.sequence(F.when(odd, 3).otherwise(2), v - 2, F.lit(2))).otherwise(
        F.array().cast("array<int>"))
    first = F.when(odd, c).otherwise(F.lit(1.0))
    series = F.aggregate(
        steps,
        F.struct(first.alias("term"), first.alias("total")),
        lambda acc, j: F.struct(
            (acc["term"] * (j - 1) / j * c * c).alias("term"),
            (acc["total"] + acc["term"] * (j - 1) / j * c * c).alias("total")),
        lambda acc: acc["total"])
    inner = (F.when(v == 1, 2.0 / math.pi * theta)
             .when(odd, 2.0 / math.pi * (theta + s * series))
             .otherwise(s * series))
    return F.when(t.isNull() | v.isNull() | (v < 1), F.lit(None).cast("double")).otherwise(
        F.greatest(F.lit(0.0), 1.0 - inner))


def t_two_sided_p_sql(t: str, dof: str) -> str:
    """The same series as `t_two_sided_p`, as a DuckDB expression over columns `t` and `dof` (integer)."""
    th = f"atan(abs({t})/sqrt({dof}))"
    c2 = f"(cos({th})*cos({th}))"
    ser = (f"list_sum([CASE WHEN {dof}%2=1 THEN cos({th}) ELSE 1.0 END * "
           f"coalesce(list_product([(j-1.0)/j*{c2} for j in range(2+{dof}%2, m+1, 2)]), 1.0) "
           f"for m in range({dof}%2, {dof}-1, 2)])")
    return (f"(CASE WHEN {t} IS NULL OR {dof} < 1 THEN NULL ELSE greatest(0.0, 1.0-(CASE WHEN {dof}=1 THEN 2/pi()*{th} "
            f"WHEN {dof}%2=1 THEN 2/pi()*({th}+sin({th})*({ser.replace('range(' + dof + '%2,', 'range(1,')})) "
            f"ELSE sin({th})*({ser.replace('range(' + dof + '%2,', 'range(0,')}) END)) END)")
