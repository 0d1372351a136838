"""Scores and calibration measures of a quantile array column.

Functions take column names (or any SQL text) for the observation and the quantile array. The levels are known when the plan
is built, so every score is unrolled into plain arithmetic over `q[i]`: it stays inside generated code, which lambda
functions over arrays would leave.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Forecast levels, tail levels and the central band of the experiment.
LEVELS = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)
TAIL_LEVELS = (0.8, 0.9)
BAND = (0.1, 0.9)


def level_index(levels, wanted: float) -> int:
    if wanted not in levels:
        raise ValueError(f"level {wanted} is not among {list(levels)}")
    return list(levels).index(wanted)


def _d(x: float) -> str:
    return f"{float(x)!r}D"


def checked(q: str, levels=LEVELS) -> Column:
    """q, or a run-time error if its length is not the number of levels."""
    return F.expr(f"if(size({q}) = {len(levels)}, {q}, raise_error('quantile array must have {len(levels)} entries'))")


def pinball_sql(y: str, q: str, tau: float) -> str:
    return f"greatest({_d(tau)}*({y}-{q}), {_d(tau - 1.0)}*({y}-{q}))"


def pinball(y: str, q: str, tau: float) -> Column:
    """Loss of one quantile (`q` names a scalar)."""
    return F.expr(pinball_sql(y, q, tau))


def _mean_pinball(y, q, levels, wanted) -> str:
    terms = [pinball_sql(y, f"{q}[{level_index(levels, t)}]", t) for t in wanted]
    return f"(2.0D*({' + '.join(terms)})/{_d(len(terms))})"


def crps(y: str, q: str, levels=LEVELS) -> Column:
    return F.expr(_mean_pinball(y, q, levels, levels))


def upper_crps(y: str, q: str, levels=LEVELS, tail=TAIL_LEVELS) -> Column:
    return F.expr(_mean_pinball(y, q, levels, tail))


def median_sql(q: str, levels=LEVELS) -> str:
    return f"{q}[{level_index(levels, 0.5)}]"


def abs_error(y: str, q: str, levels=LEVELS) -> Column:
    return F.expr(f"abs({y}-{median_sql(q, levels)})")


def covered(y: str, q: str, levels=LEVELS, band=BAND) -> Column:
    """1.0 inside the closed band, 0.0 outside; an inverted band is an error."""
    lo, hi = (f"{q}[{level_index(levels, b)}]" for b in band)
    return F.expr(f"CASE WHEN {lo} > {hi} THEN double(raise_error('lower quantile exceeds upper quantile')) "
                  f"WHEN {y} >= {lo} AND {y} <= {hi} THEN 1.0D ELSE 0.0D END")


def width(q: str, levels=LEVELS, band=BAND) -> Column:
    return F.expr(f"{q}[{level_index(levels, band[1])}] - {q}[{level_index(levels, band[0])}]")


def quantile_rank(y: str, q: str, levels=LEVELS) -> Column:
    """Number of quantiles strictly below the observation."""
    return F.expr(" + ".join(f"if({q}[{i}] < {y}, 1, 0)" for i in range(len(levels))))


def monotone_sql(q: str, levels=LEVELS) -> str:
    return "(" + " AND ".join(f"{q}[{i}] <= {q}[{i + 1}]" for i in range(len(levels) - 1)) + ")"


def is_monotone(q: str, levels=LEVELS) -> Column:
    return F.expr(monotone_sql(q, levels))


def pit(y: str, q: str, levels=LEVELS) -> Column:
    """Level at which the quantile function reaches y, interpolated and clipped to the outer levels.

    On tied quantiles the right-most level counts. Crossing quantiles are an error.
    """
    last = len(levels) - 1
    text = f"CASE WHEN NOT {monotone_sql(q, levels)} THEN double(raise_error('quantile crossing'))"
    text += f" WHEN {y} >= {q}[{last}] THEN {_d(levels[last])} WHEN {y} < {q}[0] THEN {_d(levels[0])}"
    for i in range(last - 1, -1, -1):
        step = f"{_d(levels[i + 1] - levels[i])}*({y}-{q}[{i}])/nullif({q}[{i + 1}]-{q}[{i}], 0.0D)"
        text += f" WHEN {y} >= {q}[{i}] THEN {_d(levels[i])} + {step}"
    return F.expr(text + " END")


def skill(score: str, reference: str) -> Column:
    return F.expr(f"1D - {score}/{reference}")


def bundle(y: str, q: str, levels=LEVELS) -> list[Column]:
    """Aggregates of the headline metrics in one pass."""
    return [F.count(y).alias("n"), F.avg(crps(y, q, levels)).alias("crps"),
            F.avg(upper_crps(y, q, levels)).alias("upper_crps"),
            F.avg(covered(y, q, levels)).alias("coverage_80pct"),
            F.avg(width(q, levels)).alias("interval_width")]


def error_bundle(y: str, q: str, levels=LEVELS) -> list[Column]:
    e = f"({median_sql(q, levels)}-{y})"
    return [F.expr(f"avg({e})").alias("bias"), F.expr(f"avg(abs({e}))").alias("mae"),
            F.expr(f"sqrt(avg({e}*{e}))").alias("rmse")]
