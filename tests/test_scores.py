from __future__ import annotations

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from foresift.functions import scores as S
from foresift.operators import reports as R


def frame(spark, rows):
    return spark.createDataFrame([(float(y), [float(v) for v in q]) for y, q in rows], "obs double, q array<double>")


def one(df, col):
    return [r[0] for r in df.select(col).collect()]


def test_perfect_forecast_scores_zero(spark):
    df = frame(spark, [(3.0, [3.0] * 9)])
    assert one(df, S.crps("obs", "q")) == [0.0]
    assert one(df, S.upper_crps("obs", "q")) == [0.0]
    assert one(df, S.abs_error("obs", "q")) == [0.0]


def test_pinball_is_asymmetric(spark):
    df = frame(spark, [(1.0, [0.0] * 9), (-1.0, [0.0] * 9)])
    np.testing.assert_allclose(one(df, S.pinball("obs", "q[8]", 0.9)), [0.9, 0.1])


def test_hand_values(spark):
    q = list(range(1, 10))
    df = frame(spark, [(5.0, q), (9.5, q), (0.0, q)])
    y = np.array([5.0, 9.5, 0.0])[:, None]
    d = y - np.array(q)[None, :]
    t = np.array(S.LEVELS)
    loss = np.maximum(t * d, (t - 1) * d)
    np.testing.assert_allclose(one(df, S.crps("obs", "q")), 2 * loss.mean(axis=1))
    np.testing.assert_allclose(one(df, S.upper_crps("obs", "q")), 2 * loss[:, 7:].mean(axis=1))
    assert one(df, S.abs_error("obs", "q")) == [0.0, 4.5, 5.0]
    assert one(df, S.covered("obs", "q")) == [1.0, 0.0, 0.0]
    assert one(df, S.width("q")) == [8.0] * 3
    assert one(df, S.quantile_rank("obs", "q")) == [4, 9, 0]


def test_band_edges_count_as_covered_and_ranks_are_strict(spark):
    df = frame(spark, [(1.0, range(1, 10)), (9.0, range(1, 10))])
    assert one(df, S.covered("obs", "q")) == [1.0, 1.0]
    assert one(df, S.quantile_rank("obs", "q")) == [0, 8]


def test_pit(spark):
    q = [10.0 * t for t in S.LEVELS]
    df = frame(spark, [(5.0, q), (3.3, q), (-4.0, q), (99.0, q), (2.0, [1, 2, 2, 2, 5, 6, 7, 8, 9])])
    np.testing.assert_allclose(one(df, S.pit("obs", "q")), [0.5, 0.33, 0.1, 0.9, 0.4])


@pytest.mark.parametrize("col", [lambda: S.pit("obs", "q"), lambda: S.covered("obs", "q")])
def test_crossing_is_an_error(spark, col):
    with pytest.raises(PySparkException):
        frame(spark, [(5.0, range(9, 0, -1))]).select(col()).collect()


def test_wrong_length_and_absent_level(spark):
    with pytest.raises(PySparkException):
        frame(spark, [(5.0, range(8))]).select(S.checked("q")).collect()
    with pytest.raises(ValueError):
        S.level_index(S.LEVELS, 0.95)


def test_monotone(spark):
    df = frame(spark, [(0, range(9)), (0, [1] * 9), (0, [1, 2, 3, 4, 5, 4, 7, 8, 9])])
    assert one(df, S.is_monotone("q")) == [True, True, False]


def test_histograms_of_a_calibrated_forecast(spark):
    from statistics import NormalDist
    z = [NormalDist().inv_cdf(t) for t in S.LEVELS]
    n = 20_000
    # deterministic normal sample: equally spaced probabilities
    obs = [NormalDist().inv_cdf((i + 0.5) / n) for i in range(n)]
    df = spark.createDataFrame([(float(o),) for o in obs], "obs double").select(
        F.lit("m").alias("method"), "obs", F.array(*[F.lit(v) for v in z]).alias("q"))
    fractions = [r["fraction"] for r in R.rank_histogram(df).collect()]
    np.testing.assert_allclose(fractions, [0.1] * 10, atol=1e-3)
    # the PIT clips at the outer levels: the mass below 0.1 lands in bin 1, the mass above 0.9 in bin 9
    pit = {r["bin_index"]: r["frequency"] for r in R.pit_histogram(df).collect()}
    assert pit[0] == 0.0 and abs(pit[1] - 0.2) < 2e-3 and abs(pit[9] - 0.1) < 2e-3
    assert len(pit) == 10


def test_empty_bins_are_kept(spark):
    df = frame(spark, [(0.0, range(1, 10))]).withColumn("method", F.lit("m"))
    rows = R.rank_histogram(df).collect()
    assert sorted(r["bin_index"] for r in rows) == list(range(10))
    assert sum(r["fraction"] for r in rows) == 1.0
