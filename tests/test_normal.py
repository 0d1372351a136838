from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
from pyspark.sql import functions as F

from foresift.functions import normal as N


def test_cdf_and_crps_against_erfc(spark, con):
    zs = np.linspace(-9, 9, 181)
    df = spark.createDataFrame([(float(z),) for z in zs], "z double")
    got = df.select("z", F.expr(N.cdf_sql("z")).alias("p"), F.expr(N.phi_sql("z")).alias("d")).collect()
    for r in got:
        assert abs(r["p"] - 0.5 * math.erfc(-r["z"] / math.sqrt(2))) < 1e-15
        assert abs(r["d"] - NormalDist().pdf(r["z"])) < 1e-15
    np.testing.assert_allclose(N.cdf_np(zs), [0.5 * math.erfc(-z / math.sqrt(2)) for z in zs], atol=1e-15)
    assert con.execute(f"SELECT {N.cdf_sql('z')} FROM (SELECT 1.5::DOUBLE AS z)").fetchall()[0][0] == N.cdf_np(np.array(1.5))


def test_gaussian_crps_hand_values(spark):
    df = spark.createDataFrame([(0.0, 1.0, 0.0), (2.0, 3.0, -1.0)], "mu double, sigma double, y double")
    got = [r[0] for r in df.select(N.gaussian_crps("mu", "sigma", "y")).collect()]
    nd = NormalDist()
    want = [s * (z * (2 * nd.cdf(z) - 1) + 2 * nd.pdf(z) - 1 / math.sqrt(math.pi)) for z, s in ((0.0, 1.0), (-1.0, 3.0))]
    np.testing.assert_allclose(got, want, atol=1e-12)


def test_student_t_table(spark, con):
    """Two-sided 5 % and 1 % points from printed tables."""
    table = [(1, 12.706, 0.05), (2, 4.303, 0.05), (3, 3.182, 0.05), (4, 2.776, 0.05), (9, 2.262, 0.05), (10, 3.169, 0.01),
             (29, 2.045, 0.05), (30, 2.750, 0.01), (120, 1.980, 0.05), (570, 1.964, 0.05)]
    df = spark.createDataFrame([(n, t) for n, t, _ in table], "n long, t double")
    got = {r["n"]: r["p"] for r in df.select("n", N.t_two_sided_p(F.col("t"), F.col("n")).alias("p")).collect()}
    for n, t, p in table:
        assert abs(got[n] - p) < 4e-4
        sql = con.execute(f"SELECT {N.t_two_sided_p_sql('t', 'dof')} FROM (SELECT {t}::DOUBLE AS t, {n} AS dof)").fetchall()
        assert abs(sql[0][0] - got[n]) < 1e-12


def test_quantile_points():
    assert abs(N.z_values([0.975])[0] - 1.959963984540054) < 1e-12
