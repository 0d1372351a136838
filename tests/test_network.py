from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from foresift.operators import network as NN
from foresift.operators import sampling as SM


def data(n_cases=40, stations=(0, 1, 2), bias=(-2.0, 0.0, 3.0), seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(n_cases):
        for s, b in zip(stations, bias):
            for step in (24.0, 48.0):
                m, v = rng.normal(280, 5), rng.uniform(0.5, 3)
                rows.append((s, c % 4, c // 4, step, m, v, m + b + rng.normal(0, 1)))
    return pd.DataFrame(rows, columns=["station_id", "year_idx", "time_idx", "step_hours", "ens_mean", "ens_var", "t2m_obs"])


def test_gradient_matches_finite_differences():
    rng = np.random.default_rng(1)
    shape = NN.Shape(3, 2)
    w = shape.initial(0) + rng.normal(0, 0.05, len(shape.initial(0)))
    n = 20
    x = {"m": rng.normal(size=n), "v": rng.normal(size=n), "base_mu": rng.normal(size=n), "base_ls2": rng.normal(0, 0.2, n),
         "s": rng.integers(0, 3, n), "l": rng.integers(0, 2, n), "y": rng.normal(size=n)}
    loss = lambda f: NN.losses(*NN.forward(shape, f, x)[:2], x["y"]).mean()
    g = NN.gradient(shape, w, x)
    for i in rng.choice(len(w), 40, replace=False):
        e = np.zeros_like(w)
        e[i] = 1e-6
        assert abs((loss(w + e) - loss(w - e)) / 2e-6 - g[i]) < 1e-6


def test_untrained_network_is_the_raw_gaussian(spark):
    df = spark.createDataFrame(data()).withColumn("fit_id", F.lit("a"))
    model = NN.fit_networks(df, {"a": 0}, rounds=0)
    for r in model.transform(df.drop("fit_id").limit(20)).collect():
        assert abs(r["mu"] - r["ens_mean"]) < 1e-9
        assert abs(r["sigma"] - np.sqrt(r["ens_var"])) < 1e-9


def test_station_bias_is_learned_and_best_round_kept(spark):
    df = spark.createDataFrame(data(120)).withColumn("fit_id", F.lit("a"))
    model = NN.fit_networks(df, {"a": 0}, rounds=6, local_steps=150)
    out = model.transform(df.drop("fit_id"))
    bias = {r[0]: r[1] for r in out.groupBy("station_id").agg(F.avg(F.col("mu") - F.col("ens_mean"))).collect()}
    assert bias[0] < -1 and bias[2] > 1.5
    assert min(model.history["a"]) < model.history["a"][0]
    assert len(model.history["a"]) == 7
    # a station that was never seen uses index 0 and still gets a forecast
    odd = model.transform(df.drop("fit_id").limit(5).withColumn("station_id", F.lit(99).cast("long")))
    assert odd.where("q is null").count() == 0


def test_tiny_set_takes_fixed_steps_without_validation(spark):
    df = spark.createDataFrame(data(3)).withColumn("fit_id", F.lit("a"))
    model = NN.fit_networks(df, {"a": 0}, rounds=5)
    assert model.history["a"] == []
    assert np.abs(model.shared["a"] - model.shape.initial(0)).max() > 0


def test_several_fits_together_equal_single_fits(spark):
    df = spark.createDataFrame(data(60))
    both = df.withColumn("fit_id", F.explode(F.array(F.lit("a"), F.lit("b"))))
    model = NN.fit_networks(both, {"a": 0, "b": 1}, rounds=2)
    alone = NN.fit_networks(df.withColumn("fit_id", F.lit("b")), {"b": 1}, rounds=2)
    np.testing.assert_allclose(model.history["b"], alone.history["b"], rtol=1e-6)
    assert model.history["a"] != model.history["b"]


def test_one_shard_equals_numpy(spark, monkeypatch):
    monkeypatch.setattr(NN, "MIN_SHARD_ROWS", 10 ** 9)
    pdf = data(60)
    df = spark.createDataFrame(pdf).withColumn("fit_id", F.lit("a"))
    model = NN.fit_networks(df, {"a": 3}, rounds=2, local_steps=20)
    split = SM.validation_split(df, 3, 0.1, row_key=["station_id", "step_hours"]).toPandas()
    loc, scale = split[["ens_mean", "ens_var", "t2m_obs"]].mean(), split[["ens_mean", "ens_var", "t2m_obs"]].std(ddof=0)
    x = {"m": (split["ens_mean"] - loc["ens_mean"]) / scale["ens_mean"], "v": (split["ens_var"] - loc["ens_var"]) / scale["ens_var"],
         "y": (split["t2m_obs"] - loc["t2m_obs"]) / scale["t2m_obs"],
         "base_mu": (split["ens_mean"] - loc["t2m_obs"]) / scale["t2m_obs"],
         "base_ls2": np.log(split["ens_var"] / scale["t2m_obs"] ** 2), "s": split["station_id"], "l": (split["step_hours"] > 24).astype(int)}
    x, held = {k: v.to_numpy() for k, v in x.items()}, split["is_val"].to_numpy()
    order = np.lexsort((x["y"], x["m"]))
    shape = NN.Shape(3, 2)
    flat = np.concatenate([NN.initial_embedding(3, [0, 1, 2]).ravel(), NN.Shape(0, 2).initial(3)])
    history = []
    for r in range(3):
        mu, sg, *_ = NN.forward(shape, flat, {k: v[held] for k, v in x.items()})
        history.append((NN.losses(mu, sg, x["y"][held]) * scale["t2m_obs"]).mean())
        fit = order[~held[order]]
        n = len(fit)
        flat = NN.adam_steps(shape, flat, {k: v[fit] for k, v in x.items()}, 20, max(256, n // 20), 3000 + r)
    np.testing.assert_allclose(model.history["a"], history, rtol=1e-6)


def test_a_shard_holds_its_stations_only_and_hot_ones_are_split(spark, monkeypatch):
    pdf = pd.concat([data(150, (0,), (-2.0,)), *[data(12, (s,), (1.0,), s) for s in range(1, 9)]])
    df = spark.createDataFrame(pdf).withColumn("fit_id", F.lit("a"))
    monkeypatch.setattr(NN, "MIN_SHARD_ROWS", 60)
    model = NN.fit_networks(df, {"a": 0}, rounds=2, local_steps=20)
    rows = model.embeddings.collect()
    assert sorted(r["s"] for r in rows) == list(range(9)) and all(len(r["value"]) == NN.EMBEDDING for r in rows)
    assert len(model.shared["a"]) == len(NN.Shape(0, 2).initial(0))       # the driver's part knows no stations
    shard = pd.DataFrame({"fit_id": "a", "is_val": False, "m": 0.1, "v": 0.2, "y": [0.3, 0.1], "base_mu": 0.1, "base_ls2": 0.0,
                          "s": [5, 70], "l": 0, "obs_scale": 1.0})
    own = pd.DataFrame({"fit_id": "a", "s": [70, 5], "value": [[1.0] * 4, [0.0] * 4]})
    out = NN.train_shard(shard, own, model.shared.copy(), 2, {"a": 0}, 0, set(), 3)
    assert sorted(out["key"]) == [NN.SHARED, 5, 70]


def test_a_station_outside_the_set_of_a_fit_is_unseen_by_it(spark):
    df = spark.createDataFrame(data(30))
    both = df.withColumn("fit_id", F.lit("all")).unionByName(df.where("station_id > 0").withColumn("fit_id", F.lit("some")))
    model = NN.fit_networks(both, {"all": 0, "some": 1}, rounds=1, local_steps=5)
    out = model.transform(df)
    assert out.groupBy("fit_id").count().collect() == [out.where("q is not null").groupBy("fit_id").count().collect()[i] for i in (0, 1)]
    assert out.where("fit_id = 'some'").count() == df.count()


def test_rounds_do_not_shuffle_the_rows(spark):
    """Shards lie in buckets of their keys: a cogroup with a small table exchanges that table alone."""
    from foresift.sources.storage import materialise_bucketed
    rows = spark.range(4000).selectExpr("cast(id % 3 as string) AS fit_id", "cast(id % 7 as int) AS shard", "id / 2D AS y")
    stored = materialise_bucketed(rows, ["fit_id", "shard"], 3)
    own = stored.select("fit_id", "shard").distinct()
    size = lambda pdf, other: pd.DataFrame({"n": [len(pdf)]})       # noqa: E731
    done = stored.groupBy("fit_id", "shard").cogroup(own.groupBy("fit_id", "shard")).applyInPandas(size, "n bigint")
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and done.groupBy().sum("n").first()[0] == 4000
    plain = rows.groupBy("fit_id", "shard").cogroup(own.groupBy("fit_id", "shard")).applyInPandas(size, "n bigint")
    assert "Exchange" in plain._jdf.queryExecution().executedPlan().toString()


def test_sets_of_cases_equal_rows_repeated_by_fit(spark, monkeypatch):
    """A row that stands in several sets is given once; its copies, packed in cells, train the same networks."""
    df = spark.createDataFrame(data(60))
    cases = df.select(*SM.CASE).distinct()
    sets = cases.withColumn("fit_id", F.lit("all")).unionByName(cases.where("year_idx < 9").withColumn("fit_id", F.lit("some")))
    monkeypatch.setattr(NN, "MIN_SHARD_ROWS", 120)
    monkeypatch.setattr(NN, "CELL_ROWS", 50)
    given, dealt = [], NN._dealt
    monkeypatch.setattr(NN, "_dealt", lambda rows, *rest: (given.append(rows.count()), dealt(rows, *rest))[1])
    one = NN.fit_networks(df, {"all": 0, "some": 1}, rounds=2, local_steps=10, sets=sets)
    many = NN.fit_networks(df.join(sets, SM.CASE), {"all": 0, "some": 1}, rounds=2, local_steps=10)
    assert given[0] == df.count() and given[1] == df.join(sets, SM.CASE).count() > given[0]
    for f in ("all", "some"):
        assert len(one.history[f]) == 3
        np.testing.assert_allclose(one.history[f], many.history[f], rtol=1e-5)
    a, b = (m.scales.toPandas().set_index("fit_id").sort_index() for m in (one, many))
    np.testing.assert_allclose(a[b.columns].astype(float), b.astype(float), rtol=1e-9)


def test_predictions_do_not_depend_on_the_buckets(spark, monkeypatch):
    """Rows meet the embeddings in buckets of stations; the bucket of a station with most rows is split."""
    pdf = pd.concat([data(100, (0,), (-2.0,)), data(5, (1, 2), (0.0, 3.0))])
    df = spark.createDataFrame(pdf).withColumn("fit_id", F.explode(F.array(F.lit("a"), F.lit("b"))))
    model = NN.fit_networks(df, {"a": 0, "b": 1}, rounds=2, local_steps=20)
    test = df.drop("fit_id").distinct()
    keys = ["fit_id", "station_id", *SM.CASE, "step_hours"]
    want = model.transform(test).toPandas().sort_values(keys)
    monkeypatch.setattr(NN, "PREDICT_ROWS", 40)
    got = model.transform(test).toPandas().sort_values(keys)
    assert len(got) == 2 * test.count()
    np.testing.assert_allclose(got["mu"], want["mu"], rtol=1e-6)
    rows = NN._indexed(test, model.stations, model.leads)
    _, parts = NN._dealt(rows, "s", 10, rows.count(), F.xxhash64("ens_mean"))
    assert parts.agg(F.max("_parts")).first()[0] > 1


def test_a_batch_is_taken_in_parts_and_in_single_precision(monkeypatch):
    rng = np.random.default_rng(1)
    shape, n = NN.Shape(3, 2), 50
    w = shape.initial(0) + rng.normal(0, 0.05, len(shape.initial(0)))
    x = {"m": rng.normal(size=n), "v": rng.normal(size=n), "base_mu": rng.normal(size=n), "base_ls2": rng.normal(0, 0.2, n),
         "s": rng.integers(0, 3, n), "l": rng.integers(0, 2, n), "y": rng.normal(size=n)}
    whole = NN.gradient(shape, w, x)
    monkeypatch.setattr(NN, "GRADIENT_ROWS", 7)
    np.testing.assert_allclose(NN.gradient(shape, w, x), whole, atol=1e-14)
    seen, gradient = [], NN.gradient
    monkeypatch.setattr(NN, "gradient", lambda shape, flat, x, room: (seen.append((flat.dtype, x["m"].dtype)), gradient(shape, flat, x, room))[1])
    assert NN.adam_steps(shape, w, x, 3, 20, 0).dtype == np.float64 and set(seen) == {(np.dtype("float32"),) * 2}
