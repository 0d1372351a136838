"""Distributional regression network trained by local SGD with weight averaging.

The rows of each fit are dealt to shards of bounded size by station; a station with more rows than a shard is split over several.
A shard is stored in a few rows of packed columns. A row of the panel that stands in many sets is shuffled once, and its copies are made
inside the tasks that pack.
In a round every shard scores the current weights on its held-out rows and then takes some Adam steps from them. The station
embeddings are a keyed table that lies with the rows: a shard gets those of its stations, and Spark averages what comes back by
station, weighted by rows. Only the shared layers, whose size depends neither on stations nor on rows, are averaged on the
driver. The best round by held-out CRPS wins, the untrained network (the raw-ensemble Gaussian) included.
"""
from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foresift.functions.normal import INV_SQRT_PI, SQRT_2PI, cdf_np
from foresift.functions.scores import LEVELS
from foresift.operators.emos import gaussian_quantiles
from foresift.operators.sampling import CASE, held_out, validation_splits
from foresift.operators.spread import position, row_sized
from foresift.sources.storage import materialise, materialise_bucketed

# Network and training settings of the method.
EMBEDDING, HIDDEN = 4, 64
LEARNING_RATE, BATCH, PATIENCE = 1e-3, 4096, 5
FALLBACK_ROWS, FALLBACK_STEPS = 200, 200
SHARD_ROWS, MIN_SHARD_ROWS = 500_000, 20_000
SCORE_ROWS = 16_384
GRADIENT_ROWS = 1024
# rows times fits that a task predicts at once
PREDICT_ROWS = 1_000_000
# what a shard stores of its rows, as packed values: those that training reads, in its precision; and the rows of one cell
PACKED = {"m": "<f4", "v": "<f4", "y": "<f4", "base_ls2": "<f4", "s": "<i4", "l": "<i2", "is_val": "?"}
CELL_ROWS = 65_536


@dataclass(frozen=True)
class Shape:
    stations: int
    leads: int

    def parts(self) -> list[tuple[int, ...]]:
        n_in = 2 + EMBEDDING * (2 if self.leads else 1)
        return [(self.stations, EMBEDDING), (self.leads, EMBEDDING), (n_in, HIDDEN), (HIDDEN,), (HIDDEN, HIDDEN), (HIDDEN,),
                (HIDDEN, 2), (2,)]

    def unpack(self, flat: np.ndarray) -> list[np.ndarray]:
        out, at = [], 0
        for shape in self.parts():
            size = math.prod(shape)
            out.append(flat[at:at + size].reshape(shape))
            at += size
        return out

    def initial(self, seed: int) -> np.ndarray:
        """Random hidden layers and embeddings, zero output layer."""
        rng = np.random.default_rng(seed)
        parts = []
        for i, shape in enumerate(self.parts()):
            if i < 2:
                parts.append(rng.standard_normal(shape))
            elif i in (2, 4):
                parts.append(rng.uniform(-1, 1, shape) / math.sqrt(shape[0]))
            elif i in (3, 5):
                parts.append(rng.uniform(-1, 1, shape) / math.sqrt(self.parts()[i - 1][0]))
            else:
                parts.append(np.zeros(shape))
        return np.concatenate([p.ravel() for p in parts])


def _inputs(pdf: pd.DataFrame) -> dict[str, np.ndarray]:
    return {c: pdf[c].to_numpy() for c in ("m", "v", "base_mu", "base_ls2", "s", "l", "y") if c in pdf}


class Room:
    """Arrays for the layers of some rows, used over and over: fresh ones would cost a batch as much as its products."""

    def __init__(self, rows: int, shape: Shape, dtype):
        n_in = shape.parts()[2][0]
        self.x0 = np.empty((rows, n_in), dtype)
        self.h1, self.h2, self.d1, self.d2 = (np.empty((rows, HIDDEN), dtype) for _ in range(4))
        self.on, self.ones = np.empty((rows, HIDDEN), dtype=bool), np.ones(rows, dtype)


def _layers(shape: Shape, parts: list[np.ndarray], x: dict, room: Room) -> tuple:
    es, el, w1, b1, w2, b2, w3, b3 = parts
    n = len(x["m"])
    x0, h1, h2 = room.x0[:n], room.h1[:n], room.h2[:n]
    x0[:, 0], x0[:, 1], x0[:, 2:2 + EMBEDDING] = x["m"], x["v"], es[x["s"]]
    if shape.leads:
        x0[:, 2 + EMBEDDING:] = el[x["l"]]
    for below, w, b, h in ((x0, w1, b1, h1), (h1, w2, b2, h2)):
        np.matmul(below, w, out=h)
        h += b
        np.maximum(h, 0.0, out=h)
    out = h2 @ w3 + b3
    return x["base_mu"] + out[:, 0], np.exp(0.5 * (x["base_ls2"] + out[:, 1])), x0, h1, h2


def forward(shape: Shape, flat: np.ndarray, x: dict) -> tuple:
    return _layers(shape, shape.unpack(flat), x, Room(len(x["m"]), shape, flat.dtype))


def losses(mu: np.ndarray, sg: np.ndarray, y: np.ndarray) -> np.ndarray:
    z = (y - mu) / sg
    return sg * (z * (2 * cdf_np(z) - 1) + 2 * np.exp(-0.5 * z * z) / SQRT_2PI - INV_SQRT_PI)


def _sum_by(index: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(index, rows[:, i], n) for i in range(rows.shape[1])], axis=1)


def gradient(shape: Shape, flat: np.ndarray, x: dict, room: Room | None = None) -> np.ndarray:
    """Gradient of the mean standardised CRPS."""
    parts = shape.unpack(flat)
    es, el, w1, _, w2, _, w3, _ = parts
    n = len(x["y"])
    room = room or Room(GRADIENT_ROWS, shape, flat.dtype)
    total = np.zeros_like(flat)
    g_es, g_el, *grads = shape.unpack(total)
    below = []
    # some rows at a time: their hidden layers stay in the cache of a core
    for lo in range(0, n, GRADIENT_ROWS):
        part = {c: a[lo:lo + GRADIENT_ROWS] for c, a in x.items()}
        mu, sg, x0, h1, h2 = _layers(shape, parts, part, room)
        z = (part["y"] - mu) / sg
        bell = np.exp(-0.5 * z * z)
        d_out = np.stack([1 - 2 * cdf_np(z, bell), (2 * bell / SQRT_2PI - INV_SQRT_PI) * 0.5 * sg], axis=1) / n
        d1, d2, on, ones = (a[:len(z)] for a in (room.d1, room.d2, room.on, room.ones))
        for above, w, h, d in ((d_out, w3, h2, d2), (d2, w2, h1, d1)):
            np.matmul(above, w.T, out=d)
            np.greater(h, 0.0, out=on)
            d *= on
        below.append(d1 @ w1[2:].T)
        for g, more in zip(grads, (x0.T @ d1, ones @ d1, h1.T @ d2, ones @ d2, h2.T @ d_out, ones @ d_out)):
            g += more
    d0 = np.concatenate(below)
    g_es += _sum_by(x["s"], d0[:, :EMBEDDING], len(es))
    if shape.leads:
        g_el += _sum_by(x["l"], d0[:, EMBEDDING:], len(el))
    return total


def adam_steps(shape: Shape, flat: np.ndarray, x: dict, steps: int, batch: int, seed: int) -> np.ndarray:
    """Weights after some Adam steps. They are taken in single precision, as networks are trained; scores are in double."""
    rng = np.random.default_rng(seed)
    x = {k: v.astype(np.float32) if v.dtype == np.float64 else v for k, v in x.items()}
    w = flat.astype(np.float32)
    m1, m2 = np.zeros_like(w), np.zeros_like(w)
    n, order, at = len(x["y"]), None, 0
    room = Room(GRADIENT_ROWS, shape, w.dtype)
    for t in range(1, steps + 1):
        if order is None or at >= n:
            order, at = rng.permutation(n), 0
        pick = order[at:at + batch]
        at += batch
        g = gradient(shape, w, {k: v[pick] for k, v in x.items()}, room)
        m1 *= 0.9
        m1 += 0.1 * g
        m2 *= 0.999
        g *= g
        g *= 0.001
        m2 += g
        np.multiply(m2, 1 / (1 - 0.999 ** t), out=g)
        np.sqrt(g, out=g)
        g += 1e-8
        np.divide(m1, g, out=g)
        g *= LEARNING_RATE / (1 - 0.9 ** t)
        w -= g
    return w.astype(np.float64)


def initial_embedding(seed: int, stations: np.ndarray) -> np.ndarray:
    """First embedding of each station, a function of seed and station alone."""
    return np.stack([np.random.default_rng([seed, int(s)]).standard_normal(EMBEDDING) for s in stations]) \
        if len(stations) else np.zeros((0, EMBEDDING))


class NetworkModel:
    """Fitted networks: a vector of shared layers per fit id, and a table of embeddings by fit id and station."""

    def __init__(self, shape, shared, embeddings, scales, stations, leads, history):
        self.shape, self.shared, self.embeddings, self.scales = shape, shared, embeddings, scales
        self.stations, self.leads, self.history = stations, leads, history

    def transform(self, test: DataFrame, levels=LEVELS) -> DataFrame:
        """Rows of `test` per fit id with mu, sigma and q; unseen stations and leads use index 0.

        Rows meet the embeddings of all fits in buckets of stations; a bucket of many rows is split, and each part gets the embeddings.
        """
        rows = _indexed(test, self.stations, self.leads)
        own = "fit_id" in test.columns      # rows that belong to one fit each
        n = rows.count()
        buckets = max(1, math.ceil(n * (1 if own else len(self.shared)) / PREDICT_ROWS), min(
            test.sparkSession.sparkContext.defaultParallelism, math.ceil(n / MIN_SHARD_ROWS)))
        keep = [c for c in test.columns if c != "fit_id"]
        dealt, parts = _dealt(rows, "s", buckets, n, F.xxhash64(*[c for c in KEY if c in rows.columns]))
        places = F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))
        table = self.embeddings.withColumn("_bucket", _bucket("s", buckets)).join(parts, "_bucket").withColumn("_part", places)
        # stations that the set of a fit does not hold are unseen by that fit
        unseen = {r["fit_id"]: np.array(r["value"]) for r in self.embeddings.where("s = 0").collect()}      # one row per fit
        shape, shared, scales = self.shape, self.shared, _by_fit(self.scales)
        of_row = [F.col(c).alias(f"_in_{c}") for c in ("ens_mean", "ens_var", "s", "l", *(["fit_id"] if own else []))]
        schema = T.StructType([T.StructField("fit_id", T.StringType())] + [test.schema[c] for c in keep]
                              + [T.StructField("mu", T.DoubleType()), T.StructField("sigma", T.DoubleType())])

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            x = {c: left[f"_in_{c}"].to_numpy() for c in ("ens_mean", "ens_var", "s", "l")}
            whose, s_of = right["fit_id"].to_numpy(), right["s"].to_numpy()
            values = right["value"].combine_chunks().flatten().to_numpy().reshape(-1, EMBEDDING)
            out = []
            for fit in shared:
                mine = np.flatnonzero(left["_in_fit_id"].to_numpy() == fit) if own else slice(None)
                part = {c: a[mine] for c, a in x.items()}
                at = np.flatnonzero(whose == fit)
                at = at[np.argsort(s_of[at])]
                names = s_of[at]
                place = np.searchsorted(names, part["s"])
                found = place < len(names)
                found[found] = names[place[found]] == part["s"][found]
                part["s"] = np.where(found, place, len(names))
                es = np.concatenate([values[at], unseen[fit][None]])
                flat = np.concatenate([es.ravel(), shared[fit]]).astype(np.float32)
                got = [forward(Shape(len(es), shape.leads), flat, _standardised(part, scales[fit], i))[:2]
                       for i in range(0, len(place), SCORE_ROWS)]
                if got:
                    mu, sg = (np.concatenate(g) for g in zip(*got))
                    kept = (left.take(pa.array(mine)) if own else left).select(keep)
                    cols = [pa.repeat(fit, len(mu)), *kept.columns, pa.array(mu * scales[fit]["obs_scale"] + scales[fit]["obs_loc"]),
                            pa.array(sg * scales[fit]["obs_scale"])]
                    out.append(pa.table(cols, names=["fit_id", *keep, "mu", "sigma"]))
            return pa.concat_tables(out) if out else _empty(schema)

        by = ["_bucket", "_part"]
        done = dealt.select(*by, *keep, *of_row).groupBy(*by).cogroup(
            table.select(*by, "fit_id", "s", "value").groupBy(*by)).applyInArrow(run, schema)
        return done.withColumn("q", gaussian_quantiles("mu", "sigma", levels))


KEY = ("station_id", *CASE, "valid_time", "step_hours", "ens_mean", "ens_var")


def _empty(schema: T.StructType) -> pa.Table:
    from pyspark.sql.pandas.types import to_arrow_schema
    return to_arrow_schema(schema).empty_table()


def _bucket(key: str, n: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


def _dealt(rows: DataFrame, key: str, n_buckets: int, n_rows: int, of_row: Column) -> tuple[DataFrame, DataFrame]:
    """Rows with `_bucket` (by hash of a key) and `_part`: a bucket of more than twice the mean size is split by the hash `of_row`.

    Also the number of parts of each bucket, a row per bucket.
    """
    rows = rows.withColumn("_bucket", _bucket(key, n_buckets))
    parts = materialise(rows.groupBy("_bucket").agg(
        F.ceil(F.count(F.lit(1)) * F.lit(n_buckets) / F.lit(2 * max(n_rows, 1))).cast("int").alias("_parts")))
    return rows.join(parts, "_bucket").withColumn("_part", F.pmod(of_row, F.col("_parts")).cast("int")), parts


def _by_fit(scales: DataFrame) -> dict[str, dict]:
    return {r["fit_id"]: r.asDict() for r in scales.collect()}      # one row per fit


MOMENTS = (("ens_mean", "m"), ("ens_var", "v"), ("t2m_obs", "obs"))


def _scales(train: DataFrame, sets: DataFrame | None = None) -> DataFrame:
    """Mean and deviation of inputs and observation by fit. Those of sets of cases come from the moments of each case."""
    by = ["fit_id"] if sets is None else CASE
    parts = train.groupBy(*by).agg(F.count(F.lit(1)).alias("fit_rows"), *[f for c, n in MOMENTS for f in (
        F.avg(c).alias(f"{n}_loc"), F.var_pop(c).alias(f"{n}_var"))])
    if sets is not None:
        joined = materialise(parts).join(sets, CASE)
        rows = F.sum("fit_rows")
        centre = joined.groupBy("fit_id").agg(rows.alias("_n"), *[(F.sum(F.col("fit_rows") * F.col(f"{n}_loc")) / rows).alias(f"_{n}")
                                                                  for _, n in MOMENTS])
        off = {n: F.col(f"{n}_loc") - F.col(f"_{n}") for _, n in MOMENTS}
        parts = joined.join(centre, "fit_id").groupBy("fit_id").agg(rows.alias("fit_rows"), *[f for _, n in MOMENTS for f in (
            F.first(f"_{n}").alias(f"{n}_loc"),
            (F.sum(F.col("fit_rows") * (F.col(f"{n}_var") + off[n] * off[n])) / rows).alias(f"{n}_var"))])
    return parts.select("fit_id", "fit_rows", *[c for _, n in MOMENTS for c in (
        F.col(f"{n}_loc"), F.when(F.col(f"{n}_var") > 0, F.sqrt(f"{n}_var")).otherwise(F.lit(1.0)).alias(f"{n}_scale"))])


def _indexed(df: DataFrame, stations: DataFrame, leads: DataFrame | None) -> DataFrame:
    """Rows with their embedding indices; 0 for unseen ones."""
    rows = df.join(stations, "station_id", "left").withColumn("s", F.coalesce("s", F.lit(0)).cast("long"))
    if leads is None:
        return rows.withColumn("l", F.lit(0))
    return rows.join(leads, "step_hours", "left").withColumn("l", F.coalesce("l", F.lit(0)).cast("int"))


def _standardised(x: dict, scale: dict, at: int = 0, rows: int = SCORE_ROWS) -> dict[str, np.ndarray]:
    """Some rows from `at` on: inputs and the raw-ensemble Gaussian in standardised units."""
    x = {c: a[at:at + rows] for c, a in x.items()}
    loc, sc, sc2 = scale["obs_loc"], scale["obs_scale"], scale["obs_scale"] ** 2
    out = {"m": (x["ens_mean"] - scale["m_loc"]) / scale["m_scale"], "v": (x["ens_var"] - scale["v_loc"]) / scale["v_scale"],
           "base_mu": (x["ens_mean"] - loc) / sc, "base_ls2": np.log(np.maximum(x["ens_var"], sc2 * 1e-6) / sc2)}
    if "t2m_obs" in x:
        out["y"] = (x["t2m_obs"] - loc) / sc
    return out | {c: x[c] for c in ("s", "l")}


def _pack(rows: DataFrame, fits: list[str], n_shards: dict[str, int], scales: dict[str, dict], use_lead: bool) -> DataFrame:
    """Shards in rows of packed columns, from rows that name the fits they stand in (`codes`) in groups of bounded size.

    The copies of a row exist only here. A station with more rows than an average shard of a fit is split.
    """
    n_of = np.array([n_shards[f] for f in fits])
    share = n_of / np.array([scales[f]["fit_rows"] for f in fits])
    kinds = {c: kind for c, kind in PACKED.items() if use_lead or c != "l"}
    fields = "".join(f", {c} binary" for c in kinds)
    cell_rows = CELL_ROWS

    def pieces(table: pa.Table) -> pa.Table:
        codes = table["codes"].combine_chunks().dictionary_encode()
        member, held = (np.zeros((len(codes.dictionary), len(fits)), dtype=bool) for _ in range(2))
        for i, text in enumerate(codes.dictionary.to_pylist()):
            for code in map(int, text.split()):
                member[i, code // 2], held[i, code // 2] = True, code % 2
        kind = codes.indices.to_numpy()
        x = {c: table[c].to_numpy() for c in ("ens_mean", "ens_var", "t2m_obs", "s", "l")}
        of_station, of_row = table["of_station"].to_numpy().astype(np.int64), table["of_row"].to_numpy().astype(np.int64)
        n_parts = table["_parts"][0].as_py()
        out = []
        for f in range(len(fits)):
            mine = np.flatnonzero(member[kind, f])
            if not len(mine):
                continue
            _, at, own = np.unique(x["s"][mine], return_inverse=True, return_counts=True)
            split = np.ceil(own * n_parts * share[f]).astype(np.int64)[at]
            shard = (of_station[mine] + of_row[mine] % np.maximum(split, 1)) % n_of[f]
            order = np.argsort(shard, kind="stable")
            mine, shard = mine[order], shard[order]
            start = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
            whole = _standardised({c: a[mine] for c, a in x.items()}, scales[fits[f]], rows=len(mine)) | {"is_val": held[kind[mine], f]}
            whole = {c: whole[c].astype(of) for c, of in kinds.items()}
            for lo, hi in zip(start, np.r_[start[1:], len(mine)]):
                out.append((fits[f], int(shard[lo]), *(whole[c][lo:hi].tobytes() for c in kinds)))
        return pa.table([pa.array(c) for c in zip(*out)], names=["fit_id", "shard", *kinds])

    def whole(table: pa.Table) -> pa.Table:
        x = _unpacked(table.to_pandas())
        # in an order of their own: a shard that runs again, elsewhere, takes the same steps
        order = np.lexsort((x["s"], x["v"], x["y"], x["m"]))
        # in cells of bounded size: large values are slow to pass on
        cells = [order[i:i + cell_rows] for i in range(0, len(order), cell_rows)]
        cols = [pa.array([x[c][cell].tobytes() for cell in cells], type=pa.binary()) for c in kinds]
        fit, shard = (pa.repeat(table[c][0], len(cells)) for c in ("fit_id", "shard"))
        return pa.table([fit, shard, *cols, pa.array(range(len(cells))), pa.array([int(x["is_val"][cell].sum()) for cell in cells])],
                        names=["fit_id", "shard", *kinds, "cell", "n_val"])

    by = ["_bucket", "_part"]
    cut = rows.groupBy(*by).applyInArrow(pieces, "fit_id string, shard bigint" + fields)
    return cut.groupBy("fit_id", "shard").applyInArrow(whole, "fit_id string, shard bigint" + fields + ", cell bigint, n_val bigint")


def _unpacked(pdf: pd.DataFrame) -> dict[str, np.ndarray]:
    return {c: np.concatenate([np.frombuffer(b, dtype=kind) for b in pdf[c]]) for c, kind in PACKED.items() if c in pdf}


def fit_networks(train: DataFrame, seeds: dict[str, int], use_lead: bool = True, rounds: int = 100,
                 local_steps: int = 100, val_fraction: float = 0.1, min_updates: int = 2000,
                 sets: DataFrame | None = None) -> NetworkModel:
    """Trains one network per fit id (keys of `seeds`; column `fit_id` of `train`).

    Where the training sets are sets of cases, `sets` names them by fit id and `train` holds every row once, without `fit_id`.
    Patience may end a fit only after `min_updates` steps. Sets under FALLBACK_ROWS rows, and sets of a single case, which
    leave no rows to validate on, take FALLBACK_STEPS steps in all.
    """
    spark = train.sparkSession
    use_lead = use_lead and "step_hours" in train.columns
    stations = position(train.select("station_id").distinct(), [], F.floor(F.col("station_id") / 1024),
                        [F.col("station_id")], "s").select("station_id", "s")
    leads = None
    if use_lead:
        leads = position(train.select("step_hours").distinct(), [], F.floor(F.col("step_hours") / 24),
                         [F.col("step_hours")], "l").select("step_hours", "l")
    stations = materialise(stations)
    wanted = F.col("fit_id").isin(list(seeds))
    scales = materialise(_scales(train, sets).where(wanted))
    scale_of = _by_fit(scales)
    sizes = {f: r["fit_rows"] for f, r in scale_of.items()}
    shape = Shape(0, leads.count() if leads is not None else 0)       # of the shared layers
    fits = sorted(sizes)
    # a row names the fits it stands in, and whether they hold it out
    number = F.broadcast(spark.createDataFrame([(f, 2 * i) for i, f in enumerate(fits)], "fit_id string, _number int"))     # one row per fit
    code = (F.col("_number") + F.col("is_val").cast("int")).cast("string")
    if sets is None:
        split = validation_splits(train.where(wanted), seeds, val_fraction, row_key=["station_id", "step_hours"] if use_lead else ["station_id"])
        coded = split.join(number, "fit_id").withColumn("codes", code)
    else:
        units = train.groupBy(*CASE).agg(F.count(F.lit(1)).alias("_rows")).join(sets.where(wanted).select("fit_id", *CASE), CASE)
        flags = held_out(units, seeds, CASE, val_fraction).join(number, "fit_id")
        coded = train.join(materialise(flags.groupBy(*CASE).agg(F.concat_ws(" ", F.collect_list(code)).alias("codes"))), CASE)
    cores = spark.sparkContext.defaultParallelism
    n_shards = {f: max(math.ceil(n / SHARD_ROWS), min(cores, math.ceil(n / MIN_SHARD_ROWS))) for f, n in sizes.items()}
    n_stored = sum(n_shards.values())
    key = [c for c in ("station_id", *CASE, "step_hours") if c in coded.columns]
    coded = _indexed(coded, stations, leads).select("codes", "ens_mean", "ens_var", "t2m_obs", "s", "l", F.hash("s").alias("of_station"),
                                                    F.hash(*key).alias("of_row"))
    n_rows = sum(sizes.values()) if sets is None else train.count()
    dealt, _ = _dealt(coded, "s", max(n_stored, 1), n_rows, F.col("of_row"))
    # every round reads all shards: in buckets they are shuffled once, not once a round
    stored = materialise_bucketed(_pack(dealt, fits, n_shards, scale_of, use_lead), ["fit_id", "shard"], n_stored)

    def stations_of(batches):
        for pdf in batches:
            for fit, shard, packed in pdf[["fit_id", "shard", "s"]].itertuples(index=False):
                yield pd.DataFrame({"fit_id": fit, "s": np.unique(np.frombuffer(packed, dtype=PACKED["s"])), "shard": shard})

    places = materialise(stored.select("fit_id", "shard", "s").mapInPandas(stations_of, "fit_id string, s bigint, shard bigint").distinct())
    held = {r["fit_id"] for r in stored.where("n_val > 0").select("fit_id").distinct().collect()}     # one row per fit
    brief = {f for f in sizes if sizes[f] < FALLBACK_ROWS or f not in held}
    current = {f: shape.initial(s) for f, s in seeds.items() if f in sizes}
    best, best_val = dict(current), {f: math.inf for f in current}
    bad = {f: 0 for f in current}
    history: dict[str, list[float]] = {f: [] for f in current}
    schema = "fit_id string, key bigint, value array<double>, weight double"
    first = embedded = _initial_embeddings(places, seeds)
    best_table: dict[str, DataFrame] = {f: embedded for f in current}
    n_leads = shape.leads
    for r in range(rounds + 1):
        live = [f for f in current if (r == 0 if f in brief else bad[f] < PATIENCE or r * local_steps < min_updates)]
        if not live:
            break
        weights = {f: current[f] for f in live}
        score_only = r == rounds

        def run(packed: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
            fit, x = packed["fit_id"].iloc[0], _unpacked(packed.sort_values("cell"))
            scale = scale_of[fit]
            base = (x["m"] * np.float64(scale["m_scale"] / scale["obs_scale"])
                    + (scale["m_loc"] - scale["obs_loc"]) / scale["obs_scale"])
            pdf = pd.DataFrame(x | {"fit_id": pd.Categorical([fit]).repeat(len(base)), "base_mu": base,
                                    "obs_scale": scale["obs_scale"]}, copy=False)
            return train_shard(pdf, own, weights, n_leads, seeds, r, brief, local_steps, score_only)

        of_shard = embedded.join(places.where(F.col("fit_id").isin(live)), ["fit_id", "s"])
        done = materialise(stored.drop("n_val").where(F.col("fit_id").isin(live)).groupBy("fit_id", "shard")
                           .cogroup(of_shard.groupBy("fit_id", "shard")).applyInPandas(run, schema))
        got = _weighted_mean(done.where("key < 0")).toPandas()      # shared layers and the score: two rows per fit
        for fit, key, value, weight in got[["fit_id", "key", "value", "weight"]].itertuples(index=False):
            if key == SCORE:
                history[fit].append(float(value[0]))
                if value[0] < best_val[fit]:
                    best_val[fit], best[fit], best_table[fit], bad[fit] = float(value[0]), current[fit], embedded, 0
                else:
                    bad[fit] += 1
        embedded = _mean_embeddings(done.where("key >= 0"))
        for fit, key, value in got[["fit_id", "key", "value"]].itertuples(index=False):
            if key == SHARED:
                current[fit] = np.array(value)
                if fit in brief:
                    best[fit], best_table[fit] = current[fit], embedded
    kept = None
    for table in {id(t): t for t in best_table.values()}.values():
        part = table.where(F.col("fit_id").isin([f for f, t in best_table.items() if t is table]))
        kept = part if kept is None else kept.unionByName(part)
    kept = kept.unionByName(first.where("s = 0").join(kept, ["fit_id", "s"], "left_anti"))
    return NetworkModel(shape, best, materialise(kept), scales, stations, leads, history)


# keys of the rows that a shard returns besides those of its stations
SCORE, SHARED = -1, -2


def train_shard(pdf: pd.DataFrame, own: pd.DataFrame, weights: dict, n_leads: int, seeds: dict[str, int], r: int, brief: set,
                local_steps: int, score_only: bool = False) -> pd.DataFrame:
    """One shard of one round: its score, and after some steps the shared layers and the embeddings of its stations.

    The order of the rows decides which of them make a batch.
    """
    fit = pdf["fit_id"].iloc[0]
    own = own.sort_values("s")
    names = own["s"].to_numpy()
    shape = Shape(len(names), n_leads)
    flat = np.concatenate([np.concatenate(own["value"].to_list()), weights[fit]])
    held = pdf["is_val"].to_numpy()
    whole = _inputs(pdf) | {"s": np.searchsorted(names, pdf["s"].to_numpy())}
    scale = pdf["obs_scale"].to_numpy()
    out = []
    if held.any():
        x = {c: a[held].astype(np.float64) if a.dtype == np.float32 else a[held] for c, a in whole.items()}
        # some rows at a time: the hidden layers are many times wider than a row
        val = np.concatenate([losses(*forward(shape, flat, part)[:2], part["y"]) for part in (
            {c: a[i:i + SCORE_ROWS] for c, a in x.items()} for i in range(0, len(x["y"]), SCORE_ROWS))]) * scale[held]
        out.append((SCORE, [val.mean()], float(len(val))))
    if not score_only and not held.all():
        x = {c: a[~held] for c, a in whole.items()}
        n = len(x["y"])
        w = adam_steps(shape, flat, x, FALLBACK_STEPS if fit in brief else local_steps,
                       max(1, min(BATCH, max(256, n // 20))), seeds[fit] * 1000 + r)
        cut = len(names) * EMBEDDING
        out.append((SHARED, w[cut:], float(n)))
        times = np.bincount(x["s"], minlength=len(names))
        # a station that this shard holds for validation alone keeps its embedding, at next to no weight
        out += [(int(s), e, max(float(t), 1e-9)) for s, e, t in zip(names, w[:cut].reshape(-1, EMBEDDING), times)]
    frame = pd.DataFrame(out, columns=["key", "value", "weight"])
    frame.insert(0, "fit_id", fit)
    return frame


def _initial_embeddings(places: DataFrame, seeds: dict[str, int]) -> DataFrame:
    """They depend on seed and station alone: fits of one seed share the draw."""
    def run(batches):
        for pdf in batches:
            for seed, part in pdf.groupby("_seed", sort=False):
                yield pd.DataFrame({"_seed": seed, "s": part["s"].to_numpy(), "value": list(initial_embedding(seed, part["s"].to_numpy()))})
    of_fit = F.broadcast(places.sparkSession.createDataFrame(list(seeds.items()), "fit_id string, _seed int"))     # one row per fit
    # unseen stations take index 0, whether or not the set has rows of it
    zero = places.select("fit_id", F.lit(0).cast("bigint").alias("s")).distinct()
    pairs = places.select("fit_id", "s").unionByName(zero).distinct().join(of_fit, "fit_id")
    drawn = pairs.select("_seed", "s").distinct().mapInPandas(run, "_seed int, s bigint, value array<double>")
    return materialise(pairs.join(row_sized(drawn), ["_seed", "s"]).select("fit_id", "s", "value"))


def _mean_embeddings(rows: DataFrame) -> DataFrame:
    """Mean embeddings by fit and station, weighted by rows: one aggregation, a sum per element."""
    total = F.sum("weight")
    means = [F.sum(F.col("value")[i] * F.col("weight")) / total for i in range(EMBEDDING)]
    return rows.groupBy("fit_id", F.col("key").alias("s")).agg(F.array(*means).alias("value"))


def _weighted_mean(rows: DataFrame) -> DataFrame:
    """Mean vectors by fit and key, element by element."""
    cells = rows.select("fit_id", "key", "weight", F.posexplode("value").alias("pos", "x"))
    means = cells.groupBy("fit_id", "key", "pos").agg((F.sum(F.col("x") * F.col("weight")) / F.sum("weight")).alias("x"),
                                                      F.sum("weight").alias("weight"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "x")))
    return means.groupBy("fit_id", "key").agg(F.transform(ordered, lambda p: p["x"]).alias("value"), F.max("weight").alias("weight"))
