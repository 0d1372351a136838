"""Training-set selection: recent and random cases, sweeps, held-out stations and cases.

Case lists are short (one row per issue date and analogue year). They are stored before they meet the panel, so Spark knows
their size and decides between a broadcast and a shuffle.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foresift.functions.hashing import hash_key
from foresift.operators.spread import position
from foresift.sources.storage import materialise

# Archive span in days over its number of case intervals.
CASE_SPAN_DAYS = 7297.0
CASE_INTERVALS = 4071
DAYS_PER_CASE = CASE_SPAN_DAYS / CASE_INTERVALS
CASE = ["year_idx", "time_idx"]


def days_to_cases(days: Column) -> Column:
    """Number of cases nearest to a span of days (ties to even)."""
    return F.bround(days / F.lit(DAYS_PER_CASE)).cast("bigint")


def cases_to_days(cases: Column) -> Column:
    return F.bround(cases * F.lit(DAYS_PER_CASE)).cast("bigint")


def exact_days(cases: Column) -> Column:
    """Span in days that maps back to exactly this many cases."""
    return cases * F.lit(DAYS_PER_CASE)


def k_for_label(label: Column, n_full: Column) -> Column:
    """Cases for a label of days, where 'full' means all of them."""
    return F.when(label == "full", n_full).otherwise(F.least(days_to_cases(label.try_cast("double")), n_full))


def rank_recent(cases: DataFrame, keys: list[str] = ()) -> DataFrame:
    """0-based rank of the cases from the newest to the oldest; ties by year and time index."""
    block = -F.year("case_date")
    return position(cases, list(keys), block, [F.col("case_date").desc(), F.col("year_idx"), F.col("time_idx")], "rank")


def rank_random(cases: DataFrame, seed, keys: list[str] = ()) -> DataFrame:
    """0-based rank of the cases in hashed order; the hash prefix is the sort block."""
    h = cases.withColumn("_h", hash_key(seed, *[F.col(c) for c in CASE]))
    return position(h, list(keys), F.substring("_h", 1, 2), [F.col("_h"), F.col("year_idx"), F.col("time_idx")],
                    "rank").drop("_h")


def distinct_cases(train: DataFrame, extra: list[str] = ()) -> DataFrame:
    return train.groupBy(*extra, *CASE).agg(F.min("case_date").alias("case_date"))


def k_recent(train: DataFrame, k: int) -> DataFrame:
    keep = materialise(rank_recent(distinct_cases(train)).where(F.col("rank") < k))
    return train.join(keep.select(*CASE), CASE, "left_semi")


def k_random(train: DataFrame, k: int, seed: int) -> DataFrame:
    keep = materialise(rank_random(distinct_cases(train), F.lit(seed)).where(F.col("rank") < k))
    return train.join(keep.select(*CASE), CASE, "left_semi")


def sweep_cases(cases: DataFrame, ks: list[int], seeds: list[int], keys: list[str] = ()) -> DataFrame:
    """All training sets of a sweep as (arm, seed, k, case) rows: nested recent sets and nested random sets.

    Ranks are computed once per arm and seed; a set of k cases is the ranks below k. Only cases are expanded here, never
    panel rows.
    """
    recent = rank_recent(cases, keys).withColumn("arm", F.lit("contiguous")).withColumn("seed", F.lit(-1))
    seeded = cases.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
    random = rank_random(seeded, F.col("seed"), ["seed", *keys]).withColumn("arm", F.lit("random"))
    ranked = recent.unionByName(random.select(*recent.columns))
    sizes = F.array(*[F.lit(int(k)) for k in ks])
    return ranked.withColumn("k", F.explode(F.filter(sizes, lambda k: k > F.col("rank"))))


def sweep_panel(train: DataFrame, sets: DataFrame) -> DataFrame:
    """Panel rows of every training set, keyed by (arm, seed, k).

    The stored case list has a known size: while it is small the panel is not shuffled for this join.
    """
    return train.join(materialise(sets.select("arm", "seed", "k", *CASE)), CASE)


def leave_one_out_stats(train: DataFrame) -> DataFrame:
    """Size and moments of each leave-one-station-out training set, from totals minus the station's own share."""
    per = train.groupBy("station_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("ens_mean").alias("sm"), F.sum("t2m_obs").alias("sy"),
        F.sum("ens_var").alias("sv"))
    tot = per.agg(*[F.sum(c).alias("t_" + c) for c in ("n", "sm", "sy", "sv")], F.count(F.lit(1)).alias("t_s"))
    both = per.crossJoin(F.broadcast(tot))     # totals are one row
    n = F.col("t_n") - F.col("n")
    return both.select(F.col("station_id").alias("target"), n.alias("n_train"),
                       (F.col("t_s") - 1).alias("n_stations"),
                       ((F.col("t_sm") - F.col("sm")) / n).alias("mean_forecast"),
                       ((F.col("t_sy") - F.col("sy")) / n).alias("mean_obs"),
                       ((F.col("t_sv") - F.col("sv")) / n).alias("mean_var"))


def leave_one_out(train: DataFrame, target: int) -> DataFrame:
    return train.where(F.col("station_id") != target)


def validation_split(train: DataFrame, seed: int = 0, fraction: float = 0.1, min_rows: int = 200,
                     row_key: list[str] = ()) -> DataFrame:
    """Adds `is_val`: whole cases held out in hashed order, or rows if there are no case ids; none if too small."""
    by_case = all(c in train.columns for c in CASE)
    unit = CASE if by_case else list(row_key)
    units = train.groupBy(*unit).agg(F.count(F.lit(1)).alias("_rows"))
    h = units.withColumn("_h", hash_key(F.lit(seed), *[F.col(c) for c in unit]))
    ranked = position(h, [], F.substring("_h", 1, 2), [F.col("_h"), *[F.col(c) for c in unit]], "_rank")
    size = units.agg(F.count(F.lit(1)).alias("_n"), F.sum("_rows").alias("_total"))
    n_val = F.least(F.greatest(F.lit(1), F.bround(fraction * F.col("_n")).cast("bigint")), F.col("_n") - 1)
    none = (F.col("_total") < min_rows) | (F.col("_n") < 2)
    flags = ranked.crossJoin(F.broadcast(size)).select(     # size is one row
        *unit, F.when(none, F.lit(False)).otherwise(F.col("_rank") < n_val).alias("is_val"))
    return train.join(flags, unit)


def validation_splits(train: DataFrame, seeds: dict[str, int], fraction: float = 0.1, min_rows: int = 200,
                      row_key: list[str] = ()) -> DataFrame:
    """`validation_split` of many sets at once: sets are told apart by `fit_id`, each with its own seed."""
    unit = CASE if all(c in train.columns for c in CASE) else list(row_key)
    units = train.groupBy("fit_id", *unit).agg(F.count(F.lit(1)).alias("_rows"))
    return train.join(held_out(units, seeds, unit, fraction, min_rows), ["fit_id", *unit])


def held_out(units: DataFrame, seeds: dict[str, int], unit: list[str], fraction: float = 0.1, min_rows: int = 200) -> DataFrame:
    """`is_val` of each unit (a case, or a row) of many sets, from the units of every `fit_id` and their numbers of rows (`_rows`)."""
    # one row per fit
    of_fit = F.broadcast(units.sparkSession.createDataFrame(list(seeds.items()), "fit_id string, _seed int"))
    units = units.join(of_fit, "fit_id")
    h = units.withColumn("_h", hash_key(F.col("_seed"), *[F.col(c) for c in unit]))
    ranked = position(h, ["fit_id"], F.substring("_h", 1, 2), [F.col("_h"), *[F.col(c) for c in unit]], "_rank")
    size = units.groupBy("fit_id").agg(F.count(F.lit(1)).alias("_n"), F.sum("_rows").alias("_total"))
    n_val = F.least(F.greatest(F.lit(1), F.bround(fraction * F.col("_n")).cast("bigint")), F.col("_n") - 1)
    none = (F.col("_total") < min_rows) | (F.col("_n") < 2)
    return ranked.join(size, "fit_id").select(
        "fit_id", *unit, F.when(none, F.lit(False)).otherwise(F.col("_rank") < n_val).alias("is_val"))


def full_and_smaller(cases: DataFrame, ks: list[int], seeds: list[int], keys: list[str] = ()) -> DataFrame:
    """`sweep_cases` for the sizes below the number of cases (of each key group), and the recent set of all cases with that k."""
    total = cases.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")) if keys else cases.agg(F.count(F.lit(1)).alias("_n"))
    both = lambda df: df.join(total, list(keys)) if keys else df.crossJoin(F.broadcast(total))      # noqa: E731  one row
    below = both(sweep_cases(cases, ks, seeds, keys)).where(F.col("k") < F.col("_n")).drop("_n")
    whole = both(rank_recent(cases, keys)).withColumns({"arm": F.lit("contiguous"), "seed": F.lit(-1), "k": F.col("_n").cast("int")})
    return below.unionByName(whole.select(*below.columns))
