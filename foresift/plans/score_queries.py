"""Registered queries: quantile scores and calibration (F.col("q"))."""
from __future__ import annotations

from pyspark.sql import functions as F

from foresift.functions import scores as S
from foresift.operators import baselines as B
from foresift.operators import panel as P
from foresift.operators import reports as R
from foresift.plans import ctes as C
from foresift.plans import inputs as I
from foresift.plans.panel_queries import KEYS
from foresift.plans.registry import query
from foresift.sources import tables as T

BY_LEAD = "method:s step_hours:d"
RANGE = "UNNEST(range(10)) AS t(b)"


def by_lead(spark, sf, *aggs):
    return I.predictions(spark, sf).groupBy("method", "step_hours").agg(*aggs)


def lead_sql(*cols: str) -> str:
    return f"SELECT method, step_hours, {', '.join(cols)} FROM preds GROUP BY ALL"


@query("q1_pinball", f"{BY_LEAD} p10:d p50:d p90:d",
       lead_sql(*[f"avg(CASE WHEN obs >= q[{i}] THEN {t}*(obs-q[{i}]) ELSE ({t}-1.0)*(obs-q[{i}]) END) AS p{round(100*t)}"
                  for i, t in ((1, 0.1), (5, 0.5), (9, 0.9))]))
def pinball(spark, sf):
    return by_lead(spark, sf, *[F.avg(S.pinball("obs", f"q[{i}]", t)).alias(f"p{round(100 * t)}")
                                for i, t in ((0, 0.1), (4, 0.5), (8, 0.9))])


@query("q2_crps", f"method:s {KEYS} crps:d",
       f"SELECT method, station_id, valid_time, step_hours, {C.crps()} AS crps FROM preds")
def crps(spark, sf):
    return I.predictions(spark, sf).select("method", *T.KEY, S.crps("obs", "q").alias("crps"))


@query("q3_upper_crps", f"{BY_LEAD} upper_crps:d", lead_sql(f"avg({C.upper_crps()}) AS upper_crps"))
def upper_crps(spark, sf):
    return by_lead(spark, sf, F.avg(S.upper_crps("obs", "q")).alias("upper_crps"))


@query("q4_median_error", f"{BY_LEAD} abs_error:d", lead_sql("avg(abs(obs-q[5])) AS abs_error"))
def median_error(spark, sf):
    return by_lead(spark, sf, F.avg(S.abs_error("obs", "q")).alias("abs_error"))


@query("q5_coverage", f"{BY_LEAD} coverage:d", lead_sql(f"avg({C.cover()}) AS coverage"))
def coverage(spark, sf):
    return by_lead(spark, sf, F.avg(S.covered("obs", "q")).alias("coverage"))


@query("q6_width", f"{BY_LEAD} interval_width:d", lead_sql(f"avg({C.width()}) AS interval_width"))
def width(spark, sf):
    return by_lead(spark, sf, F.avg(S.width("q")).alias("interval_width"))


@query("q7_errors", f"{BY_LEAD} bias:d mae:d rmse:d", lead_sql(C.errors()))
def errors(spark, sf):
    return by_lead(spark, sf, *S.error_bundle("obs", "q"))


BUNDLE = "n:i crps:d upper_crps:d coverage_80pct:d interval_width:d"


@query("q8_metric_bundle", f"{BY_LEAD} {BUNDLE}", lead_sql(C.bundle()))
def metric_bundle(spark, sf):
    return by_lead(spark, sf, *S.bundle("obs", "q"))


PIT_SQL = ("CASE WHEN obs >= q[9] THEN 0.9 WHEN obs < q[1] THEN 0.1 ELSE list_extract(list_filter(["
           + ", ".join(f"CASE WHEN obs >= q[{i}] AND obs < q[{i+1}] THEN {S.LEVELS[i-1]}::DOUBLE + "
                       f"({S.LEVELS[i]}::DOUBLE-{S.LEVELS[i-1]}::DOUBLE)*(obs-q[{i}])/(q[{i+1}]-q[{i}]) END"
                       for i in range(1, 9)) + "], lambda x: x IS NOT NULL), 1) END")
C.CTES["pits"] = f"SELECT method, station_id, valid_time, step_hours, {PIT_SQL} AS pit FROM preds"
C.CTES["pit_hist"] = """SELECT g.method, g.b AS bin_index, coalesce(c.c, 0)/g.n::DOUBLE AS frequency FROM
    (SELECT method, count(*) AS n, unnest(range(10)) AS b FROM pits GROUP BY method) g LEFT JOIN
    (SELECT method, least(floor(pit*10), 9)::BIGINT AS b, count(*) AS c FROM pits GROUP BY ALL) c USING (method, b)"""


@query("q9_pit", f"method:s {KEYS} pit:d", "SELECT method, station_id, valid_time, step_hours, pit FROM pits")
def pit(spark, sf):
    return I.predictions(spark, sf).select("method", *T.KEY, S.pit("obs", "q").alias("pit"))


@query("q10_pit_histogram", "method:s bin_index:i frequency:d", "SELECT method, bin_index, frequency FROM pit_hist")
def pit_histogram(spark, sf):
    return R.pit_histogram(I.predictions(spark, sf))


@query("q11_reliability", "method:s reliability:d",
       "SELECT method, sqrt(avg((frequency-0.1)*(frequency-0.1))) AS reliability FROM pit_hist GROUP BY method")
def reliability(spark, sf):
    return R.reliability(R.pit_histogram(I.predictions(spark, sf)))


C.CTES["rank_hist"] = f"""SELECT g.method, g.b AS bin_index, g.b/10.0::DOUBLE AS bin_lo, (g.b+1)/10.0::DOUBLE AS bin_hi,
    coalesce(c.c, 0)/g.n::DOUBLE AS fraction, g.n AS n_instances FROM
    (SELECT method, count(*) AS n, unnest(range(10)) AS b FROM preds GROUP BY method) g LEFT JOIN
    (SELECT method, {C.rank()} AS b, count(*) AS c FROM preds GROUP BY ALL) c USING (method, b)"""


@query("q12_rank_histogram", "method:s bin_index:i bin_lo:d bin_hi:d fraction:d n_instances:i", "SELECT * FROM rank_hist")
def rank_histogram(spark, sf):
    return R.rank_histogram(I.predictions(spark, sf))


@query("q13_quantile_order", "method:s n:i n_monotone:i n_sorted:i spread:d",
       """SELECT method, count(*) AS n, count(*) FILTER (q = list_sort(q)) AS n_monotone, count(*) AS n_sorted,
       avg(list_max(q)-list_min(q)) AS spread FROM (SELECT method, CASE WHEN step_hours = 6 THEN list_reverse(q) ELSE q END
       AS q FROM preds) GROUP BY method""")
def quantile_order(spark, sf):
    """Crossing quantiles (here: reversed arrays) are counted, then sorted."""
    p = I.predictions(spark, sf).withColumn("q", F.when(F.col("step_hours") == 6, F.reverse("q")).otherwise(F.col("q")))
    p = p.withColumn("s", F.array_sort("q"))
    return p.groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.count_if(S.is_monotone("q")).alias("n_monotone"),
                                   F.count_if(S.is_monotone("s")).alias("n_sorted"),
                                   F.avg(F.col("s")[8] - F.col("s")[0]).alias("spread"))


@query("q14_shape_check", "method:s n:i crps:d", f"SELECT method, count(*) AS n, avg({C.crps()}) AS crps FROM preds GROUP BY 1")
def shape_check(spark, sf):
    """Scores over arrays that passed the run-time length check."""
    q = S.checked("q")
    return (I.predictions(spark, sf).withColumn("q", q).groupBy("method")
            .agg(F.count(F.lit(1)).alias("n"), F.avg(S.crps("obs", "q")).alias("crps")))


@query("q15_skill", "method:s n:i crps:d skill:d",
       f"""SELECT method, n, crps, 1 - crps/(SELECT avg(c) FROM pl WHERE method = 'raw_ensemble') AS skill FROM
       (SELECT method, count(*) AS n, avg(c) AS crps FROM pl GROUP BY method)""")
def skill(spark, sf):
    return R.skill_table(I.predictions(spark, sf), "raw_ensemble")


@query("q16_interpolated_lookup", "method:s at:d value:d",
       """SELECT p.method, p.at, CASE WHEN l.x IS NULL THEN (SELECT arg_min(interval_width, coverage_80pct) FROM curve)
       WHEN u.x IS NULL THEN l.w ELSE l.w + (p.at-l.x)/(u.x-l.x)*(u.w-l.w) END AS value FROM
       (SELECT method, avg(CASE WHEN obs BETWEEN q[1] AND q[9] THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS at FROM preds
        WHERE method IN ('raw_ensemble', 'climatology') GROUP BY method) p
       LEFT JOIN LATERAL (SELECT max(coverage_80pct) AS x, arg_max(interval_width, (coverage_80pct, interval_width)) AS w
         FROM curve WHERE coverage_80pct <= p.at) l ON true
       LEFT JOIN LATERAL (SELECT min(coverage_80pct) AS x, arg_min(interval_width, (coverage_80pct, interval_width)) AS w
         FROM curve WHERE coverage_80pct > p.at) u ON true""")
def interpolated_lookup(spark, sf):
    """Width of the inflation curve at the coverage of two methods."""
    curve = B.inflation_curve(I.test(spark, sf))
    targets = (I.predictions(spark, sf, ("raw_ensemble", "climatology")).groupBy("method")
               .agg(F.avg(S.covered("obs", "q")).alias("at")))
    return R.interpolate_at(curve, "coverage_80pct", "interval_width", targets)
