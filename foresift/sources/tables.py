"""Parquet scans and the mapping of the given tables to ensemble forecasts and observations.

Archive: one order line is one ensemble member. Station = supplier, issue time = month of shipment, lead = 0, 6 or
12 h by line number. The verifying observation is the net price of the first line of the cell that was not returned, so
some cells have none.

Operational stream: one event is one member. Station = ten neighbouring users, issue time = day, lead by event type.

Every row of a table is used, and stations grow with the data.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ["station_id", "valid_time", "step_hours"]
CELL = ["station_id", "year_idx", "time_idx", "issue_time", "step_hours", "valid_time"]
# Scale divisors. They are prime, so that means and quantiles never end exactly on a rounding digit.
PRICE_UNIT = 977.0
EVENT_UNIT = 0.97
# Lead hours of the event types and the start of the test period.
EVENT_LEADS = {"click": 0.0, "error": 6.0, "purchase": 12.0, "signup": 18.0, "view": 24.0}
TEST_START = "2000-01-01"
# Fixed value: the member order is one 64-bit number (order line, then part), so that "first in order" hashes.
ORDER_STEP = 1_000_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plus_hours(ts: Column, hours: Column) -> Column:
    return F.timestamp_add("HOUR", hours.cast("bigint"), ts)


def archive_members(spark: SparkSession, sf_dir: str, since: str | None = None, before: str | None = None) -> DataFrame:
    """Members of all issue times, or of those from `since` on and before `before` (starts of months).

    The bounds are applied to the stored date, where the scan can use them to skip row groups.
    """
    li = read_table(spark, sf_dir, "lineitem")
    kind = li.schema["l_shipdate"].dataType.simpleString()
    if since:
        li = li.where(F.col("l_shipdate") >= F.lit(since).cast(kind))
    if before:
        li = li.where(F.col("l_shipdate") < F.lit(before).cast(kind))
    price = F.col("l_extendedprice")
    issue = F.trunc(F.to_date("l_shipdate"), "MM").cast("timestamp_ntz")
    step = (((F.col("l_linenumber") - 1) % 3) * 6).cast("double")
    return li.select(
        F.col("l_suppkey").alias("station_id"), F.year("l_shipdate").alias("year_idx"),
        F.month("l_shipdate").alias("time_idx"), issue.alias("issue_time"), step.alias("step_hours"),
        plus_hours(issue, step).alias("valid_time"), (price / F.lit(PRICE_UNIT)).alias("t2m_forecast"),
        F.when(F.col("l_returnflag") != "R",
               price * (1 - F.col("l_discount")) * (1 + F.col("l_tax")) / F.lit(PRICE_UNIT)).alias("verifying"),
        ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * F.lit(ORDER_STEP)
         + F.col("l_partkey") % ORDER_STEP).alias("member_order"), F.col("l_linenumber").alias("line"))


def event_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events")
    issue = F.to_date("ts").cast("timestamp_ntz")
    step = F.lit(None).cast("double")
    for kind, lead in EVENT_LEADS.items():
        step = F.when(F.col("event_type") == kind, F.lit(lead)).otherwise(step)
    return (ev.select(F.floor(F.col("user_id") / 10).alias("station_id"), issue.alias("issue_time"),
                      step.alias("step_hours"), (F.col("value") / F.lit(EVENT_UNIT)).alias("t2m_forecast"),
                      F.col("event_id").alias("member_order"))
            .withColumn("valid_time", plus_hours(F.col("issue_time"), F.col("step_hours"))))


def event_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six-hourly mean value per group of five users: an observation series with real gaps."""
    ev = read_table(spark, sf_dir, "events")
    slot = plus_hours(F.to_date("ts").cast("timestamp_ntz"), F.floor(F.hour("ts") / 6) * 6)
    return (ev.groupBy(F.floor(F.col("user_id") / 5).alias("series_id"), slot.alias("ts"))
            .agg(F.avg(F.col("value") / F.lit(EVENT_UNIT)).alias("value")))


def station_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Station table from the suppliers: position from the nation number, altitude from the balance."""
    su = read_table(spark, sf_dir, "supplier")
    return su.select(
        F.col("s_suppkey").alias("station_id"), F.col("s_name").alias("station_name"),
        (F.lit(40.0) + F.col("s_nationkey") * 0.7).alias("station_latitude"),
        (F.lit(5.0) + F.col("s_nationkey") * 0.4).alias("station_longitude"),
        (F.col("s_acctbal") / F.lit(7.3)).alias("station_altitude"))
