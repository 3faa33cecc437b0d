"""Dates on the wire, cursors, and the banking calendar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def iso_of_wire(wire: Column) -> Column:
    """``20260231`` to ``2026-02-31``: digits are moved and not checked against the calendar; else null."""
    parts = [F.substring(wire, 1, 4), F.substring(wire, 5, 2), F.substring(wire, 7, 2)]
    return F.when(wire.rlike("^[0-9]{8}$"), F.concat(parts[0], F.lit("-"), parts[1], F.lit("-"), parts[2]))


def wire_of_iso(iso: Column) -> Column:
    return F.when(iso.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.replace(iso, F.lit("-"), F.lit("")))


def cursor_of(day: Column) -> Column:
    """The last second of a day as the fixed-width text that stamps are compared with."""
    return F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T23:59:59Z"))


def day_of(stamp: Column) -> Column:
    return F.to_date(F.substring(stamp, 1, 10))


def age_days(cursor: Column, service_day: Column) -> Column:
    """Days from the service to the cursor; computed on reading and never stored."""
    return F.date_diff(cursor.cast("date"), service_day.cast("date")).cast("long")


def within_days(a: Column, b: Column, days: int) -> Column:
    return F.abs(F.date_diff(a, b)) <= days


def monthly_cursors(spark: SparkSession, start: str, end: str) -> DataFrame:
    """``cursor`` (date): the first of every month after ``start`` and before ``end``."""
    first = F.add_months(F.trunc(F.lit(start).cast("date"), "month"), 1)
    months = spark.range(1).select(F.explode(F.sequence(first, F.lit(end).cast("date"), F.expr("interval 1 month"))).alias("cursor"))
    return months.where(F.col("cursor") < F.lit(end).cast("date"))


def banking_calendar(spark: SparkSession, start: str, end: str, holidays: tuple[str, ...] = ()) -> DataFrame:
    """``day, is_banking, banking_number, next_banking, previous_banking`` for every day from ``start`` to ``end``.

    ``banking_number`` counts the banking days up to and with the day, so the banking days in ``(a, b]`` are the difference of
    two lookups. The table has a row for each day of the range.
    """
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("day"))
    is_banking = F.weekday("day") < 5
    if holidays:
        is_banking = is_banking & ~F.col("day").isin(*[F.lit(h).cast("date") for h in holidays])
    order = Window.orderBy("day")
    flagged = days.withColumn("is_banking", is_banking)
    own = F.when(F.col("is_banking"), F.col("day"))
    return flagged.select(
        "day",
        "is_banking",
        F.sum(F.col("is_banking").cast("long")).over(order).alias("banking_number"),
        F.first(own, ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing)).alias("next_banking"),
        F.last(own, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("previous_banking"),
    )


def add_banking_days(df: DataFrame, day: str, count: int, calendar: DataFrame, out: str) -> DataFrame:
    """``df`` with the day ``count`` banking days after ``day``; a count of 0 moves a closed day forward."""
    steps = F.broadcast(calendar.select(F.col("day").alias("_from"), (F.col("banking_number") + F.lit(count) + F.when(F.col("is_banking") | (F.lit(count) > 0), 0).otherwise(1)).alias("_number")))
    ends = F.broadcast(calendar.where("is_banking").select(F.col("banking_number").alias("_number"), F.col("day").alias(out)))
    return df.join(steps, F.col(day) == F.col("_from"), "left").join(ends, "_number", "left").drop("_from", "_number")
