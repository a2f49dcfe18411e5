"""Incremental passes: look-back windows, what is due, checkpoints, rotation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def hours_between(a: Column, b: Column) -> Column:
    """Whole hours from a to b, rounded up."""
    return F.ceil(F.timestamp_diff("SECOND", a, b) / 3600).cast("bigint")


def lookback_hours(last_success: Column, now: Column, least: int) -> Column:
    """Hours a pass must look back: at least so many, else the gap since the last success and 2 more; null (a full sweep) without one."""
    return F.when(last_success.isNotNull(), F.greatest(F.lit(least).cast("bigint"), hours_between(last_success, now) + 2))


def pass_due(last_success: Column, now: Column, hours: int = 20) -> Column:
    return last_success.isNull() | (now - last_success >= F.make_dt_interval(F.lit(0), F.lit(hours)))


def search_since(last_success: Column, overlap_days: int = 2) -> Column:
    """Lower bound of an incremental pass, overlapping the last one."""
    return last_success - F.make_dt_interval(F.lit(overlap_days))


def rotation(groups: list[str], counter: int) -> str:
    """The group that a counter's pass serves."""
    return groups[counter % len(groups)]


def or_query(terms: Column) -> Column:
    """An array of search terms as one query: those of several words quoted, OR between them; '' for no terms."""
    quoted = F.transform(terms, lambda t: F.when(F.contains(t, F.lit(" ")), F.concat(F.lit('"'), t, F.lit('"'))).otherwise(t))
    return F.array_join(quoted, " OR ")


def scan_plan(groups: DataFrame, done: DataFrame, cities: list[str], now: Column, least_hours: int, full_days: int, counter: int, wanted: int, wanted_full: int) -> DataFrame:
    """(scope, query, city, turn, hours, wanted): the searches of one pass. groups: (scope, terms array); done: (scope, last_success, last_full).

    A scope without a success, or whose full sweep is full_days old or missing, is swept in full (null hours, wanted_full results); others look
    back as lookback_hours() says. The counter turns the cities, so that no city is always last.
    """
    start = counter % len(cities) if cities else 0
    turned = F.array(*[F.lit(c) for c in cities[start:] + cities[:start]])
    full = F.col("last_success").isNull() | F.col("last_full").isNull() | (now - F.col("last_full") >= F.make_dt_interval(F.lit(full_days)))
    x = groups.select("scope", or_query(F.col("terms")).alias("query")).join(done, "scope", "left").withColumn("_full", full)
    return x.select("scope", "query", F.posexplode(turned).alias("turn", "city"), F.when(~F.col("_full"), lookback_hours(F.col("last_success"), now, least_hours)).alias("hours"), F.when(F.col("_full"), wanted_full).otherwise(wanted).alias("wanted"))


def checkpoint(done: DataFrame, runs: DataFrame) -> DataFrame:
    """(scope, last_success) after passes: the start of the last complete pass of each scope; an incomplete pass moves nothing. done: (scope, last_success); runs: (scope, started_at, complete)."""
    fresh = runs.filter("complete").groupBy("scope").agg(F.max("started_at").alias("_s"))
    both = done.join(fresh, "scope", "full_outer")
    return both.select("scope", F.greatest("last_success", "_s").alias("last_success"))
