"""Pay in common units: problem 1's queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quernwork.functions.pay import pay_statements
from quernwork.functions.text import source_key
from quernwork.operators.units import REFERENCE_ROWS, band_of, settle_columns, settle_sources, settle_statements
from quernwork.session import bounded_rows, stored, table


def jobs_with_pay(jobs: DataFrame, profiles: DataFrame, units: DataFrame, rates: DataFrame) -> DataFrame:
    """(job_id, primary_source, salary, updated_at, statements, settled): yearly CAD pay of every job.

    What a source means by a figure without a unit is settled first, from all its figures (settle_sources(), the profile being the habit), then
    each record. Null and blank salaries have no statements and a null `settled`; sources without a profile have no habits, those
    with several the smallest. Repeated rows stay repeated.
    """
    spec = jobs.select("job_id", "primary_source", "salary", "updated_at", source_key("primary_source").alias("_source"))
    habits = F.broadcast(
        profiles.select(source_key("source").alias("_source"), F.col("pay_unit").alias("_unit"), F.col("pay_currency").alias("_currency"), F.col("pay_scale").alias("_scale")).groupBy("_source").agg(F.min(F.struct("_unit", "_currency", "_scale")).alias("p")).select("_source", "p.*")
    ) if len(bounded_rows(profiles.select("source"), REFERENCE_ROWS, "source_profiles")) else None
    unit_factor = {r.unit: float(r.per_year) for r in bounded_rows(units.select("unit", "per_year"), REFERENCE_ROWS, "pay_units")}
    currency_factor = {r.currency: float(r.cad) for r in bounded_rows(rates.select("currency", "cad"), REFERENCE_ROWS, "fx_rates")}
    spec = spec.join(habits, "_source", "left") if habits is not None else spec.selectExpr("*", "string(null) _unit", "string(null) _currency", "double(null) _scale")
    if not unit_factor or not currency_factor:
        raise ValueError("pay_units and fx_rates must not be empty")
    spec = stored(spec.withColumn("statements", pay_statements("salary")), "pay-statements")
    meant = settle_sources(spec, "_source", "statements", unit_factor, currency_factor, "_unit", "_currency", "_scale")
    # one row for each source with a profile
    spec = spec.join(F.broadcast(meant.select("_source", F.when(F.col("unique"), F.col("unit")).alias("_meant"))), "_source", "left").withColumn("_unit", F.coalesce("_meant", "_unit")).drop("_meant")
    return settle_statements(spec, "statements", unit_factor, currency_factor, "_unit", "_currency", "_scale")


def _pay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs_with_pay(*(table(spark, sf_dir, t) for t in ("jobs", "source_profiles", "pay_units", "fx_rates")))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs whose salary states base pay, with the bands of the low and the high figure."""
    bands = table(spark, sf_dir, "pay_bands")
    # amounts are rounded to a hundredth of a cent, so that products such as 22.3 x 2080 don't miss a band's edge by an ulp
    low, high = (band_of(F.round(F.col(f"settled.{x}"), 4), bands, "band_id", "low_cad_year", "high_cad_year") for x in ("low", "high"))
    return (
        _pay(spark, sf_dir)
        .filter("settled.unique")
        .select("job_id", low.alias("low_band"), high.alias("high_band"))
        .filter("low_band is not null and high_band is not null")
    )


def p1_pay_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every source: jobs, jobs with stated pay, those resting on the source's habit, those whose statements check each other, those not unique, and the mean yearly CAD midpoint."""
    first = F.try_element_at("statements", F.lit(1))
    stated = F.col("settled").isNotNull()
    return (
        _pay(spark, sf_dir)
        .groupBy(F.col("_source").alias("source"))
        .agg(
            F.count("*").alias("jobs"),
            F.count_if(stated).alias("with_pay"),
            F.count_if(stated & (first["unit"].isNull() | first["currency"].isNull())).alias("by_habit"),
            F.count_if(F.size("statements") > 1).alias("checked_by_identity"),
            F.count_if(stated & ~F.col("settled.unique")).alias("not_unique"),
            F.round(F.avg((F.col("settled.low") + F.col("settled.high")) / 2), 2).alias("mean_cad_year"),
        )
    )


def p1_column_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The units that each return flag's line items are recorded in, by the identity net = price x fraction, with all solutions that are equally good.

    The columns are recorded in units of their own: net in cents where goods were accepted, the fraction in percent where nothing was returned yet.
    """
    x = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_extendedprice").alias("price"), (1 - F.col("l_discount")).alias("f"))
    x = x.select("l_returnflag", "price", (F.col("price") * F.col("f") * F.when(F.col("l_returnflag") == "A", 100).otherwise(1)).alias("net"), (F.col("f") * F.when(F.col("l_returnflag") == "N", 100).otherwise(1)).alias("fraction"))
    found = settle_columns(x, "l_returnflag", {"net": 1, "price": -1, "fraction": -1}, {"net": {"dollar": 1.0, "cent": 0.01}, "price": {"dollar": 1.0}, "fraction": {"one": 1.0, "percent": 0.01}})
    return found.select("l_returnflag", F.col("units")["net"].alias("net_unit"), F.col("units")["fraction"].alias("fraction_unit"), F.round(F.col("residual"), 6).alias("residual"), "n", "unique")


QUERIES = {"p1_found": p1_found, "p1_pay_by_source": p1_pay_by_source, "p1_column_units": p1_column_units}
SQL = {
    "p1_column_units": """with x as (select l_returnflag, ln(l_extendedprice * (1 - l_discount) * case when l_returnflag = 'A' then 100 else 1 end) - ln(l_extendedprice) - ln((1 - l_discount) * case when l_returnflag = 'N' then 100 else 1 end) as raw from lineitem where l_extendedprice > 0 and l_discount < 1),
    m as (select l_returnflag, quantile_disc(raw, 0.5) as raw, count(*) as n from x group by 1), net(net_unit, a) as (values ('dollar', 1.0), ('cent', 0.01)), fr(fraction_unit, b) as (values ('one', 1.0), ('percent', 0.01)),
    c as (select *, round(abs(raw + ln(a) - ln(b)), 6) as residual from m, net, fr), k as (select *, min(residual) over (partition by l_returnflag) as least from c)
    select l_returnflag, net_unit, fraction_unit, residual, n, count(*) over (partition by l_returnflag) = 1 as "unique" from k where residual <= least"""
}
