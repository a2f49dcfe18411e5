"""Quantities recorded in different units: settle units by physical identities.

A reading is a figure whose unit, currency or scale may be open. Readings of one record that describe
the same quantity are tied by the identity  value x factor = value' x factor',  so the right choice of
units is the one whose log residuals are smallest. `settle_statements` solves that for statements of
one quantity per record; `settle_columns` solves it for columns tied by a product identity such as
mass = density x volume, whose units are a habit of each source.
"""

from __future__ import annotations

import math
from itertools import product

from pyspark.sql import Column, DataFrame, functions as F

from quernwork.session import bounded_rows

#: A reference table (units, currencies, bands, source habits) may have so many rows on the driver.
REFERENCE_ROWS = 10_000
#: What it costs to depart from a source's habit, as a squared log residual: a habit gives way only where
#: the identity speaks against it by more than a factor of about 1.4.
HABIT_COST = 0.12
#: The same for the habit of a whole source, which its median speaks against: it gives way only to a factor of about e.
SOURCE_COST = 1.0
#: Two choices whose costs differ by less count as equally good, and the solution as not unique.
TIE = 1e-6


def _literal_map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def settle_statements(
    df: DataFrame, statements: str, unit_factor: dict[str, float], currency_factor: dict[str, float], habit_unit: str, habit_currency: str, habit_scale: str
) -> DataFrame:
    """df with `settled` struct<low, high, residual, unique>: the record's quantity in common units.

    statements: array<struct<low, high, unit, currency, thousands>>. A stated unit or currency stands. An open
    unit may be any of unit_factor, at HABIT_COST unless it is the habit; an open currency is the habit's; the
    habit's scale applies to a figure without unit, currency and thousands mark. Each candidate of the
    first statement is scored with the best candidate of every other one (squared differences of logs
    plus habit costs), so the search grows linearly with the statements.

    Null or empty statements, and records of which no candidate has a value (no unit, no habit), give
    null. Without a habit and without an identity to decide, several units are equally good: unique is
    false and low and high are those of no candidate (null). Rows are kept; extra columns are untouched.
    """
    units, currencies = _literal_map(unit_factor), _literal_map(currency_factor)
    names = F.array(*[F.lit(u) for u in unit_factor])

    def candidates(s: Column) -> Column:
        bare = s["unit"].isNull() & s["currency"].isNull() & ~F.coalesce(s["thousands"], F.lit(False))
        rate = F.element_at(currencies, F.coalesce(s["currency"], F.col(habit_currency)))
        scale = F.when(bare, F.coalesce(F.col(habit_scale), F.lit(1.0))).otherwise(1.0)

        def of(u: Column) -> Column:
            f = F.element_at(units, u) * rate * scale
            cost = F.when(s["unit"].isNotNull() | u.eqNullSafe(F.col(habit_unit)), 0.0).otherwise(HABIT_COST)
            return F.struct(cost.alias("cost"), (s["low"] * f).alias("low"), (s["high"] * f).alias("high"))

        pool = F.when(s["unit"].isNotNull(), F.array(s["unit"])).otherwise(names)
        return F.filter(F.transform(pool, of), lambda x: x["low"] > 0)

    def mid(x: Column) -> Column:
        return (F.log(x["low"]) + F.log(x["high"])) / 2

    def score(x: Column, others: Column) -> Column:
        rest = F.transform(
            F.filter(others, lambda o: F.size(o) > 0),
            lambda o: F.array_min(F.transform(o, lambda y: y["cost"] + (mid(y) - mid(x)) * (mid(y) - mid(x)))),
        )
        return F.struct((x["cost"] + F.aggregate(rest, F.lit(0.0), lambda a, b: a + b)).alias("total"), x["low"].alias("low"), x["high"].alias("high"))

    def settle(scored: Column) -> Column:
        best, second = F.try_element_at(scored, F.lit(1)), F.try_element_at(scored, F.lit(2))
        unique = second.isNull() | (second["total"] - best["total"] > TIE)
        return F.when(
            best.isNotNull(),
            F.struct(F.when(unique, best["low"]).alias("low"), F.when(unique, best["high"]).alias("high"), best["total"].alias("residual"), unique.alias("unique")),
        )

    # each step is bound by a lambda and the last one by the generator, so that no later filter copies the search
    said = F.filter(F.array(F.col(statements)), lambda s: F.size(s) > 0)
    pools = F.transform(said, lambda s: F.struct(candidates(s[0]).alias("first"), F.transform(F.slice(s, 2, 1_000_000), candidates).alias("others")))
    scored = F.transform(pools, lambda p: F.array_sort(F.transform(p["first"], lambda x: score(x, p["others"]))))
    return df.select("*", F.explode_outer(F.transform(scored, settle)).alias("settled"))


def settle_columns(df: DataFrame, by: str, identity: dict[str, int], candidates: dict[str, dict[str, float]]) -> DataFrame:
    """One row per value of `by` and best unit combination: by, units map<column, unit>, residual, spread, n, unique.

    identity: exponents of the columns in a product that is 1 in common units, {"mass": 1, "density": -1, "volume": -1}.
    candidates: for each column its possible units and their factors to the common unit. One aggregation of the
    raw log residual per group serves all combinations, as a choice of units shifts it by a constant:
    residual = |median(raw) + sum(exponent x log factor)|. Combinations equal in residual (a rescaling that
    the identity can't see) all come out, with unique = false. Rows with a null, zero or negative figure say
    nothing about units and are left out; null `by` is a group of its own; groups without a usable row give
    no row.
    """
    cols = list(identity)
    raw = sum((F.log(F.col(c)) * k for c, k in identity.items()), F.lit(0.0))
    usable = None
    for c in cols:
        usable = (F.col(c) > 0) if usable is None else usable & (F.col(c) > 0)
    stats = df.filter(usable).groupBy(by).agg(
        F.percentile_approx(raw, 0.5, 10_000).alias("raw"), F.stddev_pop(raw).alias("spread"), F.count("*").alias("n")
    )
    combos = []
    for choice in product(*[candidates[c].items() for c in cols]):
        shift = sum(identity[c] * math.log(f) for c, (_, f) in zip(cols, choice, strict=True))
        units = F.create_map(*[F.lit(x) for c, (u, _) in zip(cols, choice, strict=True) for x in (c, u)])
        combos.append(F.struct(F.round(F.abs(F.col("raw") + shift), 9).alias("residual"), units.alias("units")))
    scored = stats.withColumn("combo", F.explode(F.array(*combos)))
    best = stats.withColumn("least", F.array_min(F.transform(F.array(*combos), lambda x: x["residual"]))).select(F.col(by).alias("_by"), "least")
    kept = scored.join(best, scored[by].eqNullSafe(best["_by"])).filter(F.col("combo.residual") - F.col("least") <= TIE).drop("_by")
    count = kept.groupBy(F.col(by).alias("_by")).agg(F.count("*").alias("_solutions"))
    return kept.join(count, kept[by].eqNullSafe(count["_by"])).select(
        by, F.col("combo.units").alias("units"), F.col("combo.residual").alias("residual"), "spread", "n", (F.col("_solutions") == 1).alias("unique")
    )


def settle_sources(df: DataFrame, by: str, statements: str, unit_factor: dict[str, float], currency_factor: dict[str, float], habit_unit: str, habit_currency: str, habit_scale: str) -> DataFrame:
    """(by, unit, residual, figures, unique): the unit that each source means where it states none, for sources with a stated habit.

    All records speak of one quantity, so the identity  figure x factor = quantity  ties a source's open figures to the stated ones of all
    sources: of all units the one comes out whose squared log residual of the medians, plus SOURCE_COST for leaving the stated habit, is least. unique
    is false where another one is as good. One aggregation by source; the units are tried on its medians. Sources without open or usable figures keep their habit.
    """
    units, currencies = _literal_map(unit_factor), _literal_map(currency_factor)
    s = F.try_element_at(F.col(statements), F.lit(1))
    bare = s["unit"].isNull() & s["currency"].isNull() & ~F.coalesce(s["thousands"], F.lit(False))
    mid = (F.log(s["low"]) + F.log(s["high"])) / 2 + F.log(F.element_at(currencies, F.coalesce(s["currency"], F.col(habit_currency)))) + F.log(F.when(bare, F.coalesce(F.col(habit_scale), F.lit(1.0))).otherwise(1.0))
    x = df.select(by, F.col(habit_unit).alias("_unit"), F.when(s["unit"].isNull(), mid).alias("open"), F.when(s["unit"].isNotNull(), mid + F.log(F.element_at(units, s["unit"]))).alias("said"))
    said = x.agg(F.percentile_approx("said", 0.5, 10_000).alias("said"))
    each = x.filter(F.col("_unit").isNotNull()).groupBy(by).agg(F.min("_unit").alias("_unit"), F.percentile_approx("open", 0.5, 10_000).alias("open"), F.count("open").alias("figures"))
    tried = F.array(*[F.struct((F.coalesce(F.pow(F.col("open") + math.log(f) - F.col("said"), 2), F.lit(0.0)) + F.when(F.col("_unit") == u, 0.0).otherwise(SOURCE_COST)).alias("residual"), F.lit(u).alias("unit")) for u, f in unit_factor.items()])
    best = each.crossJoin(F.broadcast(said)).withColumn("_t", F.array_sort(tried))  # one row
    return best.select(by, F.col("_t")[0]["unit"].alias("unit"), F.col("_t")[0]["residual"].alias("residual"), "figures", (F.size("_t") < 2) | (F.try_element_at("_t", F.lit(2))["residual"] - F.col("_t")[0]["residual"] > TIE)).toDF(by, "unit", "residual", "figures", "unique")


def band_of(amount: Column, bands: DataFrame, band_id: str, low: str, high: str) -> Column:
    """The id of the band with low <= amount < high, as bigint; null outside all bands and for null and NaN. bands is a bounded reference table without overlaps, looked up as literals."""
    rows = sorted((float(r[low]), float(r[high]), int(r[band_id])) for r in bounded_rows(bands.select(low, high, band_id), REFERENCE_ROWS, "the bands") if None not in (r[low], r[high]))
    if not rows:
        return F.lit(None).cast("bigint")
    lows, highs, ids = (F.lit(list(x)) for x in zip(*rows, strict=True))
    at = F.size(F.filter(lows, lambda x: x <= amount))
    inside = amount.isNotNull() & ~F.isnan(amount) & (at > 0)
    return F.when(inside & (amount < F.try_element_at(highs, at)), F.try_element_at(ids, at).cast("bigint"))
