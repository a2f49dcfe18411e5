"""Judgments of records: what is cached, taken over or decided by rule, how they refer to each other, and what comes of them. All amounts, caps and bounds are the caller's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quernwork.functions.jobtext import strict_instant


def limited(description: Column | str, mark: str = "[truncated]") -> Column:
    """Whether a description says little: blank, or ending with the mark of a cut."""
    text = F.trim(F.coalesce(F.col(description) if isinstance(description, str) else description, F.lit("")))
    return (text == "") | F.endswith(text, F.lit(mark))


def readable_rows(rows: DataFrame, id_col: str, stamp: str, closed: Column) -> tuple[DataFrame, DataFrame]:
    """(usable rows, faults (id, fault)): rows without an id or closed ones are in neither; ids that occur twice and stamps without an offset are faults."""
    open_rows = rows.filter((F.coalesce(id_col, F.lit("")) != "") & ~F.coalesce(closed, F.lit(False)))
    twice = rows.filter(F.coalesce(id_col, F.lit("")) != "").groupBy(id_col).agg(F.count("*").alias("_n")).filter("_n > 1")
    x = open_rows.join(twice, id_col, "left").withColumn("fault", F.when(F.col("_n").isNotNull(), "duplicate id").when(strict_instant(stamp).isNull(), "no instant with an offset"))
    return x.filter("fault is null").drop("_n", "fault"), x.filter("fault is not null").select(id_col, "fault").distinct()


def cached(records: DataFrame, results: DataFrame) -> DataFrame:
    """records (job_id, fingerprint, policy, ...) with the saved judgment (canonical_id, score) of equal job, fingerprint and policy; nulls where there is none."""
    keys = ["job_id", "fingerprint", "policy"]
    one = results.groupBy(*keys).agg(F.max(F.struct("canonical_id", "score")).alias("_r"))
    return records.join(one, keys, "left").select(*records.columns, F.col("_r.canonical_id").alias("canonical_id"), F.col("_r.score").alias("score"))


def first_known(records: DataFrame, sources: list[tuple[str, DataFrame]], key: str, value: str) -> DataFrame:
    """(key, value, origin): of several sources (key, value) in the order given the first that knows a record; nulls where none does."""
    x, taken = records.select(key), F.lit(None)
    values = []
    for n, (name, df) in enumerate(sources):
        x = x.join(df.groupBy(key).agg(F.max(value).alias(f"_{n}")), key, "left")
        values.append(F.col(f"_{n}"))
        taken = F.coalesce(taken, F.when(F.col(f"_{n}").isNotNull(), name))
    return x.select(key, F.coalesce(*values).alias(value), taken.alias("origin"))


def without_conflicts(judgments: DataFrame, saved: DataFrame) -> DataFrame:
    """judgments (job_id, canonical_id, duplicate_ids, ...) where one that names a member saved (job_id, canonical_id) under another canonical stands by itself: its own canonical, without duplicates."""
    named = judgments.select("job_id", F.col("canonical_id").alias("_c"), F.explode(F.array_union("duplicate_ids", F.array("canonical_id"))).alias("_m"))
    other = named.join(saved.select(F.col("job_id").alias("_m"), F.col("canonical_id").alias("_s")), "_m").filter("_s <> _c").select("job_id").distinct().withColumn("_x", F.lit(True))
    x = judgments.join(other, "job_id", "left")
    return x.withColumns({"canonical_id": F.when(F.col("_x"), F.col("job_id")).otherwise(F.col("canonical_id")), "duplicate_ids": F.when(F.col("_x"), F.array().cast("array<string>")).otherwise(F.col("duplicate_ids"))}).drop("_x")


def inherited(judgments: DataFrame, saved: DataFrame) -> DataFrame:
    """judgments (job_id, canonical_id, duplicate_ids, score) that take over the saved judgment (job_id, canonical_id, duplicate_ids, score) of their canonical: its score, and the duplicates of both, without the canonical, in order."""
    s = saved.select(F.col("job_id").alias("canonical_id"), F.col("canonical_id").alias("_c"), F.col("duplicate_ids").alias("_d"), F.col("score").alias("_s"))
    x = judgments.join(s, "canonical_id", "left")
    known = F.col("_c").isNotNull()
    both = F.array_union(F.array_union(F.array("canonical_id"), "duplicate_ids"), F.col("_d"))
    rest = F.array_sort(F.array_except(both, F.array("_c")))
    return x.select("job_id", F.coalesce("_c", "canonical_id").alias("canonical_id"), F.when(known, rest).otherwise(F.col("duplicate_ids")).alias("duplicate_ids"), F.when(known, F.col("_s")).otherwise(F.col("score")).alias("score"))


def capped_score(score: Column, caps: list[tuple[Column, int]]) -> Column:
    """A score no larger than the cap of any condition that holds."""
    return F.least(score, *[F.when(F.coalesce(c, F.lit(False)), cap) for c, cap in caps]) if caps else score


def banded(score: Column, bands: list[tuple[int, str]], below: str) -> Column:
    """The name of the first band, from the highest bound down, that a score reaches."""
    out = F.lit(below)
    for least, name in sorted(bands):
        out = F.when(score >= least, name).otherwise(out)
    return F.when(score.isNotNull(), out)


def remarks(notes: Column, parts: list[Column], canonical: Column, own: Column) -> Column:
    """Notes with the parts that are not null as one sentence behind them, and the canonical record named ahead where it is another one."""
    said = F.array_join(F.array_compact(F.array(*parts)), "; ")
    sentence = F.concat(F.upper(F.substring(said, 1, 1)), F.substring(said, F.lit(2), F.length(said)), F.lit("."))
    text = F.when(said != "", F.concat_ws(" ", F.trim(notes), sentence)).otherwise(F.trim(notes))
    return F.when(canonical != own, F.concat(F.lit("Duplicate of "), canonical, F.lit(". "), text)).otherwise(text)


def pre_judged(records: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """(job_id, rule): the first rule, in the order given, that settles a record ahead of any judge; records that none settles are left out."""
    rule = F.lit(None).cast("string")
    for name, holds in reversed(rules):
        rule = F.when(F.coalesce(holds, F.lit(False)), name).otherwise(rule)
    return records.select("job_id", rule.alias("rule")).filter("rule is not null")


def labelled(description: Column | str, job_type: Column | str, labels: list[str], kinds: list[str], unless: str) -> Column:
    """Whether a text labels itself with one of the kinds ("<label>: <kind>") or says "is a <kind> position", and neither it nor the type has what `unless` matches."""
    d, t = (F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in (description, job_type))
    kind = "|".join(kinds)
    said = F.lower(d).rlike(rf"(?:{'|'.join(labels)})\s*[:\-]\s*\**\s*(?:{kind})|\bis\s+an?\s+(?:{kind})\s+(?:position|role|job)\b")
    return said & ~F.lower(F.concat_ws("\n", t, d)).rlike(unless)


def valid_pay(low: Column, high: Column, unit: Column, units: list[str]) -> Column:
    """Whether a range of pay is sound: both ends known or none, none negative or endless, in order, in a known unit."""
    both = low.isNull() == high.isNull()
    fine = lambda c: c.isNull() | ((c >= 0) & ~F.isnan(c) & (c < float("inf")))
    return both & fine(low) & fine(high) & F.coalesce(low <= high, F.lit(True)) & F.coalesce(unit.isin(*units), F.lit(False))


def config_faults(excluded: list[str], exceptions: dict[str, list[str]], numbers: dict[str, tuple[float | None, float]]) -> list[str]:
    """What is wrong with a configuration: exceptions to keywords that aren't excluded, and numbers below their least value (null ones are unset)."""
    unknown = sorted(set(exceptions) - set(excluded))
    return ([f"exceptions to {unknown}, which aren't excluded"] if unknown else []) + [f"{k} is below {least}" for k, (v, least) in sorted(numbers.items()) if v is not None and v < least]


def retry_delay(reviewed: Column, pending: Column, failed: Column, soon: int, later: int) -> Column:
    """Seconds until the next pass: soon where one made progress and records are left, later where it failed, made none or nothing is left."""
    return F.when((reviewed > 0) & (pending > 0) & ~F.coalesce(failed, F.lit(False)), soon).otherwise(later)
