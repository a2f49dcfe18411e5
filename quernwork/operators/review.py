"""Reviews and cached judgments: freshness, queues, twins, fingerprints, differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quernwork.functions.jobtext import norm_company, norm_title

INPUTS = ["title", "company", "location", "city", "description", "salary", "job_type"]


def group_key() -> Column:
    """The key of records that are judged together: employer, title and city (else location)."""
    place = F.lower(F.coalesce(F.nullif(F.trim("city"), F.lit("")), F.trim("location"), F.lit("")))
    return F.concat_ws("|", norm_company("company"), norm_title("title"), place)


def fingerprints(jobs: DataFrame) -> DataFrame:
    """(group_key, members, fingerprint): the hash of each group's sorted input hashes. Only hashes of fixed size are gathered, never the texts."""
    one = F.sha2(F.concat_ws("\u0001", *[F.coalesce(F.col(c), F.lit("")) for c in INPUTS]), 256)
    rows = jobs.select(group_key().alias("group_key"), "job_id", one.alias("h"))
    # the sum and count of hashed pieces identify the multiset without sorting a group in one task
    piece = F.conv(F.substring("h", 1, 8), 16, 10).cast("decimal(20,0)")
    other = F.conv(F.substring("h", 9, 8), 16, 10).cast("decimal(20,0)")
    g = rows.groupBy("group_key").agg(F.count("*").alias("members"), F.sum(piece).cast("string").alias("a"), F.sum(other).cast("string").alias("b"))
    return g.select("group_key", "members", F.sha2(F.concat_ws("|", F.col("members").cast("string"), "a", "b"), 256).alias("fingerprint"))


def twins(jobs: DataFrame, results: DataFrame) -> DataFrame:
    """(job_id, twin_id): for a record without a result the one with equal inputs whose result was written last (results: job_id, written_at); ties to the smallest id. Equal inputs meet by hash; one twin per hash is kept before the join."""
    h = jobs.select("job_id", F.sha2(F.concat_ws("\u0001", *[F.coalesce(F.col(c), F.lit("")) for c in INPUTS]), 256).alias("h"))
    latest = results.groupBy("job_id").agg(F.max("written_at").alias("written_at"))
    done = h.join(latest, "job_id")
    newest = done.groupBy("h").agg(F.max("written_at").alias("written_at"))
    best = done.join(newest, ["h", "written_at"]).groupBy("h").agg(F.min("job_id").alias("twin_id"))
    return h.join(latest, "job_id", "left_anti").join(best, "h").select("job_id", "twin_id")


def current_reject(decision: Column, reviewed_at: Column, updated_at: Column) -> Column:
    """Whether a review still rejects: its decision is Reject and it isn't older than the record."""
    return F.coalesce((F.lower(F.trim(decision)) == "reject") & (reviewed_at >= updated_at), F.lit(False))


def needs_review(jobs: DataFrame, results: DataFrame) -> DataFrame:
    """Records with a description and no result written since they changed."""
    fresh = results.groupBy("job_id").agg(F.max("written_at").alias("_w"))
    described = jobs.filter(F.length(F.trim("description")) > 0)
    return described.join(fresh, "job_id", "left").filter(F.col("_w").isNull() | (F.col("_w") < F.col("updated_at"))).drop("_w")


def differences(have: DataFrame, want: DataFrame, key: str, value: str) -> DataFrame:
    """(key, have, want): cells whose value differs, nulls compared as values."""
    both = have.select(key, F.col(value).alias("have")).join(want.select(key, F.col(value).alias("want")), key, "left")
    return both.filter(~F.col("have").eqNullSafe(F.col("want")))
