"""Best representative of each duplicate group: field-by-field survivorship in one aggregation.

For each attribute the survivor is the maximum of a composite struct (usable, priorities ..., job_id), so all
attributes of all groups come from a single pass with map-side combination; a group of any size never sits in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quernwork.functions.text import fold, source_key, words_only
from quernwork.plans.pay_plan import jobs_with_pay
from quernwork.session import bounded_rows, table

#: Texts that stand for a missing description, as folded words.
PLACEHOLDERS = [
    "", "n a", "na", "none", "null", "nan", "tbd", "tba", "tbc", "no description", "description not available", "no description available", "not available", "to be confirmed",
    "voir l annonce", "see posting for details", "see posting", "see job posting", "see website", "description a venir", "coming soon", "a venir",
]
#: The trust rank of sources without a profile.
LAST = 2**31 - 1


def is_placeholder(c: Column) -> Column:
    return F.coalesce(words_only(fold(c)), F.lit("")).isin(PLACEHOLDERS)


def distinct_lines(c: Column) -> Column:
    """The number of distinct non-blank lines, list markers and outer blanks aside; 0 for null, blank and placeholder texts."""
    plain = F.regexp_replace(c, r"(?i)</(?:p|li|div|tr|h\d)>|<br\s*/?>", "\n")
    bare = F.transform(F.split(plain, r"[\r\n]+"), lambda x: F.regexp_replace(F.regexp_replace(x, r"^[\s\u00A0]*(?:(?:[-*•·▪◦–—]|\(?\d{1,3}[.)])[\s\u00A0]+)?", ""), r"[\s\u00A0]+$", ""))
    lines = F.array_distinct(F.filter(bare, lambda x: ~x.rlike(r"^(?:[-*•·▪◦–—]|\d{1,3}[.)])?$")))
    return F.when(c.isNull() | is_placeholder(c), 0).otherwise(F.size(lines))


def survivors(groups: DataFrame, jobs: DataFrame, paid: DataFrame, profiles: DataFrame) -> DataFrame:
    """(group_id, description_job_id, salary_job_id, source_job_id): one row per group.

    groups (group_id, job_id) may repeat rows; members that jobs doesn't know count for nothing. Descriptions: most distinct
    lines, then the more trusted source, then the latest updated_at. Salaries: the latest updated_at of the jobs
    in paid (job_id). Sources: the smallest trust_rank, then the latest updated_at; sources without a profile rank
    last. Null instants are the earliest; what is still tied goes to the largest job_id. '' where no member has the field.
    """
    members = groups.select("group_id", "job_id").distinct()
    bounded_rows(profiles.select("source"), 10_000, "source_profiles")
    trust = F.broadcast(profiles.select(source_key("source").alias("_source"), "trust_rank").groupBy("_source").agg(F.min("trust_rank").alias("trust_rank")))
    wanted = jobs.select("job_id", "primary_source", "description", "updated_at").join(members.select("job_id").distinct(), "job_id", "left_semi")
    facts = (
        wanted.withColumn("_source", source_key("primary_source"))
        .join(trust, "_source", "left")
        .join(paid.select("job_id").distinct().withColumn("_paid", F.lit(True)), "job_id", "left")
        .select("job_id", distinct_lines(F.col("description")).alias("lines"), (-F.coalesce("trust_rank", F.lit(LAST))).alias("trust"), "updated_at", F.coalesce("_paid", F.lit(False)).alias("paid"))
    )
    known = F.col("lines").isNotNull()
    best = members.join(facts, "job_id", "left").groupBy("group_id").agg(
        F.max(F.when(known, F.struct(F.col("lines") > 0, "lines", "trust", "updated_at", "job_id"))).alias("d"),
        F.max(F.when(known, F.struct("paid", "updated_at", "job_id"))).alias("s"),
        F.max(F.when(known, F.struct("trust", "updated_at", "job_id"))).alias("p"),
    )
    return best.select(
        "group_id",
        F.coalesce(F.when(F.col("d.lines") > 0, F.col("d.job_id")), F.lit("")).alias("description_job_id"),
        F.coalesce(F.when(F.col("s.paid"), F.col("s.job_id")), F.lit("")).alias("salary_job_id"),
        F.coalesce("p.job_id", F.lit("")).alias("source_job_id"),
    )


def _survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs, groups, profiles = (table(spark, sf_dir, t) for t in ("jobs", "dup_groups", "source_profiles"))
    members = jobs.join(groups.select("job_id").distinct(), "job_id", "left_semi")
    paid = jobs_with_pay(members, profiles, table(spark, sf_dir, "pay_units"), table(spark, sf_dir, "fx_rates")).filter("settled.unique").select("job_id")
    return survivors(groups, jobs, paid, profiles)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per group: the members that give description, salary and source."""
    return _survivors(spark, sf_dir)


def p2_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surviving record of every group: its fields' values."""
    best = _survivors(spark, sf_dir)
    jobs = table(spark, sf_dir, "jobs")
    for field, column in (("description", "description"), ("salary", "salary"), ("source", "primary_source")):
        best = best.join(jobs.select(F.col("job_id").alias(f"{field}_job_id"), F.col(column).alias(field)), f"{field}_job_id", "left")
    return best.select("group_id", "description", "salary", "source")


QUERIES = {"p2_found": p2_found, "p2_records": p2_records}
