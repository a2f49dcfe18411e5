"""Evidence about links: which record to check, what the answers say together, and what a budget covers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quernwork.functions.jobtext import external_url, url_host

#: The classes of sources: what the absence or the answer of a link is worth.
CLASSES = {
    "full_listing": ("greenhouse", "lever", "ashby", "smartrecruiters", "workday", "successfactors"),
    "listing_only": ("smartrecruiters", "ashby", "successfactors"),
    "employer": ("greenhouse", "lever", "ashby", "smartrecruiters", "workday", "successfactors", "oracle"),
    "direct": ("jobbank", "linkedin", "indeed"),
    "uncheckable": ("glassdoor", "zip_recruiter"),
}
DAY = 86_400


def is_class(source: Column | str, name: str) -> Column:
    return (F.col(source) if isinstance(source, str) else source).isin(*CLASSES[name])


def backoff_days(streak: Column) -> Column:
    """Days to wait after so many answers "alive" in a row: 1, 2, 4, and 4 from then on. The exponent is clamped, so no streak overflows."""
    return F.pow(F.lit(2), F.least(F.greatest(F.coalesce(streak, F.lit(0)) - 1, F.lit(0)), F.lit(2))).cast("int")


def is_due(checked_at: Column, streak: Column, now: Column) -> Column:
    return checked_at.isNull() | (checked_at + F.make_dt_interval(backoff_days(streak)) <= now)


def candidates(entities: DataFrame, links: DataFrame, now: Column, unwanted: DataFrame | None = None, page_check: Column | None = None, early: str | None = None) -> DataFrame:
    """(job_id, checked_at, last_seen, checkable, long_unseen): open, included records due for a check, in the order of checked_at (never first), last_seen, job_id.

    All links must be of known sources. A record is checkable if a link's source can be asked or page_check (a condition on a link, such as
    "its apply URL is an employer's page") holds for one. Checkable ones qualify when due and not shown by a full listing for
    2 days (none counts as never); the others when no link has been seen for 30 days, whether due or not. early: a source that is
    asked too where nothing else can be: its records qualify when due and unseen for 2 days. unwanted (job_id) spends no request, so it
    only qualifies where none is needed. One aggregation over the links with conditional maxima.
    """
    one = is_class("source", "full_listing") | is_class("source", "direct")
    stats = links.groupBy("job_id").agg(
        F.max("last_seen").alias("last_seen"),
        F.max(F.when(is_class("source", "full_listing"), F.col("last_seen"))).alias("listed"),
        F.bool_or(one | F.coalesce(page_check, F.lit(False)) if page_check is not None else one).alias("checkable"),
        F.bool_and(one | is_class("source", "uncheckable")).alias("known"),
        F.bool_or(F.col("source") == early if early else F.lit(False)).alias("early"),
    )
    open_ones = entities.filter("closed_at is null and excluded_at is null").select("job_id", F.col("liveness_checked_at").alias("checked_at"), is_due(F.col("liveness_checked_at"), F.col("liveness_alive_streak"), now).alias("due"))
    old = now - F.make_dt_interval(F.lit(2))
    x = open_ones.join(stats.filter("known"), "job_id").withColumn("long_unseen", F.col("last_seen") <= now - F.make_dt_interval(F.lit(30)))
    stale = F.col("listed").isNull() | (F.col("listed") < old)
    qualifies = F.when(F.col("checkable"), F.col("due") & stale).when(F.col("early"), F.col("long_unseen") | (F.col("due") & (F.col("last_seen") < old))).otherwise(F.col("long_unseen"))
    x = x.filter(qualifies)
    if unwanted is not None:
        flagged = unwanted.select("job_id").distinct().withColumn("_unwanted", F.lit(True))
        asks = F.col("checkable") | (F.col("early") & ~F.col("long_unseen"))
        x = x.join(flagged, "job_id", "left").filter(~(asks & F.coalesce("_unwanted", F.lit(False))))
    return x.select("job_id", "checked_at", "last_seen", "checkable", "long_unseen").orderBy(F.col("checked_at").asc_nulls_first(), "last_seen", "job_id")


def link_order() -> list[Column]:
    """Employers' links first, then those answered in batches, then as they were first seen."""
    return [~is_class("source", "employer"), F.col("source") != "indeed", F.col("first_seen"), F.col("source"), F.col("source_id")]


def fold_answers(answers: DataFrame) -> DataFrame:
    """(job_id, result, closed_by_employer) from answers (job_id, rank, source, answer, hosted, long_unseen, dropped), answer in gone, alive, unknown.

    Links of uncheckable sources have no say. An unknown link of a listing that dropped it counts as gone. In rank order: an employer's
    first answer other than unknown decides; without one, a hosted "gone" ahead of all others than gone decides, then the first
    other than gone, else "gone" if all say so; without any aggregator the result is unknown, but gone where no link can be checked and all are
    long unseen. Closed form: minima of the ranks that matter, in one aggregation.
    """
    checkable = ~is_class("source", "uncheckable")
    turned = F.when((F.col("answer") == "unknown") & is_class("source", "listing_only") & F.coalesce("dropped", F.lit(False)), "gone").otherwise(F.col("answer"))
    x = answers.withColumns({"answer": turned, "_own": checkable & is_class("source", "employer"), "_other": checkable & ~is_class("source", "employer")})
    ans = F.col("answer")
    r = x.groupBy("job_id").agg(
        F.min_by("answer", F.when(F.col("_own") & (ans != "unknown"), F.col("rank"))).alias("own"),
        F.count_if("_other").alias("others"),
        F.min(F.when(F.col("_other") & (ans != "gone"), F.col("rank"))).alias("first_not_gone"),
        F.min_by("answer", F.when(F.col("_other") & (ans != "gone"), F.col("rank"))).alias("not_gone"),
        F.min(F.when(F.col("_other") & (ans == "gone") & F.col("hosted"), F.col("rank"))).alias("first_hosted"),
        F.count_if(checkable).alias("checkable"),
        F.bool_and(F.coalesce("long_unseen", F.lit(False))).alias("long_unseen"),
    )
    initial = F.when((F.col("checkable") == 0) & F.col("long_unseen"), "gone").otherwise("unknown")
    others = F.when(F.col("first_hosted").isNotNull() & (F.col("first_not_gone").isNull() | (F.col("first_hosted") < F.col("first_not_gone"))), "gone").otherwise(F.coalesce("not_gone", F.lit("gone")))
    result = F.when(F.col("own").isNotNull(), F.col("own")).when(F.col("others") == 0, initial).otherwise(others)
    return r.select("job_id", result.alias("result"), F.coalesce(F.col("own") == "gone", F.lit(False)).alias("closed_by_employer"))


def record_links(links: DataFrame, answers: DataFrame, now: Column) -> DataFrame:
    """links with gone_at and apply_url after answers (source, source_id, answer, apply_url, answered): gone sets the instant, alive clears it, unknown leaves it.

    The apply URL is replaced where the source answered about it (answered), blank by null; links without an answer stay as they are.
    """
    a = answers.select("source", "source_id", F.col("answer").alias("_a"), F.nullif(F.col("apply_url"), F.lit("")).alias("_u"), F.col("answered").alias("_said"))
    x = links.join(a, ["source", "source_id"], "left")
    gone = F.when(F.col("_a") == "gone", now).when(F.col("_a") == "alive", F.lit(None)).otherwise(F.col("gone_at"))
    return x.withColumns({"gone_at": gone, "apply_url": F.when(F.coalesce("_said", F.lit(False)), F.col("_u")).otherwise(F.col("apply_url"))}).drop("_a", "_u", "_said")


def batch_answers(asked: DataFrame, replies: DataFrame) -> DataFrame:
    """asked (source_id) with answer, apply_url and hosted from replies (key, expired, view_url, host): a key that the reply leaves out stays without an answer (null), which is not "unknown".

    The key is the id without its source's prefix; a reply whose flag isn't a boolean says nothing. hosted: the view URL is at the site itself (host).
    """
    r = replies.filter("expired is not null").groupBy("key").agg(F.max(F.struct("expired", "view_url", "host")).alias("r"))
    own = F.endswith(F.concat(F.lit("."), url_host("r.view_url")), F.concat(F.lit("."), F.col("r.host")))
    x = asked.join(r, F.regexp_replace(asked["source_id"], "^in-", "") == r["key"], "left")
    return x.select(*asked.columns, F.when(F.col("r.expired"), "gone").when(~F.col("r.expired"), "alive").alias("answer"), external_url("r.view_url").alias("apply_url"), F.coalesce(own, F.lit(False)).alias("hosted"))


def employer_pages(links: DataFrame, page: Column) -> DataFrame:
    """(job_id, page): employers' pages behind a record's apply URLs, one for each URL; none where a link is an employer's own already. page: struct<source, source_id, url> of a link, or null."""
    own = links.filter(is_class("source", "employer")).select("job_id").distinct()
    found = links.filter("job_id is not null").withColumn("page", page).filter("page is not null").join(own, "job_id", "left_anti")
    return found.groupBy("job_id", F.col("page.url").alias("_url")).agg(F.max_by("page", F.struct("first_seen", "source", "source_id")).alias("page")).drop("_url")


def record_results(entities: DataFrame, results: DataFrame, now: Column) -> DataFrame:
    """(job_id, streak, closed_at, closed_by_employer) after the results: alive adds to the streak, gone resets it and closes, unknown keeps it; the employer's flag is overwritten."""
    e = entities.join(results, "job_id")
    streak = F.coalesce("liveness_alive_streak", F.lit(0))
    return e.select(
        "job_id",
        F.when(F.col("result") == "alive", streak + 1).when(F.col("result") == "gone", 0).otherwise(streak).alias("streak"),
        F.when(F.col("result") == "gone", now).otherwise(F.col("closed_at")).alias("closed_at"),
        results["closed_by_employer"].alias("closed_by_employer"),
    )


def within_budget(df: DataFrame, cost: str, order: list[Column], budget: int, buckets: str) -> DataFrame:
    """df with `spent` (the cost up to and including a row, in order) for the rows that the budget covers.

    The prefix sum runs in two steps: totals per value of `buckets` (the leading order column, in few values) give each bucket's start, a
    window within the bucket the rest; no single task sorts all rows.
    """
    totals = df.groupBy(buckets).agg(F.sum(cost).alias("_t"))
    starts = totals.withColumn("_start", F.coalesce(F.sum("_t").over(W.orderBy(F.col(buckets).asc_nulls_first()).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_t")
    inside = F.sum(cost).over(W.partitionBy(buckets).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    out = df.withColumn("_in", inside)
    out = out.join(F.broadcast(starts), out[buckets].eqNullSafe(starts[buckets])).select(out["*"], (F.col("_start") + F.col("_in")).alias("spent")).drop("_in")
    return out.filter(F.col("spent") <= budget)


def dropped_from_listing(links: DataFrame, now: Column) -> DataFrame:
    """(source, source_id): links of sources whose listing alone can show a removal, unseen for 2 days while their board was seen since. The board's last sighting is one value per board; a hot board is reduced before the join."""
    mine = links.filter(is_class("source", "listing_only") & F.col("board").isNotNull())
    limit = now - F.make_dt_interval(F.lit(2))
    live = mine.groupBy("source", "board").agg(F.max("last_seen").alias("board_seen")).filter(F.col("board_seen") >= limit)
    old = mine.groupBy("source", "board", "source_id").agg(F.max("last_seen").alias("last_seen")).filter(F.col("last_seen") < limit)
    return old.join(live, ["source", "board"], "left_semi").select("source", "source_id")


def best_url(entities: DataFrame, links: DataFrame) -> DataFrame:
    """(job_id, shown_url): a live full-listing link, else an apply link, else the record's own url if it is live or nothing is, else the first live link; in the order of first_seen, source, source_id, uncheckable ones last among the live."""
    rank = F.struct("first_seen", "source", "source_id")
    live = F.col("gone_at").isNull()
    x = links.groupBy("job_id").agg(
        F.min_by("url", F.when(live & is_class("source", "full_listing"), rank)).alias("listed"),
        F.min_by("apply_url", F.when(F.length(F.trim("apply_url")) > 0, rank)).alias("apply"),
        F.min_by("url", F.when(live, F.struct(is_class("source", "uncheckable"), "first_seen", "source", "source_id"))).alias("live"),
        F.collect_set(F.when(live, F.col("url"))).alias("live_urls"),
    )
    own = F.when(F.col("live").isNull() | F.array_contains("live_urls", F.col("url")), F.col("url"))
    return entities.select("job_id", "url").join(x, "job_id", "left").select("job_id", F.coalesce("listed", "apply", own, "live").alias("shown_url"))
