"""Queries over the store: links, reviews, runs, merges, closure evidence, queues and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from quernwork.functions.jobtext import content_hash
from quernwork.operators import closure as C, evidence as E, incremental as I, predicates as P, resolve as R, review as V
from quernwork.plans.text_plan import _REASON, KEY, RULES
from quernwork.session import table

QUERIES, SQL = {}, {}

#: The instant at which the queries look at the store.
NOW = "2025-09-15 00:00:00"
_N = f"timestamp '{NOW}'"


def now() -> Column:
    return F.expr(f"timestamp_ntz'{NOW}'")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def links(spark: SparkSession, d: str) -> DataFrame:
    """job_sources without redeliveries: of each link the state recorded last."""
    rows = table(spark, d, "job_sources").select("source", "source_id", "job_id", "board", "url", "first_seen", "last_seen", "apply_url", "gone_at", "recorded_at")
    return R.latest_wins(rows, ["source", "source_id"], ["last_seen", "recorded_at"])


_LINKS = "(select * from (select *, row_number() over (partition by source, source_id order by last_seen desc nulls last, recorded_at desc nulls last, job_id desc nulls last, board desc nulls last, url desc nulls last, first_seen desc nulls last, apply_url desc nulls last, gone_at desc nulls last) as rn from (select source, source_id, job_id, board, url, first_seen, last_seen, apply_url, gone_at, recorded_at from job_sources)) where rn = 1)"
_FULL = "('greenhouse', 'lever', 'ashby', 'smartrecruiters', 'workday', 'successfactors')"
_CHECKABLE = "('greenhouse', 'lever', 'ashby', 'smartrecruiters', 'workday', 'successfactors', 'oracle', 'jobbank', 'linkedin', 'indeed')"
_ASKED = "('greenhouse', 'lever', 'ashby', 'smartrecruiters', 'workday', 'successfactors', 'jobbank', 'linkedin', 'indeed')"
_UNCHECKABLE, _LISTING_ONLY = "('glassdoor', 'zip_recruiter')", "('smartrecruiters', 'ashby', 'successfactors')"
_EMPLOYER = "('greenhouse', 'lever', 'ashby', 'smartrecruiters', 'workday', 'successfactors', 'oracle')"


def reviews(spark: SparkSession, d: str) -> DataFrame:
    """The latest review of each job with its fields; ties to the largest data text."""
    r = R.latest_wins(table(spark, d, "reviews").select("job_id", "data", "updated_at"), ["job_id"], ["updated_at", "data"])
    m = F.from_json("data", "map<string,string>")
    return r.select("job_id", "updated_at", F.lower(F.trim(m["AI Decision"])).alias("decision"), F.lower(F.trim(m["Application Status"])).alias("status"), m["AI Score"].alias("score_text"), "data")


_REVIEWS = "(select job_id, updated_at, lower(trim(json_extract_string(data, '$.\"AI Decision\"'))) as decision, lower(trim(json_extract_string(data, '$.\"Application Status\"'))) as status, json_extract_string(data, '$.\"AI Score\"') as score_text, data from (select *, row_number() over (partition by job_id order by updated_at desc nulls last, data desc) as rn from reviews) where rn = 1)"


@query(
    f"""select l.source, count(distinct l.job_id) as jobs, count(distinct case when r.decision = 'recommend' then l.job_id end) as recommended,
    count(distinct case when r.decision = 'maybe' then l.job_id end) as maybe, count(distinct case when r.decision = 'reject' then l.job_id end) as rejected
    from job_sources l left join {_REVIEWS} r on l.job_id = r.job_id where l.job_id is not null group by 1"""
)
def source_decision_funnel(spark: SparkSession, d: str) -> DataFrame:
    """Per source the jobs that its links lead to and their latest decisions. (source, job) pairs are made distinct before the join, so redelivered and hot links cost nothing in it."""
    pairs = table(spark, d, "job_sources").filter("job_id is not null").select("source", "job_id").distinct()
    x = pairs.join(reviews(spark, d).select("job_id", "decision"), "job_id", "left")
    return x.groupBy("source").agg(F.count("*").alias("jobs"), *[F.count_if(F.col("decision") == k).alias(n) for k, n in (("recommend", "recommended"), ("maybe", "maybe"), ("reject", "rejected"))])


@query(f"select job_id, updated_at, decision, status from {_REVIEWS}")
def latest_reviews(spark: SparkSession, d: str) -> DataFrame:
    return reviews(spark, d).select("job_id", "updated_at", "decision", "status")


@query("select primary_source, coalesce(city, '') as city, count(*) as jobs from jobs group by 1, 2")
def entities_by_source_city(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "jobs").groupBy("primary_source", F.coalesce("city", F.lit("")).alias("city")).agg(F.count("*").alias("jobs"))


@query(f"select job_id, string_agg(source || ' ' || url, chr(10) order by first_seen, source, source_id) as links from {_LINKS} where job_id is not null group by 1")
def link_list(spark: SparkSession, d: str) -> DataFrame:
    """Each job's links as one text, in the order of their first sighting. A job has at most one link per source, so a list stays small."""
    item = F.struct("first_seen", "source", "source_id", F.concat_ws(" ", "source", "url").alias("t"))
    g = links(spark, d).filter("job_id is not null").groupBy("job_id").agg(F.array_sort(F.collect_list(item)).alias("x"))
    return g.select("job_id", F.array_join(F.transform("x", lambda i: i["t"]), "\n").alias("links"))


@query("select max(started_at) as last_finished, count(*) as runs, count(finished_at) as finished from runs where true")
def run_log(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "runs").agg(F.max("started_at").alias("last_finished"), F.count("*").alias("runs"), F.count("finished_at").alias("finished"))


@query("select k as counter, sum(cast(json_extract_string(stats, '$.' || k) as bigint))::bigint as total, count(*) as runs from (select stats, unnest(json_keys(stats)) as k from runs where finished_at is not null and stats is not null) group by 1")
def run_counters(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "runs").filter("finished_at is not null and stats is not null").select(F.explode(F.from_json("stats", "map<string,bigint>")).alias("counter", "n"))
    return r.groupBy("counter").agg(F.sum("n").cast("bigint").alias("total"), F.count("*").alias("runs"))


@query("select count(distinct job_id) as unknown_reviews from reviews where job_id not in (select job_id from jobs)")
def unknown_reviews(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "reviews").select("job_id").distinct().join(table(spark, d, "jobs").select("job_id"), "job_id", "left_anti").agg(F.count("*").alias("unknown_reviews"))


@query(f"select j.job_id, j.title, r.decision, case when coalesce(r.status, '') = '' then 'not applied' else r.status end as status, case when try_cast(r.score_text as double) = floor(try_cast(r.score_text as double)) then cast(try_cast(r.score_text as double) as bigint) end as score from jobs j left join {_REVIEWS} r using (job_id) where j.excluded_at is null and j.closed_at is null")
def visible_jobs(spark: SparkSession, d: str) -> DataFrame:
    """Open, included jobs with their reviewer's fields; a score counts where it is a whole number."""
    j = table(spark, d, "jobs").filter("excluded_at is null and closed_at is null").select("job_id", "title")
    x = j.join(reviews(spark, d), "job_id", "left")
    number = F.col("score_text").try_cast("double")
    return x.select("job_id", "title", "decision", F.coalesce(F.nullif("status", F.lit("")), F.lit("not applied")).alias("status"), F.when(number == F.floor(number), number.cast("bigint")).alias("score"))


@query(f"select job_id, description_attempted_at, first_seen from jobs where coalesce(trim(description), '') = '' and closed_at is null order by description_attempted_at nulls first, first_seen desc, job_id limit 50")
def pending_descriptions(spark: SparkSession, d: str) -> DataFrame:
    """The next 50 jobs to fetch a description for: never tried first, then the oldest try, then the newest record (top-k report)."""
    j = table(spark, d, "jobs").filter("coalesce(trim(description), '') = '' and closed_at is null")
    return j.select("job_id", "description_attempted_at", "first_seen").orderBy(F.col("description_attempted_at").asc_nulls_first(), F.desc("first_seen"), "job_id").limit(50)


@query("with h as (select distinct job_id, url from job_sources where job_id is not null), x as (select h.url, j.description, j.updated_at, j.job_id from h join jobs j using (job_id) where length(trim(j.description)) > 0) select url, arg_max(job_id, (updated_at, job_id)) as from_job from x group by 1")
def described_urls(spark: SparkSession, d: str) -> DataFrame:
    """URLs whose job has a description, and the job it would be copied from."""
    h = table(spark, d, "job_sources").filter("job_id is not null").select("job_id", "url").distinct()
    j = table(spark, d, "jobs").filter("length(trim(description)) > 0").select("job_id", "updated_at")
    return h.join(j, "job_id").groupBy("url").agg(F.max_by("job_id", F.struct("updated_at", "job_id")).alias("from_job"))


def unwanted(spark: SparkSession, d: str) -> DataFrame:
    """(job_id): skipped records, and such whose current review rejects them, applied ones aside."""
    r = reviews(spark, d).join(table(spark, d, "jobs").select("job_id", F.col("updated_at").alias("changed_at")), "job_id")
    status = F.coalesce("status", F.lit(""))
    return r.filter((status == "skip") | (V.current_reject(F.col("decision"), F.col("updated_at"), F.col("changed_at")) & (status != "applied"))).select("job_id")


@query(
    f"""with due as (select job_id, liveness_checked_at as checked_at, liveness_checked_at is null or liveness_checked_at + to_days(cast(pow(2, least(greatest(coalesce(liveness_alive_streak, 0) - 1, 0), 2)) as int)) <= {_N} as due from jobs where closed_at is null and excluded_at is null),
    s as (select job_id, max(last_seen) as last_seen, max(case when source in {_FULL} then last_seen end) as listed, bool_or(source in {_ASKED} or coalesce(regexp_matches(apply_url, '/apply/[0-9]*7$'), false)) as checkable, bool_and(source in {_ASKED} or source in {_UNCHECKABLE}) as known, bool_or(source = 'zip_recruiter') as zip from {_LINKS} where job_id is not null group by 1),
    u as (select r.job_id from {_REVIEWS} r join jobs j using (job_id) where coalesce(r.status, '') = 'skip' or (coalesce(r.decision = 'reject' and r.updated_at >= j.updated_at, false) and coalesce(r.status, '') <> 'applied')),
    x as (select *, last_seen <= {_N} - interval 30 day as long_unseen from due join s using (job_id) where known)
    select job_id, checked_at, last_seen, checkable, long_unseen from x
    where case when checkable then due and (listed is null or listed < {_N} - interval 2 day) when zip then long_unseen or (due and last_seen < {_N} - interval 2 day) else long_unseen end
    and not ((checkable or (zip and not long_unseen)) and job_id in (select job_id from u))"""
)
def closure_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Open records due for a check, an apply URL of some pages standing for one that can be asked, with the early check of one source."""
    page = F.coalesce(F.col("apply_url").rlike("/apply/[0-9]*7$"), F.lit(False))
    return C.candidates(table(spark, d, "jobs"), links(spark, d).filter("job_id is not null"), now(), unwanted(spark, d), page, "zip_recruiter")


@query(f"select coalesce(liveness_alive_streak, 0) as streak, cast(pow(2, least(greatest(coalesce(liveness_alive_streak, 0) - 1, 0), 2)) as int) as wait_days, count(*) as jobs, count(*) filter (where liveness_checked_at is null or liveness_checked_at + to_days(cast(pow(2, least(greatest(coalesce(liveness_alive_streak, 0) - 1, 0), 2)) as int)) <= {_N}) as due from jobs group by 1, 2")
def backoff_due(spark: SparkSession, d: str) -> DataFrame:
    streak = F.col("liveness_alive_streak")
    return table(spark, d, "jobs").groupBy(F.coalesce(streak, F.lit(0)).alias("streak"), C.backoff_days(streak).alias("wait_days")).agg(F.count("*").alias("jobs"), F.count_if(C.is_due(F.col("liveness_checked_at"), streak, now())).alias("due"))


def answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers about links, read from the store: gone where gone_at is set, alive where seen after NOW, else unknown; hosted where there is an apply URL; dropped where the listing no longer has them."""
    x = links(spark, d).filter("job_id is not null")
    gone = C.dropped_from_listing(links(spark, d), now()).withColumn("dropped", F.lit(True))
    rank = F.row_number().over(W.partitionBy("job_id").orderBy(*C.link_order()))
    return x.join(gone, ["source", "source_id"], "left").select(
        "job_id", rank.alias("rank"), "source", "dropped",
        F.when(F.col("gone_at").isNotNull(), "gone").when(F.col("last_seen") >= now(), "alive").otherwise("unknown").alias("answer"),
        F.col("apply_url").isNotNull().alias("hosted"), (F.col("last_seen") <= now() - F.make_dt_interval(F.lit(30))).alias("long_unseen"),
    )


_DROPPED = f"""(with m as (select source, board, source_id, max(last_seen) as last_seen from {_LINKS} where source in {_LISTING_ONLY} and board is not null group by 1, 2, 3), b as (select source, board, max(last_seen) as seen from m group by 1, 2)
    select source, source_id from m join b using (source, board) where seen >= {_N} - interval 2 day and last_seen < {_N} - interval 2 day)"""
_ANSWERS = f"""(select job_id, l.source, source in {_EMPLOYER} as employer, source in {_UNCHECKABLE} as silent, row_number() over (partition by job_id order by source not in {_EMPLOYER}, source <> 'indeed', first_seen, source, source_id) as rank,
    case when gone_at is not null then 'gone' when last_seen >= {_N} then 'alive' when (source, source_id) in (select (source, source_id) from {_DROPPED}) then 'gone' else 'unknown' end as answer, apply_url is not null as hosted, last_seen <= {_N} - interval 30 day as long_unseen from {_LINKS} l where job_id is not null)"""


@query(
    f"""with r as (select job_id, arg_min(answer, rank) filter (where employer and not silent and answer <> 'unknown') as own, count(*) filter (where not employer and not silent) as others, min(rank) filter (where not employer and not silent and answer <> 'gone') as ng, arg_min(answer, rank) filter (where not employer and not silent and answer <> 'gone') as nga,
      min(rank) filter (where not employer and not silent and answer = 'gone' and hosted) as hg, count(*) filter (where not silent) as asked, bool_and(long_unseen) as lu from {_ANSWERS} group by 1)
    select job_id, case when own is not null then own when others = 0 then case when asked = 0 and lu then 'gone' else 'unknown' end when hg is not null and (ng is null or hg < ng) then 'gone' else coalesce(nga, 'gone') end as result, coalesce(own = 'gone', false) as closed_by_employer from r"""
)
def closure_fold(spark: SparkSession, d: str) -> DataFrame:
    return C.fold_answers(answers(spark, d))


@query(
    f"""with c as (select job_id, sum(case when source in {_CHECKABLE} then 1 else 0 end)::bigint as cost, min(first_seen) as f from {_LINKS} where job_id is not null group by 1),
    s as (select job_id, cost, sum(cost) over (order by f, job_id rows unbounded preceding)::bigint as spent from c)
    select job_id, cost, spent from s where spent <= 400"""
)
def budget_prefix(spark: SparkSession, d: str) -> DataFrame:
    """The jobs whose checks a budget of 400 requests covers, oldest first."""
    cost = links(spark, d).filter("job_id is not null").groupBy("job_id").agg(F.sum(F.when(F.col("source").isin(*C.CLASSES["employer"], *C.CLASSES["direct"]), 1).otherwise(0)).cast("bigint").alias("cost"), F.min("first_seen").alias("f"))
    x = C.within_budget(cost.withColumn("day", F.to_date("f")), "cost", [F.col("f"), F.col("job_id")], 400, "day")
    return x.select("job_id", "cost", F.col("spent").cast("bigint").alias("spent"))


@query(f"select source, source_id from {_DROPPED}")
def listing_absence(spark: SparkSession, d: str) -> DataFrame:
    return C.dropped_from_listing(links(spark, d), now())


@query(
    f"""with l as (select * from {_LINKS} where job_id is not null), x as (select job_id, arg_min(url, (first_seen, source, source_id)) filter (where gone_at is null and source in {_FULL}) as listed,
      arg_min(apply_url, (first_seen, source, source_id)) filter (where length(trim(apply_url)) > 0) as apply, arg_min(url, (source in ('glassdoor', 'zip_recruiter'), first_seen, source, source_id)) filter (where gone_at is null) as live,
      list(url) filter (where gone_at is null) as urls from l group by 1)
    select j.job_id, coalesce(listed, apply, case when live is null or list_contains(urls, j.url) then j.url end, live) as shown_url from jobs j left join x using (job_id)"""
)
def best_link(spark: SparkSession, d: str) -> DataFrame:
    return C.best_url(table(spark, d, "jobs"), links(spark, d).filter("job_id is not null"))


@query(
    f"""with p as (select ingest_seq, source, source_id, {KEY} as k from postings), s as (select min(ingest_seq) as ingest_seq, source, source_id, arg_min(k, ingest_seq) as k from p group by 2, 3),
    known as (select source, source_id, min(job_id) as known from job_sources where job_id is not null group by 1, 2), held as (select distinct source, job_id as keyed from job_sources where job_id is not null),
    n as (select s.*, substr(sha1(k), 1, 16) as keyed, known.known, held.keyed is not null as held from s left join known using (source, source_id) left join held on held.source = s.source and held.keyed = substr(sha1(k), 1, 16)),
    r as (select *, row_number() over (partition by source, keyed, known is null order by ingest_seq) as rn from n)
    select source, source_id, coalesce(known, case when not held and rn = 1 then keyed else substr(sha1(k || '|' || source || '|' || source_id), 1, 16) end) as entity_id from r"""
)
def resolved_identity(spark: SparkSession, d: str) -> DataFrame:
    """Every posting's entity: known links keep theirs, new ones meet by key, a second link of a source stays apart."""
    p = R.first_wins(table(spark, d, "postings").select("source", "source_id", "title", "company", "city", F.col("ingest_seq").alias("seq")), ["source", "source_id"], ["seq"])
    known = table(spark, d, "job_sources").select("source", "source_id", F.col("job_id").alias("entity_id"))
    return R.resolve_identity(p, known).select("source", "source_id", "entity_id")


_ENT = f"(select *, substr(sha1({KEY}), 1, 16) as entity_id, ingest_seq as seq from postings)"


def _last_own(c: str, filled: bool) -> str:
    return f"arg_max(coalesce({c}, ''), seq) filter (where source = ps" + (f" and length(trim(coalesce({c}, ''))) > 0" if filled else "") + ")"


def _own_or(c: str, only_filled_other: bool) -> str:
    other = f"arg_min(coalesce({c}, ''), seq)" + (f" filter (where length(trim(coalesce({c}, ''))) > 0)" if only_filled_other else "")
    return f"coalesce({_last_own(c, True)}, {other}, '')"


@query(
    f"with e as (select *, first_value(source) over (partition by entity_id order by seq) as ps from {_ENT}) select entity_id, min(ps) as primary_source, "
    + ", ".join(f"{_last_own(c, False)} as {c}" for c in ("title", "city"))
    + ", "
    + ", ".join(f"{_own_or(c, False)} as {c}" for c in ("company", "location"))
    + ", "
    + ", ".join(f"{_own_or(c, True)} as {c}" for c in ("description", "salary", "job_type"))
    + ", cast(arg_min(posted_date, seq) filter (where posted_date is not null) as varchar) as posted_date, arg_min(coalesce(url, ''), seq) as url from e group by 1"
)
def survivorship(spark: SparkSession, d: str) -> DataFrame:
    from quernwork.functions.jobtext import dedupe_key, entity_id

    p = table(spark, d, "postings").withColumn("entity_id", entity_id(dedupe_key("company", "title", "city"))).withColumn("seq", F.col("ingest_seq"))
    return R.survive(p.select("entity_id", "source", "seq", *R.MATERIAL, "posted_date", "url")).withColumn("posted_date", F.col("posted_date").cast("string"))


_HASHED = "sha1(cast(to_json([" + ", ".join(f"coalesce({{0}}.{c}, '')" for c in R.MATERIAL) + "]) as varchar))"


@query(
    f"""with p as (select * from (select *, row_number() over (partition by source, source_id order by ingest_seq desc) as rn from postings) where rn = 1), l as (select source, source_id, min(job_id) as job_id from job_sources where job_id is not null group by 1, 2),
    x as (select p.source, p.source_id, j.job_id, {_HASHED.format('p')} as a, {_HASHED.format('j')} as b from p left join l using (source, source_id) left join jobs j on j.job_id = l.job_id)
    select source, case when job_id is null then 'new' when a <> b then 'changed' else 'seen' end as label, count(*) as postings from x group by 1, 2"""
)
def change_detection(spark: SparkSession, d: str) -> DataFrame:
    """What the postings do to the store, per source: new, changed or only seen again."""
    p = R.latest_wins(table(spark, d, "postings").select("source", "source_id", "ingest_seq", *R.MATERIAL), ["source", "source_id"], ["ingest_seq"])
    known = table(spark, d, "job_sources").filter("job_id is not null").groupBy("source", "source_id").agg(F.min("job_id").alias("job_id"))
    old = table(spark, d, "jobs").select("job_id", content_hash(*R.MATERIAL).alias("old"))
    x = p.withColumn("new", content_hash(*R.MATERIAL)).select("source", "source_id", "new").join(known, ["source", "source_id"], "left").join(old, "job_id", "left")
    label = F.when(F.col("old").isNull(), "new").when(F.col("old") != F.col("new"), "changed").otherwise("seen")
    return x.groupBy("source", label.alias("label")).agg(F.count("*").alias("postings"))


@query(
    f"""with p as (select * from postings), last as (select source, source_id, arg_max(url, ingest_seq) as url, arg_max(coalesce(apply_url, ''), ingest_seq) as apply_url, arg_max(coalesce(seen, false), ingest_seq) as seen, arg_max(seen_at, ingest_seq) as seen_at from p group by 1, 2), l as {_LINKS}
    select source, source_id, case when t.seen is not null then t.url else l.url end as url, coalesce(nullif(t.apply_url, ''), l.apply_url) as apply_url, coalesce(l.first_seen, t.seen_at) as first_seen,
    case when coalesce(t.seen, false) or l.last_seen is null then greatest(l.last_seen, t.seen_at) else l.last_seen end as last_seen, case when coalesce(t.seen, false) and source in {_FULL} then null else l.gone_at end as gone_at from l full outer join last t using (source, source_id)"""
)
def merged_links(spark: SparkSession, d: str) -> DataFrame:
    """The link table after all postings."""
    new = table(spark, d, "postings").select("source", "source_id", "url", F.lit(None).cast("string").alias("raw"), F.coalesce("apply_url", F.lit("")).alias("apply_url"), F.coalesce("seen", F.lit(False)).alias("seen"), C.is_class("source", "full_listing").alias("full_listing"), "seen_at", F.col("ingest_seq").alias("seq"))
    old = links(spark, d).withColumn("raw", F.lit(None).cast("string"))
    return R.merge_links(old.select("source", "source_id", "url", "raw", "apply_url", "first_seen", "last_seen", "gone_at"), new).drop("raw")


@query(
    f"""with p as (select *, {_REASON} as reason from postings), k as (select distinct source, source_id from job_sources), r as (select p.* from p anti join k using (source, source_id) where reason is not null), ok as (select distinct source, source_id from p where reason is null),
    g as (select source, source_id, arg_max(reason, ingest_seq) as reason, min(seen_at) as first_seen, coalesce(max(case when seen then seen_at end), min(seen_at)) as last_seen from r anti join ok using (source, source_id) group by 1, 2)
    select source, reason, count(*) as rejected, min(first_seen) as first_seen, max(last_seen) as last_seen from g where last_seen >= timestamp '2026-01-15 00:00:00' - interval 60 day group by 1, 2"""
)
def rejected_history(spark: SparkSession, d: str) -> DataFrame:
    """Rejected postings that stay after pruning what was last seen over 60 days before, per source and reason."""
    p = P.route(table(spark, d, "postings"), RULES, table(spark, d, "job_sources")).withColumnsRenamed({"ingest_seq": "seq"})
    empty = p.sparkSession.createDataFrame([], "source string, source_id string, reason string, first_seen timestamp_ntz, last_seen timestamp_ntz")
    accepted = p.filter("reason is null").select("source", "source_id")
    merged = R.merge_rejected(empty, p.filter("route = 'reject'").select("source", "source_id", "reason", "seq", F.coalesce("seen", F.lit(False)).alias("seen"), "seen_at"), accepted)
    kept = R.prune(merged, F.expr("timestamp_ntz'2026-01-15 00:00:00'"))
    return kept.groupBy("source", "reason").agg(F.count("*").alias("rejected"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


@query(
    f"""with s as (select job_id, bool_or(source in {_FULL}) as full_listing, max(last_seen) as seen_at from {_LINKS} where job_id is not null group by 1)
    select job_id, seen_at > closed_at and (not coalesce(closed_by_employer, false) or full_listing or seen_at - closed_at >= interval 7 day) as reopened from jobs join s using (job_id) where closed_at is not null and seen_at is not null"""
)
def reopened_jobs(spark: SparkSession, d: str) -> DataFrame:
    """Closed jobs with the verdict of their latest sighting."""
    s = links(spark, d).filter("job_id is not null").groupBy("job_id").agg(F.bool_or(C.is_class("source", "full_listing")).alias("full_listing"), F.max("last_seen").alias("seen_at"))
    j = table(spark, d, "jobs").filter("closed_at is not null").select("job_id", "closed_at", "closed_by_employer").join(s, "job_id").filter("seen_at is not null")
    verdict = R.reopened(F.col("seen_at") > F.col("closed_at"), F.col("closed_at"), F.col("closed_by_employer"), F.col("full_listing"), F.col("seen_at"))
    return j.select("job_id", verdict.alias("reopened"))


@query(f"select job_id, case when (posted_date is null or posted_date >= date '2025-07-17') and not coalesce({_REASON} is not null, false) then null else coalesce(excluded_at, {_N}) end as excluded_at from jobs")
def reevaluated_exclusions(spark: SparkSession, d: str) -> DataFrame:
    """Exclusions under the present rules: 60 days of age at most (undated ones pass) and no reason to reject; the first instant of an exclusion is kept."""
    passes = (F.col("posted_date").isNull() | (F.col("posted_date") >= F.lit("2025-07-17").cast("date"))) & P.rejection_reason(RULES).isNull()
    return table(spark, d, "jobs").select("job_id", P.exclusion(passes, F.col("excluded_at"), now()).alias("excluded_at"))


@query("select * exclude rn from (select source, source_id, title, ingest_seq, row_number() over (partition by source, source_id order by ingest_seq) as rn from postings) where rn = 1")
def first_wins_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return R.first_wins(table(spark, d, "postings").select("source", "source_id", "title", "ingest_seq"), ["source", "source_id"], ["ingest_seq"])


@query(f"select j.job_id, coalesce(r.decision = 'reject' and r.updated_at >= j.updated_at, false) as current_reject, coalesce(r.status in ('applied'), false) as applied, coalesce(r.status in ('skip', 'closed'), false) as unwanted from jobs j join {_REVIEWS} r using (job_id)")
def review_overlay(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "jobs").select("job_id", F.col("updated_at").alias("changed_at")).join(reviews(spark, d), "job_id")
    return j.select("job_id", V.current_reject(F.col("decision"), F.col("updated_at"), F.col("changed_at")).alias("current_reject"), F.coalesce(F.col("status") == "applied", F.lit(False)).alias("applied"), F.coalesce(F.col("status").isin("skip", "closed"), F.lit(False)).alias("unwanted"))


@query("select j.job_id, j.updated_at from jobs j left join (select job_id, max(updated_at) as w from reviews group by 1) r using (job_id) where length(trim(j.description)) > 0 and (w is null or w < j.updated_at)")
def review_backlog(spark: SparkSession, d: str) -> DataFrame:
    done = table(spark, d, "reviews").select("job_id", F.col("updated_at").alias("written_at"))
    return V.needs_review(table(spark, d, "jobs").select("job_id", "description", "updated_at"), done).select("job_id", "updated_at")


@query("select j.job_id, j.updated_at from jobs j left join (select job_id, max(updated_at) as w from reviews group by 1) r using (job_id) where length(trim(j.description)) > 0 and (w is null or w < j.updated_at) order by j.updated_at desc, j.job_id desc limit 120")
def review_queue(spark: SparkSession, d: str) -> DataFrame:
    """The next 120 records to review, last changed first (top-k report)."""
    return review_backlog(spark, d).orderBy(F.desc("updated_at"), F.desc("job_id")).limit(120)


_INPUT = "sha256(" + " || chr(1) || ".join(f"coalesce({c}, '')" for c in V.INPUTS) + ")"
_GROUP = KEY.split("lower(coalesce(city")[0] + "lower(coalesce(nullif(trim(city), ''), trim(location), '')))"


@query(
    f"""with h as (select {_GROUP} as group_key, {_INPUT} as h from jobs), g as (select group_key, count(*) as members, sum(cast('0x' || substr(h, 1, 8) as bigint)) as a, sum(cast('0x' || substr(h, 9, 8) as bigint)) as b from h group by 1)
    select group_key, members, sha256(members || '|' || a || '|' || b) as fingerprint from g"""
)
def input_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return V.fingerprints(table(spark, d, "jobs"))


_AS_JOBS = "(select cast(ingest_seq as varchar) as job_id, title, company, location, city, description, salary, job_type, seen_at, url, ingest_seq from postings)"


@query(
    f"""with h as (select job_id, {_INPUT} as h, ingest_seq, seen_at from {_AS_JOBS}), best as (select h, arg_min(job_id, (epoch_us(seen_at) * -1, job_id)) as twin_id from h where ingest_seq % 2 = 0 and seen_at is not null group by 1)
    select job_id, twin_id from h join best using (h) where ingest_seq % 2 = 1 or seen_at is null"""
)
def twin_results(spark: SparkSession, d: str) -> DataFrame:
    """For postings of odd number an equal one of even number, whose result they could take over."""
    p = table(spark, d, "postings").withColumn("job_id", F.col("ingest_seq").cast("string"))
    return V.twins(p.select("job_id", *V.INPUTS), p.filter("ingest_seq % 2 = 0 and seen_at is not null").select("job_id", F.col("seen_at").alias("written_at")))


@query(f"with w as (select job_id, case when closed_at is not null then 'closed' when excluded_at is not null then 'excluded' else 'open' end as want from jobs) select w.job_id, r.status as have, w.want from {_REVIEWS} r join w using (job_id) where r.status is distinct from w.want")
def status_differences(spark: SparkSession, d: str) -> DataFrame:
    """Reviews whose status differs from what the record's state would give."""
    j = table(spark, d, "jobs").select("job_id", F.when(F.col("closed_at").isNotNull(), "closed").when(F.col("excluded_at").isNotNull(), "excluded").otherwise("open").alias("status"))
    have = reviews(spark, d).select("job_id", "status").join(j.select("job_id"), "job_id", "left_semi")
    return V.differences(have, j, "job_id", "status")


@query(
    """with r as (select id, started_at, lag(case when finished_at is not null then started_at end) over (order by id) as prev, max(case when finished_at is not null then started_at end) over (order by id rows between unbounded preceding and 1 preceding) as last_success from runs)
    select id, case when last_success is not null then greatest(72, cast(ceil(date_diff('second', last_success, started_at) / 3600.0) as bigint) + 2) end as hours, last_success is null or started_at - last_success >= interval 20 hour as due from r"""
)
def lookback_windows(spark: SparkSession, d: str) -> DataFrame:
    """How far each run has to look back: since the start of the last finished run before it. Runs are few rows a day; the window runs within months, with the months' carry joined on."""
    r = table(spark, d, "runs").withColumn("_m", F.date_format("started_at", "yyyy-MM"))
    done = F.when(F.col("finished_at").isNotNull(), F.col("started_at"))
    inside = F.max(done).over(W.partitionBy("_m").orderBy("id").rowsBetween(W.unboundedPreceding, -1))
    months = r.groupBy("_m").agg(F.max(done).alias("_done"))
    carry = months.withColumn("_carry", F.max("_done").over(W.orderBy("_m").rowsBetween(W.unboundedPreceding, -1))).select("_m", "_carry")
    x = r.withColumn("_in", inside).join(F.broadcast(carry), "_m").withColumn("last_success", F.greatest("_in", "_carry"))
    return x.select("id", I.lookback_hours(F.col("last_success"), F.col("started_at"), 72).alias("hours"), I.pass_due(F.col("last_success"), F.col("started_at")).alias("due"))


@query("select batch_id, count(*) as postings, count(distinct source) as sources, min(seen_at) as first_seen, count(*) filter (where not seen) as replayed from postings group by 1")
def batch_sizes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "postings").groupBy("batch_id").agg(F.count("*").alias("postings"), F.countDistinct("source").alias("sources"), F.min("seen_at").alias("first_seen"), F.count_if(~F.col("seen")).alias("replayed"))


@query("select ingest_seq, source, source_id from (select ingest_seq, source, source_id from postings union all select null, source, source_id from (select distinct source, source_id from job_sources)) except select p.ingest_seq, p.source, p.source_id from postings p join job_sources s using (source, source_id)")
def set_algebra(spark: SparkSession, d: str) -> DataFrame:
    """Union by name with a missing column, less the postings of known links."""
    p = table(spark, d, "postings").select("ingest_seq", "source", "source_id")
    s = table(spark, d, "job_sources").select("source", "source_id").distinct()
    known = p.join(s, ["source", "source_id"], "left_semi").select(p.columns)
    return p.unionByName(s, allowMissingColumns=True).select(p.columns).distinct().join(known, p.columns, "left_anti")


@query(f"select job_id, coalesce(score, -1) as score from (select job_id, try_cast(score_text as double) as score from {_REVIEWS} where coalesce(status, '') not in ('skip', 'closed') and coalesce(decision, '') <> 'reject')")
def default_view(spark: SparkSession, d: str) -> DataFrame:
    """The tracker's default view: without skipped, closed and rejected rows, best score first."""
    r = reviews(spark, d).filter("coalesce(status, '') not in ('skip', 'closed') and coalesce(decision, '') <> 'reject'")
    return r.select("job_id", F.coalesce(F.col("score_text").try_cast("double"), F.lit(-1.0)).alias("score")).orderBy(F.desc("score"), "job_id")


@query("with j as (select source, source_id, job_id, first_seen from job_sources where raw is not null), c as (select first_seen, source, source_id, row_number() over (order by first_seen, source, source_id, job_id) as rn from j) select count(*) as snapshots, max(rn) as last_seq from c")
def replay_order(spark: SparkSession, d: str) -> DataFrame:
    """Raw snapshots numbered for a replay."""
    raw = table(spark, d, "job_sources").filter("raw is not null").select("source", "source_id", "job_id", "first_seen").withColumn("day", F.to_date("first_seen"))
    return R.replay(raw, ["day", "first_seen", "source", "source_id", "job_id"]).agg(F.count("*").alias("snapshots"), F.max("seq").alias("last_seq"))


_KEYED = "(select distinct cast(ingest_seq as varchar) as job_id, coalesce('jid:' || nullif(regexp_extract(url, '[?&]jid=([^&#]+)', 1), ''), url) as k from postings where url is not null)"
_BARE = "(select cast(ingest_seq as varchar) as job_id, case when ingest_seq % 3 = 0 then '' else description end as description, seen_at as updated_at from postings)"


@query(
    f"""with g as (select k, max((j.updated_at, j.job_id)) as g from {_KEYED} k join {_BARE} j using (job_id) where length(trim(j.description)) > 0 group by 1),
    b as (select k.job_id, k.k from {_KEYED} k join {_BARE} j using (job_id) where not coalesce(length(trim(j.description)) > 0, false))
    select b.job_id, arg_max(g.g[2], g.g) as from_job from b join g using (k) group by 1"""
)
def sibling_descriptions(spark: SparkSession, d: str) -> DataFrame:
    """For postings without a description (every third is taken for one) another posting of the same URL that has one."""
    p = table(spark, d, "postings").withColumns({"job_id": F.col("ingest_seq").cast("string"), "updated_at": F.col("seen_at")})
    bare = p.withColumn("description", F.when(F.col("ingest_seq") % 3 != 0, F.col("description")).otherwise(""))
    return E.sibling_texts(p, bare)


@query(
    """with u as (select source, source_id, case source when 'greenhouse' then 'https://boards.greenhouse.io/' || board || '/jobs/' || split_part(source_id, ':', 2) when 'lever' then 'https://jobs.lever.co/' || board || '/' || split_part(source_id, ':', 2)
      when 'workday' then 'https://' || board || '.myworkdayjobs.com/en/site/job/x/' || split_part(source_id, ':', 2) || '/apply/now' when 'successfactors' then 'https://' || board || '.jobs.hr.cloud.sap/job/' || split_part(source_id, ':', 2) || '?a=b' else url end as url from job_sources)
    select source, case source when 'greenhouse' then source_id when 'workday' then board_host || '.myworkdayjobs.com:' when 'successfactors' then board_host || '.jobs.hr.cloud.sap:' end as page_id, count(*) as links
    from (select source, source_id, split_part(source_id, ':', 1) as board_host from u) group by 1, 2"""
)
def employer_pages(spark: SparkSession, d: str) -> DataFrame:
    """The employers' pages that links would lead to if they had the public shapes of these sites; ids that a site doesn't have (no UUID at lever) lead to none."""
    number = F.element_at(F.split("source_id", ":"), -1)
    url = (
        F.when(F.col("source") == "greenhouse", F.concat(F.lit("https://boards.greenhouse.io/"), F.col("board"), F.lit("/jobs/"), number))
        .when(F.col("source") == "lever", F.concat(F.lit("https://jobs.lever.co/"), F.col("board"), F.lit("/"), number))
        .when(F.col("source") == "workday", F.concat(F.lit("https://"), F.col("board"), F.lit(".myworkdayjobs.com/en/site/job/x/"), number, F.lit("/apply/now")))
        .when(F.col("source") == "successfactors", F.concat(F.lit("https://"), F.col("board"), F.lit(".jobs.hr.cloud.sap/job/"), number, F.lit("?a=b")))
        .otherwise(F.col("url"))
    )
    page = E.employer_link(url)
    return table(spark, d, "job_sources").groupBy("source", page["source_id"].alias("page_id")).agg(F.count("*").alias("links"))


@query("select group_id, count(distinct job_id) as members, count(distinct case when job_id not in (select job_id from reviews) then job_id end) as unreviewed from dup_groups group by 1")
def duplicate_groups(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "dup_groups").distinct()
    done = table(spark, d, "reviews").select("job_id").distinct().withColumn("_r", F.lit(True))
    return g.join(done, "job_id", "left").groupBy("group_id").agg(F.count("*").alias("members"), F.count_if(F.col("_r").isNull()).alias("unreviewed"))


@query(
    """with g as (select distinct group_id, job_id from dup_groups), c as (select group_id, min(job_id) as canonical_id, list_sort(list(job_id)) as ids from g group by 1)
    select g.job_id, c.canonical_id, case when len(c.ids) = 1 then 'alone' when g.job_id = c.canonical_id then 'canonical' else 'duplicate' end as role from g join c using (group_id)"""
)
def canonical_roles(spark: SparkSession, d: str) -> DataFrame:
    """Each member's canonical record (the smallest id of its group) and role; groups are reduced to their minimum, never gathered."""
    g = table(spark, d, "dup_groups").distinct()
    c = g.groupBy("group_id").agg(F.min("job_id").alias("canonical_id"), F.count("*").alias("n"))
    role = F.when(F.col("n") == 1, "alone").when(F.col("job_id") == F.col("canonical_id"), "canonical").otherwise("duplicate")
    return g.join(c, "group_id").select("job_id", "canonical_id", role.alias("role"))


@query(
    f"""with p as (select *, row_number() over (partition by source, source_id order by ingest_seq desc) as rn from postings where coalesce(trim(description), '') <> ''), n as (select source, source_id, description, salary from p where rn = 1),
    l as (select source, source_id, min(job_id) as job_id from job_sources where job_id is not null group by 1, 2), d as (select job_id, arg_max(n.description, (source, source_id)) as nd, arg_max(n.salary, (source, source_id)) as ns from n join l using (source, source_id) group by 1),
    x as (select j.job_id, j.updated_at, j.description, coalesce(d.nd, j.description) as d2, j.salary, case when length(trim(coalesce(j.salary, ''))) = 0 and d.job_id is not null then coalesce(d.ns, j.salary) else j.salary end as s2 from jobs j left join d using (job_id))
    select job_id, d2 is distinct from description as described, s2 is distinct from salary as paid, case when d2 is distinct from description or s2 is distinct from salary then {_N} else updated_at end as updated_at from x"""
)
def enriched_jobs(spark: SparkSession, d: str) -> DataFrame:
    """What fetched details (the described postings of known links) change in the store."""
    p = table(spark, d, "postings").filter("coalesce(trim(description), '') <> ''").select("source", "source_id", "description", "salary", "ingest_seq")
    last = R.latest_wins(p, ["source", "source_id"], ["ingest_seq"])
    known = table(spark, d, "job_sources").filter("job_id is not null").groupBy("source", "source_id").agg(F.min("job_id").alias("job_id"))
    key = F.struct("source", "source_id")
    details = last.join(known, ["source", "source_id"]).groupBy("job_id").agg(F.max_by("description", key).alias("description"), F.max_by("salary", F.when(F.col("salary").isNotNull(), key)).alias("salary")).withColumn("outcome", F.lit("ok"))
    jobs = table(spark, d, "jobs").select("job_id", "description", "salary", "updated_at", "description_attempted_at", "description_checked_at")
    new = E.apply_details(jobs, details, now())
    old = jobs.select("job_id", F.col("description").alias("od"), F.col("salary").alias("os"))
    return new.join(old, "job_id").select("job_id", (~F.col("description").eqNullSafe(F.col("od"))).alias("described"), (~F.col("salary").eqNullSafe(F.col("os"))).alias("paid"), "updated_at")
