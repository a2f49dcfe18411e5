"""Queries over the flow of postings into the store: paged sources, frames, boards, upserts, reviews, judgments, fetches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quernwork.functions import jobtext as X
from quernwork.operators import closure as C, evidence as E, incremental as I, judging as J, resolve as R, store as S
from quernwork.plans.store_plan import _LINKS, _N, _REVIEWS, KEY, _last_own, _own_or, links, now, reviews
from quernwork.plans.text_plan import _AMOUNT, RULES
from quernwork.session import table
from quernwork.sources import pages as G, snapshots as Z

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# Sources ---------------------------------------------------------------------------------------------------------------

_PAGED = "(select source, ingest_seq // 40 as page, source_id, 30 as total from postings where source is not null)"


@query(
    f"""with i as (select * from {_PAGED} where page < 50), f as (select source, page, count(*) as fresh from (select source, source_id, min(page) as page from i group by 1, 2) group by 1, 2),
    p as (select source, page, max(total) as total from i group by 1, 2), q as (select p.*, coalesce(fresh, 0) as fresh from p left join f using (source, page)),
    w as (select *, count(*) over a = page + 1 as whole, sum(fresh) over a as met from q window a as (partition by source order by page rows unbounded preceding)),
    g as (select *, whole and fresh > 0 and met < total as goes_on from w), r as (select *, coalesce(bool_and(goes_on) over (partition by source order by page rows between unbounded preceding and 1 preceding), true) as reached from g)
    select source, i.page, count(*) as items, count(distinct source_id) as postings from i join r using (source, page) where whole and fresh > 0 and reached group by 1, 2"""
)
def paged_search(spark: SparkSession, d: str) -> DataFrame:
    """What a reader takes from each source's pages of postings before it stops."""
    p = table(spark, d, "postings").filter("source is not null").select("source", F.floor(F.col("ingest_seq") / 40).alias("page"), "source_id", F.lit(30).alias("total"))
    read = G.read_until_stop(p, ["source"], "page", "source_id", "total", 50)
    return read.groupBy("source", "page").agg(F.count("*").alias("items"), F.countDistinct("source_id").alias("postings"))


@query("with f as (select source, source_id, min(ingest_seq) as ingest_seq from postings group by 1, 2), d as (select source_id, max((description, salary)) as d from postings where ingest_seq % 2 = 0 and description is not null and salary is not null group by 1) select f.source, f.source_id, d.d[1] as description, d.d[2] as salary from f left join d using (source_id)")
def detailed_postings(spark: SparkSession, d: str) -> DataFrame:
    """The first sighting of each posting with its detail; the details of odd postings have failed."""
    p = table(spark, d, "postings")
    found = R.first_wins(p.select("source", "source_id", "ingest_seq", "description", "salary"), ["source", "source_id"], ["ingest_seq"]).drop("ingest_seq")
    details = p.filter("ingest_seq % 2 = 0 and description is not null and salary is not null").select("source_id", "description", "salary")
    return G.with_details(found, details, ["source_id"], ["description", "salary"])


_FRAME_AMOUNTS = "case when ingest_seq % 3 = 0 then null else ingest_seq * 1.25 end"


@query(
    f"""with p as (select *, {_FRAME_AMOUNTS} as low, case when ingest_seq % 5 = 0 then null else ingest_seq * 1.5 end as high from postings)
    select source, source_id, title, case when low is null and high is null then '' else concat_ws(' - ', case when low is not null then {_AMOUNT.format('round(low, 2)')} end, case when high is not null and high is distinct from low then {_AMOUNT.format('round(high, 2)')} end) || ' CAD yearly' end as salary
    from (select source, source_id, url, low, high, trim(regexp_replace(regexp_replace(coalesce(title, ''), '[ \t\r\f\v]+', ' ', 'g'), '^[\\s\\x{{00A0}}]+|[\\s\\x{{00A0}}]+$', '', 'g')) as title from p) where coalesce(trim(source_id), '') <> '' and coalesce(trim(url), '') <> '' and title <> ''"""
)
def frame_postings(spark: SparkSession, d: str) -> DataFrame:
    """Postings from rows of a frame, with NaN amounts."""
    nan = F.lit(float("nan"))
    p = table(spark, d, "postings").select(
        F.col("source").alias("site"), F.col("source_id").alias("id"), F.col("url").alias("job_url"), "title", "company", "location", "job_type", F.lit(None).cast("string").alias("description"), F.lit("nan").alias("date_posted"),
        F.when(F.col("ingest_seq") % 3 == 0, nan).otherwise(F.col("ingest_seq") * 1.25).alias("min_amount"), F.when(F.col("ingest_seq") % 5 == 0, nan).otherwise(F.col("ingest_seq") * 1.5).alias("max_amount"), F.lit(None).cast("string").alias("currency"), F.lit("yearly").alias("interval"), F.lit("None").alias("job_url_direct"),
    )
    return G.from_frame(p, F.lit("")).select("source", "source_id", "title", "salary")


@query(
    """select board, source_id, url, title, location, cast(posted_date as varchar) as posted_date from (select 'b' || cast(batch_id % 7 as varchar) as board, 'b' || cast(batch_id % 7 as varchar) || ':' || source_id as source_id, url, title, coalesce(location, '') as location, posted_date, ingest_seq from postings
    where length(trim(source_id)) > 0 and length(trim(url)) > 0 and length(trim(title)) > 0) where ingest_seq % 11 <> 0"""
)
def board_postings(spark: SparkSession, d: str) -> DataFrame:
    """Postings read back from boards' JSON, one body each; every eleventh body is broken and is set aside."""
    p = table(spark, d, "postings")
    board = F.concat(F.lit("b"), (F.col("batch_id") % 7).cast("string"))
    job = F.struct(F.col("source_id").alias("id"), F.col("url").alias("absolute_url"), "title", F.struct(F.col("location").alias("name")).alias("location"), F.lit("").alias("content"), F.col("posted_date").cast("string").alias("updated_at"))
    body = F.to_json(F.struct(F.array(job).alias("jobs")))
    good, _ = Z.read_job_lists(p.select(board.alias("board"), F.when(F.col("ingest_seq") % 11 != 0, body).otherwise(F.concat(F.lit("<"), body)).alias("body")))
    return good.drop("description").withColumn("posted_date", F.col("posted_date").cast("string"))


@query("select count(*) filter (where ingest_seq % 11 = 0) + count(*) filter (where ingest_seq % 11 <> 0 and not coalesce(length(trim(source_id)) > 0 and length(trim(url)) > 0 and length(trim(title)) > 0, false)) as quarantined from postings")
def quarantined_postings(spark: SparkSession, d: str) -> DataFrame:
    """How many bodies and elements the same boards' reader sets aside."""
    p = table(spark, d, "postings")
    job = F.struct(F.col("source_id").alias("id"), F.col("url").alias("absolute_url"), "title")
    body = F.to_json(F.struct(F.array(job).alias("jobs")))
    _, bad = Z.read_job_lists(p.select(F.lit("b").alias("board"), F.when(F.col("ingest_seq") % 11 != 0, body).otherwise(F.concat(F.lit("<"), body)).alias("body")))
    return bad.agg(F.count("*").alias("quarantined"))


@query("with f as (select province_code as board, 'city' as parameter, cast(place_id as varchar) as id, place_name as descriptor from places where province_code is not null union all select distinct province_code, 'country', 'c-' || province_code, 'Canada' from places where province_code in ('ON', 'BC')) select board, parameter, [id] as ids from f where descriptor = 'Canada' union all select board, parameter, list_sort(list(distinct id)) from f where lower(descriptor) like '%bury%' and board not in ('ON', 'BC') group by 1, 2")
def narrowed_searches(spark: SparkSession, d: str) -> DataFrame:
    """How the search of each province's board is narrowed: by its facet of the country, else by those of places named "...bury"."""
    p = table(spark, d, "places").filter("province_code is not null")
    leaf = F.to_json(F.array(F.struct(F.lit("city").alias("facetParameter"), F.array(F.struct(F.array(F.struct(F.col("place_id").cast("string").alias("id"), F.col("place_name").alias("descriptor"))).alias("values"))).alias("values"))))
    cities = Z.flatten_facets(p.select(F.col("province_code").alias("board"), leaf.alias("f")), "f")
    country = p.filter("province_code in ('ON', 'BC')").select(F.col("province_code").alias("board"), F.lit("country").alias("parameter"), F.concat(F.lit("c-"), F.col("province_code")).alias("id"), F.lit("Canada").alias("descriptor")).distinct()
    return Z.location_filter(cities.unionByName(country), F.lower("descriptor").contains("bury"))


@query("select job_id, lower(title) as title from jobs where regexp_matches(' ' || trim(regexp_replace(lower(strip_accents(coalesce(title, ''))), '[^a-z0-9]+', ' ', 'g')) || ' ', ' (technician|scientist|analyst) | assess')")
def board_titles(spark: SparkSession, d: str) -> DataFrame:
    """The jobs of whole boards whose title has a keyword."""
    return G.board_scan(table(spark, d, "jobs"), RULES["titles"]).select("job_id", F.lower("title").alias("title"))


@query("select source, regexp_replace(regexp_extract(url, '^(https?://[^/]+)', 1) || '/careers', '/+$', '') as base, count(*) as links from job_sources where url is not null group by 1, 2")
def board_bases(spark: SparkSession, d: str) -> DataFrame:
    """The bases of boards from the URLs of their searches."""
    site = F.regexp_extract("url", "^(https?://[^/]+)", 1)
    searched = F.when(F.length("url") % 2 == 0, F.concat(site, F.lit("/careers/tile-search-results/?q=x"))).otherwise(F.concat(site, F.lit("/careers/go/All-Jobs/123/45/")))
    return table(spark, d, "job_sources").filter("url is not null").groupBy("source", G.board_base(searched).alias("base")).agg(F.count("*").alias("links"))


@query()
def result_pages(spark: SparkSession, d: str) -> DataFrame:
    """Postings read back from results pages in HTML (parser, no SQL form)."""
    p = table(spark, d, "postings").filter("title is not null and company is not null")
    e = lambda c: F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "&", "&amp;"), "<", "&lt;")
    page = F.concat(F.lit('<span id="results-count">1,234</span><article id="article-1"><a class="resultJobItem" href="/jobsearch/jobposting/'), F.col("ingest_seq"), F.lit(';x"><span class="noctitle">'), e("title"), F.lit('</span></a><ul><li class="business">'), e("company"), F.lit('</li><li class="location"><span class="wb-inv">Location</span>'), e("location"), F.lit('</li><li class="salary">Salary '), e("salary"), F.lit("</li></ul></article>"))
    rows, _ = G.read_results(p.select("ingest_seq", page.alias("html")))
    return rows


@query(
    """select ingest_seq, case status when 404 then 'gone' when 403 then case when ingest_seq % 2 = 0 then 'gone' else 'unknown' end when 200 then case when ingest_seq % 4 = 1 then 'unknown' else 'alive' end else 'unknown' end as answer
    from (select ingest_seq, [200, 404, 403, 500][1 + (ingest_seq // 4) % 4] as status from postings)"""
)
def classified_responses(spark: SparkSession, d: str) -> DataFrame:
    """What responses about postings say: every source form in turn, with pages that lack what shows a posting is there."""
    p = table(spark, d, "postings").select("ingest_seq", (F.col("ingest_seq") % 4).alias("k"), F.element_at(F.array(*[F.lit(x) for x in (200, 404, 403, 500)]), (1 + F.floor(F.col("ingest_seq") / 4) % 4).cast("int")).alias("status"))
    source = F.element_at(F.array(*[F.lit(x) for x in ("workday", "lever", "workday", "jobbank")]), (F.col("k") + 1).cast("int"))
    unposted = (F.col("status") == 403) & (F.col("ingest_seq") % 2 == 0)
    workday = F.when(unposted, '{"errorCode": "S22"}').otherwise('{"jobPostingInfo": {"title": "t", "jobReqId": "r"}}')
    body = F.when(F.col("k").isin(0, 2), workday).when(F.col("k") == 1, '{"id": "other", "text": "t"}').otherwise('<div class="job-posting-detail-requirements">')
    return E.classify(p.select("ingest_seq", source.alias("source"), F.concat(F.lit("b:"), F.col("ingest_seq")).alias("source_id"), "status", body.alias("body"))).select("ingest_seq", "answer")


@query("select count(*) filter (where regexp_matches(coalesce(stats, ''), '\\b(403|429|999)\\b')) as blocked, count(*) as runs from runs")
def blocked_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs whose log tells of a block by its code."""
    return table(spark, d, "runs").agg(F.count_if(E.blocked("stats")).alias("blocked"), F.count("*").alias("runs"))


_TERMS = "['lab technician', 'analyst', 'kiln hand']"


@query(
    f"""with g as (select source as scope, max(last_seen) as last_success from job_sources group by 1), x as (select scope, last_success, last_success - interval 10 day * (length(scope) % 3) as last_full from g),
    y as (select *, last_success is null or last_full is null or {_N} - last_full >= interval 14 day as whole from x)
    select scope, '"lab technician" OR analyst OR "kiln hand"' as query, c.city, c.turn, case when not whole then greatest(72, cast(ceil(date_diff('second', last_success, {_N}) / 3600.0) as bigint) + 2) end as hours, case when whole then 400 else 200 end as wanted
    from y, (values (0, 'Keskmere'), (1, 'Nordbury'), (2, 'Tambmere')) c(turn, city)"""
)
def scan_plans(spark: SparkSession, d: str) -> DataFrame:
    """The searches of the next pass for each source."""
    done = table(spark, d, "job_sources").groupBy(F.col("source").alias("scope")).agg(F.max("last_seen").alias("last_success"))
    done = done.withColumn("last_full", F.col("last_success") - F.make_dt_interval(10 * (F.length("scope") % 3)))
    groups = done.select("scope", F.array(F.lit("lab technician"), F.lit("analyst"), F.lit("kiln hand")).alias("terms"))
    return I.scan_plan(groups, done, ["Nordbury", "Tambmere", "Keskmere"], now(), 72, 14, 5, 200, 400)


# Store -----------------------------------------------------------------------------------------------------------------

_RESOLVED = f"""p0 as (select *, {KEY} as k from postings), fs as (select min(ingest_seq) as ingest_seq, source, source_id, arg_min(k, ingest_seq) as k from p0 group by 2, 3),
    known as (select source, source_id, min(job_id) as known from job_sources where job_id is not null group by 1, 2), held as (select distinct source, job_id as keyed from job_sources where job_id is not null),
    n as (select fs.*, substr(sha1(k), 1, 16) as keyed, known.known, held.keyed is not null as held from fs left join known using (source, source_id) left join held on held.source = fs.source and held.keyed = substr(sha1(k), 1, 16)),
    rr as (select *, row_number() over (partition by source, keyed, known is null order by ingest_seq) as rn from n),
    ids as (select source, source_id, coalesce(known, case when not held and rn = 1 then keyed else substr(sha1(k || '|' || source || '|' || source_id), 1, 16) end) as entity_id from rr)"""
_FULL = str(C.CLASSES["full_listing"])


def sighted(spark: SparkSession, d: str) -> DataFrame:
    """All postings with their entity."""
    p = table(spark, d, "postings")
    first = R.first_wins(p.select("source", "source_id", "title", "company", "city", F.col("ingest_seq").alias("seq")), ["source", "source_id"], ["seq"])
    known = table(spark, d, "job_sources").select("source", "source_id", F.col("job_id").alias("entity_id"))
    ids = R.resolve_identity(first, known).select("source", "source_id", "entity_id")
    return p.join(ids, ["source", "source_id"]).select("entity_id", "source", F.col("ingest_seq").alias("seq"), F.coalesce("seen", F.lit(False)).alias("seen"), "seen_at", C.is_class("source", "full_listing").alias("full_listing"), *R.MATERIAL, "posted_date", "url")


_MAT = ", ".join(R.MATERIAL)
_HASH = "sha1(cast(to_json([" + ", ".join(f"coalesce({c}, '')" for c in R.MATERIAL) + "]) as varchar))"


@query(
    f"""with {_RESOLVED}, s as (select entity_id, source, ingest_seq as seq, {_MAT}, posted_date, url from postings join ids using (source, source_id)),
    u as (select * from s union all select job_id, primary_source, -1, {_MAT}, posted_date, url from jobs where job_id in (select entity_id from s)),
    e as (select *, first_value(source) over (partition by entity_id order by seq) as ps from u),
    m as (select entity_id, min(ps) as primary_source, {_last_own('title', False)} as title, {_last_own('city', False)} as city, {_own_or('company', False)} as company, {_own_or('location', False)} as location, {_own_or('description', True)} as description, {_own_or('salary', True)} as salary, {_own_or('job_type', True)} as job_type from e group by 1),
    h as (select *, {_HASH} as new_hash from m), o as (select job_id, {_HASH} as old_hash, last_seen as old_seen, updated_at as old_updated, closed_at, closed_by_employer from jobs),
    b as (select t.entity_id, max(t.seen_at) as now_at, min(t.seen_at) as first_at, max(case when t.seen then t.seen_at end) as seen_last, bool_or(coalesce(t.seen, false) and o.closed_at is not null and (not coalesce(o.closed_by_employer, false) or t.source in {_FULL} or t.seen_at - o.closed_at >= interval 7 day)) as opens
      from (select ids.entity_id, postings.* from postings join ids using (source, source_id)) t left join o on o.job_id = t.entity_id group by 1)
    select h.entity_id as job_id, case when old_hash is null then 'new' when old_hash <> new_hash then 'changed' else 'seen' end as label, primary_source, title, city, company, location, salary, job_type, length(description) as description_chars,
      case when old_hash is not null then greatest(old_seen, seen_last) else coalesce(seen_last, first_at) end as last_seen, case when old_hash = new_hash then old_updated else now_at end as updated_at, case when not coalesce(opens, false) then o.closed_at end as closed_at
    from h left join o on o.job_id = h.entity_id join b on b.entity_id = h.entity_id"""
)
def stored_jobs_after_batch(spark: SparkSession, d: str) -> DataFrame:
    """The jobs that the postings touch, as they are afterwards."""
    out = S.upsert(table(spark, d, "jobs"), sighted(spark, d))
    return out.select("job_id", "label", "primary_source", "title", "city", "company", "location", "salary", "job_type", F.length("description").alias("description_chars"), "last_seen", "updated_at", "closed_at")


@query(f"with {_RESOLVED}, t as (select count(*) as fetched, source, count(*) filter (where k.known is not null) as known from postings left join known k using (source, source_id) group by source), e as (select source, count(distinct entity_id) as entities from ids group by 1) select source, fetched, known, entities from t left join e using (source) where source is not null")
def ingest_counts(spark: SparkSession, d: str) -> DataFrame:
    """What one run over the postings counts for each source: fetched, of known links, and the records they belong to."""
    p = table(spark, d, "postings").select("source", "source_id")
    known = table(spark, d, "job_sources").filter("job_id is not null").select("source", "source_id").distinct().withColumn("_k", F.lit(True))
    counts = p.join(known, ["source", "source_id"], "left").groupBy("source").agg(F.count("*").alias("fetched"), F.count("_k").alias("known"))
    return counts.join(sighted(spark, d).groupBy("source").agg(F.countDistinct("entity_id").alias("entities")), "source", "left").filter("source is not null")


@query(
    f"""with a as (select source, source_id, case (epoch(first_seen)::bigint // 60) % 3 when 0 then 'gone' when 1 then 'alive' else 'unknown' end as answer, (epoch(first_seen)::bigint // 60) % 5 = 0 as answered from {_LINKS})
    select source, source_id, case answer when 'gone' then {_N} when 'unknown' then gone_at end as gone_at, case when answered then case when answer = 'gone' then null else 'https://x.invalid/1' end else apply_url end as apply_url from {_LINKS} l join a using (source, source_id)"""
)
def recorded_links(spark: SparkSession, d: str) -> DataFrame:
    """Links after answers: each third is gone, alive or unknown, and every fifth source says where applications go."""
    x = links(spark, d).select("source", "source_id", "first_seen", "gone_at", "apply_url")
    minute = F.floor(F.unix_seconds(F.col("first_seen").cast("timestamp")) / 60)
    answer = F.when(minute % 3 == 0, "gone").when(minute % 3 == 1, "alive").otherwise("unknown")
    answers = x.select("source", "source_id", answer.alias("answer"), F.when(answer == "gone", "").otherwise("https://x.invalid/1").alias("apply_url"), (minute % 5 == 0).alias("answered"))
    return C.record_links(x, answers, now()).select("source", "source_id", "gone_at", "apply_url")


@query(
    f"""select job_id, case r.k when 0 then coalesce(liveness_alive_streak, 0) + 1 when 1 then 0 else coalesce(liveness_alive_streak, 0) end as streak, case when r.k = 1 then {_N} else closed_at end as closed_at, r.k = 1 and length(job_id) % 2 = 0 as closed_by_employer
    from jobs join (select job_id, ('0x' || substr(job_id, 1, 4))::bigint % 3 as k from jobs) r using (job_id)"""
)
def recorded_closures(spark: SparkSession, d: str) -> DataFrame:
    """Jobs after a check of each: alive, gone or unknown."""
    k = F.conv(F.substring("job_id", 1, 4), 16, 10).cast("bigint") % 3
    results = table(spark, d, "jobs").select("job_id", F.when(k == 0, "alive").when(k == 1, "gone").otherwise("unknown").alias("result"), ((k == 1) & (F.length("job_id") % 2 == 0)).alias("closed_by_employer"))
    return C.record_results(table(spark, d, "jobs"), results, now())


@query("select source, source_id, case when ('0x' || right(md5(source_id), 4))::bigint % 3 = 0 then 'gone' when ('0x' || right(md5(source_id), 4))::bigint % 3 = 1 then 'alive' end as answer from (select distinct source, source_id from job_sources where source = 'indeed')")
def batch_lookups(spark: SparkSession, d: str) -> DataFrame:
    """Answers of one source's batches: a third of the keys is left out of the replies and stays without an answer."""
    asked = table(spark, d, "job_sources").filter("source = 'indeed'").select("source", "source_id").distinct()
    k = F.conv(F.substring(F.md5("source_id"), -4, 4), 16, 10).cast("bigint") % 3
    replies = asked.filter(k != 2).select(F.regexp_replace("source_id", "^in-", "").alias("key"), (k == 0).alias("expired"), F.lit("https://indeed.invalid/v").alias("view_url"), F.lit("indeed.invalid").alias("host"))
    return C.batch_answers(asked, replies).select("source", "source_id", "answer")


@query(
    f"""with p as (select job_id, updated_at as written_at, case when length(data) % 2 = 0 then 'maybe' else 'reject' end as decision, length(data) as seq from reviews where length(data) % 3 > 0), l as (select job_id, max((written_at, seq, decision)) as p from p group by 1)
    select job_id, case when l.p is not null and (r.updated_at is null or l.p[1] > r.updated_at) then l.p[3] else r.decision end as decision from (select job_id, decision, updated_at - interval 1 day * (length(data) % 2) as updated_at from {_REVIEWS}) r full outer join l using (job_id)"""
)
def newest_decisions(spark: SparkSession, d: str) -> DataFrame:
    """The decision that holds for each job: the backed-up review's or a published result's written after it."""
    back = reviews(spark, d).select("job_id", "decision", F.col("updated_at").alias("reviewed_at"), (F.col("updated_at") - F.make_dt_interval(F.length("data") % 2)).alias("updated_at"))
    size = F.length("data")
    results = table(spark, d, "reviews").filter("length(data) % 3 > 0").select("job_id", F.when(size % 2 == 0, "maybe").otherwise("reject").alias("decision"), F.col("updated_at").alias("reviewed_at"), F.col("updated_at").alias("written_at"), size.alias("seq"))
    return S.effective_reviews(back, results).select("job_id", "decision")


@query(f"select job_id, case when r.k % 2 = 0 then '{{\"AI Score\":\"' || r.k || '\"}}' else r.data end as data from (select job_id, data, ('0x' || right(md5(job_id), 4))::bigint as k from {_REVIEWS}) r")
def backed_up_reviews(spark: SparkSession, d: str) -> DataFrame:
    """The latest reviews after a backup of new fields for half of the jobs."""
    old = reviews(spark, d).select("job_id", "data", "updated_at")
    k = F.conv(F.substring(F.md5("job_id"), -4, 4), 16, 10).cast("bigint")
    sheet = old.filter(k % 2 == 0).select("job_id", F.create_map(F.lit("AI Score"), k.cast("string")).alias("fields"))
    out, _ = S.backup_reviews(old, sheet, table(spark, d, "jobs"), now())
    return out.select("job_id", "data")


@query(
    f"""select j.job_id, j.title, case when length(j.description) > 300 then substr(j.description, 1, 300) || ' [truncated]' else j.description end as description,
    coalesce(case when try_cast(r.score_text as double) = floor(try_cast(r.score_text as double)) then cast(cast(try_cast(r.score_text as double) as bigint) as varchar) end, r.score_text, '') as "AI Score",
    coalesce(nullif(json_extract_string(r.data, '$."Application Status"'), ''), 'Not Applied') as "Application Status" from jobs j left join {_REVIEWS} r using (job_id) where j.excluded_at is null"""
)
def tracker(spark: SparkSession, d: str) -> DataFrame:
    """The tracker after a rebuild."""
    jobs = table(spark, d, "jobs").filter("excluded_at is null").select("job_id", "title", "description")
    return S.tracker_rows(jobs, reviews(spark, d), ["job_id", "title", "description"], ["AI Score", "Application Status"], 300)


@query("select id, started_at, case when id % 3 = 0 then started_at + interval 1 hour else finished_at end as finished_at, case when id % 3 = 0 then '{\"done\":1}' else stats end as stats from runs union all select max(id) + 1, max(started_at), null, null from runs")
def logged_runs(spark: SparkSession, d: str) -> DataFrame:
    """The run log after a start and the ends of every third run."""
    r = table(spark, d, "runs")
    starts = r.agg((F.max("id") + 1).alias("id"), F.max("started_at").alias("started_at"))
    ends = r.filter("id % 3 = 0").select("id", (F.col("started_at") + F.make_dt_interval(F.lit(0), F.lit(1))).alias("finished_at"), F.lit('{"done":1}').alias("stats"))
    return S.log_runs(r, starts, ends)


@query("select source as key, arg_max(last_seen, (last_seen, recorded_at)) as value from job_sources group by 1")
def settings(spark: SparkSession, d: str) -> DataFrame:
    """A settings table of the sources' last sightings after writes in any order."""
    rows = table(spark, d, "job_sources").select(F.col("source").alias("key"), F.col("last_seen").alias("value"), "recorded_at")
    return S.put(rows.select("key", "value").limit(0), rows, ["key"], ["value", "recorded_at"])


# Fetches ---------------------------------------------------------------------------------------------------------------

_TARGETS = f"(select l.source, j.job_id, coalesce('jid:' || nullif(regexp_extract(l.url, '[?&]jid=([^&#]+)', 1), ''), l.url) as k, j.description_attempted_at as attempted_at, j.first_seen from {_LINKS} l join jobs j using (job_id) where coalesce(trim(j.description), '') = '' and j.description_checked_at is null and j.closed_at is null and j.excluded_at is null and l.url is not null)"


def targets(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "jobs").filter("coalesce(trim(description), '') = '' and description_checked_at is null and closed_at is null and excluded_at is null").select("job_id", F.col("description_attempted_at").alias("attempted_at"), "first_seen")
    return links(spark, d).filter("url is not null").select("source", "job_id", X.posting_key("url").alias("k")).join(j, "job_id")


@query(
    f"""with g as (select source, k, max(attempted_at) as tried, max(first_seen) as new from {_TARGETS} group by 1, 2), r as (select source, k, row_number() over (partition by source order by coalesce(tried, timestamp '1900-01-01'), new desc, k) as turn from g)
    select source, k, job_id, turn from {_TARGETS} t join r using (source, k) where turn <= case when source = 'linkedin' then 7 else 20 end"""
)
def fetches(spark: SparkSession, d: str) -> DataFrame:
    """The postings of each source to fetch a description for next, 20 at most, of one source 7 (top-k report)."""
    return S.fetch_order(targets(spark, d), "k", 20, {"linkedin": 7}).select("source", "k", "job_id", "turn")


@query(f"select job_id, case length(k) % 4 when 0 then 'ok' when 1 then 'gone' else 'tried' end as outcome, count(*) as links from {_TARGETS} where length(k) % 4 < 3 group by 1, 2")
def fetch_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """What fetches mean for the records of a posting; a quarter wasn't fetched."""
    t = targets(spark, d)
    n = F.length("k") % 4
    out = t.filter(n < 3).select("source", "k", F.when(n == 0, 200).when(n == 1, 410).otherwise(429).alias("status")).distinct()
    return S.attempts(t, out, "k").groupBy("job_id", "outcome").agg(F.count("*").alias("links"))


# Judgments -------------------------------------------------------------------------------------------------------------

_SAVED = f"(select job_id, coalesce(try_cast(score_text as double), 0)::int as score, length(data) as n from {_REVIEWS})"


def saved(spark: SparkSession, d: str) -> DataFrame:
    return reviews(spark, d).select("job_id", F.coalesce(F.col("score_text").try_cast("double"), F.lit(0.0)).cast("int").alias("score"), F.length("data").alias("n"))


@query("select job_id, coalesce(trim(description), '') = '' or right(trim(description), 11) = '[truncated]' as limited from jobs")
def limited_descriptions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "jobs").select("job_id", J.limited("description").alias("limited"))


@query("with c as (select job_id, count(*) as n, min(case when length(data) % 2 = 0 then '2025-01-01T00:00:00Z' else '2025-01-01 00:00' end) as s from reviews group by 1) select job_id, case when n > 1 then 'duplicate id' else 'no instant with an offset' end as fault from c where n > 1 or s not like '%Z'")
def sheet_faults(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a sheet that can't be read: ids that occur twice, stamps without an offset."""
    rows = table(spark, d, "reviews").select("job_id", F.when(F.length("data") % 2 == 0, "2025-01-01T00:00:00Z").otherwise("2025-01-01 00:00").alias("stamp"))
    return J.readable_rows(rows, "job_id", "stamp", F.lit(False))[1]


@query(f"select j.job_id, r.score, case when r.job_id is not null then r.job_id end as canonical_id from (select job_id, length(title) % 2 as p from jobs) j left join {_SAVED} r on r.job_id = j.job_id and r.n % 2 = j.p")
def cached_judgments(spark: SparkSession, d: str) -> DataFrame:
    """Jobs with their saved judgment under the same policy."""
    records = table(spark, d, "jobs").select("job_id", F.lit("f").alias("fingerprint"), (F.length("title") % 2).cast("string").alias("policy"))
    results = saved(spark, d).select("job_id", F.lit("f").alias("fingerprint"), (F.col("n") % 2).cast("string").alias("policy"), F.col("job_id").alias("canonical_id"), "score")
    return J.cached(records, results).select("job_id", "score", "canonical_id")


@query(f"with c as (select job_id, score from {_SAVED} where n % 3 = 0), t as (select job_id, 50 as score from jobs where length(title) % 3 = 0), u as (select job_id, 0 as score from jobs where coalesce(job_type, '') = '') select j.job_id, coalesce(c.score, t.score, u.score) as score, case when c.score is not null then 'cache' when t.score is not null then 'twin' when u.score is not null then 'rule' end as origin from jobs j left join c using (job_id) left join t using (job_id) left join u using (job_id)")
def judgment_origins(spark: SparkSession, d: str) -> DataFrame:
    """Where each job's judgment comes from: the cache, a twin, a rule, or none of them."""
    j = table(spark, d, "jobs")
    cache = saved(spark, d).filter("n % 3 = 0").select("job_id", "score")
    rule = J.pre_judged(j, [("blank type", F.coalesce("job_type", F.lit("")) == "")]).select("job_id", F.lit(0).alias("score"))
    return J.first_known(j, [("cache", cache), ("twin", j.filter("length(title) % 3 = 0").select("job_id", F.lit(50).alias("score"))), ("rule", rule)], "job_id", "score")


_GROUPS = "(select group_id, min(job_id) as canonical_id, list_sort(list(distinct job_id)) as ids from dup_groups group by 1)"


def judged(spark: SparkSession, d: str) -> DataFrame:
    """Judgments of duplicate groups by their canonical, the smallest id. A group's ids are a handful; here they are one judgment's text."""
    g = table(spark, d, "dup_groups").distinct().groupBy("group_id").agg(F.min("job_id").alias("canonical_id"), F.array_sort(F.collect_set("job_id")).alias("ids"))
    return g.select(F.col("canonical_id").alias("job_id"), "canonical_id", F.array_except("ids", F.array("canonical_id")).alias("duplicate_ids"), F.lit(60).alias("score"))


@query(
    f"""with n as (select canonical_id, unnest(ids) as m from {_GROUPS}), x as (select distinct n.canonical_id from n join {_SAVED} s on s.job_id = n.m where s.n % 2 = 0 and n.m <> n.canonical_id)
    select g.canonical_id as job_id, g.canonical_id, case when x.canonical_id is not null then 0 else len(g.ids) - 1 end as duplicates from {_GROUPS} g left join x using (canonical_id)"""
)
def judgments_without_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Judgments of duplicate groups, standing by themselves where a duplicate was saved as its own canonical."""
    own = saved(spark, d).filter("n % 2 = 0").select("job_id", F.col("job_id").alias("canonical_id"))
    return J.without_conflicts(judged(spark, d), own).select("job_id", "canonical_id", F.size("duplicate_ids").alias("duplicates"))


@query(f"select g.canonical_id as job_id, g.canonical_id, case when s.job_id is not null then s.score else 60 end as score, len(g.ids) - 1 + case when s.job_id is not null then 1 else 0 end as duplicates from {_GROUPS} g left join {_SAVED} s on s.job_id = g.canonical_id")
def inherited_judgments(spark: SparkSession, d: str) -> DataFrame:
    """Judgments of duplicate groups that take over what is saved for their canonical, with one more duplicate."""
    known = saved(spark, d).select("job_id", F.col("job_id").alias("canonical_id"), F.array(F.lit("zz")).alias("duplicate_ids"), "score")
    return J.inherited(judged(spark, d), known).select("job_id", "canonical_id", "score", F.size("duplicate_ids").alias("duplicates"))


@query(
    f"""with s as (select job_id, score, n % 7 = 0 as blocked, n % 5 = 0 as low from {_SAVED}), c as (select *, least(score, case when low then 54 end, case when blocked then 29 end) as capped from s)
    select job_id, capped as score, case when capped >= 75 then 'high' when capped >= 55 then 'middle' else 'rest' end as band, case when low then 'Seen. Low; said so.' else 'Seen.' end as notes from c"""
)
def final_scores(spark: SparkSession, d: str) -> DataFrame:
    """Saved scores under example caps and bands, with remarks."""
    s = saved(spark, d).select("job_id", "score", (F.col("n") % 7 == 0).alias("blocked"), (F.col("n") % 5 == 0).alias("low"))
    x = s.withColumn("capped", J.capped_score(F.col("score"), [(F.col("low"), 54), (F.col("blocked"), 29)]))
    notes = J.remarks(F.lit(" Seen. "), [F.when(F.col("low"), "low"), F.when(F.col("low"), "said so")], F.col("job_id"), F.col("job_id"))
    return x.select("job_id", F.col("capped").alias("score"), J.banded(F.col("capped"), [(75, "high"), (55, "middle")], "rest").alias("band"), notes.alias("notes"))


@query(
    r"""select job_id, (regexp_matches(lower(coalesce(description, '')), '(employment type|job type|status)\s*[:\-]\s*\**\s*(casual|part[- ]time|on[- ]call)') or regexp_matches(lower(coalesce(description, '')), '\bis\s+an?\s+(casual|part[- ]time|on[- ]call)\s+(position|role|job)\b')) and not regexp_matches(lower(coalesce(job_type, '') || chr(10) || coalesce(description, '')), '\bfull[- ]?time\b') as casual from jobs"""
)
def labelled_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Jobs whose text labels them as casual and doesn't speak of full time."""
    casual = J.labelled("description", "job_type", ["employment type", "job type", "status"], ["casual", "part[- ]time", "on[- ]call"], r"\bfull[- ]?time\b")
    return table(spark, d, "jobs").select("job_id", casual.alias("casual"))


@query("select id, case when coalesce(cast(json_extract_string(stats, '$.new') as bigint), 0) > 0 and coalesce(cast(json_extract_string(stats, '$.changed') as bigint), 0) > 0 and finished_at is not null then 60 else 3600 end as delay from runs")
def retry_delays(spark: SparkSession, d: str) -> DataFrame:
    """How long to wait after each run."""
    n = lambda k: F.coalesce(F.get_json_object("stats", f"$.{k}").cast("bigint"), F.lit(0))
    return table(spark, d, "runs").select("id", J.retry_delay(n("new"), n("changed"), F.col("finished_at").isNull(), 60, 3600).alias("delay"))


@query("select job_id, title, company, coalesce(location, '') as location, salary, job_type, updated_at, coalesce(city, '') as city from jobs where closed_at is null")
def judged_fields(spark: SparkSession, d: str) -> DataFrame:
    """The fields that a judge is given."""
    return table(spark, d, "jobs").filter("closed_at is null").select("job_id", "title", "company", F.coalesce("location", F.lit("")).alias("location"), "salary", "job_type", "updated_at", F.coalesce("city", F.lit("")).alias("city"))


