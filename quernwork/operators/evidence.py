"""Evidence from fetched responses and details: what an answer says about a link, employers' links, and text copied between postings.

Network access is outside: responses and details are tables. A missing row means "not answered", which is not the same as "unknown".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quernwork.functions.jobtext import parse_date, posting_key, url_host

#: For each source the JSON fields that show a posting is there: its id, its title, and a flag that must not be false.
ALIVE_FIELDS = {"greenhouse": ("id", "title", None), "lever": ("id", "text", None), "smartrecruiters": ("id", "name", "active")}
#: Marks in pages: of a posting that is there, and of one that is no longer.
ALIVE_MARKS = {"jobbank": r"job-posting-detail-requirements", "linkedin": r"top-card-layout__title", "successfactors": r"class=\"[^\"]*jobdescription|itemprop=\"?description|id=\"job-description\""}
GONE_MARKS = {"linkedin": r"<figure[^>]*closed-job", "successfactors": r"view this job because it\S{1,6}s not available at this time"}


#: Endings of the hosts of employers' own pages (a whole host without a leading dot).
PAGE_HOSTS = {"workday": ".myworkdayjobs.com", "greenhouse": ".greenhouse.io", "lever": "jobs.lever.co", "oracle": ".oraclecloud.com", "successfactors": ".jobs.hr.cloud.sap"}


def _path(url: Column) -> Column:
    return F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))


def employer_link(url: Column | str, hosts: dict[str, str] | None = None) -> Column:
    """struct<source, source_id, url> of an employer's own page behind an apply URL; null for other hosts and paths.

    The path is read by its segments. Where it names board and posting the id is "board:posting"; where the page can only be asked by its
    URL, the id is the host with a colon, and the URL is without query and without the steps of an application. hosts: other endings, by source.
    """
    url = F.col(url) if isinstance(url, str) else url
    host, path = url_host(url), _path(url)
    seg = F.filter(F.split(path, "/"), lambda p: p != "")
    at = lambda k: F.coalesce(F.try_element_at(seg, F.lit(k)), F.lit(""))
    digits = lambda c: c.rlike("^[0-9]+$")
    plain = F.concat(F.lit("https://"), host, path)
    before = F.slice(seg, 1, F.coalesce(F.array_position(seg, "apply"), F.lit(0)).cast("int") - 1)
    job = F.when(F.array_contains(seg, "apply"), F.concat(F.lit("https://"), host, F.lit("/"), F.array_join(before, "/"))).otherwise(plain)
    inside = F.array_position(seg, "job")
    at_oracle = (at(1) == "hcmUI") & (at(2) == "CandidateExperience") & (at(4) == "sites")
    oracle_id = F.when((F.size(seg) == 7) & (at(6) == "job"), at(7)).when((F.size(seg) == 8) & at(6).isin("jobs", "requisitions") & (at(7) == "preview"), at(8)).otherwise("")
    shapes = {
        "workday": ((inside > 0) & (inside < F.size(seg)), F.concat(host, F.lit(":")), job),
        "greenhouse": ((F.size(seg) == 3) & (at(2) == "jobs") & digits(at(3)), F.concat_ws(":", at(1), at(3)), url),
        "lever": ((F.size(seg) >= 2) & (F.length(at(2)) == 36) & at(2).rlike("^[0-9a-f]{8}-[0-9a-f-]+$"), F.concat_ws(":", at(1), at(2)), url),
        "oracle": (at_oracle & digits(oracle_id), F.concat_ws(":", at(5), oracle_id), plain),
        "successfactors": ((at(1) == "job") & (F.size(seg) > 1), F.concat(host, F.lit(":")), plain),
    }
    out = F.lit(None)
    for source, ending in (hosts or PAGE_HOSTS).items():
        fits, source_id, shown = shapes[source]
        here = F.endswith(host, F.lit(ending)) if ending.startswith(".") else host == ending
        link = F.struct(F.lit(source).alias("source"), source_id.alias("source_id"), shown.alias("url"))
        out = F.when(here & F.coalesce(fits, F.lit(False)), link).otherwise(out)
    return out


def classify(responses: DataFrame) -> DataFrame:
    """responses (source, source_id, status, body) with `answer`: gone, alive or unknown.

    404 and 410 say gone for every source with a rule, and so does a source's own way to say it (a refusal with the code of an unposted
    requisition, a search that finds nothing, a notice). 200 says alive where the body is the very posting with its title and no flag against it; what shows a
    posting is there goes before what says it is gone, but a closed notice in a page goes first. A status with both of its two flags, or none, says nothing. Other
    bodies and statuses, malformed JSON, null status (no response) and sources without a rule say nothing. A board's listing is for board_answers.
    """
    j = lambda p: F.get_json_object("body", p)
    source, ok = F.col("source"), F.col("status") == 200
    wanted = F.element_at(F.split("source_id", ":"), -1)
    filled = lambda c: F.length(F.trim(F.coalesce(c, F.lit("")))) > 0
    alive = gone = F.lit(False)
    for name, (key, title, flag) in ALIVE_FIELDS.items():
        here = (source == name) & F.contains("source_id", F.lit(":")) & (j(f"$.{key}") == wanted) & filled(j(f"$.{title}"))
        alive = alive | (here & (F.coalesce(j(f"$.{flag}"), F.lit("true")) != "false") if flag else here)
    alive = alive | ((source == "workday") & filled(j("$.jobPostingInfo.title")) & filled(j("$.jobPostingInfo.jobReqId")))
    items = F.from_json(j("$.items"), "array<struct<Id: string, Title: string>>")
    alive = alive | ((source == "oracle") & (j("$.count") == "1") & F.exists(items, lambda x: (x["Id"] == wanted) & filled(x["Title"])))
    for name, mark in ALIVE_MARKS.items():
        shut = F.col("body").rlike(GONE_MARKS[name]) if name == "linkedin" else F.lit(False)
        alive = alive | ((source == name) & F.col("body").rlike(mark) & ~shut)
    off, on = filled(j("$.status.deactivatedAtUtc")), F.coalesce(j("$.status.isActive") == "true", F.lit(False))
    alive = alive | ((source == "zip_recruiter") & on & ~off)
    gone = gone | ((source == "zip_recruiter") & off & ~on) | ((source == "oracle") & (j("$.count") == "0") & (F.size(items) == 0))
    for name, mark in GONE_MARKS.items():
        gone = gone | ((source == name) & F.col("body").rlike(mark))
    named = source.isin(*ALIVE_MARKS, "workday", "zip_recruiter") | F.contains("source_id", F.lit(":"))  # the others are asked by board and id
    ruled = source.isin(*ALIVE_FIELDS, *ALIVE_MARKS, "workday", "oracle", "zip_recruiter") & named
    refused = (source == "workday") & (F.col("status") == 403) & (j("$.errorCode") == "S22")
    no = F.lit(False)
    answer = F.when(ruled & (F.col("status").isin(404, 410) | F.coalesce(refused, no)), "gone").when(ok & F.coalesce(alive, no), "alive").when(ok & F.coalesce(gone, no), "gone").otherwise("unknown")
    return responses.withColumn("answer", answer)


def blocked(error: Column | str) -> Column:
    """Whether an error's text tells of a block or rate limit: a 403, 429 or 999 standing by itself."""
    return F.coalesce((F.col(error) if isinstance(error, str) else error).rlike(r"\b(?:403|429|999)\b"), F.lit(False))


def board_answers(asked: DataFrame, boards: DataFrame) -> DataFrame:
    """asked (board, posting_id) with `answer` from whole listings, boards (board, status, body): absence counts only in a listing all of whose entries are well formed; an unlisted entry that is present is alive."""
    jobs = F.from_json(F.get_json_object("body", "$.jobs"), "array<struct<id: string, title: string>>")
    whole = (F.col("status") == 200) & jobs.isNotNull() & F.forall(jobs, lambda j: j.isNotNull() & (F.length(j["id"]) > 0) & j["title"].isNotNull())
    ids = boards.select("board", F.coalesce(whole, F.lit(False)).alias("_whole"), F.transform(jobs, lambda j: j["id"]).alias("_ids"))
    x = asked.join(ids, "board", "left")
    listed = F.array_contains("_ids", F.col("posting_id"))
    return x.withColumn("answer", F.when(~F.coalesce("_whole", F.lit(False)), "unknown").when(listed, "alive").otherwise("gone")).drop("_whole", "_ids")


def sibling_texts(links: DataFrame, jobs: DataFrame) -> DataFrame:
    """(job_id, from_job): for each record without a description a described one that shares a posting (by the key of a URL); the last updated, ties to the largest id.

    The described side is reduced to one record a posting before the join, so a shared key can't multiply rows.
    """
    keyed = links.filter("job_id is not null").select("job_id", posting_key("url").alias("k")).filter("k is not null").distinct()
    described = F.length(F.trim("description")) > 0
    giver = keyed.join(jobs.filter(described).select("job_id", "updated_at"), "job_id").groupBy("k").agg(F.max(F.struct("updated_at", "job_id")).alias("g"))
    bare = keyed.join(jobs.filter(~F.coalesce(described, F.lit(False))).select("job_id"), "job_id")
    best = bare.join(giver, "k").groupBy("job_id").agg(F.max("g").alias("g"))
    return best.select("job_id", F.col("g.job_id").alias("from_job"))


def apply_details(jobs: DataFrame, details: DataFrame, now: Column) -> DataFrame:
    """jobs after details (job_id, outcome, description, salary): "ok" fills the description and a blank salary; "gone" marks it as looked for; other outcomes record the attempt only. updated_at moves only where a field did."""
    d = details.select("job_id", "outcome", F.col("description").alias("_d"), F.col("salary").alias("_s"))
    x = jobs.join(d, "job_id", "left")
    ok = F.coalesce(F.col("outcome") == "ok", F.lit(False))
    description = F.when(ok, F.coalesce("_d", "description")).otherwise(F.col("description"))
    salary = F.when(ok & (F.length(F.trim(F.coalesce("salary", F.lit("")))) == 0), F.coalesce("_s", "salary")).otherwise(F.col("salary"))
    moved = ~description.eqNullSafe(F.col("description")) | ~salary.eqNullSafe(F.col("salary"))
    return x.withColumns({
        "updated_at": F.when(moved, now).otherwise(F.col("updated_at")),
        "description_attempted_at": F.when(F.col("outcome").isNotNull(), now).otherwise(F.col("description_attempted_at")),
        "description_checked_at": F.when(F.col("outcome").isin("ok", "gone"), now).otherwise(F.col("description_checked_at")),
        "salary": salary,
        "description": description,
    }).drop("outcome", "_d", "_s")


def reference_faults(judgments: DataFrame, members: DataFrame) -> DataFrame:
    """judgments (group_id, job_id, canonical_id, duplicate_ids) with `fault`: null where all references are sound.

    "unknown": canonical or duplicates outside the group (members: group_id, job_id); "invalid": the canonical among its duplicates, or one of them twice; "other": the judged record is neither.
    """
    dup = F.coalesce("duplicate_ids", F.expr("array()").cast("array<string>"))
    named = judgments.select("group_id", F.col("job_id").alias("_j"), F.explode(F.array_union(dup, F.array("canonical_id"))).alias("job_id"))
    strangers = named.join(members.select("group_id", "job_id").distinct(), ["group_id", "job_id"], "left_anti").select("group_id", F.col("_j").alias("job_id")).distinct().withColumn("_unknown", F.lit(True))
    invalid = F.array_contains(dup, F.col("canonical_id")) | (F.size(dup) != F.size(F.array_distinct(dup)))
    other = ~F.array_contains(F.array_union(dup, F.array("canonical_id")), F.col("job_id"))
    x = judgments.join(strangers, ["group_id", "job_id"], "left")
    return x.withColumn("fault", F.when(F.col("_unknown"), "unknown").when(invalid, "invalid").when(other, "other")).drop("_unknown")


def conflicts(writes: DataFrame, table: DataFrame, key: str, inputs: list[str]) -> DataFrame:
    """writes with `conflict`: true where the record is missing, not unique, or has changed in one of the inputs since it was read (nulls compared as values)."""
    now = table.groupBy(key).agg(F.count("*").alias("_n"), *[F.min(c).alias(f"_{c}") for c in inputs])  # compared only where there is one row
    x = writes.join(now, key, "left")
    same = F.coalesce(F.col("_n") == 1, F.lit(False))
    for c in inputs:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return x.withColumn("conflict", ~same).drop("_n", *[f"_{c}" for c in inputs])


def endpoint(url: Column | str) -> Column:
    """struct<tenant, site, api> of a board's URL; null without a host or path."""
    url = F.col(url) if isinstance(url, str) else url
    host = F.try_parse_url(url, F.lit("HOST"))
    parts = F.filter(F.split(_path(url), "/"), lambda p: p != "")
    site, tenant = F.try_element_at(parts, F.lit(-1)), F.substring_index(host, ".", 1)
    api = F.concat(F.lit("https://"), host, F.lit("/wday/cxs/"), tenant, F.lit("/"), site, F.lit("/jobs"))
    return F.when(host.isNotNull() & site.isNotNull(), F.struct(tenant.alias("tenant"), site.alias("site"), api.alias("api")))


def long_date(c: Column | str) -> Column:
    """A date from ISO text or English "Jan 5, 2025" and "January 5, 2025"; null for anything else."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(parse_date(c), *[F.try_to_timestamp(F.trim(c), F.lit(f)).cast("date") for f in ("MMM d, yyyy", "MMMM d, yyyy")])


def city_from_slug(path: Column | str, title: Column | str) -> Column:
    """The words of a "/job/<slug>/" path ahead of the title's first word, as a name; '' where the slug doesn't hold the title."""
    path, title = (F.col(c) if isinstance(c, str) else c for c in (path, title))
    slug = F.lower(F.regexp_extract(F.try_url_decode(path), r"/job/([^/]+)/", 1))
    words = F.filter(F.split(F.regexp_replace(slug, r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")
    first = F.regexp_extract(F.lower(title), r"([\p{L}\p{N}]+)", 1)
    at = F.array_position(words, first)
    return F.when(at > 1, F.initcap(F.array_join(F.slice(words, 1, at.cast("int") - 1), " "))).otherwise("")
