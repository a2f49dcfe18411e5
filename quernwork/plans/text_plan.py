"""Queries over fields of postings: cleaning, keys, predicates, pay texts, URLs, snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quernwork.functions import jobtext as X
from quernwork.functions.pay import pay_statements
from quernwork.functions.text import fold
from quernwork.operators import predicates as P
from quernwork.operators.resolve import MATERIAL
from quernwork.operators.units import REFERENCE_ROWS
from quernwork.session import bounded_rows, table
from quernwork.sources.snapshots import SNAPSHOT, parse_snapshots

QUERIES, SQL = {}, {}

#: Neutral example rules.
CITIES = {"Nordbury": ["Old Nordbury Landing"], "Tambmere": [], "Keskmere": []}
RULES = {
    "cities": CITIES,
    "titles": ["technician", "scientist", "analyst", "assess*"],
    "title_exclusions": ["senior", "lead", "kiln"],
    "title_exceptions": {"kiln": ["analyst"]},
    "companies": ["tarrowick*"],
    "too_far": ["elmaby", "varnaby", "tambmere"],
}

#: SQL pieces. A text is folded to a-z, 0-9 and blanks and padded, so that a whole word is a substring.
_PAD = "(' ' || trim(regexp_replace(lower(strip_accents(coalesce({0}, ''))), '[^a-z0-9]+', ' ', 'g')) || ' ')"
_TITLE_OK = f"({' or '.join(f'contains({_PAD.format("title")}, {w!r})' for w in (' technician ', ' scientist ', ' analyst ', ' assess'))})"
_EXCLUDED = f"(contains({_PAD.format('title')}, ' senior ') or contains({_PAD.format('title')}, ' lead ') or (contains({_PAD.format('title')}, ' kiln ') and not contains({_PAD.format('title')}, ' analyst ')))"
_FOREIGN = rf"(regexp_matches(lower(strip_accents(p)), '{P.FOREIGN_WORDS}') or regexp_matches(p, '{P.FOREIGN_STATE}'))"
_HOME = rf"list_filter(string_split_regex(coalesce(location, ''), '[;|\n]| / '), lambda p: contains(lower(strip_accents(p)), 'canada') or not {_FOREIGN})"
_CITY = "case " + " ".join(
    f"when len(list_filter({_HOME}, lambda p: {' or '.join(f'contains({_PAD.format("p")}, {(" " + n.lower() + " ")!r})' for n in [c, *a])})) > 0 then '{c}'" for c, a in CITIES.items()
) + " end"
_PART = "(contains(regexp_replace(lower(strip_accents(coalesce(job_type, ''))), '[^a-z]', '', 'g'), 'parttime') and not contains(regexp_replace(lower(strip_accents(coalesce(job_type, ''))), '[^a-z]', '', 'g'), 'fulltime'))"
_TOWNS = ["tambmere", "keskmere", "elmaby", "nordbury", "varnaby"]
_TOO_FAR = r"""(select len(names) > 0 and len(list_filter(names, lambda p: p not in ({0}))) = 0 from (select list_filter(list_transform(string_split_regex(lower(strip_accents(coalesce(location, ''))), '[;|\n]| / |\)\s+'), lambda p: trim(regexp_extract(p, '^([^,(]*)', 1))), lambda p: p <> '') as names))"""
_FAR = _TOO_FAR.format(", ".join(repr(t) for t in RULES["too_far"]))
_REASON = f"case when ({_CITY} is null and lower(coalesce(city, '')) not in ('nordbury', 'tambmere', 'keskmere')) or {_FAR} then 'location' when not {_TITLE_OK} then 'title' when {_EXCLUDED} then 'excluded_title' when contains({_PAD.format('company')}, ' tarrowick') then 'company' when {_PART} then 'job_type' end"
_SUFFIX = "(" + "|".join(X.COMPANY_SUFFIXES) + ")"
_COMPANY = f"trim(regexp_replace(regexp_replace('  ' || replace(trim(regexp_replace(lower(strip_accents(coalesce(company, ''))), '[^a-z0-9]+', ' ', 'g')), ' ', '  ') || '  ', ' {_SUFFIX} ', ' ', 'g'), ' +', ' ', 'g'))"
_TITLE = "trim(regexp_replace(lower(strip_accents(coalesce(title, ''))), '[^a-z0-9]+', ' ', 'g'))"
KEY = f"concat_ws('|', {_COMPANY}, {_TITLE}, lower(coalesce(city, '')))"


def _clean(c: str) -> str:
    t = rf"regexp_replace(regexp_replace(coalesce({c}, ''), '[ \t\r\f\v]+', ' ', 'g'), '^[\s\x{{00A0}}]+|[\s\x{{00A0}}]+$', '', 'g')"
    return f"case when lower({t}) in ('nan', 'none', 'nat') then '' else {t} end"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("select place_id, lower(strip_accents(place_name)) as folded from places")
def fold_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "places").select("place_id", fold("place_name").alias("folded"))


@query(f"select job_id, {_clean('title')} as title, {_clean('location')} as location, {_clean('salary')} as salary from jobs")
def clean_fields(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "jobs").select("job_id", *[X.clean(c).alias(c) for c in ("title", "location", "salary")])


@query(r"""select job_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(description, ''), '[ \t\r\f\v\x{00A0}]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') as description from jobs""")
def clean_descriptions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "jobs").select("job_id", X.clean_description("description").alias("description"))


@query(f"select job_id, {_COMPANY} as company, {_TITLE} as title, {KEY} as dedupe_key, substr(sha1({KEY}), 1, 16) as entity_id from jobs")
def identity_keys(spark: SparkSession, d: str) -> DataFrame:
    key = X.dedupe_key("company", "title", "city")
    return table(spark, d, "jobs").select("job_id", X.norm_company("company").alias("company"), X.norm_title("title").alias("title"), key.alias("dedupe_key"), X.entity_id(key).alias("entity_id"))


@query("select job_id, sha1(cast(to_json([coalesce(title, ''), coalesce(description, ''), coalesce(company, ''), coalesce(city, ''), coalesce(location, ''), coalesce(salary, ''), coalesce(job_type, '')]) as varchar)) as hash from jobs")
def content_hashes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "jobs").select("job_id", X.content_hash(*MATERIAL).alias("hash"))


@query(f"select job_id, {_CITY} as city from jobs")
def city_match_priority(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "jobs").select("job_id", P.city_match("location", CITIES).alias("city"))


@query(f"select job_id, {_TITLE_OK} as kept, {_EXCLUDED} as excluded from jobs")
def title_keywords(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "jobs")
    return j.select("job_id", P.keyword_match("title", RULES["titles"]).alias("kept"), P.keyword_excluded("title", RULES["title_exclusions"], RULES["title_exceptions"]).alias("excluded"))


@query(
    r"""with t as (select job_id, list_filter(list_transform(string_split_regex(lower(strip_accents(coalesce(location, ''))), '[;|\n]| / |\)\s+'), lambda p: trim(regexp_extract(p, '^([^,(]*)', 1))), lambda p: p <> '') as names from jobs)
    select job_id, len(names) > 0 and len(list_filter(names, lambda p: p not in ('tambmere', 'keskmere', 'elmaby', 'nordbury', 'varnaby'))) = 0 as too_far from t"""
)
def too_far_places(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "jobs").select("job_id", P.too_far("location", _TOWNS).alias("too_far"))


@query(f"select coalesce(job_type, '') as job_type, {_PART} as part_time, count(*) as jobs from jobs group by 1, 2")
def part_time_types(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "jobs").groupBy(F.coalesce("job_type", F.lit("")).alias("job_type"), P.part_time_only("job_type").alias("part_time")).agg(F.count("*").alias("jobs"))


@query(f"select {_REASON} as reason, count(*) as postings from postings group by 1")
def rejection_reasons(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "postings").groupBy(P.rejection_reason(RULES).alias("reason")).agg(F.count("*").alias("postings"))


@query(
    f"""with known as (select distinct source, source_id from job_sources), p as (select *, {_REASON} as reason from postings)
    select source, case when k.source_id is not null then 'update' when reason is null then 'new' else 'reject' end as route, reason, count(*) as postings from p left join known k using (source, source_id) group by 1, 2, 3"""
)
def routed_postings(spark: SparkSession, d: str) -> DataFrame:
    return P.route(table(spark, d, "postings"), RULES, table(spark, d, "job_sources")).groupBy("source", "route", "reason").agg(F.count("*").alias("postings"))


@query(rf"select ingest_seq, regexp_replace({_clean('location')}, ',\s*(AB|BC|MB|NB|NL|NS|NT|NU|ON|PE|QC|SK|YT),\s*CA$', ', \1, Canada') as location from postings")
def full_country_names(spark: SparkSession, d: str) -> DataFrame:
    return P.normalize(table(spark, d, "postings"), CITIES).select("ingest_seq", "location")


_HOST = r"lower(regexp_extract(url, '^https?://([^/?#:]+)', 1))"


@query(f"select source, {_HOST} as host, count(*) as links from job_sources group by 1, 2")
def url_hosts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "job_sources").groupBy("source", X.url_host("url").alias("host")).agg(F.count("*").alias("links"))


@query(
    "select source, count(*) as links, count(*) filter (where not (" + " or ".join(f"('.' || {_HOST}) like '%.{a}'" for a in X.AGGREGATOR_HOSTS) + ")) as own_pages, count(distinct coalesce('jid:' || nullif(regexp_extract(url, '[?&]jid=([^&#]+)', 1), ''), url)) as postings from job_sources group by 1"
)
def external_pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "job_sources").groupBy("source").agg(F.count("*").alias("links"), F.count_if(X.external_url("url") != "").alias("own_pages"), F.countDistinct(X.posting_key("url")).alias("postings"))


@query(
    """with r as (select source, source_id, job_id, recorded_at, raw from job_sources where raw is not null)
    select source, source_id, recorded_at, json_extract_string(raw, '$.title') as title, json_extract_string(raw, '$.company') as company, json_extract_string(raw, '$.city') as city, cast(json_extract_string(raw, '$.posted_date') as date) as posted_date from r"""
)
def raw_snapshots(spark: SparkSession, d: str) -> DataFrame:
    good, _ = parse_snapshots(table(spark, d, "job_sources"))
    return good.select("source", "source_id", "recorded_at", *[F.col(f"posting.{c}").alias(c) for c in ("title", "company", "city")], X.parse_date("posting.posted_date").alias("posted_date"))


@query("select count(*) as snapshots, count(*) filter (where not json_valid(raw)) as broken, sum(len(json_keys(raw)))::bigint as fields from job_sources where raw is not null")
def snapshot_quality(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "job_sources").filter("raw is not null").select(F.json_object_keys("raw").alias("k"))
    return s.agg(F.count("*").alias("snapshots"), F.count_if(F.col("k").isNull()).alias("broken"), F.sum(F.size("k")).cast("bigint").alias("fields"))


@query("select job_id, case when length(description) > 500 then substr(description, 1, 500) || ' [truncated]' else description end as description from jobs")
def report_texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "jobs").select("job_id", X.truncate_report("description", 500).alias("description"))


_AMOUNT = "rtrim(rtrim(format('{{:,.2f}}', {0}), '0'), '.')"


@query(
    f"""with p as (select o_orderkey, o_totalprice as low, o_totalprice * 2 as high from orders)
    select o_orderkey, {_AMOUNT.format('round(low, 2)')} || ' - ' || {_AMOUNT.format('round(high, 2)')} || ' CAD yearly' as pay from p where low > 0"""
)
def formatted_pay(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("low"), (F.col("o_totalprice") * 2).alias("high")).filter("low > 0")
    return o.select("o_orderkey", X.format_pay(F.round("low", 2), F.round("high", 2), F.lit("CAD"), F.lit("yearly")).alias("pay"))


@query(
    r"""with s as (select job_id, salary, list_transform(regexp_extract_all(salary, '(\d{1,3}(,\d{3})+(\.\d+)?|\d+(\.\d+)?)', 1), lambda x: cast(replace(x, ',', '') as double)) as a,
      regexp_matches(lower(salary), '\b(hourly|per hour|an hour|/ ?hr|/ ?hour|/h)\b') as h, regexp_matches(lower(salary), '\b(yearly|annual|annually|per year|a year|/ ?yr|/ ?year|per annum)\b') as y from jobs where regexp_matches(salary, '^[0-9,.]+( - [0-9,.]+)? (CAD|USD|EUR|GBP) [a-z]+$')),
    u as (select job_id, list_max(a) as top, regexp_extract(salary, '(CAD|USD|EUR|GBP)', 1) as cur, case when h and not y then 'hourly' when y and not h then 'annual' end as unit from s),
    v as (select *, case when unit = 'hourly' or (unit is null and top < 200) then top * 2080 when unit = 'annual' then top end as yearly from u)
    select job_id, unit, case when cur in ('CAD', 'USD') and yearly >= 15000 then round(yearly, 2) end as annual_maximum from v"""
)
def annual_maxima(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "jobs").filter(F.col("salary").rlike(r"^[0-9,.]+( - [0-9,.]+)? (CAD|USD|EUR|GBP) [a-z]+$"))
    j = j.select("job_id", X.pay_unit("salary").alias("unit"), F.array_max(X.pay_amounts("salary")).alias("top"), F.regexp_extract("salary", "(CAD|USD|EUR|GBP)", 1).alias("cur"))
    return j.select("job_id", "unit", F.round(X.annual_maximum(F.col("top"), F.col("cur"), F.col("unit")), 2).alias("annual_maximum"))


@query()
def annual_maxima_of_all(spark: SparkSession, d: str) -> DataFrame:
    """The most that every job's pay comes to in a year, whatever form its salary has; null where none can be read (scanner, no SQL form)."""
    per_year = {r.unit: float(r.per_year) for r in bounded_rows(table(spark, d, "pay_units").select("unit", "per_year"), REFERENCE_ROWS, "pay_units")}
    top = X.stated_annual_maximum(pay_statements("salary"), per_year)
    return table(spark, d, "jobs").select("job_id", top.alias("top")).select("job_id", "top.unit", "top.annual_maximum")


@query(
    "select job_id, regexp_matches(regexp_replace(lower(coalesce(salary, '') || chr(10) || coalesce(description, '')), '" + X.FIRM_PAY + "', chr(10), 'g'), '" + X.OPEN_PAY + "') as open from jobs"
)
def open_pay(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "jobs").select("job_id", X.pay_is_open("salary", "description").alias("open"))


@query()
def description_pay(spark: SparkSession, d: str) -> DataFrame:
    """Pay stated within whole descriptions (scanner, no SQL form)."""
    s = table(spark, d, "jobs").select("job_id", F.explode(pay_statements("description")).alias("p")).filter("p.unit is not null and (p.currency is not null or p.thousands)")
    return s.select("job_id", "p.low", "p.high", "p.unit", "p.currency")


@query()
def html_texts(spark: SparkSession, d: str) -> DataFrame:
    """Readable text of descriptions with markup (HTML parser, no SQL form)."""
    return table(spark, d, "postings").filter("description like '%<%>%'").select("ingest_seq", X.html_text("description").alias("text"))


__all__ = ["QUERIES", "SNAPSHOT", "SQL"]
