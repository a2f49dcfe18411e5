"""Paged sources, page readers, store writes and judgments on small tables."""

import datetime as dt
import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from quernwork.operators import closure as C, incremental as I, judging as J, predicates as P, store as S
from quernwork.sources import pages as G, snapshots as Z

T0 = dt.datetime(2025, 1, 1)


def day(n):
    return T0 + dt.timedelta(days=n)


def ts(t):
    return F.lit(t).cast("timestamp_ntz")


def test_reader_stops(spark):
    data = [("a", 0, "x", 3), ("a", 0, "y", 0), ("a", 1, "z", 0), ("a", 2, "late", 0)]  # three keys met
    data += [("b", 0, "x", 0), ("b", 1, "x", 0), ("b", 2, "y", 0)]  # a page without a new key
    data += [("c", 0, "x", 0), ("c", 2, "y", 0)] + [("d", 1, "x", 0)] + [("e", n, f"k{n}", 0) for n in range(9)]  # a missing page, no first page, too many pages
    df = spark.createDataFrame(data, "scope string, page int, id string, total int")
    got = sorted((r.scope, r.page, r.id) for r in G.read_until_stop(df, ["scope"], "page", "id", "total", 4).collect())
    assert got == [("a", 0, "x"), ("a", 0, "y"), ("a", 1, "z"), ("b", 0, "x"), ("c", 0, "x")] + [("e", n, f"k{n}") for n in range(4)]
    assert G.read_until_stop(df.limit(0), ["scope"], "page", "id", "total", 4).count() == 0


def test_failed_detail_is_a_sighting(spark):
    found = spark.createDataFrame([("1", "t"), ("2", "u")], "id string, title string").withColumn("description", F.lit(None).cast("string"))
    got = G.with_details(found, spark.createDataFrame([("1", "text")], "id string, description string"), ["id"], ["description"])
    assert sorted((r.id, r.description) for r in got.collect()) == [("1", "text"), ("2", None)]


def test_location_filter(spark):
    leaves = spark.createDataFrame([("a", "country", "ca", "Canada"), ("a", "city", "1", "Nordbury"), ("b", "city", "2", "Nordbury"), ("b", "city", "1", "Nordbury West"), ("c", "city", "3", "Elsewhere")], "board string, parameter string, id string, descriptor string")
    assert rows(Z.location_filter(leaves, F.col("descriptor").contains("Nordbury"))) == [("a", "country", ["ca"]), ("b", "city", ["1", "2"])]


def test_frame_rows(spark):
    nan = float("nan")
    s = "id string, site string, job_url string, title string, company string, location string, description string, date_posted string, min_amount double, max_amount double, currency string, interval string, job_type string, job_url_direct string"
    data = [("1", "indeed", "u", "T", "nan", None, "d", "2025-01-02", 20.5, nan, None, "hourly", None, "nan"), ("2", "indeed", "u", "T", "c", "l", None, None, nan, nan, "USD", None, None, None), ("nan", "x", "u", "T", *[None] * 10), ("3", "x", None, "T", *[None] * 10)]
    got = {r.source_id: r for r in G.from_frame(spark.createDataFrame(data, s), F.lit("Nordbury")).collect()}
    assert set(got) == {"1", "2"} and got["1"].salary == "20.5 CAD hourly" and got["2"].salary == "" and got["1"].company == "" and got["1"].posted_date == dt.date(2025, 1, 2)


def test_feed(spark):
    e = lambda link, title: f'<entry><title>{title}</title><link href="{link}"/><updated>2025-01-02</updated></entry>'
    feed = "<feed>" + e("https://x.invalid/p/42/", "Clerk") + e("https://evil.invalid/p/43", "Clerk") + e("https://x.invalid/p/none", "Clerk") + e("https://x.invalid/p/44", " ") + "</feed>"
    df = spark.createDataFrame([(feed,), (None,), ("<feed/>",)], "feed string")
    assert [r.source_id for r in Z.read_feed(Z.feed_entries(df), "https://x.invalid/").collect()] == ["42"]


def test_results_page():
    page = '<span id="results-count">1,234</span><article id="article-1"><a class="resultJobItem" href="/jobposting/77;s=1"><span class="noctitle"> Kiln <b>Clerk</b></span></a><li class="location"><span class="wb-inv">Location</span> Nordbury</li><li class="salary">Salary $20</li></article><article id="article-2"><a class="resultJobItem" href="/other">x</a></article>'
    got = G.results_of(page)
    assert got["total"] == 1234 and [(r["source_id"], r["title"], r["location"], r["salary"], r["company"]) for r in got["rows"]] == [("77", "Kiln Clerk", "Nordbury", "$20", "")]
    assert G.results_of("<p>nothing</p>") is None and G.results_of(None) is None


def test_details(spark):
    chunk = lambda s: f'<script>self.__next_f.push([1,{json.dumps(s)}])</script>'
    text = "<p>Long text, \u00e9</p>"
    framed = f'1:{{"jobDetails":{{"htmlFullDescription":"$2"}}}}\n2:T{len(text.encode()):x},{text}'
    pages = [
        ("native", '<div class="job-posting-detail-requirements"><p>Do it</p></div>', "Do it", None), ("native", '<div class="job-posting-content"><a id="externalJobLink" href="u">x</a><div property="description">a &lt;LOD b</div></div>', "a <LOD b", None),
        ("native", '<div class="job-posting-content"><a id="externalJobLink" href="u">x</a></div>', "", None), ("native", "<p>x</p>", None, "fault"), ("native", None, None, "fault"),
        ("guest", '<div class="show-more-less-html__markup">A<br>B</div><div class="compensation__salary"> $20 </div>', "A\nB", None), ("tile", '<div class="jobdescription">T</div><span class="jobDate">Jan 5, 2025</span>', "T", None),
        ("framed", chunk(framed), "Long text, \u00e9", None), ("framed", chunk(framed[:-3]), None, "fault"), ("framed", '<script type="application/ld+json">{"@type": "JobPosting", "description": "<b>short</b>"}</script>' + chunk(framed), "Long text, \u00e9", None), ("framed", "", None, "fault"), ("odd", "x", None, "fault"),
    ]
    df = spark.createDataFrame([(n, k, p) for n, (k, p, _, _) in enumerate(pages)], "n int, kind string, html string")
    got = {r.n: r for r in G.read_details(df).collect()}
    for n, (kind, _, want, fault) in enumerate(pages):
        assert (got[n].description, got[n].fault is not None) == (want, fault is not None), (n, kind)
    assert got[5].salary == "$20" and got[6].date == "Jan 5, 2025"


def test_board_base(spark):
    urls = ["https://x.invalid/brand/search/?q=a", "https://x.invalid/go/Lab-Jobs/123/45/", "https://x.invalid/", "https://x.invalid/tile-search-results"]
    assert [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(G.board_base("u")).collect()] == ["https://x.invalid/brand", "https://x.invalid", "https://x.invalid", "https://x.invalid"]


def test_scan_plan(spark):
    groups = spark.createDataFrame([("a", ["x", "y z"]), ("b", ["x"]), ("c", [])], "scope string, terms array<string>")
    done = spark.createDataFrame([("a", day(8), day(1)), ("b", day(9), day(-20))], "scope string, last_success timestamp_ntz, last_full timestamp_ntz")
    got = sorted((r.scope, r.turn, r.query, r.city, r.hours, r.wanted) for r in I.scan_plan(groups, done, ["N", "T"], ts(day(10)), 24, 14, 3, 200, 400).collect())
    assert got == [("a", 0, 'x OR "y z"', "T", 50, 200), ("a", 1, 'x OR "y z"', "N", 50, 200), ("b", 0, "x", "T", None, 400), ("b", 1, "x", "N", None, 400), ("c", 0, "", "T", None, 400), ("c", 1, "", "N", None, 400)]


@pytest.mark.parametrize(("location", "want"), [("Toronto, NC", 0), ("Toronto, DC", 0), ("Toronto, ON", 1), ("Toronto, NC; Guelph, ON", 1), ("Toronto, NC, Canada", 1), ("Paris, England", 0), ("Edinburgh, Scotland", 1)])
def test_home_places(spark, location, want):
    assert len(spark.createDataFrame([(location,)], "l string").select(P.home_places("l")).first()[0]) == want


JOBS = "job_id string, closed_at timestamp_ntz, excluded_at timestamp_ntz, liveness_checked_at timestamp_ntz, liveness_alive_streak int"
LINKS = "job_id string, source string, source_id string, last_seen timestamp_ntz, apply_url string"


def test_candidates(spark):
    cases = {  # job: (checked, links (source, last seen, apply), candidate)
        "listed": (None, [("lever", 9, None)], False), "unlisted": (None, [("lever", 7, None)], True), "just": (None, [("lever", 8, None)], False), "not due": (day(9.5), [("indeed", 0, None)], False), "due": (day(8), [("indeed", 0, None)], True),
        "uncheckable": (day(9), [("glassdoor", -20, None)], True), "fresh": (None, [("glassdoor", -19, None)], False), "page": (None, [("glassdoor", 0, "p")], True), "strange": (None, [("indeed", 0, None), ("google", 0, None)], False),
        "early": (None, [("zip_recruiter", 7, None)], True), "early not due": (day(9.5), [("zip_recruiter", 7, None)], False), "skipped": (None, [("indeed", 0, None)], False), "skipped old": (None, [("glassdoor", -21, None)], True), "excluded": (None, [("indeed", 0, None)], False), "closed": (None, [("indeed", 0, None)], False),
    }
    jobs = spark.createDataFrame([(k, day(1) if k == "closed" else None, day(1) if k == "excluded" else None, c, 1) for k, (c, _, _) in cases.items()], JOBS)
    links = spark.createDataFrame([(k, s, f"{n}", day(d), a) for k, (_, ls, _) in cases.items() for n, (s, d, a) in enumerate(ls)], LINKS)
    unwanted = spark.createDataFrame([("skipped",), ("skipped old",)], "job_id string")
    got = [r.job_id for r in C.candidates(jobs, links, ts(day(10)), unwanted, F.col("apply_url") == "p", "zip_recruiter").collect()]
    assert set(got) == {k for k, (_, _, want) in cases.items() if want} and got[-2:] == ["due", "uncheckable"]


def test_links_and_pages(spark):
    links = spark.createDataFrame([("a", "indeed", "1", "u1", day(0), None), ("a", "linkedin", "2", "u1", day(1), day(0)), ("b", "lever", "3", "u2", day(0), None), ("b", "indeed", "4", "u2", day(0), None)], "job_id string, source string, source_id string, apply_url string, first_seen timestamp_ntz, gone_at timestamp_ntz")
    answers = spark.createDataFrame([("indeed", "1", "gone", "", True), ("linkedin", "2", "alive", "x", False)], "source string, source_id string, answer string, apply_url string, answered boolean")
    got = {r.source_id: (r.gone_at, r.apply_url) for r in C.record_links(links, answers, ts(day(5))).collect()}
    assert got == {"1": (day(5), None), "2": (None, "u1"), "3": (None, "u2"), "4": (None, "u2")}
    page = F.struct(F.lit("oracle").alias("source"), F.lit("s").alias("source_id"), F.col("apply_url").alias("url"))
    assert [(r.job_id, r.page.url) for r in C.employer_pages(links, page).collect()] == [("a", "u1")]


def test_batch_answers(spark):
    asked = spark.createDataFrame([("in-1",), ("in-2",), ("in-3",), ("in-4",)], "source_id string")
    replies = spark.createDataFrame([("1", True, "https://a.indeed.invalid/v", "indeed.invalid"), ("2", False, "https://own.example/x", "indeed.invalid"), ("3", None, None, None)], "key string, expired boolean, view_url string, host string")
    got = sorted((r.source_id, r.answer, r.apply_url, r.hosted) for r in C.batch_answers(asked, replies).collect())
    assert got == [("in-1", "gone", "", True), ("in-2", "alive", "https://own.example/x", False), ("in-3", None, "", False), ("in-4", None, "", False)]


def test_upsert_of_tables(spark):
    t = spark.createDataFrame([("a", 1, "x"), ("b", None, None)], "k string, n int, v string")
    new = spark.createDataFrame([("b", 2, "y", 1), ("b", 3, None, 2), ("c", 4, "z", 1)], "k string, n int, v string, o int")
    assert rows(S.put(t, new, ["k"], ["o"])) == [("a", 1, "x"), ("b", 3, None), ("c", 4, "z")]
    assert rows(S.put(t.limit(0), new.limit(0), ["k"], ["o"])) == []


def test_published_results(spark):
    r = spark.createDataFrame([("a", "f", "p", "old", day(1), None)], "job_id string, fingerprint string, policy string, result string, written_at timestamp_ntz, error string")
    anew = S.save_results(r, spark.createDataFrame([("a", "f", "p", "new"), ("b", "f", "p", "x")], "job_id string, fingerprint string, policy string, result string"))
    assert rows(anew.select("job_id", "result", "written_at")) == [("a", "new", None), ("b", "x", None)]
    w = spark.createDataFrame([("a", "f", "p", day(2), None), ("b", "f", "p", None, "quota")], "job_id string, fingerprint string, policy string, written_at timestamp_ntz, error string")
    assert rows(S.published(anew, w).select("job_id", "written_at", "error")) == [("a", day(2), None), ("b", None, "quota")]


def test_headers():
    assert S.header_names(["A", "B", "Note", ""], 5, 2) == ["Note", "Column D", "Column E"] and S.header_names(["x"] * 26 + [""], 27, 26) == ["Column AA"]
    with pytest.raises(ValueError):
        S.header_names(["A", "N", "N"], 3, 1)


def test_fetch_order(spark):
    s = "source string, job_id string, k string, attempted_at timestamp_ntz, first_seen timestamp_ntz"
    df = spark.createDataFrame([("a", "1", "p", None, day(1)), ("a", "2", "q", None, day(2)), ("a", "3", "r", day(3), day(9)), ("a", "4", "p", day(4), day(9)), ("b", "5", "p", None, None)], s)
    got = sorted((r.source, r.turn, r.k, r.job_id) for r in S.fetch_order(df, "k", 2, {"b": 1}).collect())
    assert got == [("a", 1, "q", "2"), ("a", 2, "r", "3"), ("b", 1, "p", "5")]
    assert S.fetch_order(df.limit(0), "k", 2).count() == 0


def test_inherited_and_conflicts(spark):
    s = "job_id string, canonical_id string, duplicate_ids array<string>, score int"
    j = spark.createDataFrame([("a", "b", ["a"], 50), ("c", "c", [], 10)], s)
    kept = spark.createDataFrame([("b", "b", ["z"], 90)], s)
    assert rows(J.inherited(j, kept)) == [("a", "b", ["a", "z"], 90), ("c", "c", [], 10)]
    assert rows(J.without_conflicts(j, spark.createDataFrame([("a", "x"), ("c", "c")], "job_id string, canonical_id string")).select("job_id", "canonical_id", "duplicate_ids")) == [("a", "a", []), ("c", "c", [])]


@pytest.mark.parametrize(("text", "want"), [("Pay is negotiable", True), ("not negotiable", False), ("non-negotiable", False), ("rate depends on experience", True), ("based upon your many qualifications", True), ("starting at $20", True), ("from $20", True), ("DOE", True), ("does it", False), ("$20", False), (None, False)])
def test_open_pay(spark, text, want):
    from quernwork.functions.jobtext import pay_is_open

    assert spark.createDataFrame([(text, None)], "s string, d string").select(pay_is_open("s", "d")).first()[0] is want


def test_scores(spark):
    df = spark.createDataFrame([(90, True, None), (60, False, False), (None, None, None)], "s int, a boolean, b boolean")
    got = df.select(J.capped_score(F.col("s"), [(F.col("a"), 74), (F.col("b"), 29)]).alias("c")).select("c", J.banded(F.col("c"), [(75, "high"), (55, "middle")], "rest"))
    assert [tuple(r) for r in got.collect()] == [(74, "middle"), (60, "middle"), (None, None)]
    r = df.limit(1).select(J.remarks(F.lit("N. "), [F.lit("low"), F.lit(None).cast("string"), F.lit("cut")], F.lit("x"), F.lit("y")), J.valid_pay(F.lit(2.0), F.lit(1.0), F.lit("hour"), ["hour"]), J.valid_pay(F.lit(1.0), F.lit(2.0), F.lit("hour"), ["hour"])).first()
    assert tuple(r) == ("Duplicate of x. N. Low; cut.", False, True)
    assert J.config_faults(["a"], {"b": []}, {"n": (0, 1), "m": (None, 1)}) == ["exceptions to ['b'], which aren't excluded", "n is below 1"]
