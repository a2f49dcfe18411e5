import datetime as dt
import json

from conftest import rows
from pyspark.sql import functions as F

from quernwork.operators import evidence as E


def test_employer_link(spark):
    urls = ["https://boards.greenhouse.io/acme/jobs/77", "https://jobs.lever.co/acme/12345678-1234-1234-1234-123456789abc/apply", "https://x.oraclecloud.com/hcmUI/CandidateExperience/en/sites/CX/job/9", "https://evil.invalid/acme/jobs/77", "https://greenhouse.io.invalid/a/jobs/1", "not a url", None, "", "https://acme.wd3.myworkdayjobs.com/en/Site/job/Here/Clerk_R1/apply/now?x=1", "https://acme.wd3.myworkdayjobs.com/en/Site/job", "https://a.jobs.hr.cloud.sap/job/1?x=2", "https://a.jobs.hr.cloud.sap/jobs/1", "https://jobs.lever.co/acme/123", "https://x.oraclecloud.com/hcmUI/CandidateExperience/en/sites/CX/requisitions/preview/9"]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(E.employer_link("u")["source_id"]).collect()]
    assert got == ["acme:77", "acme:12345678-1234-1234-1234-123456789abc", "CX:9", None, None, None, None, None, "acme.wd3.myworkdayjobs.com:", None, "a.jobs.hr.cloud.sap:", None, None, "CX:9"]
    url = spark.createDataFrame([(urls[8],), (urls[10],)], "u string").select(E.employer_link("u")["url"]).collect()
    assert [r[0] for r in url] == ["https://acme.wd3.myworkdayjobs.com/en/Site/job/Here/Clerk_R1", "https://a.jobs.hr.cloud.sap/job/1"]


def test_classify(spark):
    ok = json.dumps({"id": 7, "title": "T"})
    data = [("greenhouse", "b:7", 200, ok), ("greenhouse", "b:8", 200, ok), ("greenhouse", "b:7", 404, None), ("lever", "b:7", 410, ""), ("greenhouse", "b:7", 500, ok), ("greenhouse", "b:7", 200, "{bad"), ("greenhouse", "7", 404, None), ("indeed", "b:7", 404, None), ("greenhouse", "b:7", None, None), ("smartrecruiters", "b:7", 200, '{"id":"7","name":"T","active":false}'), ("smartrecruiters", "b:7", 200, '{"id":"7","name":"T"}')]
    data += [("workday", "w", 403, '{"errorCode":"S22"}'), ("workday", "w", 403, "{}"), ("workday", "w", 200, '{"jobPostingInfo":{"title":"t","jobReqId":"r"}}'), ("oracle", "s:7", 200, '{"count":0,"items":[]}'), ("oracle", "s:7", 200, '{"count":1,"items":[{"Id":"7","Title":"t"}]}'), ("oracle", "s:7", 200, '{"count":1,"items":[{"Id":"8","Title":"t"}]}'), ("linkedin", "1", 200, '<h1 class="top-card-layout__title">x</h1><figure class="closed-job">'), ("linkedin", "1", 200, '<h1 class="top-card-layout__title">'), ("zip_recruiter", "1", 200, '{"status":{"isActive":true,"deactivatedAtUtc":"x"}}'), ("zip_recruiter", "1", 200, '{"status":{"deactivatedAtUtc":"x"}}'), ("successfactors", "1", 200, "you can't view this job because it\u2019s not available at this time"), ("jobbank", "1", 410, None)]
    got = [r.answer for r in E.classify(spark.createDataFrame(data, "source string, source_id string, status int, body string")).collect()]
    assert got == ["alive", "unknown", "gone", "gone", "unknown", "unknown", "unknown", "unknown", "unknown", "unknown", "alive", "gone", "unknown", "alive", "gone", "alive", "unknown", "gone", "alive", "unknown", "gone", "gone", "gone"]


def test_boards(spark):
    boards = spark.createDataFrame([("a", 200, '{"jobs":[{"id":"1","title":"x"}]}'), ("b", 200, '{"jobs":[{"id":"1","title":"x"},{"id":""}]}'), ("c", 404, None), ("d", 200, '{"jobs":[]}')], "board string, status int, body string")
    asked = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "2"), ("c", "1"), ("d", "1"), ("zz", "1")], "board string, posting_id string")
    got = {(r.board, r.posting_id): r.answer for r in E.board_answers(asked, boards).collect()}
    assert got == {("a", "1"): "alive", ("a", "2"): "gone", ("b", "2"): "unknown", ("c", "1"): "unknown", ("d", "1"): "gone", ("zz", "1"): "unknown"}


def test_details(spark):
    t = dt.datetime(2025, 1, 1)
    s = "job_id string, description string, salary string, updated_at timestamp_ntz, description_attempted_at timestamp_ntz, description_checked_at timestamp_ntz"
    jobs = spark.createDataFrame([("a", "", "", t, None, None), ("b", "x", "s", t, None, None), ("c", None, None, t, None, None), ("d", "", None, t, None, None)], s)
    details = spark.createDataFrame([("a", "ok", "new", "pay"), ("b", "ok", "x", "pay"), ("c", "gone", None, None), ("d", "blocked", None, None)], "job_id string, outcome string, description string, salary string")
    now = dt.datetime(2025, 2, 1)
    got = {r.job_id: r for r in E.apply_details(jobs, details, F.lit(now).cast("timestamp_ntz")).collect()}
    assert (got["a"].description, got["a"].salary, got["a"].updated_at) == ("new", "pay", now)
    assert (got["b"].salary, got["b"].updated_at, got["b"].description_checked_at) == ("s", t, now)
    assert (got["c"].description_checked_at, got["d"].description_checked_at, got["d"].description_attempted_at) == (now, None, now)


def test_references(spark):
    m = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c")], "group_id int, job_id string")
    j = spark.createDataFrame([(1, "a", "a", ["b"]), (1, "b", "a", ["zz"]), (1, "c", "a", ["a", "c"]), (1, "x1", "a", ["b", "b"]), (1, "c", "a", None)], "group_id int, job_id string, canonical_id string, duplicate_ids array<string>")
    assert [r[1] for r in rows(E.reference_faults(j, m).select("job_id", "fault"))] == [None, "unknown", "other", "invalid", "invalid"] or sorted(str(r.fault) for r in E.reference_faults(j, m).collect()) == ["None", "invalid", "invalid", "other", "unknown"]


def test_conflicts(spark):
    t = spark.createDataFrame([("a", "x"), ("b", None), ("c", "x"), ("c", "x")], "id string, v string")
    w = spark.createDataFrame([("a", "x"), ("b", None), ("c", "x"), ("d", "x"), ("a", "y")], "id string, v string")
    assert rows(E.conflicts(w, t, "id", ["v"]).select("id", "v", "conflict")) == [("a", "x", False), ("a", "y", True), ("b", None, False), ("c", "x", True), ("d", "x", True)]


def test_small_functions(spark):
    df = spark.createDataFrame([("https://acme.wd3.invalid/en-US/Site", "Jan 5, 2025", "/job/New-Nordbury-Kiln-Clerk-ON/12", "Kiln Clerk")], "u string, d string, p string, t string")
    r = df.select(E.endpoint("u").alias("e"), E.long_date("d").alias("d"), E.city_from_slug("p", "t").alias("c")).collect()[0]
    assert (r.e.tenant, r.e.site, r.d, r.c) == ("acme", "Site", dt.date(2025, 1, 5), "New Nordbury")
