import json

from conftest import rows
from pyspark.sql import functions as F

from quernwork.sources import snapshots as S


def test_snapshots_and_quarantine(spark):
    df = spark.createDataFrame([(json.dumps({"title": "Clerk", "more": 1}),), ("{bad",), (None,), ("[1]",), ("{}",)], "raw string")
    good, bad = S.parse_snapshots(df)
    assert [r.posting.title for r in good.collect()] == ["Clerk"] and bad.count() == 3


def test_job_lists(spark):
    body = json.dumps({"jobs": [{"id": 7, "absolute_url": "https://x/7", "title": "Clerk", "location": {"name": "A"}, "content": "&lt;p&gt;Hi&lt;/p&gt;", "updated_at": "2025-02-03T01:00:00Z"}, {"id": 8, "title": "no url"}, "junk", {"id": 9, "absolute_url": "u", "title": "B", "location": None}]})
    good, bad = S.read_job_lists(spark.createDataFrame([("b", body), ("empty", "{}"), ("broken", "{")], "board string, body string"))
    assert [(r.source_id, r.description, str(r.posted_date)) for r in good.orderBy("source_id").collect()] == [("b:7", "Hi", "2025-02-03"), ("b:9", "", "None")]
    assert bad.count() == 4  # two elements, and two bodies that hold no list


def test_posting_arrays(spark):
    body = json.dumps([{"id": "q", "hostedUrl": "u", "text": "Clerk", "categories": {"location": "A", "allLocations": ["A", "B"]}, "descriptionPlain": "D", "lists": [{"text": "L", "content": "<li>x</li>"}], "createdAt": 1735689600000}])
    good, _ = S.read_posting_arrays(spark.createDataFrame([("b", body)], "board string, body string"))
    r = good.collect()[0]
    assert (r.location, str(r.posted_date), "- x" in r.description) == ("A; B", "2025-01-01", True)


def test_listed_jobs(spark):
    body = json.dumps({"jobs": [{"id": "1", "jobUrl": "u", "title": "T", "isListed": False, "location": "A"}, {"id": "2", "jobUrl": "u", "title": "T", "location": "A", "secondaryLocations": [{"location": "B"}]}]})
    good, _ = S.read_listed_jobs(spark.createDataFrame([("b", body)], "board string, body string"))
    assert [(r.source_id, r.location) for r in good.collect()] == [("b:2", "A; B")]


def test_facets(spark):
    f = json.dumps([{"facetParameter": "country", "values": [{"id": "ca", "descriptor": "Canada"}, {"facetParameter": "city", "values": [{"id": "n", "descriptor": "Nordbury"}]}]}])
    for _ in range(8):
        f = json.dumps([{"values": json.loads(f)}])  # any depth
    got = rows(S.flatten_facets(spark.createDataFrame([("b", f), ("e", "[]"), ("n", None), ("x", "{")], "board string, f string"), "f"))
    assert got == [("b", "city", "n", "Nordbury"), ("b", "country", "ca", "Canada")]


def test_feed_and_summary(spark):
    e = '<entry><title>Clerk</title><link href="https://x/p/42"/><updated>2025-01-02</updated><summary>&lt;strong&gt;Salary:&lt;/strong&gt; $20 &lt;br/&gt;x</summary></entry>'
    got = S.read_feed(spark.createDataFrame([(e,), ("<entry><title/></entry>",), (None,)], "entry string"))
    r = got.select("source_id", "title", S.summary_field("summary", "Salary").alias("s"), S.summary_field("summary", "City").alias("c")).collect()
    assert [tuple(x) for x in r] == [("42", "Clerk", "$20", "")]


def test_tiles(spark):
    page = '<div><a class="jobTitle-link x" href="/job/1">A <b>clerk</b></a><span class="jobLocation"> Nordbury </span><a href="/no">n</a></div>'
    got = S.read_tiles(spark.createDataFrame([("b", page), ("b", None), ("b", "")], "board string, html string"))
    assert [(r.url, r.title.split()[0], r.location) for r in got.collect()] == [("/job/1", "A", "Nordbury")]


def test_union_sources(spark):
    a = spark.createDataFrame([(1,)], "x int")
    b = spark.createDataFrame([(2, "y")], "x int, y string")
    got = S.union_sources([b, a]).orderBy("ingest_seq").select("x", "y").collect()
    assert [tuple(r) for r in got] == [(2, "y"), (1, None)]
    assert F is not None
