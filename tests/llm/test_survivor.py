import datetime as dt

from conftest import rows
from pyspark.sql import functions as F

from quernwork.llm import survivor as S

T0 = dt.datetime(2025, 1, 1)


def test_lines(spark):
    df = spark.createDataFrame([("a\n- a\n• b\n\n 1) b ",), ("TBD",), ("(no description)",), (None,), ("",), ("x\r\ny",), ("<p>a</p><p>b</p>",), ("-\n*",)], "d string")
    assert [r[0] for r in df.select(S.distinct_lines(F.col("d"))).collect()] == [2, 0, 0, 0, 0, 2, 2, 0]


def test_survivors(spark):
    jobs = spark.createDataFrame(
        [("a", "B x", "l1\nl2", T0, "z"), ("b", "AA", "l1", T0 + dt.timedelta(1), "z"), ("c", "unknown", "l1\nl2\nl2", None, "z"), ("d", None, None, None, "z"), ("e", "aa", "TBD", T0 + dt.timedelta(2), "z")],
        "job_id string, primary_source string, description string, updated_at timestamp_ntz, paid string",
    )
    profiles = spark.createDataFrame([("aa", 1), ("b_x", 2)], "source string, trust_rank int")
    groups = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (1, "c"), (2, "d"), (3, "ghost"), (4, "b"), (4, "e"), (5, None)], "group_id long, job_id string")
    paid = spark.createDataFrame([("a",), ("b",), ("b",)], "job_id string")
    got = rows(S.survivors(groups, jobs, paid, profiles))
    assert got == [(1, "a", "b", "b"), (2, "", "", "d"), (3, "", "", ""), (4, "b", "b", "e"), (5, "", "", "")]
    assert S.survivors(groups.limit(0), jobs, paid, profiles).count() == 0
    assert rows(S.survivors(groups.filter("group_id = 1"), jobs.limit(0), paid.limit(0), profiles.limit(0))) == [(1, "", "", "")]
