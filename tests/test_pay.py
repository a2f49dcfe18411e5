import pytest
from pyspark.sql import functions as F

from quernwork.functions.pay import pay_statements, scan_pay
from quernwork.operators.units import band_of, settle_columns, settle_statements

HOUR = 2080.0


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("47,000 - 52,500 CAD yearly", [(47000, 52500, "year", "CAD", False)]),
        ("29,05 $ - 32,50 $ l'heure", [(29.05, 32.5, "hour", None, False)]),
        ("C$118-141K yearly", [(118000, 141000, "year", "CAD", True)]),
        ("CAD 87,672 annually, i.e. CAD 42.15 hourly", [(87672, 87672, "year", "CAD", False), (42.15, 42.15, "hour", "CAD", False)]),
        ("$750 sign-on bonus. Pay C$1,720 - C$2,000 biweekly plus $500 signing bonus", [(1720, 2000, "biweek", "CAD", False)]),
        ("entre 7 100 $ à 8 550 $ CAD par mois", [(7100, 8550, "month", "CAD", False)]),
        ("twenty-four Canadian dollars an hour", [(24, 24, "hour", "CAD", False)]),
        ("forty thousand CAD a year", [(40000, 40000, "year", "CAD", False)]),
        ("US$16.3/h (40 h/wk, DOE)", [(16.3, 16.3, "hour", "USD", False)]),
        ("$4,480 every two weeks", [(4480, 4480, "biweek", None, False)]),
        ("34500 - 39500", [(34500, 39500, None, None, False)]),
        ("Up to CAD 6,000/month", [(6000, 6000, "month", "CAD", False)]),
        ("€3,500 to €4,250/mo", [(3500, 4250, "month", "EUR", False)]),
        ("$0/hr", []), ("Grade 7", []), ("Level 3, step 2", []), ("$500 signing bonus", []), ("bonus up to 8%", []), ("TBD", []), ("", []), (None, []), ("   ", []),
    ],
)
def test_scan(text, want):
    assert [(x["low"], x["high"], x["unit"], x["currency"], x["thousands"]) for x in scan_pay(text)] == want


def _settle(spark, rows):
    df = spark.createDataFrame(rows, "id int, salary string, u string, c string, s double, clash string")
    df = df.withColumn("statements", pay_statements("salary"))
    return {r.id: r.settled for r in settle_statements(df, "statements", {"hour": HOUR, "year": 1.0, "week": 52.0}, {"CAD": 1.0, "USD": 1.5}, "u", "c", "s").collect()}


def test_settle(spark):
    got = _settle(
        spark,
        [
            (1, "$20 an hour", "year", "CAD", 1000.0, "x"),  # a stated unit beats the habit, and the scale isn't for it
            (2, "52", "year", "CAD", 1000.0, "x"),  # a bare figure takes all habits
            (3, "20", None, None, None, None),  # no habit: no rate, so no value
            (4, "20 CAD", None, None, None, None),  # several units are equally good
            (5, None, "year", "CAD", 1.0, None),
            (6, "CAD 41,600 (CAD 20 hourly)", "hour", "CAD", 1.0, "x"),  # the identity settles the open unit against the habit
            (7, "USD 10 hourly", "year", "CAD", 1.0, "x"),
        ],
    )
    assert (got[1].low, got[1].unique) == (20 * HOUR, True)
    assert (got[2].low, got[2].high) == (52000, 52000)
    assert got[3] is None and got[5] is None
    assert got[4].unique is False and got[4].low is None
    assert (got[6].low, got[6].unique) == (41600, True)
    assert got[7].low == 10 * HOUR * 1.5


def test_settle_empty_table(spark):
    assert _settle(spark, []) == {}


def test_columns_by_identity(spark):
    rows = [("a", 2.0 * v, 2.0, v * 1000.0) for v in (1.0, 2.0, 5.0)] + [("b", 2.0 * v, 2.0, v) for v in (1.0, 3.0)] + [("a", None, 1.0, 1.0), ("a", 0.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "source string, mass double, density double, volume double")
    got = settle_columns(df, "source", {"mass": 1, "density": -1, "volume": -1}, {"mass": {"kg": 1.0}, "density": {"kg/l": 1.0}, "volume": {"l": 1.0, "ml": 0.001}}).collect()
    assert {r.source: (r.units["volume"], r.unique, r.n) for r in got} == {"a": ("ml", True, 3), "b": ("l", True, 2)}
    twice = settle_columns(df, "source", {"mass": 1, "density": -1, "volume": -1}, {"mass": {"kg": 1.0, "g": 0.001}, "density": {"kg/l": 1.0}, "volume": {"l": 1.0, "ml": 0.001}}).collect()
    assert [r.unique for r in twice if r.source == "b"] == [False, False]


def test_bands(spark):
    bands = spark.createDataFrame([(1, 0, 10), (2, 10, 20), (9, 30, 40)], "band_id int, low int, high int")
    df = spark.createDataFrame([(0.0,), (9.99,), (10.0,), (20.0,), (35.0,), (40.0,), (None,), (-1.0,)], "x double")
    assert [r[0] for r in df.select(band_of(F.col("x"), bands, "band_id", "low", "high")).collect()] == [1, 1, 2, None, 9, None, None, None]
    assert df.select(band_of(F.col("x"), bands.limit(0), "band_id", "low", "high")).collect()[0][0] is None


def test_annual_maxima_of_all_jobs(spark, tmp_path):
    """Every job has its row, and dirty salaries are read."""
    from quernwork.plans import registry

    want = {
        "30 - 40 CAD hourly": ("hour", 83200.0), "34,000 - 52,500.5 CAD yearly": ("year", 52500.5), "$34,000/yr": ("year", 34000.0), "CAD 104k to CAD 117k annually": ("year", 117000.0), "C$118-141K yearly": ("year", 141000.0),
        "29,05 $ - 32,50 $ l'heure": ("hour", 67600.0), "Up to CAD 6,000/month": ("month", 72000.0), "$4,480 every two weeks": ("biweek", 116480.0), "25": (None, 52000.0), "34500 - 39500": (None, None),
        "CAD 87,672 annually, i.e. CAD 42.15 hourly": ("year", 87672.0), "€3,500 to €4,250/mo": ("month", None), "5,000 CAD yearly": ("year", None), "TBD": (None, None), "": (None, None), None: (None, None),
    }
    rows = list(want)
    spark.createDataFrame(list(enumerate(rows)), "job_id int, salary string").write.parquet(f"{tmp_path}/jobs.parquet")
    units = [("hour", 2080.0), ("day", 260.0), ("week", 52.0), ("biweek", 26.0), ("month", 12.0), ("year", 1.0)]
    spark.createDataFrame(units, "unit string, per_year double").write.parquet(f"{tmp_path}/pay_units.parquet")
    got = {rows[r.job_id]: (r.unit, r.annual_maximum) for r in registry.queries()["annual_maxima_of_all"](spark, str(tmp_path)).collect()}
    assert got == want
