import pytest
from conftest import rows
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from quernwork.functions import jobtext as X
from quernwork.functions.text import blank_to_null, fold, fold_py, source_key
from quernwork.operators import predicates as P


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x"))).collect()[0][0]


@pytest.mark.parametrize(("s", "want"), [("Sainte-Évangél", "sainte-evangel"), ("ＡＢＣ", "abc"), ("a­b​c", "abc"), ("", ""), (None, None), ("é", "e")])
def test_fold(spark, s, want):
    assert one(spark, s, fold) == want
    assert fold_py(s) == (want or "")


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=60))
def test_fold_py_drops_marks(s):
    import unicodedata

    want = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c) and unicodedata.category(c) != "Cf").lower()
    assert all(ord(c) > 0xFFFF for c in set(want) ^ set(fold_py(s)))


@pytest.mark.parametrize(("s", "want"), [("  a \t b ", "a b"), ("NaN", ""), (None, ""), ("a\n b", "a\n b"), ("None", "")])
def test_clean(spark, s, want):
    assert one(spark, s, X.clean) == want


@pytest.mark.parametrize(("s", "want"), [("2025-03-01", "2025-03-01"), ("2025-03-01T10:00:00Z", "2025-03-01"), ("1735689600000", "2025-01-01"), ("-5", None), ("soon", None), (None, None), ("2025-02-30", None)])
def test_parse_date(spark, s, want):
    got = one(spark, s, X.parse_date)
    assert (str(got) if got else None) == want


@pytest.mark.parametrize(("s", "want"), [("The Orbobury Foods Inc.", "orbobury foods"), ("Ltée Ltd Co", ""), (None, ""), ("Société Générale ltée", "societe generale")])
def test_norm_company(spark, s, want):
    assert one(spark, s, X.norm_company) == want


def test_urls(spark):
    assert one(spark, "https://A.b.invalid/x", X.url_host) == "a.b.invalid"
    assert one(spark, "ftp://a.b", X.url_host) == "" and one(spark, None, X.url_host) == "" and one(spark, "https://a b", X.url_host) == ""
    assert one(spark, "https://x.indeed.invalid/a", X.external_url) == "" and one(spark, "https://notindeed.invalid/a", X.external_url) == "https://notindeed.invalid/a"
    assert one(spark, "https://a.b/?x=1&jid=77", X.posting_key) == "jid:77"


def test_strict_instant(spark):
    assert one(spark, "2025-01-01T00:00:00", X.strict_instant) is None
    assert one(spark, "2025-01-01T00:00:00+02:00", X.strict_instant) is not None and one(spark, "junkZ", X.strict_instant) is None


def test_format_pay(spark):
    df = spark.createDataFrame([(30.5, 33.25, "CAD", "hourly"), (40000.0, 40000.0, "CAD", "yearly"), (None, float("nan"), "CAD", "yearly")], "a double, b double, c string, u string")
    got = [r[0] for r in df.select(X.format_pay(F.col("a"), F.col("b"), F.col("c"), F.col("u"))).collect()]
    assert got == ["30.5 - 33.25 CAD hourly", "40,000 CAD yearly", ""]


@pytest.mark.parametrize(("top", "cur", "unit", "want"), [(30.0, "CAD", "hourly", 62400.0), (60000.0, "USD", "annual", 60000.0), (30.0, "CAD", None, 62400.0), (60000.0, "CAD", None, None), (60000.0, "EUR", "annual", None), (9000.0, "CAD", "annual", None)])
def test_annual_maximum(spark, top, cur, unit, want):
    df = spark.createDataFrame([(top, cur, unit)], "t double, c string, u string")
    assert df.select(X.annual_maximum(F.col("t"), F.col("c"), F.col("u"))).collect()[0][0] == want


def test_html_text():
    assert X.html_text_py("<p>A&amp;B</p><ul><li>one</li><li>two</li></ul><script>x</script>") == "A&B\n\n- one\n- two"
    assert X.html_text_py("&lt;p&gt;x&lt;/p&gt;") == "x" and X.html_text_py(None) == ""


def test_source_key_and_blank(spark):
    assert one(spark, " Job_Bank ", source_key) == "jobbank" and one(spark, None, source_key) is None
    assert one(spark, "   ", blank_to_null) is None and one(spark, " a", blank_to_null) == " a"


@pytest.mark.parametrize(
    ("location", "want"),
    [("Nordbury, ON", "Nordbury"), ("Keskmere; Tambmere", "Tambmere"), ("Nordbury, England, United Kingdom", None), ("Nordbury, ME", None), ("Nordbury, ME, Canada", "Nordbury"), ("Old Nordbury Landing", "Nordbury"), ("nördbury", "Nordbury"), ("Nordburyville", None), ("", None), (None, None)],
)
def test_city_match(spark, location, want):
    assert one(spark, location, lambda c: P.city_match(c, {"Nordbury": ["Old Nordbury Landing"], "Tambmere": [], "Keskmere": []})) == want


def test_keywords(spark):
    assert one(spark, "Senior Technician", lambda c: P.keyword_match(c, ["tech*"])) is True
    assert one(spark, "Biotech", lambda c: P.keyword_match(c, ["tech*"])) is False
    assert one(spark, "x", lambda c: P.keyword_match(c, [])) is False and one(spark, None, lambda c: P.keyword_match(c, ["x"])) is False
    exc = lambda c: P.keyword_excluded(c, ["kiln", "lead"], {"kiln": ["analyst"]})
    assert one(spark, "Kiln Analyst", exc) is False and one(spark, "Kiln Clerk", exc) is True and one(spark, "Lead Kiln Analyst", exc) is True


@pytest.mark.parametrize(("s", "want"), [("Tambmere, ON", True), ("Tambmere; Nordbury", False), ("", False), (None, False), ("Tambmere (ON) | Elmaby", True)])
def test_too_far(spark, s, want):
    assert one(spark, s, lambda c: P.too_far(c, ["Tambmere", "Elmaby"])) is want


@pytest.mark.parametrize(("s", "want"), [("Part-time", True), ("part time / full time", False), (None, False), ("", False)])
def test_part_time(spark, s, want):
    assert one(spark, s, P.part_time_only) is want


def test_route_empty(spark):
    df = spark.createDataFrame([], "source string, source_id string, title string, company string, location string, city string, job_type string")
    rules = {"cities": {"A": []}, "titles": ["x"], "title_exclusions": [], "companies": []}
    assert rows(P.route(df, rules, df)) == []
