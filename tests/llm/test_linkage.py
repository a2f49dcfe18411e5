import numpy as np

from quernwork.llm import linkage as L, openings as O
from quernwork.llm.places import edit_distance

PLACES = "place_id int, place_name string, province_code string, province string, alt_name string"


def places(spark):
    return spark.createDataFrame([(1, "Nordbury", "ON", "Ontario", None), (2, "Tambmere", "QC", "Québec", None)], PLACES)


def spelt_right(counts, w, least=4):
    """What corrections() makes of a word, by looking at every known word."""
    if len(w) < least or any(ch.isdigit() for ch in w):
        return w
    wanted = counts[w] * O.OVERWHELMING if w in counts else 3
    near = [x for x in counts if x != w and counts[x] >= wanted and edit_distance(w, x) == 1]
    alike = [x for x in near if len(x) != len(w) or sorted(x) == sorted(w)]
    return max(alike or near, key=lambda x: (counts[x], x), default=w)


def test_forms():
    s = O.Corrections({"orbobruy": "orbobury"})
    same = {O.company_key(x, s) for x in ["Orbobury Foods", "The ORBOBURY Food Inc.", "5137571 Canada d/b/a Orbobruy Foods Corp.", "Orbobury Foods Ltée - Careers", "Orbobury Foods Limited (Canada)"]}
    assert same == {"orbobury foods"} and O.company_key(None, s) == ""
    t = O.Corrections({"supevrisor": "supervisor"})
    forms = {O.title_parts(x, t) for x in ["Junior Kiln Supervisor II (Client K-00006923)", "SUPV. 2, KILN - JR. [K00006923]", "jr kiln supevrisor - level 2 - client K-00006923 - URGENT (M/F/X)", "Supervisor II, Kiln - Junior (Client K00006923) #R-1628"]}
    assert forms == {("kiln supervisor", "junior", "2", "6923")} and O.title_parts(None, t) == ("", "", "", "")


def test_slips_of_titles_at_any_size(spark):
    """A word of four rows is known, and its misspellings are put right, among any number of other rows."""
    jobs = spark.range(50_000).selectExpr("'Mill Hand' as title").unionByName(spark.createDataFrame([("Kiln Clerk",)] * 4, "title string"))
    asked = spark.createDataFrame([("Kilnn Clerk",), ("Mill Hand",), (None,)], "title string")
    named = lambda d: d.selectExpr("title", "cast(null as string) as company")
    got = O.slips([named(asked)], O.word_counts(named(jobs))).collect()
    assert [(r.column, r.name, [(f.w, f.right) for f in r.fixes]) for r in got] == [("title", "Kilnn Clerk", [("kilnn", "kiln")])]


def test_vote_model_learns_accuracies_and_correlations():
    rng = np.random.default_rng(1)
    n = 20_000
    y = rng.random(n) < 0.1
    accuracy = [0.95, 0.9, 0.85, 0.6]
    votes = np.stack([np.where(rng.random(n) < a, y, ~y) for a in accuracy], 1)
    votes = np.concatenate([votes, votes[:, 3:4], votes[:, 3:4]], 1) * 2 - 1  # the weak function three times: it must not win
    x, counts = np.unique(votes, axis=0, return_counts=True)
    m = L.VoteModel(x, counts)
    p = m.posterior(votes) >= 0.5
    assert (p == y).mean() > 0.97


def test_link_openings(spark):
    jobs = spark.createDataFrame(
        [("a", "Kiln Clerk II", "Foo Foods Inc", "Nordbury, ON", "", "clash"), ("b", "Kiln Clerk", "Foo Foods Inc", "Nordbury, ON", "", ""), ("c", None, None, None, None, None), ("d", "Kiln Clerk II", "Foo Foods Inc", "Nordbury", "", ""), ("e", "Kiln Clerk II", "Foo Seeds", "Nordbury", "", "")],
        "job_id string, title string, company string, location string, city string, confidence string",
    )
    links = spark.createDataFrame(
        [("s", "1", "CLERK 2, KILN", "The Foo Food Ltd", "", "Nordbury"), ("s", "1", "CLERK 2, KILN", "The Foo Food Ltd", "", "Nordbury"), ("t", "2", "Kiln Clerk 2", "Foo Foods", "Nordbury, ON, CA", ""), ("s", "3", None, None, None, None), ("s", "4", "Kiln Clerk II", "Foo Foods", "Tambmere", "")],
        "source string, source_id string, title string, company string, location string, city string",
    )
    assigned = spark.createDataFrame([("T ", "a"), ("t", "d")], "source string, job_id string")
    got = sorted((r.source, r.source_id, r.job_id) for r in L.link_openings(links, jobs, places(spark), assigned).collect())
    assert got == [("s", "1", "a")]
    assert L.link_openings(links.limit(0), jobs, places(spark), assigned).count() == 0
    assert L.link_openings(links, jobs.limit(0), places(spark), assigned).count() == 0


def test_rare_employers_stay_references(spark):
    """A brand of five rows puts its misspellings right, however many rows others have."""
    many = spark.range(120_000).selectExpr("concat('j', id) as job_id", "'Mill Hand' as title", "'Zamorrin Mills' as company", "'Nordbury' as location", "'' as city")
    few = spark.createDataFrame([(f"f{n}", "Kiln Clerk", "Orbobury Foods", "Nordbury", "") for n in range(5)], "job_id string, title string, company string, location string, city string")
    links = spark.createDataFrame([("s", "1", "Kiln Clerk", "Orbobruy Foods", "Nordbury", ""), ("s", "2", "Kiln Clerk", None, "Nordbury", "")], "source string, source_id string, title string, company string, location string, city string")
    got = L.link_openings(links, many.unionByName(few), places(spark), spark.createDataFrame([], "source string, job_id string")).collect()
    assert [(r.source_id, r.job_id) for r in got] == [("1", "f0")]


def test_corrections_equal_brute_force(spark):
    """The join finds what looking up every word finds."""
    counts = {"kalumpell": 200, "kalupell": 15, "tarrowick": 900, "tarrowikc": 5, "orbobury": 4, "orbobory": 9, "foods": 80, "food": 300}
    words = [*counts, "kalummpell", "orboburi", "orbobruy", "tarrowic", "zzzz", "fods", "foo", "fo0ds", "tarowick", "orbobry"]
    got = {r.w: r.right for r in O.corrections(spark.createDataFrame([("company", *x) for x in counts.items()], "column string, w string, count bigint"), spark.createDataFrame([("company", w) for w in words], "column string, w string")).collect()}
    assert got == {w: r for w in words if (r := spelt_right(counts, w)) != w} and got["orbobruy"] == "orbobury" and got["tarrowikc"] == "tarrowick" and "kalupell" not in got


def openings(spark, rows):
    cols = ["company_key", "title_words", "seniority", "grade", "client", "place_key"]
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in cols))


def test_the_model_decides(spark):
    """No rule stands behind the model: another grade or rank is turned down against six votes for, which a count of votes would let through."""
    jobs = [(f"brand{n} foods", f"clerk kiln{n % 7}", r, g, "", str(n % 5)) for n in range(60) for r in ("", "junior") for g in ("1", "2")]
    links = [j for j in jobs if j[2] == "" or j[3] == "1"]
    got = L.scored_pairs(openings(spark, links), openings(spark, jobs)).toPandas()
    same = (got[[f"l_{c}" for c in O.OPENING]].to_numpy() == got[[f"r_{c}" for c in O.OPENING]].to_numpy()).all(1)
    assert same.sum() == len(links) and ((got["confidence"] >= L.ACCEPT) == same).all()
    counted = (got[L.VOTES] > 0).sum(1) > (got[L.VOTES] < 0).sum(1)
    assert (counted & ~same).sum() > 50


def test_brand_within_one_edit(spark):
    """A pair that the model accepts comes out though its brand, too rare for a reference word, differs by one letter; not where the spelling is another employer's or could be two."""
    jobs, links = [], []
    for n in range(40):
        jobs.append((f"m{n:02}", f"Kiln Clerk {'abcdefghijklmnopqrstuvwxyz'[n % 26] * 3}", f"Zamorrin{'abcdefgh'[n % 8] * 4} Mills", "Nordbury", ""))
        links.append(("s", f"m{n}", *jobs[-1][1:]))
    jobs += [("a", "Dryer Hand", "Orbobury Foods", "Nordbury", ""), ("b", "Mill Hand", "Tarrowick Seeds", "Nordbury", ""), ("c", "Mill Hand", "Tarrowock Seeds", "Tambmere", ""), ("d", "Dock Hand", "Velmora Foods", "Nordbury", ""), ("e", "Dock Hand", "Velmore Foods", "Nordbury", "")]
    links += [("s", "1", "Dryer Hand", "Orboburi Foods", "Nordbury", ""), ("s", "2", "Mill Hand", "Tarrowock Seeds", "Nordbury", ""), ("s", "3", "Dock Hand", "Velmoru Foods", "Nordbury", ""), ("s", "4", "Dryer Hand", "Orboburi Seeds", "Nordbury", "")]
    df = spark.createDataFrame(jobs, "job_id string, title string, company string, location string, city string")
    asked = spark.createDataFrame(links, "source string, source_id string, title string, company string, location string, city string")
    got = {r.source_id: r.job_id for r in L.link_openings(asked, df, places(spark), spark.createDataFrame([], "source string, job_id string")).collect()}
    assert {k: v for k, v in got.items() if k.isdigit()} == {"1": "a"}
