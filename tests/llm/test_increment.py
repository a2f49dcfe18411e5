import random
import re

import pytest

from quernwork.llm import increment as I
from quernwork.session import shared_dir, stored

PLACES = "place_id int, place_name string, province_code string, province string, alt_name string"
POST = "ingest_seq long, source string, source_id string, title string, company string, location string, city string, description string, content_hash string, first string"


def text(n, words=60):
    r = random.Random(n)
    return " ".join(r.choice("abcdefghij") + str(r.randrange(50)) for _ in range(words))


def changed(t, at):
    w = t.split()
    w[at] = "zz"
    return " ".join(w)


def test_ids(spark):
    df = spark.createDataFrame(
        [(1, "indeed", "in-56b2fce8c25f646f"), (2, "Indeed ", "https://indeed.invalid/viewjob?jk=56b2fce8c25f646f"), (3, "indeed", " IN_56b2fce8c25f646f"), (4, "indeed", "56b2fce8c25f646f"), (5, "lever", "b:7"), (6, "lever", "B%3A7 "), (7, "lever", "https://b.lever.invalid/jobs/7"), (8, "lever", "b/7"), (9, "lever", "b: 7"), (10, "x", None), (11, None, "7"), (12, "x", " ")],
        "n int, source string, source_id string",
    )
    got = {r.n: r.id for r in I.with_id_key(df, "source", "source_id").collect()}
    assert len({got[n] for n in (1, 2, 3, 4)}) == 1 and len({got[n] for n in (5, 6, 7, 8, 9)}) == 1 and got[1] != got[5]
    assert got[10] is None and got[11] is None and got[12] is None


def test_repeats(spark):
    places = spark.createDataFrame([(1, "Nordbury", "ON", "Ontario", None)], PLACES)
    job = ("j", "Kiln Clerk", "Foo Foods", "Nordbury, ON", "", text(1), "h1")
    jobs = spark.createDataFrame([job, ("n", None, None, None, None, None, None)], "job_id string, title string, company string, location string, city string, description string, content_hash string")
    links = spark.createDataFrame([("lever", "b:1", None, None, None), ("lever", None, "{bad", None, None)], "source string, source_id string, raw string, job_id string, first_seen timestamp_ntz")
    base = ("Kiln Clerk", "Foo Foods", "Nordbury")
    rows = [
        (1, "lever", "B/1", None, None, None, None, None, None),  # a known id
        (2, "ashby", "b:1", None, None, None, None, None, ""),  # the same id at another source
        (3, "x", "3", None, None, None, None, None, "h1"),  # a known hash
        (4, "x", "4", "CLERK, KILN", "The Foo Food Ltd", "", "Nordbury", f"<p>{changed(text(1), 20)}</p>", "h4"),  # the same opening
        (5, "x", "5", *base, "", text(2), "h5"),  # another description
        (6, "x", "6", *base, "", changed(text(2), 3), "h6"),  # near to an earlier posting
        (7, "x", "7", "Kiln Clerk II", "Foo Foods", "Nordbury", "", text(1), "h7"),  # another title
        (8, "x", "7", *base, "", "TBD", "h8"),  # an earlier id
        (9, "x", "9", *base, "", "TBD", "h9"),  # placeholders are no description
    ]
    posts = spark.createDataFrame([(*r, "clash") for r in rows], POST)
    assert sorted(r[0] for r in I.repeats(posts, jobs, links, places, f"{shared_dir(spark)}/cells-1", 2).collect()) == [1, 3, 4, 6, 8]
    assert I.repeats(posts.limit(0), jobs, links, places, f"{shared_dir(spark)}/cells-2", 1).count() == 0
    none = sorted(r[0] for r in I.repeats(posts, jobs.limit(0), links.limit(0), places.limit(0), f"{shared_dir(spark)}/cells-3", 1).collect())
    assert 6 in none and 8 in none and 1 not in none


def test_a_stored_index_needs_no_source_table(spark):
    """A later session checks a batch with the index alone, reads only the buckets that the batch falls into, and finds the same rows."""
    places = spark.createDataFrame([(1, "Nordbury", "ON", "Ontario", None)], PLACES)
    fields = "title string, company string, location string, city string, description string, content_hash string"
    jobs = spark.createDataFrame([(f"j{n}", "Kiln Clerk", f"Brand{'abcdefghij'[n % 10]}{'klmnopqrst'[n // 10]} Foods", "Nordbury", "", text(n), f"h{n}") for n in range(100)], "job_id string, " + fields)
    links = spark.createDataFrame([("lever", f"b:{n}", None, None, None) for n in range(50)], "source string, source_id string, raw string, job_id string, first_seen timestamp_ntz")
    post = lambda n, i, k, t: (n, "lever", i, "Kiln Clerk", f"Brand{k} Foods", "Nordbury", "", t, f"p{n}", "x")
    posts = [post(1, "b:3", "zz", text(900)), post(2, "n:1", "ck", changed(text(2), 9)), post(3, "n:2", "zz", changed(text(900), 5)), post(4, "N:1 ", "xx", text(901))]
    df = spark.createDataFrame(posts, POST)
    path = f"{shared_dir(spark)}/cells-kept"
    first = I.History.create(spark, path, places, jobs, links)
    assert [r[0] for r in first.deliver(df.filter("ingest_seq = 1")).collect()] == [1]
    later = I.History.open(spark, path, places, deliveries=2)
    batch = df.filter("ingest_seq = 2")
    cells = later.index.read("cells", "opening", later._points(batch.withColumnRenamed("ingest_seq", "ref")).select("opening"))
    plan = cells._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[.*bucket#\d+ = \d+", plan)  # one bucket of all
    assert [r[0] for r in later.deliver(batch).collect()] == [2]
    assert sorted(r[0] for r in later.deliver(df.filter("ingest_seq > 2")).collect()) == [3, 4]


def test_batches_equal_one_pass_and_brute_force(spark, monkeypatch):
    """Probing and appending batch by batch finds what one pass over all batches finds, and what comparing all pairs finds; crowded cells lose nothing."""
    places = spark.createDataFrame([(1, "Nordbury", "ON", "Ontario", None)], PLACES)
    rnd = random.Random(2)
    rows = []
    for n in range(120):
        t = text(rnd.randrange(12), 40)
        for _ in range(rnd.randrange(4)):
            t = changed(t, rnd.randrange(40))
        rows.append((n, "Kiln Clerk", f"Foo{rnd.choice('ab')} Foods", "Nordbury", "", t))
    df = spark.createDataFrame(rows, "ref long, title string, company string, location string, city string, description string")
    pts = I.points(df, places)
    brute = set()
    sh = [(r[2], I.shingles_of(I.words_of(r[5]))) for r in rows]
    for i, (c, s) in enumerate(sh):
        if any(c == d and len(s & t) >= I.SIMILAR * len(s | t) for d, t in sh[:i]):
            brute.add(i)
    for crowded in (64, 3):
        monkeypatch.setattr(I, "CROWDED", crowded)
        near = I.CellIndex(spark, f"{shared_dir(spark)}/cells-w{crowded}").probe(I._distinct(pts))
        assert {r.ref for r in pts.join(near, ["opening", "text_hash"]).filter("first < ref").collect()} == brute
        step = I.CellIndex(spark, f"{shared_dir(spark)}/cells-s{crowded}", 8)
        found = set()
        for k in range(3):
            batch = I._distinct(pts.filter(f"ref between {40 * k} and {40 * k + 39}"))
            hit = step.probe(batch)
            found |= {r.ref for r in pts.filter(f"ref between {40 * k} and {40 * k + 39}").join(hit, ["opening", "text_hash"]).filter("first < ref").collect()}
            step.append(pts.filter(f"ref between {40 * k} and {40 * k + 39}"))
        assert found == brute


@pytest.mark.parametrize("crowded", [64, 3])
def test_a_probe_asks_the_driver_little(spark, monkeypatch, crowded):
    """A probe runs five queries, each of which leaves its plan and its threads to the driver; it finds the same whether tables are sent to the rows or met by a shuffle."""
    monkeypatch.setattr(I, "CROWDED", crowded)
    places = spark.createDataFrame([(1, "Nordbury", "ON", "Ontario", None)], PLACES)
    rows = [(n, "Kiln Clerk", "Foo Foods", "Nordbury", "", changed(text(n % 7, 40), n % 3)) for n in range(30)]
    pts = I.points(spark.createDataFrame(rows, "ref long, title string, company string, location string, city string, description string"), places)
    old, new = stored(pts.filter("ref < 15"), "old"), stored(I._distinct(pts.filter("ref >= 15")), "new")
    queries = spark._jsparkSession.sharedState().statusStore()
    got = []
    for most in (200_000, 0):
        monkeypatch.setattr(I, "MOST_BROADCAST", most)
        index = I.CellIndex(spark, f"{shared_dir(spark)}/cells-q{crowded}-{most}")
        index.append(old)
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        before = queries.executionsCount()
        near = index.probe(new)
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        assert queries.executionsCount() - before <= 5
        got.append({tuple(r) for r in near.collect()})
    assert got[0] == got[1] and len(got[0]) == new.count() and {r[2] for r in got[0]} <= set(range(15))


def test_similar_sets_share_a_prefix():
    rnd = random.Random(5)
    for _ in range(300):
        a = [rnd.choice("abcdefgh") + str(rnd.randrange(30)) for _ in range(rnd.randrange(5, 80))]
        b = list(a)
        for _ in range(rnd.randrange(3)):
            b[rnd.randrange(len(b))] = "q" + str(rnd.randrange(99))
        sa, sb = I.shingles_of(a), I.shingles_of(b)
        ha, hb = I.shingle_hashes(a), I.shingle_hashes(b)
        assert len(ha) == len(sa) and len(set(ha) & set(hb)) == len(sa & sb)
        if len(sa & sb) >= I.SIMILAR * len(sa | sb):
            assert set(I.prefix_of(ha)) & set(I.prefix_of(hb))


def test_long_tags_are_markup():
    assert I.words_of(f"<a title='{'x ' * 200}'>one</a> 3 < 4 and 5 > 2") == ["one", "3", "4", "and", "5", "2"]


def test_reach_is_a_bound():
    rnd = random.Random(4)
    for _ in range(300):
        a = [rnd.choice("abcdefgh") + str(rnd.randrange(9)) for _ in range(rnd.randrange(8, 60))]
        b = list(a)
        for _ in range(rnd.randrange(3)):
            b[rnd.randrange(len(b))] = "q" + str(rnd.randrange(99))
        sa, sb = I.shingles_of(a), I.shingles_of(b)
        if len(sa & sb) >= I.SIMILAR * len(sa | sb):
            assert len(set(a) ^ set(b)) <= I.reach(len(a))
