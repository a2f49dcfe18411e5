"""Set-based operators against sequential models."""

import datetime as dt
import random

from conftest import rows
from pyspark.sql import functions as F

from quernwork.operators import closure as C, incremental as I, resolve as R, review as V

T0 = dt.datetime(2025, 1, 1)


def day(n, seconds=0):
    return T0 + dt.timedelta(days=n, seconds=seconds)


def ts(x):
    return F.lit(x).cast("timestamp_ntz")


def sequential(sightings):
    """One entity at a time, one sighting after the other."""
    store = {}
    for s in sorted(sightings, key=lambda s: s["seq"]):
        e = store.get(s["entity_id"])
        v = {k: s[k] or "" for k in [*R.MATERIAL, "url"]}
        if e is None:
            store[s["entity_id"]] = {"primary_source": s["source"], **v, "posted_date": s["posted_date"]}
            continue
        mine = s["source"] == e["primary_source"]
        if mine:
            e["title"], e["city"] = v["title"], v["city"]
            for k in ("company", "location"):
                if v[k].strip():
                    e[k] = v[k]
        for k in ("description", "salary", "job_type"):
            if v[k].strip() and (mine or not e[k].strip()):
                e[k] = v[k]
        e["posted_date"] = e["posted_date"] or s["posted_date"]
    return store


def test_survivorship_matches_sequential_model(spark):
    rnd = random.Random(7)
    value = lambda: rnd.choice(["", "a", "b", None])
    data = [{"entity_id": f"e{rnd.randrange(40)}", "source": rnd.choice("xyz"), "seq": n, **{k: value() for k in [*R.MATERIAL, "url"]}, "posted_date": rnd.choice([None, dt.date(2025, 1, 1 + n % 9)])} for n in range(400)]
    schema = "entity_id string, source string, seq int, " + ", ".join(f"{k} string" for k in [*R.MATERIAL, "url"]) + ", posted_date date"
    got = {r.entity_id: r.asDict() for r in R.survive(spark.createDataFrame([tuple(d[c.split()[0]] for c in schema.split(", ")) for d in data], schema)).collect()}
    want = sequential(data)
    assert got.keys() == want.keys()
    for k, e in want.items():
        assert {c: got[k][c] for c in e} == {c: ("" if v is None and c != "posted_date" else v) for c, v in e.items()}, k


def test_survive_empty(spark):
    schema = "entity_id string, source string, seq int, " + ", ".join(f"{k} string" for k in [*R.MATERIAL, "url"]) + ", posted_date date"
    assert R.survive(spark.createDataFrame([], schema)).count() == 0


def test_identity(spark):
    p = spark.createDataFrame(
        [(1, "a", "a1", "Clerk", "Foo Inc", "X"), (2, "b", "b1", "CLERK", "Foo", "x"), (3, "a", "a2", "clerk", "Foo Ltd", "X"), (4, "a", "a9", None, None, None), (5, "c", "c1", "Clerk", "Foo", "X")],
        "seq int, source string, source_id string, title string, company string, city string",
    )
    links = spark.createDataFrame([("a", "a9", "known"), ("z", "z", None)], "source string, source_id string, entity_id string")
    got = {r.source_id: r.entity_id for r in R.resolve_identity(p, links).collect()}
    assert got["a1"] == got["b1"] == got["c1"] != got["a2"]
    assert got["a9"] == "known"
    held = spark.createDataFrame([("c", "old", got["a1"])], "source string, source_id string, entity_id string")
    again = {r.source_id: r.entity_id for r in R.resolve_identity(p, held).collect()}
    assert again["c1"] != again["a1"] == got["a1"]


def test_first_and_latest_wins(spark):
    df = spark.createDataFrame([("k", 2, None), ("k", 1, "x"), ("k", 3, "z"), ("k", 3, "z"), (None, 1, "n")], "k string, seq int, v string")
    assert rows(R.first_wins(df, ["k"], ["seq"])) == [(None, 1, "n"), ("k", 1, "x")]
    assert rows(R.latest_wins(df, ["k"], ["seq"])) == [(None, 1, "n"), ("k", 3, "z")]


def test_change_labels(spark):
    cols = "id string, " + ", ".join(f"{c} string" for c in R.MATERIAL)
    new = spark.createDataFrame([("n", *"abcdefg"), ("s", *"abcdef", None), ("c", *"abcdefx")], cols)
    old = spark.createDataFrame([("s", *"abcdef", ""), ("c", *"abcdefg")], cols)
    assert rows(R.change_labels(new, old, "id")) == [("c", "changed"), ("n", "new"), ("s", "seen")]


def test_merge_links(spark):
    old = spark.createDataFrame([("a", "1", "u", "r", "p", day(0), day(1), day(2)), ("b", "1", "u", "r", None, day(0), day(1), day(2))], "source string, source_id string, url string, raw string, apply_url string, first_seen timestamp_ntz, last_seen timestamp_ntz, gone_at timestamp_ntz")
    new = spark.createDataFrame([("a", "1", "v", "s", "", 2, True, True, day(5)), ("b", "1", "w", "t", "q", 1, False, True, day(6)), ("c", "1", "x", "y", "", 1, True, False, day(7))], "source string, source_id string, url string, raw string, apply_url string, seq int, seen boolean, full_listing boolean, seen_at timestamp_ntz")
    got = {r.source: r for r in R.merge_links(old, new).collect()}
    assert (got["a"].url, got["a"].apply_url, got["a"].last_seen, got["a"].gone_at) == ("v", "p", day(5), None)
    assert (got["b"].url, got["b"].apply_url, got["b"].last_seen, got["b"].gone_at) == ("w", "q", day(1), day(2))
    assert (got["c"].first_seen, got["c"].last_seen) == (day(7), day(7))


def test_prune_boundary(spark):
    df = spark.createDataFrame([("in", day(0)), ("out", day(0, -1))], "k string, last_seen timestamp_ntz")
    assert [r.k for r in R.prune(df, ts(day(60))).collect()] == ["in"]


def test_reopen_boundary(spark):
    df = spark.createDataFrame([(1, True, day(0), True, False, day(7)), (2, True, day(0), True, False, day(7, -1)), (3, True, day(0), False, False, day(1)), (4, False, day(0), False, True, day(9)), (5, True, day(0), True, True, day(1)), (6, True, None, False, False, day(1))], "id int, seen boolean, closed timestamp_ntz, emp boolean, full boolean, n timestamp_ntz")
    got = {r.id: r.o for r in df.select("id", R.reopened(*[F.col(c) for c in ("seen", "closed", "emp", "full", "n")]).alias("o")).collect()}
    assert got == {1: True, 2: False, 3: True, 4: False, 5: True, 6: False}


def test_rejected_history(spark):
    s = "source string, source_id string, reason string, first_seen timestamp_ntz, last_seen timestamp_ntz"
    old = spark.createDataFrame([("a", "1", "title", day(0), day(1)), ("a", "2", "title", day(0), day(1))], s)
    new = spark.createDataFrame([("a", "1", "location", 1, False, day(9)), ("a", "3", "title", 2, True, day(3))], "source string, source_id string, reason string, seq int, seen boolean, seen_at timestamp_ntz")
    ok = spark.createDataFrame([("a", "2")], "source string, source_id string")
    assert rows(R.merge_rejected(old, new, ok)) == [("a", "1", "location", day(0), day(1)), ("a", "3", "title", day(3), day(3))]


def fold(answers, long_unseen):
    """The answers of one job one after the other."""
    asked = [a for a in answers if a[0] != "glassdoor"]
    result = "gone" if not asked and long_unseen else "unknown"
    closed = False
    for source, answer, hosted, dropped in asked:
        employer = source in C.CLASSES["employer"]
        answer = "gone" if answer == "unknown" and dropped and source == "ashby" else answer
        if employer and answer == "unknown":
            continue
        result = answer
        if employer:
            closed = answer == "gone"
            break
        if answer != "gone" or hosted:
            break
    return result, closed


def test_closure_fold_matches_sequential_model(spark):
    rnd = random.Random(3)
    data, want = [], {}
    for j in range(300):
        pick = lambda: (rnd.choice(["ashby", "oracle", "indeed", "linkedin", "glassdoor"]), rnd.choice(["gone", "alive", "unknown"]), rnd.random() < 0.3, rnd.random() < 0.3)
        answers = sorted((pick() for _ in range(rnd.randrange(1, 5))), key=lambda a: a[0] not in C.CLASSES["employer"])
        unseen = [rnd.random() < 0.7 for _ in answers]
        data += [(f"j{j}", n, *a, u) for n, (a, u) in enumerate(zip(answers, unseen, strict=True))]
        want[f"j{j}"] = fold(answers, all(unseen))
    df = spark.createDataFrame(data, "job_id string, rank int, source string, answer string, hosted boolean, dropped boolean, long_unseen boolean")
    got = {r.job_id: (r.result, r.closed_by_employer) for r in C.fold_answers(df).collect()}
    assert got == want


def test_backoff_and_due(spark):
    df = spark.createDataFrame([(n,) for n in (None, 0, 1, 2, 3, 4, 70)], "s int")
    assert [r[0] for r in df.select(C.backoff_days(F.col("s"))).collect()] == [1, 1, 1, 2, 4, 4, 4]


def test_budget(spark):
    rnd = random.Random(5)
    data = [(n, rnd.randrange(4), rnd.randrange(5)) for n in range(200)]
    df = spark.createDataFrame(data, "id int, d int, cost int")
    want, total = set(), 0
    for n, _, c in sorted(data, key=lambda r: (r[1], r[0])):
        total += c
        if total <= 90:
            want.add((n, total))
    assert {(r.id, r.spent) for r in C.within_budget(df, "cost", [F.col("id")], 90, "d").collect()} == want


def test_best_url(spark):
    e = spark.createDataFrame([("1", "own"), ("2", "own"), ("3", "own"), ("4", "own"), ("5", "own")], "job_id string, url string")
    s = "job_id string, source string, source_id string, url string, apply_url string, first_seen timestamp_ntz, gone_at timestamp_ntz"
    links = spark.createDataFrame(
        [("1", "indeed", "1", "i", None, day(0), None), ("1", "lever", "1", "l", "ap", day(1), None), ("2", "lever", "1", "l", " ", day(0), day(1)), ("2", "indeed", "1", "i", "ap", day(1), day(2)), ("3", "indeed", "1", "i", None, day(0), None), ("3", "linkedin", "2", "own", None, day(1), None), ("4", "glassdoor", "1", "g", None, day(0), None), ("4", "indeed", "1", "i", "", day(1), None)],
        s,
    )
    assert rows(C.best_url(e, links)) == [("1", "l"), ("2", "ap"), ("3", "own"), ("4", "i"), ("5", "own")]


def test_absence_needs_a_live_board(spark):
    s = "source string, source_id string, board string, last_seen timestamp_ntz"
    links = spark.createDataFrame([("ashby", "b:1", "b", day(0)), ("ashby", "b:2", "b", day(9)), ("ashby", "c:1", "c", day(0)), ("indeed", "b:1", "b", day(0)), ("ashby", "x", None, day(0)), ("lever", "b:1", "b", day(0)), ("lever", "b:2", "b", day(9))], s)
    assert rows(C.dropped_from_listing(links, ts(day(10)))) == [("ashby", "b:1")]


def test_fingerprint_is_of_the_set(spark):
    cols = ["job_id", *V.INPUTS]
    a = spark.createDataFrame([("1", "t", "c", "l", "y", "d", "s", "j"), ("2", "t", "c", "l", "y", "e", None, "j")], ", ".join(f"{c} string" for c in cols))
    one, two = V.fingerprints(a).collect()[0], V.fingerprints(a.orderBy(F.desc("job_id"))).collect()[0]
    assert one == two and one.members == 2
    assert V.fingerprints(a.filter("job_id = '1'")).collect()[0].fingerprint != one.fingerprint


def test_lookback(spark):
    df = spark.createDataFrame([(None, day(1)), (day(0), day(0, 3601)), (day(0), day(10))], "a timestamp_ntz, b timestamp_ntz")
    assert [r[0] for r in df.select(I.lookback_hours(F.col("a"), F.col("b"), 72)).collect()] == [None, 72, 242]
    assert df.select(I.or_query(F.array(F.lit("a"), F.lit("b c")))).first()[0] == 'a OR "b c"' and I.rotation(["x", "y"], 3) == "y"


def test_replay_order(spark):
    df = spark.createDataFrame([(2, "b"), (1, "z"), (1, "a"), (None, "n")], "d int, k string")
    assert [r.k for r in R.replay(df, ["d", "k"]).orderBy("seq").collect()] == ["n", "a", "z", "b"]
