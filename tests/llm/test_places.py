import pytest
from hypothesis import given, settings, strategies as st

from quernwork.llm import places as P

ROWS = [(1, "Tambmoor Bay", "SK", "Saskatchewan", None), (2, "Saint-Gédéon", "QC", "Québec", "St-Gédéon"), (3, "Keskmere", "QC", "Québec", None), (4, "Keskmere", "NS", "Nova Scotia", None), (5, "Varnaby", "BC", "British Columbia", None), (6, "Upper Varnaby", "BC", "British Columbia", None), (7, "Yarlbury", "ON", "Ontario", "Old Yarlbury Landing")]


@pytest.mark.parametrize(
    ("location", "city", "want"),
    [
        ("Tambmoor Bay, SK", "", [1]), ("TAMBMOOR BAY SK", None, [1]), ("tambmoor bay,sk", "", [1]), ("CA-SK-Tambmoor Bay", "", [1]), ("Tambmoor Bay L0E 4G4, Canada", "", [1]), ("Tambmor Bay", "", [1]), ("Tmabmoor Bay", "", [1]),
        ("Saint-GÃ©dÃ©on", "", [2]), ("St-Gedeon", "", [2]), ("Saint-eGédéon", "", [2]), ("Keskmere", "Keskmere, NS", [4]), ("Keskmere", "KESKMERE QC", [3]), ("Keskmere, Nova Scotia", "", [4]), ("Keskmere", "", [3, 4]),
        ("Upper Varnaby, BC", "", [6]), ("Varnaby", "", [5]), ("Varnaby, BC | Yarlbury, ON", "", [5, 7]), ("Old Yarlbury Landing", "", [7]), ("496 Varnaby Road, Yarlbury, ON", "Yarlbury", [7]), ("12 Mill Rd, Yarlbury ON", "", [7]),
        ("Yarlbury, OH, USA", "", []), ("Yarlbury, England, United Kingdom", "Yarlbury", []), ("Varnaby, AB", "", []), ("Remote", "", []), ("On-site: Yarlbury", "", [7]), ("Plant 4 | Yarlbury, ON", "", [7]), ("ON", "", []), ("???", "", []), ("", "Yarlbury", [7]), (None, "Yarlbury", [7]), (None, None, []), ("  ", "", []),
    ],
)
def test_resolve(location, city, want):
    assert P.PlaceResolver(ROWS).resolve(location, city) == want


words = st.text(alphabet="abc", max_size=6)


@settings(max_examples=300, deadline=None)
@given(words, words, words)
def test_distance_is_a_metric(a, b, c):
    d = P.edit_distance
    assert d(a, b) == d(b, a) and (d(a, b) == 0) == (a == b) and d(a, c) <= d(a, b) + d(b, c)


@settings(max_examples=150, deadline=None)
@given(st.lists(words, max_size=12), words, st.integers(0, 3))
def test_tree_returns_every_entry(entries, q, r):
    tree = P.EntryTree([(e, None) for e in entries])
    assert tree.within(q, r) == sorted({(d, e) for e in entries if (d := P.edit_distance(q, e)) <= r})


def test_match_within_and_shards(spark, monkeypatch):
    refs = spark.createDataFrame([(1, "alpha"), (2, "alpah"), (3, None), (4, ""), (1, "alpha")], "id int, name string")
    vals = spark.createDataFrame([("Alpha",), ("alphaa",), (None,), ("zzz",), ("Alpha",), ("",)], "value string")
    want = {("Alpha", 1, 0), ("Alpha", 2, 1), ("alphaa", 1, 1), (None, None, None), ("zzz", None, None), ("", None, None)}
    assert {tuple(r) for r in P.match_within(vals, "value", refs, "id", "name").collect()} == want
    monkeypatch.setattr(P, "TREE_ENTRIES", 1)
    assert {tuple(r) for r in P.match_within(vals, "value", refs, "id", "name").collect()} == want


def test_a_list_in_shards_resolves_alike(spark, sf, monkeypatch):
    """A list beyond one tree gives every entry the places that a broadcast one gives."""
    places = spark.read.parquet(f"{sf}/places.parquet")
    jobs = spark.read.parquet(f"{sf}/jobs.parquet").select("job_id", "location", "city")
    one = {r.job_id: r.place_ids for r in P.resolve_places(jobs, ["job_id"], "location", "city", places).collect()}
    monkeypatch.setattr(P, "TREE_ENTRIES", 60)
    monkeypatch.setattr(P, "TASK_VALUES", 500)
    assert {r.job_id: r.place_ids for r in P.resolve_places(jobs, ["job_id"], "location", "city", places).collect()} == one


def test_empty(spark, sf):
    jobs = spark.createDataFrame([], "job_id string, location string, city string, place_ids string")
    places = spark.read.parquet(f"{sf}/places.parquet")
    assert P.resolve_places(jobs, ["job_id"], "location", "city", places).count() == 0
    some = spark.createDataFrame([("a", "Nowhere", None), ("a", "Nowhere", None)], "job_id string, location string, city string")
    assert [r.place_ids for r in P.resolve_places(some, ["job_id"], "location", "city", places.limit(0)).collect()] == [[], []]
