import random

import pytest

from quernwork.llm import truncation as T

FULL = "We need a careful person for the cold store. The night crew checks every pallet twice a week.\n- Lifting up to 25 kg\n- Steady hands around the kiln"


@pytest.mark.parametrize(
    ("tail", "want"),
    [("&nbs", "cut"), ("&am", "cut"), (" R&D", "ask"), ("<br", "cut"), ("<li class=", "cut"), ("�", "cut"), (" [...]", "cut"), (" (more)", "cut"), (" [truncated]", "cut"), (" and,", "cut"), (" now.", "complete"), (' he said "no."', "complete"), (" and th", "ask"), (" and the...", "ask")],
)
def test_closing(tail, want):
    assert T.closing(FULL + tail)[0] == want


def test_no_description():
    assert [T.closing(x)[0] for x in (None, "", "  ", "TBD", "See posting for details")] == ["none"] * 5


def test_aligned_end():
    rest = " and walks to the loading dock before noon. Then the shift ends."
    long = FULL.replace("\n", " ") + rest
    assert T.aligned_end(long[:-12], long) == "cut"
    assert T.aligned_end(long[: long.index(" Then")], long) == "complete"
    assert T.aligned_end(long[: long.index(". Then")], long) is None  # the stop is missing: its own end has to say
    assert T.aligned_end("something else entirely that has nothing to do with the other text at all", long) is None
    assert T.aligned_end(long, long) is None and T.aligned_end("", long) is None


def test_frame(spark):
    rnd = random.Random(1)
    nouns, verbs = ["kiln", "dryer", "mill", "press", "dock", "scale"], ["checks", "cleans", "moves", "opens", "labels"]
    sentence = lambda: f"The {rnd.choice(nouns)} crew {rnd.choice(verbs)} the {rnd.choice(nouns)} and the {rnd.choice(nouns)} before the {rnd.choice(nouns)} opens."
    rows, cut = [], set()
    for n in range(400):
        body = " ".join(sentence() for _ in range(4)) + "\n- Rotating weeks in the " + rnd.choice(nouns)
        if n % 10 == 0:
            body, k = body[: rnd.randrange(130, 200)].rstrip(), cut.add(n)
            if body.endswith("."):
                cut.discard(n)
        rows.append((n, body, "clash"))
    rows += [(1000, None, ""), (1001, "", ""), (1002, "TBD", ""), (1003, rows[0][1], "")]
    got = {r[0] for r in T.truncated(spark.createDataFrame(rows, "id long, text string, sign string"), "id", "text").collect()}
    assert not got & {1000, 1001, 1002} and (1003 in got) == (0 in got)
    assert len(got & cut) >= 0.9 * len(cut) and len(got - cut - {1003}) <= 4
    assert T.truncated(spark.createDataFrame([], "id long, text string"), "id", "text").count() == 0


def test_counts_are_chunked_alike(spark, monkeypatch):
    """The judgments don't depend on how rows are spread over tasks."""
    rows = [(n, FULL + f" {n % 7} more words here{'.' if n % 2 else ''}") for n in range(60)]
    df = spark.createDataFrame(rows, "id long, text string")
    a = {tuple(r) for r in T.judged(df.repartition(1), "id", "text").collect()}
    monkeypatch.setattr(T, "COUNTED", 3)
    assert len(a) == 60 and a == {tuple(r) for r in T.judged(df.repartition(6), "id", "text").collect()}


def test_alignment_goes_before_the_own_end(spark):
    """A near copy settles a text, whatever its closing words are elsewhere; the others are judged by these."""
    rnd = random.Random(7)
    words = lambda n: " ".join("".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(n))
    long = f"{words(80)} and the crew walks home after the second bell"
    rows = [(1, long), (2, long[: long.index(" after")]), (3, f"{words(70)}.")]
    rows += [(10 + n, f"{words(60)}\n- and the crew walks home") for n in range(5)]
    got = {r.id: (r["by"], r.cut) for r in T.judged(spark.createDataFrame(rows, "id long, text string"), "id", "text").collect()}
    assert got[2] == ("alignment", True) and got[3] == ("end", False) and got[10] == ("closing words", False)


def test_no_evidence_is_no_cut(spark):
    """Unseen closing words are looked at with less before them; what the corpus doesn't know at all is not taken for cut. Short texts are judged like long ones."""
    rows = [(n, f"The crew number {n} likes experience") for n in range(6)] + [(10, "Wanted: zyx qrs tuv"), (11, "They want some exper"), (12, "N/A"), (13, " ")]
    got = {r.id: r.cut for r in T.judged(spark.createDataFrame(rows, "id long, text string"), "id", "text").collect()}
    assert got[0] is False and got[10] is False and got[11] is True and 12 not in got and 13 not in got


def test_bands_estimate_similarity():
    """Near copies share a band, unlike texts hardly ever do."""
    rnd = random.Random(3)
    words = lambda n: [rnd.choice("abcdefghijkl") + str(rnd.randrange(60)) for _ in range(n)]
    near = far = 0
    for _ in range(60):
        a = words(120)
        b = list(a)
        b[60] = "zz"
        half = a[:60] + words(60)
        near += bool(set(T.band_keys(T.shingle_hashes(a))) & set(T.band_keys(T.shingle_hashes(b))))
        far += bool(set(T.band_keys(T.shingle_hashes(a))) & set(T.band_keys(T.shingle_hashes(half))))
    assert near == 60 and far < 30


@pytest.mark.parametrize("variants", [5, 30])
def test_cuts_among_variants_of_a_template(spark, variants):
    """Many openings share a template and each has its own ending; a cut meets its own copy, not just the longest text."""
    rnd = random.Random(variants)
    word = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8))
    shared = " ".join(word() for _ in range(100))
    rows = []
    for n in range(variants):
        end = [word() for _ in range(rnd.randrange(6, 16))]
        rows += [(2 * n, f"{shared} {' '.join(end)}."), (2 * n + 1, f"{shared} {end[0][:5]}")]
    texts = T.distinct_texts(spark.createDataFrame(rows, "id long, text string"), "id", "text")
    got = {r.id for r in T.aligned_ends(T.text_facts(texts), texts).filter("end = 'cut'").collect()}
    brute = {i for i, s in rows for j, t in rows if i != j and T.aligned_end(s, t) == "cut"}
    assert got == brute == {n for n, _ in rows if n % 2}


@pytest.mark.parametrize("small", [0, 16, 1000])
def test_ends_do_not_depend_on_the_size_of_a_bucket(spark, monkeypatch, small):
    """Both verdicts are those of all pairs, in crowded buckets too: variants that are cut, and such that are complete though the closing words of a line go on elsewhere."""
    monkeypatch.setattr(T, "SMALL_BUCKET", small)
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8))
    words = lambda n: " ".join(word() for _ in range(n))
    rows = []
    for group in range(2):
        shared = words(100)
        for n in range(15 if group else 4):
            line, other, half, rest = words(3), words(3), words(3), words(rnd.randrange(3, 12))
            # with a longer copy each: whole lines, a line whose copy has a full stop there, and a cut one
            ends = [line, f"{line}\n- {rest}", other, f"{other}. {words(4)}", half[:-3], f"{half} {word()}"]
            rows += [(1000 * group + 10 * n + k, f"{shared}\n- {e}") for k, e in enumerate(ends)]
    texts = T.distinct_texts(spark.createDataFrame(rows, "id long, text string"), "id", "text")
    got = {r.id: r.end for r in T.aligned_ends(T.text_facts(texts), texts).collect()}
    brute = {}
    for i, s in rows:
        said = {T.aligned_end(s, t) for j, t in rows if i != j} - {None}
        brute |= {i: max(said)} if said else {}
    assert got == brute and {"cut", "complete"} == set(brute.values())


def test_a_complete_text_of_a_crowded_template(spark):
    """A text that ends a line is complete where a longer copy ends that line too, however many copies the template has."""
    rnd = random.Random(12)
    words = lambda n: " ".join("".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(n))
    for copies in (3, 40):
        shared = f"{words(90)}\n- Rotating weeks in the kiln"
        rows = [(1, shared)] + [(100 + n, f"{shared}\n- {words(6)}.") for n in range(copies)]
        rows += [(1000 + n, f"{words(30)}\n- Rotating weeks in the kiln house") for n in range(100)]
        got = {r.id: (r["by"], r.cut) for r in T.judged(spark.createDataFrame(rows, "id long, text string"), "id", "text").collect()}
        assert got[1] == ("alignment", False)


def test_copies_are_no_evidence(spark):
    """Copies and near copies that are cut at the same place don't show that the half word ends a line; different texts do."""
    rnd = random.Random(5)
    words = lambda n: " ".join("".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(n))
    rows = [(n, f"{words(30)}. The night crew walks the yard twice.") for n in range(3)]
    same, first, second = words(60), words(40), words(40)
    rows += [(100 + n, f"{same}. The night crew wal") for n in range(12)]
    rows += [(200 + n, f"{first} {words(1)} {second}. The night crew wal") for n in range(12)]
    rows += [(300 + n, f"{words(60)}\n- Rotating weeks in the kiln") for n in range(12)]
    got = {r[0] for r in T.truncated(spark.createDataFrame(rows, "id long, text string"), "id", "text").collect()}
    assert got == {*range(100, 112), *range(200, 212)}
