"""Canonical forms of employer, title and place, however they are written.

Misspelt words are put right with the corpus's own frequent words: a word that is rare beside a neighbour at edit
distance 1 is taken for a slip of it. Words count from LEAST_ROWS rows on, however many rows there are; words and their
neighbours meet in a join, and no list of words is ever on the driver. The counts that words are held against are a table of
(w, count): an index that must find its own keys again stores it once and never counts anew.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from quernwork.functions.text import fold, fold_py, source_key, words_only
from quernwork.llm.places import PlaceResolver, _mojibake, edit_distance, place_rows, squeeze
from quernwork.session import stored

#: Fewest letters of a word that may be misspelt.
_LEAST = {"title": 3, "company": 4}
#: Values with slips are broadcast where there are at most so many, and met in a shuffled join where there are more.
MOST_BROADCAST = 200_000
#: A word counts as known from so many rows on.
LEAST_ROWS = 4
#: A known word gives way to a neighbour this many times as frequent.
OVERWHELMING = 40

#: Short forms in titles and companies, legal forms, and what adverts add to a title.
_TITLE_SHORT = {
    "jr": "junior", "jnr": "junior", "sr": "senior", "snr": "senior", "asst": "assistant", "assist": "assistant", "coord": "coordinator", "eng": "engineer", "engr": "engineer", "supv": "supervisor", "supvr": "supervisor", "sup": "supervisor",
    "mgr": "manager", "mngr": "manager", "tech": "technician", "pkg": "packaging", "spec": "specialist", "insp": "inspector", "op": "operator", "mech": "mechanic", "sci": "scientist", "admin": "administrator", "qc": "quality control", "qa": "quality assurance", "lab": "laboratory", "dir": "director",
}
_COMPANY_SHORT = {
    "pkg": "packaging", "chem": "chemicals", "chemical": "chemicals", "bev": "beverages", "beverage": "beverages", "lab": "laboratories", "labs": "laboratories", "laboratory": "laboratories", "food": "foods", "logistic": "logistics", "bakery": "bakeries", "textile": "textiles",
    "ceramic": "ceramics", "seed": "seeds", "plastic": "plastics", "fishery": "fisheries", "mill": "milling", "analytic": "analytics", "mfg": "manufacturing", "tech": "technologies", "intl": "international",
}
_LEGAL = frozenset("inc incorporated ltd limited ltee limitee corp corporation co company llc llp lp plc gmbh sa sarl sas ulc group groupe holdings partners partner partenaires".split())
_COMPANY_TAIL = frozenset("canada careers career jobs hr dept department recruiting recruitment hiring".split())
_KNOWN = frozenset(_COMPANY_SHORT) | frozenset(_COMPANY_SHORT.values()) | _LEGAL | _COMPANY_TAIL
_SENIORITY = frozenset("junior senior assistant lead associate principal chief head intern trainee".split())
_GRADES = {"i": "1", "ii": "2", "iii": "3", "iv": "4", "v": "5", "vi": "6"} | {str(i): str(i) for i in range(1, 10)}
_ADDED = re.compile(
    r"\(?\b[mfhwdx](?:\s*/\s*[mfhwdx]){1,3}\b\)?|#\s*r?-?\d+|\breq(?:uisition)?\.?\s*(?:id|no|#)?\s*[:#-]?\s*\d+|\(?\b\d+\s*-?\s*months?\b(?:\s+contract)?\)?|\b(?:full|part)\s*-?\s*time\b|\b(?:urgent(?:ly)?|permanent|temporary|contract|hiring\s+now|remote|hybrid|on-?site)\b"
)
_CLIENT = re.compile(r"\b(?:client\s*)?\(?k\s*-?\s*0*(\d{3,})\b")


def _words(c: Column) -> Column:
    return F.filter(F.split(words_only(fold(c)), " "), lambda w: (F.length(w) > 1) & ~w.rlike("[0-9]"))


def word_counts(df: DataFrame) -> DataFrame:
    """(column, w, count): the words of title and of company in LEAST_ROWS rows or more."""
    both = F.array(*[F.struct(F.lit(c).alias("column"), _words(F.col(c)).alias("ws")) for c in _LEAST])
    words = df.select(F.explode(both).alias("x")).select("x.column", F.explode("x.ws").alias("w"))
    return words.groupBy("column", "w").count().filter(F.col("count") >= LEAST_ROWS)


class Corrections:
    """Words put right by given corrections; all others stay as they are."""

    def __init__(self, right: dict[str, str]) -> None:
        self.known = right

    def right(self, w: str) -> str:
        return self.known.get(w, w)


def company_words(s: str | None) -> list[str]:
    """The words of an employer's name as they are written, without a numbered shell."""
    t = re.sub(r"^.*?\b(?:d\s*/?\s*b\s*/?\s*a|doing business as|o/a|trading as)\b\.?\s*", " ", fold_py(s))
    return re.findall(r"[a-z0-9&]+", t)


def company_key(s: str | None, spelling: Corrections) -> str:
    """Brand and trade of an employer, without article, numbered shell, legal form and what is added to a name."""
    words = company_words(s)
    words = [_COMPANY_SHORT.get(w, w) for w in (w if w in _KNOWN else spelling.right(w) for w in words)]
    if words[:1] in (["the"], ["les"], ["le"], ["la"]):
        words = words[1:]
    while len(words) > 1 and words[-1] in _LEGAL | _COMPANY_TAIL:
        words.pop()
    return " ".join(w for w in words if w not in _LEGAL) or " ".join(words)


def _parts(w: str) -> Column:
    """_shorter() of a column."""
    cut = F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(F.col(w), F.lit(1), i - 1), F.substring(F.col(w), i + 1, F.length(w))))
    return F.array_distinct(F.concat(F.array(w), cut))


def corrections(counts: DataFrame, words: DataFrame) -> DataFrame:
    """(column, w, right): the words (column, w) that are slips of a neighbour at distance 1, and that neighbour, the most frequent one; a lost, doubled or exchanged letter goes before a replaced one.

    A word that counts (column, w, count) don't have gives way to any known neighbour, one that they have only to a neighbour OVERWHELMING
    times as frequent. Words with few letters and such with digits stay. counts may be of any size: words meet at what is left of
    them without one letter, so a key has no more words than one letter can be put in, whatever the number of rows.
    """
    least = F.when(F.col("column") == "title", _LEAST["title"]).otherwise(_LEAST["company"])
    asked = words.filter((F.length("w") >= least) & ~F.col("w").rlike("[0-9]")).distinct().join(counts, ["column", "w"], "left")
    asked = asked.select("column", "w", F.when(F.col("count").isNull(), 3).otherwise(F.col("count") * OVERWHELMING).alias("wanted"))
    known = counts.select("column", F.col("w").alias("x"), "count").withColumn("part", F.explode(_parts("x")))
    pairs = asked.withColumn("part", F.explode(_parts("w"))).join(known, ["column", "part"])
    pairs = pairs.filter("x <> w and count >= wanted and abs(length(x) - length(w)) <= 1").select("column", "w", "x", "count")

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b.drop_duplicates()
            b = b[[edit_distance(w, x) == 1 for w, x in zip(b["w"], b["x"], strict=True)]]
            # a lost, doubled or exchanged letter
            yield b.assign(alike=[len(x) != len(w) or sorted(x) == sorted(w) for w, x in zip(b["w"], b["x"], strict=True)])

    best = pairs.mapInPandas(near, "column string, w string, x string, count bigint, alike boolean").groupBy("column", "w").agg(F.max(F.struct("alike", "count", "x")).alias("best"))
    return best.select("column", "w", F.col("best.x").alias("right"))


def slips(frames: list[DataFrame], counts: DataFrame) -> DataFrame:
    """(column, name, fixes array<struct<w, right>>): the titles and companies of all frames that have misspelt words, and what these become. counts: word_counts(). Stored."""
    both = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("name")) for c in _LEAST])
    names = frames[0].select(F.explode(both).alias("x"))
    for f in frames[1:]:
        names = names.unionByName(f.select(F.explode(both).alias("x")))

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(c, s, w) for c, s in zip(b["column"], b["name"], strict=True) for w in dict.fromkeys(_SPLIT[c](s))], columns=["column", "name", "w"])

    used = stored(names.select("x.*").filter("name is not null").distinct().mapInPandas(split, "column string, name string, w string"), "words")
    fixed = used.join(corrections(counts, used.select("column", "w")), ["column", "w"]).groupBy("column", "name").agg(F.collect_list(F.struct("w", "right")).alias("fixes"))
    return stored(fixed, "slips")


def with_fixes(df: DataFrame, found: DataFrame | None) -> DataFrame:
    """df with title_fixes and company_fixes (null for values without a slip), from slips(). Few slips travel to the rows, so that these needn't be shuffled."""
    few = found is not None and found.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    for column in _LEAST:
        named = f"{column}_fixes"
        if found is None:
            df = df.withColumn(named, F.lit(None).cast("array<struct<w: string, right: string>>"))
        else:
            mine = found.filter(F.col("column") == column).select(F.col("name").alias(column), F.col("fixes").alias(named))
            df = df.join(F.broadcast(mine) if few else mine, column, "left")
    return df


class Canonical:
    """Canonical parts of one task: equal values are worked out once."""

    def __init__(self, rows: list[tuple]) -> None:
        resolver, none = PlaceResolver(rows), Corrections({})
        self.place = lru_cache(200_000)(lambda a, b: place_key(resolver, a, b))
        self._company = lru_cache(200_000)(lambda s: company_key(s, none))
        self._title = lru_cache(200_000)(lambda s: title_parts(s, none))

    def company(self, s: str | None, fixes: object) -> str:
        return self._company(s) if fixes is None else company_key(s, _of(fixes))

    def title(self, s: str | None, fixes: object) -> tuple[str, str, str, str]:
        return self._title(s) if fixes is None else title_parts(s, _of(fixes))


def _of(fixes: object) -> Corrections:
    return Corrections({f["w"]: f["right"] for f in fixes})


def title_parts(s: str | None, spelling: Corrections) -> tuple[str, str, str, str]:
    """(words of topic and role in alphabetical order, seniority, grade, client code) of a title."""
    t = fold_py(s)
    codes = sorted({m[1] for m in _CLIENT.finditer(t)})
    t = _ADDED.sub(" ", _CLIENT.sub(" ", t))
    t = re.sub(r"\bclient\b", " ", t)
    grades = set()
    t = re.sub(r"\b(?:level|grade|lvl|niveau)\s*[-:]?\s*(\d|i{1,3}|iv|v)\b", lambda m: grades.add(_GRADES.get(m[1], m[1])) or " ", t)
    words: list[str] = []
    for w in re.findall(r"[a-z0-9]+", t):
        if w in _GRADES:
            grades.add(_GRADES[w])
        else:
            words += _TITLE_SHORT.get(w, _TITLE_SHORT.get(r := spelling.right(w), r)).split()
    rank = sorted(w for w in words if w in _SENIORITY)
    return " ".join(sorted(w for w in words if w not in _SENIORITY)), " ".join(rank), " ".join(sorted(grades)), " ".join(codes)


#: The words of a title or company that may be misspelt.
_SPLIT: dict[str, Callable] = {
    "company": lambda s: [w for w in company_words(s) if w not in _KNOWN],
    "title": lambda s: [w for w in re.findall(r"[a-z0-9]+", fold_py(s)) if w not in _GRADES and w not in _TITLE_SHORT],
}


def place_key(resolver: PlaceResolver, location: str | None, city: str | None) -> str:
    """The ids of the places that location (else city) names; where the list has none, the folded text of the entry; '' for blank ones."""
    ids = resolver.resolve(location, city) or (resolver.resolve(None, city) if city and city.strip() else [])
    if ids:
        return " ".join(map(str, ids))
    entry = location if location and location.strip() else city
    return "~" + k if (k := squeeze(_mojibake(entry or ""))) else ""


def opening_forms(df: DataFrame, keys: list[str], places: DataFrame, found: DataFrame | None) -> DataFrame:
    """(keys..., company_key, title_words, seniority, grade, client, place_key) of rows with title, company, location and city.

    Blank and null fields give ''. found: slips() of the rows, or None where nothing is put right.
    """
    rows = place_rows(places)
    schema = ", ".join(f"`{c}` {t}" for c, t in df.select(*keys).dtypes) + ", company_key string, title_words string, seniority string, grade string, client string, place_key string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forms = Canonical(rows)
        for b in batches:
            parts = [forms.title(s, f) for s, f in zip(b["_title"], b["_title_fixes"], strict=True)]
            out = b[keys].copy()
            out["company_key"] = [forms.company(s, f) for s, f in zip(b["_company"], b["_company_fixes"], strict=True)]
            for i, name in enumerate(("title_words", "seniority", "grade", "client")):
                out[name] = [p[i] for p in parts]
            out["place_key"] = [forms.place(x, y) for x, y in zip(b["_location"], b["_city"], strict=True)]
            yield out

    fields = ("title", "company", "location", "city", "title_fixes", "company_fixes")
    spec = with_fixes(df.select(*dict.fromkeys([*keys, "title", "company", "location", "city"])), found).select(*keys, *[F.col(c).alias(f"_{c}") for c in fields])
    return spec.mapInPandas(run, schema)


#: The parts that make one opening.
OPENING = ["company_key", "title_words", "seniority", "grade", "client", "place_key"]

#: The 12 fields of a posting in job_sources.raw.
RAW_SCHEMA = "source string, source_id string, url string, title string, company string, location string, description string, posted_date string, salary string, job_type string, city string, apply_url string"


def raw_fields(links: DataFrame) -> DataFrame:
    """links with the posting fields of raw as columns; malformed and null snapshots give nulls."""
    r = F.from_json("raw", RAW_SCHEMA)
    return links.withColumn("_raw", r).select(
        "source", "source_id", "job_id", "first_seen", *[F.col(f"_raw.{c}").alias(c) for c in ("title", "company", "location", "city", "description")]
    )


__all__ = ["OPENING", "RAW_SCHEMA", "Canonical", "Corrections", "company_key", "corrections", "opening_forms", "place_key", "raw_fields", "slips", "source_key", "title_parts", "with_fixes", "word_counts"]
