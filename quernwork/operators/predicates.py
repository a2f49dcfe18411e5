"""Predicates over postings: places, title keywords, exclusions, and the first reason to reject."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from quernwork.functions.jobtext import clean, clean_description
from quernwork.functions.text import fold

#: What separates places in a location, words of foreign countries, and codes of foreign states.
_SEPARATORS = r"[;|\n]| / "
FOREIGN_WORDS = r"\b(?:united states|usa|united kingdom|england)\b"
FOREIGN_STATES = "AL AK AZ AR CO CT DE FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ NM NY NC ND OH OK OR PA RI SC SD TN TX UT VT VA WA WV WI WY DC".split()
FOREIGN_STATE = rf",\s*(?:{'|'.join(FOREIGN_STATES)})\b"
_PROVINCE_CODE = r",\s*(AB|BC|MB|NB|NL|NS|NT|NU|ON|PE|QC|SK|YT),\s*CA$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _any(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts, F.lit(False))


def home_places(location: Column | str) -> Column:
    """array<string>: the components of a location that don't look foreign."""
    parts = F.split(F.coalesce(_col(location), F.lit("")), _SEPARATORS)
    return F.filter(parts, lambda p: fold(p).contains("canada") | ~(fold(p).rlike(FOREIGN_WORDS) | p.rlike(FOREIGN_STATE)))


def keyword_regex(keywords: list[str]) -> str | None:
    """One alternation of whole words on folded text; a trailing * makes a keyword a prefix. None for no keywords."""
    parts = []
    for k in keywords:
        word = re.escape(k.rstrip("*").lower())
        parts.append(rf"(?<![\p{{L}}\p{{N}}_]){word}" + ("" if k.endswith("*") else r"(?![\p{L}\p{N}_])"))
    return "|".join(parts) or None


def keyword_match(text: Column | str, keywords: list[str]) -> Column:
    """Whether a text has one of the keywords; false for no keywords and for null."""
    pattern = keyword_regex(keywords)
    return F.coalesce(fold(_col(text)).rlike(pattern), F.lit(False)) if pattern else F.lit(False)


def keyword_excluded(text: Column | str, exclusions: list[str], exceptions: dict[str, list[str]] | None = None) -> Column:
    """Whether a text has an excluded keyword none of whose own exceptions it has. Keywords with equal exceptions share one expression."""
    groups: dict[tuple, list[str]] = {}
    for k in exclusions:
        groups.setdefault(tuple((exceptions or {}).get(k, ())), []).append(k)
    return _any([keyword_match(text, ks) & ~keyword_match(text, list(exc)) for exc, ks in groups.items()])


def _folded_like(pattern: str) -> Callable[[Column], Column]:
    return lambda p: fold(p).rlike(pattern)


def city_match(location: Column | str, cities: dict[str, list[str]]) -> Column:
    """The first city, in the order given, that a non-foreign component names by itself or an alias; null for none."""
    places = home_places(location)
    tests = []
    for city, aliases in cities.items():
        pattern = keyword_regex([city, *aliases])
        tests.append(F.when(F.size(F.filter(places, _folded_like(pattern))) > 0, city))
    return F.coalesce(*tests) if tests else F.lit(None).cast("string")


def too_far(location: Column | str, towns: list[str]) -> Column:
    """Whether a location names places and all of them, up to a comma or bracket, are among the towns."""
    parts = F.split(F.coalesce(fold(_col(location)), F.lit("")), _SEPARATORS + r"|\)\s+")
    names = F.filter(F.transform(parts, lambda p: F.trim(F.regexp_extract(p, r"^([^,(]*)", 1))), lambda p: p != "")
    known = [t.lower() for t in towns]
    return (F.size(names) > 0) & F.forall(names, lambda p: p.isin(known)) if known else F.lit(False)


def part_time_only(job_type: Column | str) -> Column:
    letters = F.regexp_replace(F.coalesce(fold(_col(job_type)), F.lit("")), "[^a-z]", "")
    return letters.contains("parttime") & ~letters.contains("fulltime")


def rejection_reason(rules: dict) -> Column:
    """The first failing test in the fixed order location, title, excluded_title, company, job_type; null for a posting that passes.

    rules: cities {city: aliases}, titles, title_exclusions, title_exceptions, companies, too_far (towns; a location of nothing else
    is rejected even where the city is one of ours). Reads location, city, title, company, job_type.
    """
    found = city_match("location", rules["cities"]).isNotNull() | F.lower(F.coalesce("city", F.lit(""))).isin([c.lower() for c in rules["cities"]])
    return (
        F.when(~found | too_far("location", rules.get("too_far", [])), "location")
        .when(~keyword_match("title", rules["titles"]), "title")
        .when(keyword_excluded("title", rules["title_exclusions"], rules.get("title_exceptions")), "excluded_title")
        .when(keyword_match("company", rules["companies"]), "company")
        .when(part_time_only("job_type"), "job_type")
    )


def full_country(location: Column | str) -> Column:
    """A trailing ", XX, CA" written out."""
    return F.regexp_replace(_col(location), _PROVINCE_CODE, ", $1, Canada")


def normalize(df: DataFrame, cities: dict[str, list[str]]) -> DataFrame:
    """Postings with cleaned fields; a blank city is filled from the location."""
    out = df.withColumns({c: clean(c) for c in ("title", "company", "salary", "job_type", "city")} | {"description": clean_description("description"), "location": full_country(clean("location"))})
    return out.withColumn("city", F.when(F.col("city") != "", F.col("city")).otherwise(F.coalesce(city_match("location", cities), F.lit(""))))


def route(df: DataFrame, rules: dict, known: DataFrame) -> DataFrame:
    """df with reason and route: known links go on even if they now fail ("update"), passing ones are "new", the others "reject"."""
    keys = known.select("source", "source_id").distinct().withColumn("_known", F.lit(True))
    out = df.withColumn("reason", rejection_reason(rules)).join(keys, ["source", "source_id"], "left")
    return out.withColumn("route", F.when(F.col("_known"), "update").when(F.col("reason").isNull(), "new").otherwise("reject")).drop("_known")


def exclusion(passes: Column, excluded_at: Column, now: Column) -> Column:
    """The instant of a reversible exclusion: cleared where the record passes, else the first one kept."""
    return F.when(passes, F.lit(None)).otherwise(F.coalesce(excluded_at, now))
