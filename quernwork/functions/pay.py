"""Pay statements in free text.

`pay_statements` scans text for base pay and returns what the text itself states; units, currencies
and scales that it leaves open stay null for the operator in operators/units.py to settle.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

STATEMENTS = T.ArrayType(
    T.StructType(
        [
            T.StructField("low", T.DoubleType()),
            T.StructField("high", T.DoubleType()),
            T.StructField("unit", T.StringType()),
            T.StructField("currency", T.StringType()),
            T.StructField("thousands", T.BooleanType()),
        ]
    )
)

#: Unit names by the words that state them.
UNIT_WORDS = (
    ("biweek", r"bi-?\s?weekly|(?:every|per|each)\s+(?:two|2)\s+weeks|fortnight(?:ly)?|(?:aux|par|toutes\s+les)\s+(?:deux|2)\s+semaines|quinzaine"),
    ("hour", r"hourly|hours?|hrs?|h|heures?|l'heure|horaire|stunde|hora"),
    ("day", r"daily|days?|jours?|journalier|journee|per\s+diem"),
    ("week", r"weekly|weeks?|wks?|semaines?|hebdomadaire"),
    ("month", r"monthly|months?|mos?|mois|mensuel(?:lement)?|mth"),
    ("year", r"yearly|years?|yrs?|annually|annual|annum|annuellement|annuel|annees?|ans?(?!\s+(?:hour|hr|h)\b)|pa"),
)
#: Number words.
_ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
_TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
_WORD = {w: i for i, w in enumerate(_ONES)} | {w: 20 + 10 * i for i, w in enumerate(_TENS)}
_WORD_RE = re.compile(rf"\b(?:{'|'.join(sorted(_WORD, key=len, reverse=True))}|hundred|thousand)(?:[\s-]+(?:and\s+)?(?:{'|'.join(sorted(_WORD, key=len, reverse=True))}|hundred|thousand))*\b")

_NUMBER = r"\d{1,3}(?:[ ,]\d{3})+(?:[.,]\d{1,2})?(?!\d)|\d+(?:[.,]\d+)?"
_MONEY = re.compile(
    rf"(?P<pre>(?:cad|usd|eur|gbp)\s*\$?|ca\$|c\$|us\$|\$|€|£)?\s*(?P<num>{_NUMBER})\s*(?P<k>k\b|thousand\b)?\s*(?P<post>\$\s*(?:cad|usd|us\b|ca\b)?|€|£|(?:cad|usd|eur|gbp)\b|(?:canadian|us|american)?\s*dollars?\b|euros?\b|pounds?\b)?"
)
_CURRENCY = (("CAD", r"cad|ca\$|c\$|canadian"), ("USD", r"usd|us\$|\$\s*us|american"), ("EUR", r"eur|€"), ("GBP", r"gbp|£|pound"))
#: What stands beside pay without being base pay; a clause with one of the words is left out as a whole.
_BESIDE = re.compile(r"bonus|premium|prime\b|vacation|vacances|allowance|overtime|relocation|stipend|commission|pension|rrsp|leave\b|conge|\d\s*%")
_HOURS = re.compile(r"\d+(?:[.,]\d+)?\s*(?:h|hrs?|hours?|heures?)\s*(?:/|per|a|par|each)\s*(?:wk|week|semaine)s?\b")
_GRADES = re.compile(r"\b(?:grades?|steps?|levels?|bands?|echelons?|niveaux?|classes?|scales?|group)\s*[-#:]?\s*\d+\b|\b\d+\s*(?:%|percent\b|pour\s?cent\b)")
_CLAUSES = re.compile(r"[;()\[\]|\n]|\s\+\s|\splus\s|\sand\s|,\s+(?=[^\d\s])|\.\s+(?=[^\d\s])")
_UNITS = [(u, re.compile(rf"(?<![a-z0-9'])(?:{p})(?![a-z0-9])" if u != "hour" else rf"(?<![a-z])(?:{p})(?![a-z0-9])")) for u, p in UNIT_WORDS]


def _words_to_digits(m: re.Match) -> str:
    total = part = 0
    for w in re.split(r"[\s-]+", m[0]):
        if w == "hundred":
            part = max(part, 1) * 100
        elif w == "thousand":
            total, part = total + max(part, 1) * 1000, 0
        elif w != "and":
            part += _WORD[w]
    return str(total + part)


def _value(num: str) -> float:
    num = num.replace(" ", "")
    if re.fullmatch(r"\d{1,3}(?:,\d{3})+(?:\.\d+)?", num):
        num = num.replace(",", "")
    elif re.fullmatch(r"\d{1,3}(?:,\d{3})+,\d{1,2}", num):
        head, _, tail = num.rpartition(",")
        num = head.replace(",", "") + "." + tail
    return float(num.replace(",", "."))


def _unit(clause: str, after: int) -> str | None:
    """The unit stated behind the figures, else anywhere in the clause."""
    for part in (clause[after:], clause):
        found = [(m.start(), -len(m[0]), u) for u, r in _UNITS if (m := r.search(part))]
        if found:
            return min(found)[2]
    return None


@lru_cache(100_000)
def scan_pay(text: str | None) -> list[dict]:
    """The statements of base pay in one text, in the order of the text; none for null, blank or pay-less text. Figures of zero are no pay."""
    if not text or not text.strip():
        return []
    t = re.sub(r"[    \s]+", " ", text).strip().lower()
    t = t.replace("’", "'").translate(str.maketrans("éèêàâûôîç", "eeeaauoic"))
    t = re.sub(r"\bp\.\s?a\.?", "per annum", t)
    t = re.sub(r"\b(min|max|i\.e|e\.g|approx|env|ca)\.", lambda m: m[1].replace(".", ""), t)
    t = _GRADES.sub(" ", _HOURS.sub(" ", t))
    t = _WORD_RE.sub(_words_to_digits, t) if not re.search(r"(?:every|aux|per)\s+two\s+weeks", t) else t
    out = []
    for clause in _CLAUSES.split(t):
        if not clause or _BESIDE.search(clause):
            continue
        c = re.sub(r"(?:every|per)\s+(?:two|2)\s+weeks", "biweekly", re.sub(r"aux (?:deux|2) semaines", "biweekly", clause))
        # a figure glued to letters or "#" ("R7", "#12") is no amount
        money = [m for m in _MONEY.finditer(c) if m["pre"] or not re.search(r"[a-z#]-?$", c[: m.start("num")])]
        if not money:
            continue
        values, marks = [_value(m["num"]) for m in money], [bool(m["k"]) for m in money]
        if any(marks):  # in "36-38K" the mark holds for both
            last = max(i for i, k in enumerate(marks) if k)
            marks = [k or (i < last and values[i] < 1000) for i, k in enumerate(marks)]
        values = [v * 1000 if k else v for v, k in zip(values, marks, strict=True)]
        values = [v for v in values if v > 0]
        if not values:
            continue
        said = " ".join((m["pre"] or "") + " " + (m["post"] or "") for m in money)
        out.append(
            {
                "low": min(values),
                "high": max(values),
                "unit": _unit(c, money[-1].end("k") if money[-1]["k"] else money[-1].end("num")),
                "currency": next((n for n, p in _CURRENCY if re.search(p, said) or re.search(rf"\b(?:{n.lower()})\b", c)), None),
                "thousands": any(marks),
            }
        )
    return out


@F.pandas_udf(STATEMENTS)
def _pay_statements(texts: pd.Series) -> pd.Series:
    return texts.map(scan_pay)  # short texts repeat: a task scans each once


def pay_statements(text: Column | str) -> Column:
    """array<struct<low, high, unit, currency, thousands>> of a text."""
    return _pay_statements(text)
