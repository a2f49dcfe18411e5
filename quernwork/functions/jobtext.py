"""Scalar functions of the postings domain as native expressions: cleaning, dates, URLs, keys, pay."""

from __future__ import annotations

import unicodedata
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from quernwork.functions.text import fold, words_only

#: Words that mean "nothing" in a field.
_NOTHING = ("nan", "none", "nat")
#: Legal forms that don't tell employers apart.
COMPANY_SUFFIXES = ("inc", "incorporated", "ltd", "limited", "ltee", "llc", "corp", "corporation", "co", "company", "plc", "ulc", "lp", "canada", "the")
#: Job sites whose pages are no employer's own.
AGGREGATOR_HOSTS = ("indeed.invalid", "linkedin.invalid", "glassdoor.invalid", "ziprecruiter.invalid", "google.invalid", "jobbank.invalid")
#: Hours of a full-time year, the least amount read as yearly, and the most read as hourly where no unit is stated.
YEAR_HOURS, LEAST_YEARLY, MOST_HOURLY = 2080, 15_000, 200


def clean(c: Column | str) -> Column:
    """Text without outer space and doubled blanks; '' for null and for words that mean nothing. Line feeds stay."""
    c = F.col(c) if isinstance(c, str) else c
    t = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"[ \t\r\f\x0B]+", " "), r"^[\s\u00A0]+|[\s\u00A0]+$", "")
    return F.when(F.lower(t).isin(*_NOTHING), "").otherwise(t)


def clean_description(c: Column | str) -> Column:
    """Lines cleaned one by one, at most one blank line between paragraphs; '' for null."""
    c = F.col(c) if isinstance(c, str) else c
    t = F.regexp_replace(F.coalesce(c, F.lit("")), r"[ \t\r\f\x0B\u00A0]+", " ")
    t = F.regexp_replace(F.regexp_replace(t, r" ?\n ?", "\n"), r"\n{3,}", "\n\n")
    return F.regexp_replace(t, r"^\s+|\s+$", "")


def parse_date(c: Column | str) -> Column:
    """A date from ISO text (with or without time), or from positive epoch milliseconds in UTC; null for anything else."""
    c = F.col(c) if isinstance(c, str) else c
    iso = F.regexp_extract(c, r"^\s*(\d{4}-\d{2}-\d{2})(?:[T ].*)?\s*$", 1)
    millis = F.when(c.rlike(r"^\s*\d{10,14}\s*$"), F.trim(c).try_cast("bigint"))
    epoch = F.when(millis > 0, F.date_from_unix_date((millis / 86_400_000).cast("int")))
    return F.coalesce(F.try_to_date(F.nullif(iso, F.lit(""))), epoch)


def norm_company(c: Column | str) -> Column:
    """Folded words of an employer's name without legal forms."""
    padded = F.concat(F.lit("  "), F.regexp_replace(words_only(fold(c)), " ", "  "), F.lit("  "))
    bare = F.regexp_replace(padded, rf" (?:{'|'.join(COMPANY_SUFFIXES)}) ", " ")
    return F.coalesce(F.trim(F.regexp_replace(bare, r" +", " ")), F.lit(""))


def norm_title(c: Column | str) -> Column:
    return F.coalesce(words_only(fold(c)), F.lit(""))


def dedupe_key(company: Column | str, title: Column | str, city: Column | str) -> Column:
    """The key under which two postings are taken for the same opening."""
    city = F.col(city) if isinstance(city, str) else city
    return F.concat_ws("|", norm_company(company), norm_title(title), F.lower(F.coalesce(city, F.lit(""))))


def entity_id(key: Column) -> Column:
    return F.substring(F.sha1(key), 1, 16)


def content_hash(*cols: Column | str) -> Column:
    """A hash over the material fields; null counts as blank. The canonical form is a JSON array of strings."""
    return F.sha1(F.to_json(F.array(*[F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in cols])))


def url_host(c: Column | str) -> Column:
    """Lower-case host of an http(s) URL, '' for other and malformed ones."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.rlike(r"(?i)^https?://"), F.lower(F.coalesce(F.try_parse_url(c, F.lit("HOST")), F.lit("")))).otherwise("")


def external_url(c: Column | str, aggregators: tuple[str, ...] = AGGREGATOR_HOSTS) -> Column:
    """An http(s) URL whose host is no aggregator's, else ''."""
    c = F.col(c) if isinstance(c, str) else c
    host = url_host(c)
    own = host != ""
    for a in aggregators:
        own = own & ~F.endswith(F.concat(F.lit("."), host), F.lit("." + a))
    return F.when(own, c).otherwise("")


def posting_key(c: Column | str) -> Column:
    """What names a posting in a URL: its jid parameter, else the URL."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.concat(F.lit("jid:"), F.nullif(F.regexp_extract(c, r"[?&]jid=([^&#]+)", 1), F.lit(""))), c)


def strict_instant(c: Column | str) -> Column:
    """A timestamp from text that states its offset; null for naive and malformed text."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.rlike(r"(?:Z|[+-]\d{2}:?\d{2})$"), F.try_to_timestamp(c))


def format_pay(low: Column, high: Column, currency: Column, interval: Column) -> Column:
    """"30.5 - 33.25 CAD hourly": distinct finite amounts, currency and interval; '' where no amount is known."""
    shown = F.transform(F.filter(F.array(low, high), lambda x: x.isNotNull() & ~F.isnan(x) & (x > 0)), lambda x: F.call_function("format_number", x, F.lit("#,##0.##")))
    amounts = F.array_join(F.array_distinct(shown), " - ")
    return F.when(amounts == "", "").otherwise(F.concat_ws(" ", amounts, F.nullif(currency, F.lit("")), F.nullif(interval, F.lit(""))))


def pay_amounts(c: Column | str) -> Column:
    """Amounts in a formatted pay text; null where one is written with a k ("60k" is no 60)."""
    c = F.col(c) if isinstance(c, str) else c
    amounts = F.transform(F.regexp_extract_all(c, F.lit(r"(\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?)"), F.lit(1)), lambda x: F.regexp_replace(x, ",", "").try_cast("double"))
    return F.when(~c.rlike(r"(?i)\d\s*k\b"), amounts)


def pay_unit(c: Column | str) -> Column:
    """hourly, annual, or null where a text states neither or both."""
    c = F.lower(F.col(c) if isinstance(c, str) else c)
    hourly, annual = c.rlike(r"\b(?:hourly|per hour|an hour|/ ?hr|/ ?hour|/h)\b"), c.rlike(r"\b(?:yearly|annual|annually|per year|a year|/ ?yr|/ ?year|per annum)\b")
    return F.when(hourly & ~annual, "hourly").when(annual & ~hourly, "annual")


def annual_maximum(maximum: Column, currency: Column, unit: Column) -> Column:
    """The most that pay comes to in a year; null for other currencies and for amounts that fit neither an hour nor a year."""
    known = F.coalesce(currency, F.lit("CAD")).isin("CAD", "USD")
    hourly = (unit == "hourly") | (unit.isNull() & (maximum < MOST_HOURLY))
    yearly = F.when(hourly, maximum * YEAR_HOURS).when(unit == "annual", maximum)
    return F.when(known & (yearly >= LEAST_YEARLY), yearly)


def stated_annual_maximum(statements: Column, per_year: dict[str, float]) -> Column:
    """struct<annual_maximum, unit>: the most that pay statements (pay_statements()) come to in a year and the unit it is stated in; both null where nothing is stated, the amount null where none can be read.

    per_year: years' factors of units; hours count as in annual_maximum(). A statement without currency is in CAD.
    """

    def yearly(p: Column) -> Column:
        factor = F.lit(None).cast("double")
        for unit, x in per_year.items():
            factor = F.when(p["unit"] == unit, x).otherwise(factor)
        as_is = p["unit"].isNull() | (p["unit"] == "hour")
        kind = F.when(p["unit"] == "hour", "hourly").when(p["unit"].isNotNull(), "annual")
        amount = annual_maximum(F.when(as_is, p["high"]).otherwise(p["high"] * factor), p["currency"], kind)
        return F.struct(F.round(amount, 2).alias("annual_maximum"), p["unit"].alias("unit"))

    return F.array_max(F.transform(statements, yearly))


#: Wording that leaves pay open, and refusals that hold the same word.
OPEN_PAY = (
    r"negotiable|negotiated|commensurate"
    r"|(?:depend\w*\s+(?:on|upon)|based\s+(?:on|upon)|according\s+to)\b[^.\n]{0,80}\b(?:experience|qualifications?|skills)"
    r"|starting\s+(?:at|from|wage|rate|salary|pay)|\bfrom\s+(?:cad\s*|ca)?\$|\bdoe\b"
)
FIRM_PAY = r"(?:non-|non |not )negotiable"


def pay_is_open(salary: Column | str, description: Column | str) -> Column:
    """Whether wording leaves pay open; "not negotiable" doesn't."""
    t = F.lower(F.concat_ws("\n", *[F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in (salary, description)]))
    return F.regexp_replace(t, FIRM_PAY, "\n").rlike(OPEN_PAY)


def truncate_report(c: Column | str, most: int, mark: str = " [truncated]") -> Column:
    """A text cut to `most` characters with a mark behind it where anything was cut."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit(mark))).otherwise(c)


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("script", "style"):
            self.hidden += 1
        elif tag == "li":
            self.out.append("\n- ")
        elif tag in ("br", "p", "div", "tr", "ul", "ol", "h1", "h2", "h3", "h4"):
            self.out.append("\n")

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        elif tag in ("p", "div", "tr", "h1", "h2", "h3", "h4"):
            self.out.append("\n")

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.out.append(data)


def html_text_py(s: str | None) -> str:
    """Readable text of an HTML fragment: entries as "- " lines, breaks as line feeds; escaped markup is unescaped first; '' for null."""
    import html
    import re

    if not s:
        return ""
    if "<" not in s and "&lt;" in s:
        s = html.unescape(s)
    p = _Text()
    p.feed(s)
    p.close()
    text = unicodedata.normalize("NFC", "".join(p.out)).replace("\u00a0", " ")
    lines = [re.sub(r"[ \t\r\f\v]+", " ", x).strip() for x in text.split("\n")]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


@F.pandas_udf(T.StringType())
def _html_text(s: pd.Series) -> pd.Series:
    return s.map(html_text_py)


def html_text(c: Column | str) -> Column:
    return _html_text(c)

