"""Sources that are read page by page, page readers, and rows of frames. Pages are tables; network access is outside."""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from quernwork.functions.jobtext import clean, clean_description, format_pay, html_text_py, parse_date
from quernwork.operators.predicates import keyword_match


def read_until_stop(items: DataFrame, scope: list[str], page: str, key: str, total: str, most_pages: int) -> DataFrame:
    """The items (scope..., page, key, total, ...) that a reader which turns page by page, from 0, would have read.

    It reads at most most_pages, stops at a page that is missing or has no new key, and behind the page with which it has met as many keys
    as the first positive total says. A scope has most_pages rows at most in the window, whatever its items.
    """
    items = items.filter((F.col(page) >= 0) & (F.col(page) < most_pages))
    first = items.groupBy(*scope, key).agg(F.min(page).alias(page)).groupBy(*scope, page).agg(F.count("*").alias("_fresh"))
    pages = items.groupBy(*scope, page).agg(F.max(total).alias("_total")).join(first, [*scope, page], "left")
    so_far = W.partitionBy(*scope).orderBy(page).rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy(*scope).orderBy(page).rowsBetween(W.unboundedPreceding, -1)
    fresh = F.coalesce("_fresh", F.lit(0))
    pages = pages.withColumns({"_whole": F.count("*").over(so_far) == F.col(page) + 1, "_met": F.sum(fresh).over(so_far), "_said": F.first(F.when(F.col("_total") > 0, F.col("_total")), ignorenulls=True).over(so_far)})
    pages = pages.withColumn("_goes_on", F.col("_whole") & (fresh > 0) & (F.col("_said").isNull() | (F.col("_met") < F.col("_said"))))
    read = pages.withColumn("_reached", F.coalesce(F.bool_and("_goes_on").over(before), F.lit(True))).filter(F.col("_reached") & F.col("_whole") & (fresh > 0))
    return items.join(read.select(*scope, page), [*scope, page], "left_semi")


def with_details(found: DataFrame, details: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """found with `fields` from their details where these have one; a posting whose detail failed (no row) is still a sighting, with null fields. One detail a posting counts, the largest."""
    one = details.groupBy(*keys).agg(F.max(F.struct(*fields)).alias("_d"))
    return found.drop(*fields).join(one, keys, "left").select(*[c for c in found.columns if c not in fields], *[F.col(f"_d.{f}").alias(f) for f in fields])


def board_scan(postings: DataFrame, titles: list[str]) -> DataFrame:
    """Postings of whole boards whose title has one of the keywords; the test stands in the scan's filter, ahead of everything else."""
    return postings.filter(keyword_match("title", titles))


def from_frame(rows: DataFrame, city: Column) -> DataFrame:
    """Postings of search rows (id, site, job_url, title, company, location, description, date_posted, min_amount, max_amount, currency, interval, job_type, job_url_direct).

    NaN, null and words for nothing are blank; rows without id, URL or title are left out. salary: the finite amounts with currency (CAD
    unless stated) and interval, '' without one.
    """
    text = lambda c: clean(F.col(c).cast("string"))
    named = rows.filter((text("id") != "") & (text("job_url") != "") & (text("title") != ""))
    amount = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    pay = format_pay(amount("min_amount"), amount("max_amount"), F.coalesce(F.nullif(text("currency"), F.lit("")), F.lit("CAD")), text("interval"))
    return named.select(
        text("site").alias("source"), text("id").alias("source_id"), text("job_url").alias("url"), *[text(c).alias(c) for c in ("title", "company", "location", "job_type")],
        clean_description("description").alias("description"), parse_date(F.col("date_posted").cast("string")).alias("posted_date"), pay.alias("salary"), city.alias("city"), text("job_url_direct").alias("apply_url"),
    )


def board_base(url: Column | str) -> Column:
    """A board's URL without query, trailing slashes and the endpoints of searches ("/search", "/tile-search-results") and categories ("/go/<name>/<number>")."""
    url = F.col(url) if isinstance(url, str) else url
    path = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    path = F.regexp_replace(path, r"(?i)/go/[^/]+/\d+(?:/\d+)?/?$", "")
    path = F.regexp_replace(F.regexp_replace(path, r"(?i)/(?:search|tile-search-results)/?$", ""), "/+$", "")
    return F.concat(F.try_parse_url(url, F.lit("PROTOCOL")), F.lit("://"), F.try_parse_url(url, F.lit("AUTHORITY")), path)


def site_id(c: Column | str, prefix: str = "li-") -> Column:
    """An id without its source's prefix."""
    return F.regexp_replace(c, f"^{re.escape(prefix)}", "")


class _Nodes(HTMLParser):
    """The elements of a page with tag, attributes, inner markup and depth; void elements have no inner markup."""

    _VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

    def __init__(self, page: str) -> None:
        super().__init__(convert_charrefs=False)
        self.page, self.nodes, self.open, self.starts = page, [], [], [0]
        for line in page.split("\n"):
            self.starts.append(self.starts[-1] + len(line) + 1)
        self.feed(page)
        self.close()
        for n in self.open:
            n["end"] = len(page)

    def _at(self) -> int:
        line, column = self.getpos()
        return self.starts[line - 1] + column

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = {k: v or "" for k, v in attrs}
        at = self._at()
        node = {"tag": tag, "attrs": a, "classes": frozenset(a.get("class", "").split()), "start": at + len(self.get_starttag_text() or ""), "end": at + len(self.get_starttag_text() or ""), "inside": list(self.open)}
        self.nodes.append(node)
        if tag not in self._VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if self.open and self.open[-1] is self.nodes[-1]:
            self.open.pop()

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k]["tag"] == tag:
                for n in self.open[k:]:
                    n["end"] = self._at()
                del self.open[k:]
                return

    def find(self, test, within: dict | None = None) -> list[dict]:
        return [n for n in self.nodes if test(n) and (within is None or any(x is within for x in n["inside"]))]

    def text(self, node: dict | None, hidden: str | None = None) -> str:
        """The text of a node as one line, without the inner nodes of a class that readers don't see."""
        if not node:
            return ""
        markup, at = "", node["start"]
        for n in self.find(lambda n: hidden in n["classes"], node) if hidden else []:
            if n["start"] >= at:
                markup, at = markup + self.page[at : n["start"]] + " ", n["end"]
        return " ".join(html_text_py(markup + self.page[at : node["end"]]).split())

    def long_text(self, node: dict | None) -> str:
        return html_text_py(self.page[node["start"] : node["end"]]) if node else ""


def _first(found: list[dict]) -> dict | None:
    return found[0] if found else None


_RESULTS = T.StructType([T.StructField("total", T.LongType()), T.StructField("rows", T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("source_id", "title", "company", "location", "salary", "date")])))])


def results_of(page: str | None) -> dict | None:
    """total and rows of a results page; null without a results count. Rows without a posting's number or title are left out."""
    doc = _Nodes(page or "")
    count = _first(doc.find(lambda n: n["attrs"].get("id") == "results-count"))
    digits = doc.text(count).replace(",", "")
    if not digits.isdigit():
        return None
    rows = []
    for row in doc.find(lambda n: n["tag"] == "article" and n["attrs"].get("id", "").startswith("article-")):
        link = _first(doc.find(lambda n: n["tag"] == "a" and "resultJobItem" in n["classes"], row))
        number = re.search(r"/jobposting/(\d+)(?:[;/?]|$)", link["attrs"].get("href", "")) if link else None
        field = lambda name, row=row: doc.text(_first(doc.find(lambda n: name in n["classes"], row)), "wb-inv")
        if number and (title := field("noctitle")):
            rows.append({"source_id": number[1], "title": title, "company": field("business"), "location": field("location"), "salary": re.sub(r"^Salary\s*", "", field("salary")), "date": field("date")})
    return {"total": int(digits), "rows": rows}


@F.pandas_udf(_RESULTS)
def _results(pages: pd.Series) -> pd.DataFrame:
    found = [results_of(p) for p in pages]
    return pd.DataFrame({c: pd.Series([r[c] if r else None for r in found], dtype=object) for c in ("total", "rows")})


def read_results(df: DataFrame, column: str = "html") -> tuple[DataFrame, DataFrame]:
    """(rows, pages without a results count): one row a result of each page, with its total and df's other columns."""
    rest = [c for c in df.columns if c != column]
    read = df.withColumn("_r", _results(column))
    rows = read.filter("_r.total is not null").select(*rest, F.col("_r.total").alias("total"), F.explode("_r.rows").alias("_x")).select(*rest, "total", "_x.*")
    return rows, read.filter("_r.total is null").drop("_r")


_DETAIL = T.StructType([T.StructField(c, T.StringType()) for c in ("description", "salary", "date", "fault")])


def _markup(text: str) -> str:
    return html_text_py(text) if re.search(r"</?(?:p|br|li|ul|ol|div|span|strong|b|em|i|u|h[1-6])\b[^>]*>", text, re.I) else "\n".join(" ".join(x.split()) for x in text.split("\n")).strip()


def framed_texts(data: str) -> dict[str, str]:
    """The rows of a stream of rows "<hex>:<value>\\n" and "<hex>:T<hex length>,<that many bytes>"; ValueError where a row ends before its length."""
    raw, at, out = data.encode(), 0, {}
    while at < len(raw):
        head = re.compile(rb"([0-9a-f]*):(?:T([0-9a-f]+),)?").match(raw, at)
        if not head:
            break
        if head[2]:
            end = head.end() + int(head[2], 16)
            if end > len(raw):
                raise ValueError("a text ends before its length")
        else:
            end = raw.find(b"\n", head.end())
            end = len(raw) if end < 0 else end
        out[head[1].decode()] = raw[head.end() : end].decode()
        at = end + (0 if head[2] else 1)
    return out


def detail_of(kind: str | None, page: str | None) -> dict:
    """description, salary, date and fault of a detail page. kind: "native" (a block of requirements, else a partner's hidden text, else nothing to read), "guest" (description and a box with pay), "tile" (description and date), "framed" (the longest of JSON-LD and framed texts). fault says what is wrong with a page that can't be read; such a page may be read again."""
    doc, out = _Nodes(page or ""), {"description": None, "salary": "", "date": "", "fault": None}
    by_class = lambda *names: _first(doc.find(lambda n: any(x in n["classes"] for x in names)))
    if kind == "native":
        text = doc.long_text(by_class("job-posting-detail-requirements"))
        holder = by_class("job-posting-content")
        if not text and holder:
            outside = _first(doc.find(lambda n: n["attrs"].get("id") == "externalJobLink" and n["attrs"].get("href"), holder))
            hidden = _first(doc.find(lambda n: n["attrs"].get("property") == "description", holder))
            text = _markup(doc.long_text(hidden)) if outside and hidden else "" if outside else None
        read = bool(text) or (holder is not None and text is not None)
        out["description"], out["fault"] = (text, None) if read else (None, "neither requirements nor a link outside")
    elif kind == "guest":
        out["description"], out["salary"] = doc.long_text(by_class("show-more-less-html__markup")), doc.text(by_class("compensation__salary"))
    elif kind == "tile":
        block = _first(doc.find(lambda n: "jobdescription" in n["classes"] or n["attrs"].get("itemprop") == "description" or n["attrs"].get("id") == "job-description"))
        posted = _first(doc.find(lambda n: n["attrs"].get("itemprop") == "datePosted" or "jobDate" in n["classes"]))
        out["description"], out["date"] = doc.long_text(block), (posted["attrs"].get("content") or doc.text(posted)) if posted else ""
    elif kind == "framed":
        texts = []
        for script in doc.find(lambda n: n["tag"] == "script" and n["attrs"].get("type") == "application/ld+json"):
            try:
                found = json.loads(doc.page[script["start"] : script["end"]])
            except ValueError:
                continue
            texts += [html_text_py(x["description"]) for x in (found if isinstance(found, list) else [found]) if isinstance(x, dict) and x.get("@type") == "JobPosting" and isinstance(x.get("description"), str)]
        try:
            frames = framed_texts("".join(json.loads(x) for x in re.findall(r'__next_f\.push\(\[1,("(?:[^"\\]|\\.)*")\]\)', page or "")))
            named = [m[1] for v in frames.values() for m in re.finditer(r'"htmlFullDescription":"((?:[^"\\]|\\.)*)"', v)]
            for text in named:
                text = json.loads(f'"{text}"')
                text = frames.get(text[1:], "") if re.fullmatch(r"\$[0-9a-f]+", text) else text
                texts += [html_text_py(text)] if text else []
        except ValueError as e:
            out["fault"] = str(e)
        out["description"] = max(texts, key=len, default=None)
        out["fault"] = None if out["description"] else out["fault"] or "no description"
    else:
        out["fault"] = "unknown kind of page"
    return out


@F.pandas_udf(_DETAIL)
def _details(kinds: pd.Series, pages: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([detail_of(k, p) for k, p in zip(kinds, pages, strict=True)], columns=["description", "salary", "date", "fault"])


def read_details(df: DataFrame, kind: str = "kind", column: str = "html") -> DataFrame:
    """df's other columns with description, salary, date and fault of each detail page (detail_of())."""
    rest = [c for c in df.columns if c != column]
    return df.select(*rest, _details(kind, column).alias("_d")).select(*rest, "_d.*")
