"""Readers of raw records: JSON snapshots and boards, feeds, pages. Malformed records are set aside one by one, never dropped silently."""

from __future__ import annotations

import json
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from quernwork.functions.jobtext import html_text, parse_date

#: The 12 fields of a posting.
SNAPSHOT = "source string, source_id string, url string, title string, company string, location string, description string, posted_date string, salary string, job_type string, city string, apply_url string"


def parse_snapshots(df: DataFrame, column: str = "raw") -> tuple[DataFrame, DataFrame]:
    """(rows with the parsed `posting`, quarantined rows): null snapshots are in neither; text that is no JSON object, or has no title, is quarantined."""
    parsed = df.filter(F.col(column).isNotNull()).withColumn("posting", F.from_json(column, SNAPSHOT))
    good = F.json_object_keys(column).isNotNull() & F.col("posting.title").isNotNull()
    return parsed.filter(good), parsed.filter(~F.coalesce(good, F.lit(False)))


_POSTING = ["source_id", "url", "title", "location", "description", "posted_date"]


def _exploded(df: DataFrame, array_json: Column, item: str) -> DataFrame:
    """One row per element of a JSON array of objects, each parsed by itself, so that a malformed one spoils no other; a body without such an array is one row without an item. An empty array has no rows."""
    items = F.from_json(array_json, "array<string>")
    return df.withColumn("_text", F.explode(F.coalesce(items, F.array(F.col("body"))))).withColumn("_item", F.when(items.isNotNull(), F.from_json("_text", item)))


def _split(rows: DataFrame, fields: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    out = rows.select("board", "_text", *[v.alias(k) for k, v in fields.items()])
    good = (F.length(F.trim("source_id")) > 0) & (F.length(F.trim("title")) > 0) & (F.length(F.trim("url")) > 0)
    return out.filter(good).drop("_text"), out.filter(~F.coalesce(good, F.lit(False))).select("board", "_text")


def read_job_lists(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Boards of the form {"jobs": [{id, absolute_url, title, location: {name}, content, updated_at}]} in df (board, body): (postings, malformed elements)."""
    rows = _exploded(df, F.get_json_object("body", "$.jobs"), "id string, absolute_url string, title string, location struct<name: string>, content string, updated_at string")
    i = F.col("_item")
    return _split(rows, {"source_id": F.when(F.length(i["id"]) > 0, F.concat_ws(":", "board", i["id"])), "url": i["absolute_url"], "title": i["title"], "location": F.coalesce(i["location"]["name"], F.lit("")), "description": html_text(i["content"]), "posted_date": parse_date(i["updated_at"])})


def read_posting_arrays(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Boards of the form [{id, hostedUrl, text, categories: {location, allLocations}, descriptionPlain, lists: [{text, content}], createdAt}] in df (board, body)."""
    rows = _exploded(df, F.col("body"), "id string, hostedUrl string, text string, categories struct<location: string, allLocations: array<string>>, descriptionPlain string, lists array<struct<text: string, content: string>>, createdAt string")
    i = F.col("_item")
    places = F.array_join(F.filter(F.array_distinct(F.concat(F.array(i["categories"]["location"]), F.coalesce(i["categories"]["allLocations"], F.expr("array()").cast("array<string>")))), lambda x: F.length(x) > 0), "; ")
    lists = F.array_join(F.transform(F.coalesce(i["lists"], F.expr("array()").cast("array<struct<text: string, content: string>>")), lambda x: F.concat_ws("\n", x["text"], x["content"])), "\n")
    return _split(rows, {"source_id": F.when(F.length(i["id"]) > 0, F.concat_ws(":", "board", i["id"])), "url": i["hostedUrl"], "title": i["text"], "location": places, "description": html_text(F.concat_ws("\n", i["descriptionPlain"], F.nullif(lists, F.lit("")))), "posted_date": parse_date(i["createdAt"])})


def read_listed_jobs(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Boards of the form {"jobs": [{id, jobUrl, title, isListed, location, secondaryLocations: [{location}], descriptionHtml, publishedAt}]}; unlisted postings are left out."""
    rows = _exploded(df, F.get_json_object("body", "$.jobs"), "id string, jobUrl string, title string, isListed boolean, location string, secondaryLocations array<struct<location: string>>, descriptionHtml string, publishedAt string")
    rows = rows.filter(F.coalesce(F.col("_item.isListed"), F.lit(True)))  # a malformed one stays, for the quarantine
    i = F.col("_item")
    places = F.array_join(F.concat(F.array(F.coalesce(i["location"], F.lit(""))), F.coalesce(F.transform(i["secondaryLocations"], lambda x: x["location"]), F.expr("array()").cast("array<string>"))), "; ")
    return _split(rows, {"source_id": F.when(F.length(i["id"]) > 0, F.concat_ws(":", "board", i["id"])), "url": i["jobUrl"], "title": i["title"], "location": places, "description": html_text(i["descriptionHtml"]), "posted_date": parse_date(i["publishedAt"])})


def _leaves(facets: list, parameter: str | None) -> list[tuple]:
    out = []
    for f in facets:
        if not isinstance(f, dict):
            continue
        p = f.get("facetParameter") or parameter
        if f.get("values") is not None:
            out += _leaves(f["values"] if isinstance(f["values"], list) else [], p)
        elif f.get("id"):
            out.append((p, str(f["id"]), f.get("descriptor")))
    return out


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("parameter", "id", "descriptor")])))
def _facet_leaves(texts: pd.Series) -> pd.Series:
    def one(text: str | None) -> list:
        try:
            parsed = json.loads(text or "[]")
        except ValueError:
            parsed = []
        return [dict(zip(("parameter", "id", "descriptor"), x, strict=True)) for x in _leaves(parsed if isinstance(parsed, list) else [], None)]

    return texts.map(one)


def flatten_facets(df: DataFrame, column: str) -> DataFrame:
    """(board, parameter, id, descriptor): the leaves of facets [{facetParameter, values: [{id, descriptor, facetParameter?, values?}]}] nested to any depth, with the parameter nearest above; text that is no such list has none."""
    return df.select("board", F.explode(_facet_leaves(column)).alias("f")).select("board", "f.*")


def location_filter(leaves: DataFrame, is_ours: Column, country: str = "Canada") -> DataFrame:
    """(board, parameter, ids): how each board's search is narrowed to our places: its facet of the whole country, else for each parameter the sorted ids of the places that is_ours (a condition on descriptor) holds for. Boards with neither have no row."""
    whole = leaves.filter(F.col("descriptor") == country).groupBy("board").agg(F.min(F.struct("parameter", "id")).alias("w"))
    ours = leaves.filter(is_ours).join(whole, "board", "left_anti").groupBy("board", "parameter").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    return whole.select("board", "w.parameter", F.array("w.id").alias("ids")).unionByName(ours)


def feed_entries(df: DataFrame, column: str = "feed") -> DataFrame:
    """(entry): the entries of whole feeds; a feed without any has none."""
    return df.select(F.explode(F.regexp_extract_all(column, F.lit(r"(?s)(<entry[\s>].*?</entry>)"), F.lit(1))).alias("entry"))


def read_feed(df: DataFrame, site: str = "") -> DataFrame:
    """(source_id, url, title, updated, summary) of Atom entries, one XML text of an entry in each row of df (entry); entries without a title, or whose link doesn't start with `site` or end with a number, are left out."""
    def at(path: str) -> Column:
        return F.xpath_string("entry", F.lit(path))

    out = df.filter("entry is not null").select(at("//link/@href").alias("url"), at("//title").alias("title"), at("//updated").alias("updated"), at("//summary").alias("summary"))
    out = out.withColumn("source_id", F.regexp_extract("url", r"/(\d+)/?$", 1)).filter(F.col("url").startswith(site) & (F.col("source_id") != "") & (F.length(F.trim("title")) > 0))
    return out.select("source_id", "url", "title", parse_date("updated").alias("updated"), "summary")


def summary_field(c: Column | str, label: str) -> Column:
    """The value behind "<strong>label:</strong>" in an HTML summary; '' where it is missing."""
    import re

    c = F.col(c) if isinstance(c, str) else c
    return F.trim(F.regexp_replace(F.regexp_extract(c, rf"(?is)<strong>\s*{re.escape(label)}\s*:?\s*</strong>\s*:?\s*(.*?)(?:<br|</p|</li|$)", 1), "<[^>]*>", ""))


class _Tiles(HTMLParser):
    """Links of class "jobTitle-link" with their href, and the text of the next element of class "jobLocation"."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[dict] = []
        self.field: str | None = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = dict(attrs)
        kinds = (a.get("class") or "").split()
        if tag == "a" and "jobTitle-link" in kinds and a.get("href"):
            self.rows.append({"url": a["href"], "title": "", "location": ""})
            self.field = "title"
        elif "jobLocation" in kinds and self.rows:
            self.field = "location"

    def handle_endtag(self, tag: str) -> None:
        self.field = None

    def handle_data(self, data: str) -> None:
        if self.field:
            self.rows[-1][self.field] += data


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("url", "title", "location")])))
def _tiles(pages: pd.Series) -> pd.Series:
    def one(page: str | None) -> list:
        t = _Tiles()
        t.feed(page or "")
        t.close()
        return [{k: " ".join(v.split()) for k, v in r.items()} for r in t.rows]

    return pages.map(one)


def read_tiles(df: DataFrame, column: str = "html") -> DataFrame:
    """df's other columns with one row per result tile of a page: url, title, location. Pages without tiles give no rows."""
    rest = [c for c in df.columns if c != column]
    return df.select(*rest, F.explode(_tiles(column)).alias("_t")).select(*rest, "_t.*").filter("length(title) > 0")


def union_sources(frames: list[DataFrame], order: str = "ingest_seq") -> DataFrame:
    """All frames by name, missing columns as nulls, with a struct that keeps the frames' order (and the order of rows within one read), for any number of partitions."""
    out = None
    for n, f in enumerate(frames):
        f = f.withColumn(order, F.struct(F.lit(n).alias("source_no"), F.monotonically_increasing_id().alias("row_no")))
        out = f if out is None else out.unionByName(f, allowMissingColumns=True)
    if out is None:
        raise ValueError("no source")
    return out
