"""Deduplicating new batches against all history with a persisted inverted-file index.

Every accepted record is a point: its opening (employer, full title, place) as a one-hot coordinate of a weight that no
description distance reaches, and its description as hashed counts of distinct words, a vector of DIM small
counts under the L1 distance. Cells are formed by the opening and, within it, by rings of the distance to the
origin. As the L1 distance is a metric, a record nearer than r to a query q lies in the query's own opening and in a ring
that meets [|q| - r, |q| + r]; no other cell can hold a nearer match. Where a cell is crowded its points are met over the
shingles of their prefix only, one of which any two similar texts share. Survivors of the vector bound are held
against the exact similarity of five-word shingles.

The index is a folder of tables: cells with vectors and packed texts, keys of ids and hashes, both laid out in BUCKETS buckets,
and the counts of words that spellings are held against. A batch reads only the buckets that its own openings and keys fall into, and
no source table; afterwards it is appended. Word counts are taken once, when the index is made, so the key of
an opening is the same for ever.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quernwork.functions.text import fold_py, source_key
from quernwork.llm.openings import MOST_BROADCAST, Canonical, raw_fields, slips, with_fixes, word_counts
from quernwork.llm.places import place_rows
from quernwork.session import bounded_rows, shared_dir, stored, table

#: Words of a shingle, the similarity that makes two descriptions nearly the same, the dimension of a vector, and the growth of the rings.
SHINGLE, SIMILAR, DIM, RING = 5, 0.8, 64, 1.25
#: Descriptions of fewer words (placeholders among them) are no description.
LEAST_WORDS = 5
#: Buckets of the stored tables (an index keeps the number it was made with), the tasks that write one, and the points from which an opening is crowded.
BUCKETS, SPREAD, CROWDED = 16, 4, 64
#: p6_found delivers the postings in so many parts, in the order of their arrival; each is probed, then appended.
DELIVERIES = 2

_TAG = re.compile(r"</?[a-zA-Z!][^<>]*>|&(?:[a-z]{2,8}|#\d{1,5});")
_POINT = "ref bigint, company_key string, rest string, text_hash bigint, size int, norm int, ring int, prefix array<bigint>, vector binary, packed binary"
_TABLES = {
    "cells": "opening bigint, ring int, text_hash bigint, first bigint, size int, norm int, prefix array<bigint>, vector binary, packed binary",
    "keys": "key string, first bigint",
}


def words_of(text: str | None) -> list[str]:
    """Folded words of a text without its markup."""
    return re.findall(r"[^\W_]+", fold_py(_TAG.sub(" ", text))) if text else []


def shingles_of(words: list[str]) -> set:
    return {tuple(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))}


@lru_cache(500_000)
def _word_hash(w: str) -> int:
    return int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")


#: Odd multipliers, one for each place in a shingle; the products wrap.
_PLACE = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], dtype=np.uint64)


def shingle_hashes(words: list[str]) -> np.ndarray:
    """The distinct 64-bit hashes of a text's shingles, ascending; one for a text shorter than a shingle."""
    h = np.fromiter(map(_word_hash, words), np.uint64, len(words))
    n = max(1, len(h) - SHINGLE + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(SHINGLE, len(h))):
        out += h[k : k + n] * _PLACE[k]
    return np.unique((out ^ (out >> np.uint64(29))) * _PLACE[0])


def prefix_of(hashes: np.ndarray) -> np.ndarray:
    """The smallest hashes of a set, so many that two sets of similarity SIMILAR or more share one of them."""
    return hashes[: len(hashes) - int(np.ceil(SIMILAR * len(hashes) - 1e-9)) + 1]


def ring_of(norm: float) -> int:
    return int(np.floor(np.log(max(norm, 1)) / np.log(RING)))


def reach(words):
    """No record of similarity SIMILAR or more is farther than this in L1: an unshared distinct word stands in an unshared shingle, at most 2 x (SHINGLE - 1) words at the ends share one, and the unshared shingles of both are (1 - s) / s of one's own."""
    return (1 - SIMILAR) / SIMILAR * words + 2 * (SHINGLE - 1)


def points(df: DataFrame, places: DataFrame, found: DataFrame | None = None, once: bool = False) -> DataFrame:
    """(ref, opening, text_hash, size, norm, ring, prefix, vector, packed) of rows (ref, title, company, location, city, description).

    Rows whose employer, title, place or description is blank, or whose description has fewer than LEAST_WORDS words, name no
    opening with a description and give no point. found: slips() of the rows, or None. Counts of a
    vector end at 255, which can only bring two vectors nearer, so the bound stays one. once: copies within a batch of rows are left out,
    where all rows have the same ref.
    """
    rows = place_rows(places)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forms = Canonical(rows)
        slot = lru_cache(200_000)(lambda w: zlib.crc32(w.encode()) % DIM)
        for b in batches:
            out, met = [], set()
            for ref, t, tf, c, cf, l, y, d in zip(b["ref"], b["title"], b["title_fixes"], b["company"], b["company_fixes"], b["location"], b["city"], b["description"], strict=True):
                ws = words_of(d)
                if len(ws) < LEAST_WORDS or not (ck := forms.company(c, cf)) or not (tp := forms.title(t, tf))[0] or not (pk := forms.place(l, y)):
                    continue
                distinct = set(ws)
                v = np.minimum(np.bincount([slot(w) for w in distinct], minlength=DIM), 255).astype("u1")
                text = " ".join(ws).encode()
                if once:
                    if (key := (ck, tp, pk, text)) in met:
                        continue
                    met.add(key)
                prefix = prefix_of(shingle_hashes(ws)).view(np.int64)
                out.append((ref, ck, "|".join((*tp, pk)), _hash(text), len(ws), len(distinct), ring_of(len(distinct)), prefix, v.tobytes(), zlib.compress(text, 1)))
            yield pd.DataFrame(out, columns=["ref", "company_key", "rest", "text_hash", "size", "norm", "ring", "prefix", "vector", "packed"])

    spec = df.select("ref", "title", "company", "location", "city", "description").filter("description is not null and title is not null and company is not null")
    # 60 bits of a digest name an opening
    opening = F.conv(F.substring(F.sha1(F.concat_ws("|", "company_key", "rest")), 1, 15), 16, 10).cast("bigint")
    return with_fixes(spec, found).mapInPandas(run, _POINT).select("ref", opening.alias("opening"), "text_hash", "size", "norm", "ring", "prefix", "vector", "packed")


def _hash(b: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(b, digest_size=8).digest(), "little", signed=True)


def _distinct(df: DataFrame) -> DataFrame:
    """One point per opening and text, with the smallest ref: exact copies are one point, and a hot opening is spread over its texts."""
    return df.groupBy("opening", "text_hash").agg(F.min("ref").alias("first"), *[F.any_value(c).alias(c) for c in ("size", "norm", "ring", "prefix", "vector", "packed")])


def _within_bound(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        if len(b):
            x, y = (np.frombuffer(b"".join(b[c]), "u1").reshape(-1, DIM).astype("i2") for c in ("q_vector", "vector"))
            b = b[np.abs(x - y).sum(1, dtype="i4") <= reach(b["q_size"].to_numpy())]
        yield b[["opening", "q_text_hash", "text_hash", "first"]]


def _rerank(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def shingles(packed: bytes) -> set:
        return shingles_of(zlib.decompress(packed).decode().split(" "))

    for b in batches:
        keep = []
        for q, x in zip(b["q_packed"], b["packed"], strict=True):
            a, c = shingles(q), shingles(x)
            n = len(a & c)
            keep.append(n >= SIMILAR * (len(a) + len(c) - n))
        yield b.loc[keep, ["opening", "q_text_hash", "first"]]


def _sent(df: DataFrame, rows: int) -> DataFrame:
    """A stored table of so many rows (exact up to MOST_BROADCAST) to be met: sent to the rows where these are at most MOST_BROADCAST, else met by a shuffle."""
    return F.broadcast(df) if rows <= MOST_BROADCAST else df


def _rows(df: DataFrame) -> int:
    """The rows of a stored table, counted up to MOST_BROADCAST + 1."""
    return df.limit(MOST_BROADCAST + 1).count()


class CellIndex:
    """The stored index in a folder that all executors share. Each delivery is a part of its own, so writing one again replaces it and touches no other."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.buckets, self.parts = spark, path, buckets, 0

    def _bucket(self, key: str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def append(self, pts: DataFrame, keys: DataFrame | None = None) -> None:
        """Adds a delivery: points to the cells, keys (key, ref) to the keys, exact copies as one with the smallest ref. Earlier deliveries aren't touched.

        One shuffle brings a bucket to SPREAD tasks, a hot opening's texts to different ones, and rows are combined where they arrive.
        """
        part = F.pmod(F.col("text_hash"), F.lit(SPREAD))
        cells = pts.withColumns({"bucket": self._bucket("opening"), "_part": part}).repartition("bucket", "_part")
        columns = [F.min("ref").alias("first"), *[F.any_value(c).alias(c) for c in ("ring", "size", "norm", "prefix", "vector", "packed")]]
        cells = cells.groupBy("bucket", "_part", "opening", "text_hash").agg(*columns).drop("_part")
        cells.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/cells/delivery={self.parts}")
        if keys is not None:
            first = keys.withColumn("bucket", self._bucket("key")).groupBy("bucket", "key").agg(F.min("ref").alias("first")).repartition("bucket")
            first.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/keys/delivery={self.parts}")
        self.parts += 1

    def _held(self, name: str, key: str, asked: DataFrame) -> tuple[DataFrame, int]:
        """The buckets of a table that the keys `asked` (stored; may repeat) fall into, and the number of these keys. One job gives both; the scan skips all other buckets by their folders."""
        met = bounded_rows(asked.groupBy(self._bucket(key).alias("bucket")).count(), self.buckets, "the buckets")
        if not self.parts:
            return self.spark.createDataFrame([], _TABLES[name]), sum(r["count"] for r in met)
        held = self.spark.read.schema(f"{_TABLES[name]}, delivery int, bucket int").parquet(f"{self.path}/{name}")
        return held.filter(F.col("bucket").isin([r["bucket"] for r in met]) & (F.col("delivery") < self.parts)).drop("delivery", "bucket"), sum(r["count"] for r in met)

    def read(self, name: str, key: str, asked: DataFrame) -> DataFrame:
        """The rows of a table with one of the keys `asked` (stored; may repeat), out of their buckets."""
        held, rows = self._held(name, key, asked)
        return held.join(_sent(asked, rows), key, "left_semi")

    def probe(self, batch: DataFrame) -> DataFrame:
        """(opening, text_hash, first): for each distinct point of a batch (of _distinct, stored) the smallest ref among its near duplicates in the index and in the batch itself.

        Cells are met by an equality join on opening and ring (and, in crowded openings, a shingle of the prefix); vectors bound the distance; only
        pairs within the bound are given their texts and reranked exactly. Equal texts need neither vectors nor texts.
        """
        held, rows = self._held("cells", "opening", batch.select("opening"))
        own = batch.select(held.columns)
        near = held.join(_sent(batch.select("opening"), rows), "opening", "left_semi").unionByName(own)
        cells = near.drop("packed")
        crowd = stored(cells.groupBy("opening").agg((F.count("*") > CROWDED).alias("crowded")).filter("crowded"), "crowded")
        crowds = _rows(crowd)
        if crowds:
            crowd = _sent(crowd, crowds)

        def met(df: DataFrame) -> DataFrame:
            if not crowds:
                return df.withColumn("by", F.lit(0).cast("bigint")).drop("prefix")
            by = F.when(F.col("crowded"), F.col("prefix")).otherwise(F.array(F.lit(0).cast("bigint")))
            return df.join(crowd, "opening", "left").withColumn("by", F.explode(by)).drop("crowded", "prefix")

        r = r_of("size")
        low, high = (F.floor(F.log(F.greatest(x, F.lit(1.0))) / float(np.log(RING))).cast("int") for x in (F.col("norm") - r, F.col("norm") + r))
        asking = batch.select("opening", F.explode(F.sequence(low, high)).alias("ring"), "prefix", F.col("text_hash").alias("q_text_hash"), F.col("size").alias("q_size"), F.col("norm").alias("q_norm"), F.col("vector").alias("q_vector"))
        meet = met(asking).join(met(cells.drop("size")), ["opening", "ring", "by"])
        meet = meet.filter((F.col("q_text_hash") != F.col("text_hash")) & (F.abs(F.col("q_norm") - F.col("norm")) <= r_of("q_size")))
        meet = meet.select("opening", "q_text_hash", "q_size", "q_vector", "text_hash", "first", "vector")
        bounded = stored(meet.mapInPandas(_within_bound, "opening bigint, q_text_hash bigint, text_hash bigint, first bigint").distinct(), "bounded")
        # few pairs and few points go to the buckets' rows themselves, many to those of the openings asked for
        number = _rows(bounded)
        q_texts = batch.select("opening", F.col("text_hash").alias("q_text_hash"), F.col("packed").alias("q_packed"))
        texts = (held.unionByName(own) if number <= MOST_BROADCAST else near).select("opening", "text_hash", "packed")
        x_texts = texts.join(_sent(bounded.select("opening", "text_hash"), number), ["opening", "text_hash"], "left_semi").dropDuplicates(["opening", "text_hash"])
        if number > MOST_BROADCAST:
            q_texts = q_texts.join(bounded.select("opening", "q_text_hash"), ["opening", "q_text_hash"], "left_semi")
        pairs = q_texts.join(_sent(bounded, number), ["opening", "q_text_hash"]).join(x_texts, ["opening", "text_hash"]).select("opening", "q_text_hash", "q_packed", "packed", "first")
        exact = pairs.mapInPandas(_rerank, "opening bigint, q_text_hash bigint, first bigint")
        equal = (held.unionByName(own) if rows <= MOST_BROADCAST else near).select("opening", "text_hash", "first")
        same = equal.join(_sent(batch.select("opening", "text_hash"), rows), ["opening", "text_hash"]).withColumnRenamed("text_hash", "q_text_hash")
        return exact.unionByName(same).groupBy("opening", F.col("q_text_hash").alias("text_hash")).agg(F.min("first").alias("first"))


def r_of(size: str) -> Column:
    """reach() of a column."""
    return F.lit((1 - SIMILAR) / SIMILAR) * F.col(size) + 2 * (SHINGLE - 1)


#: Prefixes that some sources set before an id.
_PREFIX = r"^(?:in|li|gd|zr)[-_]?(?=[0-9a-f]{6,}$)"


def with_id_key(df: DataFrame, source: str, source_id: str, name: str = "id") -> DataFrame:
    """df with a link's id however it is written: case, blanks, an escaped or replaced separator, a URL around it and a source's prefix carry no meaning. Null for blank ids and sources."""
    out = df.withColumn("_t", F.lower(F.regexp_replace(F.regexp_replace(source_id, r"[\s\u00a0]+", ""), "(?i)%3a", ":")))
    out = out.withColumn("_host", F.regexp_extract("_t", r"^[a-z]+://([^/?#]+)", 1))
    out = out.withColumn("_query", F.regexp_extract("_t", r"[?&](?:jk|id|jid|jobid|gh_jid|vjk)=([^&#]+)", 1))
    out = out.withColumn("_bare", F.when(F.col("_query") != "", F.col("_query")).otherwise(F.regexp_extract("_t", r"/([^/?#]+)/?(?:[?#].*)?$", 1)))
    board = F.regexp_extract("_host", r"^(?!www\.)([^.]+)\.[^.]+\.", 1)
    from_url = F.when((board != "") & ~F.col("_bare").contains(":"), F.concat(board, F.lit(":"), F.col("_bare"))).otherwise(F.col("_bare"))
    out = out.withColumn("_id", F.regexp_replace(F.when(F.col("_host") != "", from_url).otherwise(F.regexp_replace("_t", "[/|]", ":")), _PREFIX, ""))
    out = out.withColumn(name, F.when(F.col("_id") != "", F.concat(F.nullif(source_key(source), F.lit("")), F.lit("|"), F.col("_id"))))
    return out.drop("_t", "_host", "_query", "_bare", "_id")


_FIELDS = ["title", "company", "location", "city", "description"]


def keys_of(df: DataFrame, ref: Column, source: str | None = None, source_id: str | None = None, content_hash: str | None = None) -> DataFrame:
    """(key, ref): the keys under which a record is found again, its id at its source and its content hash. Null and blank ones give none."""
    both = []
    if source_id:
        df = with_id_key(df, source, source_id, "_id_key")
        both.append(F.concat(F.lit("i|"), F.col("_id_key")))
    if content_hash:
        both.append(F.concat(F.lit("h|"), F.nullif(F.trim(content_hash), F.lit(""))))
    return df.select(ref.alias("ref"), F.explode(F.array_compact(F.array(*both))).alias("key"))


def _first(keys: DataFrame) -> DataFrame:
    return keys.groupBy("key").agg(F.min("ref").alias("first"))


class History:
    """All that was ever accepted, as an index on disk.

    History.create() makes one from the tables accepted so far and History.open() takes up a stored one, without these tables.
    Accepted rows have ref -1, postings their ingest_seq, so a single order holds for all: a posting repeats where the
    first ref of one of its keys or near duplicates is smaller than its own.
    """

    def __init__(self, spark: SparkSession, path: str, places: DataFrame, buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.places, self.index = spark, path, places, CellIndex(spark, path, buckets)

    @classmethod
    def create(cls, spark: SparkSession, path: str, places: DataFrame, jobs: DataFrame, links: DataFrame, buckets: int = BUCKETS) -> History:
        """An index of jobs (title, company, location, city, description, content_hash) and links (source, source_id, raw). The words of jobs are the spellings that later ones are held against."""
        out = cls(spark, path, places, buckets)
        word_counts(jobs).write.mode("overwrite").parquet(f"{path}/words")
        old = F.lit(-1).cast("bigint")
        records = jobs.select(old.alias("ref"), *_FIELDS).unionByName(raw_fields(links.filter("raw is not null")).select(old.alias("ref"), *_FIELDS))
        keys = keys_of(jobs, old, content_hash="content_hash").unionByName(keys_of(links, old, "source", "source_id"))
        out.index.append(out._points(records, once=True), keys)
        return out

    @classmethod
    def open(cls, spark: SparkSession, path: str, places: DataFrame, deliveries: int, buckets: int = BUCKETS) -> History:
        """A stored index that holds so many deliveries, the first one included. places must be the list that it was made with."""
        out = cls(spark, path, places, buckets)
        out.index.parts = deliveries
        return out

    def _points(self, records: DataFrame, once: bool = False) -> DataFrame:
        counts = self.spark.read.schema("column string, w string, count bigint").parquet(f"{self.path}/words")
        return points(records, self.places, slips([records], counts), once)

    def deliver(self, postings: DataFrame) -> DataFrame:
        """(ingest_seq): the postings of a batch that repeat something accepted before or a posting of the batch with a smaller ingest_seq; then the batch is accepted itself.

        A repeat has the same source and id, or the same content hash, or is the same opening with a description of similarity
        SIMILAR. Null ids, hashes and descriptions repeat nothing. Reads only the buckets that the batch falls into.
        """
        keys = stored(keys_of(postings, F.col("ingest_seq"), "source", "source_id", "content_hash"), "batch-keys")
        held = self.index.read("keys", "key", keys.select("key")).withColumnRenamed("first", "ref")
        first = held.unionByName(keys.select("key", "ref")).groupBy("key").agg(F.min("ref").alias("first"))
        by_key = keys.join(first, "key").filter("first < ref").select("ref")
        pts = stored(self._points(postings.select(F.col("ingest_seq").alias("ref"), *_FIELDS)), "batch-points")
        near = self.index.probe(stored(_distinct(pts), "batch-cells"))
        by_text = pts.select("ref", "opening", "text_hash").join(near, ["opening", "text_hash"]).filter("first < ref").select("ref")
        found = by_key.unionByName(by_text).select(F.col("ref").alias("ingest_seq")).distinct()
        self.index.append(pts, keys)
        return found


def repeats(postings: DataFrame, jobs: DataFrame, links: DataFrame, places: DataFrame, path: str, deliveries: int = DELIVERIES) -> DataFrame:
    """(ingest_seq): postings that repeat a row of jobs or links or a posting with a smaller ingest_seq.

    An index of jobs and links is made at `path` and then given the postings in `deliveries` parts in the order of
    ingest_seq. Where the parts end has no influence on the rows.
    """
    history = History.create(postings.sparkSession, path, places, jobs, links)
    cuts = [k / deliveries for k in range(1, deliveries)]
    ends = (postings.agg(F.percentile_approx("ingest_seq", cuts).alias("q")).first().q or []) if cuts else []
    edges = [None, *sorted(set(ends)), None]
    found = None
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        part = postings.filter((F.lit(True) if lo is None else F.col("ingest_seq") > lo) & (F.lit(True) if hi is None else F.col("ingest_seq") <= hi))
        rows = history.deliver(part)
        found = rows if found is None else found.unionByName(rows)
    return found


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings that repeat something accepted before."""
    import uuid

    path = f"{shared_dir(spark)}/quernwork-{uuid.uuid4().hex}/history"
    return repeats(*(table(spark, sf_dir, t) for t in ("postings", "jobs", "job_sources", "places")), path)


def p6_repeats_by_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every batch its postings and its repeats."""
    posts = table(spark, sf_dir, "postings").select("ingest_seq", "batch_id")
    found = p6_found(spark, sf_dir).withColumn("repeat", F.lit(1))
    return posts.join(found, "ingest_seq", "left").groupBy("batch_id").agg(F.count("*").alias("postings"), F.count("repeat").alias("repeats"))


QUERIES = {"p6_found": p6_found, "p6_repeats_by_batch": p6_repeats_by_batch}
