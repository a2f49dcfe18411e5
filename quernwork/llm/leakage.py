"""Evaluation texts leaking into training text: a positional inverted index and its intersection from the rarest terms.

Text is compared in terms: words, and for scripts without spaces characters, both folded. A passage of N terms with
at most one of them changed, added or left out holds an unbroken run of at least (N - 1) // 2 terms, so every
leak contains a phrase of that length exactly. Phrases are found in the postings by intersecting
offset-adjusted lists, rarest term first; the documents that survive are aligned exactly.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quernwork.functions.text import fold_py
from quernwork.session import bounded_rows, stored, table

#: So many evaluation items are searched at once (they and their phrases travel to all tasks); more are searched one part after the other.
MOST_ITEMS = 20_000
_CJK = r"[぀-ヿ㐀-䶿一-鿿豈-﫿]"


@dataclass(frozen=True)
class Unit:
    """How a kind of text is cut into terms. passage: running terms that make a leak; slip: longest gap, in terms, that is one word."""

    name: str
    passage: int
    slip: int

    @property
    def seed(self) -> int:
        return (self.passage - self.slip) // 2

    def holds(self, c: Column) -> Column:
        """Whether a text can hold such a passage at all."""
        return F.length(c) >= self.passage if self.name == "word" else c.rlike(_CJK)


WORDS, CHARS = Unit("word", 14, 1), Unit("char", 20, 2)


#: One row of the stored index: the postings of a shard of documents. A document's terms stand at consecutive places, two documents at least GAP apart.
_SHARD = "docs array<%s>, bases array<bigint>, terms array<string>, starts array<int>, places array<int>"
#: More than any passage has terms: no phrase reaches from one document into the next.
GAP = 64


def terms_of(text: str | None, unit: Unit) -> list[str]:
    """Folded terms of a text."""
    return re.findall(r"[^\W_]+" if unit.name == "word" else r"[^\W_]", fold_py(text))


def build_index(docs: DataFrame, unit: Unit, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The positional inverted index of all terms, stored in the shared folder, sharded by document: each row holds for a batch of documents the places of every term.

    One pass without a shuffle; any number of item sets can be searched in it. Null and blank texts have no postings.
    """
    kind = dict(docs.dtypes)[id_col]

    def invert(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids, bases, at, flat, place = [], [], 0, [], []
            for i, t in zip(b["id"], b["text"], strict=True):
                ts = terms_of(t, unit)
                if not ts:
                    continue
                ids.append(i)
                bases.append(at)
                flat += ts
                place.append(np.arange(at, at + len(ts), dtype=np.int32))
                at += len(ts) + GAP
            if not ids:
                continue
            codes, names = pd.factorize(np.array(flat, dtype=object))
            order = np.argsort(codes, kind="stable")
            starts = np.concatenate([[0], np.cumsum(np.bincount(codes))]).astype(np.int32)
            yield pd.DataFrame({"docs": [ids], "bases": [bases], "terms": [names.tolist()], "starts": [starts], "places": [np.concatenate(place)[order]]})

    spec = docs.filter(unit.holds(F.col(text_col))).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return stored(spec.mapInPandas(invert, _SHARD % kind), f"postings-{unit.name}")


def term_counts(index: DataFrame, terms: set[str]) -> DataFrame:
    """(term, n): postings of the given terms (a bounded set) in all shards."""
    wanted = F.broadcast(index.sparkSession.createDataFrame([(t,) for t in sorted(terms)], "term string"))
    ends = F.arrays_zip(F.col("terms").alias("term"), F.slice("starts", 2, F.size("terms")).alias("b"), F.slice("starts", 1, F.size("terms")).alias("a"))
    return index.select(F.explode(ends).alias("x")).select("x.*").join(wanted, "term").groupBy("term").agg(F.sum(F.col("b") - F.col("a")).alias("n"))


def phrase_hits(index: DataFrame, seeds: list[tuple], id_type: str, item_type: str) -> DataFrame:
    """(doc_id, item_id) of documents with a whole phrase. seeds: (item, terms rarest first, their offsets from the rarest).

    Lists are intersected from the rarest term at adjusted offsets, and only phrases are looked at whose rarest term a shard
    has; equal phrases of several items are intersected once. The phrases travel once to every executor.
    """
    by_phrase: dict[tuple, set] = defaultdict(set)
    for item, terms, offsets in seeds:
        by_phrase[terms, offsets].add(item)
    by_rarest: dict[str, list] = defaultdict(list)
    for (terms, offsets), items in by_phrase.items():
        by_rarest[terms[0]].append((terms[1:], offsets[1:], items))
    sent = index.sparkSession.sparkContext.broadcast((dict(by_rarest), frozenset(t for terms, _ in by_phrase for t in terms)))

    def intersect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        phrases, known = sent.value
        for b in batches:
            out = set()
            for row in b.itertuples(index=False):
                bases, starts, places = np.asarray(row.bases), row.starts, np.asarray(row.places)
                lists = {t: places[starts[k] : starts[k + 1]] for k, t in enumerate(row.terms) if t in known}
                for rarest, first in lists.items():
                    for terms, offsets, items in phrases.get(rarest, ()):
                        at = first
                        for t, off in zip(terms, offsets, strict=True):
                            other = lists.get(t)
                            if other is None:
                                at = at[:0]
                            else:
                                k = np.searchsorted(other, at + off)
                                at = at[(k < len(other)) & (other[np.minimum(k, len(other) - 1)] == at + off)]
                            if not len(at):
                                break
                        for d in set((np.searchsorted(bases, at, side="right") - 1).tolist()):
                            out |= {(row.docs[d], item) for item in items}
            yield pd.DataFrame(sorted(out, key=str), columns=["doc_id", "item_id"])

    return index.mapInPandas(intersect, f"doc_id {id_type}, item_id {item_type}")


def _runs(item: list[str], doc: list[str], unit: Unit) -> bool:
    """Whether doc contains a passage of the item: unit.passage running terms with at most one word changed, added or left out."""
    at: dict[str, list[int]] = {}
    for i, t in enumerate(item):
        at.setdefault(t, []).append(i)
    ends: dict[tuple[int, int], int] = {}  # (item end, doc end) of the run that ends there -> its length
    before: dict[int, int] = {}  # item position -> length of the run that ends there in the previous column
    for j, t in enumerate(doc):
        now = {i: before.get(i - 1, 0) + 1 for i in at.get(t, ())}
        for i, n in now.items():
            if n >= unit.passage:
                return True
            ends[i, j] = n
        before = now
    # two runs and one slip between them: the second run starts behind a gap of gi terms of the item and gj of the document
    gaps = [(gi, gj) for gi in range(unit.slip + 1) for gj in range(unit.slip + 1) if gi or gj]
    for (i, j), n in ends.items():
        if (i + 1, j + 1) in ends:  # the run goes on
            continue
        for gi, gj in gaps:  # i - n, j - n: the terms before this run
            first = ends.get((i - n - gi, j - n - gj), 0)
            if first and first + n + gi >= unit.passage:
                return True
    return False


def leaks(docs: DataFrame, items: DataFrame, unit: Unit, id_col: str = "doc_id", text_col: str = "text", index: DataFrame | None = None) -> DataFrame:
    """(doc_id, item_id): documents that contain at least unit.passage running terms of an item, at most one word of them changed, added or left out.

    items (item_id, text) may be of any number: MOST_ITEMS of them are searched at a time, all in the one index of all terms
    (build_index(), made here unless it is given). Phrases are intersected from their rarest term within each shard, and only documents
    with a whole phrase are aligned. No postings are shuffled. Items shorter than a passage, null and blank texts give nothing; repeated items and
    documents give each pair once; ties in rarity are broken by the term.
    """
    kind = dict(docs.dtypes)[id_col]
    usable = items.select("item_id", "text").filter("text is not null").distinct()
    empty = docs.sparkSession.createDataFrame([], f"doc_id {kind}, item_id {dict(items.dtypes)['item_id']}")
    groups = max(1, -(-usable.count() // MOST_ITEMS))
    if index is None and usable.head(1):
        index = build_index(docs, unit, id_col, text_col)
    # groups by hash are uneven: twice the mean bounds them
    parts = [usable] if groups == 1 else [usable.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(2 * groups)) == g) for g in range(2 * groups)]
    found = [x for p in parts if (x := _search(docs, index, p, unit, id_col, text_col, empty)) is not None]
    return reduce(DataFrame.unionByName, found, empty).distinct() if found else empty


def _search(docs: DataFrame, index: DataFrame, items: DataFrame, unit: Unit, id_col: str, text_col: str, empty: DataFrame) -> DataFrame | None:
    """leaks() of a bounded number of items."""
    kind = dict(docs.dtypes)[id_col]
    rows = bounded_rows(items, MOST_ITEMS, "the evaluation items")
    known = {(r.item_id, ts) for r in rows if len(ts := tuple(terms_of(r.text, unit))) >= unit.passage}
    if not known:
        return None
    counts = {r.term: r.n for r in term_counts(index, {t for _, ts in known for t in ts}).collect()}  # at most the items' terms
    seeds = set()
    for item, terms in known:
        for i in range(len(terms) - unit.seed + 1):
            window = terms[i : i + unit.seed]
            if all(t in counts for t in window):
                order = sorted(range(unit.seed), key=lambda k: (counts[window[k]], window[k], k))
                seeds.add((item, tuple(window[k] for k in order), tuple(k - order[0] for k in order)))
    if not seeds:
        return None
    pairs = phrase_hits(index, sorted(seeds), kind, dict(items.dtypes)["item_id"]).distinct()

    by_id: dict = {}
    for item, terms in known:
        by_id.setdefault(item, []).append(list(terms))
    sent = docs.sparkSession.sparkContext.broadcast(by_id)

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keep = [any(_runs(item, terms_of(t, unit), unit) for item in sent.value[i]) for i, t in zip(b["item_id"], b["text"], strict=True)]
            yield b.loc[keep, ["doc_id", "item_id"]]

    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return texts.join(pairs, "doc_id").mapInPandas(check, empty.schema)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that contain a passage of an evaluation item."""
    docs, items = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "eval_items")
    wide = F.col("text").rlike(_CJK)
    return leaks(docs, items.filter(~wide), WORDS).unionByName(leaks(docs, items.filter(wide), CHARS))


def p7_items_leaked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every evaluation item the number of documents that leak it, 0 included."""
    items = table(spark, sf_dir, "eval_items").select("item_id", "lang").distinct()
    found = p7_found(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("n"))
    return items.join(found, "item_id", "left").select("item_id", "lang", F.coalesce("n", F.lit(0)).cast("bigint").alias("documents"))


QUERIES = {"p7_found": p7_found, "p7_items_leaked": p7_items_leaked}
