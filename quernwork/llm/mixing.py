"""Mixing sources to target weights by Poisson replication.

Each document is repeated k times, k drawn from a Poisson distribution by inverting it at a uniform number hashed from the
seed and the document's id: reproducible, independent of partitions, without a shuffle until the mixture is put in
its global random order.
"""

from __future__ import annotations

import math
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quernwork.functions.text import source_key
from quernwork.session import bounded_rows, stored, table

#: A folder with the public tokenizers' files, and the one that sizes are counted with.
TOKENIZERS = os.environ.get("QUERNWORK_TOKENIZERS", "/opt/tokenizers")
TOKENIZER = "byte_bpe_50k.json"
#: Sources of a target list on the driver.
MOST_SOURCES = 10_000


def token_counts(df: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id", "source"), path: str | None = None) -> DataFrame:
    """(keep..., tokens): each text's size in tokens of a public tokenizer, whole texts; 0 for null and blank ones."""
    path = path or f"{TOKENIZERS}/{TOKENIZER}"
    schema = ", ".join(f"`{c}` {t}" for c, t in df.select(*keep).dtypes) + ", tokens bigint"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        for b in batches:
            texts = [x if x and x.strip() else "" for x in b["_text"]]
            yield b[list(keep)].assign(tokens=[len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)])

    return df.select(*keep, F.col(text_col).alias("_text")).mapInPandas(run, schema)


def _pmf(rate: float, most: int) -> np.ndarray:
    """Poisson probabilities of 0, 1, ... most - 1, by their logarithms, so that no rate is too large."""
    k = np.arange(most, dtype=float)
    return np.exp(k * math.log(rate) - rate - np.concatenate([[0.0], np.cumsum(np.log(k[1:]))])) if rate > 0 and most else (k == 0).astype(float)


def capped_mean(rate: float, cap: int) -> float:
    """The mean of min(K, cap) for K Poisson with this rate."""
    p = _pmf(rate, cap)
    return float(np.arange(cap) @ p + cap * max(0.0, 1 - p.sum()))


def rate_for(mean: float, cap: int) -> float:
    """The Poisson rate whose capped mean is `mean`; infinite where the cap can't give it."""
    if mean <= 0 or cap <= 0:
        return 0.0
    if mean >= cap:
        return math.inf
    lo, hi = 0.0, max(1.0, mean)
    while capped_mean(hi, cap) < mean and hi < 2.0**60:
        lo, hi = hi, hi * 2
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if capped_mean(mid, cap) < mean else (lo, mid)
    return (lo + hi) / 2


def reachable(wanted: dict[str, float], most: dict[str, float]) -> dict[str, float]:
    """Sizes in proportion to what is wanted, none above its most: what the sources at their cap leave over goes to the others by their weights."""
    out, free, total = {}, dict(wanted), sum(wanted.values())
    while free:
        weight = sum(free.values())
        full = {k for k in free if most[k] <= total * free[k] / weight} if weight else set(free)
        if not full:
            return out | {k: total * w / weight for k, w in free.items()}
        for k in full:
            out[k] = min(most[k], total)
            total -= out[k]
            del free[k]
    return out


def _uniform(seed: int, *cols: Column | str) -> Column:
    """A number in [0, 1) hashed from the seed and the columns."""
    return F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(2**40)) / float(2**40)


def plan_mix(sizes: DataFrame, targets: DataFrame, total_tokens: float | None = None) -> list[dict]:
    """For each target source: tokens and documents at hand, wanted tokens, mean repetition, Poisson rate and cumulative probabilities.

    sizes (source, tokens); the mixture is to have total_tokens, by default as many as the listed sources have.
    Source names are compared without case, blanks and separators. Sources without documents and sources not listed get and give nothing.
    """
    rows = bounded_rows(targets.select("source", "weight", "max_repeats", source_key("source").alias("key")).filter("weight > 0"), MOST_SOURCES, "the targets")
    # only the targets' sums reach the driver, however many sources the documents have
    listed = sizes.sparkSession.createDataFrame([(k,) for k in {r.key for r in rows} if k is not None], "key string")
    known = sizes.filter("tokens > 0").withColumn("key", source_key("source")).join(F.broadcast(listed), "key")
    sums = known.groupBy("key").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("documents"))
    have = {r.key: (r.tokens, r.documents) for r in bounded_rows(sums, MOST_SOURCES, "the targets' documents by source")}
    total = total_tokens if total_tokens is not None else sum(have.get(k, (0, 0))[0] for k in {r.key for r in rows})
    weights = sum(r.weight for r in rows)
    out = []
    for r in rows:
        tokens, documents = have.get(r.key, (0, 0))
        wanted = total * r.weight / weights if weights else 0.0
        mean = min(wanted / tokens, float(r.max_repeats)) if tokens else 0.0
        rate = rate_for(mean, r.max_repeats)
        steps = [1.0] * r.max_repeats if rate == 0 else [0.0] * r.max_repeats if math.isinf(rate) else np.cumsum(_pmf(rate, r.max_repeats)).tolist()
        out.append({"key": r.key, "source": r.source, "share": r.weight / weights, "max_repeats": r.max_repeats, "tokens": int(tokens), "documents": int(documents), "wanted": wanted, "mean": mean, "steps": steps})
    filled = reachable({p["source"]: p["wanted"] for p in out}, {p["source"]: float(p["tokens"] * p["max_repeats"]) for p in out})
    return [p | {"reachable": filled[p["source"]]} for p in out]


def repeats(sizes: DataFrame, plan: list[dict], seed: int) -> DataFrame:
    """sizes (doc_id, source, tokens) of the listed sources with `times`: how often each document is used, at most max_repeats; the inverse of the source's capped Poisson distribution at the document's own number."""
    spark = sizes.sparkSession
    known = spark.createDataFrame([(p["key"], p["steps"]) for p in plan], "_key string, _steps array<double>")
    drawn = sizes.filter("tokens > 0").withColumn("_key", source_key("source")).join(F.broadcast(known), "_key")
    u = _uniform(seed, "doc_id")
    return drawn.withColumn("_u", u).withColumn("times", F.expr("size(filter(_steps, x -> x <= _u))")).drop("_steps", "_u", "_key")


def mixture(sizes: DataFrame, plan: list[dict], seed: int = 1) -> DataFrame:
    """(doc_id, source, tokens, copy, position): every document as often as it is used, in a global order drawn from the seed. position is a 64-bit number to sort by; rows come range-partitioned and sorted by it."""
    copies = repeats(sizes, plan, seed).filter("times > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).drop("times")
    return copies.withColumn("position", F.xxhash64(F.lit(seed + 1), "doc_id", "copy")).orderBy("position")


def shares(mixed: DataFrame, plan: list[dict]) -> DataFrame:
    """One row per target source, counted in the mixture itself (of mixture()): target share, share reached, and the share reachable where what capped sources leave over goes to the others; tokens at hand, wanted and used, shortfall, and the largest number of uses.

    Target shares refer to the planned total, reached ones to the mixture's, reachable ones to the total under the caps.
    """
    spark = mixed.sparkSession
    # a document's copies first, so that a source's sums need only one row a document
    each = mixed.groupBy("source", "doc_id").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("times"))
    used = each.groupBy(source_key("source").alias("_key")).agg(F.sum("tokens").alias("used"), F.count("*").alias("documents_used"), F.max("times").cast("int").alias("most_uses"))
    total = sum(p["reachable"] for p in plan)
    rows = [(p["key"], p["source"], p["share"], p["reachable"] / total if total else 0.0, p["max_repeats"], p["documents"], p["tokens"], p["wanted"], p["mean"]) for p in plan]
    known = spark.createDataFrame(rows, "_key string, source string, target_share double, reachable double, max_repeats int, documents bigint, tokens bigint, wanted_tokens double, mean_repeats double")
    # the listed sources only: a row for each target
    out = known.join(used, "_key", "left").withColumn("used_tokens", F.coalesce("used", F.lit(0)).cast("bigint"))
    whole = out.agg(F.sum("used_tokens").alias("_total"))
    return out.crossJoin(F.broadcast(whole)).select(
        "source",
        F.round("target_share", 6).alias("target_share"),
        F.round(F.when(F.col("_total") > 0, F.col("used_tokens") / F.col("_total")).otherwise(0.0), 6).alias("achieved_share"),
        F.round("reachable", 6).alias("reachable_share"),
        "max_repeats", "documents", "tokens",
        F.round("wanted_tokens").cast("bigint").alias("wanted_tokens"),
        "used_tokens",
        F.greatest(F.round(F.col("wanted_tokens")).cast("bigint") - F.col("used_tokens"), F.lit(0)).alias("shortfall_tokens"),
        F.round("mean_repeats", 6).alias("mean_repeats"),
        F.coalesce("documents_used", F.lit(0)).alias("documents_used"),
        F.coalesce("most_uses", F.lit(0)).alias("most_uses"),
    )


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[dict]]:
    sizes = stored(token_counts(table(spark, sf_dir, "documents")), "token-counts")
    plan = plan_mix(sizes, table(spark, sf_dir, "mix_targets"))
    return mixture(sizes, plan), plan


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The achieved shares of the mixture of documents to the weights of mix_targets, shortfalls included; the mixture is written and then counted."""
    mixed, plan = _mixed(spark, sf_dir)
    return shares(stored(mixed, "mixture"), plan)


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture itself in its global order."""
    return _mixed(spark, sf_dir)[0]


QUERIES = {"p8_shares": p8_shares, "p8_mixture": p8_mixture}
