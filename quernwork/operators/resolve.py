"""Identity, survivorship, change detection and merges, set-based.

Order within a batch is `seq`; every operator is a closed form over it, so nothing is replayed row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quernwork.functions.jobtext import content_hash, dedupe_key, entity_id

MATERIAL = ["title", "description", "company", "city", "location", "salary", "job_type"]


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the first in `order` (which must be unique within a key). Aggregated map-side, so a hot key costs one row a task."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min(F.struct(*order, *[c for c in rest if c not in order])).alias("_r"))
    return best.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def latest_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the last in `order`."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max(F.struct(*order, *[c for c in rest if c not in order])).alias("_r"))
    return best.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def resolve_identity(postings: DataFrame, links: DataFrame) -> DataFrame:
    """postings (source, source_id, title, company, city, seq, ...) with entity_id.

    A known (source, source_id) keeps its entity. A new one gets the id of its key, unless that id already has a link of the same
    source, known or earlier in the batch: then an id of its own, from key, source and source_id. links: (source, source_id, entity_id).
    """
    key = dedupe_key("company", "title", "city")
    known = links.filter("entity_id is not null").groupBy("source", "source_id").agg(F.min("entity_id").alias("_known"))
    held = links.filter("entity_id is not null").select("source", F.col("entity_id").alias("_keyed")).distinct().withColumn("_held", F.lit(True))
    named = postings.withColumn("_key", key).withColumn("_keyed", entity_id(F.col("_key")))
    named = named.join(known, ["source", "source_id"], "left").join(held, ["source", "_keyed"], "left")
    # the first new link of a source under a key; later ones get their own ids
    firsts = named.filter("_known is null").groupBy("source", "_keyed").agg(F.min(F.struct("seq", "source_id")).alias("_first"))
    named = named.join(firsts, ["source", "_keyed"], "left")
    own = entity_id(F.concat_ws("|", "_key", "source", "source_id"))
    first = ~F.coalesce("_held", F.lit(False)) & (F.col("source_id") == F.col("_first.source_id"))
    return named.withColumn("entity_id", F.coalesce("_known", F.when(first, F.col("_keyed")).otherwise(own))).drop("_key", "_keyed", "_known", "_held", "_first")


def survive(sightings: DataFrame) -> DataFrame:
    """One row per entity_id from its sightings (entity_id, source, seq and the posting fields).

    The primary source is the first one's. title, city: its last value, even blank; company, location: its last non-blank value, else the
    first value; description, salary, job_type: its last non-blank value, else the first non-blank one of any source;
    posted_date: the first that is known; url: the first. Null counts as blank.
    """
    primary = sightings.groupBy("entity_id").agg(F.min_by("source", "seq").alias("primary_source"))
    df = sightings.join(primary, "entity_id")
    mine = F.col("source").eqNullSafe(F.col("primary_source"))

    def value(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(""))

    def filled(c: str) -> Column:
        return F.length(F.trim(value(c))) > 0

    def last_own(c: str, only_filled: bool) -> Column:
        return F.max_by(value(c), F.when(mine & (filled(c) if only_filled else F.lit(True)), F.col("seq")))

    aggs = [F.first("primary_source").alias("primary_source")]
    aggs += [last_own(c, False).alias(c) for c in ("title", "city")]
    aggs += [F.coalesce(last_own(c, True), F.min_by(value(c), F.col("seq"))).alias(c) for c in ("company", "location")]
    aggs += [F.coalesce(last_own(c, True), F.min_by(value(c), F.when(filled(c), F.col("seq"))), F.lit("")).alias(c) for c in ("description", "salary", "job_type")]
    aggs += [F.min_by("posted_date", F.when(F.col("posted_date").isNotNull(), F.col("seq"))).alias("posted_date"), F.min_by(value("url"), F.col("seq")).alias("url")]
    return df.groupBy("entity_id").agg(*aggs)


def change_labels(new: DataFrame, old: DataFrame, key: str) -> DataFrame:
    """(key, label): new, changed or seen, by the hash of the material fields. Endpoints are compared: A to B to A within one batch is "seen"."""
    a = new.select(key, content_hash(*MATERIAL).alias("_new"))
    b = old.select(key, content_hash(*MATERIAL).alias("_old"))
    return a.join(b, key, "left").select(key, F.when(F.col("_old").isNull(), "new").when(F.col("_old") != F.col("_new"), "changed").otherwise("seen").alias("label"))


def merge_links(old: DataFrame, new: DataFrame) -> DataFrame:
    """The link table after a batch: (source, source_id, url, raw, apply_url, first_seen, last_seen, gone_at).

    Of each link the batch's last sighting by seq counts: url and raw are overwritten, last_seen moves only where it was really seen,
    apply_url keeps the old one if the new is blank, gone_at is cleared by a real sighting in a full listing. new
    has seq, seen (boolean), full_listing (boolean) and seen_at besides.
    """
    last = latest_wins(new, ["source", "source_id"], ["seq"]).select("source", "source_id", *[F.col(c).alias(f"n_{c}") for c in ("url", "raw", "apply_url", "seen", "full_listing", "seen_at")])
    both = old.join(last, ["source", "source_id"], "full_outer")
    touched, seen = F.col("n_seen").isNotNull(), F.coalesce("n_seen", F.lit(False))
    return both.select(
        "source", "source_id",
        F.when(touched, F.col("n_url")).otherwise(F.col("url")).alias("url"),
        F.when(touched, F.col("n_raw")).otherwise(F.col("raw")).alias("raw"),
        F.coalesce(F.nullif("n_apply_url", F.lit("")), "apply_url").alias("apply_url"),
        F.coalesce("first_seen", "n_seen_at").alias("first_seen"),
        F.when(seen | F.col("last_seen").isNull(), F.greatest("last_seen", "n_seen_at")).otherwise(F.col("last_seen")).alias("last_seen"),
        F.when(seen & F.coalesce("n_full_listing", F.lit(False)), F.lit(None)).otherwise(F.col("gone_at")).alias("gone_at"),
    )


def merge_rejected(old: DataFrame, new: DataFrame, accepted: DataFrame) -> DataFrame:
    """The table of rejected postings after a batch: (source, source_id, reason, first_seen, last_seen).

    first_seen stays, last_seen moves only where the posting was really seen; links in `accepted` (source, source_id) leave the table. new: source, source_id, reason, seq, seen, seen_at.
    """
    per = new.groupBy("source", "source_id").agg(
        F.max_by("reason", "seq").alias("n_reason"), F.min("seen_at").alias("n_first"), F.max(F.when(F.col("seen"), F.col("seen_at"))).alias("n_last")
    )
    both = old.join(per, ["source", "source_id"], "full_outer").join(accepted.select("source", "source_id").distinct(), ["source", "source_id"], "left_anti")
    first = F.coalesce("first_seen", "n_first")
    return both.select("source", "source_id", F.coalesce("n_reason", "reason").alias("reason"), first.alias("first_seen"), F.coalesce(F.greatest("last_seen", "n_last"), first).alias("last_seen"))


def prune(rejected: DataFrame, now: Column, days: int = 60) -> DataFrame:
    """Rejected postings last seen within so many days, the boundary included."""
    return rejected.filter(F.col("last_seen") >= now - F.make_dt_interval(F.lit(days)))


def reopened(seen: Column, closed_at: Column, by_employer: Column, full_listing: Column, now: Column, days: int = 7) -> Column:
    """Whether a sighting opens a closed record again: any real one, but after an employer's closure only one in a full listing or after so many days."""
    return F.coalesce(seen, F.lit(False)) & closed_at.isNotNull() & (~F.coalesce(by_employer, F.lit(False)) | F.coalesce(full_listing, F.lit(False)) | (now - closed_at >= F.make_dt_interval(F.lit(days))))


def replay(raw: DataFrame, order: list[str]) -> DataFrame:
    """raw rows with seq, the rank of their first sighting over all rows. The rank comes from counts of each value of the leading order column, not from one sorted task."""
    lead, *rest = order
    counts = raw.groupBy(lead).count()
    before = counts.withColumn("_b", F.sum("count").over(W.orderBy(F.col(lead).asc_nulls_first()).rowsBetween(W.unboundedPreceding, -1)))
    within = F.row_number().over(W.partitionBy(lead).orderBy(*rest))
    out = raw.withColumn("_w", within)
    return out.join(before, out[lead].eqNullSafe(before[lead])).select(out["*"], (F.coalesce("_b", F.lit(0)) + F.col("_w")).alias("seq")).drop("_w")
