"""The store's tables after a batch: records, reviewers' fields, results, the run log and settings. Every write is a new table beside the old one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quernwork.functions.jobtext import content_hash
from quernwork.operators.resolve import MATERIAL, reopened, survive


def upsert(jobs: DataFrame, sightings: DataFrame) -> DataFrame:
    """The rows of jobs that a batch touches, as they are after it, with `label`: new, changed or seen.

    sightings: (entity_id, source, seq, seen, seen_at, full_listing, MATERIAL, posted_date, url). A stored record counts as its own first sighting,
    so fields survive as in survive(). updated_at moves to the batch's last sighting where the hash of the material fields
    changed, last_seen only by real sightings. A closed record opens again by reopened(), and then is due for a check.
    """
    old = jobs.select(F.col("job_id").alias("entity_id"), F.col("primary_source").alias("source"), F.lit(-1).cast("bigint").alias("seq"), *MATERIAL, "posted_date", "url").join(sightings.select("entity_id").distinct(), "entity_id", "left_semi")
    fields = survive(old.unionByName(sightings.select(old.columns)))
    state = jobs.select(F.col("job_id").alias("entity_id"), content_hash(*MATERIAL).alias("_old"), "first_seen", "last_seen", "updated_at", "closed_at", "closed_by_employer", "liveness_checked_at")
    x = sightings.join(state.select("entity_id", "closed_at", "closed_by_employer"), "entity_id", "left")
    opens = reopened(F.col("seen"), F.col("closed_at"), F.col("closed_by_employer"), F.col("full_listing"), F.col("seen_at"))
    batch = x.groupBy("entity_id").agg(F.bool_or(F.coalesce(opens, F.lit(False))).alias("_opens"), F.min("seen_at").alias("_first"), F.max("seen_at").alias("_now"), F.max(F.when(F.col("seen"), F.col("seen_at"))).alias("_seen"))
    y = fields.join(state, "entity_id", "left").join(batch, "entity_id")
    known, changed = F.col("_old").isNotNull(), F.col("_old") != content_hash(*MATERIAL)
    return y.select(
        F.col("entity_id").alias("job_id"), F.when(~known, "new").when(changed, "changed").otherwise("seen").alias("label"), "primary_source", *MATERIAL, "posted_date", "url",
        F.coalesce("first_seen", "_first").alias("first_seen"), F.when(known, F.greatest("last_seen", "_seen")).otherwise(F.coalesce("_seen", "_first")).alias("last_seen"),
        F.when(known & ~changed, F.col("updated_at")).otherwise(F.col("_now")).alias("updated_at"), F.when(~F.col("_opens"), F.col("closed_at")).alias("closed_at"),
        F.when(F.col("_opens"), False).otherwise(F.coalesce("closed_by_employer", F.lit(False))).alias("closed_by_employer"), F.when(~F.col("_opens"), F.col("liveness_checked_at")).alias("liveness_checked_at"),
    )


def put(table: DataFrame, rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """table after an upsert of whole rows: of each key the last of `rows` by `order`, else what was there. The columns are the table's."""
    rest = [c for c in table.columns if c not in keys]
    new = rows.groupBy(*keys).agg(F.max(F.struct(*order, F.struct(*rest).alias("_row"))).alias("_n")).select(*keys, F.col("_n._row").alias("_n"))
    both = table.withColumn("_o", F.struct(*rest)).select(*keys, "_o").join(new, keys, "full_outer").withColumn("_r", F.coalesce("_n", "_o"))
    return both.select(*[F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in table.columns])


def backup_reviews(reviews: DataFrame, sheet: DataFrame, jobs: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(reviews, jobs) after a backup of the sheet's reviewer fields: sheet (job_id, fields map<string, string>) replaces a record's review as a whole; ai_reviewed_at follows the field of that name where the sheet has it (a blank one clears it)."""
    rows = sheet.select("job_id", F.to_json("fields").alias("data"), now.alias("updated_at"))
    stamps = sheet.filter(F.map_contains_key("fields", "AI Reviewed At")).select("job_id", F.nullif(F.col("fields")["AI Reviewed At"], F.lit("")).alias("_a"), F.lit(True).alias("_said"))
    stamped = jobs.join(stamps, "job_id", "left").withColumn("ai_reviewed_at", F.when(F.col("_said"), F.col("_a").try_cast("timestamp_ntz")).otherwise(F.col("ai_reviewed_at"))).drop("_a", "_said")
    return put(reviews, rows, ["job_id"], ["updated_at"]), stamped


def tracker_rows(visible: DataFrame, reviews: DataFrame, shown: list[str], fields: list[str], most: int) -> DataFrame:
    """The tracker after a rebuild: visible records with their shown columns, the description cut to `most` characters, and the reviewers' fields; whole-number scores as numbers' text, and a default status."""
    data = F.from_json("data", "map<string,string>")
    cells = {f: F.coalesce(data[f], F.lit("")) for f in fields}
    if "AI Score" in cells:
        number = cells["AI Score"].try_cast("double")
        cells["AI Score"] = F.when(number == F.floor(number), number.cast("bigint").cast("string")).otherwise(cells["AI Score"])
    if "Application Status" in cells:
        cells["Application Status"] = F.coalesce(F.nullif(cells["Application Status"], F.lit("")), F.lit("Not Applied"))
    cut = F.when(F.length("description") > most, F.concat(F.substring("description", 1, most), F.lit(" [truncated]"))).otherwise(F.col("description"))
    x = visible.withColumn("description", cut).join(reviews.select("job_id", "data"), "job_id", "left")
    return x.select(*shown, *[c.alias(f) for f, c in cells.items()])


def header_names(header: list[str], width: int, first: int) -> list[str]:
    """Names of the reviewers' columns from `first` on: the header's, and "Column <letters>" for blank ones up to the widest row. Names that occur twice are an error."""
    def letters(n: int) -> str:
        return letters((n - 1) // 26) + chr(65 + (n - 1) % 26) if n else ""

    names = [header[k] if k < len(header) and header[k].strip() else f"Column {letters(k + 1)}" for k in range(first, width)]
    if len(set(names)) < len(names):
        raise ValueError("two reviewer columns have the same name")
    return names


def log_runs(runs: DataFrame, starts: DataFrame, ends: DataFrame) -> DataFrame:
    """The run log after starts (id, started_at) and ends (id, finished_at, stats): a run that never ended keeps nulls; an end without a start changes nothing."""
    begun = runs.unionByName(starts.join(runs.select("id"), "id", "left_anti"), allowMissingColumns=True)
    done = ends.select("id", F.col("finished_at").alias("_f"), F.col("stats").alias("_s"))
    return begun.join(done, "id", "left").select("id", "started_at", F.coalesce("_f", "finished_at").alias("finished_at"), F.coalesce("_s", "stats").alias("stats"))


def save_results(results: DataFrame, judged: DataFrame) -> DataFrame:
    """Results (job_id, fingerprint, policy, result, written_at, error) after new judgments (job_id, fingerprint, policy, result): a result that is judged anew is no longer published."""
    new = judged.select("job_id", "fingerprint", "policy", "result", F.lit(None).cast("timestamp_ntz").alias("written_at"), F.lit(None).cast("string").alias("error"))
    return put(results, new, ["job_id", "fingerprint", "policy"], ["result"])


def published(results: DataFrame, writes: DataFrame) -> DataFrame:
    """Results after attempts to publish them (job_id, fingerprint, policy, written_at, error): a written one has its instant, one that failed its error only."""
    keys = ["job_id", "fingerprint", "policy"]
    w = writes.select(*keys, F.col("written_at").alias("_w"), F.col("error").alias("_e"), F.lit(True).alias("_x"))
    x = results.join(w, keys, "left")
    return x.select(*keys, "result", F.when(F.col("_x") & F.col("_w").isNotNull(), F.col("_w")).otherwise(F.col("written_at")).alias("written_at"), F.when(F.col("_x"), F.col("_e")).otherwise(F.col("error")).alias("error"))


def effective_reviews(backups: DataFrame, results: DataFrame) -> DataFrame:
    """(job_id, decision, reviewed_at): the newest of the backed-up review (job_id, decision, reviewed_at, updated_at) and the published results (job_id, decision, reviewed_at, written_at, seq) written after it; unpublished results don't count, ties go to the larger seq."""
    last = results.filter("written_at is not null").groupBy("job_id").agg(F.max(F.struct("written_at", "seq", "decision", "reviewed_at")).alias("_p"))
    x = backups.select("job_id", "updated_at", F.struct("decision", "reviewed_at").alias("_b")).join(last, "job_id", "full_outer")
    newer = F.col("_p").isNotNull() & (F.col("updated_at").isNull() | (F.col("_p.written_at") > F.col("updated_at")))
    return x.select("job_id", F.when(newer, F.col("_p.decision")).otherwise(F.col("_b.decision")).alias("decision"), F.when(newer, F.col("_p.reviewed_at")).otherwise(F.col("_b.reviewed_at")).alias("reviewed_at"))


def fetch_order(targets: DataFrame, key: str, limit: int, caps: dict[str, int] | None = None) -> DataFrame:
    """targets (source, job_id, key, attempted_at, first_seen) of the postings to fetch next, with `turn`: postings never tried first, then by their latest attempt, the newest record ahead; at most `limit` postings of a source (or its own cap), each with all its records."""
    group = targets.groupBy("source", key).agg(F.max("attempted_at").alias("_tried"), F.max("first_seen").alias("_new"))
    bounds = F.lit(limit)
    for source, most in (caps or {}).items():
        bounds = F.when(F.col("source") == source, most).otherwise(bounds)
    # the top of each source first, so that no source is sorted as a whole in one task
    order = F.struct(F.coalesce(F.col("_tried"), F.lit("1900-01-01").cast("timestamp_ntz")).alias("t"), (-F.unix_micros(F.col("_new").cast("timestamp"))).alias("n"), F.col(key).alias("k"))
    most = max([limit, *(caps or {}).values()])
    top = group.select("source", order.alias("o")).withColumn("_part", F.pmod(F.xxhash64("o"), F.lit(64)))
    some = top.withColumn("_r", F.row_number().over(W.partitionBy("source", "_part").orderBy("o"))).filter(F.col("_r") <= most)
    ranked = some.withColumn("turn", F.row_number().over(W.partitionBy("source").orderBy("o"))).filter(F.col("turn") <= bounds)
    return targets.join(ranked.select("source", F.col("o.k").alias(key), "turn"), ["source", key])


def attempts(targets: DataFrame, outcomes: DataFrame, key: str) -> DataFrame:
    """(job_id, outcome): what the outcome (source, key, status) of a posting's fetch means for each of its records: ok (200), gone (404, 410), tried (all else, a refusal or unreadable page included); postings that weren't fetched have no row."""
    meaning = F.when(F.col("status") == 200, "ok").when(F.col("status").isin(404, 410), "gone").otherwise("tried")
    return targets.join(outcomes.select("source", key, meaning.alias("outcome")), ["source", key]).select("job_id", "outcome")
