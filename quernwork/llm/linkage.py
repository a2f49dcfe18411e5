"""Matching entities across sources without keys.

Labelling functions vote on candidate pairs (+1 same, -1 different, 0 no opinion); a generative model of the
votes learns each function's accuracy and the correlations between functions without any labels, and gives each
pair a posterior probability. The posterior alone decides. What is known of the functions goes into the model: each looks at a
part that makes the opening what it is and abstains where a slip of writing may be at work, so equal openings hardly ever
draw a vote against.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quernwork.functions.text import source_key
from quernwork.llm.openings import OPENING, opening_forms, raw_fields, slips, word_counts
from quernwork.session import stored, table

#: Pairs of at least this posterior are links.
ACCEPT = 0.5


#: Pseudo-counts of the votes -1, 0, 1 among different and equal pairs: what is believed of a function before any pair is seen. They matter for a handful of pairs only.
_BELIEF = np.array([[1.2, 0.2, 0.6], [0.1, 0.2, 1.7]])
#: The largest share of equal pairs that a function may vote against, whatever the votes of the others.
SLIP = 1e-3
#: The weight of _BELIEF about different pairs, as a share of all pairs: without it they could be thought to agree in everything.
BELIEF = 0.25


class VoteModel:
    """Two latent classes over votes in {-1, 0, 1}; within a class the votes form a tree, so that correlated functions don't count twice.

    slip bounds the probability of a vote against among equal pairs: with a small one, a vote against outweighs any number of correlated ones for it. belief is the
    weight, as a share of all pairs, of what is believed of different pairs: that a function by itself lets about a third of them pass.

    Fitted by expectation maximisation on counts of vote patterns (3 ** functions of them at most, whatever
    the number of pairs). The tree is the maximum spanning tree of the conditional mutual information given the
    current posteriors (Chow and Liu), learned anew in each of the first rounds.
    """

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, rounds: int = 60, slip: float = 1.0, belief: float = 0.0) -> None:
        self.x = np.asarray(patterns, dtype=int) + 1
        n, w = np.asarray(counts, dtype=float), self.x.shape[1]
        votes = self.x - 1
        agree = (votes >= 0).all(1) & ((votes > 0).sum(1) * 2 > w)
        p = np.where(agree, 0.95, 0.02)
        self.parent = [-1] * w
        for k in range(rounds):
            r = np.stack([n * (1 - p), n * p])
            if k < 5:
                self.parent = self._tree(r)
            self.prior = (r.sum(1) + 1) / (n.sum() + 2)
            self.tables = []
            for j, q in enumerate(self.parent):
                t = np.tile((_BELIEF * [[1 + belief * n.sum()], [1]])[:, None, :], (1, 3, 1))
                for c in range(2):
                    np.add.at(t[c], (self.x[:, q] if q >= 0 else np.zeros(len(n), int), self.x[:, j]), r[c])
                t /= t.sum(2, keepdims=True)
                t[1, :, 0] = np.minimum(t[1, :, 0], slip)
                t[1, :, 1:] *= ((1 - t[1, :, 0]) / t[1, :, 1:].sum(1))[:, None]
                self.tables.append(t)
            new = self.posterior(self.x - 1)
            done = np.abs(new - p).max(initial=0) < 1e-9
            p = new
            if done:
                break

    def _tree(self, r: np.ndarray) -> list[int]:
        w = self.x.shape[1]
        info = {}
        for i, j in combinations(range(w), 2):
            total = 0.0
            for c in range(2):
                t = np.full((3, 3), 1e-6)
                np.add.at(t, (self.x[:, i], self.x[:, j]), r[c])
                p = t / t.sum()
                total += t.sum() * float((p * np.log(p / (p.sum(1, keepdims=True) * p.sum(0, keepdims=True)))).sum())
            info[i, j] = total
        parent, inside = [-1] * w, {0}
        while len(inside) < w:
            i, j = max(((a, b) for a in inside for b in range(w) if b not in inside), key=lambda e: info[min(e), max(e)])
            parent[j] = i
            inside.add(j)
        return parent

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        x = np.asarray(votes, dtype=int) + 1
        logs = np.tile(np.log(self.prior), (len(x), 1))
        for j, q in enumerate(self.parent):
            logs += np.log(self.tables[j][:, x[:, q] if q >= 0 else np.zeros(len(x), int), x[:, j]]).T
        return 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -700, 700)))


def posteriors(votes: DataFrame, names: list[str], most_patterns: int = 100_000, slip: float = 1.0, belief: float = 0.0) -> DataFrame:
    """votes with `confidence`: the posterior of each row's pattern. Only the pattern counts reach the driver."""
    rows = votes.groupBy(*names).count().limit(most_patterns + 1).collect()
    if len(rows) > most_patterns:
        raise ValueError("too many vote patterns")
    if not rows:
        return votes.withColumn("confidence", F.lit(None).cast("double"))
    x = np.array([[r[n] for n in names] for r in rows])
    model = VoteModel(x, np.array([r["count"] for r in rows]), slip=slip, belief=belief)
    known = votes.sparkSession.createDataFrame(
        [(*map(int, a), float(p)) for a, p in zip(x, model.posterior(x), strict=True)], ", ".join(f"`{n}` int" for n in names) + ", confidence double"
    )
    return votes.join(F.broadcast(known), names)  # at most 3 ** functions rows


_TITLE = ["title_words", "seniority", "grade", "client"]
VOTES = ["v_words", "v_rank", "v_grade", "v_client", "v_company", "v_trade", "v_place"]


def _blocks() -> list[Column]:
    """Keys of which candidates share one: employer and title; employer, place and initials of the title; title, place and the employer's initial."""
    initials = F.array_join(F.transform(F.split("title_words", " "), lambda w: F.substring(w, 1, 1)), "")
    return [
        F.when(F.col("company_key") != "", F.xxhash64(F.lit(1), "company_key", *_TITLE)),
        F.when((F.col("company_key") != "") & (F.col("place_key") != ""), F.xxhash64(F.lit(2), "company_key", "place_key", initials, "client")),
        F.when((F.col("title_words") != "") & (F.col("place_key") != ""), F.xxhash64(F.lit(3), *_TITLE, "place_key", F.substring("company_key", 1, 1))),
    ]


def candidate_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct pairs (l_..., r_...) of distinct openings that share a block key. Equal openings are one row on either side, so copies don't multiply. Openings without employer, title or place are in no pair."""

    def side(df: DataFrame, p: str) -> DataFrame:
        named = df.filter("company_key <> '' and title_words <> '' and place_key <> ''")
        forms = named.select(*OPENING).distinct().withColumn("_key", F.explode(F.array_compact(F.array_distinct(F.array(*_blocks())))))
        return forms.select("_key", *[F.col(c).alias(f"{p}_{c}") for c in OPENING])

    return side(left, "l").join(side(right, "r"), "_key").drop("_key").distinct()


def _brand(c: str) -> Column:
    return F.substring_index(c, " ", 1)


def _trade(c: str) -> Column:
    return F.substring_index(c, " ", -1)


def meant_brands(pairs: DataFrame, openings: DataFrame) -> DataFrame:
    """(l_company_key, r_company_key): names without a namesake, and the one employer of the same trade at one edit among their candidates.

    A brand that any of the openings has, whatever its trade, is another employer's name and no slip; a name with several such neighbours stays undecided.
    """
    brands = openings.select(_brand("company_key").alias("brand")).distinct()
    apart = F.levenshtein(_brand("l_company_key"), _brand("r_company_key"), 1) == 1
    near = pairs.filter((_trade("l_company_key") == _trade("r_company_key")) & apart).select("l_company_key", "r_company_key", _brand("l_company_key").alias("brand")).distinct()
    one = near.join(brands, "brand", "left_anti").groupBy("l_company_key").agg(F.min("r_company_key").alias("r_company_key"), F.count("*").alias("n"))
    return one.filter("n = 1").drop("n")


def vote(pairs: DataFrame, meant: DataFrame) -> DataFrame:
    """pairs with the votes of all labelling functions. An employer's name that is taken for a slip (meant, of meant_brands()) is no reason for or against."""

    def same(c: str) -> Column:
        return F.when(F.col(f"l_{c}") == F.col(f"r_{c}"), 1).otherwise(-1)

    neither = (F.col("l_client") == "") & (F.col("r_client") == "")
    overlap = F.arrays_overlap(F.split("l_place_key", " "), F.split("r_place_key", " "))
    cols = {
        "v_words": same("title_words"),
        "v_rank": same("seniority"),
        "v_grade": same("grade"),
        "v_client": F.when(neither, 0).otherwise(same("client")),
        "v_company": F.when(F.col("l_company_key") == F.col("r_company_key"), 1).when(F.col("_meant"), 0).otherwise(-1),
        "v_trade": F.when(_trade("l_company_key") == _trade("r_company_key"), 1).otherwise(-1),
        "v_place": F.when(overlap, 1).otherwise(-1),
    }
    return pairs.join(meant.withColumn("_meant", F.lit(True)), ["l_company_key", "r_company_key"], "left").withColumns({k: v.cast("int") for k, v in cols.items()}).drop("_meant")


def scored_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """The candidate pairs of two tables of openings with all votes and the posterior `confidence`."""
    pairs = stored(candidate_pairs(left, right), "candidates")
    return posteriors(stored(vote(pairs, meant_brands(pairs, right)), "votes"), VOTES, slip=SLIP, belief=BELIEF)


def link_openings(links: DataFrame, jobs: DataFrame, places: DataFrame, assigned: DataFrame) -> DataFrame:
    """(source, source_id, job_id, confidence): for each link the job that is the same opening.

    links (source, source_id, title, company, location, city) and jobs (job_id, ...) are matched by the posterior of
    the vote model, ACCEPT or more. assigned (source, job_id): a job that has a link of a source is never a
    match for another link of it. One row per link; among several jobs the most confident, then the
    smallest job_id. Repeated links count once. Links without title, company or place match nothing.
    """
    found = slips([jobs, links], stored(word_counts(jobs), "word-counts"))
    key = F.xxhash64(*OPENING).alias("opening")
    j = stored(opening_forms(jobs, ["job_id"], places, found).select("*", key), "jobs")
    asked = links.dropDuplicates(["source", "source_id", "title", "company", "location", "city"])
    l = stored(opening_forms(asked, ["source", "source_id"], places, found).select("*", key), "links")
    accepted = scored_pairs(l, j).filter(F.col("confidence") >= ACCEPT)
    accepted = accepted.select(F.xxhash64(*[f"l_{c}" for c in OPENING]).alias("opening"), F.xxhash64(*[f"r_{c}" for c in OPENING]).alias("job_opening"), "confidence")

    # for each opening and source that asks: the best job without a link of that source. The askers of an opening are at most
    # as many as there are sources; its jobs are joined once and reduced at once.
    sources = l.select("opening", source_key("source").alias("_source")).distinct().join(accepted, "opening")
    taken = assigned.select(source_key("source").alias("_source"), "job_id").filter("job_id is not null").distinct()
    best = (
        sources.join(j.select(F.col("opening").alias("job_opening"), "job_id"), "job_opening")
        .join(taken, ["_source", "job_id"], "left_anti")
        .groupBy("opening", "_source")
        .agg(F.min(F.struct((-F.col("confidence")).alias("c"), "job_id")).alias("best"))
    )
    out = l.select("source", "source_id", "opening", source_key("source").alias("_source")).join(best, ["opening", "_source"])
    return out.groupBy("source", "source_id").agg(F.min("best").alias("best")).select("source", "source_id", "best.job_id", F.round(-F.col("best.c"), 6).alias("confidence"))


def _linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = table(spark, sf_dir, "job_sources")
    open_links = raw_fields(links.filter("job_id is null and raw is not null"))
    jobs = table(spark, sf_dir, "jobs").select("job_id", "title", "company", "location", "city")
    return link_openings(open_links, jobs, table(spark, sf_dir, "places"), links.select("source", "job_id"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links without job_id and the job that is the same opening."""
    return _linked(spark, sf_dir).select("source", "source_id", "job_id")


def p3_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matches with their confidence."""
    return _linked(spark, sf_dir)


QUERIES = {"p3_found": p3_found, "p3_confidence": p3_confidence}
