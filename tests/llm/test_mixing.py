import math
import os

import pytest
from pyspark.sql import functions as F

from quernwork.llm import mixing as M


@pytest.mark.parametrize(("mean", "cap"), [(0.3, 1), (0.99, 1), (1.7, 3), (2.9, 3), (4.5, 5), (700, 5000), (4999, 5000), (1e-6, 9)])
def test_rate_for(mean, cap):
    assert abs(M.capped_mean(M.rate_for(mean, cap), cap) - mean) < 1e-6 * max(1, mean)
    assert math.isinf(M.rate_for(cap, cap)) and M.rate_for(0, cap) == 0


def test_mix(spark):
    sizes = spark.createDataFrame([(n, "A " if n % 2 else "b", 10, "x") for n in range(4000)] + [(9000, "unlisted", 10, "x"), (9001, "a", 0, "x"), (9002, None, 5, "x")], "doc_id long, source string, tokens long, times string").drop("times")
    targets = spark.createDataFrame([("a", 3.0, 2), ("B", 1.0, 1), ("none", 1.0, 4)], "source string, weight double, max_repeats int")
    plan = M.plan_mix(sizes, targets)
    got = {r.source: r for r in M.shares(M.mixture(sizes, plan, 5), plan).collect()}
    assert got["a"].most_uses <= 2 and got["B"].most_uses == 1 and got["none"].used_tokens == 0 and got["none"].shortfall_tokens == 8000
    assert abs(got["a"].used_tokens - got["a"].wanted_tokens) < 0.1 * got["a"].wanted_tokens and abs(got["B"].used_tokens - got["B"].wanted_tokens) < 0.1 * got["B"].wanted_tokens
    mix = M.mixture(sizes, plan, 5)
    assert mix.agg(F.sum("tokens")).collect()[0][0] == sum(r.used_tokens for r in got.values())
    assert {tuple(r) for r in M.mixture(sizes.repartition(7), plan, 5).collect()} == {tuple(r) for r in mix.collect()}
    assert mix.groupBy("doc_id").count().agg(F.max("count")).collect()[0][0] <= 2


def test_reachable():
    """What is left over by capped sources goes to the others in proportion, until they are at their caps too."""
    assert M.reachable({"a": 50.0, "b": 30.0, "c": 20.0}, {"a": 10.0, "b": 1000.0, "c": 1000.0}) == {"a": 10.0, "b": 54.0, "c": 36.0}
    assert M.reachable({"a": 50.0, "b": 50.0}, {"a": 10.0, "b": 20.0}) == {"a": 10.0, "b": 20.0}
    assert M.reachable({"a": 50.0, "b": 0.0}, {"a": 0.0, "b": 0.0}) == {"a": 0.0, "b": 0.0} and M.reachable({}, {}) == {}


def test_cap_takes_all(spark):
    sizes = spark.createDataFrame([(1, "a", 10), (2, "b", 1000)], "doc_id long, source string, tokens long")
    plan = M.plan_mix(sizes, spark.createDataFrame([("a", 1.0, 3), ("b", 1.0, 1)], "source string, weight double, max_repeats int"))
    got = {r.source: r for r in M.shares(M.mixture(sizes, plan), plan).collect()}
    assert got["a"].used_tokens == 30 and got["a"].shortfall_tokens == 505 - 30


def test_empty(spark):
    sizes = spark.createDataFrame([], "doc_id long, source string, tokens long")
    targets = spark.createDataFrame([("a", 1.0, 3)], "source string, weight double, max_repeats int")
    assert [(r.source, r.achieved_share) for r in M.shares(M.mixture(sizes, M.plan_mix(sizes, targets)), M.plan_mix(sizes, targets)).collect()] == [("a", 0.0)]


@pytest.mark.skipif(not os.path.exists(f"{M.TOKENIZERS}/{M.TOKENIZER}"), reason="no tokenizer files")
def test_token_counts(spark):
    df = spark.createDataFrame([(1, "a", "hello world"), (2, "a", None), (3, None, "  "), (4, "a", "<|endoftext|>")], "doc_id long, source string, text string")
    got = {r.doc_id: r.tokens for r in M.token_counts(df).collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] > 1


def test_many_sources(spark):
    """Listed sources are found among any number of others."""
    sizes = spark.range(30_000).selectExpr("id as doc_id", "concat('s', id) as source", "10L as tokens")
    plan = M.plan_mix(sizes, spark.createDataFrame([(f"S{n * 500}", 1.0, 3) for n in range(50)], "source string, weight double, max_repeats int"))
    assert [(p["tokens"], p["documents"]) for p in plan] == [(10, 1)] * 50
