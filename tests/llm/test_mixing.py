"""Mixtures."""

import random

import pytest

from sondera.llm import mixing as mx

WORDS = "alpha beta gamma delta epsilon".split()


@pytest.fixture
def documents(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randrange(5, 60))), ["Big One", "big-one ", "small"][0 if i % 10 < 6 else 1 if i % 10 < 9 else 2]) for i in range(400)]
    rows += [(900, None, "small"), (901, "", "small"), (902, "text", None), (903, "text", "other"), (904, "text", " - "), (None, "no id at all", "small")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "0 AS tokens", "'x' AS rounds")


def targets(spark, *rows):
    return spark.createDataFrame(rows, "source string, target_share double, max_repeats int")


def test_shares(spark, documents):
    copies, report = mx.plan_mixture(documents, targets(spark, ("big_one", 0.7, 1), ("small", 0.3, 3), ("nothing", 0.1, 2)))
    by = {r["source"]: r for r in report.collect()}
    assert set(by) == {"big_one", "small", "nothing"} and by["nothing"]["actual_share"] == 0
    assert abs(by["small"]["actual_share"] - 0.3) < 0.02 and by["small"]["most_copies"] <= 3 and by["big_one"]["most_copies"] <= 1
    rows = copies.collect()
    assert len({r["doc_id"] for r in rows}) == len(rows) and all(r["tokens"] > 0 for r in rows)
    for name, r in by.items():
        used = sum(x["tokens"] * x["copies"] for x in rows if x["source"] == name)
        assert used == r["used_tokens"] and abs(used - r["budget_tokens"]) <= 60
    again, _ = mx.plan_mixture(documents.repartition(7), targets(spark, ("small", 0.3, 3), ("big_one", 0.7, 1)))
    assert {r["doc_id"]: r["copies"] for r in again.collect()} == {r["doc_id"]: r["copies"] for r in rows}


def test_prefix_sums_are_exact(spark, documents):
    """With a budget of just some of a source, the used documents are the first of its hashed order."""
    copies, _ = mx.plan_mixture(documents, targets(spark, ("big_one", 1.0, 1)), total_tokens=1000)
    order = {r["doc_id"]: r["place"] for r in mx.sized(documents, f"{mx.TOKENIZERS}/byte_bpe_50k.tiktoken").collect()}
    rows = sorted(copies.collect(), key=lambda r: order[r["doc_id"]])
    total, flags = 0, [r["copies"] for r in rows]
    for r in rows:
        assert r["copies"] == int(total + r["tokens"] / 2 <= 1000)
        total += r["tokens"]
    assert flags == sorted(flags, reverse=True) and 0 < sum(flags) < len(flags)


def test_odd_targets(spark, documents):
    odd = targets(spark, ("small", None, 2), (None, 0.5, 1), ("big_one", 0.5, None), ("big_one", 0.2, -1))
    copies, report = mx.plan_mixture(documents, odd)
    assert {r["used_tokens"] for r in report.collect()} == {0} and copies.where("copies > 0").count() == 0
    assert mx.plan_mixture(documents.limit(0), odd)[0].count() == 0 and mx.plan_mixture(documents, odd.limit(0))[1].count() == 0
    capped, report = mx.plan_mixture(documents, targets(spark, ("small", 1.0, 2)), total_tokens=10**9)
    assert {r["copies"] for r in capped.collect()} == {2} and report.first()["actual_share"] == 1.0
