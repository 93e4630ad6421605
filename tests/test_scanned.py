"""Searching in one scan: many queries over chunks that are scanned once."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sondera.operators import lexical, scanned
from sondera.operators.words import Variants


def terms(text):
    return re.findall("[a-z0-9]+", " ".join(scanned.tokens(text, Variants())))


def counted(row, phrase, weights):
    """How much a chunk's fields have of a phrase."""
    texts = {"text": "\n".join(row), "symbol": row[1], "path": row[3]}
    return sum(w * sum(t[i : i + len(phrase)] == phrase for i in range(len(t))) for name, w in weights.items() for t in [terms(texts[name])])


@pytest.fixture
def words():
    rng = random.Random(4)
    pool = [f"word{chr(97 + i)}{chr(97 + i % 7)}" for i in range(24)] + ["zz", "a_b", "wordaa_wordbb", "Pix.lines", "x1"]
    return lambda n: " ".join(rng.choice(pool[: rng.randint(2, len(pool))]) for _ in range(n))


@pytest.mark.parametrize("together", [40, 500_000])
def test_phrases_picked(words, monkeypatch, together):
    """Whatever is looked at together, keys and lengths are those of a count by hand; a phrase may go across fields of the whole text, not of its own field."""
    monkeypatch.setattr(scanned, "TOGETHER", together)
    rows = [(words(20), words(2), "", words(2), "text") for _ in range(40)] + [("", "", "", "", ""), ("zz zz zz zz", "zz", "", "zz", "zz"), ("a", "b", "", "a b", "a")]
    keys = {k: i for i, k in enumerate(["zz", "zz zz", "a b", "zz zz zz", "b a", "text", "wordaa wordbb", "x 1", "none", "no ne", *{t for r in rows for t in terms(r[0])} - {"zz"}])}
    at, told = 0, []
    for length, many, found, f in scanned.Phrases(keys, lexical.FIELD_WEIGHTS).pick([list(c) for c in zip(*rows)]):
        for n, m in zip(length.tolist(), many.tolist()):
            told.append((n, dict(zip(found[:m].tolist(), f[:m].tolist()))))
            found, f = found[m:], f[m:]
        at += 1
    assert (at > 1) == (together == 40)
    for row, (n, found) in zip(rows, told, strict=True):
        assert n == sum(len(terms(t)) for t in ("\n".join(row), row[1], row[3]))
        want = {k: counted(row, p.split(), lexical.FIELD_WEIGHTS) for p, k in keys.items()}
        assert found == {k: v for k, v in want.items() if v}


def test_many_queries_in_one_scan(spark, chunk, words, monkeypatch):
    """More queries than were searched for at once before need one scan, and list the same as a search in all pairs."""
    calls, picked = [], scanned.picked
    monkeypatch.setattr(scanned, "picked", lambda *a: calls.append(1) or picked(*a))
    texts = {f"c{i:03d}": words(30) for i in range(120)}
    rows = chunk(*[{"chunk_id": i, "text": t, "source_path": f"p{i}", "symbol": t.split()[0]} for i, t in texts.items()])
    asked = [(i, words(60)) for i in range(4_000)]
    made = spark.createDataFrame(asked, "query_id long, query string").repartition(3)
    got = lexical.bm25_phrases(rows, made, 3)
    assert len(calls) == 1 and sum(len(scanned.tokens(t, Variants())) for _, t in asked) > 200_000
    every = {r["chunk_id"]: tuple(r[c] or "" for c in ("text", "symbol", "xml_path", "source_path", "kind")) for r in rows.collect()}
    size = {i: sum(len(terms(t)) for t in ("\n".join(r), r[1], r[3])) for i, r in every.items()}
    mean, n = sum(size.values()) / len(size), len(size)
    found = {r["query_id"]: [] for r in got.select("query_id").distinct().collect()}
    for r in got.orderBy("query_id", "rank").collect():
        found[r["query_id"]].append((r["chunk_id"], round(r["score"], 6)))
    assert len(found) == len(asked)
    memory = {}
    for q, text in asked[::400]:
        phrases = Counter(" ".join(re.findall("[a-z0-9]+", t)) for t in dict.fromkeys(scanned.tokens(text, Variants())))
        score = Counter()
        for p, times in phrases.items():
            if p not in memory:
                memory[p] = {i: f for i, r in every.items() if (f := counted(r, p.split(), lexical.FIELD_WEIGHTS))}
            df = len(memory[p])
            idf = max(math.log((n - df + 0.5) / (df + 0.5)), 1e-6) if df * 2 < n else 1e-6
            for i, f in memory[p].items():
                score[i] += times * idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * size[i] / mean))
        assert found[q] == [(i, round(s, 6)) for i, s in sorted(score.items(), key=lambda x: (-round(x[1], 9), x[0]))[:3]]


def test_batches_and_looks(spark, chunk, words, monkeypatch):
    """Queries in several batches and chunks in many short looks give the same lists, also by the bonus alone."""
    rows = chunk(*[{"chunk_id": f"c{i:03d}", "text": words(25), "source_path": f"lib/{words(1)}/{i}", "symbol": words(1), "xml_path": "root/pixArray" if i % 9 == 0 else None} for i in range(300)])
    asked = spark.createDataFrame([(i, words(n)) for i, n in enumerate([1, 2, 3, 8, 20, 40] * 10)] + [(98, "pixels"), (99, "")], "query_id long, query string")
    told = lambda: [sorted(map(tuple, rank(rows, asked, 4).withColumn("score", F.round("score", 7)).collect())) for rank in (lexical.bm25, lexical.bm25_phrases)]
    once = told()
    monkeypatch.setattr(scanned, "MOST_QUERIES", 7)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        assert told() == once
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_best_by_looks(words):
    """Leaving out what can't be among the best changes no list."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(2)
    many, keys, limit = 3_000, 60, 4
    has = rng.random((many, keys)) < rng.random(keys) ** 3
    f, length = np.where(has, rng.integers(1, 12, (many, keys)), 0.0), rng.integers(20, 90, many)
    impact, weights = scanned.Impact(1.2, 0.75, float(length.mean())), rng.random(keys) * 5
    add = np.where(has, impact.of(f, length[:, None]), 0.0)
    queries = [rng.choice(keys, rng.integers(1, 30), replace=False) for _ in range(60)]
    ends = np.append(0, np.cumsum([len(x) for x in queries]))
    for costly in (0, 4, 10**9):
        scanned.COSTLY, kept = costly, scanned.COSTLY
        try:
            best = scanned.Best(np.concatenate(queries), np.ones(ends[-1]), ends, weights, add.max(0), impact, limit, True, False)
            for a, b in ((0, 200), (200, 1500), (1500, many)):
                row, key = np.nonzero(has[a:b])
                none = np.array([], np.int64)
                best.add(pa.array([f"{i:05d}" for i in range(a, b)]), length[a:b], (key, row), f[a:b][row, key], (none, none), none)
        finally:
            scanned.COSTLY = kept
        for own, listed in zip(queries, best.kept, strict=True):
            score = add[:, own] @ weights[own]
            want = sorted((-round(s, 9), f"{i:05d}") for i, s in enumerate(score.tolist()) if s > 0)[:limit]
            assert [x[1] for x in listed] == [x[1] for x in want]
