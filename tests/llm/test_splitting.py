"""Pieces of oversized chunks."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sondera.llm import splitting as sp


def strongest(places, strengths, low, high):
    best = [(s, p) for p, s in zip(places, strengths) if low <= p <= high]
    return max(best)[1] if best else None


def test_range_maximum():
    rng = random.Random(1)
    for _ in range(200):
        n = rng.randrange(1, 40)
        places = sorted(rng.sample(range(1, 200), n))
        strengths = [rng.randrange(1, 6) for _ in places]
        table = sp.StrongestCut(sp.np.array(places), sp.np.array(strengths))
        a, b = sorted(rng.sample(range(0, 210), 2))
        assert table.query(a, b) == strongest(places, strengths, a, b)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .\n\r#é😀", max_size=400), st.integers(1, 50), st.integers(-2, 60))
def test_spans(text, limit, overlap):
    spans = sp.spans(text, limit, overlap)
    kept = max(0, min(overlap, limit // 2, limit - 1))
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    assert all(b - a <= limit for a, b in spans)
    for (_, b), (c, _) in zip(spans, spans[1:]):
        assert c == b - kept
    joined = text[: spans[0][1]] + "".join(text[prev[1] : b] for prev, (_, b) in zip(spans, spans[1:]))
    assert joined == text


def test_natural_places():
    text = "First paragraph here.\nIt has two lines.\n\nSecond paragraph begins here and goes on."
    assert text[: sp.spans(text, 60, 0)[0][1]].endswith("\n\n")
    with pytest.raises(ValueError):
        sp.spans("x", 0, 0)


def test_frame(spark, chunk):
    text = "alpha beta\n" * 10
    rows = chunk(
        {"chunk_id": "long", "text": text, "start_line": 5}, {"chunk_id": "line", "text": "y" * 60 + "\nz"}, {"chunk_id": "fits", "text": "x" * 40}, {"chunk_id": "null", "text": None},
        {"chunk_id": None, "text": text}, {"chunk_id": "other", "knowledge_id": "none", "text": text}, {"chunk_id": "unlisted", "knowledge_id": "?", "text": text}, {"chunk_id": "late", "text": text},
        {"chunk_id": "nolines", "text": text, "start_line": None}, extra={"cut": "x", "piece": 1},
    )
    from datetime import datetime

    rows = rows.unionByName(chunk({"chunk_id": "late", "text": "short", "indexed_at": datetime(2027, 1, 1)}, extra={"cut": "x", "piece": 1})).unionByName(rows.limit(1))
    limits = spark.createDataFrame([("k", 10, 3), ("k", 12, 9), ("none", None, 5), (None, 1, 1)], "knowledge_id string, max_chunk_tokens int, chunk_overlap_tokens int")
    got = sp.split_oversized(rows, limits).orderBy("chunk_id", "piece").collect()
    assert {(r["chunk_id"], r["cut"]) for r in got} == {("long", "natural"), ("line", "forced"), ("nolines", "natural")}
    long = [r for r in got if r["chunk_id"] == "long"]
    assert long[0]["start_line"] == 5 and long[-1]["end_line"] == 14
    for r in long:
        assert r["text"] == text[r["start"] : r["end"]] and len(r["text"]) <= 40
        assert r["start_line"] == 5 + text[: r["start"]].count("\n") and r["end_line"] == 5 + text[: r["end"] - 1].count("\n")
    assert all(b["start"] == a["end"] - 12 for a, b in zip(long, long[1:]))
    assert all(r["start_line"] is None for r in got if r["chunk_id"] == "nolines")
    assert sp.split_oversized(rows.limit(0), limits).count() == 0 and sp.split_oversized(rows, limits.limit(0)).count() == 0
