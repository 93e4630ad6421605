"""The operators over the given tables, where these are at hand."""

import os

import numpy as np
import pytest

from sondera.llm import leaks, quality, queries, scans

TABLES = os.environ.get("SONDERA_TABLES", "/root/testdata")

pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="the tables aren't here")


def test_pages_like_transcripts(spark):
    """Pages come out as a reader wrote them down."""
    folder = f"{TABLES}/sf0.01"
    wanted = {r["chunk_id"]: r["page_text"] for r in spark.read.parquet(f"{folder}/transcripts.parquet").collect()}
    got = {r["chunk_id"]: r["text"] for r in scans.ScanRepair(spark.read.parquet(f"{folder}/chunks.parquet")).repaired().collect()}
    plain = lambda t: [" ".join(p.split()) for p in t.split("\n\n") if p.strip()]
    right = sum(plain(got[k]) == plain(t) for k, t in wanted.items())
    assert len(wanted) > 5 and right >= len(wanted) - 1


def test_forms_like_labels(spark):
    """Forms agree with hand labels, a few of which are wrong."""
    folder = f"{TABLES}/sf0.01"
    labels = {r["doc_id"]: r["form"] for r in spark.read.parquet(f"{folder}/form_labels.parquet").collect()}
    got = {r["doc_id"]: r["form"] for r in quality.text_forms(spark.read.parquet(f"{folder}/documents.parquet")).collect()}
    same = [(got[d] == "prose") == (f == "prose") for d, f in labels.items() if d in got]
    assert len(same) > 30 and np.mean(same) >= 0.9


def test_leaks_like_brute_force(spark):
    """Every document aligned with every item gives the same pairs."""
    folder = f"{TABLES}/sf0.001"
    documents, items = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/eval_items.parquet")
    got = {(r["doc_id"], r["item_id"]) for r in queries.p6_found(spark, folder).collect()}
    codes = leaks.WordCodes()
    passages = [(r["item_id"], leaks._coded(r["text"], codes)) for r in leaks.passages(items).collect()]
    texts = [(r["doc_id"], leaks._coded(r["text"], codes)) for r in documents.collect()]
    keys = [(d, i, p, t) for d, t in texts for i, p in passages if len(p)]
    best = leaks.best_stretches([(p, t) for _, _, p, t in keys], limits=(0.5, 0.15))
    want = {(d, i) for (d, i, p, _), b in zip(keys, best) if leaks._fits(b, len(p), 0.5, 0.15)}
    assert got == want and len(want) > 3
