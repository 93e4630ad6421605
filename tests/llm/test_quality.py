"""Statistics and forms of texts."""

import random

import duckdb
import pytest

from sondera.llm import quality as ql
from sondera.llm.queries import oracle_sql

SENTENCES = ["The sensor was moved to the other side of the hall.", "We have not seen any change in the values since then.", "It is not clear why the pump must be started by hand.", "Der Versuch wird nach der Messung noch einmal geprüft.", "La curva è fragile, ma il limite resta nella norma."]


def make(rng):
    prose = lambda: " ".join(rng.choice(SENTENCES) for _ in range(8))
    listing = lambda: "\n".join(f"- {rng.choice('pump valve sensor lamp'.split())} {rng.choice('red blue green'.split())}" for _ in range(20))
    table = lambda: "\n".join("a|b|c" if i == 0 else f"{rng.random() * 999:.2f}|{rng.randrange(9999)}|x{rng.randrange(9)}" for i in range(20))
    junk = lambda: " ".join("".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(rng.randrange(3, 14))) for _ in range(60))
    kinds = {"prose": prose, "list": listing, "table": table, "junk": junk}
    return [(k, kinds[k]()) for k in rng.choices(list(kinds), [70, 12, 12, 6], k=300)]


def test_forms(spark):
    made = make(random.Random(6))
    rows = [(i, t) for i, (_, t) in enumerate(made)] + [(1000, None), (1001, ""), (1002, " \n\r\n"), (None, "No id. It is prose all the same, we think.")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS votes", "'x' AS form", "2 AS n_words")
    got = {r["doc_id"]: r for r in ql.text_forms(df).collect()}
    assert len(got) == len(rows)
    wrong = sum((got[i]["form"] == "prose") != (k == "prose") for i, (k, _) in enumerate(made))
    assert wrong <= 2
    assert got[1000]["form"] == got[1001]["form"] == got[1002]["form"] == "junk" and got[1000]["n_words"] == 0
    assert all(abs(sum(r[f"p_{f}"] for f in ql.FORMS) - 1) < 1e-9 for r in got.values())
    assert ql.text_forms(df.limit(0)).count() == 0


def test_statistics(spark):
    text = "The pump is on.\r\n\n- red 1\nx;y;z"
    r = ql.text_statistics(spark.createDataFrame([(1, text), (1, text)], "doc_id long, text string")).first()
    assert (r["n_lines"], r["n_words"], r["bullet_share"], r["cell_share"]) == (3, 9, 1 / 3, 1 / 3)
    assert r["line_end_punctuation"] == 1 / 3 and r["common_word_share"] == 4 / 9 or r["common_word_share"] > 0.3


@pytest.mark.skipif("p8_statistics" not in oracle_sql(), reason="no SQL")
def test_statistics_like_sql(spark, tmp_path):
    made = [(i, t, None) for i, (_, t) in enumerate(make(random.Random(7)))] + [(-1, None, None), (-2, "", None)]
    spark.createDataFrame(made, "doc_id long, text string, x string").coalesce(1).write.parquet(f"{tmp_path}/documents")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents/*.parquet'")
    sql = {r[0]: r for r in con.execute(f"SELECT doc_id, n_words, n_lines FROM ({oracle_sql()['p8_statistics']})").fetchall()}
    for r in ql.text_statistics(spark.read.parquet(f"{tmp_path}/documents")).collect():
        assert sql[r["doc_id"]] == (r["doc_id"], r["n_words"], r["n_lines"])


def test_learning_prefers_agreement():
    right, wrong = [1] * len(ql.LABELLERS), [2 if len(r) > 1 else 0 for _, r in ql.LABELLERS]
    prior, rates = ql.learn([(right, 80), (wrong, 20)])
    post = ql.posterior([wrong], prior, rates)[0]
    assert post[0] < 0.5 and abs(prior.sum() - 1) < 1e-9
    assert ql.learn([])[0].sum() == 1
