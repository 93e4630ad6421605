"""Tokens, lines, citations, redaction."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sondera.functions import citations as ct
from sondera.functions import text as tx
from sondera.functions import vectors as vx


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'int'}" for k, v in values.items()))
    return df.select(column.alias("x")).first()["x"]


def plain_tokens(text):
    out = []
    for t in re.findall(r"[A-Za-z_][A-Za-z0-9_\.]*|[0-9]+", text):
        parts = [p.lower() for p in re.findall("[A-Za-z]+|[0-9]+", t)]
        for v in dict.fromkeys([t.lower(), *parts, *(["pixel", "pixels"] if "pix" in parts else [])]):
            out += [v, v[:-1]] if v.endswith("s") and len(v) > 3 else [v]
    return out


def test_tokens(spark):
    assert one(spark, tx.tokens("t"), t="Parser.parse_files v2") == ["parser.parse_files", "parser.parse_file", "parser", "parse", "files", "file", "v2", "v", "2"]
    assert one(spark, tx.tokens("t"), t="") == []
    assert one(spark, tx.tokens("t"), t=None) == []
    assert one(spark, tx.match_terms("t"), t="a a b") == ["a", "b"]


@settings(max_examples=12, deadline=None)
@given(st.lists(st.text(alphabet="abPix_.s09 -é\n", max_size=30), min_size=1, max_size=15))
def test_tokens_like_plain(spark, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", tx.tokens("t").alias("x")).collect()
    assert {r["i"]: r["x"] for r in rows} == {i: plain_tokens(t) for i, t in enumerate(texts)}


def test_lines_and_preview(spark):
    assert one(spark, tx.lines("t"), t="a\r\nb\n\nc\n") == ["a", "b", "", "c"]
    assert one(spark, tx.lines_with_ends("t"), t="a\nb") == ["a\n", "b"]
    assert one(spark, tx.preview("t", 5), t="a  b\nc d") == "a b…"
    assert one(spark, tx.heading_text(F.col("t")), t="## Two # ") == "Two #"


@settings(max_examples=12, deadline=None)
@given(st.lists(st.text(alphabet="abPix_.s09 -é\n", max_size=30), min_size=1, max_size=15))
def test_index_like_plain(spark, texts):
    """What is indexed of a text is what its tokens are in SQL: counts, terms and their places."""
    from collections import Counter

    from sondera.operators import words

    rows = spark.createDataFrame([(str(i), t, "Ab.c", None, "p/ab", "text") for i, t in enumerate(texts)], "chunk_id string, text string, symbol string, xml_path string, source_path string, kind string")
    weights = {"text": 1.0, "symbol": 8.0, "path": 3.0}
    for r in words.analysed(rows, weights).collect():
        text = texts[int(r["chunk_id"])]
        every = plain_tokens("\n".join([text, "Ab.c", "", "p/ab", "text"]))
        assert {x["token"]: x["tf"] for x in r["tokens"]} == Counter(every) and r["bag_length"] == len(every)
        runs = {"text": every, "symbol": plain_tokens("Ab.c"), "path": plain_tokens("p/ab")}
        want, length = {}, 0
        for field, tokens in runs.items():
            terms = re.findall("[a-z0-9]+", " ".join(tokens))
            length += len(terms)
            for at, term in enumerate(terms):
                want.setdefault(term, []).append(words.FIELD_BASE[field] + at)
        assert {x["term"]: x["places"] for x in r["terms"]} == want and r["phrase_length"] == length
        count = lambda term: sum(weights["path" if p >= words.FIELD_BASE["path"] else "symbol" if p >= words.FIELD_BASE["symbol"] else "text"] for p in want[term])  # noqa: E731, B023
        assert all(x["f"] == count(x["term"]) for x in r["terms"])


def test_credentials_in_messages(spark):
    out = one(spark, tx.without_credentials("t"), t="http://u:p@h/x?api_key=abc Password: zz bearer = qq y=1")
    assert out == "http://***@h/x?api_key=*** Password=*** bearer=*** y=1"


def test_citations(spark):
    df = spark.createDataFrame([("Repo", "abc123", "src/detector.py", 10, 14, None, "real-chunk-id")], "r string, c string, p string, s int, e int, i string, k string")
    col = F.col
    assert df.select(ct.code_citation(col("r"), col("c"), col("p"), col("s"), col("e"), col("i"), col("k"))).first()[0] == "Repo@abc123:src/detector.py:10-14"
    none = F.lit(None).cast("string")
    assert df.select(ct.code_citation(none, none, none, none, none, none, col("k"))).first()[0] == "real-chunk-id"
    assert df.select(ct.document_citation(F.lit("file.pdf"), F.lit(12), F.lit("Section"))).first()[0] == "file.pdf:p.12 §Section"
    assert df.select(ct.document_citation(none, none, none)).first()[0] == "unknown source"
    assert df.select(ct.with_url(F.lit("x"), F.lit("http://u"))).first()[0] == "x (http://u)"
    assert df.select(ct.public_remote(F.lit("git@github.com:o/r.git"))).first()[0] == "https://github.com/o/r"
    assert df.select(ct.public_remote(F.lit("https://other.example/o/r"))).first()[0] is None
    url = ct.citation_url(F.lit("https://gitlab.com/o/r"), F.lit("c"), F.lit("a.py"), F.lit(1), F.lit(2))
    assert df.select(url).first()[0] == "https://gitlab.com/o/r/-/blob/c/a.py#L1-2"


def test_vectors(spark):
    from sondera.providers import HashEmbedding

    df = spark.createDataFrame([("alpha",), ("",), (None,)], "t string")
    rows = df.select("t", vx.hash_embedding(F.col("t"), 6).alias("v")).collect()
    for r in rows:
        assert abs(sum(x * x for x in r["v"]) - 1) < 1e-9
        assert max(abs(a - b) for a, b in zip(r["v"], HashEmbedding(6).embed_query(r["t"] or ""))) < 1e-9
    zero = F.array(F.lit(0.0), F.lit(0.0))
    assert df.select(vx.cosine(zero, zero)).first()[0] == 0.0
    assert df.select(vx.hamming(vx.sign_bits(F.array(F.lit(1.0), F.lit(-1.0)), 2), vx.sign_bits(F.array(F.lit(1.0), F.lit(1.0)), 2))).first()[0] == 1
