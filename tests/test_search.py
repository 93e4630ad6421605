"""Ranking by words and vectors, fusion, lookup, evaluation, the engine."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sondera import config as cf
from sondera.engine import Engine, collect_citations
from sondera.functions import text as tx
from sondera.functions import vectors as vx
from sondera.operators import dense, evaluate, filters, fusion, lexical, lookup
from sondera.operators.words import Variants, WordStore
from sondera.plans import catalogue
from sondera.providers import HashEmbedding


def ids(df, *keys):
    return [r["chunk_id"] for r in df.orderBy(*(keys or ("rank",))).collect()]


@pytest.fixture
def corpus_(chunk):
    return chunk(
        {"chunk_id": "m1", "text": "calibrate the detector now", "symbol": "Detector.calibrate", "source_path": "core/detector.py", "repository_name": "core", "kind": "method", "language": "python", "source_type": "code"},
        {"chunk_id": "m2", "text": "reset the detector", "symbol": "Detector.reset", "source_path": "core/detector.py", "repository_name": "core", "kind": "method", "language": "python", "source_type": "code"},
        {"chunk_id": "c", "text": "class Detector", "symbol": "Detector", "source_path": "core/detector.py", "repository_name": "core", "kind": "class", "source_type": "code"},
        {"chunk_id": "g", "text": "a guide about detectors", "source_path": "docs/guide.md", "document_type": "markdown", "source_type": "documents", "metadata": '{"section": "S"}'},
        {"chunk_id": "x", "text": "<pix id='1'/>", "source_path": "g.xml", "document_type": "xml", "xml_path": "root/pixArray", "source_type": "documents"},
        {"chunk_id": "e", "text": None, "source_path": None},
    )


def q(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts, 1)], "query_id long, query string")


def test_bm25(spark, corpus_):
    assert ids(lexical.bm25(corpus_, q(spark, "Detector.calibrate"), 1)) == ["m1"]
    assert ids(lexical.bm25(corpus_, q(spark, "pixels"), 3))[0] == "x"
    assert ids(lexical.bm25(corpus_, q(spark, "detector"), 10, {"repository_name": "core", "kind": "class"})) == ["c"]
    assert lexical.bm25(corpus_, q(spark, ""), 5).count() == 0
    assert "g" in ids(lexical.bm25(corpus_, q(spark, "docs/gu"), 5))
    with pytest.raises(ValueError):
        lexical.bm25(corpus_, q(spark, "x"), 0)
    assert lexical.bm25(corpus_.limit(0), q(spark, "detector"), 5).count() == 0


def test_phrases_rank(spark, corpus_):
    assert ids(lexical.bm25_phrases(corpus_, q(spark, "detector_reset"), 3))[0] == "m2"
    assert lexical.bm25_phrases(corpus_, q(spark, "_"), 3).count() == 0
    assert len(ids(lexical.bm25_phrases(corpus_, q(spark, "the detector"), 2, two_stage=True))) == 2


def test_whole_texts_and_a_bound(spark, chunk):
    """Whole texts are searched, unless a bound is asked for."""
    rows = chunk({"chunk_id": "long", "text": "word " * 40_001 + "marker", "source_path": "path/long.txt"})
    assert ids(lexical.bm25(rows, q(spark, "marker"), 5)) == ["long"] and ids(lexical.bm25_phrases(rows, q(spark, "marker"), 5)) == ["long"]
    assert lexical.bm25(rows, q(spark, "marker"), 5, most_chars=tx.MAX_INDEXED).count() == 0
    assert ids(lexical.bm25(rows, q(spark, "long"), 5, most_chars=tx.MAX_INDEXED)) == ["long"]


def test_phrase_counts(spark, chunk):
    """A phrase counts where its terms follow each other, in each field by its weight."""
    rows = chunk(
        {"chunk_id": "a", "text": "my_func my.func func my", "source_path": "z"}, {"chunk_id": "b", "text": "func my", "symbol": "my_func", "source_path": "z"}, {"chunk_id": "c", "text": "x", "symbol": "my", "source_path": "func"},
        {"chunk_id": "d", "text": None, "source_path": None}, {"chunk_id": "e", "text": "zz zz zz zz", "source_path": "q"},
    )
    hits, _ = lexical._phrase_hits(lexical.indexed(rows), q(spark, "my_func", "zz_zz"))
    got = {(r["chunk_id"], r["key"]): r["f"] for r in hits.collect()}
    index = lexical.indexed(rows)
    texts = {r["chunk_id"]: r for r in rows.collect()}
    for chunk_id, r in texts.items():
        fields = {"text": "\n".join(x or "" for x in (r["text"], r["symbol"], r["xml_path"], r["source_path"], r["kind"])), "symbol": r["symbol"] or "", "path": r["source_path"] or ""}
        for key in ("my func", "zz zz"):
            want, phrase = 0.0, key.split()
            for field, text in fields.items():
                terms = re.findall("[a-z0-9]+", " ".join(v for raw in re.findall(tx.TOKEN, text) for v in Variants()[raw]))
                want += lexical.FIELD_WEIGHTS[field] * sum(terms[i : i + len(phrase)] == phrase for i in range(len(terms)))
            assert got.get((chunk_id, key), 0.0) == want
    assert index.statistics("phrase_length")[0] == 5 and got["b", "my func"] == 18.0


def test_named_by_runs_and_letters(spark, chunk):
    rows = chunk({"chunk_id": "a", "symbol": "x", "source_path": "lib/my-long name/file.py"}, {"chunk_id": "b", "symbol": "Ab", "source_path": "other"})
    got = {(r["query_id"], r["chunk_id"]) for r in lexical._named(q(spark, "my-long name/file", "long", "b", "AB", "", "zz-long name/x", "lib/m"), rows).collect()}
    assert got == {(1, "a"), (2, "a"), (3, "a"), (3, "b"), (4, "b"), (7, "a")}


def test_stored_index(spark, chunk, tmp_path):
    """A stored index answers as one made on the way does, after every run."""
    store = WordStore(spark, f"file://{tmp_path}/words", lexical.FIELD_WEIGHTS, buckets=3, most_segments=2)
    assert store.read() is None
    asked = q(spark, "alpha beta", "gamma_delta", "a.py")
    make = lambda *texts, start=0, path="a": [{"chunk_id": f"{path}{i + start}", "text": t, "source_path": f"{path}.py", "file_key": f"/{path}.py"} for i, t in enumerate(texts)]
    files = {"a": make("alpha beta", "gamma delta gamma_delta", path="a"), "b": make("alpha", "beta beta", path="b")}
    steps = [(None, files["a"] + files["b"], None), ("a", make("alpha alpha gamma_delta", path="a"), None), ("c", make("delta gamma", "alpha beta", path="c"), None), ("b", [], "/b.py"), ("d", make("beta", path="d"), None)]
    now: dict[str, list] = {}
    for n, (name, rows, gone) in enumerate(steps):
        if name is None:
            now = dict(files)
        elif gone:
            now.pop(name)
        else:
            now[name] = rows
        fresh = chunk(*rows) if rows else chunk({"chunk_id": "x"}).limit(0)
        before = store.docs.pointer()["generation"]
        assert store.add(fresh, spark.createDataFrame([(gone,)], "file_key string") if gone else None, batch=str(n)) == before + 1
        assert store.add(fresh, batch=str(n)) == before + 1
        index, plain = store.read(), chunk(*[r for rs in now.values() for r in rs])
        for rank in (lexical.bm25, lexical.bm25_phrases):
            rounded = lambda df: sorted((r["query_id"], r["rank"], r["chunk_id"], round(r["score"], 9)) for r in df.collect())
            assert rounded(rank(index, asked, 5)) == rounded(rank(plain, asked, 5)), (n, rank)
    assert len(store.docs.pointer()["note"]) <= 2


def test_filters(corpus_):
    assert set(ids(filters.apply(corpus_, {"language": ["python"], "path_prefix": "core/"}), "chunk_id")) == {"m1", "m2"}
    assert filters.apply(corpus_, {"language": []}).count() == 0
    assert ids(filters.apply(corpus_, {"section": "S"}), "chunk_id") == ["g"]
    assert filters.apply(corpus_, {"symbol": None}).count() == 3
    assert filters.apply(corpus_, None).count() == 6


def test_dense(spark):
    rng = np.random.default_rng(0)
    m = rng.standard_normal((300, 16))
    rows = spark.createDataFrame([(f"v{i:03d}", [float(x) for x in v], i % 3) for i, v in enumerate(m)] + [("short", [1.0], 0), ("none", None, 0)], "chunk_id string, vector array<float>, label int")
    asked = rows.where("chunk_id in ('v000', 'v100')").select(F.col("chunk_id").alias("query_id"), "vector")
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    got = {(r["query_id"], r["rank"]): r["chunk_id"] for r in dense.nearest(rows, asked, 5, block=1).collect()}
    for name, i in (("v000", 0), ("v100", 100)):
        assert [got[name, k] for k in range(1, 6)] == [f"v{j:03d}" for j in np.argsort(-(unit @ unit[i]))[:5]]
    only = dense.nearest(rows, asked, 3, {"label": 1}).collect()
    assert all(int(r["chunk_id"][1:]) % 3 == 1 for r in only)
    for mode in ("scalar", "binary"):
        assert {r["chunk_id"] for r in dense.nearest(rows, asked, 1, mode=mode, oversampling=5).collect()} == {"v000", "v100"}
        stored = dense.quantised(rows, mode)
        assert stored.select(F.max(F.length(dense.QUANTISED[mode][0]))).first()[0] == {"scalar": 16, "binary": 2}[mode]
        assert sorted(map(tuple, dense.nearest(stored, asked, 5, mode=mode).collect())) == sorted(map(tuple, dense.nearest(rows, asked, 5, mode=mode).collect()))
    # queries in several parts and blocks, and equal vectors, by their keys
    same = rows.unionByName(rows.where("chunk_id = 'v000'").withColumn("chunk_id", F.concat(F.lit("a"), F.lit("0"))))
    for block, held in ((1, 1), (1024, 1 << 22)):
        assert [r["chunk_id"] for r in dense.nearest(same, asked.where("query_id = 'v000'"), 2, block=block, held=held).orderBy("rank").collect()] == ["a0", "v000"]
    found = dense.HashedIndex(rows, 16).search(asked, 5)
    assert {r["chunk_id"] for r in found.where("rank = 1").collect()} == {"v000", "v100"}
    assert dense.nearest(rows.limit(0), asked, 3).count() == 0 and dense.nearest(rows, asked.limit(0), 3).count() == 0


def test_hashed_recall(spark):
    """Of vectors without near neighbours at least nine tenths of the true neighbours are found, self matches left out."""
    m = np.random.default_rng(3).standard_normal((1500, 64))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, vector array<double>")
    asked = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "vector")
    index = dense.HashedIndex.fitted(rows, 64, key="vec_id")
    found = {(r["query_id"], r["vec_id"]) for r in index.search(asked, 11).collect()}
    assert index.bits == 6 and index.probes > 1 and index.shortlist < 0.12 * 1500
    true = {(i, int(j)) for i in range(0, 1500, 50) for j in np.argsort(-(m @ m[i]))[1:11]}
    assert len(true & found) / len(true) >= 0.9


def test_fitted_to_clusters(spark):
    """Where neighbours are near, few places are looked into."""
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((60, 32))
    m = np.repeat(centres, 20, axis=0) + 0.15 * rng.standard_normal((1200, 32))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, vector array<double>")
    index = dense.HashedIndex.fitted(rows, 32, key="vec_id")
    assert index.probes == 1
    asked = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "vector")
    got = index.search(asked, 10).collect()
    assert all(r["query_id"] // 20 == r["vec_id"] // 20 for r in got) and len(got) == 120
    assert dense.HashedIndex.fitted(rows.limit(0), 32, key="vec_id").search(asked, 5).count() == 0


def test_fusion(spark):
    lists = spark.createDataFrame([(1, 0, 1, "a"), (1, 0, 2, "b"), (1, 1, 1, "b"), (1, 1, 2, "c"), (1, 1, 2, "c"), (1, 1, 3, None)], "query_id int, list_idx int, rank int, chunk_id string")
    assert ids(fusion.reciprocal_ranks(lists, 3, k=10)) == ["b", "a", "c"]
    rows = spark.createDataFrame([(1, 1, "a", "s"), (1, 2, "b", "s"), (1, 3, "c", "t"), (1, 4, "d", None)], "query_id int, rank int, chunk_id string, source_path string")
    assert ids(fusion.diversify(rows, 1)) == ["a", "c", "d"] and ids(fusion.diversify(rows, None)) == ["a", "b", "c", "d"]
    hits = spark.createDataFrame([(1, 1, "a", 0.5, "calibrate", None, "calibrate detector"), (1, 2, "b", 0.1, "calibrate the detector", None, "calibrate detector")], "query_id int, rank int, chunk_id string, score double, text string, symbol string, query string")
    top = fusion.rerank(hits, 1).first()
    assert top["chunk_id"] == "b" and top["pre_rerank_score"] == 0.1


def test_lookup(spark, corpus_):
    targets = lookup.by_id(corpus_, "m2").withColumn("target_id", F.lit("t"))
    assert set(ids(lookup.neighbours(corpus_, targets, 1, 1), "ord")) == {"m1", "m2", "c"}
    assert ids(lookup.parent(corpus_, targets), "ord") == ["c"]
    assert ids(lookup.same_section(corpus_, lookup.by_id(corpus_, "g").withColumn("target_id", F.lit("t"))), "ord") == ["g"]
    aims = spark.createDataFrame([("a", "m2", None), ("b", None, "core/detector.py"), ("c", "zz", "nope")], "target_id string, chunk_id string, source_id string")
    assert {r["target_id"]: r["chunk_id"] for r in lookup.find(corpus_, aims).collect()} == {"a": "m2", "b": "m1"}
    assert ids(lookup.by_symbol(corpus_, "Detector", 5), "ord") == ["c"]


def test_metrics(spark):
    found = spark.createDataFrame([(1, r, i) for r, i in enumerate("xabc", 1)], "query_id int, rank int, chunk_id string")
    cases = spark.createDataFrame([(1, ["a", "c"]), (2, ["z"]), (3, [])], "query_id int, expected array<string>")
    rows = {r["query_id"]: r for r in evaluate.metrics(found, cases).collect()}
    assert (rows[1]["recall_at_5"], rows[1]["recall_at_10"], rows[1]["mrr"]) == (1.0, 1.0, 0.5)
    assert (rows[2]["recall_at_5"], rows[3]["mrr"]) == (0.0, 0.0)
    assert evaluate.averages(evaluate.metrics(found, cases.limit(0))).first()["mrr"] == 0.0


def test_engine(spark, corpus_):
    vectors = corpus_.select("chunk_id", vx.hash_embedding(F.col("text"), 8).alias("vector"))
    engine = Engine(corpus_, vectors, HashEmbedding(8), cf.Retrieval(max_results_per_source=1))
    asked = engine.queries("calibrate detector")
    assert engine.mode() == "hybrid"
    final = engine.stages(asked, 3).where("stage = 'final'")
    assert final.count() == 3 and engine.search(asked, 3).select("source_path").distinct().count() >= 3
    words = Engine(corpus_)
    assert words.mode() == "sparse_fallback" and Engine(corpus_, retrieval=cf.Retrieval(dense_candidates=0)).mode() == "sparse_only"
    assert set(ids(words.search_documents(asked, 5))) == {"g"}
    assert set(ids(words.search_code(asked, 5))) == {"m1", "m2", "c"}
    marked = corpus_.withColumn("document_type", F.when(F.col("chunk_id") == "e", "code").otherwise(F.col("document_type"))).withColumn("symbol", F.when(F.col("chunk_id") == "e", "Lonely").otherwise(F.col("symbol")))
    assert ids(Engine(marked).search_code(engine.queries("lonely"), 5)) == ["e"]
    with pytest.raises(ValueError):
        words.search_words(asked, 5, which="other")
    assert collect_citations(words.search_words(asked, 2)).count() == 2
    aims = spark.createDataFrame([("t", "m1", None)], "target_id string, chunk_id string, source_id string")
    assert "m1" not in ids(words.related(aims, 2)) and words.related(aims, 2).count() == 2
    lost = spark.createDataFrame([("z", "none", None)], "target_id string, chunk_id string, source_id string")
    assert words.read_source(aims).count() == 2 and [r["found"] for r in words.read_source(lost).collect()] == [False]
    assert "text" not in words.source_metadata(aims).columns
    assert words.info().first()["chunks"] == 6
    cases = spark.createDataFrame([(1, "calibrate detector", ["m1"])], "query_id long, query string, expected array<string>")
    assert words.evaluate(cases).first()["mrr"] == 1.0


@pytest.fixture
def failing():
    """A model that can't be reached, and one that embeds queries in another way than texts; made here so that executors get its code."""

    class Failing:
        dimensions = 2

        def __init__(self, works: bool = False):
            self.works = works

        def embed_texts(self, texts):
            if not self.works:
                raise ConnectionError("http://u:p@h refused token=abc")
            return np.array([[0.0, 1.0]] * len(texts))

        def embed_query(self, text):
            self.embed_texts([text])
            return np.array([1.0, 0.0])

        def scores(self, queries, texts):
            raise RuntimeError("no memory for the reranker")

    return Failing


def test_what_fails_is_done_without(spark, corpus_, failing):
    vectors = corpus_.select("chunk_id", F.array(F.lit(1.0), F.lit(0.0)).alias("vector")).where("chunk_id = 'g'").unionByName(corpus_.select("chunk_id", F.array(F.lit(0.0), F.lit(1.0)).alias("vector")).where("chunk_id = 'x'"))
    asked = q(spark, "calibrate detector")
    stages, said = Engine(corpus_, vectors, failing()).debug(asked, 3)
    assert said["mode"] == "sparse_fallback" and said["degraded"] and said["fallback_category"] == "service_unavailable" and "abc" not in said["fallback_detail"] and "u:p" not in said["fallback_detail"]
    assert stages.where("stage = 'final'").count() == 3
    with pytest.raises(Exception, match="refused"):
        Engine(corpus_, vectors, failing(), fall_back=False).debug(asked, 3)
    stages, said = Engine(corpus_, vectors, failing(True), cf.Retrieval(rerank=True), failing()).debug(asked, 3)
    assert said["mode"] == "hybrid" and said["reranked"] is False and "no memory" in said["reranker_error"]
    # queries are embedded as queries
    assert ids(stages.where("stage = 'dense'"))[0] == "g" and stages.where("stage = 'final'").count() == 3
    with pytest.raises(Exception, match="no memory"):
        Engine(corpus_, vectors, failing(True), cf.Retrieval(rerank=True), failing(), fall_back=False).debug(asked, 3)


@pytest.mark.parametrize("name", ["hybrid_search", "search_stages"])
def test_hybrid_search_fails_with_its_vectors(spark, chunk, tmp_path, monkeypatch, name):
    """A failed search by vectors is an error, not a ranking by words alone."""
    chunk({"chunk_id": "a", "text": "calibrate the detector"}).write.parquet(f"{tmp_path}/chunks.parquet")
    spark.createDataFrame([("i", "detector", ["a"])], "item_id string, query string, expected array<string>").write.parquet(f"{tmp_path}/eval_items.parquet")
    assert catalogue.queries()[name](spark, str(tmp_path)).count()

    def broken(*args, **more):
        raise RuntimeError("no vectors here")

    monkeypatch.setattr(dense, "nearest", broken)
    with pytest.raises(RuntimeError, match="no vectors here"):
        catalogue.queries()[name](spark, str(tmp_path))
    assert catalogue.queries()["sparse_fallback"](spark, str(tmp_path)).count() == 1


def test_own_retrievers(spark, corpus_):
    class Fixed:
        def search(self, queries, limit, filters=None):
            return queries.select("query_id", F.lit(1).alias("rank"), F.lit("g").alias("chunk_id"), F.lit(1.0).alias("score"))

    assert ids(Engine(corpus_, sparse=Fixed()).stages(q(spark, "a"), 1).where("stage = 'final'")) == ["g"]
    assert ids(Engine(corpus_, dense=Fixed(), sparse=Fixed()).stages(q(spark, "a"), 1).where("stage = 'final'")) == ["g"]


def test_http_embedding(monkeypatch):
    """Answers are tried again after trouble on the service's side, put in order and checked."""
    import json

    from sondera import providers as pv

    made = pv.HttpEmbedding("http://x.invalid", "m", batch_size=2, query_instruction="find: ", dimensions=2)
    monkeypatch.setattr(pv.time, "sleep", lambda s: None)
    asked, answers = [], []

    def ask(self, texts):
        asked.append(texts)
        answer = answers.pop(0)
        if isinstance(answer, Exception):
            raise pv._Again() from answer
        return answer

    monkeypatch.setattr(pv.HttpEmbedding, "_ask", ask)
    good = lambda *vectors: json.dumps({"data": [{"index": i, "embedding": v} for i, v in reversed(list(enumerate(vectors)))]}).encode()
    answers[:] = [pv.EmbeddingError("503"), b"<html>", good([1, 0], [0, 1]), good([1, 1])]
    assert made.embed_texts(["a", "b", "c"]).tolist() == [[1, 0], [0, 1], [1, 1]]
    answers[:] = [good([1, 0])]
    assert made.embed_query("a").tolist() == [1, 0] and asked[-1] == ["find: a"]
    for wrong in ([good([1, 0], [0, 1])], [good([1, 0, 0])], [pv.EmbeddingError("503")] * 4, [b"{}"] * 4):
        answers[:] = list(wrong)
        with pytest.raises(pv.EmbeddingError):
            made.embed_texts(["a"])
