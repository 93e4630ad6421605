"""Files, parsers, normalising, incremental indexing, snapshots, streams, settings."""

import json
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sondera import config as cf
from sondera import engine as en
from sondera import schema as sc
from sondera.operators import index as ix
from sondera.operators import normalize as nz
from sondera.operators.lexical import FIELD_WEIGHTS
from sondera.operators.latest import latest
from sondera.operators.words import WordStore
from sondera.sources import files, parsers, tables
from sondera.streaming import events as ev
from sondera.streaming.watch import index_stream


def test_latest(spark):
    rows = [("a", 1, "x"), ("a", 2, "y"), ("a", 2, "y"), (None, 3, "z"), ("b", None, "q"), ("b", None, "r")]
    df = spark.createDataFrame(rows, "k string, t int, v string")
    got = {r["k"]: r["v"] for r in latest(df, "k", "t", ["v"]).collect()}
    assert got["a"] == "y" and got["b"] in ("q", "r") and None not in got
    again = {r["k"]: r["v"] for r in latest(df.orderBy(F.desc("v")), "k", "t", ["v"]).collect()}
    assert again == got and latest(df.limit(0), "k", "t", ["v"]).count() == 0


def test_ids(chunk):
    rows = chunk({"text": "one"}, {"text": "two", "ord": 0}, {"text": "one", "ord": 0, "knowledge_id": "other"}).select(sc.chunk_id().alias("i"), sc.content_hash().alias("h")).collect()
    assert rows[0]["i"] == rows[1]["i"] and rows[0]["h"] != rows[1]["h"] and rows[0]["i"] != rows[2]["i"]


def test_discover(tmp_path):
    for name in ("a.py", "_b.py", ".env", "node_modules/x.py", "deep/c.md", "d.pyc"):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_text("x")
    (tmp_path / "link.py").symlink_to(tmp_path / "a.py")
    names = [p.rsplit("/", 1)[-1] for p in files.discover(tmp_path)]
    assert names == [".env", "_b.py", "a.py", "c.md"]
    assert files.discover(tmp_path / "a.py") == [str((tmp_path / "a.py").resolve())]


def test_parsers():
    md = parsers.markdown_chunks("drop\n# One\nBody\n## Two\nMore")
    assert [(c["metadata"]["heading"], c["start_line"], c["end_line"]) for c in md] == [("One", 2, 3), ("Two", 4, 5)]
    assert parsers.markdown_chunks("plain")[0]["end_line"] == 1
    source = "import os\nclass A(B):\n    @classmethod\n    def m(cls):\n        def inner(): pass\n    async def n(self): pass\ndef f():\n    def g(): pass\n"
    py = {c.get("symbol"): c["kind"] for c in parsers.python_chunks(source)}
    assert py == {None: "module", "A": "class", "A.m": "method", "A.n": "method", "f": "function", "g": "function"}
    made = parsers.python_chunks("from a import (b,\n  c)\nimport d as e\n@dec(1)\ndef f():\n    import g\nclass K:\n    if True:\n        def m(self): pass\n    class L:\n        def n(self): pass\n")
    assert made[0]["metadata"]["imports"] == ["from a import b, c", "import d as e"]
    assert [(c["symbol"], c["kind"], c["start_line"]) for c in made[1:]] == [("f", "function", 5), ("K", "class", 7), ("K.m", "method", 9), ("K.L", "class", 10), ("K.L.n", "method", 11)] and made[1]["metadata"]["decorators"] == ["dec(1)"]
    with pytest.raises(SyntaxError):
        parsers.python_chunks("def (")
    xml = parsers.xml_chunks("<root>\n<a>\n<detector>\n<pix/>\n<pix/>\n</detector>\n</a>\n</root>")
    # a closing tag closes the nearest of its name and no other; the rest ends with the text
    crossed = parsers.xml_chunks("<a>\n<b>\n<c>\n<d/>\n</b>\n<e>\n<f/>\n</e>\n</a>\n<!-- -->")
    assert [(c["symbol"], c["start_line"], c["end_line"]) for c in crossed] == [("a", 1, 9), ("a/b", 2, 5), ("a/b/c", 3, 10), ("a/c/e", 6, 8)]
    assert ("root/a/detector", 3, 6) in {(c["symbol"], c["start_line"], c["end_line"]) for c in xml}
    assert parsers.xml_chunks("<a/>") == []
    assert parsers.html_text("<head><title>t</title></head><h1>Title</h1><p>Hello <b>world</b></p>") == "# Title\nHello world"


def test_sections_like_parser(spark):
    rng = random.Random(3)
    texts = ["\n".join(rng.choice(["# h", "## k x", "text", "", "#!x"]) for _ in range(rng.randrange(9))) for _ in range(60)] + ["", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = sorted((r["i"], r["start_line"], r["end_line"], r["text"]) for r in tables.markdown_sections(df, "i").collect())
    want = sorted((i, c["start_line"], c["end_line"], c["text"]) for i, t in enumerate(texts) for c in parsers.markdown_chunks(t or ""))
    assert got == want


def test_windows():
    lines = ["x" * 37 + "\n"] * 40
    spans = nz.line_windows(lines, 100, 20)
    assert spans[0] == (0, 2) and spans[-1][1] == 40
    for (a, b), (c, d) in zip(spans, spans[1:]):
        assert a < c <= b and sum(map(len, lines[a:b])) <= 100
    assert nz.line_windows(["y" * 500 + "\n", "z\n"], 100, 0) == [(0, 1), (1, 2)] and nz.line_windows([], 10, 0) == []


def test_normalize(chunk):
    text = "".join(f"line {i:03d} of the big method, all alike\n" for i in range(40))
    rows = chunk({"text": text, "symbol": "Big.method", "start_line": 10, "ord": 5, "file_key": "/f"}, {"text": "small", "ord": 9, "file_key": "/f"})
    out = nz.normalize(rows, 25, 5).orderBy("ord").collect()
    assert [r["ord"] for r in out] == list(range(len(out))) and len({r["chunk_id"] for r in out}) == len(out)
    assert out[0]["start_line"] == 10 and out[-2]["end_line"] == 49 and all(r["symbol"] == "Big.method" for r in out[:-1])
    assert json.loads(out[0]["metadata"])["sub_chunk_count"] == str(len(out) - 1)
    assert nz.split_chunks(rows, None).count() == 2


def test_classify(spark):
    state = lambda *rows: spark.createDataFrame([("k", p, float(m), 1, s, None) for p, m, s in rows], sc.FILE_STATE)
    now, then = state(("a", 1, "x"), ("b", 2, "y"), ("c", 1, "z"), ("c", 1, "z")), state(("a", 1, "x"), ("b", 1, "y"), ("d", 1, "w"))
    assert {r["path"]: r["status"] for r in ix.classify(now, then).collect()} == {"a": "unchanged", "b": "changed", "c": "new", "d": "deleted"}
    assert ix.report(ix.classify(now, then)).first().asDict() == {"new": 1, "unchanged": 1, "changed": 1, "deleted": 1}
    assert ix.classify(now.limit(0), then.limit(0)).count() == 0


def test_replace_and_prune(chunk):
    rows = chunk({"source_path": "a.py", "chunk_id": "1"}, {"source_path": "a.py", "chunk_id": "2"}, {"source_path": "b.py", "chunk_id": "3"})
    fresh = chunk({"source_path": "a.py", "chunk_id": "1"})
    assert sorted(r["chunk_id"] for r in ix.replace_files(rows, fresh).collect()) == ["1", "3"]
    left, gone = ix.prune_unknown(rows, rows.where("chunk_id = '3'").select(F.col("source_path").alias("path")))
    assert [r["chunk_id"] for r in left.collect()] == ["3"] and [r["file_key"] for r in gone.collect()] == ["/r/a.py"]
    assert ix.delete_files(rows, rows.select("file_key")).count() == 0
    assert ix.counts(rows).first()["sources"] == 2


def test_snapshots_and_stream(spark, chunk, tmp_path):
    store = ix.Snapshots(spark, f"file://{tmp_path}/store")
    assert store.read() is None and store.read(sc.CHUNKS).count() == 0 and store.pointer()["generation"] == 0
    rows = chunk({"source_path": "a.py", "chunk_id": "1"}, {"source_path": "b.py", "chunk_id": "2"})
    assert store.write(rows) == 1 and store.write(rows, batch="x") == 2 and store.write(rows.limit(1), batch="x") == 2
    assert store.read().count() == 2
    rows.write.parquet(f"{tmp_path}/in")
    other = ix.Snapshots(spark, f"file://{tmp_path}/other")
    words = WordStore(spark, f"file://{tmp_path}/words", FIELD_WEIGHTS)
    for _ in range(2):
        source = spark.readStream.schema(sc.CHUNKS).parquet(f"{tmp_path}/in")
        index_stream(source, other, f"file://{tmp_path}/check", words=words).awaitTermination()
    assert words.read().docs.count() == 2
    assert other.read().count() == 2 and other.drop() and other.read() is None


def test_only_touched_buckets_are_written(spark, chunk, tmp_path):
    store = ix.Snapshots(spark, f"file://{tmp_path}/s", buckets=8, keep=2)
    rows = chunk(*[{"source_path": f"f{i}.py", "chunk_id": f"c{i}", "text": "t"} for i in range(40)])
    store.write(rows)
    first = store.pointer()["parts"]
    assert store.replace(chunk({"source_path": "f7.py", "chunk_id": "new"})) == 2
    second = store.pointer()["parts"]
    assert sum(first[b] != second[b] for b in first) == 1
    got = {r["chunk_id"] for r in store.read().collect()}
    assert got == {f"c{i}" for i in range(40)} - {"c7"} | {"new"}
    # an id that comes under another file goes from where it was
    store.replace(chunk({"source_path": "moved.py", "chunk_id": "c3"}))
    assert sorted(r["file_key"] for r in store.read().where("chunk_id = 'c3'").collect()) == ["/r/moved.py"] and store.read().count() == 40
    store.replace(rows.limit(0), rows.where("chunk_id = 'c5'").select("file_key"))
    assert store.read().where("chunk_id = 'c5'").count() == 0 and store.read().count() == 39
    names = [n for n in store._names() if n.startswith("manifest-")]
    assert len(names) == 2 and {p.split("/")[0] for n in names for p in store._manifest(n)["parts"].values()} >= {n for n in store._names() if n.startswith("v")} - {store._names()[-1]}


def test_two_writers_and_a_crash(spark, chunk, tmp_path, monkeypatch):
    """Of two writers one is told; what a writer left half done is never seen and never in the way."""
    one, two = (ix.Snapshots(spark, f"file://{tmp_path}/s") for _ in range(2))
    one.write(chunk({"chunk_id": "a"}))
    seen = one.pointer()
    two.write(chunk({"chunk_id": "b"}))
    monkeypatch.setattr(one, "pointer", lambda: seen)
    with pytest.raises(ix.Conflict):
        one.write(chunk({"chunk_id": "c"}))
    monkeypatch.undo()
    assert [r["chunk_id"] for r in one.read().collect()] == ["b"] and one.pointer()["generation"] == 2
    for step in ("_publish", "_tidy"):
        with monkeypatch.context() as m:
            m.setattr(ix.Snapshots, step, lambda *a: (_ for _ in ()).throw(OSError("lost")))
            with pytest.raises(OSError):
                one.write(chunk({"chunk_id": step}))
        want = "b" if step == "_publish" else "_tidy"
        assert [r["chunk_id"] for r in two.read().collect()] == [want]
    assert one.write(chunk({"chunk_id": "d"})) == 4 and [r["chunk_id"] for r in two.read().collect()] == ["d"]


def test_noise(spark, tmp_path):
    files_ = spark.createDataFrame([("/r/a.npy", 5), ("/r/b/c.zip", 7), ("/r/htmlcov/x.py", 1), ("/r/htmlcov/y.log", 2), ("/r/.log", 3), ("/r/ok.py", 9), (None, 1)], "path string, size long")
    got = {r["category"]: (r["files"], r["bytes"], r["folders"], r["samples"]) for r in ix.noisy_files(files_).collect()}
    assert got == {"binary/data": (1, 5, 0, "a.npy"), "archives": (1, 7, 0, "c.zip"), "logs/cache/build": (0, 0, 1, "htmlcov"), "logs": (1, 2, 0, "y.log")}
    assert "archives" not in {r["category"] for r in ix.noisy_files(files_, (".zip",)).collect()} and ix.noisy_files(files_.limit(0)).count() == 0
    config = cf.Config(cf.Knowledge("demo"), cf.Storage(str(tmp_path)), sources=cf.Sources(code=[cf.Source(path=str(tmp_path))]))
    cf.save(config, tmp_path / "demo.yaml")
    assert en.ignore_noise(config, ["logs/cache/build"], tmp_path / "demo.yaml") and not en.ignore_noise(config, ["logs/cache/build"])
    assert "htmlcov" in cf.load(tmp_path / "demo.yaml").indexing.ignored_directories


def test_jsonl_and_documents(spark, chunk, tmp_path):
    chunk({"source_path": "a.md", "text": "t"}).write.json(f"{tmp_path}/j")
    assert tables.read_jsonl(spark, f"{tmp_path}/j").first()["text"] == "t"
    store = ix.Snapshots(spark, f"file://{tmp_path}/from-lines")
    assert tables.import_jsonl(spark, f"{tmp_path}/j", store) and not tables.import_jsonl(spark, f"{tmp_path}/j", store) and store.read().count() == 1
    broken = tables.parsed_texts(spark.createDataFrame([(1, "def ("), (2, "x = 1")], "i int, t string"), "i", "t", parsers.python_chunks)
    assert {(r["i"], r["kind"], r["start_line"]) for r in broken.collect()} == {(1, "error", None), (2, "module", 1)}
    docs = spark.createDataFrame([(1, "a\nb", None, None, None, None, None)], "doc_id long, text string, lang string, source string, document_type string, repository_name string, updated_at timestamp")
    row = tables.documents_as_chunks(docs).first()
    assert row["end_line"] == 2 and row["source_path"] == "unknown/1" and row["chunk_id"].startswith("documents_chk_")
    (tmp_path / "e.yaml").write_text("queries:\n- query: q\n  expected: a\n- query: r\n  expected: [b, c]\n")
    assert [r["expected"] for r in tables.read_evaluation(spark, str(tmp_path / "e.yaml")).collect()] == [["a"], ["b", "c"]]


def test_index_run(spark, tmp_path):
    root = tmp_path / "src"
    root.mkdir()
    (root / "good.py").write_text("def f():\n    return 1\n")
    (root / "bad.py").write_text("def (\n")
    config = cf.Config(cf.Knowledge("demo"), cf.Storage(str(tmp_path / "data")), sources=cf.Sources(code=[cf.Source(path=str(root))]))
    config.models.embedding.dimensions = 8
    first = en.index_config(spark, config, embed=True)
    assert (first.new, first.failed, first.chunks, first.dense_error) == (2, 1, 2, None)
    (root / "note.md").write_text("# One\nBody\n## Two\nMore\n")
    second = en.index_config(spark, config)
    assert (second.new, second.unchanged, second.chunks) == (2, 1, 4)
    (root / "good.py").unlink()
    assert en.index_config(spark, config).deleted == 1
    engine = en.open_engine(spark, config)
    assert engine.chunks.count() == 2 and engine.mode() == "hybrid"
    assert en.embed_config(spark, config) == 2
    assert engine.search(engine.queries("Two More"), 1).first()["symbol"] == "Two"
    assert en.delete_source_vectors(spark, config, "note.md") == 0
    assert en.delete_index(spark, config) == (True, None) and not (tmp_path / "data").exists()


def test_settings(tmp_path, monkeypatch):
    monkeypatch.setenv("SONDERA_HOME", str(tmp_path))
    path = cf.create("one", [str(tmp_path)])
    loaded = cf.load(path)
    assert loaded.retrieval.dense_candidates == 40 and loaded.parsing.max_chunk_tokens == 1200 and loaded.collection == "kb_one"
    assert [c.knowledge.id for _, c in cf.listed()] == ["one"] and cf.resolve("one") == path
    with pytest.raises(cf.ConfigError):
        cf.create("one", [])
    with pytest.raises(cf.ConfigError):
        cf.Knowledge("../x")
    (tmp_path / "bad.yaml").write_text("knowledge: {id: b}\nnonsense: 1\n")
    with pytest.raises(cf.ConfigError):
        cf.load(tmp_path / "bad.yaml")


def test_errors():
    error = en.compact_error(ConnectionError("http://u:p@h refused token=abc"))
    assert "u:p" not in error and "abc" not in error
    assert en.error_category(ConnectionError("x")) == "service_unavailable" and en.error_category(ImportError("x")) == "missing_dependency"


def test_windows_in_time(spark):
    at = [datetime(2026, 1, 1, 0, m) for m in (0, 10, 50)]
    df = spark.createDataFrame([(t, "a", 1, 2.0) for t in at], "ts timestamp, event_type string, user_id int, value double")
    assert ev.windows(df, "30 minutes").count() == 2 and ev.sessions(df, "15 minutes").count() == 2
