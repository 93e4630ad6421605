"""Files that no project member wrote by hand."""

import random

import pandas as pd
import pytest

from sondera.llm import handwritten as hw

NOTICES = ["# Code generated by x. DO NOT EDIT.", "// <auto-generated>", "# @generated by tool from a.schema", "# machine made (x) - edit a.tmpl instead", "# -- x: emitted 12 definitions, do not touch --", "# end of output written by x; local changes are overwritten"]
THIRD = ["# Vendored from lib 1.6, local changes: none", "# Copied verbatim from the Lib sources (commit 12ab). Please send fixes upstream.", "/*! lib v4.1.0 | (c) Lib contributors | MIT License */", " * Licensed with the terms of its own project, see upstream LICENSE."]
TALK = ["# Fails when a file lacks the DO NOT EDIT line.", "// Hand-kept mirror of the generated bindings; edit freely.", "# Writes the generated tables; this script itself is maintained by hand.", "# We used to vendor lib here and no longer do.", "# Copyright the own-repo contributors", "# Checks that minified assets are fresh."]


@pytest.mark.parametrize("line", NOTICES)
def test_generated(line):
    assert "generated:notice" in hw.text_signs(f"import a\n{line}\nx = 1", "py")[0]
    assert line not in hw.masked(f"import a\n{line}\nx = 1")


@pytest.mark.parametrize("line", THIRD)
def test_third_party(line):
    assert "vendored:notice" in hw.text_signs(f"{line}\nx = 1", "py")[0]


@pytest.mark.parametrize("line", TALK)
def test_talk(line):
    assert hw.text_signs(f"{line}\nx = 1", "py")[0] == []


def test_paths_and_shapes():
    yes = {"a/vendor/b.py": "vendored:path", "a/app.min.js": "minified:name", "a/x_pb2.py": "generated:name", "a/poetry.lock": "generated:lock", "a/src/chunk.a39f58be.js": "minified:name", "a/build/x.c": "generated:folder", "a/lib-1.2.3.js": "vendored:release"}
    for path, sign in yes.items():
        assert sign in hw.path_signs(path), path
    for path in ("a/vendor_portal/b.py", "a/autogen_check/c.py", "a/codegen/e.py", "a/tools/builders/x.py", "a/minify_x.go", None, ""):
        assert hw.path_signs(path) == [], path
    assert "minified:lines" in hw.text_signs("var a=f(b)||c.d;" * 200, "js")[0] and hw.text_signs("word " * 300, "js")[0] == []
    assert hw.text_signs("    0.1234567, 0.2345678, 0.3456789,\n" * 40, "py")[1] > hw.LEAST_DATA


def test_files(spark, chunk):
    rng = random.Random(9)
    rows = []

    def add(path, *texts, repo="own", **more):
        rows.extend({"chunk_id": f"{path}{i}", "source_path": path, "file_key": "/" + path, "repository_name": repo, "text": t, **more} for i, t in enumerate(texts))

    for i in range(120):
        code = "\n".join(f"def {rng.choice('load save read write'.split())}_{rng.randrange(99)}(value):\n    {rng.choice(TALK)}\n    return value.{rng.choice('strip lower items'.split())}()" for _ in range(8))
        add(f"r{i % 11}/src/f{i}.py", code, repo=f"r{i % 11}")
        add(f"r{i % 11}/core/g{i}.py", NOTICES[i % 6].replace("x", rng.choice("abcdxyz")).replace("12", str(i)) + "\n" + _pool(rng), repo=f"r{i % 11}")
        add(f"r{i % 11}/{rng.choice(('vendor', 'node_modules', 'app/deps'))}/v{i}.py", code, repo=f"r{i % 11}")
    add("r0/deep/late.py", "x = 1", "y = 2\n" + NOTICES[5])
    add("r0/talk.py", TALK[0] + "\nx = 1")
    add("r0/quiet.py", _pool(rng))
    add("r0/readme.md", NOTICES[0])
    add("r0/conf.yaml", "a: 1")
    add("r0/pnpm-lock.yaml", "a: 1")
    rows += [{"chunk_id": "n", "file_key": None, "text": "x"}, {"chunk_id": "m", "file_key": "/m.py", "source_path": None, "text": None}, {"chunk_id": None, "file_key": "/q.py", "text": "x"}, {"chunk_id": "o", "file_key": "/o.py", "source_path": None, "text": "", "repository_name": None}]
    df = chunk(*rows, extra={"signs": 1, "data": 2, "repository": "x"})
    df = df.unionByName(df.limit(10))
    got = {r["file_key"]: r["signs"] for r in hw.foreign_files(df).collect()}
    assert "generated:remark" in got["/r0/deep/late.py"] and got["/r0/talk.py"] == [] and got["/o.py"] == [] and "/r0/pnpm-lock.yaml" in got
    assert not {"/r0/readme.md", "/r0/conf.yaml", "/m.py", "/q.py"} & set(got)
    # the classifier of texts knows what is made, though it never saw the notices
    assert "generated:text" in got["/r0/quiet.py"]
    assert sum("generated:text" in got[f"/r{i % 11}/core/g{i}.py"] for i in range(120)) >= 110
    assert sum(any(s.startswith("vendored") for s in signs) for f, signs in got.items() if "/v" in f.rsplit("/", 1)[-1] or "/v" in f) >= 115
    assert sum(bool(got[f"/r{i % 11}/src/f{i}.py"]) for i in range(120)) <= 2
    assert hw.foreign_files(df.limit(0)).count() == 0


def _pool(rng):
    return "\n".join(f'_POOL_{rng.randrange(999)} = _pool.add("a.b{rng.randrange(99)}", {rng.randrange(999)}, b"x")' for _ in range(20))


def _row(text, path, repository, signs):
    return text, path, repository, signs, hw.text_bins(text), hw.remarks(text)


COLUMNS = ["text", "source_path", "repository", "signs", "bins", "remarks"]


def test_classifier_without_notices():
    rng = random.Random(10)
    hand = lambda: "\n".join(f"def {rng.choice('load save read'.split())}_{rng.randrange(99)}(value):\n    return value.{rng.choice('strip lower'.split())}()" for _ in range(8))
    rows = [_row(hand(), f"r{i % 11}/src/f{i}.py", f"r{i % 11}", []) for i in range(80)] + [_row(NOTICES[i % 6] + "\n" + _pool(rng), f"r{i % 11}/src/g{i}.py", f"r{i % 11}", ["generated:notice"]) for i in range(60)]
    model = hw.Classifiers(pd.DataFrame(rows, columns=COLUMNS))
    judged = model.report["generated", "text"]
    assert judged["precision"] >= 0.97 and judged["recall"] >= 0.9
    assert model.judge([_pool(rng) for _ in range(20)], ["new/src/x.py"] * 20)[:, 0, 0].sum() >= 18
    assert model.judge([hand() for _ in range(20)], ["new/src/y.py"] * 20).any(axis=(1, 2)).sum() <= 1


def test_classifier_needs_examples(caplog):
    sample = pd.DataFrame([_row("a b", "x.py", "r", ["generated:notice"]), _row("c d", None, None, [])], columns=COLUMNS)
    model = hw.Classifiers(sample)
    assert not model.judge(["a b", ""], ["x.py", None]).any() and "no classifier of minified files" in caplog.text
    assert model.report["minified", "text"] == {"threshold": float("inf"), "examples": 0}


def test_cut():
    import numpy as np

    cut, precision, recall = hw.best_cut(np.array([3.0, 2.0, 1.0, 0.0, -1.0]), np.array([True, True, False, True, False]), 0.97)
    assert (cut, precision) == (1.5, 1.0) and recall == pytest.approx(2 / 3)
    assert hw.best_cut(np.array([1.0, 1.0]), np.array([True, False]), 0.97)[0] == float("inf") and hw.best_cut(np.array([]), np.array([], bool), 0.9)[0] == float("inf")


def test_remarks_are_judged_line_by_line():
    """A notice among many other remarks counts as one that stands alone; a long line too."""
    rng, rows = random.Random(4), []
    for i in range(200):
        line = f"# Code generated by tool{i}. DO NOT EDIT." if i % 2 else rng.choice(TALK)
        rows.append(_row(line + f"\nx{i} = {i}", f"r{i % 13}/a{i}.py", f"r{i % 13}", ["generated:notice"] if i % 2 else []))
    model = hw.Classifiers(pd.DataFrame(rows, columns=COLUMNS))
    many = "\n".join(TALK * 50)
    said = model.judge([many + "\n# Code generated by abc. DO NOT EDIT.", many, "# " + "word " * 5000], ["q/b.py"] * 3)[:, 0, 2]
    assert said.tolist() == [True, False, False]
