"""Scanned pages."""

import random

from sondera.llm import scans as sc

BODY = ("every measurement between the two stations was repeated after the winter because the detector had been moved "
        "and nobody remembered which cable belonged to the portable generator of the western laboratory").split()


def page(rng, n, header, broken=None, misread=None, number=True):
    words = [rng.choice(BODY) for _ in range(60)]
    lines = [" ".join(words[i : i + 9]) for i in range(0, 60, 9)]
    if broken:
        lines[2] += f" {broken[0]}"
        lines[3] = f"{broken[1]} " + lines[3]
    if misread:
        lines[4] += f" {misread}"
    return "\n".join([header, "", *lines[:-1], lines[-1] + " end.", *(["", f"- {n} -"] if number else [])])


def test_faults_and_repair(spark, chunk):
    rng = random.Random(8)
    rows = [{"chunk_id": f"p{i}", "source_path": f"f{i // 4}.pdf", "file_key": f"/f{i // 4}.pdf", "ord": i % 4, "document_type": "pdf", "text": page(rng, i, "Kelhil Institute")} for i in range(40)]
    rows[0]["text"] = page(rng, 0, "Kelhil lnstitute", ("measure-", "ment"), "dctector")
    rows[1]["text"] = page(rng, 1, "Kelhil Institute", ("west¬", "ern"), "l3o")
    rows[2]["text"] = page(rng, 2, "Kelhil Institute", None, "between").replace("\n", "\r\n")
    rows[3]["document_type"] = None
    rows += [{"chunk_id": "n", "source_path": "f.pdf", "text": None}, {"chunk_id": None, "source_path": "f.pdf", "text": "x"}, {"chunk_id": "e", "source_path": "f.pdf", "text": ""}, {"chunk_id": "code", "text": "tbe dctector"}, {"chunk_id": "one", "source_path": "g.pdf", "text": "word"}]
    df = chunk(*rows, extra={"fault": 1, "item": "x", "line": 3})
    df = df.unionByName(df.limit(5))
    repair = sc.ScanRepair(df)
    got = {(r["chunk_id"], r["fault"], r["item"]) for r in repair.faults().collect()}
    assert len(got) == repair.faults().count()
    assert {x for x in got if x[0] == "p0"} == {("p0", "header", "Kelhil lnstitute"), ("p0", "pageno", "- 0 -"), ("p0", "hyphen", "measurement"), ("p0", "misread", "detector")}
    assert {x for x in got if x[0] == "p1"} == {("p1", "header", "Kelhil Institute"), ("p1", "pageno", "- 1 -"), ("p1", "hyphen", "western"), ("p1", "misread", "130")}
    assert {x[1] for x in got if x[0] == "p2"} == {"header", "pageno"} and not {x for x in got if x[0] in ("n", "e", "code", "one")}
    text = {r["chunk_id"]: r["text"] for r in repair.repaired().collect()}
    assert "measurement" in text["p0"] and "detector" in text["p0"] and "Institute" not in text["p0"] and "\n" not in text["p0"]
    assert text["e"] == "" and "n" not in text
    empty = sc.ScanRepair(df.limit(0))
    assert empty.faults().count() == 0 and empty.repaired().count() == 0


def test_page_numbers():
    for line in ("12", "- 12 -", "[12]", "Page 3 of 9", "xiv", "p. 7", "— 4 —", "l2", "Seite 5", "6O"):
        assert sc.is_page_number(line), line
    for line in ("12.", "306 percent", "", "mixed words", "the end", "1. Heading", "civic"):
        assert not sc.is_page_number(line), line


def test_parts():
    assert sc.fold("N0isy Transit Report") == sc.fold("Nolsy Transit Report") == sc.fold("Noisy Transit Report")
    words, breaks = sc.body_words("one two-\nthree, four\npre- and post-x", [])
    assert breaks == [("two", "three")] and "four" in words and "pre-" in words and "two" not in words
    assert sc.paragraphs("A b-\nc d.\n\n  E f.", [], {("b", "c"): "bc"}, {"d": "dd"}) == "A bc dd.\n\nE f."


def test_hyphens_kept(spark, chunk):
    text = "the long-term plan and the long-term view of a pre- and post-test value\nof long-\nterm pre-\nand post-\nwork"
    df = chunk({"chunk_id": "a", "source_path": "a.pdf", "text": text}, {"chunk_id": "b", "source_path": "b.pdf", "text": "post-war post-test post-date work"})
    got = {r["item"] for r in sc.ScanRepair(df).faults().where("fault = 'hyphen'").collect()}
    assert got == {"long-term", "post-work"}
