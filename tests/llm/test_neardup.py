"""Near-duplicates against brute force."""

import random
import re

from sondera.llm import neardup as nd


def brute(texts, width, threshold, least):
    sets = {}
    for k, t in texts.items():
        w = re.findall(r"\w+", (t or "").lower())
        if len(w) >= max(1, least):
            n = min(width, len(w))
            sets[k] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    keys = sorted(sets)
    return {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold}


def family(rng, n):
    vocabulary = [f"w{i}" for i in range(400)]
    texts = {}
    for f in range(n):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(35, 90))]
        for c in range(rng.randrange(1, 5)):
            words = list(base)
            for _ in range(rng.randrange(0, 9)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts[f"d{f:03d}{c}"] = " ".join(words)
    return texts


def test_pairs_like_brute_force(spark, chunk):
    texts = family(random.Random(2), 60)
    texts |= {"copy1": texts["d0000"], "copy2": texts["d0000"].upper(), "short": "a b c", "empty": "", "null": None}
    rows = chunk(*[{"chunk_id": k, "text": t} for k, t in texts.items()], extra={"size": 1, "bands": 2})
    rows = rows.unionByName(rows.limit(30))
    got = {(r["chunk_id_a"], r["chunk_id_b"]) for r in nd.near_duplicate_pairs(rows, width=3, threshold=0.6, least_words=30, bands=32, rows=3).collect()}
    assert got == brute(texts, 3, 0.6, 30)


def test_classes(spark, chunk):
    rows = chunk(*[{"chunk_id": f"c{i}", "text": "one and the same text of some words"} for i in range(50)], {"chunk_id": None, "text": "x y z"}, {"chunk_id": "z", "text": "tiny"})
    members, links = nd.near_duplicate_classes(rows)
    assert members.select("alike").distinct().count() == 2 and members.count() == 51 and links.count() == 0
    members, links = nd.near_duplicate_classes(rows.limit(0))
    assert members.count() == 0 and links.count() == 0


def test_min_max_signature():
    rng = nd.np.random.default_rng(0)
    base = rng.integers(0, 2**63, 300, dtype=nd.np.uint64)
    alike = nd.np.concatenate([base[:240], rng.integers(0, 2**63, 60, dtype=nd.np.uint64)])
    agree = (nd.signature(nd.np.unique(base), 2000, 1, 7) == nd.signature(nd.np.unique(alike), 2000, 1, 7)).mean()
    assert abs(agree - 240 / 360) < 0.06
    assert (nd.signature(base[::-1], 8, 3, 7) == nd.signature(base, 8, 3, 7)).all()


def test_link_counts(spark, chunk):
    texts = family(random.Random(3), 30)
    texts |= {f"copy{i}": texts["d0000"] for i in range(7)}
    rows = chunk(*[{"chunk_id": k, "text": t} for k, t in texts.items()])
    pairs = brute(texts, 3, 0.6, 30)
    got = {r["chunk_id"]: r for r in nd.link_counts(rows, width=3, threshold=0.6, least_words=30, bands=32, rows=3).collect()}
    assert {k: r["links"] for k, r in got.items()} == {k: sum(k in p for p in pairs) for k in texts}
    assert got["copy3"]["class_id"] == "copy0" and got["copy3"]["copies"] == 8
    assert nd.link_counts(rows.limit(0)).count() == 0


def test_many_copies(spark, chunk, monkeypatch):
    """A class that is divided among tasks gives the same pairs."""
    monkeypatch.setattr(nd, "COPIES", 4)
    rows = chunk(*[{"chunk_id": f"c{i:02d}", "text": "one and the same text of some words"} for i in range(30)])
    got = [tuple(r) for r in nd.near_duplicate_pairs(rows).collect()]
    assert len(got) == len(set(got)) == 435


def test_key_filter(spark):
    from sondera.llm.columns import KeyFilter

    keys = nd.np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 3000)
    frame = spark.createDataFrame([(int(k),) for k in keys], "key long")
    for most in (1 << 28, 1 << 12):
        known = KeyFilter(frame, "key", most)
        assert known.passes(keys).all()
    other = nd.np.random.default_rng(2).integers(-(2**63), 2**63 - 1, 20_000)
    known = KeyFilter(frame, "key")
    assert known.passes(other).mean() < 0.1 and known.packed.value.nbytes <= 1 << 15
    assert not KeyFilter(frame.limit(0), "key").passes(other).any()


def test_boilerplate(spark, chunk, monkeypatch):
    """Texts that share a long beginning meet under one key, which is divided among tasks, and give the same pairs."""
    rng = random.Random(7)
    head = " ".join(f"licence{i}" for i in range(60))
    texts = {f"b{i:02d}": head + " " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.choice((8, 60)))) for i in range(60)}
    rows = chunk(*[{"chunk_id": k, "text": t} for k, t in texts.items()])
    options = {"width": 3, "threshold": 0.6, "least_words": 30, "bands": 32, "rows": 3}
    plain = {tuple(r) for r in nd.near_duplicate_pairs(rows, **options).collect()}
    monkeypatch.setattr(nd, "ROWS_OF_KEY", 3)
    monkeypatch.setattr(nd, "COUNTED", 2)
    assert {tuple(r) for r in nd.near_duplicate_pairs(rows, **options).collect()} == plain == brute(texts, 3, 0.6, 30) and len(plain) > 100
