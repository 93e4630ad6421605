"""Leaked passages."""

import random

from sondera.llm import leaks as lk


def passage(rng, n):
    return [f"{rng.choice('bcdfgklmnprst')}{rng.choice('aeiou')}{rng.choice('bcdfgklmnprst')}{rng.randrange(99)}" for _ in range(n)]


def test_found_and_not(spark):
    rng = random.Random(4)
    items = {i: passage(rng, 40) for i in range(1, 9)}
    noise = lambda n: passage(rng, n)
    docs, want = [], set()

    def doc(i, words, item=None):
        docs.append((i, " ".join(words)))
        if item:
            want.add((i, item))

    doc(1, noise(50) + items[1] + noise(50), 1)
    doc(2, noise(20) + items[2][:22] + noise(60), 2)
    doc(3, noise(20) + items[3][:14] + noise(60))
    changed = list(items[4])
    for k in (5, 17, 29):
        changed[k] = "other"
    doc(4, [w.upper() + "," for w in changed], 4)
    doc(5, items[5][:12] + items[5][13:30] + ["<b>added</b>"] + items[5][30:], 5)
    doc(6, noise(150))
    doc(7, items[6][::-1])
    docs += [(8, None), (9, ""), (None, " ".join(items[1])), (1, docs[0][1])]
    for i in range(100, 160):  # one item in very many documents
        doc(i, items[8] + noise(5), 8)
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS item_id", "2 AS seed")
    rows = [(i, "Read this and answer now. " + " ".join(w) if i % 2 else " ".join(w)) for i, w in items.items()] + [(20, None), (21, ""), (None, "x y")] + [(30 + i, "Read this and answer now. " + " ".join(noise(30))) for i in range(4)]
    given = spark.createDataFrame(rows + rows[:1], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in lk.leaked_passages(df, given).collect()}
    assert got == want
    assert lk.leaked_passages(df.limit(0), given).count() == 0 and lk.leaked_passages(df, given.limit(0)).count() == 0


def test_alignment():
    p = lk.np.arange(1, 21, dtype=lk.np.uint64)
    d = lk.np.concatenate([lk.np.full(5, 99, lk.np.uint64), p[:10], p[11:], lk.np.full(3, 98, lk.np.uint64)])
    assert lk.best_stretches([(p, d), (p, p), (p, d[:0]), (p[:0], d)]) == [(19, 20, 1), (20, 20, 0), (0, 0, 0), (0, 0, 0)]


def test_clean_part_of_an_edited_stretch():
    """Half a passage counts although a longer alignment bridges what was changed, and although a longer copy is edited too much."""
    p = lk.np.arange(1, 101, dtype=lk.np.uint64)
    other = lambda n: lk.np.full(n, 999, lk.np.uint64)
    bridged = lk.np.concatenate([other(9), p[:55], other(20), p[75:], other(9)])
    longer = lk.np.concatenate([other(9), p[:60], other(18), p[78:], other(9)])
    spoilt = p.copy()
    spoilt[3::5] = 998  # every fifth word changed
    two = lk.np.concatenate([other(9), spoilt, other(300), p[:52], other(9)])
    none = lk.np.concatenate([other(9), p[:45], other(20), p[65:], other(9)])
    pairs = [(p, bridged), (p, longer), (p, two), (p, none), (p, spoilt)]
    assert [r[1] > 0.5 * 100 and r[2] <= 0.15 * r[1] + 0.5 for r in lk.best_stretches(pairs, limits=(0.5, 0.15))] == [True, True, True, False, False]


def test_long_document():
    """Scores don't run over, and stretches across the cuts of a long document are whole."""
    p = lk.np.arange(1, 101, dtype=lk.np.uint64)
    for size, places in ((100_000, (50, 30_000, 59_900, 70_000, 99_900)), (1_000_000, (499_950,))):
        for at in places:
            d = lk.np.full(size, 999, lk.np.uint64)
            d[at : at + 100] = p
            assert lk.best_stretches([(p, d)]) == [(100, 100, 0)]


def test_words():
    assert lk.words("**Bold** <i>and</i> [link](http://x.y) snake_case\nÉté") == ["bold", "and", "link", "snake", "case", "été"]


def test_long_documents_in_a_frame(spark):
    """A passage with one edit is found in documents of every length with all of its words, and isn't where it isn't."""
    rng = random.Random(8)
    item = passage(rng, 80)
    edited = item[:30] + ["added"] + item[30:]
    docs = []
    for i, size in enumerate((10_000, 40_000, 70_000, 140_000)):
        body = [f"n{rng.randrange(10**6)}" for _ in range(size)]
        docs += [(i, " ".join(body[: size // 2] + edited + body[size // 2 :])), (100 + i, " ".join(body))]
    got = lk.leaked_passages(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()
    assert sorted((r["doc_id"], r["matched"], r["edits"]) for r in got) == [(i, 80, 1) for i in range(4)]


def test_what_cannot_fit_is_not_aligned():
    """The bound on shared runs leaves out no stretch within the limits."""
    rng = random.Random(6)
    np = lk.np
    for _ in range(300):
        words = rng.randrange(4, 90)
        p = np.array([rng.randrange(60) if rng.random() < 0.2 else rng.randrange(10**6) for _ in range(words)], np.uint64)
        d = list(p[rng.randrange(max(1, words // 2)) :])
        for _ in range(rng.randrange(0, 12)):
            at = rng.randrange(len(d) + 1)
            d[at : at + rng.randrange(2)] = [7_000_000] if rng.random() < 0.6 else []
        d = np.array([8_000_000] * 5 + d + [8_000_000] * 5, np.uint64)
        best = lk.best_stretches([(p, d)], limits=(0.5, 0.15))[0]
        if lk._fits(best, words, 0.5, 0.15):
            assert lk._may_fit(words, np.unique(lk.runs(p, 4)), np.unique(lk.runs(d, 4)), 4, 0.5, 0.15)
