"""Held-out passages that stand, wholly or in part, in training documents.

Runs of words of the passages are seeds. Around every place of a passage its
rarest seeds, by their number of documents, are kept; documents that share
some with a passage are aligned with it word by word (Smith and Waterman), so
changed, added and dropped words are bridged.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sondera.llm.columns import KeyFilter, spread
from sondera.llm.neardup import WordCodes, mix
from sondera.session import settle

_MARKUP = re.compile(r"<[^<>\n]*>|&[a-z]{2,8};|\]\([^()\s]*\)")
_WORD = re.compile(r"[^\W_]+")

def words(text: str | None) -> list[str]:
    """Words without case, punctuation, spacing and markup."""
    if not text:
        return []
    if "<" in text or "&" in text or "](" in text:
        text = _MARKUP.sub(" ", text)
    return _WORD.findall(text.lower())


def runs(codes: np.ndarray, width: int) -> np.ndarray:
    """A number for each run of ``width`` words, in order."""
    if len(codes) < width:
        return np.empty(0, np.uint64)
    out = np.zeros(len(codes) - width + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(width):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + codes[i : len(codes) - width + 1 + i])
    return out


def _coded(text: str | None, codes: WordCodes) -> np.ndarray:
    found = words(text)
    return np.fromiter(map(codes.__getitem__, found), np.uint64, len(found))


def passages(items: DataFrame, common: float = 0.02) -> DataFrame:
    """item_id, text without a first sentence that several items share.

    A first sentence counts as a common instruction if more than three items
    and more than ``common`` of all begin with it. Of repeated item ids one
    counts; items without an id or a text are left out.
    """
    first = F.regexp_extract("text", r"^\s*([^.!?\n]+[.!?:])\s", 1)
    rows = items.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).groupBy("item_id").agg(F.max("text").alias("text")).withColumn("_first", first)
    counts = rows.where("_first <> ''").groupBy("_first").agg(F.count("*").alias("_n"))
    shared = counts.where(F.col("_n") > max(3, common * rows.count())).select("_first", F.lit(True).alias("_common"))
    joined = rows.join(shared, "_first", "left")
    return joined.select("item_id", F.when(F.col("_common"), F.substring(F.ltrim("text"), F.length("_first") + 1, F.length("text"))).otherwise(F.col("text")).alias("text"))


#: Parts of a seed's documents.
SALTS = 8


def leaked_passages(documents: DataFrame, items: DataFrame, width: int = 4, near: int = 6, keep: int = 3, least: int = 2, part: float = 0.5, edits: float = 0.15) -> DataFrame:
    """Pairs of a document and an item that leaked into it: doc_id, item_id, matched, item_words, edits.

    A pair counts if one stretch of the document aligns with at least ``part``
    of the item's words, with at most ``edits`` changed, added or dropped words
    for each word of the stretch. A seed is kept if it is among the ``keep``
    rarest of some ``near`` seeds in a row, so no part of a passage is without
    seeds, however often a passage leaked. ``least`` shared seeds make a pair a
    candidate (one, for passages that have fewer).

    Documents without an id or a text, and items without, give no rows; of
    repeated document ids every text counts and pairs are listed once. Other
    columns are ignored.
    """
    held = settle(passages(items))

    def item_seeds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes = WordCodes()
        for batch in batches:
            for item, text in zip(batch["item_id"], batch["text"]):
                coded = _coded(text, codes)
                if len(coded):
                    seeds = runs(coded, min(width, len(coded)) if len(coded) < width else width)
                    yield pd.DataFrame({"item_id": item, "at": np.arange(len(seeds)), "seed": seeds.view(np.int64), "item_words": len(coded)})

    seeds = settle(held.mapInPandas(item_seeds, "item_id long, at int, seed long, item_words int"))
    known = KeyFilter(seeds, "seed")

    def doc_seeds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes = WordCodes()
        for batch in batches:
            # the runs of a whole batch at once, but for those across two documents
            coded = [_coded(t, codes) for t in batch["text"]]
            sizes = np.array([len(c) for c in coded], np.int64)
            owner = np.repeat(np.arange(len(coded)), sizes)
            every = runs(np.concatenate(coded), width).view(np.int64) if len(coded) else np.empty(0, np.int64)
            at = np.flatnonzero((owner[: len(every)] == owner[width - 1 : width - 1 + len(every)]) & known.passes(every))
            found = pd.DataFrame({"doc_id": batch["doc_id"].to_numpy()[owner[at]], "seed": every[at]})
            yield found.drop_duplicates()

    texts = documents.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long"), "text")
    texts = spread(texts, "doc_id")
    hits = settle(texts.mapInPandas(doc_seeds, "doc_id long, seed long").distinct())
    df = hits.groupBy("seed").agg(F.count("*").alias("df"))
    # the rarest seeds of every window of a passage
    ranked = seeds.join(df, "seed")
    rank_in = [F.struct("df", "seed", "at")]
    span = Window.partitionBy("item_id").orderBy("at")
    kept = ranked.withColumn("_mine", rank_in[0])
    windows = [F.sort_array(F.collect_list("_mine").over(span.rangeBetween(-b, near - 1 - b))) for b in range(near)]
    chosen = F.lit(False)
    for window in windows:
        chosen = chosen | F.array_contains(F.slice(window, 1, keep), F.col("_mine"))
    kept = kept.withColumn("_chosen", chosen).where("_chosen").select("seed", "item_id").distinct()
    # as many seeds as the passage has, if it has fewer than asked for
    need = seeds.groupBy("item_id").agg(F.least(F.lit(least), F.countDistinct("seed")).alias("_need"))
    # a seed that a third of all documents have is spread over some tasks
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("_salt")
    salted = kept.select("seed", "item_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    candidates = hits.select("doc_id", "seed", salt).join(salted, ["seed", "_salt"]).groupBy("doc_id", "item_id").agg(F.count("*").alias("_n")).join(need, "item_id").where(F.col("_n") >= F.col("_need"))
    candidates = settle(candidates.select("doc_id", "item_id"))
    # only texts of candidates leave the scan
    asked = KeyFilter(candidates.select(F.xxhash64("doc_id").alias("key")).distinct(), "key")

    def wanted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.loc[asked.passes(batch["key"].to_numpy(dtype=np.int64)), ["doc_id", "text"]]

    chosen = texts.select("doc_id", "text", F.xxhash64("doc_id").alias("key")).mapInPandas(wanted, "doc_id long, text string")
    pairs = candidates.join(chosen, "doc_id").join(held.select("item_id", F.col("text").alias("passage")), "item_id")

    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes = WordCodes()
        for batch in batches:
            # a document or passage of several pairs is read once for a batch
            once = {t: _coded(t, codes) for t in {*batch["passage"], *batch["text"]}}
            cut = {t: np.unique(runs(c, width)) for t, c in once.items()}
            may = np.array([_may_fit(len(once[p]), cut[p], cut[t], width, part, edits) for p, t in zip(batch["passage"], batch["text"])], bool)
            batch = batch[may]
            made = [(once[p], once[t]) for p, t in zip(batch["passage"], batch["text"])]
            results = best_stretches(made, limits=(part, edits))
            out = batch[["doc_id", "item_id"]].assign(
                matched=[r[0] for r in results], spanned=[r[1] for r in results], edits=[r[2] for r in results], item_words=[len(p) for p, _ in made]
            )
            good = [_fits(r, len(p), part, edits) for r, (p, _) in zip(results, made)]
            yield out.loc[good, ["doc_id", "item_id", "matched", "item_words", "edits"]]

    aligned = pairs.select("doc_id", "item_id", "passage", "text").mapInPandas(align, "doc_id long, item_id long, matched int, item_words int, edits int")
    return aligned.groupBy("doc_id", "item_id").agg(F.max(F.struct("matched", "item_words", "edits")).alias("_best")).select("doc_id", "item_id", "_best.*")


def _may_fit(words: int, passage: np.ndarray, document: np.ndarray, width: int, part: float, edits: float) -> bool:
    """Whether a document can hold a stretch within the limits: each edit costs as many runs of a passage as a run has words, no more.

    Runs that a passage repeats count once, so as many as repeat are allowed for.
    """
    span = part * words
    repeated = max(0, words - width + 1) - len(passage)
    least = span - width + 1 - width * (edits * span + 0.5) - repeated
    return least <= 0 or len(np.intersect1d(passage, document, assume_unique=True)) >= least - 1e-9


#: Cells of a table of scores.
CELLS = 6_000_000


def _windows(pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[int]]:
    """The pairs with long documents cut, and the pair that each belongs to.

    A stretch with a positive score takes up less than twice as many words of
    the document as the passage has; cuts overlap by as many, so none is lost.
    """
    made, owner = [], []
    for i, (p, d) in enumerate(pairs):
        over = 2 * len(p)
        size = max(2 * over, CELLS // max(1, len(p)))
        for at in range(0, max(1, len(d) - over), max(1, size - over)) if len(d) > size else (0,):
            made.append((p, d[at : at + size]))
            owner.append(i)
    return made, owner


def _fits(stretch: tuple[int, int, int], words: int, part: float, edits: float) -> bool:
    """Whether a stretch has enough of a passage's words and few enough edits."""
    return stretch[1] >= part * words - 1e-9 and stretch[2] <= edits * stretch[1] + 0.5


def best_stretches(
    pairs: list[tuple[np.ndarray, np.ndarray]], match: int = 1, mismatch: int = -1, gap: int = -1, at_once: int = 128, limits: tuple[float, float] | None = None,
) -> list[tuple[int, int, int]]:
    """Best local alignment of each (passage, document): words matched, passage words spanned, words edited.

    With ``limits``, the part of the passage and the edits for each word, a
    stretch within them is given where there is one: if the best alignment
    isn't, a stretch of it, or of the next best ones.
    """
    out: list[tuple[int, int, int]] = [(0, 0, 0)] * len(pairs)
    whole, (pairs, owner) = pairs, _windows(pairs)
    best = [(False, 0)] * len(whole)
    order = sorted(range(len(pairs)), key=lambda i: (len(pairs[i][1]), len(pairs[i][0])))
    while order:
        # as many pairs as keep the table of scores in a few MB, at least one
        last = pairs[order[-1]]
        take = max(1, min(at_once, CELLS // max(1, len(last[1]) * max(len(pairs[i][0]) for i in order[-at_once:]))))
        part, order = order[-take:], order[:-take]
        rows, cols = max(len(pairs[i][0]) for i in part), max(len(pairs[i][1]) for i in part)
        if not rows or not cols:
            continue
        p, d = np.zeros((len(part), rows), np.uint64), np.ones((len(part), cols), np.uint64)
        p_has, d_has = np.zeros(p.shape, bool), np.zeros(d.shape, bool)
        for k, i in enumerate(part):
            p[k, : len(pairs[i][0])], p_has[k, : len(pairs[i][0])] = pairs[i][0], True
            d[k, : len(pairs[i][1])], d_has[k, : len(pairs[i][1])] = pairs[i][1], True
        table = _scores(lambda r: (d == p[:, r : r + 1]) & d_has & p_has[:, r : r + 1], rows, len(part), cols, match, mismatch, gap)  # noqa: B023
        flat = table.transpose(1, 0, 2).reshape(len(part), -1)
        tops = flat.argmax(axis=1)
        for k, i in enumerate(part):
            r, c = divmod(int(tops[k]), cols + 1)
            score = int(table[r, k, c])
            if score <= best[owner[i]][1] and not limits:
                continue
            steps = _trace(table[:, k, :], pairs[i][0], pairs[i][1], r, c, match, mismatch, gap)
            found = _counted(steps)
            if limits and not _fits(found, len(pairs[i][0]), *limits):
                clean = _within(*pairs[i], steps, score, *limits, match, mismatch, gap)
                if clean:
                    found, score = clean, clean[0] - clean[2]
            # what is within the limits goes before all that isn't
            fits = bool(limits) and _fits(found, len(pairs[i][0]), *limits)
            if (fits, score) > best[owner[i]]:
                best[owner[i]], out[owner[i]] = (fits, score), found
    return out


def _within(
    p: np.ndarray, d: np.ndarray, steps: np.ndarray, score: int, part: float, edits: float, match: int, mismatch: int, gap: int
) -> tuple[int, int, int] | None:
    """The longest stretch within the limits of an alignment, or of the next best ones that share no pair of words with those before."""
    # a stretch within the limits has at least this score
    need = part * len(p) * (1 - 2 * edits) - 1 - 1e-9
    barred: list[np.ndarray] = []
    while len(steps) and score >= max(1, need):
        found = _longest_clean(steps, len(p), part, edits)
        if found:
            return found
        barred.append(steps[steps[:, 2] <= 1, :2])
        cells = np.concatenate(barred)
        cells = cells[np.argsort(cells[:, 0], kind="stable")]
        starts = np.searchsorted(cells[:, 0], np.arange(len(p) + 1))

        def same_at(r: int, cells=cells, starts=starts) -> np.ndarray:
            same = d == p[r]
            same[cells[starts[r] : starts[r + 1], 1]] = False
            return same[None]

        table = _scores(same_at, len(p), 1, len(d), match, mismatch, gap)[:, 0, :]
        r, c = divmod(int(table.argmax()), len(d) + 1)
        score = int(table[r, c])
        steps = _trace(table, p, d, r, c, match, mismatch, gap, set(map(tuple, cells.tolist())))
    return None


def _longest_clean(steps: np.ndarray, words: int, part: float, edits: float) -> tuple[int, int, int] | None:
    """The longest part of an alignment that is within the limits, and of which no beginning or end has as many edits as matches."""
    kind = steps[:, 2]
    spanned, edited = np.cumsum(kind <= 2), np.cumsum(kind > 0)
    score = np.cumsum(np.where(kind == 0, 1, -1))
    best = None
    for i in np.flatnonzero(kind == 0):
        had = (spanned[i] - 1, edited[i], score[i] - 1)
        gained = score[i:] - had[2]
        drop = np.flatnonzero(gained <= 0)
        stop = len(gained) if not len(drop) else drop[0]
        span, edit = spanned[i : i + stop] - had[0], edited[i : i + stop] - had[1]
        top = np.maximum.accumulate(gained[:stop])
        rises = (kind[i : i + stop] == 0) & (np.r_[0, top[:-1]] < gained[:stop])
        good = np.flatnonzero(rises & (span >= part * words - 1e-9) & (edit <= edits * span + 0.5))
        if len(good) and (best is None or span[good[-1]] > best[1]):
            j = good[-1]
            best = (int((kind[i : i + j + 1] == 0).sum()), int(span[j]), int(edit[j]))
    return best


def _scores(same_at, rows: int, many: int, cols: int, match: int, mismatch: int, gap: int) -> np.ndarray:
    """Scores of local alignments that end at each word of the passages (first axis) and documents (last)."""
    # scores are at most the greatest ramp and gain together
    kind = np.int16 if cols * -gap + rows * match < 32_000 else np.int32
    table = np.zeros((rows + 1, many, cols + 1), kind)
    ramp = (np.arange(cols + 1) * -gap).astype(kind)
    for r in range(rows):
        row = np.zeros((many, cols + 1), kind)
        row[:, 1:] = np.maximum(table[r, :, :-1] + np.where(same_at(r), match, mismatch).astype(kind), table[r, :, 1:] + gap)
        np.maximum(row, 0, out=row)
        # a gap along the document is a running maximum with a slope
        np.maximum(row, np.maximum.accumulate(row + ramp, axis=1) - ramp, out=row)
        table[r + 1] = row
    return table


def _trace(
    table: np.ndarray, p: np.ndarray, d: np.ndarray, r: int, c: int, match: int, mismatch: int, gap: int, barred: set[tuple[int, int]] = frozenset()
) -> np.ndarray:
    """The steps of the alignment that ends at a cell: passage word, document word, kind (0 same, 1 changed, 2 dropped, 3 added)."""
    steps = []
    while r > 0 and c > 0 and table[r, c] > 0:
        same = p[r - 1] == d[c - 1] and (r - 1, c - 1) not in barred
        if table[r, c] == table[r - 1, c - 1] + (match if same else mismatch):
            r, c, kind = r - 1, c - 1, 0 if same else 1
        elif table[r, c] == table[r - 1, c] + gap:
            r, kind = r - 1, 2
        else:
            c, kind = c - 1, 3
        steps.append((r, c, kind))
    return np.array(steps[::-1], np.int64).reshape(-1, 3)


def _counted(steps: np.ndarray) -> tuple[int, int, int]:
    """Words matched, passage words spanned, words edited."""
    kind = steps[:, 2]
    return int((kind == 0).sum()), int((kind <= 2).sum()), int((kind > 0).sum())
