"""Near-duplicates by min-max hashing, with an exact check of every candidate.

A text is the set of its runs of consecutive words. Under each of ``k`` random
orders of all runs both the least and the greatest of a set are kept, so k
orders give 2k values of a signature. Values are taken together in bands;
texts that agree in a band are candidates, and every candidate is checked
exactly. Texts with the same set are one class from the start, so copies never
meet in pairs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondera.llm.columns import TIE, KeyFilter, versions
from sondera.operators.latest import latest
from sondera.operators.lexical import small
from sondera.session import settle

_WORD = re.compile(r"\w+")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xBF58476D1CE4E5B9)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them evenly."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _MIX2
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordCodes(dict):
    """A 64-bit number for each word, the same in every process; remembers those it has seen, up to a bound."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > 500_000:
            self.clear()
        code = self[word] = xxhash.xxh3_64_intdigest(word)
        return code


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Distinct runs of ``width`` words as sorted 64-bit numbers; fewer words give one run of them all."""
    if not len(words):
        return np.empty(0, np.uint64)
    width = min(width, len(words))
    run = np.zeros(len(words) - width + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(width):
            run = mix(run * _MIX + words[i : len(words) - width + 1 + i])
    return np.unique(run)


def signature(runs: np.ndarray, bands: int, rows: int, seed: int) -> np.ndarray:
    """One number for each band: half of the values of a signature are least, half greatest values."""
    orders = -(-bands * rows // 2)
    factors = mix(np.arange(1, orders + 1, dtype=np.uint64) + np.uint64(seed) * np.uint64(1_000_003)) | np.uint64(1)
    with np.errstate(over="ignore"):
        under = runs[None, :] * factors[:, None]
        values = np.concatenate([under.min(axis=1), under.max(axis=1)])[: bands * rows].reshape(rows, bands)
        # a band takes its values from orders that are far apart
        band = np.arange(bands, dtype=np.uint64)
        for row in values:
            band = mix(band * _MIX + row)
    return band


def _runs_of(text: str | None, width: int, least_words: int, codes: WordCodes) -> np.ndarray | None:
    words = _WORD.findall(text.lower()) if text else []
    if len(words) < max(1, least_words):
        return None
    return shingles(np.fromiter(map(codes.__getitem__, words), np.uint64, len(words)), width)


def _digest(runs: np.ndarray) -> bytes:
    """128 bits that tell a set of runs from others."""
    with np.errstate(over="ignore"):
        return np.array([np.bitwise_xor.reduce(mix(runs)), mix(runs + _MIX).sum()], np.uint64).tobytes()


def signed_texts(df: DataFrame, keep: list[str], width: int, least_words: int, bands: int, rows: int, seed: int = 7) -> DataFrame:
    """``keep`` and alike (a digest of the set of runs), size, bands of each text; nulls for short ones."""
    types = dict(df.select(*keep).dtypes)
    schema = ", ".join([f"`{k}` {types[k]}" for k in keep]) + ", alike binary, size int, bands array<long>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes = WordCodes()
        for batch in batches:
            alike, sizes, keys = [], [], []
            for text in batch["text"]:
                runs = _runs_of(text, width, least_words, codes)
                alike.append(None if runs is None else _digest(runs))
                sizes.append(0 if runs is None else len(runs))
                keys.append(None if runs is None else signature(runs, bands, rows, seed).view(np.int64))
            yield batch[keep].assign(alike=alike, size=sizes, bands=pd.Series(keys, dtype=object, index=batch.index))

    return df.select(*keep, "text").mapInPandas(run, schema)


#: Rows of a band's key that one task sets against all of the key; of how many rows one is counted to find such keys.
ROWS_OF_KEY, COUNTED = 4096, 64


def _divided(keyed: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides of the join of rows with equal keys, and its columns: keys with very many rows (boilerplate) are divided among tasks.

    Such keys are found by counting the rows of each sixty-fourth set, by its
    digest. Only where pairs are made depends on that: every pair is.
    """
    few = keyed.where(F.pmod(F.xxhash64("alike"), F.lit(COUNTED)) == 0).groupBy("key").agg(F.count("*").alias("n"))
    hot = settle(few.where(F.col("n") * COUNTED > ROWS_OF_KEY).select("key", F.ceil(F.col("n") * COUNTED / ROWS_OF_KEY).cast("int").alias("parts")))
    if hot.isEmpty():
        return keyed, keyed, ["key"]
    placed = keyed.join(small(hot), "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    one = placed.withColumn("part", F.pmod(F.xxhash64(F.lit("part"), F.col("alike")), F.col("parts")).cast("int"))
    return one, placed.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))), ["key", "part"]


def near_duplicate_classes(
    chunks: DataFrame, width: int = 5, threshold: float = 0.8, least_words: int = 1, bands: int = 24, rows: int = 5, seed: int = 7
) -> tuple[DataFrame, DataFrame]:
    """Classes of texts with equal sets of runs, and the pairs of classes at or above the threshold.

    First frame: chunk_id, alike (the class). Second: alike_a < alike_b and
    similarity, each pair once. Together they hold every link without listing
    pairs of copies. A pair at the threshold t is a candidate with probability
    1 - (1 - t^rows)^bands at least; candidates are checked exactly, whatever
    their number. Of each chunk the latest version counts; chunks without an
    id, without words or with fewer than ``least_words`` are in neither frame.
    Other columns are ignored.
    """
    source = versions(chunks, "text")
    made = signed_texts(source, ["chunk_id", "indexed_at", TIE], width, least_words, bands, rows, seed)
    newest = latest(made, "chunk_id", "indexed_at", ["alike", "size", "bands"], TIE).where(F.col("alike").isNotNull())
    # read several times below, and costly to make: kept in the shared folder
    newest = settle(newest)
    members = newest.select("chunk_id", "alike")
    # any copy has the same bands, so the first will do
    keyed = newest.dropDuplicates(["alike"]).select("alike", "size", F.posexplode("bands").alias("band", "key"))
    keyed = keyed.select("alike", "size", F.xxhash64("band", "key").alias("key"))
    left, right, on = _divided(keyed)
    right = right.select(F.col("alike").alias("alike_b"), F.col("size").alias("size_b"), *on)
    # a set can reach t only if the smaller has t times the runs of the larger
    close = (F.least("size", "size_b") >= threshold * F.greatest("size", "size_b") - 1e-9) & (F.col("alike") < F.col("alike_b"))
    pairs = settle(left.join(right, on).where(close).select(F.col("alike").alias("alike_a"), "alike_b").distinct())

    # only the texts of candidates are cut into runs again, one of each class
    wanted = pairs.select(F.col("alike_a").alias("alike")).unionByName(pairs.select(F.col("alike_b").alias("alike"))).distinct()
    wanted = settle(members.join(wanted, "alike").groupBy("alike").agg(F.min("chunk_id").alias("chunk_id")))
    asked = KeyFilter(wanted.select(F.xxhash64("chunk_id").alias("key")), "key")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes = WordCodes()
        for batch in batches:
            batch = batch[asked.passes(batch["key"].to_numpy(dtype=np.int64))]
            runs = [_runs_of(text, width, 1, codes) for text in batch["text"]]
            runs = [None if r is None else r.view(np.int64) for r in runs]
            yield batch[["chunk_id", "indexed_at", TIE]].assign(runs=pd.Series(runs, dtype=object, index=batch.index))

    keyed_texts = source.where(F.col("chunk_id").isNotNull()).select("chunk_id", "indexed_at", TIE, "text", F.xxhash64("chunk_id").alias("key"))
    again = keyed_texts.mapInPandas(cut, f"chunk_id string, indexed_at timestamp, {TIE} long, runs array<long>")
    runs = settle(latest(again, "chunk_id", "indexed_at", ["runs"], TIE).join(wanted, "chunk_id").select("alike", "runs"))
    with_runs = pairs.join(runs.select(F.col("alike").alias("alike_a"), F.col("runs").alias("runs_a")), "alike_a").join(
        runs.select(F.col("alike").alias("alike_b"), F.col("runs").alias("runs_b")), "alike_b"
    )

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            scores = []
            for a, b in zip(batch["runs_a"], batch["runs_b"]):
                both = len(np.intersect1d(a, b, assume_unique=True))
                scores.append(both / (len(a) + len(b) - both))
            out = batch[["alike_a", "alike_b"]].assign(similarity=np.array(scores, dtype=float))
            yield out[out["similarity"] >= threshold - 1e-12]

    links = with_runs.select("alike_a", "alike_b", "runs_a", "runs_b").mapInPandas(check, "alike_a binary, alike_b binary, similarity double")
    return members, links


#: Copies of a text that a task sets against the others at once.
COPIES = 4096


def near_duplicate_pairs(chunks: DataFrame, **options) -> DataFrame:
    """All pairs of near-duplicate chunks: chunk_id_a < chunk_id_b.

    Lists copies of a text against each other too, so its size is that of the
    answer; ``near_duplicate_classes`` has the same links in short form. A
    class of very many copies is divided among tasks.
    """
    members, links = near_duplicate_classes(chunks, **options)
    a = members.select(F.col("chunk_id").alias("chunk_id_a"), F.col("alike").alias("alike_a"))
    b = members.select(F.col("chunk_id").alias("chunk_id_b"), F.col("alike").alias("alike_b"))
    parts = members.groupBy("alike").agg(F.count("*").alias("n")).where("n > 1").select("alike", F.ceil(F.col("n") / COPIES).cast("int").alias("parts"))
    copies = members.join(parts, "alike")
    one = copies.select("alike", F.pmod(F.xxhash64("chunk_id"), F.col("parts")).cast("int").alias("part"), F.col("chunk_id").alias("chunk_id_a"))
    all_ = copies.select("alike", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("chunk_id").alias("chunk_id_b"))
    same = one.join(all_, ["alike", "part"]).where(F.col("chunk_id_a") < F.col("chunk_id_b")).select("chunk_id_a", "chunk_id_b")
    linked = links.join(a, "alike_a").join(b, "alike_b")
    return same.unionByName(linked.select(F.least("chunk_id_a", "chunk_id_b").alias("chunk_id_a"), F.greatest("chunk_id_a", "chunk_id_b").alias("chunk_id_b")))


def link_counts(chunks: DataFrame, **options) -> DataFrame:
    """One row for each chunk that has a text: chunk_id, class_id, copies, links.

    Chunks with the same set of runs are one class, named by its smallest
    chunk_id; ``copies`` is how many chunks it has, ``links`` with how many
    other chunks, of its own and other classes, a chunk is near-duplicate.
    """
    members, links = near_duplicate_classes(chunks, **options)
    classes = members.groupBy("alike").agg(F.min("chunk_id").alias("class_id"), F.count("*").alias("copies"))
    both = links.select(F.col("alike_a").alias("alike"), F.col("alike_b").alias("other")).unionByName(links.select(F.col("alike_b").alias("alike"), F.col("alike_a").alias("other")))
    others = both.join(classes.select(F.col("alike").alias("other"), F.col("copies").alias("_of")), "other").groupBy("alike").agg(F.sum("_of").alias("_others"))
    counted = classes.join(others, "alike", "left").withColumn("links", F.col("copies") - 1 + F.coalesce("_others", F.lit(0)))
    return members.join(counted, "alike").select("chunk_id", "class_id", "copies", "links")
