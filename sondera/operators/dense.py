"""Nearest neighbours by cosine: exact, by stored quantised vectors with an exact second look, and by a hashed index.

Vectors are scanned once for as many queries as a task may hold; every task
keeps its best rows of each query, and only these are exchanged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sondera.functions import vectors as vx
from sondera.operators import filters as flt
from sondera.operators.lexical import checked_limit, small

#: Queries that are compared at once, and numbers of queries that a task holds for one scan (8 bytes each).
BLOCK, HELD = 1024, 1 << 22


def _matrix(column: pd.Series, size: int | None = None) -> np.ndarray:
    rows = [np.asarray(v, dtype=np.float64) for v in column]
    size = size or (len(rows[0]) if rows else 0)
    return np.vstack(rows) if rows else np.empty((0, size))


def _unit(m: np.ndarray) -> np.ndarray:
    norms = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return m / np.where(norms > 0, norms, 1.0)


def _parts(queries: DataFrame, held: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of the queries, as many at a time as one scan may hold; the driver holds one part at a time."""
    ids, rows = [], []
    for row in queries.select("query_id", "vector").where(F.col("vector").isNotNull()).toLocalIterator():
        if rows and len(row["vector"]) != len(rows[0]):
            raise ValueError("the queries' vectors are of different sizes")
        ids.append(row["query_id"])
        rows.append(row["vector"])
        if len(rows) * len(rows[0]) >= held:
            yield np.array(ids), np.array(rows, np.float64)
            ids, rows = [], []
    if rows:
        yield np.array(ids), np.array(rows, np.float64)


def ranked(scores: DataFrame, limit: int, key: str) -> DataFrame:
    """The best rows of each query, ties by key."""
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), F.asc(key))
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("query_id", "rank", key, "score")


def _to_bytes(m: np.ndarray) -> np.ndarray:
    """Each row in steps of a 127th of its greatest number."""
    scale = np.abs(m).max(axis=1, keepdims=True)
    return np.clip(np.floor(m * 127.0 / np.where(scale > 0, scale, 1.0) + 0.5), -127, 127).astype(np.int8)


def _to_bits(m: np.ndarray) -> np.ndarray:
    """Each row's signs, eight to a byte."""
    return np.packbits(m > 0, axis=1)


def _cosines(rows: np.ndarray, asked: np.ndarray) -> np.ndarray:
    return _unit(rows.astype(np.float64)) @ _unit(asked.astype(np.float64)).T


def _sign_matches(rows: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Minus the number of signs that differ."""
    out = np.empty((len(rows), len(asked)))
    for q, one in enumerate(asked):
        out[:, q] = np.bitwise_count(rows ^ one).sum(axis=1)
    return -out


#: How vectors are kept by mode: the column, how it is made, what it is read as, and how close two are. A quarter of 32-bit vectors, or a 32nd.
QUANTISED = {"scalar": ("as_bytes", _to_bytes, np.int8, _cosines), "binary": ("as_bits", _to_bits, np.uint8, _sign_matches)}


def quantised(vectors: DataFrame, mode: str, vector: str = "vector") -> DataFrame:
    """The table with its vectors in a quantised form besides (``as_bytes`` or ``as_bits``), to be stored: a first look then reads that column alone."""
    name, make = QUANTISED[mode][:2]

    @F.pandas_udf("binary")
    def run(column: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else make(np.asarray(v, np.float64)[None, :])[0].tobytes() for v in column], index=column.index, dtype=object)

    return vectors.withColumn(name, run(F.col(vector)))


def nearest(
    vectors: DataFrame, queries: DataFrame, limit: int = 10, filters: Mapping[str, Any] | None = None, key: str = "chunk_id", vector: str = "vector",
    mode: str = "exact", oversampling: float = 2.0, block: int = BLOCK, held: int = HELD,
) -> DataFrame:
    """The nearest vectors of each query by cosine: query_id, rank, key, score.

    ``queries`` has query_id and vector. With the mode 'scalar' or 'binary' a
    shortlist of ``oversampling`` times ``limit`` is found by quantised vectors,
    stored ones (``quantised``) if the table has them, and ordered by the exact
    ones, which are read for the shortlist only. Rows without a vector, or with
    one of another size, are left out; filters are applied before. A vector
    without length has a score of 0.
    """
    checked_limit(limit)
    many = limit if mode == "exact" else math.ceil(limit * max(1.0, oversampling))
    found_by, make, kind, closeness = (None, None, None, _cosines) if mode == "exact" else QUANTISED[mode]
    rows = flt.apply(vectors, filters, any_prefix=True).where(F.col(key).isNotNull())
    stored = mode != "exact" and found_by in vectors.columns
    scanned = rows.select(F.col(key), F.col(found_by if stored else vector).alias("_v")).where(F.col("_v").isNotNull())
    types = dict(rows.dtypes), dict(queries.dtypes)
    schema = f"query_id {types[1]['query_id']}, `{key}` {types[0][key]}, score double"
    context, found = vectors.sparkSession.sparkContext, None
    for ids, asked in _parts(queries, held):
        size = asked.shape[1]
        shared = context.broadcast((ids, asked if mode == "exact" else make(asked)))

        def search(batches: Iterator[pd.DataFrame], size=size, shared=shared) -> Iterator[pd.DataFrame]:
            ids, asked = shared.value
            best: list[tuple[np.ndarray, ...]] = [()] * -(-len(ids) // block)
            for batch in batches:
                if stored:
                    good = [len(v) == len(asked[0].tobytes()) for v in batch["_v"]]
                    made = np.array([np.frombuffer(v, kind) for v, g in zip(batch["_v"], good) if g])
                else:
                    good = [len(v) == size for v in batch["_v"]]
                    made = _matrix(batch["_v"][good], size)
                    made = made if mode == "exact" else make(made)
                keys = batch[key].to_numpy()[good]
                if not len(keys):
                    continue
                for i in range(len(best)):
                    close = np.round(closeness(made, asked[i * block : (i + 1) * block]), 9)
                    # all that are as close as the last one kept; of equals the key decides
                    floor = np.partition(close, -many, axis=0)[-many] if many < len(keys) else np.full(close.shape[1], -np.inf)
                    q, r = np.nonzero((close >= floor).T)
                    best[i] = _kept(best[i], (q, keys[r], close[r, q]), many)
            for i, part in enumerate(best):
                if part:
                    yield pd.DataFrame({"query_id": ids[i * block : (i + 1) * block][part[0]], key: part[1], "score": part[2]})

        made = scanned.mapInPandas(search, schema)
        found = made if found is None else found.unionByName(made)
    if found is None:
        found = vectors.sparkSession.createDataFrame([], schema)
    best = ranked(found, many, key)
    if mode == "exact":
        return best
    # the exact vectors of the shortlist alone
    short = best.select("query_id", key).join(rows.select(key, F.col(vector).alias("_v")), key).join(small(queries.select("query_id", F.col("vector").alias("_q"))), "query_id")
    return ranked(short.select("query_id", key, vx.cosine(F.col("_v"), F.col("_q")).alias("score")), limit, key)


def _kept(before: tuple[np.ndarray, ...], fresh: tuple[np.ndarray, ...], many: int) -> tuple[np.ndarray, ...]:
    """The best ``many`` rows of each query among those kept before and new ones: query, key, closeness."""
    q, keys, close = [np.concatenate(pair) for pair in zip(before, fresh)] if before else fresh
    order = np.lexsort((keys, -close, q))
    q, keys, close = q[order], keys[order], close[order]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    return q[place < many], keys[place < many], close[place < many]


def _flips(margins: np.ndarray, many: int) -> np.ndarray:
    """For each row and table the ``many`` sets of signs, as bits, that cost least to turn; the empty set is the first."""
    bits = margins.shape[2]
    sets = (np.arange(1 << bits)[:, None] >> np.arange(bits)) & 1
    # some rows at a time, as every set of each table is held
    parts = [np.argsort(margins[i : i + 256] @ sets.T, axis=2, kind="stable")[:, :, :many] for i in range(0, len(margins), 256)]
    return np.concatenate(parts)


class HashedIndex:
    """Approximate neighbours by random hyperplanes: rows that agree with a query in the signs of some table meet.

    Every row is indexed in every table, and has a sketch of ``sketch`` signs
    besides. A query looks into ``probes`` places of each table: that of its
    own signs and those that differ in the planes it is closest to, where a
    neighbour is likeliest to lie on the other side. Of the rows it meets the
    ``shortlist`` with the nearest sketches are compared exactly. The planes
    depend on the seed only. ``fitted`` chooses bits and probes.
    """

    def __init__(
        self, vectors: DataFrame, dimensions: int, tables: int = 24, bits: int = 6, seed: int = 11, key: str = "chunk_id", vector: str = "vector", probes: int = 4, sketch: int = 512, shortlist: int = 160,
    ):
        self.key, self.tables, self.bits, self.dimensions, self.probes, self.shortlist = key, tables, bits, dimensions, max(1, min(probes, 1 << bits)), shortlist
        rng = np.random.default_rng(seed)
        self.planes, self.more = rng.standard_normal((dimensions, tables * bits)), rng.standard_normal((dimensions, 64 * max(1, sketch // 64)))
        self.rows = self._coded(vectors.select(F.col(key), F.col(vector).alias("vector")), key)

    @classmethod
    def fitted(cls, vectors: DataFrame, dimensions: int, recall: float = 0.95, limit: int = 10, sample: int = 2000, key: str = "chunk_id", vector: str = "vector", **options) -> HashedIndex:
        """An index with as many bits as the number of rows asks for, and as many probes as reach ``recall`` on a sample.

        A place of a table holds some 32 rows of even data, whatever their
        number. Probes are counted on at most ``sample`` rows, chosen by a hash
        of their key, of which a tenth are queries; they are doubled until
        enough of the true neighbours are met, or every place is looked into.
        """
        rows = vectors.select(F.col(key), F.col(vector).alias("vector")).where(F.col(key).isNotNull() & (F.size(vector) == dimensions))
        many = rows.count()
        bits = max(1, min(20, round(math.log2(max(2, many))) - 5))
        part = rows.orderBy(F.xxhash64(F.lit("fit"), key)).limit(sample).select("vector").toPandas()["vector"]
        index = cls(vectors, dimensions, bits=bits, key=key, vector=vector, probes=1, **options)
        m = _unit(_matrix(part, dimensions))
        asked = m[:: max(1, len(m) // max(1, min(200, len(m) // 10)))]
        if len(m) <= limit + 1:
            return index
        true = np.argsort(-(asked @ m.T), axis=1)[:, 1 : limit + 1]
        own, sides = index._places(m), (asked @ index.planes).reshape(len(asked), index.tables, bits)
        theirs = ((sides > 0) * (1 << np.arange(bits))).sum(axis=2)
        while True:
            looked = theirs[:, :, None] ^ _flips(np.abs(sides), index.probes)
            met = np.array([[(own[r][:, None] == looked[q]).any() for r in true[q]] for q in range(len(asked))])
            if met.mean() >= recall or index.probes >= 1 << bits:
                return index
            index.probes = min(1 << bits, index.probes * 2)

    def _places(self, m: np.ndarray) -> np.ndarray:
        return (((m @ self.planes).reshape(len(m), self.tables, self.bits) > 0) * (1 << np.arange(self.bits))).sum(axis=2)

    def _coded(self, rows: DataFrame, key: str, probes: int = 1) -> DataFrame:
        kind, planes, more, tables, bits, size = dict(rows.dtypes)[key], self.planes, self.more, self.tables, self.bits, self.dimensions

        def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                batch = batch[[v is not None and len(v) == size for v in batch["vector"]]]
                if batch.empty:
                    continue
                m = _unit(_matrix(batch["vector"], size))
                sides = (m @ planes).reshape(len(m), tables, bits)
                codes = ((sides > 0) * (1 << np.arange(bits))).sum(axis=2)
                if probes > 1:
                    codes = codes[:, :, None] ^ _flips(np.abs(sides), probes)
                codes = (codes.reshape(len(m), tables, -1) + (np.arange(tables) * (1 << bits))[:, None]).reshape(len(m), -1)
                sketches = np.packbits(m @ more > 0, axis=1).view(np.int64)
                yield pd.DataFrame({key: batch[key].to_numpy(), "vector": list(m), "codes": list(codes.astype(np.int32)), "sketch": list(sketches)})

        return rows.mapInPandas(code, f"`{key}` {kind}, vector array<double>, codes array<int>, sketch array<long>")

    def search(self, queries: DataFrame, limit: int = 10) -> DataFrame:
        """query_id, rank, key, score: the best among the rows that a query meets in some table."""
        checked_limit(limit)
        asked = self._coded(queries.select("query_id", "vector"), "query_id", self.probes).select("query_id", F.col("vector").alias("q"), F.col("sketch").alias("s"), "codes")
        theirs = asked.select("query_id", F.explode("codes").alias("code"))
        met = self.rows.select(self.key, F.explode("codes").alias("code")).join(theirs, "code").select("query_id", self.key).distinct()
        # by sketches first, an eighth of a vector or less
        near = met.join(self.rows.select(self.key, "sketch"), self.key).join(asked.select("query_id", "s"), "query_id")
        order = Window.partitionBy("query_id").orderBy("_apart", self.key)
        near = near.select("query_id", self.key, vx.hamming(F.col("sketch"), F.col("s")).alias("_apart")).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= max(limit, self.shortlist))
        pairs = near.select("query_id", self.key).join(self.rows.select(self.key, "vector"), self.key).join(asked.select("query_id", "q"), "query_id")
        return ranked(pairs.select("query_id", self.key, vx.dot(F.col("vector"), F.col("q")).alias("score")), limit, self.key)
