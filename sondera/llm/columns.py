"""What the operators of this package share: picking columns and running Python over texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Orders versions that are equally late, without the text itself.
TIE = "_tie"


def versions(chunks: DataFrame, *columns: str) -> DataFrame:
    """Only the needed columns of the chunk table, with the tie-break of ``latest``."""
    wanted = list(dict.fromkeys(["chunk_id", "indexed_at", *columns]))
    return spread(chunks.select(*wanted), "chunk_id").select("*", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias(TIE))


def spread(df: DataFrame, key: str) -> DataFrame:
    """The rows over at least as many partitions as there are cores, if they are in fewer (one small file, say).

    Only where the work lies depends on this, never what comes out.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if not df.isStreaming and df.rdd.getNumPartitions() < cores else df


def map_rows(df: DataFrame, schema: str, row: Callable[..., tuple], keep: list[str], args: list[str]) -> DataFrame:
    """Run ``row(*args)`` for every row, in Arrow batches; ``keep`` is passed through.

    ``schema`` names the kept columns first, then one column for each value
    that ``row`` returns.
    """
    names = [part.split()[0] for part in _fields(schema)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = {k: batch[k] for k in keep}
            results = [row(*values) for values in zip(*[batch[a].tolist() for a in args])]
            for i, name in enumerate(names[len(keep):]):
                out[name] = pd.Series([r[i] for r in results], index=batch.index, dtype=object)
            yield pd.DataFrame(out, columns=names)

    return df.select(*dict.fromkeys([*keep, *args])).mapInPandas(run, schema)


def _fields(schema: str) -> list[str]:
    depth, parts, start = 0, [], 0
    for i, ch in enumerate(schema):
        depth += (ch in "<(") - (ch in ">)")
        if ch == "," and not depth:
            parts.append(schema[start:i].strip())
            start = i + 1
    return [*parts, schema[start:].strip()]


def suffix(path: Column) -> Column:
    """The file name's last extension, lower-case, without the dot; empty if there is none."""
    name = F.element_at(F.split(F.coalesce(path, F.lit("")), "/"), -1)
    return F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))


class KeyFilter:
    """A filter of bounded size that tells apart most of what isn't among some 64-bit keys.

    It has sixteen bits for each key, but ``most`` bits (32 MB) at most: beyond
    16 million keys it lets more through. What it lets through must be joined
    with the keys still, so its size never changes a result. Executors make
    the bitmaps; the driver sees these alone, no keys.
    """

    def __init__(self, keys: DataFrame, column: str, most: int = 1 << 28):
        self.bits = 1 << 18
        while self.bits < min(most, 16 * keys.count()):
            self.bits <<= 1
        at = F.pmod(F.col(column), F.lit(self.bits)) + 1
        made = keys.select(F.bitmap_bucket_number(at).alias("block"), F.bitmap_bit_position(at).alias("bit")).groupBy("block").agg(F.bitmap_construct_agg("bit").alias("marks"))
        packed = np.zeros(self.bits >> 3, np.uint8)
        size = 1 << 12
        for block, marks in made.toLocalIterator():
            packed[(block - 1) * size : block * size] = np.frombuffer(marks, np.uint8)
        self.packed = keys.sparkSession.sparkContext.broadcast(packed)

    def __getstate__(self) -> dict:
        return {"bits": self.bits, "packed": self.packed}

    def passes(self, keys: np.ndarray) -> np.ndarray:
        """For each signed or unsigned 64-bit key whether it may be among the keys."""
        at = (keys.astype(np.int64, copy=False) % self.bits).astype(np.int64)
        return (self.packed.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
