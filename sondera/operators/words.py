"""The inverted index: which tokens and terms stand in which chunks, stored in segments.

Texts are read once, when they are indexed. A search then reads only postings
of the tokens it asks for. Postings are appended in segments, one for each
indexing run, in proportion to what is new; a chunk that was replaced or
deleted is named in a tombstone, which ends its postings of earlier segments.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondera.functions import text as tx
from sondera.operators.index import Snapshots
from sondera.session import settle

#: Places of a term are counted from 0 in a text, from these numbers on in a symbol and in a path, so no phrase goes across.
FIELD_BASE = {"text": 0, "symbol": 1 << 29, "path": 1 << 30}

_TOKEN, _PART = re.compile(tx.TOKEN), re.compile(r"[a-z]+|[0-9]+")


class Variants(dict):
    """The tokens that a token of a text stands for, with variants and singulars: what ``functions.text.tokens`` makes of it. Remembers them, up to a bound."""

    def __missing__(self, raw: str) -> tuple[str, ...]:
        if len(self) > 300_000:
            self.clear()
        low = raw.lower()
        parts = _PART.findall(low)
        every = dict.fromkeys([low, *parts, *(("pixel", "pixels") if "pix" in parts else ())])
        made = self[raw] = tuple(x for v in every for x in ((v, v[:-1]) if v.endswith("s") and len(v) > 3 else (v,)))
        return made


class Terms(dict):
    """The runs of letters and digits of the tokens that a token of a text stands for."""

    def __init__(self, variants: Variants):
        super().__init__()
        self.variants = variants

    def __missing__(self, raw: str) -> tuple[str, ...]:
        if len(self) > 300_000:
            self.clear()
        made = self[raw] = tuple(t for v in self.variants[raw] for t in re.findall("[a-z0-9]+", v))
        return made


MADE = "bag_length int, phrase_length int, tokens array<struct<token:string,tf:int>>, terms array<struct<term:string,f:double,places:array<int>>>"


def analysed(chunks: DataFrame, weights: dict[str, float], most_chars: int | None = None) -> DataFrame:
    """The chunks without their texts, with bag_length, phrase_length, tokens (token, tf) and terms (term, weighted f, places).

    Whole texts, or their first ``most_chars`` characters. Runs in Arrow
    batches: a token's variants are worked out once, not in every row.
    """
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    text = empty("text") if most_chars is None else F.substring(empty("text"), 1, most_chars)
    kept = [c for c in chunks.columns if c != "text"]
    rows = chunks.select(*kept, text.alias("_0"), *[empty(c).alias(f"_{i}") for i, c in enumerate(("symbol", "xml_path", "source_path", "kind"), 1)])
    schema = ", ".join([*[f"`{n}` {t}" for n, t in chunks.select(*kept).dtypes], MADE])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        variants = Variants()
        terms = Terms(variants)
        for batch in batches:
            text, symbol, xml, path, kind = (c.to_pylist() for c in batch.columns[len(kept) :])
            bags, places_of = _Lists(), _Lists()
            lengths, phrase_lengths = [], []
            tf, weight, places, place_ends = [], [], [], [0]
            for i in range(len(text)):
                # what is indexed is one text of five lines, so tokens end at their ends
                whole = [_TOKEN.findall(part) for part in (text[i], symbol[i], xml[i], path[i], kind[i])]
                bag = Counter(v for part in whole for raw in part for v in variants[raw])
                lengths.append(max(1, sum(bag.values())))
                bags.add(bag)
                tf += bag.values()
                found: dict[str, list[int]] = {}
                many = 0
                for field, base, parts in (("text", 0, whole), ("symbol", FIELD_BASE["symbol"], whole[1:2]), ("path", FIELD_BASE["path"], whole[3:4])):
                    at = base
                    for part in parts:
                        for raw in part:
                            for term in terms[raw]:
                                found.setdefault(term, []).append(at)
                                at += 1
                    many += at - base
                phrase_lengths.append(many)
                places_of.add(found)
                for at in found.values():
                    places += at
                    place_ends.append(len(places))
                    low = np.asarray(at) if len(at) > 64 else at
                    weight.append(_weighted(low, weights))
            tokens = pa.StructArray.from_arrays([pa.array(bags.keys, pa.string()), pa.array(tf, pa.int32())], ["token", "tf"])
            lists = pa.ListArray.from_arrays(pa.array(place_ends, pa.int32()), pa.array(places, pa.int32()))
            made = pa.StructArray.from_arrays([pa.array(places_of.keys, pa.string()), pa.array(weight, pa.float64()), lists], ["term", "f", "places"])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(kept)], pa.array(lengths, pa.int32()), pa.array(phrase_lengths, pa.int32()), pa.ListArray.from_arrays(bags.offsets(), tokens), pa.ListArray.from_arrays(places_of.offsets(), made)],
                [*kept, "bag_length", "phrase_length", "tokens", "terms"],
            )

    return rows.mapInArrow(run, schema)


class _Lists:
    """Keys of many rows, one after the other."""

    def __init__(self) -> None:
        self.keys: list[str] = []
        self.ends = [0]

    def add(self, keys) -> None:
        self.keys += keys
        self.ends.append(len(self.keys))

    def offsets(self) -> pa.Array:
        return pa.array(self.ends, pa.int32())


def _weighted(places, weights: dict[str, float]) -> float:
    """How often a term occurs, by the weights of the fields."""
    if isinstance(places, np.ndarray):
        paths, symbols = int((places >= FIELD_BASE["path"]).sum()), int((places >= FIELD_BASE["symbol"]).sum())
    else:
        paths, symbols = sum(p >= FIELD_BASE["path"] for p in places), sum(p >= FIELD_BASE["symbol"] for p in places)
    return (len(places) - symbols) * weights["text"] + (symbols - paths) * weights["symbol"] + paths * weights["path"]


@dataclass
class WordIndex:
    """What a search by words reads.

    ``docs``: chunk_id, bag_length, phrase_length and the chunks' other columns
    but for texts. ``tokens``: token, chunk_id, tf, length. ``terms``: term,
    chunk_id, f (weighted by field), places, length.
    """

    docs: DataFrame
    tokens: DataFrame
    terms: DataFrame

    @classmethod
    def of(cls, chunks: DataFrame, weights: dict[str, float], most_chars: int | None = None, lasting: bool = True) -> WordIndex:
        """The index of a frame of chunks: written to the shared folder for as long as it is in use, or (``lasting=False``) made each time it is read."""
        made = analysed(chunks.where(F.col("chunk_id").isNotNull()), weights, most_chars)
        made = settle(made) if lasting else made
        return cls(made.drop("tokens", "terms"), _tokens(made), _terms(made))

    def statistics(self, length: str) -> tuple[int, float]:
        """How many chunks there are, and their mean length (1.0 without any)."""
        row = self.docs.agg(F.count("*").alias("n"), F.avg(length).alias("mean")).first()
        return int(row["n"] or 0), float(row["mean"] or 1.0)


def _tokens(made: DataFrame) -> DataFrame:
    return made.select("chunk_id", F.col("bag_length").alias("length"), F.inline("tokens")).select("token", "chunk_id", "tf", "length")


def _terms(made: DataFrame) -> DataFrame:
    return made.select("chunk_id", F.col("phrase_length").alias("length"), F.inline("terms")).select("term", "chunk_id", "f", "places", "length")


@dataclass
class WordStore:
    """An inverted index in a folder that all executors share.

    Its version is that of its table of chunks (``docs``), which names the
    segments that count, so readers see a run's postings and chunks together
    or neither. Beyond ``most_segments`` the living postings are written anew.
    """

    spark: SparkSession
    folder: str
    weights: dict[str, float]
    buckets: int = 32
    most_segments: int = 16
    most_chars: int | None = None

    def __post_init__(self) -> None:
        self.docs = Snapshots(self.spark, f"{self.folder}/docs")

    def add(self, chunks: DataFrame, files: DataFrame | None = None, batch: str | None = None) -> int:
        """Index the chunks of some files in place of what these files had; ``files`` (file_key) may name more that have none now."""
        now = self.docs.pointer()
        if batch is not None and now["batch"] == batch:
            return now["generation"]
        segments = list(now.get("note") or [])
        number = 1 + max([s["number"] for s in segments], default=0)
        made = settle(analysed(chunks.where(F.col("chunk_id").isNotNull()), self.weights, self.most_chars))
        fresh = made.drop("tokens", "terms").withColumn("segment", F.lit(number))
        dead = None
        if now["generation"]:
            old = self.docs.read(at=now)
            touched = fresh.select("file_key") if files is None else fresh.select("file_key").unionByName(files.select("file_key"))
            dead = old.join(touched.distinct(), "file_key", "left_semi").select("chunk_id").union(old.select("chunk_id").join(fresh.select("chunk_id").distinct(), "chunk_id", "left_semi")).distinct()
        name = self._write(number, _tokens(made), _terms(made), dead)
        segments.append({"number": number, "name": name})
        if len(segments) > self.most_segments:
            whole = self._read(segments)
            number += 1
            segments = [{"number": number, "name": self._write(number, whole[0], whole[1], None)}]
        generation = self.docs.replace(fresh, files, batch, segments) if now["generation"] else self.docs.write(fresh, batch, segments)
        self._tidy()
        return generation

    def read(self) -> WordIndex | None:
        """The current version; None if there is none."""
        now = self.docs.pointer()
        if not now["generation"]:
            return None
        tokens, terms = self._read(now["note"])
        return WordIndex(self.docs.read(at=now).drop("segment"), tokens, terms)

    def _tidy(self) -> None:
        """Drop segments that no version left names; what is newer than all of theirs may be another writer's."""
        names = self.docs._names()
        left = [s for n in names if n.startswith("manifest-") for s in self.docs._manifest(n)["note"] or []]
        used, first = {s["name"] for s in left}, min((s["number"] for s in left), default=0)
        path, fs = self.docs._path("..")
        for status in fs.listStatus(path):
            name = status.getPath().getName()
            if name.startswith("segment-") and name not in used and int(name[8:14]) < first:
                fs.delete(status.getPath(), True)

    def _write(self, number: int, tokens: DataFrame, terms: DataFrame, dead: DataFrame | None) -> str:
        name = f"segment-{number:06d}-{uuid.uuid4().hex[:8]}"
        for kind, frame, key in (("tokens", tokens, "token"), ("terms", terms, "term")):
            placed = frame.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int"))
            placed.hint("rebalance", "bucket").sortWithinPartitions("bucket", key, "chunk_id").write.partitionBy("bucket").parquet(f"{self.folder}/{name}/{kind}")
        if dead is not None:
            dead.select("chunk_id").write.parquet(f"{self.folder}/{name}/dead")
        return name

    def _read(self, segments: list[dict]) -> tuple[DataFrame, DataFrame]:
        """Postings of all segments without those that a later tombstone ended."""
        tombs = None
        for s in segments[1:]:
            dead = self.spark.read.schema("chunk_id string").parquet(f"{self.folder}/{s['name']}/dead").withColumn("ended", F.lit(s["number"]))
            tombs = dead if tombs is None else tombs.unionByName(dead)
        if tombs is not None:
            tombs = tombs.groupBy("chunk_id").agg(F.max("ended").alias("ended"))
        out = []
        for kind, columns in (("tokens", "token string, chunk_id string, tf int, length int, bucket int"), ("terms", "term string, chunk_id string, f double, places array<int>, length int, bucket int")):
            every = None
            for s in segments:
                part = self.spark.read.schema(columns).parquet(f"{self.folder}/{s['name']}/{kind}").withColumn("_segment", F.lit(s["number"]))
                every = part if every is None else every.unionByName(part)
            if tombs is not None:
                every = every.join(tombs, "chunk_id", "left").where(F.col("ended").isNull() | (F.col("ended") <= F.col("_segment"))).drop("ended")
            out.append(every.drop("_segment"))
        return out[0], out[1]
