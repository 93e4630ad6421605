"""Searching by words in one scan: what queries ask for is picked out of each chunk, and each task keeps the best of each query.

No posting is exchanged: of a chunk that is scanned only numbers of what some
query asks for are left, of a chunk that is scored only its places among the
best. So what is written grows with the chunks and with the results, not with
queries times chunks.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import islice
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sondera.operators.words import Variants, _TOKEN

_RUN = re.compile("[a-z0-9]+")

#: Of a chunk: the numbers of the keys it has and how much of each, the numbers of the queries that name it and what they add.
PICKED = "length int, keys array<int>, f array<double>, named array<int>, gain array<double>"


#: What a batch of queries has at most of distinct keys, of keys and of queries: what a task and the driver know of it has this bound.
MOST_KEYS, MOST_TERMS, MOST_QUERIES = 200_000, 4_000_000, 50_000


class Asked:
    """A batch of queries, numbered; their keys are tokens, or phrases as runs joined by blanks."""

    def __init__(self, phrases: bool) -> None:
        self.phrases, self.variants = phrases, Variants()
        self.ids: list[Any] = []
        #: Each query and what it is in small letters.
        self.texts: list[tuple[str, str]] = []
        #: The number of each key; the keys of the queries one after the other, how often they are asked for, and where each query's begin and end.
        self.keys: dict[str, int] = {}
        self.terms, self.times, self.ends = array("i"), array("i"), array("q", [0])

    def add(self, id_: Any, query: str, low: str) -> None:
        """One more query."""
        own = tokens(query, self.variants)
        found = (" ".join(_RUN.findall(t)) for t in dict.fromkeys(own)) if self.phrases else own
        many = Counter(self.keys.setdefault(k, len(self.keys)) for k in found if k)
        self.ids.append(id_)
        self.texts.append((query, low))
        self.terms.extend(many)
        self.times.extend(many.values())
        self.ends.append(len(self.terms))

    def full(self) -> bool:
        """Whether it has as much as is searched for at once."""
        return len(self.keys) >= MOST_KEYS or len(self.terms) >= MOST_TERMS or len(self.ids) >= MOST_QUERIES


def tokens(text: str, variants: Variants) -> list[str]:
    """The tokens of a text with their variants, as ``functions.text.tokens`` has them."""
    return [v for raw in _TOKEN.findall(text) for v in variants[raw]]


class Tokens:
    """Picks the tokens asked for out of the tokens of chunks' fields."""

    def __init__(self, keys: dict[str, int]) -> None:
        self.keys, self.variants, self.known = keys, Variants(), {}

    def pick(self, columns: list[list[str]]) -> Iterator[tuple[np.ndarray, ...]]:
        """Of some chunks after the other: their lengths, of each how many keys it has, the keys, and how much of each."""
        made = [self._picked([_TOKEN.findall(part) for part in fields]) for fields in zip(*columns, strict=True)]
        many = np.array([len(found) for _, found in made], np.int64)
        keys = np.fromiter((k for _, found in made for k in found), np.int32, many.sum())
        yield np.array([n for n, _ in made], np.int32), many, keys, np.fromiter((n for _, found in made for n in found.values()), np.float64, many.sum())

    def _picked(self, fields: list[list[str]]) -> tuple[int, dict[int, float]]:
        length, found, known = 0, {}, self.known
        for raw, n in Counter(r for part in fields for r in part).items():
            told = known.get(raw)
            if told is None:
                if len(known) > 300_000:
                    known.clear()
                every = self.variants[raw]
                told = known[raw] = len(every), [k for v in every if (k := self.keys.get(v)) is not None]
            length += n * told[0]
            for k in told[1]:
                found[k] = found.get(k, 0) + n
        return max(1, length), found


class _Numbers(dict):
    """Numbers of the tokens of texts, and by number what a token stands for; up to a bound, beyond which it is begun anew."""

    def __init__(self, single: dict[str, int], parts: dict[str, int]) -> None:
        super().__init__()
        self.variants, self.single, self.parts = Variants(), single, parts
        self.many, self.places, self.key_many, self.key_flat = [], [], [], []

    def __missing__(self, raw: str) -> int:
        # a variant without a mark in it is a run; what is numbered here isn't remembered twice
        every = [t for v in self.variants[raw] for t in ((v,) if v.isalnum() else _RUN.findall(v))]
        self.variants.clear()
        keys = [k for t in every if (k := self.single.get(t)) is not None]
        self.many.append(len(every))
        self.places += [self.parts.get(t, 0) for t in every]
        self.key_many.append(len(keys))
        self.key_flat += keys
        self[raw] = n = len(self)
        return n

    def tables(self) -> tuple[np.ndarray, ...]:
        """Of each token the number of its terms and keys and where they begin, and the terms and keys."""
        many, key_many = np.array(self.many, np.int64), np.array(self.key_many, np.int64)
        return many, np.cumsum(many) - many, np.array(self.places, np.int64), key_many, np.cumsum(key_many) - key_many, np.array(self.key_flat, np.int64)


def _spread(many: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The places begin, begin + 1, … of each row, as many as it has."""
    return np.repeat(begin - (np.cumsum(many) - many), many) + np.arange(many.sum())


#: Tokens of texts that are looked at together.
TOGETHER = 500_000


class Phrases:
    """Picks the phrases asked for out of the tokens of chunks' fields, by the fields' weights.

    Many chunks are looked at together. A longer phrase is met by its first two
    terms, side by side: what it costs doesn't depend on how many are asked for.
    """

    def __init__(self, keys: dict[str, int], weights: dict[str, float]) -> None:
        self.keys, self.weights = len(keys), weights
        longer = [(p.split(" "), k) for p, k in keys.items() if " " in p]
        parts: dict[str, int] = {}
        for p, _ in longer:
            for t in p:
                parts.setdefault(t, len(parts) + 1)
        self.terms = len(parts) + 1
        single = {p: k for p, k in keys.items() if " " not in p}
        self.begun = lambda: _Numbers(single, parts)
        self.known = self.begun()
        #: Phrases by length: by the first two terms, in order, and the terms and keys.
        self.longer = []
        for n in sorted({len(p) for p, _ in longer}):
            rows = np.array([[parts[t] for t in p] for p, _ in longer if len(p) == n], np.int64)
            own = np.array([k for p, k in longer if len(p) == n], np.int64)
            first = rows[:, 0] * self.terms + rows[:, 1]
            order = np.argsort(first, kind="stable")
            self.longer.append((first[order], rows[order], own[order]))

    def pick(self, columns: list[list[str]]) -> Iterator[tuple[np.ndarray, ...]]:
        """Of some chunks after the other: their lengths, of each how many keys it has, the keys, and how much of each."""
        numbers: list[int] = []
        ends: list[int] = []
        for fields in zip(*columns, strict=True):
            for part in fields:
                numbers += map(self.known.__getitem__, _TOKEN.findall(part))
                ends.append(len(numbers))
            if len(numbers) > TOGETHER:
                yield self._picked(numbers, ends, len(fields))
                numbers, ends = [], []
                if len(self.known) > 300_000:
                    self.known = self.begun()
        if ends:
            yield self._picked(numbers, ends, len(columns))

    def _picked(self, numbers: list[int], ends: list[int], fields: int) -> tuple[np.ndarray, ...]:
        many, begin, places, key_many, key_begin, key_flat = self.known.tables()
        raw, chunks = np.array(numbers, np.int64), len(ends) // fields
        place = np.repeat(np.arange(len(ends)), np.diff(np.array(ends), prepend=0))
        weight = np.full(fields, self.weights["text"])
        weight[1] += self.weights["symbol"]
        weight[3] += self.weights["path"]
        twice = np.ones(fields, np.int64)
        twice[[1, 3]] = 2
        length = np.bincount(place // fields, many[raw] * twice[place % fields], chunks).astype(np.int32)
        at = [np.repeat(place, key_many[raw])]
        keys, much = [key_flat[_spread(key_many[raw], key_begin[raw])]], [weight[at[0] % fields]]
        if self.longer:
            term, where = places[_spread(many[raw], begin[raw])], np.repeat(place, many[raw])
            pair = np.flatnonzero((term[:-1] > 0) & (term[1:] > 0))
            code = term[pair] * self.terms + term[pair + 1]
            for first, rows, own in self.longer:
                low = np.searchsorted(first, code, "left")
                met = np.flatnonzero(first[np.minimum(low, len(first) - 1)] == code)
                n = np.searchsorted(first, code[met], "right") - low[met]
                start, phrase = np.repeat(pair[met], n), _spread(n, low[met])
                size = rows.shape[1]
                ok = start + size <= len(term)
                start, phrase = start[ok], phrase[ok]
                ok = where[start] // fields == where[start + size - 1] // fields
                for i in range(2, size):
                    ok &= term[start + i] == rows[phrase, i]
                start, phrase = start[ok], phrase[ok]
                # in the whole text a phrase may go across fields, in a field of its own it may not
                inside = where[start] == where[start + size - 1]
                at.append(where[start])
                keys.append(own[phrase])
                much.append(np.where(inside, weight[where[start] % fields], self.weights["text"]))
        code = np.concatenate(at) // fields * self.keys + np.concatenate(keys)
        order = np.argsort(code)
        code = code[order]
        begin = np.flatnonzero(np.diff(code, prepend=-1))
        f = np.add.reduceat(np.concatenate(much)[order], begin) if len(begin) else np.empty(0)
        code = code[begin]
        return length, np.bincount(code // max(1, self.keys), minlength=chunks), (code % max(1, self.keys)).astype(np.int32), f


class Named:
    """What a chunk gains when a query names its symbol, path or element path: the queries and the bonus, as ``lexical.bonus`` has it."""

    def __init__(self, texts: list[tuple[str, str]], bonuses: tuple[float, float, float, float], pixels: tuple[str, ...]) -> None:
        self.texts, self.bonuses, self.pixels = texts, bonuses, set(pixels)
        self.variants = Variants()
        #: Queries by a run that isn't at an end of theirs, the shortest first; by their first letters; by tokens of theirs, made for the first chunk with an element path.
        self.inner: dict[str, list[tuple[int, int]]] = {}
        self.first: dict[int, dict[str, list[int]]] = {}
        self.token: dict[str, array] | None = None
        for q, (query, low) in enumerate(self.texts):
            if query:
                runs = _RUN.findall(low)
                if len(runs) > 2:
                    self.inner.setdefault(max(runs[1:-1], key=len), []).append((min(len(query), len(low)), q))
                else:
                    width = min(3, len(low))
                    self.first.setdefault(width, {}).setdefault(low[:width], []).append(q)
        for own in self.inner.values():
            own.sort()

    def _by_token(self) -> dict[str, array]:
        if self.token is None:
            self.token = {}
            for q, (query, _) in enumerate(self.texts):
                for t in set(tokens(query, self.variants)):
                    self.token.setdefault(t, array("i")).append(q)
        return self.token

    def gains(self, symbol: str, low_symbol: str, path: str, low_path: str, xml: str) -> dict[int, float]:
        """The bonus by query, where there is one."""
        exact, inside, in_path, element = self.bonuses
        met: set[int] = set()
        ground = f"{low_symbol}\n{low_path}"
        if self.inner:
            longest = max(len(symbol), len(low_symbol), len(path))
            for r in set(_RUN.findall(ground)):
                for size, q in self.inner.get(r, ()):
                    if size > longest:
                        break
                    met.add(q)
        for width, seeds in self.first.items():
            met.update(q for s in {ground[i : i + width] for i in range(len(ground) - width + 1)} if s in seeds for q in seeds[s])
        own = {v for raw in _TOKEN.findall(xml) for v in self.variants[raw]} if "/" in xml else set()
        if own:
            token = self._by_token()
            met.update(q for t in own | (self.pixels if own & self.pixels else set()) for q in token.get(t, ()))
        out = {}
        for q in met:
            query, low = self.texts[q]
            gain = exact if query == symbol else inside if low in low_symbol else 0.0
            gain += in_path if query in path else 0.0
            if own:
                asked = set(tokens(query, self.variants))
                gain += element if asked & own else 0.0
                gain += element if own & self.pixels and asked & self.pixels else 0.0
            if gain > 0:
                out[q] = gain
        return out


def picked(chunks: DataFrame, kept: list[str], most_chars: int | None, picker: Callable[[], Tokens | Phrases], named: Callable[[], Named]) -> DataFrame:
    """Of each chunk the columns ``kept`` and those of ``PICKED``; whole texts are read, or their first ``most_chars`` characters."""
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    text = empty("text") if most_chars is None else F.substring(empty("text"), 1, most_chars)
    read = [text.alias("_0"), *[empty(c).alias(f"_{i}") for i, c in enumerate(("symbol", "xml_path", "source_path", "kind"), 1)], F.lower(empty("symbol")).alias("_5"), F.lower(empty("source_path")).alias("_6")]
    rows = chunks.select(*kept, *read)
    schema = ", ".join([*[f"`{n}` {t}" for n, t in chunks.select(*kept).dtypes], PICKED])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, names = picker(), named()
        for batch in batches:
            text, symbol, xml, path, kind, *low = (c.to_pylist() for c in batch.columns[len(kept) :])
            identities = zip(symbol, low[0], path, low[1], xml, strict=True)
            begin = 0
            for length, many, keys, f in own.pick([text, symbol, xml, path, kind]):
                more = [names.gains(*x) for x in islice(identities, len(length))]
                ends, gain_ends = (pa.array(np.append(0, np.cumsum(n)), pa.int32()) for n in (many, [len(x) for x in more]))
                queries, gains = pa.array([q for x in more for q in x], pa.int32()), pa.array([g for x in more for g in x.values()], pa.float64())
                lists = [pa.ListArray.from_arrays(e, x) for e, x in ((ends, pa.array(keys)), (ends, pa.array(f)), (gain_ends, queries), (gain_ends, gains))]
                yield pa.RecordBatch.from_arrays([*batch.slice(begin, len(length)).columns[: len(kept)], pa.array(length), *lists], [*kept, "length", "keys", "f", "named", "gain"])
                begin += len(length)

    return rows.mapInArrow(run, schema)


@dataclass
class Impact:
    """How much a key that stands f times in a chunk adds to its score, before the key's weight."""

    k1: float
    b: float
    mean: float

    def of(self, f: np.ndarray, length: np.ndarray) -> np.ndarray:
        return f * (self.k1 + 1) / (f + self.k1 * (1 - self.b + self.b * length / self.mean))


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of lists, and of each the row it is in."""
    return lists.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))


def key_statistics(rows: DataFrame, many: int, impact: Impact) -> tuple[np.ndarray, np.ndarray]:
    """Of each key in how many chunks it stands, and the most it adds to any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, top = np.zeros(many, np.int64), np.zeros(many)
        for batch in batches:
            keys, at = _flat(batch.column(0))
            df += np.bincount(keys, minlength=many)
            np.maximum.at(top, keys, impact.of(_flat(batch.column(1))[0], batch.column(2).to_numpy()[at]))
        there = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(df[there]), pa.array(top[there])], ["key", "df", "top"])

    made = rows.select("keys", "f", "length").mapInArrow(run, "key int, df bigint, top double").groupBy("key").agg(F.sum("df").alias("df"), F.max("top").alias("top"))
    found = made.toArrow()
    df, top = np.zeros(many), np.zeros(many)
    key = found["key"].to_numpy()
    df[key], top[key] = found["df"].to_numpy(), found["top"].to_numpy()
    return df, top


#: Keys and rows that are scored at once at most.
POSTINGS, ROWS = 4_000_000, 60_000


#: Keys are looked at in all chunks until the others add less than this share of what is needed.
LEFT = 0.4


#: How much more it costs to look at a key of a chunk than at a chunk of a key.
COSTLY = 4


class Best:
    """The best chunks of each query among those a task has seen.

    A query's keys are in order of the most they add. Once ``limit`` chunks
    are known, a chunk with none of the first keys can't be among the best if
    what the others add at most is less than the last of these has. Of the
    others all keys are looked at only where the first ones leave that open.
    """

    def __init__(self, terms: np.ndarray, times: np.ndarray, ends: np.ndarray, weights: np.ndarray, top: np.ndarray, impact: Impact, limit: int, bonus: bool, alone: bool) -> None:
        self.impact, self.limit, self.bonus, self.alone, self.weights = impact, limit, bonus, alone, weights
        self.kept: list[list[tuple[float, str, float, float]]] = [[] for _ in ends[1:]]
        most = times * (weights * top)[terms]
        order = np.lexsort((-most, np.repeat(np.arange(len(self.kept)), np.diff(ends))))
        self.term, self.times, self.ends = terms[order].astype(np.int64), times[order].astype(np.float64), ends.tolist()
        #: What a query's keys from each on add at most.
        self.rest, most = np.zeros(len(most)), most[order]
        for a, b in zip(self.ends, self.ends[1:]):
            self.rest[a:b] = np.cumsum(most[a:b][::-1])[::-1]

    def add(self, ids: pa.Array, length: np.ndarray, keys: tuple[np.ndarray, np.ndarray], f: np.ndarray, named: tuple[np.ndarray, np.ndarray], gain: np.ndarray) -> None:
        """Look at some chunks."""
        rows_in, many = len(length), len(self.weights)
        own = self.impact.of(f, length[keys[1]]) * self.weights[keys[0]]
        order = np.argsort(keys[0], kind="stable")
        at, add = keys[1][order], own[order]
        ends = np.searchsorted(keys[0][order], np.arange(many + 1))
        row_ends = np.searchsorted(keys[1], np.arange(rows_in + 1))
        row_many, asked_for = np.diff(row_ends), np.zeros(many)
        by_query = np.argsort(named[0], kind="stable")
        asked, first = np.unique(named[0][by_query], return_index=True)
        gained = {q: by_query[a:b] for q, a, b in zip(asked.tolist(), first, np.append(first, len(by_query))[1:], strict=True)}

        def summed(terms: np.ndarray, times: np.ndarray) -> np.ndarray:
            """What some keys add to each chunk."""
            low, high = ends[terms], ends[terms + 1]
            lists = [slice(a, b) for a, b in zip(low.tolist(), high.tolist(), strict=True)]
            if not lists:
                return np.zeros(rows_in)
            much = np.concatenate([add[x] for x in lists])
            if (times != 1).any():
                much *= np.repeat(times, high - low)
            return np.bincount(np.concatenate([at[x] for x in lists]), much, rows_in)

        for q, (a, b) in enumerate(zip(self.ends, self.ends[1:])):
            kept, more = self.kept[q], gained.get(q)
            floor = -kept[-1][0] - 1e-6 if len(kept) == self.limit else 0.0
            terms, times, rest = self.term[a:b], self.times[a:b], self.rest[a:b]
            must = b - a if more is not None or not floor > 0 else int(np.searchsorted(-rest, -floor * LEFT, side="left"))
            if more is None and not (ends[terms[:must] + 1] > ends[terms[:must]]).any():
                continue
            score = summed(terms[:must], times[:must])
            if must < b - a:
                rows = np.flatnonzero(score >= floor - rest[must])
                if not len(rows):
                    continue
                if COSTLY * row_many[rows].sum() > (ends[terms[must:] + 1] - ends[terms[must:]]).sum():
                    score += summed(terms[must:], times[must:])
                else:
                    asked_for[terms] = times
                    places, begin = _spread(row_many[rows], row_ends[rows]), np.cumsum(row_many[rows]) - row_many[rows]
                    score[rows] = np.add.reduceat(asked_for[keys[0][places]] * own[places], begin)
                    asked_for[terms] = 0.0
                rows = rows[score[rows] >= floor]
            else:
                rows = None
            bonus: dict[int, float] = {}
            if more is not None:
                where, much = named[1][more], gain[more]
                ok = slice(None) if self.alone else score[where] > 0
                bonus = dict(zip(where[ok].tolist(), much[ok].tolist(), strict=True))
                if self.bonus:
                    score[where[ok]] += much[ok]
            if rows is None:
                rows = np.flatnonzero((score > 0) & (score >= floor))
            if len(rows) > self.limit:
                last = np.partition(score[rows], len(rows) - self.limit)[len(rows) - self.limit]
                rows = rows[score[rows] >= last - 1e-8]
            if len(rows):
                made = score[rows]
                fresh = zip((-np.round(made, 9)).tolist(), ids.take(pa.array(rows)).to_pylist(), made.tolist(), [bonus.get(r, 0.0) for r in rows.tolist()], strict=True)
                self.kept[q] = sorted([*kept, *fresh])[: self.limit]


#: Chunks that a task scores at least, where there are so many for each core: every task lists the best of each query.
SCORED = 150_000


def best(rows: DataFrame, many_rows: int, asked: Asked, id_type, weights: np.ndarray, top: np.ndarray, impact: Impact, limit: int, bonus: bool, alone: bool) -> DataFrame:
    """query_id, chunk_id, score, gain: of each task the best of each query, among which the best are.

    ``bonus``: whether what a chunk gains counts; ``alone``: whether it is
    enough to be listed.
    """
    kind, query_ids, queries = to_arrow_type(id_type), asked.ids, [np.array(x) for x in (asked.terms, asked.times, asked.ends)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Best(*queries, weights, top, impact, limit, bonus, alone)
        waiting: list[pa.RecordBatch] = []

        def look() -> None:
            whole = pa.Table.from_batches(waiting).combine_chunks()
            ids, length, keys, f, named, gain = (c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in whole.columns)
            found.add(ids, length.to_numpy(), _flat(keys), _flat(f)[0], _flat(named), _flat(gain)[0])
            waiting.clear()

        many = looks = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            waiting.append(batch)
            many += len(batch.column(2).flatten())
            # a short first look shows what is needed to be among the best
            if many > (POSTINGS if looks else POSTINGS // 8) or sum(b.num_rows for b in waiting) > (ROWS if looks else ROWS // 8):
                look()
                many, looks = 0, looks + 1
        if waiting:
            look()
        for begin in range(0, len(found.kept), 1000):
            flat = [(query_ids[q], *row[1:]) for q in range(begin, min(begin + 1000, len(found.kept))) for row in found.kept[q]]
            ids, chunks, scores, gains = zip(*flat, strict=True) if flat else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(chunks, pa.string()), pa.array(scores, pa.float64()), pa.array(gains, pa.float64())], ["query_id", "chunk_id", "score", "gain"])

    cores = max(1, rows.sparkSession.sparkContext.defaultParallelism)
    rows = rows.select("chunk_id", "length", "keys", "f", "named", "gain").coalesce(cores * max(1, -(-many_rows // (cores * SCORED))))
    return rows.mapInArrow(run, f"query_id {id_type.simpleString()}, chunk_id string, score double, gain double")
