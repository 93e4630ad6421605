"""Ranking by words: BM25 over bags of tokens and over phrases in weighted fields, for batches of queries.

What is searched is a stored inverted index (``words``) or a frame of chunks,
which is scanned once (``scanned``). Only what some query asks for leaves the
scan; texts are never read for a search in a stored index. Each chunk is scored
in one task, which keeps the best of each query alone. Scores are ranked
rounded, with the chunk's id against ties, so results don't depend on the order
of sums. A search of a batch runs a few small jobs before it returns its frame.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sondera.functions import text as tx
from sondera.operators import filters as flt
from sondera.operators import scanned
from sondera.operators.latest import latest
from sondera.operators.words import FIELD_BASE, WordIndex
from sondera.session import settle



@dataclass
class Versions:
    """A table of chunks in which a chunk may stand in several versions, the latest of which counts.

    It is picked after a version's text was read, so no text is exchanged.
    """

    rows: DataFrame


Source = DataFrame | WordIndex | Versions

#: Saturation and length normalisation of the two rankings, and the fields' weights.
BAG_K1, BAG_B = 1.5, 0.75
PHRASE_K1, PHRASE_B = 1.2, 0.75
FIELD_WEIGHTS = {"text": 1.0, "symbol": 8.0, "path": 3.0}
BONUS_EXACT, BONUS_SYMBOL, BONUS_PATH, BONUS_XML = 10.0, 3.0, 1.0, 1.5
PIXEL_WORDS = ("pix", "pixel", "pixels")


def checked_limit(limit: int) -> int:
    """A limit of at least one, or an error."""
    if limit < 1:
        raise ValueError("limit must be at least 1")
    return limit


def postings(source: Source) -> DataFrame:
    """token, chunk_id, tf: the inverted index as a table."""
    return indexed(source, lasting=False).tokens.select("token", "chunk_id", "tf")


def document_frequencies(source: Source) -> DataFrame:
    """token, df: in how many chunks a token stands."""
    return indexed(source, lasting=False).tokens.groupBy("token").agg(F.count("*").alias("df"))


def corpus_statistics(source: Source) -> DataFrame:
    """n_docs and avg_len (1.0 for an empty corpus), one row."""
    return indexed(source, lasting=False).docs.agg(F.count("*").alias("n_docs"), F.coalesce(F.avg("bag_length"), F.lit(1.0)).alias("avg_len"))


def query_tokens(queries: DataFrame, distinct: bool = False) -> DataFrame:
    """query_id, token, qtf: the queries' tokens and how often each is asked for."""
    found = tx.match_terms("query") if distinct else tx.tokens("query")
    return queries.select("query_id", F.explode(found).alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("qtf"))


def _identity(chunks: DataFrame) -> DataFrame:
    """What of a chunk the bonus looks at, with the tokens of its element path made once for the chunk."""
    xml = F.coalesce("xml_path", F.lit(""))
    return chunks.select(
        "chunk_id", F.coalesce("symbol", F.lit("")).alias("_symbol"), F.coalesce("source_path", F.lit("")).alias("_path"),
        F.when(xml.contains("/"), tx.tokens(xml)).alias("_elements"),
    )


def bonus(query: Column, qtokens: Column) -> Column:
    """What a chunk (as ``_identity`` shows it) gains when a query names its symbol, path or element path."""
    symbol = F.when(query == F.col("_symbol"), F.lit(BONUS_EXACT)).when(F.contains(F.lower("_symbol"), F.lower(query)), F.lit(BONUS_SYMBOL)).otherwise(F.lit(0.0))
    path = F.when(F.contains(F.col("_path"), query), F.lit(BONUS_PATH)).otherwise(F.lit(0.0))
    own, words = F.col("_elements"), F.array(*[F.lit(w) for w in PIXEL_WORDS])
    named = F.when(own.isNotNull() & F.arrays_overlap(qtokens, own), F.lit(BONUS_XML)).otherwise(F.lit(0.0))
    pixels = F.when(own.isNotNull() & F.arrays_overlap(qtokens, words) & F.arrays_overlap(own, words), F.lit(BONUS_XML)).otherwise(F.lit(0.0))
    return symbol + path + named + pixels


def _named(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """query_id, chunk_id where the query stands in the symbol or the path.

    A query of three runs of letters and digits or more meets chunks by its
    longest run that isn't at an end, which must be a whole one of theirs; a
    shorter query by its first three letters. What no query needs isn't made.
    """
    asked = queries.where(F.length("query") > 0).select("query_id", "query")
    runs = F.regexp_extract_all(F.lower("query"), F.lit("[a-z0-9]+"), F.lit(0))
    inner = F.slice(runs, 2, F.greatest(F.size(runs) - 2, F.lit(0)))
    asked = asked.withColumn("_inner", F.when(F.size(runs) > 2, F.array_max(F.transform(inner, lambda r: F.struct(F.length(r).alias("n"), r.alias("r"))))["r"]))
    asked = asked.withColumn("_width", F.when(F.col("_inner").isNotNull(), 0).otherwise(F.least(F.length("query"), F.lit(3))))
    ground = F.lower(F.concat_ws("\n", F.coalesce("symbol", F.lit("")), F.coalesce("source_path", F.lit(""))))
    inside = F.contains(F.lower(F.coalesce("symbol", F.lit(""))), F.lower(F.col("query"))) | F.contains(F.coalesce("source_path", F.lit("")), F.col("query"))
    found = None
    # at most four numbers
    for width in sorted(r[0] for r in asked.select("_width").distinct().collect()):
        n = F.length(ground) - width + 1
        pieces = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(ground, i, F.lit(width)))).otherwise(F.array().cast("array<string>"))  # noqa: B023
        seeds = F.regexp_extract_all(ground, F.lit("[a-z0-9]+"), F.lit(0)) if not width else pieces
        here = docs.select("chunk_id", "symbol", "source_path", F.explode(F.array_distinct(seeds)).alias("seed"))
        part = asked.where(F.col("_width") == width).select("query_id", "query", F.coalesce("_inner", F.lower(F.left("query", F.lit(width)))).alias("seed"))
        met = here.join(part, "seed").where(inside).select("query_id", "chunk_id")
        found = met if found is None else found.unionByName(met)
    return (found if found is not None else asked.select("query_id", F.lit("").alias("chunk_id"))).distinct()


def ranked(scores: DataFrame, limit: int, score: str = "score") -> DataFrame:
    """The best ``limit`` rows of each query, with their rank from 1."""
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round(score, 9)), F.asc("chunk_id"))
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


#: Rows of a frame that are sent to every task at most: some 10 MB.
SENT = 100_000


def small(df: DataFrame, most: int = SENT) -> DataFrame:
    """The frame, marked to be sent to every task if it has so few rows; counted, not guessed."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def _gains(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """query_id, chunk_id, bonus of all pairs with a bonus: the query stands in the symbol or path, or shares a token with the element path."""
    pixel = lambda c: F.when(c.isin(*PIXEL_WORDS), F.array(c, F.lit("\0pixel"))).otherwise(F.array(c))
    marked = lambda c: F.array_distinct(F.flatten(F.transform(c, pixel)))
    asked = queries.select("query_id", F.col("query").alias("_query"), tx.tokens("query").alias("_qtokens"))
    elements = _identity(docs.where(F.contains(F.coalesce("xml_path", F.lit("")), F.lit("/")))).select("chunk_id", F.explode(marked("_elements")).alias("token"))
    by_element = elements.join(asked.select("query_id", F.explode(marked("_qtokens")).alias("token")), "token").select("query_id", "chunk_id")
    pairs = _named(queries, docs).unionByName(by_element).distinct()
    made = pairs.join(_identity(docs), "chunk_id").join(asked, "query_id").select("query_id", "chunk_id", bonus(F.col("_query"), F.col("_qtokens")).alias("bonus"))
    return made.where("bonus > 0")


def _batches(queries: DataFrame, phrases: bool) -> Iterator[scanned.Asked]:
    """The queries, as many at a time as are searched for at once; the driver holds one batch."""
    made = settle(queries.where(F.col("query_id").isNotNull()).select("query_id", F.coalesce("query", F.lit("")).alias("query"), F.lower(F.coalesce("query", F.lit(""))).alias("low")))
    asked = scanned.Asked(phrases)
    for row in made.toLocalIterator():
        asked.add(*row)
        if asked.full():
            yield asked
            asked = scanned.Asked(phrases)
    if asked.ids:
        yield asked


def _picked(source: Source, asked: scanned.Asked, queries: DataFrame, filters: Mapping[str, Any] | None, most_chars: int | None) -> DataFrame:
    """A row for each chunk: chunk_id, allowed (by the filters) and what ``scanned.PICKED`` names."""
    if isinstance(source, WordIndex):
        return _from_index(source, asked, queries, filters)
    rows = source.rows if isinstance(source, Versions) else source
    rows = rows.where(F.col("chunk_id").isNotNull()).withColumn("allowed", flt.predicate(rows, filters))
    kept = ["chunk_id", *(["indexed_at", "content_hash"] if isinstance(source, Versions) else []), "allowed"]
    keys, texts = asked.keys, asked.texts
    picker = (lambda: scanned.Phrases(keys, FIELD_WEIGHTS)) if asked.phrases else (lambda: scanned.Tokens(keys))
    made = scanned.picked(rows, kept, most_chars, picker, lambda: scanned.Named(texts, (BONUS_EXACT, BONUS_SYMBOL, BONUS_PATH, BONUS_XML), PIXEL_WORDS))
    return latest(made, "chunk_id", "indexed_at", ["allowed", "length", "keys", "f", "named", "gain"], "content_hash") if isinstance(source, Versions) else made


def _from_index(index: WordIndex, asked: scanned.Asked, queries: DataFrame, filters: Mapping[str, Any] | None) -> DataFrame:
    """``_picked`` from the postings of a stored index."""
    spark, kind = index.docs.sparkSession, dict(queries.dtypes)["query_id"]
    numbered = spark.createDataFrame(list(asked.keys.items()), "key string, _k int")
    mine = spark.createDataFrame([(q, i) for i, q in enumerate(asked.ids)], f"query_id {kind}, _q int")
    queries = queries.join(small(mine.select("query_id")), "query_id", "left_semi")
    if asked.phrases:
        hits, length = _phrase_hits(index, queries)[0], "phrase_length"
    else:
        hits, length = index.tokens.select("chunk_id", F.col("token").alias("key"), F.col("tf").cast("double").alias("f")), "bag_length"
    hits = hits.join(small(numbered), "key").groupBy("chunk_id").agg(F.collect_list(F.struct("_k", "f")).alias("_hits"))
    gains = _gains(queries, index.docs).join(small(mine), "query_id").groupBy("chunk_id").agg(F.collect_list(F.struct("_q", "bonus")).alias("_gains"))
    made = index.docs.select("chunk_id", flt.predicate(index.docs, filters).alias("allowed"), F.col(length).alias("length")).join(hits, "chunk_id", "left").join(gains, "chunk_id", "left")
    listed = lambda c, kind: F.coalesce(F.col(c), F.array().cast(f"array<{kind}>"))
    return made.select("chunk_id", "allowed", "length", listed("_hits._k", "int").alias("keys"), listed("_hits.f", "double").alias("f"), listed("_gains._q", "int").alias("named"), listed("_gains.bonus", "double").alias("gain"))


def _best(
    source: Source, queries: DataFrame, phrases: bool, filters: Mapping[str, Any] | None, limit: int, k1: float, b: float,
    idf: Callable[[int, np.ndarray], np.ndarray], named: bool, most_chars: int | None, bonus_too: bool = True,
) -> DataFrame:
    """query_id, chunk_id, score, gain: the best chunks of each query.

    Statistics are those of all chunks. ``named``: whether a bonus is enough
    to be listed; ``bonus_too``: whether the score has it.
    """
    out = None
    for asked in _batches(queries, phrases):
        rows = settle(_picked(source, asked, queries, filters, most_chars))
        row = rows.agg(F.count("*").alias("n"), F.avg("length").alias("mean")).first()
        impact = scanned.Impact(k1, b, float(row["mean"] or 1.0))
        df, top = scanned.key_statistics(rows, len(asked.keys), impact)
        found = scanned.best(rows.where("allowed"), row["n"], asked, queries.schema["query_id"].dataType, idf(max(1, row["n"]), df), top, impact, limit, bonus_too, named)
        # of what each task lists only the best are kept
        found = settle(ranked(found, limit).drop("rank"))
        out = found if out is None else out.unionByName(found)
    return out if out is not None else queries.limit(0).select("query_id", F.lit("").alias("chunk_id"), F.lit(0.0).alias("score"), F.lit(0.0).alias("gain"))


def indexed(source: Source, most_chars: int | None = None, lasting: bool = True) -> WordIndex:
    """The index of a source: itself, or that of its chunks, of whole texts or of their first characters."""
    return source if isinstance(source, WordIndex) else WordIndex.of(source, FIELD_WEIGHTS, most_chars, lasting)


def bm25(source: Source, queries: DataFrame, limit: int = 10, filters: Mapping[str, Any] | None = None, named: bool = True, most_chars: int | None = None) -> DataFrame:
    """The best chunks of each query by BM25 over bags of tokens: query_id, rank, chunk_id, score.

    ``source`` is a stored index, a frame of chunks or a table with ``Versions``
    of them. ``queries`` has query_id and query; repeated query tokens count. Statistics are those of all chunks,
    filters only choose who may be listed. A chunk whose symbol or path the
    query names gains a bonus, which alone is enough to be listed
    (``named=False`` leaves such chunks out). Queries without tokens list only
    what they name; an empty query lists nothing. ``most_chars`` bounds what of
    a frame's texts is searched (``functions.text.MAX_INDEXED`` is a usual
    bound); by default nothing does.
    """
    checked_limit(limit)
    found = _best(source, queries, False, filters, limit, BAG_K1, BAG_B, lambda n, df: np.log(1.0 + (n - df + 0.5) / (df + 0.5)), named, most_chars)
    return ranked(found, limit).select("query_id", "rank", "chunk_id", "score")


def _phrase_hits(index: WordIndex, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``hits`` and ``asked`` of phrases: a query's distinct tokens are phrases of letter and digit runs, any of which may match."""
    asked = queries.select("query_id", F.explode(tx.match_terms("query")).alias("token")).withColumn("phrase", tx.phrase_terms("token")).where(F.size("phrase") > 0)
    asked = asked.withColumn("key", F.array_join("phrase", " "))
    phrases = asked.select("key", "phrase").distinct()
    wanted = phrases.select(F.explode("phrase").alias("term")).distinct()
    seen = settle(index.terms.join(wanted, "term"))
    # a phrase of one term is that term
    single = seen.join(phrases.where(F.size("phrase") == 1).select(F.col("key").alias("term")), "term").select("chunk_id", "length", F.col("term").alias("key"), "f")
    # a longer one stands where each of its terms does, as many places further on as it is in the phrase
    many = phrases.where(F.size("phrase") > 1).select("key", F.size("phrase").alias("n"), F.posexplode("phrase").alias("i", "term"))
    met = seen.join(many, "term").select("chunk_id", "length", "key", "n", "i", F.transform("places", lambda p: p - F.col("i")).alias("starts"))
    met = met.groupBy("chunk_id", "length", "key", "n").agg(F.collect_list("starts").alias("all")).where(F.size("all") == F.col("n"))
    starts = F.aggregate(F.slice("all", 2, F.size("all")), F.get("all", F.lit(0)), F.array_intersect)
    weigh = lambda p: F.when(p >= FIELD_BASE["path"], FIELD_WEIGHTS["path"]).when(p >= FIELD_BASE["symbol"], FIELD_WEIGHTS["symbol"]).otherwise(FIELD_WEIGHTS["text"])
    longer = met.select("chunk_id", "length", "key", F.aggregate(starts, F.lit(0.0), lambda s, p: s + weigh(p)).alias("f")).where("f > 0")
    # one occurrence of each distinct token counts, tokens of the same phrase add up
    return single.unionByName(longer), asked.groupBy("query_id", "key").agg(F.count("*").alias("qtf"))


def _phrase_idf(n: int, df: np.ndarray) -> np.ndarray:
    raw = np.log((n + 0.5 - np.minimum(df, n)) / (df + 0.5))
    return np.where(raw > 0, raw, 1e-6)


def bm25_phrases(
    source: Source, queries: DataFrame, limit: int = 10, filters: Mapping[str, Any] | None = None, two_stage: bool = False, fetch: int | None = None, most_chars: int | None = None
) -> DataFrame:
    """The best chunks of each query by phrases in weighted fields: query_id, rank, chunk_id, score.

    With ``two_stage`` only the best ``fetch`` (by default ``limit``) chunks
    before the bonus can be listed, as an engine that cuts first would; else
    the bonus counts for all chunks that match. ``source`` and ``most_chars``
    are as for ``bm25``.
    """
    checked_limit(limit)
    how = (PHRASE_K1, PHRASE_B, _phrase_idf, False, most_chars)
    if two_stage:
        cut = ranked(_best(source, queries, True, filters, fetch or limit, *how, bonus_too=False), fetch or limit)
        found = cut.select("query_id", "chunk_id", (F.col("score") + F.col("gain")).alias("score")).where("score > 0")
    else:
        found = _best(source, queries, True, filters, limit, *how)
    return ranked(found, limit).select("query_id", "rank", "chunk_id", "score")
