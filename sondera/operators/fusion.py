"""Ranked lists put together: reciprocal ranks, reranking, at most so many of a source."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sondera.functions import text as tx

#: The constant of reciprocal rank fusion, and of the reranker's bonus for position.
RRF_K = 60
POSITION = 1000


def reciprocal_ranks(lists: DataFrame, limit: int = 10, k: int = RRF_K, group: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """One list from several: group columns, rank, chunk_id, score, first_list, first_rank.

    ``lists`` has list_idx and rank. A chunk scores 1 / (k + rank) in each list
    it is in, at its best rank there; of equal scores the one met first (by
    list, then rank, then id) is first. Rows without an id or a rank are left out.
    """
    rows = lists.where(F.col("chunk_id").isNotNull() & F.col("rank").isNotNull()).groupBy(*group, "list_idx", "chunk_id").agg(F.min("rank").alias("rank"))
    fused = rows.groupBy(*group, "chunk_id").agg(F.sum(F.lit(1.0) / (F.lit(k) + F.col("rank"))).alias("score"), F.min(F.struct("list_idx", "rank")).alias("_first"))
    order = Window.partitionBy(*group).orderBy(F.desc(F.round("score", 12)), "_first", "chunk_id")
    out = fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    return out.select(*group, "rank", "chunk_id", "score", F.col("_first.list_idx").alias("first_list"), F.col("_first.rank").alias("first_rank"))


def rerank(results: DataFrame, limit: int | None = None) -> DataFrame:
    """Ordered again by shared words, an exact symbol and the place so far; the old score stays as pre_rerank_score.

    ``results`` has query_id, query, rank, chunk_id, score, text and symbol.
    """
    asked, said = F.array_distinct(tx.white_space_words("query")), F.array_distinct(tx.white_space_words("text"))
    shared = F.size(F.array_intersect(asked, said)).cast("double")
    exact = F.when((F.coalesce("symbol", F.lit("")) != "") & (F.lower("query") == F.lower("symbol")), F.lit(2.0)).otherwise(F.lit(0.0))
    scored = results.withColumn("pre_rerank_score", F.col("score")).withColumn("score", shared + exact + F.lit(1.0) / (F.col("rank") - 1 + POSITION))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "rank", "chunk_id")
    out = scored.withColumn("rank", F.row_number().over(order))
    return out.where(F.col("rank") <= limit) if limit else out


def diversify(results: DataFrame, most: int | None, source: str = "source_path", limit: int | None = None) -> DataFrame:
    """At most ``most`` results of a source for each query, in their order; none or below 1 changes nothing.

    Ranks are counted anew, and cut at ``limit``.
    """
    if most is not None and most >= 1:
        own = F.coalesce(F.nullif(F.col(source), F.lit("")), F.col("chunk_id"))
        place = Window.partitionBy("query_id", "_source").orderBy("rank", "chunk_id")
        results = results.withColumn("_source", own).withColumn("_n", F.row_number().over(place)).where(F.col("_n") <= most).drop("_n", "_source")
    again = results.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "chunk_id")))
    return again.where(F.col("rank") <= limit) if limit else again
