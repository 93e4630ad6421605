"""Chunks by what they are called and by what stands around them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def by_symbols(chunks: DataFrame, symbols: DataFrame, limit: int) -> DataFrame:
    """symbol, rank and the first ``limit`` chunks of each of many symbols (``symbol``), in the order of their sources."""
    place = Window.partitionBy("symbol").orderBy("source_path", "ord", "chunk_id")
    found = chunks.join(symbols.select("symbol").distinct(), "symbol")
    return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= limit)


def by_symbol(chunks: DataFrame, symbol: str, limit: int | None = None, knowledge_id: str | None = None) -> DataFrame:
    """Chunks of a symbol, in the order of their sources."""
    found = chunks.where(F.col("symbol") == symbol)
    if knowledge_id is not None:
        found = found.where(F.col("knowledge_id") == knowledge_id)
    ordered = found.orderBy("source_path", "ord", "chunk_id")
    return ordered.limit(limit) if limit is not None else ordered


def by_path(chunks: DataFrame, path: str) -> DataFrame:
    """Chunks of a source."""
    return chunks.where(F.col("source_path") == path)


def by_repository(chunks: DataFrame, repository: str) -> DataFrame:
    """Chunks of a repository, by the name in their column or either name in their metadata."""
    inside = [F.get_json_object("metadata", f"$.{k}") == repository for k in ("repository", "repository_name")]
    return chunks.where(F.coalesce(F.col("repository_name") == repository, F.lit(False)) | F.coalesce(inside[0], F.lit(False)) | F.coalesce(inside[1], F.lit(False)))


def by_id(chunks: DataFrame, chunk_id: str) -> DataFrame:
    """The chunk with an id."""
    return chunks.where(F.col("chunk_id") == chunk_id)


def source_chunks(chunks: DataFrame, path: str) -> DataFrame:
    """A source's chunks in order."""
    return by_path(chunks, path).orderBy("ord", "chunk_id")


def find(chunks: DataFrame, targets: DataFrame) -> DataFrame:
    """One chunk for each target: the one with its chunk_id, else the first of the source with its source_id.

    ``targets`` has target_id and the nullable columns chunk_id and source_id;
    a source_id is a source's path, or failing that a source_id in the metadata.
    """
    body = [c for c in chunks.columns]
    exact = targets.where(F.col("chunk_id").isNotNull()).select("target_id", "chunk_id").join(chunks, "chunk_id").select("target_id", F.lit(0).alias("_how"), *body)
    asked = targets.where(F.col("source_id").isNotNull()).select("target_id", F.col("source_id").alias("_s"))
    path = asked.join(chunks, F.col("_s") == F.col("source_path")).select("target_id", F.lit(1).alias("_how"), *body)
    inner = F.get_json_object("metadata", "$.source_id")
    meta = asked.join(chunks.withColumn("_inner", inner), F.col("_s") == F.col("_inner")).select("target_id", F.lit(2).alias("_how"), *body)
    first = Window.partitionBy("target_id").orderBy("_how", "ord", "chunk_id")
    every = exact.unionByName(path).unionByName(meta)
    return every.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r", "_how")


def neighbours(chunks: DataFrame, targets: DataFrame, previous: int = 1, following: int = 1) -> DataFrame:
    """target_id and the chunks of the same source within so many places before and after the target, itself included.

    A target without a source or a place is returned alone.
    """
    placed = targets.select("target_id", F.col("chunk_id").alias("_id"), F.col("knowledge_id").alias("_k"), F.col("source_path").alias("_path"), F.col("ord").alias("_ord"))
    near = chunks.join(
        placed, F.col("source_path").eqNullSafe(F.col("_path")) & F.col("knowledge_id").eqNullSafe(F.col("_k"))
        & ((F.col("chunk_id") == F.col("_id")) | (F.col("_path").isNotNull() & F.col("ord").between(F.col("_ord") - previous, F.col("_ord") + following))),
    )
    return near.select("target_id", *chunks.columns)


def same_section(chunks: DataFrame, targets: DataFrame) -> DataFrame:
    """target_id and the chunks of the same source and section; a target without a section is returned alone."""
    section = F.get_json_object("metadata", "$.section")
    aims = targets.select("target_id", F.col("chunk_id").alias("_id"), F.col("knowledge_id").alias("_k"), F.col("source_path").alias("_path"), section.alias("_section"))
    rows = chunks.withColumn("_own", section)
    on = (F.col("knowledge_id").eqNullSafe(F.col("_k"))) & (F.col("source_path") == F.col("_path")) & ((F.col("chunk_id") == F.col("_id")) | (F.col("_own") == F.col("_section")))
    return rows.join(aims, on).select("target_id", *chunks.columns)


def parent(chunks: DataFrame, targets: DataFrame) -> DataFrame:
    """target_id and the chunk of the symbol around the target's: its parent_symbol in the metadata, else its symbol up to the last dot."""
    around = F.coalesce(F.get_json_object("metadata", "$.parent_symbol"), F.nullif(F.regexp_extract("symbol", r"^(.*)\.[^.]*$", 1), F.lit("")))
    aims = targets.select("target_id", F.col("knowledge_id").alias("_k"), F.col("source_path").alias("_path"), around.alias("_around")).where("_around is not null")
    met = chunks.join(aims, (F.col("source_path") == F.col("_path")) & (F.col("symbol") == F.col("_around")) & F.col("knowledge_id").eqNullSafe(F.col("_k")))
    first = Window.partitionBy("target_id").orderBy("ord", "chunk_id")
    return met.withColumn("_r", F.row_number().over(first)).where("_r = 1").select("target_id", *chunks.columns)
