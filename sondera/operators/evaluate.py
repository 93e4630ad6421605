"""How well ranked results meet what was expected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def identifiers(results: DataFrame) -> DataFrame:
    """Adds ``identifiers``: all that a result may be called by."""
    names = [F.col(c).cast("string") for c in ("chunk_id", "source_path", "source_id") if c in results.columns]
    if "metadata" in results.columns:
        names += [F.get_json_object("metadata", f"$.{k}") for k in ("path", "source_path", "git_path", "source_id")]
    return results.withColumn("identifiers", F.array_distinct(F.array_compact(F.array(*names))))


def metrics(results: DataFrame, queries: DataFrame, ks: tuple[int, ...] = (5, 10)) -> DataFrame:
    """query_id, recall_at_k for each k, mrr: one row for each query, zeros where nothing was found or expected.

    ``results`` has query_id, rank and what ``identifiers`` reads; ``queries``
    has query_id and expected (an array).
    """
    named = results if "identifiers" in results.columns else identifiers(results)
    aims = queries.select("query_id", F.array_distinct(F.coalesce("expected", F.array().cast("array<string>"))).alias("expected"))
    hits = named.select("query_id", "rank", "identifiers").join(aims, "query_id").withColumn("hit", F.array_intersect("expected", "identifiers"))
    empty = F.array().cast("array<string>")
    found = [F.array_distinct(F.flatten(F.collect_list(F.when(F.col("rank") <= k, F.col("hit")).otherwise(empty)))).alias(f"_at{k}") for k in ks]
    each = hits.groupBy("query_id").agg(*found, F.min(F.when(F.size("hit") > 0, F.col("rank"))).alias("_first"))
    joined = aims.join(each, "query_id", "left")
    recall = [F.when(F.size("expected") > 0, F.coalesce(F.size(f"_at{k}"), F.lit(0)) / F.size("expected")).otherwise(F.lit(0.0)).alias(f"recall_at_{k}") for k in ks]
    recall = [F.when(F.col(f"_at{k}").isNull(), F.lit(0.0)).otherwise(r).alias(f"recall_at_{k}") for k, r in zip(ks, recall)]
    return joined.select("query_id", *recall, F.coalesce(F.lit(1.0) / F.col("_first"), F.lit(0.0)).alias("mrr"))


def averages(per_query: DataFrame) -> DataFrame:
    """One row: the mean of each metric, zeros without queries."""
    names = [c for c in per_query.columns if c != "query_id"]
    return per_query.agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in names])
