"""A mixture of sources in target shares, measured in tokens.

Documents are ordered by a random number hashed from their identity; the order
is cut into ranges over all executors, token counts are summed within ranges,
and the sums of earlier ranges are added: exact prefix sums without gathering
a source anywhere. Each source is used in whole rounds and then up to the
place in the order at which its budget is reached.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sondera.llm.columns import spread
from sondera.session import settle

#: Where the vocabulary files of public tokenizers lie, unless told otherwise.
TOKENIZERS = "/opt/tokenizers"

#: Fixed value: how this vocabulary's tokenizer cuts a text before it is encoded.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_encoders: dict[str, object] = {}


def encoder(vocabulary: str):
    """The byte-level tokenizer of a vocabulary file of ranks; loaded once in a process."""
    if vocabulary not in _encoders:
        import tiktoken

        lines = Path(vocabulary).read_bytes().splitlines()
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line)}
        _encoders[vocabulary] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[vocabulary]


def clean_source(source: Column) -> Column:
    """The plain form of a source's name: trimmed, lower case, words joined by one underscore; null if nothing is left."""
    plain = F.regexp_replace(F.lower(F.trim(source)), r"[\s\-_.]+", "_")
    return F.nullif(F.regexp_replace(plain, "^_+|_+$", ""), F.lit(""))


def sized(documents: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, source (plain form), tokens, and the random number that orders documents."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(vocabulary).encode_ordinary
        for batch in batches:
            yield batch.drop(columns="text").assign(tokens=[len(encode(t)) if t else 0 for t in batch["text"]])

    order = F.xxhash64(F.lit("mixture"), F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")))
    rows = spread(documents.select("doc_id", "source", "text"), "doc_id").select("doc_id", clean_source(F.col("source")).alias("source"), order.alias("place"), F.coalesce("text", F.lit("")).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInPandas(count, f"doc_id {kind}, source string, place long, tokens long")


def plan_mixture(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, vocabulary: str | None = None) -> tuple[DataFrame, DataFrame]:
    """How often each document is used, and the shares reached.

    First frame: doc_id, source, tokens, copies (0 if it isn't used), one row
    for each document of a source with a target. Second: source, target_share,
    max_repeats, documents, available_tokens, budget_tokens, used_tokens,
    actual_share, most_copies, one row for each target.

    ``total_tokens`` is the size of the mixture; by default the greatest at
    which every source that has documents can reach its share, so that what
    ``max_repeats`` can't fill is never made up by others. Of a source that has
    no documents the share is divided among the rest in their proportion. With
    a larger total a source stops at max_repeats rounds. A budget is met up to
    half of the document at which it is reached.

    Documents without a source, of a source without a target, or without a
    text are not used. Of targets listed twice the larger share and the
    smaller number of repeats hold; a share or number of repeats that is
    missing or below 0 counts as 0. Repeated documents count each.
    """
    vocabulary = vocabulary or f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
    wanted = targets.where(F.col("source").isNotNull()).groupBy(clean_source(F.col("source")).alias("source")).agg(
        F.greatest(F.coalesce(F.max("target_share"), F.lit(0.0)), F.lit(0.0)).alias("target_share"),
        F.greatest(F.coalesce(F.min("max_repeats"), F.lit(0)), F.lit(0)).alias("max_repeats"),
    )
    # counted once: ranges are cut from a sample of what is ordered, which else would be counted twice
    counted = settle(sized(documents, vocabulary))
    ordered = counted.join(wanted.select("source"), "source").where("tokens > 0")
    ordered = ordered.repartitionByRange("source", "place", "doc_id").sortWithinPartitions("source", "place", "doc_id")
    ordered = settle(ordered.withColumn("part", F.spark_partition_id()))

    # a few rows: one for each range and source in it
    parts = ordered.groupBy("source", "part").agg(F.sum("tokens").alias("part_tokens"), F.count("*").alias("part_documents"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("source", "part", F.coalesce(F.sum("part_tokens").over(before), F.lit(0)).alias("offset"))
    have = parts.groupBy("source").agg(F.sum("part_tokens").alias("available_tokens"), F.sum("part_documents").alias("documents"))
    table = wanted.join(have, "source", "left").fillna(0, ["available_tokens", "documents"])
    usable = (F.col("available_tokens") > 0) & (F.col("max_repeats") > 0) & (F.col("target_share") > 0)
    sums = table.agg(
        F.coalesce(F.sum(F.when(usable, F.col("target_share"))), F.lit(0.0)).alias("shares"),
        F.coalesce(F.min(F.when(usable, F.col("available_tokens") * F.col("max_repeats") / F.col("target_share"))), F.lit(0.0)).alias("least"),
    ).first()
    for_one = (total_tokens / sums["shares"] if sums["shares"] else 0.0) if total_tokens is not None else sums["least"]
    wish = F.when(usable, F.least(F.col("target_share") * F.lit(float(for_one)), (F.col("available_tokens") * F.col("max_repeats")).cast("double"))).otherwise(0.0)
    budgets = table.withColumn("budget_tokens", F.floor(wish + 1e-6))
    rounds = F.when(F.col("available_tokens") > 0, F.floor(F.col("budget_tokens") / F.col("available_tokens"))).otherwise(0)
    budgets = budgets.withColumn("rounds", rounds.cast("int")).withColumn("rest", F.col("budget_tokens") - F.col("rounds") * F.col("available_tokens"))

    def running(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        carried: dict[tuple[int, str], int] = {}
        for batch in batches:
            keys = list(zip(batch["part"], batch["source"]))
            inside = batch.groupby(["part", "source"], sort=False)["tokens"].cumsum() - batch["tokens"]
            yield batch.assign(inside=inside + [carried.get(k, 0) for k in keys])
            for k, tokens in batch.groupby(["part", "source"], sort=False)["tokens"].sum().items():
                carried[k] = carried.get(k, 0) + int(tokens)

    kind = dict(ordered.dtypes)["doc_id"]
    # rows lie in their ranges in order, as written; sorting again within the range only makes sure of it
    sums_inside = ordered.sortWithinPartitions("part", "source", "place", "doc_id").mapInPandas(
        running, f"source string, doc_id {kind}, place long, tokens long, part int, inside long"
    )
    placed = sums_inside.join(offsets, ["source", "part"]).join(budgets.select("source", "rounds", "rest"), "source")
    extra = (F.col("offset") + F.col("inside") + F.col("tokens") / 2 <= F.col("rest")).cast("int")
    copies = placed.select("doc_id", "source", "tokens", (F.col("rounds") + extra).cast("int").alias("copies"))
    used = copies.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("used_tokens"), F.max("copies").alias("most_copies"))
    report = budgets.join(used, "source", "left").fillna(0, ["used_tokens", "most_copies"])
    # one row for each target: few, so one task may hold them all
    report = report.withColumn("_used", F.sum("used_tokens").over(Window.partitionBy(F.lit(1)))).select(
        "source", "target_share", "max_repeats", "documents", "available_tokens", "budget_tokens", "used_tokens",
        F.when(F.col("_used") > 0, F.col("used_tokens") / F.col("_used")).otherwise(0.0).alias("actual_share"), "most_copies",
    )
    return copies, report
