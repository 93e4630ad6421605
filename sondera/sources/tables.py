"""Chunks from tables and from older formats, evaluation sets from files."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sondera import schema as sc
from sondera.functions import text as tx
from sondera.operators.index import Snapshots


def scan(chunks: DataFrame, knowledge_id: str | None = None, ordered: bool = False) -> DataFrame:
    """The chunks, of one instance if it is named (a partition filter), in source order if asked."""
    rows = chunks.where(F.col("knowledge_id") == knowledge_id) if knowledge_id is not None else chunks
    return rows.orderBy("source_path", "ord", "chunk_id") if ordered else rows


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Chunks from files of JSON lines; of a source in several files the last file's count."""
    rows = spark.read.schema(sc.CHUNKS).json(path).withColumn("_file", F.input_file_name())
    last = Window.partitionBy("source_path").orderBy(F.desc("_file"))
    return rows.withColumn("_r", F.dense_rank().over(last)).where("_r = 1").drop("_r", "_file")


def import_jsonl(spark: SparkSession, path: str, store: Snapshots) -> bool:
    """Fill a store from files of JSON lines, only if it is empty; whether it was."""
    now = store.read()
    if now is not None and not now.isEmpty():
        return False
    store.write(read_jsonl(spark, path))
    return True


def documents_as_chunks(documents: DataFrame, knowledge_id: str = "documents") -> DataFrame:
    """One chunk for each document, with all its lines."""
    source = F.concat(F.coalesce("source", F.lit("unknown")), F.lit("/"), F.col("doc_id").cast("string"))
    base = documents.select(
        F.lit(knowledge_id).alias("knowledge_id"), source.alias("file_key"), source.alias("source_path"), F.lit("text").alias("kind"), F.lit(None).cast("string").alias("symbol"),
        F.lit(1).alias("start_line"), F.greatest(F.lit(1), F.size(tx.lines("text"))).alias("end_line"), F.lit(0).alias("ord"), "text",
        F.to_json(F.struct(F.col("lang").alias("language"), source.alias("path"))).alias("metadata"), F.col("updated_at").alias("indexed_at"), F.lit("documents").alias("source_type"),
        "document_type", F.col("lang").alias("language"), "repository_name", F.lit(None).cast("string").alias("xml_path"),
    )
    made = base.withColumn("chunk_id", sc.chunk_id()).withColumn("content_hash", sc.content_hash())
    return made.select(*[f.name for f in sc.CHUNKS.fields])


def markdown_sections(rows: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, start_line, end_line, heading, text of each section: a line that begins with # and what follows up to the next.

    Text before the first is left out; a text without any is one section
    without a heading. All in expressions over the row: nothing is exchanged.
    """
    lines = tx.lines(text)
    base = rows.select(key, F.coalesce(F.col(text), F.lit("")).alias("_text"), lines.alias("_lines"))
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size("_lines"), F.lit(1))), lambda i: F.startswith(F.coalesce(F.get("_lines", i - 1), F.lit("")), F.lit("#")))
    base = base.withColumn("_starts", starts)
    spans: Column = F.transform(
        "_starts", lambda s, n: F.struct(s.alias("a"), F.coalesce(F.get("_starts", n + 1) - 1, F.size("_lines")).alias("b"))
    )
    found = base.select(key, "_lines", F.explode(spans).alias("_s"))
    sections = found.select(
        key, F.col("_s.a").alias("start_line"), F.col("_s.b").alias("end_line"), tx.heading_text(F.get("_lines", F.col("_s.a") - 1)).alias("heading"),
        F.array_join(F.slice("_lines", F.col("_s.a"), F.col("_s.b") - F.col("_s.a") + 1), "\n").alias("text"),
    )
    none = base.where(F.size("_starts") == 0).select(key, F.lit(1).alias("start_line"), F.greatest(F.lit(1), F.size("_lines")).alias("end_line"), F.lit(None).cast("string").alias("heading"), F.col("_text").alias("text"))
    return sections.unionByName(none)


def parsed_texts(rows: DataFrame, key: str, text: str, parse) -> DataFrame:
    """key, ord, kind, symbol, start_line, end_line, text: what ``parse`` makes of texts that are rows; of a text that fails one row of the kind ``error`` that says why."""
    kind = dict(rows.dtypes)[key]
    names = [key, "ord", "kind", "symbol", "start_line", "end_line", "text"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, t in zip(batch[key], batch["_text"]):
                try:
                    out += [(k, i, c.get("kind"), c.get("symbol"), c["start_line"], c["end_line"], c["text"]) for i, c in enumerate(parse(t or ""))]
                except (SyntaxError, ValueError, RecursionError) as e:
                    out.append((k, 0, "error", None, None, None, f"{type(e).__name__}: {e}"))
            made = pd.DataFrame(out, columns=names)
            yield made.astype({"start_line": "Int32", "end_line": "Int32"})

    return rows.select(key, F.col(text).alias("_text")).mapInPandas(run, f"`{key}` {kind}, ord int, kind string, symbol string, start_line int, end_line int, text string")


def read_evaluation(spark: SparkSession, path: str) -> DataFrame:
    """query_id, query, expected from a YAML file of queries; one expected value may stand without a list."""
    import yaml

    data = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
    cases = data.get("queries") or data.get("cases") or [] if isinstance(data, dict) else data
    rows = [(i, str(c["query"]), [c["expected"]] if isinstance(c.get("expected"), str) else [str(x) for x in c.get("expected") or []]) for i, c in enumerate(cases, 1)]
    return spark.createDataFrame(rows, sc.QUERIES)
