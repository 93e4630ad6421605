"""Shapes of the engine's tables and the identities of chunks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _I, _L, _D = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


CHUNKS = _struct(
    knowledge_id=_S, file_key=_S, source_path=_S, kind=_S, symbol=_S, start_line=_I, end_line=_I, ord=_I, text=_S, metadata=_S,
    chunk_id=_S, content_hash=_S, indexed_at=T.TimestampType(), source_type=_S, document_type=_S, language=_S, repository_name=_S, xml_path=_S,
)
VECTORS = _struct(knowledge_id=_S, chunk_id=_S, source_path=_S, vector=T.ArrayType(T.FloatType()), norm=_D, content_hash=_S)
FILE_STATE = _struct(knowledge_id=_S, path=_S, mtime=_D, size=_L, sha256=_S, git_commit=_S)
QUERIES = _struct(query_id=_L, query=_S, expected=T.ArrayType(_S))

#: Metadata keys that are columns of their own, so that filters reach the scan.
PROMOTED = ("source_type", "document_type", "language", "repository_name")


def chunk_id(knowledge_id="knowledge_id", path="source_path", kind="kind", symbol="symbol", start="start_line", end="end_line", order="ord") -> Column:
    """The identity of a chunk: what it is and where it stands, not what it says."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    parts = [part(c) for c in (knowledge_id, path, kind, symbol, start, end, order)]
    return F.concat(part(knowledge_id), F.lit("_chk_"), F.left(F.sha2(F.concat_ws("\u0000", *parts), 256), F.lit(32)))


def content_hash(text="text") -> Column:
    """The digest of a chunk's text."""
    return F.sha2(F.coalesce(F.col(text), F.lit("")), 256)


def promoted(metadata="metadata") -> dict[str, Column]:
    """The promoted columns, read from canonical JSON; values that aren't scalars are null."""
    out = {}
    for key in PROMOTED:
        raw = F.get_json_object(F.col(metadata), f"$.{key}")
        out[key] = F.when(~raw.rlike(r"^\s*[\[{]"), raw)
    return out
