"""Keeping an index up to date while sources change."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from sondera.operators import index as ix
from sondera.operators.words import WordStore
from sondera.session import settle


def index_stream(chunks: DataFrame, snapshots: ix.Snapshots, checkpoint: str, once: bool = True, every: str = "10 seconds", words: WordStore | None = None) -> StreamingQuery:
    """Replace the files that a stream of chunks brings, one micro-batch after another, and their postings in ``words`` if given.

    Only the buckets of these files are written. A batch that is run again
    after a failure finds its number in the manifest and changes nothing.
    """

    def upsert(batch: DataFrame, number: int) -> None:
        fresh = settle(ix.newest_chunks(batch))
        name = f"{checkpoint}#{number}"
        if words is not None:
            words.add(fresh, batch=name)
        snapshots.replace(fresh, batch=name)

    writer = chunks.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def watch(spark: SparkSession, reindex: Callable[[], object], checkpoint: str, every: str = "10 seconds") -> StreamingQuery:
    """Run ``reindex`` at intervals until the query is stopped.

    Files that are edited or deleted are no new files to a file stream, so
    sources are listed anew; a run that takes longer delays the next, none
    overlap and none is lost.
    """
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(lambda batch, number: reindex() and None).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
