"""One session for all tests."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from sondera.session import local_session

    session = local_session(4, "4g")
    session.sparkContext.setLogLevel("ERROR")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()


@pytest.fixture
def chunk(spark):
    """Makes chunk frames from dictionaries."""
    from datetime import datetime

    from sondera.schema import CHUNKS

    def make(*rows, extra=None):
        full = []
        for i, r in enumerate(rows):
            base = {
                "knowledge_id": "k", "file_key": f"/r/{r.get('source_path', 'a.py')}", "source_path": "a.py", "kind": "text", "symbol": None, "start_line": 1, "end_line": None, "ord": i,
                "text": "", "metadata": "{}", "chunk_id": f"c{i}", "content_hash": None, "indexed_at": datetime(2026, 1, 1), "source_type": None, "document_type": None, "language": None,
                "repository_name": None, "xml_path": None,
            }
            full.append(tuple({**base, **r}[f.name] for f in CHUNKS.fields))
        df = spark.createDataFrame(full, CHUNKS)
        for name, value in (extra or {}).items():
            from pyspark.sql import functions as F

            df = df.withColumn(name, F.lit(value))
        return df

    return make
