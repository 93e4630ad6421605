"""Files of source trees: found on the driver, read and digested by the executors.

Spark's own listing hides names that begin with a dot or an underscore, which
source trees are full of; so paths are listed here and shared out as rows.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterable, Iterator
from pathlib import Path
from typing import TYPE_CHECKING

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

if TYPE_CHECKING:
    from sondera.config import Parsing

#: Folders and types that are no sources.
IGNORED_DIRS = frozenset(".git .hg .svn .venv venv node_modules __pycache__ .mypy_cache .pytest_cache .ruff_cache .tox dist build .idea .vscode target".split())
IGNORED_TYPES = frozenset(".pyc .pyo .so .o .a .dll .exe .class .jar .zip .gz .tar .png .jpg .jpeg .gif .ico .woff .woff2".split())


def discover(root: str | os.PathLike, ignored_dirs: Iterable[str] = IGNORED_DIRS, ignored_types: Iterable[str] = IGNORED_TYPES, follow_links: bool = False) -> list[str]:
    """The files below a root (or the root, if it is a file), resolved and sorted.

    Folders are left out by name, files by type (case matters); links are
    followed only if asked.
    """
    base = Path(root)
    dirs, types = set(ignored_dirs), set(ignored_types)
    if base.is_file():
        return [str(base.resolve())]
    found: set[str] = set()
    for folder, below, names in os.walk(base, followlinks=follow_links):
        below[:] = [d for d in below if d not in dirs and (follow_links or not os.path.islink(os.path.join(folder, d)))]
        for name in names:
            path = Path(folder, name)
            if path.suffix not in types and (follow_links or not path.is_symlink()) and path.is_file():
                found.add(str(path.resolve()))
    return sorted(found)


def listed(spark: SparkSession, roots: Iterable[tuple[str, str]], **rules) -> DataFrame:
    """knowledge_id, root, path of the files below (knowledge_id, root); of roots that share a file the last counts."""
    owner: dict[str, tuple[str, str]] = {}
    for kid, root in roots:
        base = str(Path(root).resolve().parent if Path(root).is_file() else Path(root).resolve())
        for path in discover(root, **rules):
            owner[path] = (kid, base)
    rows = [(kid, base, path) for path, (kid, base) in sorted(owner.items())]
    many = max(1, min(len(rows) // 64 + 1, 4 * spark.sparkContext.defaultParallelism))
    return spark.createDataFrame(rows, "knowledge_id string, root string, path string").repartition(many, "path")


def _digest(path: str) -> tuple[float | None, int | None, str | None]:
    try:
        stat, sha = os.stat(path), hashlib.sha256()
        with open(path, "rb") as f:
            while block := f.read(1 << 20):
                sha.update(block)
        return stat.st_mtime, stat.st_size, sha.hexdigest()
    except OSError:
        return None, None, None


def fingerprints(files: DataFrame) -> DataFrame:
    """File records with time, size and digest; files that can't be read are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [_digest(p) for p in batch["path"]]
            out = batch[["knowledge_id", "path"]].assign(mtime=[m for m, _, _ in made], size=[s for _, s, _ in made], sha256=[h for _, _, h in made], git_commit=None)
            yield out[out["sha256"].notna()]

    return files.mapInPandas(run, "knowledge_id string, path string, mtime double, size long, sha256 string, git_commit string")


def read_text(path: str) -> str:
    """A file's text: UTF-8, what isn't is marked, line ends are line feeds."""
    return Path(path).read_bytes().decode("utf-8", "replace").replace("\r\n", "\n").replace("\r", "\n")


def parsed(files: DataFrame, options: Parsing | None = None) -> DataFrame:
    """Chunks of the files, one stage: the chunk columns and ``error`` for a file that failed (then with a path only)."""
    from sondera.sources.parsers import CHUNK_FIELDS, parse_file

    names = ["knowledge_id", "file_key", *CHUNK_FIELDS, "error"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for kid, root, path in zip(batch["knowledge_id"], batch["root"], batch["path"]):
                try:
                    rows += [(kid, path, *[c.get(f) for f in CHUNK_FIELDS], None) for c in parse_file(path, root, options)]
                except Exception as e:  # noqa: BLE001 - a file that fails is reported and tried again next time
                    rows.append((kid, path, *[None] * len(CHUNK_FIELDS), f"{type(e).__name__}: {e}"[:200]))
            out = pd.DataFrame(rows, columns=names)
            for c in ("start_line", "end_line", "ord"):
                out[c] = out[c].astype("Int32")
            yield out

    return files.mapInPandas(
        run,
        "knowledge_id string, file_key string, source_path string, kind string, symbol string, start_line int, end_line int, ord int, text string, "
        "metadata string, source_type string, document_type string, language string, xml_path string, error string",
    )
