"""What version control knows about sources: once for each repository, on the driver, never fatal."""

from __future__ import annotations

import hashlib
import logging
import subprocess
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondera.functions import citations as ct

_LOG = logging.getLogger(__name__)


def _git(folder: str | Path, *args: str, timeout: int = 30, said: bool = False) -> str | None:
    """What git prints, None if it fails or (unless ``said``) prints nothing."""
    try:
        done = subprocess.run(["git", "-C", str(folder), *args], capture_output=True, text=True, timeout=timeout, check=False)
    except (OSError, subprocess.SubprocessError):
        return None
    return (done.stdout.strip() or ("" if said else None)) if done.returncode == 0 else None


def commit(folder: str | Path) -> str | None:
    """The commit checked out in a folder."""
    return _git(folder, "rev-parse", "HEAD")


def tracked(folder: str | Path) -> dict[str, str]:
    """The path in its repository of each file below a folder that version control knows, by its full path."""
    top, names = _git(folder, "rev-parse", "--show-toplevel"), _git(folder, "ls-files", "--full-name", "-z", timeout=600)
    return {str(Path(top) / n): n for n in names.split("\0") if n} if top and names else {}


def remote(folder: str | Path) -> str | None:
    """The address of a repository's origin."""
    return _git(folder, "config", "--get", "remote.origin.url")


def remote_folder(cache: str | Path, url: str) -> Path:
    """Where a remote repository is kept."""
    return Path(cache) / "remotes" / hashlib.sha256(url.encode()).hexdigest()[:16]


def clone_or_update(url: str, folder: str | Path, ref: str | None = None, timeout: int = 600) -> Path:
    """A local copy of a remote repository, brought up to date, at a ref if one is named."""
    folder = Path(folder)
    if (folder / ".git").exists():
        if _git(folder, "fetch", "--all", "--tags", "--verbose", timeout=timeout, said=True) is None:
            _LOG.warning("%s can't be brought up to date; what was fetched before is used", url)
    else:
        folder.parent.mkdir(parents=True, exist_ok=True)
        subprocess.run(["git", "clone", "--", url, str(folder)], check=True, capture_output=True, timeout=timeout)
    if ref:
        subprocess.run(["git", "-C", str(folder), "checkout", "--detach", ref], check=True, capture_output=True, timeout=timeout)
    else:
        _git(folder, "pull", "--ff-only", timeout=timeout)
    return folder


def repositories(spark: SparkSession, roots: Iterable[str]) -> DataFrame:
    """root, repository_name, git_commit, remote_url of each root; one row for each, so that joins send it to all tasks."""
    rows = [(r, Path(r).name, commit(r), remote(r)) for r in dict.fromkeys(roots)]
    return spark.createDataFrame(rows, "root string, repository_name string, git_commit string, remote_url string")


def paths(spark: SparkSession, roots: Iterable[str]) -> DataFrame:
    """file_key, git_path of the files that version control knows: one listing for each root, shared out as rows."""
    rows = sorted({(k, v) for r in dict.fromkeys(roots) for k, v in tracked(r).items()})
    return spark.createDataFrame(rows, "file_key string, git_path string")


def enrich(chunks: DataFrame, repos: DataFrame, root: str = "root", known: DataFrame | None = None) -> DataFrame:
    """Chunks with repository_name, git_commit, repository_url, git_path and citation_url of their root; ``known`` has file_key and git_path."""
    dim = repos.select(F.col("root").alias(root), F.col("repository_name").alias("_name"), "git_commit", ct.public_remote(F.col("remote_url")).alias("repository_url"))
    joined = chunks.join(dim, root, "left").withColumn("repository_name", F.coalesce("_name", "repository_name")).drop("_name")
    joined = joined.join(known, "file_key", "left") if known is not None else joined.withColumn("git_path", F.lit(None).cast("string"))
    where = F.coalesce("git_path", "source_path")
    return joined.withColumn("citation_url", ct.citation_url(F.col("repository_url"), F.col("git_commit"), where, F.col("start_line"), F.col("end_line")))
