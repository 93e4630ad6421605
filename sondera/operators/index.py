"""Keeping an index: what changed, which rows replace which, snapshots on disk."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sondera.operators.latest import latest
from sondera.session import settle

FINGERPRINT = ("mtime", "size", "sha256")


def newest_state(state: DataFrame) -> DataFrame:
    """One record for each instance and path: of repeated ones the latest."""
    keyed = state.withColumn("_key", F.concat_ws("\u0000", F.coalesce("knowledge_id", F.lit("")), "path")).where(F.col("path").isNotNull())
    return latest(keyed, "_key", "mtime", ["knowledge_id", "path", "mtime", "size", "sha256", "git_commit"]).drop("_key")


def classify(current: DataFrame, stored: DataFrame) -> DataFrame:
    """knowledge_id, path, status: new, unchanged, changed or deleted. A file is unchanged only if time, size and digest are."""
    on = ["knowledge_id", "path"]
    now = newest_state(current).select(*on, F.struct(*FINGERPRINT).alias("_now"))
    then = newest_state(stored).select(*on, F.struct(*FINGERPRINT).alias("_then"))
    status = F.when(F.col("_then").isNull(), "new").when(F.col("_now").isNull(), "deleted").when(F.col("_now").eqNullSafe(F.col("_then")), "unchanged").otherwise("changed")
    return now.join(then, on, "full_outer").select(*on, status.alias("status"))


def report(classified: DataFrame) -> DataFrame:
    """One row: how many files are new, unchanged, changed, deleted."""
    return classified.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("new", "unchanged", "changed", "deleted")])


def replace_files(chunks: DataFrame, fresh: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """The table with the chunks of some files replaced: by those of ``fresh``, and of ``files`` (file_key) that have none now.

    Old rows whose chunk_id comes again go too, whatever their file.
    """
    touched = fresh.select("file_key").distinct() if files is None else fresh.select("file_key").unionByName(files.select("file_key")).distinct()
    kept = chunks.join(touched, "file_key", "left_anti").join(fresh.select("chunk_id").distinct(), "chunk_id", "left_anti")
    return kept.select(*chunks.columns).unionByName(fresh.select(*chunks.columns))


def delete_files(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """The table without the chunks of the files named by ``file_key``."""
    return chunks.join(files.select("file_key").distinct(), "file_key", "left_anti").select(*chunks.columns)


def file_paths(chunks: DataFrame) -> DataFrame:
    """knowledge_id, file_key, path: all the paths a file is known by."""
    names = F.array_distinct(F.array_compact(F.array("source_path", *[F.get_json_object("metadata", f"$.{k}") for k in ("path", "source_path", "git_path")])))
    return chunks.select("knowledge_id", "file_key", F.explode(names).alias("path")).distinct()


def prune_unknown(chunks: DataFrame, allowed: DataFrame, knowledge_id: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The table without files none of whose paths is in ``allowed`` (path), and the files that went (knowledge_id, file_key).

    With a ``knowledge_id`` only that instance's files are looked at.
    """
    mine = chunks.where(F.col("knowledge_id") == knowledge_id) if knowledge_id is not None else chunks
    known = file_paths(mine).join(allowed.select("path").distinct(), "path", "left_semi").select("knowledge_id", "file_key").distinct()
    gone = mine.select("knowledge_id", "file_key").distinct().join(known, ["knowledge_id", "file_key"], "left_anti")
    return chunks.join(gone, ["knowledge_id", "file_key"], "left_anti").select(*chunks.columns), gone


def newest_chunks(chunks: DataFrame, *columns: Column | str) -> DataFrame:
    """The latest version of each chunk: all its columns, or its id with those named.

    What is wanted of a text should be named as an expression of it: it is
    computed in the scan then, and no text is exchanged.
    """
    if not columns:
        rest = [c for c in chunks.columns if c != "chunk_id"]
        return latest(chunks, "chunk_id", "indexed_at", rest, "content_hash").select(*chunks.columns)
    small = chunks.select(F.col("chunk_id"), F.col("indexed_at").alias("_at"), F.col("content_hash").alias("_hash"), *[c for c in columns if not isinstance(c, str) or c != "chunk_id"])
    names = [c for c in small.columns if c not in ("chunk_id", "_at", "_hash")]
    return latest(small, "chunk_id", "_at", names, "_hash") if names else small.where(F.col("chunk_id").isNotNull()).select("chunk_id").distinct()


def counts(chunks: DataFrame) -> DataFrame:
    """knowledge_id, chunks, sources, files of each instance."""
    return chunks.groupBy("knowledge_id").agg(
        F.countDistinct("chunk_id").alias("chunks"), F.countDistinct("source_path").alias("sources"), F.countDistinct("file_key").alias("files")
    )


#: Kinds of files that are noise in an index, with their types and folders.
NOISE = {
    "binary/data": (".h5 .fits .npy .npz .pkl .bin".split(), []),
    "archives": (".zip .tar .gz .tgz .whl".split(), []),
    "logs/cache/build": ([".cache"], ["htmlcov", "_build", ".ipynb_checkpoints"]),
    "logs": ([".log"], []),
    "images/media": (".png .jpg .jpeg .gif .webp .mp4 .mov .avi".split(), []),
}


def noisy_files(files: DataFrame, ignored_types: tuple[str, ...] = (), ignored_folders: tuple[str, ...] = ()) -> DataFrame:
    """category, files, bytes, folders, samples: what kinds of files and folders would be noise in an index.

    ``files`` has path and size. Types and folders that are ignored already
    are no noise; samples are three names at most.
    """
    name = F.substring_index("path", "/", -1)
    kind = F.regexp_extract(name, r"[^.](\.[^.]+)$", 1)
    above = F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1)
    rows = []
    for category, (types, folders) in NOISE.items():
        wanted, places = [t for t in types if t not in ignored_types], [f for f in folders if f not in ignored_folders]
        if wanted:
            rows.append(F.when(kind.isin(*wanted), F.struct(F.lit(category).alias("category"), F.lit(None).cast("string").alias("folder"), name.alias("name"), F.col("size").cast("long").alias("size"))))
        for place in places:
            at = F.array_position(above, place)
            rows.append(F.when(at > 0, F.struct(F.lit(category).alias("category"), F.array_join(F.slice(above, F.lit(1), at.cast("int")), "/").alias("folder"), F.lit(place).alias("name"), F.lit(None).cast("long").alias("size"))))
    marked = files.select(F.inline(F.array_compact(F.array(*rows))))
    sums = marked.groupBy("category").agg(F.count("size").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.countDistinct("folder").alias("folders"))
    # three names of each category leave each task, however many files it has
    first = Window.partitionBy("category").orderBy("name")
    few = marked.select("category", "name").distinct().withColumn("_r", F.row_number().over(first)).where("_r <= 3").groupBy("category").agg(F.array_join(F.sort_array(F.collect_list("name")), ", ").alias("samples"))
    return sums.join(few, "category")


class Conflict(RuntimeError):
    """Another writer was first."""


@dataclass
class Snapshots:
    """Versions of a table in a folder, in buckets of which a write replaces only those it touches.

    Data is written beside the old and never changed. A version is a numbered
    manifest (``manifest-00000007.json``) of the folders of its buckets, put
    in place by one rename that fails if the number is taken: readers see the
    old version or the new one, and of two writers that began from the same
    version one gets a ``Conflict``. Writing the same ``batch`` again gives the
    version it gave before, so a repeated micro-batch does nothing. The last
    ``keep`` versions stay readable, older data is dropped.
    """

    spark: SparkSession
    folder: str
    key: str = "file_key"
    buckets: int = 64
    keep: int = 3

    def _path(self, name: str):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self) -> list[str]:
        path, fs = self._path("")
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def _manifest(self, name: str) -> dict:
        path, fs = self._path(name)
        stream = fs.open(path)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def pointer(self) -> dict:
        """generation, batch, columns and the folders of the buckets of what readers see; generation 0 without a version."""
        names = [n for n in self._names() if n.startswith("manifest-")]
        return self._manifest(names[-1]) if names else {"generation": 0, "batch": None, "parts": {}, "note": None}

    def read(self, schema=None, buckets: list[int] | None = None, at: dict | None = None) -> DataFrame | None:
        """The current version, or some of its buckets; None, or an empty frame of ``schema``, if there is none."""
        now = at or self.pointer()
        if not now["generation"]:
            return None if schema is None else self.spark.createDataFrame([], schema)
        wanted = sorted({f for b, f in now["parts"].items() if buckets is None or int(b) in set(buckets)})
        kind = StructType.fromJson(now["schema"])
        if not wanted:
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).parquet(*[f"{self.folder}/{f}" for f in wanted])

    def bucket(self) -> Column:
        """The bucket of a row."""
        return F.pmod(F.xxhash64(F.coalesce(F.col(self.key).cast("string"), F.lit(""))), F.lit(self.buckets)).cast("int")

    def write(self, df: DataFrame, batch: str | None = None, note: object = None) -> int:
        """Write the whole table anew; returns its generation."""
        now = self.pointer()
        if batch is not None and now["batch"] == batch:
            return now["generation"]
        return self._commit(now, df, range(self.buckets), batch, note)

    def replace(self, fresh: DataFrame, files: DataFrame | None = None, batch: str | None = None, note: object = None, by: str = "chunk_id") -> int:
        """Replace the rows of some files by those of ``fresh``, as ``replace_files`` does, writing only the buckets they are in.

        Rows in other buckets whose ``by`` comes again go too: they are looked
        for by that column alone.
        """
        now = self.pointer()
        if batch is not None and now["batch"] == batch:
            return now["generation"]
        if not now["generation"]:
            return self._commit(now, fresh, range(self.buckets), batch, note)
        fresh = settle(fresh)
        touched = fresh.select(self.key) if files is None else fresh.select(self.key).unionByName(files.select(self.key))
        ids = fresh.select(by).distinct()
        # at most as many numbers as there are buckets
        whose = self.read(at=now).select(self.key, by).join(ids, by, "left_semi").select(self.bucket().alias("b"))
        hit = sorted(r["b"] for r in touched.select(self.bucket().alias("b")).union(whose).distinct().collect())
        old = self.read(buckets=hit, at=now)
        kept = old.join(touched.distinct(), self.key, "left_anti").join(ids, by, "left_anti")
        return self._commit(now, kept.select(*old.columns).unionByName(fresh.select(*old.columns)), hit, batch, note)

    def _commit(self, now: dict, df: DataFrame, hit, batch: str | None, note: object) -> int:
        generation = now["generation"] + 1
        version = f"v{generation:08d}-{uuid.uuid4().hex[:8]}"
        # large buckets are divided, small ones put together
        df.withColumn("_bucket", self.bucket()).hint("rebalance", "_bucket").sortWithinPartitions("_bucket", self.key).write.partitionBy("_bucket").mode("errorifexists").parquet(f"{self.folder}/{version}")
        path, fs = self._path(version)
        made = {int(s.getPath().getName()[8:]) for s in fs.listStatus(path) if s.getPath().getName().startswith("_bucket=")}
        parts = {b: f for b, f in now["parts"].items() if int(b) not in set(hit)} | {str(b): f"{version}/_bucket={b}" for b in made}
        body = {"generation": generation, "batch": batch, "parts": parts, "schema": df.schema.jsonValue(), "note": note if note is not None else now.get("note")}
        self._publish(generation, json.dumps(body))
        self._tidy()
        return generation

    def _publish(self, generation: int, body: str) -> None:
        """Put a manifest in place, whole or not at all, unless its number is taken."""
        jvm = self.spark._jvm
        source, fs = self._path(f"next-{uuid.uuid4().hex[:8]}.json")
        out = fs.create(source, True)
        out.write(bytearray(body.encode()))
        out.close()
        target, _ = self._path(f"manifest-{generation:08d}.json")
        names = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(source.toUri(), self.spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(source), fs.makeQualified(target), names)
        except Py4JJavaError as e:
            fs.delete(source, False)
            if "FileAlreadyExistsException" in str(e.java_exception):
                raise Conflict(f"version {generation} of {self.folder} was written by another writer") from e
            raise

    def _tidy(self) -> None:
        """Drop manifests before the last ``keep``, and data that no manifest is left of which names it."""
        names = self._names()
        manifests = [n for n in names if n.startswith("manifest-")]
        for name in manifests[: -self.keep]:
            path, fs = self._path(name)
            fs.delete(path, False)
        left = [self._manifest(n) for n in manifests[-self.keep :]]
        used = {f.split("/")[0] for m in left for f in m["parts"].values()}
        oldest = left[0]["generation"]
        for name in names:
            # what is newer than the oldest version may be another writer's, not yet published
            if name.startswith("v") and name not in used and int(name[1:9]) < oldest:
                path, fs = self._path(name)
                fs.delete(path, True)

    def drop(self) -> bool:
        """Delete the folder; whether there was one."""
        path, fs = self._path("")
        return bool(fs.delete(path, True))
