"""Searching and keeping a corpus: everything a caller needs, over frames of chunks, vectors and queries."""

from __future__ import annotations

import logging
import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from pathlib import Path
from typing import Any, NamedTuple, Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondera import config as cf
from sondera import providers as pv
from sondera import schema as sc
from sondera.functions import citations as ct
from sondera.functions import text as tx
from sondera.operators import dense, evaluate, fusion, index, lexical, lookup, normalize
from sondera.operators.words import WordIndex, WordStore
from sondera.session import settle
from sondera.sources import files, git

_LOG = logging.getLogger(__name__)

CORPORA = ("all", "code", "documents")


class Retriever(Protocol):
    """Ranks chunks for a batch of queries (query_id, query): query_id, rank, chunk_id, score."""

    def search(self, queries: DataFrame, limit: int, filters: Mapping[str, Any] | None = None) -> DataFrame: ...


@dataclass
class WordRetriever:
    """Ranks by phrases in weighted fields."""

    source: lexical.Source

    def search(self, queries: DataFrame, limit: int, filters: Mapping[str, Any] | None = None) -> DataFrame:
        return lexical.bm25_phrases(self.source, queries, lexical.checked_limit(limit), filters)


@dataclass
class VectorRetriever:
    """Ranks by the cosine of vectors (chunk_id, vector and the columns of filters) to that of the embedded query."""

    vectors: DataFrame
    provider: pv.EmbeddingProvider
    mode: str = "exact"

    def search(self, queries: DataFrame, limit: int, filters: Mapping[str, Any] | None = None) -> DataFrame:
        aims = pv.embed(queries.select("query_id", "query"), self.provider, "query", queries=True)
        # a model that fails does so here, not in the middle of a search
        aims = aims if isinstance(self.provider, pv.HashEmbedding) else settle(aims)
        return dense.nearest(self.vectors, aims, limit, filters, mode=self.mode)


def collect_citations(results: DataFrame) -> DataFrame:
    """chunk_id and citation of the results that have one, or a link."""
    link = F.get_json_object("metadata", "$.citation_url")
    text = F.coalesce(F.nullif(F.col("citation"), F.lit("")), F.nullif(link, F.lit("")))
    return results.select("chunk_id", text.alias("citation")).where(F.col("citation").isNotNull())


def cited(chunks: DataFrame) -> DataFrame:
    """Adds ``citation``: where each chunk is from, with a link where one is known."""
    get = lambda key: F.get_json_object("metadata", f"$.{key}")
    path = F.coalesce("source_path", get("path"))
    page = get("page")
    code = ct.code_citation(F.col("repository_name"), get("git_commit"), path, F.col("start_line"), F.col("end_line"), get("source_id"), F.col("chunk_id"))
    doc = ct.document_citation(path, page, F.coalesce(get("section"), get("heading")))
    text = F.when(ct.is_document(F.col("document_type"), F.col("source_type"), page), doc).otherwise(code)
    return chunks.withColumn("citation", ct.with_url(text, get("citation_url")))


@dataclass
class Engine:
    """A corpus of one or several instances; ``vectors`` may be missing, then search is by words alone.

    ``words`` is the corpus's stored index; without it one is made of the
    chunks for each search. ``dense`` and ``sparse`` take the place of the
    engine's own retrievers.
    """

    chunks: DataFrame
    vectors: DataFrame | None = None
    provider: pv.EmbeddingProvider | None = None
    retrieval: cf.Retrieval | None = None
    reranker: pv.Reranker | None = None
    quantization: str = "exact"
    words: WordIndex | None = None
    dense: Retriever | None = None
    sparse: Retriever | None = None
    #: Whether an embedding model or reranker that fails is done without, as searches report; else its error is raised.
    fall_back: bool = True

    def _settings(self) -> cf.Retrieval:
        return self.retrieval or cf.Retrieval()

    def queries(self, *texts: str) -> DataFrame:
        """A frame of queries from texts."""
        return self.chunks.sparkSession.createDataFrame([(i, t) for i, t in enumerate(texts, 1)], "query_id long, query string")

    def mode(self) -> str:
        """How searches run: hybrid, sparse_only (asked for) or sparse_fallback (no vectors)."""
        if self._settings().dense_candidates == 0:
            return "sparse_only"
        return "hybrid" if self.dense or (self.vectors is not None and self.provider is not None) else "sparse_fallback"

    def by_words(self) -> Retriever:
        """The retriever by words."""
        return self.sparse or WordRetriever(self.words if self.words is not None else self.chunks)

    def by_vectors(self) -> Retriever:
        """The retriever by vectors."""
        return self.dense or VectorRetriever(self._payload(), self.provider, self.quantization)

    def stages(self, queries: DataFrame, limit: int | None = None, filters: Mapping[str, Any] | None = None) -> DataFrame:
        """query_id, stage, rank, chunk_id, score of every stage: dense, sparse, fused, reranked, final."""
        return self.debug(queries, limit, filters)[0]

    def debug(self, queries: DataFrame, limit: int | None = None, filters: Mapping[str, Any] | None = None) -> tuple[DataFrame, dict[str, Any]]:
        """The stages, and how the search ran: mode, reranked, reranker_error; degraded with fallback_category and fallback_detail if vectors failed."""
        s = self._settings()
        limit = lexical.checked_limit(limit if limit is not None else s.final_results)
        said: dict[str, Any] = {"mode": self.mode()}
        near = None
        if said["mode"] == "hybrid":
            try:
                # several stages read it
                near = settle(self.by_vectors().search(queries, s.dense_candidates, filters))
            except Exception as e:  # noqa: BLE001 - whatever a model's library raises
                if not self.fall_back:
                    raise
                said = {"mode": "sparse_fallback", "degraded": True, "fallback_category": error_category(e), "fallback_detail": compact_error(e)}
                _LOG.warning("searching by words alone: %s: %s", said["fallback_category"], said["fallback_detail"])
        if near is None:
            best = self.by_words().search(queries, limit, filters)
            return self._union([("sparse", best), ("final", best)]), said
        words = self.by_words().search(queries, s.sparse_candidates, filters)
        lists = near.select("query_id", "rank", "chunk_id", "score", F.lit(0).alias("list_idx")).unionByName(words.select("query_id", "rank", "chunk_id", "score", F.lit(1).alias("list_idx")))
        fused = fusion.reciprocal_ranks(lists, max(limit, s.dense_candidates, s.sparse_candidates))
        # texts are joined only to what is listed
        wanted = ["chunk_id", "source_path", *(["text", "symbol"] if s.rerank else [])]
        named = fused.join(self.chunks.select(*wanted), "chunk_id").join(queries.select("query_id", "query"), "query_id")
        ordered, said["reranked"] = named, False
        if s.rerank:
            try:
                ordered = settle(pv.rerank_with(named, self.reranker)) if self.reranker else fusion.rerank(named)
                said["reranked"] = True
            except Exception as e:  # noqa: BLE001
                if not self.fall_back:
                    raise
                said["reranker_error"] = compact_error(e)
                _LOG.warning("not reranked: %s", said["reranker_error"])
        final = fusion.diversify(ordered, s.max_results_per_source, limit=limit)
        return self._union([("dense", near), ("sparse", words), ("fused", fused), *([("reranked", ordered)] if said["reranked"] else []), ("final", final)]), said

    @staticmethod
    def _union(parts: list[tuple[str, DataFrame]]) -> DataFrame:
        out = None
        for stage, part in parts:
            row = part.select("query_id", F.lit(stage).alias("stage"), "rank", "chunk_id", "score")
            out = row if out is None else out.unionByName(row)
        return out

    def _payload(self) -> DataFrame:
        wanted = [c for c in ("knowledge_id", "source_path", "kind", "symbol", *sc.PROMOTED) if c not in self.vectors.columns]
        return self.vectors.join(self.chunks.select("chunk_id", *wanted), "chunk_id")

    def search(self, queries: DataFrame, limit: int | None = None, filters: Mapping[str, Any] | None = None) -> DataFrame:
        """The best chunks of each query with their text and citation: query_id, rank, score, the chunk's columns, citation."""
        best = self.stages(queries, limit, filters).where("stage = 'final'").select("query_id", "rank", "chunk_id", "score")
        return best.join(cited(self.chunks), "chunk_id")

    def ranked_words(self, queries: DataFrame, limit: int = 8, filters: Mapping[str, Any] | None = None, which: str = "all") -> DataFrame:
        """query_id, rank, chunk_id, score by words alone, of all, of code or of documents.

        Documents are what is marked so as a source. Code too; queries that
        find none look among chunks whose type of document is code.
        """
        if which not in CORPORA:
            raise ValueError(f"corpus must be one of {', '.join(CORPORA)}")
        given = dict(filters or {})
        if which == "all":
            return self.by_words().search(queries, limit, filters)
        marked = self.by_words().search(queries, limit, given | {"source_type": which})
        if which == "documents":
            return marked
        marked = settle(marked)
        others = queries.join(marked.select("query_id").distinct(), "query_id", "left_anti")
        return marked.unionByName(self.by_words().search(others, limit, {"document_type": "code"} | given))

    def search_words(self, queries: DataFrame, limit: int = 8, filters: Mapping[str, Any] | None = None, which: str = "all") -> DataFrame:
        """The best chunks by words alone, with their columns and citation."""
        return self.ranked_words(queries, limit, filters, which).join(cited(self.chunks), "chunk_id")

    def search_code(self, queries: DataFrame, limit: int = 8, filters: Mapping[str, Any] | None = None) -> DataFrame:
        """The best chunks of code."""
        return self.search_words(queries, limit, filters, "code")

    def search_documents(self, queries: DataFrame, limit: int = 8, filters: Mapping[str, Any] | None = None) -> DataFrame:
        """The best chunks of documents."""
        return self.search_words(queries, limit, filters, "documents")

    def related(self, targets: DataFrame, limit: int = 5) -> DataFrame:
        """target_id, rank, chunk_id, score: chunks like the targets by symbol, heading and the beginning of the text."""
        found = lookup.find(self.chunks, targets)
        query = F.concat_ws(" ", F.coalesce("symbol", F.lit("")), F.coalesce(F.get_json_object("metadata", "$.heading"), F.lit("")), F.substring("text", 1, 200))
        asked = settle(found.select(F.col("target_id").alias("query_id"), query.alias("query"), F.col("chunk_id").alias("_self")))
        best = self.by_words().search(asked.select("query_id", "query"), limit + 1)
        others = best.join(asked.select("query_id", "_self"), "query_id").where(F.col("chunk_id") != F.col("_self")).drop("_self")
        return lexical.ranked(others.drop("rank"), limit).select(F.col("query_id").alias("target_id"), "rank", "chunk_id", "score")

    def find_symbol(self, symbol: str, limit: int = 8, knowledge_id: str | None = None) -> DataFrame:
        """Chunks of a symbol."""
        return cited(lookup.by_symbol(self.chunks, symbol, lexical.checked_limit(limit), knowledge_id))

    def read_source(self, targets: DataFrame, previous: int = 1, following: int = 1) -> DataFrame:
        """target_id, found, and the target's chunk with its neighbours and citations; a target not found has one row that says so."""
        made = cited(lookup.neighbours(self.chunks, lookup.find(self.chunks, targets), previous, following))
        return targets.select("target_id").distinct().join(made, "target_id", "left").withColumn("found", F.col("chunk_id").isNotNull())

    def source_metadata(self, targets: DataFrame) -> DataFrame:
        """The targets' chunks without their text."""
        return cited(lookup.find(self.chunks, targets)).drop("text")

    def info(self) -> DataFrame:
        """knowledge_id, chunks, sources, files of each instance, and how it is searched."""
        return index.counts(self.chunks).withColumn("mode", F.lit(self.mode()))

    def evaluate(self, cases: DataFrame, limit: int = 10, ks: tuple[int, ...] = (5, 10)) -> DataFrame:
        """The mean recall and reciprocal rank over cases (query_id, query, expected), in one job."""
        found = self.stages(cases.select("query_id", "query"), limit).where("stage = 'final'").join(self.chunks.select("chunk_id", "source_path", "metadata"), "chunk_id")
        return evaluate.averages(evaluate.metrics(found, cases, ks))


@dataclass
class IndexReport:
    """What an index run did; files that failed are counted as new and tried again."""

    new: int = 0
    unchanged: int = 0
    changed: int = 0
    deleted: int = 0
    chunks: int = 0
    failed: int = 0
    dense_error: str | None = None


def word_store(spark: SparkSession, config: cf.Config) -> WordStore:
    """An instance's inverted index."""
    return WordStore(spark, f"{config.storage.path}/words", lexical.FIELD_WEIGHTS)


def index_config(spark: SparkSession, config: cf.Config, force: bool = False, embed: bool = False, progress: Callable[[str, dict], None] | None = None) -> IndexReport:
    """List, digest, classify, parse, cut, enrich and store the sources of an instance, and their postings.

    Only what changed is parsed and written, unless ``force`` is set or the
    settings say that runs aren't incremental. Files that no source names any
    more go too, whatever is on record of them.
    """
    say = progress or (lambda event, payload: None)
    kid, s = config.knowledge.id, config.indexing
    force = force or not s.incremental
    roots = [(kid, str(source_root(config, source))) for source in config.all_sources()]
    found = files.listed(spark, roots, ignored_dirs=s.ignored_directories, ignored_types=s.ignored_extensions, follow_links=s.follow_symlinks)
    say("listed", {"roots": len(roots)})
    states = index.Snapshots(spark, f"{config.storage.path}/state", key="path", buckets=16)
    store = index.Snapshots(spark, f"{config.storage.path}/chunks")
    repos = git.repositories(spark, [r for _, r in roots])
    commits = found.join(repos, "root").select("path", F.col("git_commit").alias("_commit"))
    now = settle(files.fingerprints(found).join(commits, "path", "left").withColumn("git_commit", F.col("_commit")).select(*[f.name for f in sc.FILE_STATE.fields]))
    before = states.read(sc.FILE_STATE)
    status = settle(index.classify(now, before))
    report = IndexReport(**index.report(status).first().asDict())
    say("classified", vars(report).copy())
    wanted = status.where(F.col("status").isin("new", "changed", *(["unchanged"] if force else [])))
    made = settle(files.parsed(found.join(wanted.select("path"), "path", "left_semi"), config.parsing))
    bad = made.where(F.col("error").isNotNull()).select(F.col("file_key").alias("path")).distinct()
    fresh = made.where(F.col("error").isNull()).drop("error").join(found.select(F.col("path").alias("file_key"), "root"), "file_key")
    fresh = git.enrich(fresh.withColumn("repository_name", F.lit(None).cast("string")), repos, known=git.paths(spark, [r for _, r in roots]))
    extra = F.create_map(*[x for c in ("repository_name", "git_commit", "git_path", "repository_url", "citation_url") for x in (F.lit(c), F.col(c))])
    merged = F.map_filter(F.map_concat(F.from_json("metadata", "map<string,string>"), extra), lambda k, v: v.isNotNull())
    fresh = fresh.withColumn("metadata", F.to_json(F.map_from_entries(F.array_sort(F.map_entries(merged)))))
    fresh = fresh.withColumn("chunk_id", sc.chunk_id()).withColumn("content_hash", sc.content_hash()).withColumn("indexed_at", F.current_timestamp())
    fresh = settle(normalize.normalize(fresh.select(*[f.name for f in sc.CHUNKS.fields]), config.parsing.max_chunk_tokens, config.parsing.chunk_overlap_tokens))
    gone = status.where("status = 'deleted'").select(F.col("path").alias("file_key"))
    # files of the index that no source has, by any of their names
    names = found.select(F.explode(F.array("path", F.substring("path", F.length("root") + 2, F.length("path")))).alias("path"))
    unknown = index.prune_unknown(store.read(sc.CHUNKS), names, kid)[1].select("file_key")
    replaced = settle(wanted.select(F.col("path").alias("file_key")).unionByName(gone).unionByName(unknown).distinct())
    if not replaced.isEmpty():
        word_store(spark, config).add(fresh, replaced)
        store.replace(fresh, replaced)
        kept = now.join(wanted.select("path"), "path", "left_semi").join(bad, "path", "left_anti")
        states.replace(kept, replaced.select(F.col("file_key").alias("path")), by="path")
    report.chunks, report.failed = store.read(sc.CHUNKS).count(), bad.count()
    say("stored", {"chunks": report.chunks, "failed": report.failed})
    if embed:
        try:
            embed_config(spark, config)
        except Exception as e:  # noqa: BLE001 - chunks are kept whatever happens to vectors
            report.dense_error = f"{error_category(e)}: {compact_error(e)}"
    return report


def noise(spark: SparkSession, config: cf.Config) -> DataFrame:
    """What of an instance's sources would be noise in its index: category, files, bytes, folders, samples."""
    s = config.indexing
    roots = [(config.knowledge.id, str(source_root(config, source))) for source in config.all_sources()]
    found = files.listed(spark, roots, ignored_dirs=s.ignored_directories, ignored_types=s.ignored_extensions, follow_links=s.follow_symlinks)
    return index.noisy_files(files.fingerprints(found), tuple(s.ignored_extensions), tuple(s.ignored_directories))


def ignore_noise(config: cf.Config, categories: list[str], path: str | Path | None = None) -> bool:
    """Ignore the types and folders of some categories from now on, in the settings and in their file; whether that is news."""
    s, before = config.indexing, (len(config.indexing.ignored_extensions), len(config.indexing.ignored_directories))
    for category in categories:
        types, folders = index.NOISE[category]
        s.ignored_extensions += [t for t in types if t not in s.ignored_extensions]
        s.ignored_directories += [f for f in folders if f not in s.ignored_directories]
    news = before != (len(s.ignored_extensions), len(s.ignored_directories))
    if news and path is not None:
        cf.save(config, path)
    return news


def source_root(config: cf.Config, source: cf.Source):
    """Where a source's files are; a remote one is brought up to date first."""
    if source.repo_url:
        base = git.clone_or_update(source.repo_url, git.remote_folder(config.storage.path, source.repo_url), source.ref or None)
    else:
        base = Path(source.path)
    return base / source.subpath if source.subpath else base


def embed_missing(chunks: DataFrame, vectors: DataFrame | None, provider: pv.EmbeddingProvider) -> DataFrame:
    """The table of vectors after chunks were added or changed: only these are embedded, rows of chunks that are gone go."""
    rows = chunks.select("knowledge_id", "chunk_id", "content_hash", "source_path", "ord", "text")
    kept = None
    if vectors is not None:
        kept = vectors.join(rows.select("chunk_id", "content_hash").distinct(), ["chunk_id", "content_hash"], "left_semi")
        rows = rows.join(vectors.select("chunk_id", "content_hash").distinct(), ["chunk_id", "content_hash"], "left_anti")
    # a source's chunks go to the model one after the other
    made = pv.embed(rows.sortWithinPartitions("source_path", "ord", "chunk_id"), provider).withColumn("norm", F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))))
    made = made.select("knowledge_id", "chunk_id", "source_path", F.col("vector").cast("array<float>").alias("vector"), "norm", "content_hash")
    return made if kept is None else kept.select(*made.columns).unionByName(made)


def without_source(vectors: DataFrame, source_path: str, knowledge_id: str | None = None) -> DataFrame:
    """The table of vectors without those of a source, of one instance if it is named."""
    mine = F.col("source_path").eqNullSafe(F.lit(source_path)) & (F.lit(True) if knowledge_id is None else F.col("knowledge_id").eqNullSafe(F.lit(knowledge_id)))
    return vectors.where(~mine)


def delete_source_vectors(spark: SparkSession, config: cf.Config, source_path: str) -> int:
    """Delete the stored vectors of a source; returns how many are left."""
    store = vector_store(spark, config)
    vectors = store.read(sc.VECTORS)
    mine = vectors.where(F.col("source_path") == source_path)
    if not mine.isEmpty():
        store.replace(vectors.limit(0), mine.select("chunk_id"))
    return store.read(sc.VECTORS).count()


def vector_store(spark: SparkSession, config: cf.Config) -> index.Snapshots:
    """An instance's vectors."""
    return index.Snapshots(spark, f"{config.storage.path}/{config.collection}", key="chunk_id")


def embed_config(spark: SparkSession, config: cf.Config, recreate: bool = False) -> int:
    """Embed what an instance's vectors lack, or all anew; returns how many vectors there are."""
    chunks = index.Snapshots(spark, f"{config.storage.path}/chunks").read(sc.CHUNKS)
    store = vector_store(spark, config)
    store.write(embed_missing(chunks, None if recreate else store.read(), pv.embedding_provider(config.models.embedding)))
    return store.read(sc.VECTORS).count()


def open_engine(spark: SparkSession, config: cf.Config) -> Engine:
    """An engine over an instance's stored chunks and postings, and its vectors if there are any."""
    chunks = index.Snapshots(spark, f"{config.storage.path}/chunks").read(sc.CHUNKS)
    vectors = vector_store(spark, config).read()
    mode = {"none": "exact"}.get(config.storage.quantization.mode, config.storage.quantization.mode)
    provider = pv.embedding_provider(config.models.embedding) if vectors is not None else None
    return Engine(chunks, vectors, provider, config.retrieval, pv.reranker(config.models.reranker), mode, word_store(spark, config).read())


class Deleted(NamedTuple):
    """Whether there was anything to delete, and what went wrong."""

    existed: bool
    error: str | None = None


def delete_index(spark: SparkSession, config: cf.Config) -> Deleted:
    """Delete all that is stored of an instance, as far as that is possible."""
    try:
        return Deleted(index.Snapshots(spark, config.storage.path).drop())
    except Exception as e:  # noqa: BLE001 - told, not raised
        return Deleted(True, compact_error(e))


#: Kinds of trouble, by the type of an error and by words of its message; the first that fits counts.
TROUBLE: tuple[tuple[str, tuple[type[BaseException], ...], tuple[str, ...]], ...] = (
    ("missing_dependency", (ImportError,), ("modulenotfounderror", "importerror", "no module named")),
    ("service_unavailable", (ConnectionError, TimeoutError, pv.EmbeddingError), ("connect", "timed out", "refused", "embeddingerror", "urlerror")),
    ("configuration", (cf.ConfigError, ValueError), ("configerror",)),
    ("index", (), ("analysisexception", "collection", "vectors")),
)


def _message(error: BaseException) -> str:
    """What an error says; of one from an executor's Python what was raised there, without the way to it."""
    told = re.findall(r"^(?!pyspark|org\.|java)(\w[\w.]*(?:Error|Exception|Interrupt|Iteration)\b.*)$", str(error), re.M) if "Traceback (most recent call last)" in str(error) else []
    return told[-1] if told else str(error)


def error_category(error: BaseException) -> str:
    """What kind of trouble an error is: missing_dependency, configuration, service_unavailable, index, unknown."""
    text = f"{type(error).__name__}: {_message(error)}".lower()
    by_type = next((kind for kind, types, _ in TROUBLE if isinstance(error, types)), None)
    return by_type or next((kind for kind, _, words in TROUBLE if any(w in text for w in words)), "unknown")


def compact_error(error: BaseException, causes: int = 3, width: int = 200) -> str:
    """What an error and its causes say, each once, on one line, without credentials."""
    chain: list[BaseException] = []
    while error is not None and len(chain) < causes:
        chain.append(error)
        error = error.__cause__ or error.__context__
    said = dict.fromkeys(re.sub(r"\s+", " ", _message(e)).strip() for e in chain)
    text = ": ".join(t for t in said if t) or type(chain[0]).__name__
    for pattern, mark in tx.CREDENTIALS:
        text = re.sub(pattern, mark.replace("$", "\\"), text)
    return text[:width]
