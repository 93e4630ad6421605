"""The queries of this package, by name, each a function of a session and a folder of tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondera.llm import credentials, handwritten, leaks, mixing, neardup, quality, scans, splitting


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Code files that no project member wrote by hand."""
    return p1_files(spark, folder).where("size(signs) > 0").select("file_key")


def p1_files(spark: SparkSession, folder: str) -> DataFrame:
    """All code files with the signs that they weren't written by hand."""
    return handwritten.foreign_files(_table(spark, folder, "chunks"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Faults of scanned pages."""
    return scans.ScanRepair(_table(spark, folder, "chunks")).faults()


def p2_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Scanned pages in continuous paragraphs."""
    return scans.ScanRepair(_table(spark, folder, "chunks")).repaired()


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of chunks of at least 30 words that share 0.6 of their runs of three words."""
    return neardup.near_duplicate_pairs(_table(spark, folder, "chunks"), width=3, threshold=0.6, least_words=30, bands=32, rows=3)


def p3_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Every chunk of at least 30 words with its class of copies and the number of its near-duplicates."""
    return neardup.link_counts(_table(spark, folder, "chunks"), width=3, threshold=0.6, least_words=30, bands=32, rows=3)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Lines on which credentials begin."""
    found = credentials.find_credentials(_table(spark, folder, "chunks")).select("chunk_id", F.explode("found").alias("f"))
    return found.where("f.begins").select("chunk_id", F.col("f.line_no").alias("line_no")).distinct()


def p4_redacted(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks that hold credentials, with these overwritten."""
    return credentials.find_credentials(_table(spark, folder, "chunks")).select("chunk_id", "redacted")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks that are longer than their instance allows, and how they must be cut."""
    return _pieces(spark, folder).where("piece = 0").select("chunk_id", "cut")


def p5_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """The pieces of oversized chunks."""
    return _pieces(spark, folder)


def _pieces(spark: SparkSession, folder: str) -> DataFrame:
    return splitting.split_oversized(_table(spark, folder, "chunks"), _table(spark, folder, "instances"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with the evaluation items that leaked into them."""
    return p6_leaks(spark, folder).select("doc_id", "item_id")


def p6_leaks(spark: SparkSession, folder: str) -> DataFrame:
    """Leaks with the words matched and edited."""
    return leaks.leaked_passages(_table(spark, folder, "documents"), _table(spark, folder, "eval_items"))


def p7_mix(spark: SparkSession, folder: str) -> DataFrame:
    """How often each document is used in the mixture."""
    return mixing.plan_mixture(_table(spark, folder, "documents"), _table(spark, folder, "mix_targets"))[0]


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The shares that the mixture reaches."""
    return mixing.plan_mixture(_table(spark, folder, "documents"), _table(spark, folder, "mix_targets"))[1]


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that are not prose."""
    return quality.text_forms(_table(spark, folder, "documents")).where("form <> 'prose'").select("doc_id")


def p8_forms(spark: SparkSession, folder: str) -> DataFrame:
    """Statistics and posterior forms of all documents."""
    return quality.text_forms(_table(spark, folder, "documents"))


def p8_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """Statistics of all documents, shares rounded."""
    made = quality.text_statistics(_table(spark, folder, "documents"))
    return made.select(*[F.round(c, 6).alias(c) if kind == "double" else F.col(c) for c, kind in made.dtypes])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Queries by name."""
    return {
        "p1_found": p1_found, "p1_files": p1_files,
        "p2_found": p2_found, "p2_pages": p2_pages,
        "p3_found": p3_found, "p3_classes": p3_classes,
        "p4_found": p4_found, "p4_redacted": p4_redacted,
        "p5_found": p5_found, "p5_pieces": p5_pieces,
        "p6_found": p6_found, "p6_leaks": p6_leaks,
        "p7_mix": p7_mix, "p7_shares": p7_shares,
        "p8_found": p8_found, "p8_forms": p8_forms, "p8_statistics": p8_statistics,
    }


def oracle_sql() -> dict[str, str]:
    """SQL that gives the same rows as a query, where there is such SQL."""
    latest = "(SELECT * FROM chunks QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY indexed_at DESC, text DESC) = 1)"
    share = lambda part, whole, name: f"round(CASE WHEN {whole} > 0 THEN {part} / {whole} ELSE 0 END, 6) AS {name}"
    common = ", ".join(f"'{w}'" for w in quality.COMMON_WORDS)
    word = "[\\p{L}\\p{N}_]+"
    # exact shares of runs of three words, and the classes of equal sets of runs
    runs = f"""w AS (SELECT chunk_id, regexp_extract_all(lower(coalesce(text, '')), '{word}') AS w FROM {latest} WHERE chunk_id IS NOT NULL),
            s AS (SELECT chunk_id, list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS s FROM w WHERE len(w) >= 30),
            e AS (SELECT chunk_id, len(s) AS n, unnest(s) AS g FROM s),
            p AS (SELECT a.chunk_id AS chunk_id_a, b.chunk_id AS chunk_id_b FROM e a JOIN e b ON a.g = b.g AND a.chunk_id < b.chunk_id GROUP BY ALL HAVING count(*) >= 0.6 * (max(a.n) + max(b.n) - count(*)) - 1e-9)"""
    return {
        "p3_found": f"WITH {runs} SELECT chunk_id_a, chunk_id_b FROM p",
        "p3_classes": f"""WITH {runs}, k AS (SELECT s, min(chunk_id) AS class_id, count(*) AS copies FROM s GROUP BY s),
            l AS (SELECT c, count(*) AS links FROM (SELECT chunk_id_a AS c FROM p UNION ALL SELECT chunk_id_b FROM p) GROUP BY c)
            SELECT chunk_id, class_id, copies, coalesce(links, 0) AS links FROM s JOIN k USING (s) LEFT JOIN l ON l.c = chunk_id""",
        "p8_statistics": f"""
            WITH t AS (SELECT doc_id, row_number() OVER () AS r, lower(regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g')) AS t FROM documents),
            w AS (SELECT r, l, regexp_extract_all(l, '{word}') AS w FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM t)),
            n AS (SELECT r, length(trim(l)) AS c, len(w) AS n, len(list_filter(w, lambda x: x IN ({common}))) AS s, regexp_matches(l, '[.!?…]["''”’»)\\]]*\\s*$') AS p,
                regexp_matches(l, '^\\s*([-*+•–]\\s|\\d{{1,3}}[.)]\\s|\\[)') AS b, len(regexp_extract_all(l, '[;|\\t]|,\\S|\\S {{2,}}')) >= 2 AS x FROM w),
            g AS (SELECT r, count(*) AS n_lines, sum(c) AS c, sum(s) AS s, count(*) FILTER (p) AS p, count(*) FILTER (b) AS b, count(*) FILTER (x) AS x, coalesce(sum(c) FILTER (n >= 3 AND s * 6 >= n), 0) AS prose FROM n WHERE c > 0 GROUP BY r),
            d AS (SELECT doc_id, r, length(t) AS n_chars, len(q) AS n_words, coalesce(list_sum(list_transform(q, lambda x: length(x))), 0) AS wc, len(list_distinct(q)) AS u,
                len(regexp_extract_all(t, '[^\\p{{L}}\\p{{N}}\\s]')) AS sy, len(regexp_extract_all(t, '\\p{{N}}')) AS dg, len(regexp_extract_all(t, '[.!?…]["''”’»)\\]]*(?:\\s|$)')) AS e,
                len(list_filter(q, lambda x: regexp_matches(x, '[bcdfghjklmnpqrstvwxz]{{5}}|^\\p{{L}}{{22}}|\\p{{L}}\\d\\p{{L}}|^[a-f\\d]{{12}}'))) AS o FROM (SELECT *, regexp_extract_all(t, '{word}') AS q FROM t)),
            a AS (SELECT d.*, coalesce(n_lines, 0) AS n_lines, coalesce(c, 0) AS c, coalesce(s, 0) AS s, coalesce(p, 0) AS p, coalesce(b, 0) AS b, coalesce(x, 0) AS x, coalesce(prose, 0) AS prose FROM d LEFT JOIN g USING (r))
            SELECT doc_id, n_chars, n_words, n_lines, {share('wc', 'n_words', 'mean_word_length')}, {share('sy', 'n_chars', 'symbol_ratio')}, {share('dg', 'n_chars', 'digit_ratio')},
                {share('p', 'n_lines', 'line_end_punctuation')}, {share('s', 'n_words', 'common_word_share')}, {share('prose', 'c', 'prose_share')}, {share('n_words', 'n_lines', 'words_per_line')},
                {share('e', 'n_words', 'sentence_rate')}, {share('x', 'n_lines', 'cell_share')}, {share('b', 'n_lines', 'bullet_share')}, {share('u', 'n_words', 'distinct_share')}, {share('o', 'n_words', 'odd_word_share')}
            FROM a""",
        "p5_found": f"""
            SELECT c.chunk_id, CASE WHEN list_max(list_transform(string_split(c.text, chr(10)), lambda l: length(rtrim(l, chr(13))))) > 4 * i.max_chunk_tokens
                   THEN 'forced' ELSE 'natural' END AS cut
            FROM {latest} c JOIN instances i USING (knowledge_id) WHERE length(c.text) > 4 * i.max_chunk_tokens""",
    }
