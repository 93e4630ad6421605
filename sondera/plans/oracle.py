"""SQL with the same rows as the engine's queries."""

from __future__ import annotations

#: The latest version of each chunk, once.
_C = "c AS (SELECT * FROM chunks WHERE chunk_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY indexed_at DESC, content_hash DESC) = 1)"
_PART = "list_transform(regexp_extract_all({t}, '[A-Za-z]+|[0-9]+'), lambda p: lower(p))"


def _tokens(source: str, keys: str, text: str) -> str:
    """A row for each token (with its variants and singulars) of a text."""
    return f"""SELECT {keys}, unnest(list_concat(vs, list_transform(list_filter(vs, lambda v: v LIKE '%s' AND length(v) > 3), lambda v: v[:-2]))) AS token FROM (
        SELECT {keys}, list_distinct(list_concat([lower(t)], parts, CASE WHEN list_contains(parts, 'pix') THEN ['pixel', 'pixels'] ELSE [] END)) AS vs FROM (
            SELECT {keys}, t, {_PART.format(t="t")} AS parts FROM (SELECT {keys}, unnest(regexp_extract_all({text}, '[A-Za-z_][A-Za-z0-9_\\.]*|[0-9]+')) AS t FROM {source})))"""


_DOC = "concat_ws(chr(10), coalesce(text, ''), coalesce(symbol, ''), coalesce(xml_path, ''), coalesce(source_path, ''), coalesce(kind, ''))"
_Q = "q AS (SELECT item_id AS query_id, query, expected FROM eval_items)"
_POSTINGS = f"tok AS ({_tokens('c', 'chunk_id', _DOC)}), post AS (SELECT chunk_id, token, count(*) AS tf FROM tok GROUP BY ALL), len AS (SELECT c.chunk_id, greatest(count(t.token), 1) AS length FROM c LEFT JOIN tok t USING (chunk_id) GROUP BY ALL)"


def _bag(q: str = _Q, where: str = "TRUE", top: int = 10) -> str:
    """Common tables up to ``hits``: query_id, rank, chunk_id, score by bags of tokens with the bonus."""
    return f"""{_C}, {q}, {_POSTINGS}, qt AS (SELECT query_id, token, count(*) AS qtf FROM ({_tokens('q', 'query_id', 'query')}) GROUP BY ALL),
        st AS (SELECT count(*) AS n, avg(length) AS a FROM len), df AS (SELECT token, count(*) AS df FROM post GROUP BY ALL),
        sc AS (SELECT query_id, chunk_id, sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / a))) AS s
               FROM qt JOIN post USING (token) JOIN df USING (token) JOIN len USING (chunk_id), st GROUP BY ALL
               UNION ALL SELECT query_id, chunk_id, 0 FROM q, c WHERE query <> '' AND (contains(lower(coalesce(symbol, '')), lower(query)) OR contains(coalesce(source_path, ''), query))),
        bon AS (SELECT query_id, chunk_id, sum(s) AS s FROM sc GROUP BY ALL),
        tot AS (SELECT query_id, chunk_id, s + {_BONUS} AS score FROM bon JOIN c USING (chunk_id) JOIN q USING (query_id) WHERE {where}),
        hits AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS INTEGER) AS rank, chunk_id, score FROM tot WHERE score > 0
                 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) <= {top})"""


def _terms(text: str) -> str:
    """The runs of letters and digits of a text's tokens, with their variants and singulars, in order."""
    parts = "list_transform(regexp_extract_all(t, '[A-Za-z]+|[0-9]+'), lambda p: lower(p))"
    every = f"list_concat([lower(t)], {parts}, CASE WHEN list_contains({parts}, 'pix') THEN ['pixel', 'pixels'] ELSE [] END)"
    once = f"list_transform([{every}], lambda l: list_filter(l, lambda x, i: list_position(l, x) = i))[1]"
    tokens = f"flatten(list_transform({once}, lambda v: CASE WHEN v LIKE '%s' AND length(v) > 3 THEN [v, v[:-2]] ELSE [v] END))"
    return f"regexp_extract_all(array_to_string(flatten(list_transform(regexp_extract_all({text}, '[A-Za-z_][A-Za-z0-9_\\.]*|[0-9]+'), lambda t: {tokens})), ' '), '[a-z0-9]+')"


def _phrase_scores(q: str = _Q) -> str:
    """Common tables up to ``pscore``: query_id, chunk_id, s by phrases in weighted fields, without the bonus."""
    return f"""{_C}, {q}, pd AS (SELECT chunk_id, {_terms(_DOC)} AS tx, {_terms("coalesce(symbol, '')")} AS sy, {_terms("coalesce(source_path, '')")} AS pa FROM c),
        plen AS (SELECT chunk_id, len(tx) + len(sy) + len(pa) AS length FROM pd), pst AS (SELECT count(*) AS n, avg(length) AS a FROM plen),
        occ AS (SELECT chunk_id, term, sum(w) AS f FROM (SELECT chunk_id, unnest(tx) AS term, 1.0 AS w FROM pd UNION ALL SELECT chunk_id, unnest(sy), 8.0 FROM pd UNION ALL SELECT chunk_id, unnest(pa), 3.0 FROM pd) GROUP BY ALL),
        pq AS (SELECT query_id, regexp_extract_all(token, '[a-z0-9]+') AS p FROM (SELECT DISTINCT query_id, token FROM ({_tokens('q', 'query_id', 'query')}))),
        ph AS (SELECT query_id, p, count(*) AS qtf FROM pq WHERE len(p) > 0 GROUP BY ALL), keys AS (SELECT DISTINCT p FROM ph),
        met AS (SELECT p, chunk_id, f FROM keys JOIN occ ON len(p) = 1 AND term = p[1] UNION ALL
            SELECT p, chunk_id, f FROM (SELECT p, chunk_id, list_sum(list_transform([[1.0, {_count('tx')}], [8.0, {_count('sy')}], [3.0, {_count('pa')}]], lambda x: x[1] * x[2])) AS f
                FROM (SELECT p, chunk_id FROM keys JOIN occ ON len(p) > 1 AND term = p[1]) JOIN pd USING (chunk_id)) WHERE f > 0),
        pdf AS (SELECT p, count(*) AS df FROM met GROUP BY ALL),
        pscore AS (SELECT query_id, chunk_id, sum(qtf * CASE WHEN n - df + 0.5 > df + 0.5 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * length / a))) AS s
            FROM ph JOIN met USING (p) JOIN pdf USING (p) JOIN plen USING (chunk_id), pst GROUP BY ALL)"""


def _count(terms: str) -> str:
    return f"len(list_filter(range(1, len({terms}) - len(p) + 2), lambda i: {terms}[i : i + len(p) - 1] = p))"


def _phrases(q: str = _Q, where: str = "TRUE", top: int = 10) -> str:
    """Common tables up to ``phits``: query_id, rank, chunk_id, score by phrases with the bonus."""
    place = "row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id)"
    return f"""{_phrase_scores(q)}, ptot AS (SELECT query_id, chunk_id, s + {_BONUS} AS score FROM pscore JOIN c USING (chunk_id) JOIN q USING (query_id) WHERE s > 0 AND {where}),
        phits AS (SELECT query_id, CAST({place} AS INTEGER) AS rank, chunk_id, score FROM ptot WHERE score > 0 QUALIFY {place} <= {top})"""


#: Chunks with a path of XML elements are none with a bonus here: their column is checked by the engine's tests.
_BONUS = """CASE WHEN query = coalesce(symbol, '') THEN 10 WHEN contains(lower(coalesce(symbol, '')), lower(query)) THEN 3 ELSE 0 END + CASE WHEN contains(coalesce(source_path, ''), query) THEN 1 ELSE 0 END
    + CASE WHEN contains(coalesce(xml_path, ''), '/') AND len(list_intersect(regexp_extract_all(lower(query), '[a-z0-9]+'), regexp_extract_all(lower(xml_path), '[a-z0-9]+'))) > 0 THEN 1.5 ELSE 0 END"""


def _dense(where: str = "TRUE") -> str:
    return f"""SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, round(s, 6) AS score FROM (
        SELECT a.vec_id AS query_id, b.vec_id, s, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(s, 9) DESC, b.vec_id) AS rank
        FROM embeddings a, embeddings b, LATERAL (SELECT list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS s)
        WHERE a.vec_id % 100 = 0 AND {where}) WHERE rank <= 10"""


def _quantised(rough: str, code: str, many: int) -> str:
    return f"""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), k AS (SELECT vec_id, v, {code} AS code FROM e),
        p AS (SELECT a.vec_id AS query_id, b.vec_id, round({rough}, 9) AS r, list_cosine_similarity(a.v, b.v) AS s FROM k a, k b WHERE a.vec_id % 100 = 0),
        short AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY r DESC, vec_id) <= {many})
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, vec_id) AS INTEGER) AS rank, vec_id, round(s, 6) AS score FROM short
        QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, vec_id) <= 10"""


_PHRASED = r"q AS (SELECT item_id AS query_id, regexp_replace(query, ' ([a-z\-]+) ([a-z\-]+)$', ' \1_\2') AS query FROM eval_items)"
_SHOWN = "SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM"
#: Dense and sparse candidates, fused.
_FUSED = f"""{_phrases(top=40)}, eb AS (SELECT chunk_id AS id, {{}} AS v FROM c), 
    eq AS (SELECT query_id, {{}} AS v FROM q),
    near AS (SELECT query_id, id AS chunk_id, row_number() OVER w AS rank FROM (SELECT query_id, id, round(list_cosine_similarity(a.v, b.v), 9) AS s FROM eq a, eb b) WINDOW w AS (PARTITION BY query_id ORDER BY s DESC, id) QUALIFY row_number() OVER w <= 40),
    lists AS (SELECT 0 AS l, query_id, chunk_id, rank FROM near UNION ALL SELECT 1, query_id, chunk_id, rank FROM phits),
    rf AS (SELECT query_id, chunk_id, sum(1.0 / (60 + rank)) AS score, min(l) AS l, arg_min(rank, l) AS k FROM lists GROUP BY ALL),
    fused AS (SELECT query_id, chunk_id, score, row_number() OVER w AS rank FROM rf WINDOW w AS (PARTITION BY query_id ORDER BY round(score, 12) DESC, l, k, chunk_id) QUALIFY row_number() OVER w <= 40),
    dv AS (SELECT f.*, row_number() OVER (PARTITION BY query_id, coalesce(nullif(source_path, ''), chunk_id) ORDER BY rank, chunk_id) AS n FROM fused f JOIN c USING (chunk_id)),
    final AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY rank, chunk_id) AS rank FROM dv WHERE n <= 3 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank, chunk_id) <= 8)"""
_HASHED = "list_transform(range(0, 32), lambda i: CAST(('0x' || substr(sha256(coalesce({}, '')), CAST(i * 2 + 1 AS INTEGER), 2)) AS INTEGER) / 255.0 * 2.0 - 1.0)"
_HYBRID = _FUSED.format(_HASHED.format("text"), _HASHED.format("query"))
#: Lines of texts as Python's splitlines has them, without and with their ends.
_LINES = "list_transform([regexp_split_to_array({t}, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85]')], lambda a: CASE WHEN a[-1] = '' THEN a[:-2] ELSE a END)[1]"
#: Windows of lines of at most 1600 characters with 160 in common: w has chunk_id, piece, a (lines before), b (last line).
_WINDOWS = f"""{_C}, ln AS (SELECT *, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS l FROM c WHERE length(coalesce(text, '')) > 1600),
    cum AS (SELECT *, list_transform(range(0, len(l) + 1), lambda i: coalesce(list_sum(list_transform(l[1:i], lambda x: length(x))), 0)) AS s FROM ln),
    w AS (SELECT chunk_id, 0 AS piece, CAST(0 AS BIGINT) AS a, greatest(1, len(list_filter(s, lambda x: x <= 1600)) - 1) AS b, s FROM cum
        UNION ALL SELECT chunk_id, piece + 1, na, greatest(na + 1, len(list_filter(s, lambda x: x <= s[na + 1] + 1600)) - 1), s FROM (
            SELECT *, greatest(a + 1, len(list_filter(s, lambda x: x <= s[b + 1] - 160)) - 1) AS na FROM w) WHERE b < len(s) - 1),
    pieces AS (SELECT chunk_id, piece, count(*) OVER (PARTITION BY chunk_id) AS pieces, a, b, s[b + 1] - s[a + 1] AS n_chars FROM w)"""
_ID = "knowledge_id || '_chk_' || left(sha256(concat_ws(chr(0), knowledge_id, source_path, kind, coalesce(symbol, ''), coalesce(CAST({s} AS VARCHAR), ''), coalesce(CAST({e} AS VARCHAR), ''), CAST({o} AS VARCHAR))), 32)"
#: Known items: the twelve words in the middle of each hundredth text of at least 40 words.
_KNOWN = """kw AS (SELECT chunk_id, content_hash, regexp_extract_all(coalesce(text, ''), '[A-Za-z]{3,}') AS w FROM c),
    q AS (SELECT chunk_id AS query_id, array_to_string(w[greatest(1, CAST(floor(len(w) / 2) AS INTEGER) - 5) : greatest(1, CAST(floor(len(w) / 2) AS INTEGER) - 5) + 11], ' ') AS query, content_hash AS h FROM kw
        WHERE len(w) >= 40 AND CAST('0x' || left(sha256(chunk_id), 8) AS BIGINT) % 100 = 0)"""
_STATE = """s AS (SELECT * FROM file_state WHERE path IS NOT NULL QUALIFY row_number() OVER (PARTITION BY knowledge_id, path ORDER BY mtime DESC) = 1)"""
_CLASSIFIED = f"""WITH {_STATE}, n AS (SELECT knowledge_id, path, CASE WHEN length(path) % 7 = 0 THEN mtime + 1 ELSE mtime END AS mtime, size, sha256 FROM s WHERE length(path) % 11 <> 0
        UNION ALL SELECT knowledge_id, path || '.new', mtime, size, sha256 FROM s WHERE length(path) % 11 = 0),
    k AS (SELECT coalesce(n.knowledge_id, s.knowledge_id) AS knowledge_id, coalesce(n.path, s.path) AS path,
        CASE WHEN s.path IS NULL THEN 'new' WHEN n.path IS NULL THEN 'deleted' WHEN n.mtime = s.mtime AND n.size = s.size AND n.sha256 = s.sha256 THEN 'unchanged' ELSE 'changed' END AS status
        FROM n FULL OUTER JOIN s ON n.knowledge_id = s.knowledge_id AND n.path = s.path)"""
_RANKS = "r AS (SELECT run_id, query_id, list_idx, chunk_id, min(rank) AS rank FROM ranked_results WHERE score IS NOT NULL GROUP BY ALL), aims AS (SELECT run_id, query_id, chunk_id FROM r WHERE list_idx = 0 AND rank <= 3)"
_METRICS = f"""{_RANKS}, m AS (SELECT a.run_id, a.query_id, count(*) AS n, count(*) FILTER (b.rank <= 5) AS f5, count(*) FILTER (b.rank <= 10) AS f10, min(b.rank) AS first
    FROM aims a LEFT JOIN (SELECT * FROM r WHERE list_idx = 1) b USING (run_id, query_id, chunk_id) GROUP BY ALL)"""
_NOISY = """SELECT CASE WHEN t IN ('.h5', '.fits', '.npy', '.npz', '.pkl', '.bin') THEN 'binary/data' WHEN t IN ('.zip', '.tar', '.gz', '.tgz', '.whl') THEN 'archives' WHEN t = '.cache' THEN 'logs/cache/build' WHEN t = '.log' THEN 'logs'
        WHEN t IN ('.png', '.jpg', '.jpeg', '.gif', '.webp', '.mp4', '.mov', '.avi') THEN 'images/media' END AS category, NULL AS folder, name, size
        FROM (SELECT *, regexp_extract(name, '[^.](\\.[^.]+)$', 1) AS t FROM (SELECT path, size, regexp_extract(path, '[^/]*$') AS name FROM files))
    UNION ALL SELECT 'logs/cache/build', regexp_extract(path, '^(.*?/' || f || ')/', 1), f, NULL FROM files, (VALUES ('htmlcov'), ('_build'), ('.ipynb_checkpoints')) v(f) WHERE contains(path, '/' || f || '/')"""
_JSON = "json_extract_string(metadata, '$.{}')"


def oracle_sql() -> dict[str, str]:
    """SQL by query name; queries that SQL can't express, or only too slowly, have none."""
    return {
        "count_chunks": "SELECT knowledge_id, count(DISTINCT chunk_id) AS chunks, count(DISTINCT source_path) AS sources, count(DISTINCT file_key) AS files FROM chunks GROUP BY ALL",
        "chunk_ids": """SELECT knowledge_id || '_chk_' || left(sha256(concat_ws(chr(0), knowledge_id, source_path, kind, coalesce(symbol, ''), coalesce(CAST(start_line AS VARCHAR), ''),
            coalesce(CAST(end_line AS VARCHAR), ''), CAST(ord AS VARCHAR))), 32) AS computed_id, sha256(text) AS computed_hash FROM chunks""",
        "newest_versions": f"WITH {_C} SELECT chunk_id, content_hash, CAST(length(text) AS INTEGER) AS n_chars FROM c",
        "promoted_metadata": "SELECT chunk_id, " + ", ".join(f"{_JSON.format(k)} AS {k}" for k in ("source_type", "document_type", "language", "repository_name")) + " FROM chunks",
        "token_counts": f"WITH {_C}, {_POSTINGS} SELECT token, CAST(sum(tf) AS BIGINT) AS tf, count(*) AS df FROM post GROUP BY ALL",
        "document_frequencies": f"WITH {_C}, {_POSTINGS} SELECT token, count(*) AS df FROM post GROUP BY ALL",
        "corpus_statistics": f"WITH {_C}, {_POSTINGS} SELECT count(*) AS n_docs, round(avg(length), 6) AS avg_len FROM len",
        "query_terms": f"WITH {_Q} SELECT DISTINCT query_id, token FROM ({_tokens('q', 'query_id', 'query')})",
        "bm25_topk": f"WITH {_bag()} SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM hits",
        "bm25_filtered": f"WITH {_bag(where=_FILTER)} SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM hits",
        "bm25_named": f"WITH {_bag(q=_NAMED)} SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM hits",
        "dense_topk": _dense(),
        "dense_topk_filtered": _dense("b.label IN (1, 2, 3)"),
        "dense_scalar_rescored": _quantised("list_cosine_similarity(a.code, b.code)", "list_transform(v, lambda x: CAST(greatest(-127, least(127, floor(x * 127.0 / list_max(list_transform(v, lambda y: abs(y))) + 0.5))) AS DOUBLE))", 20),
        "dense_binary_rescored": _quantised("-len(list_filter(range(1, 65), lambda i: a.code[i] <> b.code[i]))", "list_transform(v, lambda x: x > 0)", 40),
        "vector_norms": """SELECT vec_id, round(sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS norm,
            CAST(list_sum(list_transform(range(1, 33), lambda i: CASE WHEN embedding[i] > 0 THEN CAST(1 AS BIGINT) << (32 - i) ELSE 0 END)) AS BIGINT) AS first_signs,
            CAST(list_sum(list_transform(range(33, 65), lambda i: CASE WHEN embedding[i] > 0 THEN CAST(1 AS BIGINT) << (64 - i) ELSE 0 END)) AS BIGINT) AS last_signs FROM embeddings""",
        "hash_embedding": f"""WITH {_C}, b AS (SELECT chunk_id, list_transform(range(0, 32), lambda i: CAST(('0x' || substr(sha256(coalesce(text, '')), CAST(i * 2 + 1 AS INTEGER), 2)) AS INTEGER) / 255.0 * 2.0 - 1.0) AS v FROM c),
            n AS (SELECT chunk_id, v, sqrt(list_inner_product(CAST(v AS DOUBLE[]), CAST(v AS DOUBLE[]))) AS n FROM b)
            SELECT chunk_id, CAST(d AS INTEGER) AS dimension, round(v[d + 1] / n, 6) AS value FROM n, range(0, 32) AS r(d)""",
        "rrf_fusion": """WITH r AS (SELECT run_id, query_id, list_idx, chunk_id, min(rank) AS rank FROM ranked_results WHERE chunk_id IS NOT NULL AND rank IS NOT NULL GROUP BY ALL),
            f AS (SELECT run_id, query_id, chunk_id, sum(1.0 / (60 + rank)) AS score, min(list_idx) AS l, arg_min(rank, list_idx) AS k FROM r GROUP BY ALL)
            SELECT run_id, query_id, CAST(row_number() OVER w AS INTEGER) AS rank, chunk_id, round(score, 6) AS score FROM f
            WINDOW w AS (PARTITION BY run_id, query_id ORDER BY round(score, 12) DESC, l, k, chunk_id) QUALIFY row_number() OVER w <= 10""",
        "diversified": f"""WITH {_bag(top=20)}, d AS (SELECT h.*, row_number() OVER (PARTITION BY query_id, coalesce(nullif(repository_name, ''), chunk_id) ORDER BY rank, chunk_id) AS n FROM hits h JOIN c USING (chunk_id))
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank) AS INTEGER) AS rank, chunk_id, round(score, 6) AS score FROM d WHERE n <= 1
            QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) <= 5""",
        "lexical_rerank": f"""WITH {_bag(top=20)}, x AS (SELECT query_id, rank, chunk_id, len(list_intersect(list_distinct(regexp_extract_all(lower(query), '[^\\s]+')), list_distinct(regexp_extract_all(lower(text), '[^\\s]+'))))
                + CASE WHEN coalesce(symbol, '') <> '' AND lower(query) = lower(symbol) THEN 2 ELSE 0 END + 1.0 / (rank - 1 + 1000) AS score FROM hits JOIN c USING (chunk_id) JOIN q USING (query_id))
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS INTEGER) AS rank, chunk_id, round(score, 6) AS score FROM x
            QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) <= 10""",
        "find_symbol": f"""WITH {_C}, n AS (SELECT *, count(*) OVER (PARTITION BY symbol) AS n, row_number() OVER (PARTITION BY symbol ORDER BY source_path, ord, chunk_id) AS r FROM c WHERE symbol IS NOT NULL)
            SELECT symbol, CAST(r AS INTEGER) AS rank, chunk_id, source_path FROM n WHERE n > 1 AND r <= 8""",
        "lookup_repository": f"WITH {_C} SELECT chunk_id, source_path, ord FROM c WHERE repository_name = 'carillon-core' OR {_JSON.format('repository')} = 'carillon-core' OR {_JSON.format('repository_name')} = 'carillon-core'",
        "lookup_path": f"WITH {_C} SELECT chunk_id, source_path, kind FROM c WHERE starts_with(source_path, 'carillon-core/packages/unit1') AND kind IN ('class', 'module') AND symbol IS NULL",
        "read_source_neighbours": f"WITH {_C} SELECT t.chunk_id AS target_id, n.chunk_id, n.ord FROM c t JOIN c n ON n.knowledge_id = t.knowledge_id AND n.source_path = t.source_path AND n.ord BETWEEN t.ord - 1 AND t.ord + 2",
        "find_chunks": f"""WITH {_C}, s AS (SELECT source_path, arg_min(chunk_id, (ord, chunk_id)) AS first FROM c GROUP BY ALL)
            SELECT chunk_id AS target_id, CASE WHEN ord = 0 THEN chunk_id ELSE first END AS chunk_id FROM c JOIN s USING (source_path)""",
        "same_section": f"""WITH {_C}, x AS (SELECT *, {_JSON.format('section')} AS section FROM c)
            SELECT t.chunk_id AS target_id, n.chunk_id FROM x t JOIN x n ON n.knowledge_id = t.knowledge_id AND n.source_path = t.source_path AND (n.chunk_id = t.chunk_id OR n.section = t.section)""",
        "parent_symbol": f"""WITH {_C}, t AS (SELECT chunk_id AS target_id, knowledge_id, source_path, coalesce({_JSON.format('parent_symbol')}, nullif(regexp_extract(symbol, '^(.*)\\.[^.]*$', 1), '')) AS around FROM c WHERE kind = 'method')
            SELECT target_id, p.chunk_id, p.symbol FROM t JOIN c p ON p.knowledge_id = t.knowledge_id AND p.source_path = t.source_path AND p.symbol = t.around
            QUALIFY row_number() OVER (PARTITION BY target_id ORDER BY p.ord, p.chunk_id) = 1""",
        "text_lines": """WITH l AS (SELECT doc_id, text, regexp_split_to_array(text, '\\r\\n|[\\n\\r]') AS a FROM documents)
            SELECT doc_id, CAST(greatest(1, CASE WHEN a[-1] = '' THEN len(a) - 1 ELSE len(a) END) AS INTEGER) AS n_lines, CAST(len(regexp_extract_all(text, '[^\\n]*\\n|[^\\n]+')) AS INTEGER) AS n_ended,
            CASE WHEN length(o) <= 120 THEN o ELSE rtrim(substr(o, 1, 119)) || '…' END AS preview FROM (SELECT *, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS o FROM l)""",
        "renumbered": f"""WITH {_C}, n AS (SELECT *, row_number() OVER (PARTITION BY knowledge_id, file_key ORDER BY ord, start_line, chunk_id) - 1 AS o FROM c)
            SELECT knowledge_id || '_chk_' || left(sha256(concat_ws(chr(0), knowledge_id, source_path, kind, coalesce(symbol, ''), coalesce(CAST(start_line AS VARCHAR), ''), coalesce(CAST(end_line AS VARCHAR), ''), CAST(o AS VARCHAR))), 32) AS chunk_id,
            file_key, CAST(o AS INTEGER) AS ord FROM n""",
        "classify_files": f"{_CLASSIFIED} SELECT * FROM k",
        "index_report": f"{_CLASSIFIED} SELECT " + ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in ("new", "unchanged", "changed", "deleted")) + " FROM k",
        "replaced_files": f"""WITH {_C}, t AS (SELECT DISTINCT file_key FROM c WHERE kind = 'class') SELECT kind, count(*) AS chunks, count(DISTINCT file_key) AS files FROM c
            WHERE kind = 'class' OR file_key NOT IN (SELECT file_key FROM t) GROUP BY ALL""",
        "pruned_files": f"""WITH {_C}, a AS (SELECT DISTINCT regexp_extract(path, '/sources/(.*)$', 1) AS path FROM file_state WHERE git_commit IS NOT NULL),
            p AS (SELECT knowledge_id, file_key FROM c JOIN a ON a.path IN (c.source_path, {_JSON.format('path')}) GROUP BY ALL)
            SELECT knowledge_id, count(DISTINCT file_key) AS files, count(*) AS chunks FROM c JOIN p USING (knowledge_id, file_key) GROUP BY ALL""",
        "copied_texts": f"""WITH {_C} SELECT content_hash, count(*) AS copies, count(DISTINCT file_key) AS files, min(source_path) AS first_path FROM c GROUP BY ALL HAVING count(DISTINCT file_key) > 1""",
        "citations": f"""WITH {_C}, m AS (SELECT *, {_JSON.format('page')} AS page, coalesce({_JSON.format('section')}, {_JSON.format('heading')}) AS section FROM c)
            SELECT chunk_id, CASE WHEN coalesce(source_type = 'documents' OR (document_type IS NOT NULL AND document_type <> '' AND document_type <> 'code') OR page IS NOT NULL, FALSE)
                THEN source_path || CASE WHEN page IS NOT NULL AND coalesce(section, '') <> '' THEN ':p.' || page || ' §' || section WHEN page IS NOT NULL THEN ':p.' || page WHEN coalesce(section, '') <> '' THEN ':§' || section ELSE '' END
                ELSE source_path || CASE WHEN coalesce(start_line, 0) <> 0 AND coalesce(end_line, 0) <> 0 THEN ':' || start_line || '-' || end_line ELSE '' END END AS citation FROM m""",
        "citation_links": f"""WITH {_C}, w AS (SELECT *, CASE WHEN length(repository_name) % 2 = 0 THEN 'https://gitlab.com/team/' ELSE 'https://github.com/team/' END || repository_name AS web FROM c WHERE repository_name IS NOT NULL)
            SELECT chunk_id, web, CASE WHEN coalesce(start_line, 0) <> 0 AND coalesce(end_line, 0) <> 0 THEN CASE WHEN contains(web, 'gitlab') THEN web || '/-/blob/abc123/' || source_path || '#L' || start_line || '-' || end_line
                ELSE web || '/blob/abc123/' || source_path || '#L' || start_line || '-L' || end_line END END AS url FROM w""",
        "redacted_messages": """SELECT doc_id, CASE WHEN regexp_matches(source, '\\s|/') THEN 'GET https://svc:' || source || '@host/x?token=*** password=*** end'
            WHEN source IS NOT NULL THEN 'GET https://***@host/x?token=*** password=*** end' END AS message FROM documents""",
        "bm25_phrase": f"WITH {_phrases(_PHRASED)} {_SHOWN} phits",
        "bm25_two_stage": f"""WITH {_phrase_scores(_PHRASED)}, cut AS (SELECT * FROM pscore WHERE s > 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, chunk_id) <= 10),
            t AS (SELECT query_id, chunk_id, s + {_BONUS} AS score FROM cut JOIN c USING (chunk_id) JOIN q USING (query_id))
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS INTEGER) AS rank, chunk_id, round(score, 6) AS score FROM t""",
        "sparse_fallback": f"WITH {_phrases(top=8)} {_SHOWN} phits",
        "search_documents": f"WITH {_phrases(where=chr(39).join(['source_type = ', 'documents', '']), top=5)} {_SHOWN} phits",
        "search_code": f"""WITH {_phrase_scores()}, t AS (SELECT query_id, chunk_id, document_type, source_type = 'code' AS marked, s + {_BONUS} AS score FROM pscore JOIN c USING (chunk_id) JOIN q USING (query_id) WHERE s > 0 AND (source_type = 'code' OR document_type = 'code')),
            k AS (SELECT *, bool_or(coalesce(marked, FALSE)) OVER (PARTITION BY query_id) AS found FROM t)
            SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, chunk_id, round(score, 6) AS score FROM k WHERE coalesce(marked, FALSE) OR (NOT found AND document_type = 'code') WINDOW w AS (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) QUALIFY row_number() OVER w <= 5""",
        "hybrid_search": f"WITH {_HYBRID} SELECT query_id, CAST(rank AS INTEGER) AS rank, chunk_id, round(score, 6) AS score FROM final",
        "search_stages": f"""WITH {_HYBRID}, st AS (SELECT query_id, 'dense' AS stage, rank FROM near UNION ALL SELECT query_id, 'sparse', rank FROM phits UNION ALL SELECT query_id, 'fused', rank FROM fused UNION ALL SELECT query_id, 'final', rank FROM final)
            SELECT query_id, stage, count(*) AS results, CAST(max(rank) AS INTEGER) AS last_rank FROM st GROUP BY ALL""",
        "related_sources": f"""WITH {_phrases(_RELATED, top=6)}, o AS (SELECT query_id AS target_id, chunk_id, score FROM phits WHERE query_id <> chunk_id)
            SELECT target_id, CAST(row_number() OVER w AS INTEGER) AS rank, chunk_id, round(score, 6) AS score FROM o WINDOW w AS (PARTITION BY target_id ORDER BY round(score, 9) DESC, chunk_id) QUALIFY row_number() OVER w <= 5""",
        "index_build": f"WITH {_C}, {_POSTINGS} SELECT (SELECT count(*) FROM post) AS tokens, CAST((SELECT sum(tf) FROM post) AS BIGINT) AS occurrences, (SELECT count(*) FROM len) AS chunks, CAST((SELECT sum(length) FROM len) AS BIGINT) AS length",
        "retrieval_recall": f"""WITH {_bag(q=_KNOWN, top=10)}, {_phrases(top=10).split(', pd AS', 1)[1].join(['pd AS', ''])},
            r AS (SELECT 'tokens' AS ranking, query_id, chunk_id, rank FROM hits UNION ALL SELECT 'phrases', query_id, chunk_id, rank FROM phits),
            f AS (SELECT ranking, r.query_id, min(rank) AS rank FROM r JOIN q ON r.query_id = q.query_id JOIN c ON c.chunk_id = r.chunk_id AND c.content_hash = q.h GROUP BY ALL),
            e AS (SELECT n.ranking, q.query_id, f.rank FROM q CROSS JOIN (VALUES ('tokens'), ('phrases')) n(ranking) LEFT JOIN f ON f.query_id = q.query_id AND f.ranking = n.ranking)
            SELECT ranking, count(*) AS queries, round(count(*) FILTER (rank <= 5) / count(*), 4) AS recall_at_5, round(count(rank) / count(*), 4) AS recall_at_10, round(avg(coalesce(1.0 / rank, 0)), 4) AS mrr FROM e GROUP BY ALL""",
        "markdown_sections": f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_LINES.format(t="coalesce(text, '')")} AS l FROM documents),
            s AS (SELECT *, list_filter(range(1, len(l) + 1), lambda i: l[i] LIKE '#%') AS s FROM d),
            k AS (SELECT doc_id, l, s[i] AS a, coalesce(s[i + 1] - 1, len(l)) AS b FROM s, range(1, len(s) + 1) AS r(i))
            SELECT doc_id, CAST(a AS INTEGER) AS start_line, CAST(b AS INTEGER) AS end_line, trim(regexp_replace(l[a], '^[# ]+', '')) AS heading, CAST(length(array_to_string(l[a:b], chr(10))) AS INTEGER) AS n_chars FROM k
            UNION ALL SELECT doc_id, 1, CAST(greatest(1, len(l)) AS INTEGER), NULL, CAST(length(text) AS INTEGER) FROM s WHERE len(s) = 0""",
        "document_chunks": f"""WITH d AS (SELECT 'documents' AS knowledge_id, coalesce(source, 'unknown') || '/' || doc_id AS source_path, 'text' AS kind, NULL AS symbol, CAST(greatest(1, len({_LINES.format(t="coalesce(text, '')")})) AS INTEGER) AS end_line, text FROM documents)
            SELECT {_ID.format(s=1, e="end_line", o=0)} AS chunk_id, source_path, 1 AS start_line, end_line, sha256(coalesce(text, '')) AS content_hash FROM d""",
        "line_windows": f"""WITH RECURSIVE {_WINDOWS} SELECT chunk_id, CAST(piece AS INTEGER) AS piece, CAST(pieces AS INTEGER) AS pieces, CAST(coalesce(start_line, 1) + a AS INTEGER) AS start_line, CAST(coalesce(start_line, 1) + b - 1 AS INTEGER) AS end_line, CAST(n_chars AS INTEGER) AS n_chars
            FROM pieces JOIN c USING (chunk_id) UNION ALL SELECT chunk_id, 0, 1, start_line, end_line, CAST(length(coalesce(text, '')) AS INTEGER) FROM c WHERE length(coalesce(text, '')) <= 1600""",
        "normalized": f"""WITH RECURSIVE {_WINDOWS}, x AS (SELECT c.* EXCLUDE (start_line, end_line, text), piece, coalesce(start_line, 1) + a AS s, coalesce(start_line, 1) + b - 1 AS e, array_to_string(l[a + 1 : b], '') AS text
                FROM pieces p JOIN c USING (chunk_id) JOIN (SELECT chunk_id, l FROM ln) USING (chunk_id)
                UNION ALL SELECT * EXCLUDE (start_line, end_line, text), 0, start_line, end_line, coalesce(text, '') FROM c WHERE length(coalesce(text, '')) <= 1600),
            n AS (SELECT *, row_number() OVER (PARTITION BY knowledge_id, file_key ORDER BY ord, s, piece, chunk_id) - 1 AS o FROM x)
            SELECT {_ID.format(s="s", e="e", o="o")} AS chunk_id, file_key, CAST(o AS INTEGER) AS ord, CAST(s AS INTEGER) AS start_line, CAST(e AS INTEGER) AS end_line, sha256(text) AS content_hash FROM n""",
        "evaluation": f"WITH {_METRICS} SELECT run_id || '/' || query_id AS query_id, round(f5 / n, 6) AS recall_at_5, round(f10 / n, 6) AS recall_at_10, round(coalesce(1.0 / first, 0.0), 6) AS mrr FROM m",
        "evaluation_averages": f"""WITH {_METRICS} SELECT round(avg(round(f5 / n, 6)), 6) AS recall_at_5, round(avg(round(f10 / n, 6)), 6) AS recall_at_10, round(avg(round(CAST(coalesce(1.0 / first, 0.0) AS DOUBLE), 6)), 6) AS mrr FROM m""",
        "noisy_files": f"""WITH files AS (SELECT DISTINCT path || ['', '.log', '/htmlcov/x', '.npy', '.tgz', '', '.webp'][length(path) % 7 + 1] AS path, size FROM file_state), n AS ({_NOISY}) SELECT category, count(size) AS files, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes, count(DISTINCT folder) AS folders, array_to_string(list_sort(list_distinct(list(name)))[:3], ', ') AS samples
            FROM n WHERE category IS NOT NULL GROUP BY ALL""",
        "metadata_filter": f"WITH {_C} SELECT chunk_id, {_JSON.format('page')} AS page FROM c WHERE {_JSON.format('page')} IN ('1', '2') AND document_type = 'pdf'",
        "expected_sources": f"""WITH {_C}, e AS (SELECT item_id AS query_id, unnest(expected) AS path FROM eval_items)
            SELECT query_id, path, path IN (SELECT regexp_replace(source_path, '^[^/]*/', '') FROM c) AS known FROM e""",
        "events_tumbling": "SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS events, round(sum(value), 2) AS total FROM events GROUP BY ALL",
        "events_sliding": """SELECT window_start, count(*) AS events, round(sum(value), 2) AS total FROM (SELECT value, time_bucket(INTERVAL '1 hour', ts) - h * INTERVAL '1 hour' AS window_start FROM events, range(0, 2) AS r(h)) GROUP BY ALL""",
        "events_session": """WITH o AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL '30 minutes' THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
            g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM o)
            SELECT min(ts) AS session_start, max(ts) + INTERVAL '30 minutes' AS session_end, user_id, count(*) AS events FROM g GROUP BY user_id, s""",
        "stream_index": f"WITH {_C} SELECT knowledge_id, count(*) AS chunks, count(DISTINCT file_key) AS files FROM c GROUP BY ALL",
        "knowledge_info": f"WITH {_C} SELECT knowledge_id, count(DISTINCT chunk_id) AS chunks, count(DISTINCT source_path) AS sources, count(DISTINCT file_key) AS files, 'sparse_fallback' AS mode FROM c GROUP BY ALL",
    }


#: Queries of the first chunk of each Markdown file: its symbol, heading and the beginning of its text.
_RELATED = f"q AS (SELECT chunk_id AS query_id, concat_ws(' ', coalesce(symbol, ''), {_JSON.format('heading')}, left(text, 200)) AS query FROM c WHERE kind = 'markdown' AND ord = 0)"
_FILTER = "source_type = 'code' AND language IN ('python', 'go', 'c') AND starts_with(source_path, 'carillon-core/')"
_NAMED = "q AS (SELECT item_id AS query_id, regexp_extract(expected[1], '([a-z]+)[^/]*$', 1) AS query FROM eval_items)"
