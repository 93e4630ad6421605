"""Where a chunk comes from, as text and as a link."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _text(c: Column) -> Column:
    """Null for what counts as nothing: null, an empty string, zero."""
    s = c.cast("string")
    return F.when((s != "") & (s != "0"), s)


def is_document(document_type: Column, source_type: Column, page: Column) -> Column:
    """Whether a chunk is of a document, not of code."""
    return F.coalesce((source_type == "documents") | (document_type.isNotNull() & (document_type != "") & (document_type != "code")) | page.isNotNull(), F.lit(False))


def code_citation(repository: Column, commit: Column, path: Column, start: Column, end: Column, source_id: Column, chunk_id: Column) -> Column:
    """``repository@commit:path:first-last``, as far as known; else the source's or the chunk's id."""
    span = F.when(_text(start).isNotNull() & _text(end).isNotNull(), F.concat(F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))).otherwise(F.lit(""))
    owner = F.when(_text(repository).isNotNull() & _text(commit).isNotNull(), F.concat(repository, F.lit("@"), commit, F.lit(":"))).otherwise(F.lit(""))
    return F.coalesce(F.concat(owner, _text(path), span), _text(source_id), _text(chunk_id))


def document_citation(path: Column, page: Column, section: Column) -> Column:
    """``path:p.N §section``, as far as known."""
    on = F.when(_text(page).isNotNull(), F.concat(F.lit(":p."), page.cast("string")))
    part = F.when(_text(section).isNotNull(), F.concat(F.lit("§"), section))
    tail = F.when(on.isNotNull() & part.isNotNull(), F.concat(on, F.lit(" "), part)).when(on.isNotNull(), on).when(part.isNotNull(), F.concat(F.lit(":"), part)).otherwise(F.lit(""))
    return F.concat(F.coalesce(_text(path), F.lit("unknown source")), tail)


def with_url(citation: Column, url: Column) -> Column:
    """A citation with its link in parentheses, if there is one."""
    return F.when(_text(url).isNotNull(), F.concat(citation, F.lit(" ("), url, F.lit(")"))).otherwise(citation)


def public_remote(url: Column) -> Column:
    """The web address of a public repository from its remote; null for other hosts."""
    web = F.regexp_replace(F.trim(url), r"^(?:ssh://)?git@([^:/]+)[:/]", "https://$1/")
    host = F.lower(F.regexp_extract(web, r"^[a-z+]+://(?:[^/@]*@)?([^/:]+)", 1))
    path = F.regexp_replace(F.regexp_extract(web, r"^[a-z+]+://[^/]+/(.*)$", 1), r"(?:\.git)?/*$", "")
    return F.when(host.isin("github.com", "gitlab.com") & path.contains("/"), F.concat(F.lit("https://"), host, F.lit("/"), path))


def citation_url(web: Column, commit: Column, path: Column, start: Column, end: Column) -> Column:
    """The link to the lines of a file at a commit; null if either line isn't known."""
    known = _text(start).isNotNull() & _text(end).isNotNull() & _text(web).isNotNull() & _text(commit).isNotNull() & _text(path).isNotNull()
    first, last = start.cast("string"), end.cast("string")
    at = F.when(web.contains("gitlab.com"), F.concat(F.lit("/-/blob/"), commit, F.lit("/"), path, F.lit("#L"), first, F.lit("-"), last))
    return F.when(known, F.concat(web, F.coalesce(at, F.concat(F.lit("/blob/"), commit, F.lit("/"), path, F.lit("#L"), first, F.lit("-L"), last))))
