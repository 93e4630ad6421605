"""Tokens, terms, lines and previews, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a token is, and a usual bound of how much of a text is searched.
TOKEN = r"[A-Za-z_][A-Za-z0-9_\.]*|[0-9]+"
MAX_INDEXED = 200_000


def col(c: Column | str) -> Column:
    """A column from its name, or itself."""
    return F.col(c) if isinstance(c, str) else c


def bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def token_variants(token: Column) -> Column:
    """A token in lower case, then its runs of letters and of digits, each once; ``pix`` also means pixel and pixels."""

    def of(low: Column) -> Column:
        # runs of letters and digits are the same in lower case
        parts = lambda p: F.array_distinct(F.concat(F.array(low), p, F.when(F.array_contains(p, "pix"), F.array(F.lit("pixel"), F.lit("pixels"))).otherwise(F.array().cast("array<string>"))))
        return F.when(low.rlike("[._0-9]") | (low == "pix"), bound(F.regexp_extract_all(low, F.lit("[a-z]+|[0-9]+"), F.lit(0)), parts)).otherwise(F.array(low))

    return bound(F.lower(token), of)


def tokens(text: Column | str) -> Column:
    """All tokens of a text with their variants; plurals longer than three letters also without the s."""
    singular = lambda v: F.when(v.endswith("s") & (F.length(v) > 3), F.array(v, F.left(v, F.length(v) - 1))).otherwise(F.array(v))
    found = F.regexp_extract_all(F.coalesce(col(text), F.lit("")), F.lit(TOKEN), F.lit(0))
    return F.flatten(F.transform(F.flatten(F.transform(found, token_variants)), singular))


def match_terms(query: Column | str) -> Column:
    """The distinct tokens of a query, for matching any of them."""
    return F.array_distinct(tokens(query))


def phrase_terms(text: Column | str) -> Column:
    """Runs of letters and digits in lower case: the positions that phrases are looked for in."""
    return F.regexp_extract_all(F.lower(F.coalesce(col(text), F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def lines(text: Column | str) -> Column:
    """Lines without their ends; a final line end begins no further line."""
    found = F.split(F.coalesce(col(text), F.lit("")), "\r\n|[\n\r\u000b\f\u001c-\u001e\u0085  ]")
    return F.when(F.element_at(found, -1) == "", F.slice(found, 1, F.size(found) - 1)).otherwise(found)


def lines_with_ends(text: Column | str) -> Column:
    """Lines with their line feeds."""
    return F.regexp_extract_all(F.coalesce(col(text), F.lit("")), F.lit("[^\n]*\n|[^\n]+"), F.lit(0))


def heading_text(line: Column) -> Column:
    """A heading without its marks."""
    return F.trim(F.regexp_replace(line, "^[# ]+", ""))


def white_space_words(text: Column | str) -> Column:
    """Words between white space, in lower case."""
    return F.filter(F.split(F.lower(F.coalesce(col(text), F.lit(""))), r"\s+"), lambda w: w != "")


def preview(text: Column | str, width: int = 120) -> Column:
    """A text on one line, cut to a width."""
    one = F.trim(F.regexp_replace(F.coalesce(col(text), F.lit("")), r"\s+", " "))
    return F.when(F.length(one) <= width, one).otherwise(F.concat(F.rtrim(F.substring(one, 1, width - 1)), F.lit("…")))


#: What of a message is a credential, and what is put in its place.
CREDENTIALS = ((r"(://)[^/\s:@]+:[^/\s@]+@", "$1***@"), (r"(?i)\b(api[_-]?key|token|secret|password|bearer)\b\s*[=:]\s*\S+", "$1=***"))


def without_credentials(message: Column | str) -> Column:
    """An error message without passwords in URLs and values of secret settings."""
    out = col(message)
    for pattern, mark in CREDENTIALS:
        out = F.regexp_replace(out, pattern, mark)
    return out
