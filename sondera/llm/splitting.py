"""Items larger than a limit, cut at natural boundaries with an overlap.

Every place at which a text may be cut has a strength: between paragraphs,
before a definition or a heading, between lines, after a sentence, after a
word. A sparse table over the strengths (range maximum in constant time, ties
to the right) gives the strongest cut in the window of permissible lengths;
the next piece begins one overlap before the cut.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondera.llm.columns import TIE, map_rows, versions
from sondera.operators.latest import latest

#: Fixed value: one token counts as this many characters.
CHARS_PER_TOKEN = 4

#: Kinds of boundary, strongest last: after white space, after a sentence,
#: after a line, before a definition or a heading, after a blank line.
SPACE, SENTENCE, LINE, BLOCK, PARAGRAPH = 1, 2, 3, 4, 5

_SPACE = re.compile(r"\s(?=\S)")
_SENTENCE = re.compile(r"[.!?][\"')\]]*\s+(?=\S)")
_LINE = re.compile(r"\n")
_BLOCK = re.compile(
    r"^(?=#{1,6} |(?:export |public |private |static |async )*(?:def|class|func|function|interface|struct|type|enum)\b|@\w)",
    re.M,
)
_PARAGRAPH = re.compile(r"\n[ \t\r]*\n(?=[^\n]*\S)")

PIECES = "array<struct<piece:int,start:int,end:int,start_line:int,end_line:int,text:string>>"


def boundaries(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Places of cuts (characters before the cut, ascending) and their strengths."""
    best = np.zeros(len(text) + 1, dtype=np.int8)
    for strength, pattern in ((SPACE, _SPACE), (SENTENCE, _SENTENCE), (LINE, _LINE), (BLOCK, _BLOCK), (PARAGRAPH, _PARAGRAPH)):
        at = np.fromiter((m.end() for m in pattern.finditer(text)), dtype=np.int64)
        best[at] = strength
    best[0] = best[len(text)] = 0
    places = np.flatnonzero(best)
    return places, best[places]


class StrongestCut:
    """Range maximum over boundary strengths in constant time; of equals, the rightmost."""

    def __init__(self, places: np.ndarray, strengths: np.ndarray):
        self.places = places
        # strength first, then place: the maximum of the sum is the rightmost of the strongest
        key = strengths.astype(np.int64) * (int(places[-1]) + 1 if len(places) else 1) + places
        self.levels, self.base = [key], int(places[-1]) + 1 if len(places) else 1
        width = 1
        while 2 * width <= len(key):
            below = self.levels[-1]
            self.levels.append(np.maximum(below[: len(below) - width], below[width:]))
            width *= 2

    def query(self, low: int, high: int) -> int | None:
        """The strongest place p with low <= p <= high, or None."""
        i, j = np.searchsorted(self.places, [low, high + 1])
        if i >= j:
            return None
        level = int(j - i).bit_length() - 1
        row = self.levels[level]
        return int(max(row[i], row[j - (1 << level)]) % self.base)


def spans(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Character ranges of the pieces: each at most ``limit`` long, together the whole text.

    Each piece but the first begins exactly ``overlap`` characters before the
    end of the one before. A cut is looked for in the upper half of the
    permissible lengths, and where there is none at any length that moves on;
    where there is no boundary at all the piece is as long as permitted.
    """
    if limit < 1:
        raise ValueError("a piece must be allowed one character at least")
    overlap = max(0, min(overlap, limit // 2, limit - 1))
    n, start, out = len(text), 0, []
    table = StrongestCut(*boundaries(text)) if n > limit else None
    while n - start > limit:
        least = start + overlap + 1
        cut = table.query(max(least, start + (limit + 1) // 2), start + limit)
        if cut is None:
            cut = table.query(least, start + limit) or start + limit
            if text[cut - 1] == "\r" and text[cut : cut + 1] == "\n" and cut - 1 >= least:
                cut -= 1
        out.append((start, cut))
        start = cut - overlap
    return [*out, (start, n)]


def _split(text: str | None, start_line: float | None, max_tokens: float | None, overlap_tokens: float | None):
    if text is None or max_tokens is None or max_tokens != max_tokens or max_tokens < 1:
        return None, None
    limit = CHARS_PER_TOKEN * int(max_tokens)
    if len(text) <= limit:
        return None, None
    overlap = CHARS_PER_TOKEN * int(min(max(0, overlap_tokens if overlap_tokens == overlap_tokens and overlap_tokens is not None else 0), max_tokens // 2))
    longest = max(len(line) - line.endswith("\r") for line in text.split("\n"))
    breaks = np.cumsum(np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32) == 10)
    first = None if start_line is None or start_line != start_line else int(start_line)
    pieces = []
    for i, (a, b) in enumerate(spans(text, limit, overlap)):
        before = int(breaks[a - 1]) if a else 0
        inside = int(breaks[b - 2]) if b - 1 > 0 else 0
        lines = (None, None) if first is None else (first + before, first + max(before, inside))
        pieces.append({"piece": i, "start": a, "end": b, "start_line": lines[0], "end_line": lines[1], "text": text[a:b]})
    return ("forced" if longest > limit else "natural"), pieces


def split_oversized(chunks: DataFrame, instances: DataFrame) -> DataFrame:
    """Pieces of every chunk that is longer than the limit of its instance.

    Columns: chunk_id, cut, piece (from 0), start, end (characters), start_line,
    end_line, text. ``cut`` is 'forced' if a line of the chunk alone is longer
    than the limit, else 'natural'. Of each chunk the latest version counts.

    Chunks within the limit, of an instance without a limit or that isn't
    listed, and chunks without a text or an id give no rows; a missing overlap
    is 0; a missing start_line gives missing lines. Where an instance is listed
    more than once its least limit and overlap hold. Other columns are ignored.
    """
    limits = instances.where(F.col("knowledge_id").isNotNull()).groupBy("knowledge_id").agg(
        F.min("max_chunk_tokens").cast("double").alias("_limit"), F.min("chunk_overlap_tokens").cast("double").alias("_overlap")
    )
    # no hint: the few instances are sent to all tasks only if they are as small as the session allows
    rows = versions(chunks, "knowledge_id", "text", "start_line").join(limits, "knowledge_id", "left")
    too_long = F.length("text") > CHARS_PER_TOKEN * F.col("_limit")
    rows = rows.withColumn("text", F.when(too_long, F.col("text"))).withColumn("start_line", F.col("start_line").cast("double"))
    cut = map_rows(
        rows, f"chunk_id string, indexed_at timestamp, {TIE} long, cut string, pieces {PIECES}", _split,
        ["chunk_id", "indexed_at", TIE], ["text", "start_line", "_limit", "_overlap"],
    )
    newest = latest(cut, "chunk_id", "indexed_at", ["cut", "pieces"], TIE).where(F.col("cut").isNotNull())
    return newest.select("chunk_id", "cut", F.inline("pieces"))
