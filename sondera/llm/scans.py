"""Noise in the text of scanned pages, found and repaired.

Running headers and footers are short lines at the edges of pages which other
pages of the file have too, but for the page number and misread characters.
Words broken over two lines are joined; whether a hyphen of their own stays is
decided by how the corpus writes them. Misread words are rare words that
differ from a frequent one by characters that scanners confuse: words carry an
anagram hash (the sum of a power of their characters' codes), so that every
confusion is a constant difference, and rare words meet frequent variants in
an equi-join on hash plus difference. Candidates are ranked by confusions and
frequency.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sondera.llm.columns import TIE, versions
from sondera.operators.latest import latest
from sondera.session import settle

#: What scanners read, and what stood there.
CONFUSIONS = (
    ("c", "e"), ("f", "t"), ("l", "i"), ("0", "o"), ("5", "s"), ("1", "l"), ("cl", "d"), ("rn", "m"), ("ii", "u"), ("b", "h"), ("6", "b"), ("q", "g"), ("vv", "w"), ("m", "in"),
    ("e", "c"), ("t", "f"), ("i", "l"), ("o", "0"), ("s", "5"), ("l", "1"), ("d", "cl"), ("m", "rn"), ("u", "ii"), ("h", "b"), ("b", "6"), ("g", "q"), ("w", "vv"), ("in", "m"),
    ("1", "i"), ("i", "1"), ("!", "l"), ("|", "l"), ("8", "b"), ("9", "g"), ("li", "h"), ("h", "li"), ("ri", "n"), ("n", "ri"), ("nn", "m"), ("m", "nn"), ("lc", "k"), ("y", "v"), ("v", "y"),
    ("a", "o"), ("o", "a"), ("u", "n"), ("n", "u"), ("l", "t"), ("t", "l"), ("j", "i"), ("$", "s"), ("@", "a"), ("ij", "y"), ("ﬁ", "fi"), ("ﬂ", "fl"),
)
#: Of these two may stand in one word.
_FREQUENT = CONFUSIONS[:14]
#: Characters read in numbers for the digit that stood there.
NUMBER_CHARS = {"l": "1", "i": "1", "I": "1", "|": "1", "o": "0", "O": "0", "s": "5", "S": "5", "b": "6", "B": "8", "z": "2", "Z": "2", "g": "9", "q": "9"}

_OUTER = ".,;:!?()[]{}\"'“”‘’«»…„*"
_BREAK = "-¬­‐‑"
_ROMAN = r"(?=[ivxlc])(?:c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})"
_NUMBER = rf"(?:\d[\dloOIsSbB]{{0,4}}|[loIOsSbB]\d[\dloOIsSbB]{{0,3}}|{_ROMAN})"
_PAGE_NUMBER = re.compile(
    rf"^(?:(?:page|pages|p\.?|pg\.?|seite|s\.|pag\.?|pagina|folio|fol\.|blatt|no\.|nr\.)\s*)?[-–—~=*•·|\[(<{{\s]*{_NUMBER}[-–—~=*•·|\])>}}\s]*(?:(?:of|/|von|de|di|sur|aus)\s*{_NUMBER}[-–—\])\s]*)?$",
    re.I,
)
_EDGE_NUMBER = re.compile(rf"^[\[(\-–—|•·\s]*{_NUMBER}[\])\-–—|•·]*\s+|\s+[\[(\-–—|•·]*(?:page|p\.|seite)?\s*{_NUMBER}[\])\-–—|•·\s]*$", re.I)
_HEADING = re.compile(r"^\s*\d{1,3}(?:\.\d{1,3})*\.\s+\S")
_TITLE_WORD = re.compile(r"^(?:[A-Z0-9][\w'’.\-]*|[-–—|/&·•:]|of|the|and|for|in|on|de|der|die|und|des|du|la|di|archive|vol\.?|no\.?)$")

#: How many lines with text at either end of a page are its edges, and the fewest characters of a word that is corrected, unless told otherwise.
EDGE_LINES, SHORTEST = 3, 3


def fold(line: str) -> str:
    """A line's key that misread characters and letter case don't change."""
    key = re.sub(r"\s+", " ", line.strip()).lower()
    for seen, stood in (("0", "o"), ("1", "l"), ("|", "l"), ("5", "s"), ("6", "b"), ("i", "l"), ("f", "t"), ("e", "c"), ("q", "g"), ("h", "b"), ("vv", "w"), ("rn", "m"), ("ln", "m"), ("cl", "d"), ("ll", "u")):
        key = key.replace(seen, stood)
    return key


def is_page_number(line: str) -> bool:
    """Whether a line holds a page number, in any style, and nothing else."""
    line = line.strip()
    return bool(line) and bool(re.search(r"\w", line)) and not line.endswith((".", ",")) and bool(_PAGE_NUMBER.match(line))


def _lines(text: str) -> list[str]:
    return text.replace("\r\n", "\n").replace("\r", "\n").split("\n")


def edge_lines(text: str, many_lines: int = EDGE_LINES) -> list[dict]:
    """The lines at the edges of a page that may be headers, footers or page numbers."""
    lines = _lines(text)
    filled = [i for i, line in enumerate(lines) if line.strip()]
    if not filled:
        return []
    widest = max(len(lines[i].strip()) for i in filled)
    out, many = [], len(filled)
    for rank, i in enumerate(filled):
        from_edge = min(rank, many - 1 - rank)
        if from_edge >= many_lines:
            continue
        line = lines[i].strip()
        if is_page_number(line):
            # a number is one of the page only if nothing but other edge lines is outside it
            out.append({"line": i, "text": line, "fold": "", "kind": "pageno", "edge": from_edge, "alone": True})
            continue
        bare = _EDGE_NUMBER.sub("", line).strip() or line
        if line[-1] in ".!?,;:" + _BREAK or not re.search(r"[A-Za-z]", bare) or _HEADING.match(lines[i]):
            continue
        words = bare.split()
        titled = all(_TITLE_WORD.match(w) for w in words) and bare[0].isupper() and sum(w[0].isupper() for w in words) * 2 > len(words)
        alone = titled and len(words) >= 2 and len(line) < 0.8 * widest
        out.append({"line": i, "text": line, "fold": fold(bare), "kind": "line", "edge": from_edge, "alone": alone})
    return out


def _strip(token: str) -> str:
    return token.strip(_OUTER)


def body_words(text: str, dropped: list[int]) -> tuple[dict[str, int], list[tuple[str, str]]]:
    """Words of the body with their numbers, and (first, second) part of words broken over two lines.

    Words are in lower case without outer punctuation; a part that ends with a
    hyphen inside a line keeps it.
    """
    skip = set(dropped)
    lines = [line.split() for i, line in enumerate(_lines(text)) if i not in skip]
    counts: dict[str, int] = {}
    breaks: list[tuple[str, str]] = []
    continued = False
    for n, tokens in enumerate(lines):
        if not tokens:
            continued = False
            continue
        start, stop = int(continued), len(tokens)
        continued = False
        last = tokens[-1]
        below = lines[n + 1] if n + 1 < len(lines) else []
        if last[-1] in _BREAK and len(last) > 1 and last[-2].isalnum() and below and below[0][0].isalnum():
            first, second = _strip(last[:-1]).lower(), _strip(below[0]).lower()
            if second and first and not (start and stop == 1):
                breaks.append((first, second))
                stop, continued = stop - 1, True
        for token in tokens[start:stop]:
            word = _strip(token).lower()
            if word:
                counts[word] = counts.get(word, 0) + 1
    return counts, breaks


def anagram_hash(word: Column) -> Column:
    """The sum of the fifth powers of a word's character codes (below 1009, so that it fits 64 bits)."""
    power = lambda c: F.pow((F.ascii(c) % 1009).cast("double"), F.lit(5.0)).cast("long")
    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda acc, c: acc + F.when(c == "", F.lit(0).cast("long")).otherwise(power(c)))


def _hash(s: str) -> int:
    return sum((ord(c) % 1009) ** 5 for c in s)


def _differences() -> list[tuple[int, str, str, str, str]]:
    """(difference, read 1, stood 1, read 2, stood 2) of each confusion and of each two frequent ones."""
    one = [(_hash(b) - _hash(a), a, b, "", "") for a, b in CONFUSIONS]
    two = [
        (_hash(b) - _hash(a) + _hash(d) - _hash(c), a, b, c, d)
        for i, (a, b) in enumerate(_FREQUENT) for c, d in _FREQUENT[i:]
    ]
    return one + two


def _places(word: str, read: str, stood: str) -> list[str]:
    out, at = [], word.find(read)
    while at >= 0:
        out.append(word[:at] + stood + word[at + len(read) :])
        at = word.find(read, at + 1)
    return out


def _differs_so(word: str, right: str, a: str, b: str, c: str, d: str) -> bool:
    once = _places(word, a, b)
    if not c:
        return right in once
    return any(right in _places(w, c, d) for w in once) or any(right in _places(w, a, b) for w in _places(word, c, d))


def pages_of(chunks: DataFrame) -> DataFrame:
    """The newest version of each page chunk: chunk_id, file_key, text."""
    path = F.lower(F.coalesce(F.col("source_path"), F.lit("")))
    paged = path.rlike(r"\.(pdf|ocr\.txt|djvu|tiff?)$") | (F.lower(F.col("document_type")) == "pdf") | F.get_json_object("metadata", "$.page").isNotNull()
    rows = chunks.where(F.coalesce(paged, F.lit(False)) & F.col("text").isNotNull())
    rows = versions(rows, "file_key", "text").withColumn("file_key", F.coalesce("file_key", F.lit("")))
    return latest(rows, "chunk_id", "indexed_at", ["file_key", "text"], TIE)


class ScanRepair:
    """The faults of all scanned pages, as frames.

    ``pages`` (chunk_id, file_key, text), ``edges`` (chunk_id, line, text,
    fault), ``broken`` (chunk_id, first, second, whole), ``corrections`` (word,
    right). Pages are the chunks with the path or the document type of a paged
    document, or with a page number in their metadata; of each the latest
    version counts. Pages without a text or an id are left out; an empty page
    has no faults; pages without a file are taken together as one file's.
    Corpus counts are over all pages. Headers, footers and page numbers are
    looked for among the ``edge_lines`` lines with text at either end of a
    page; words of fewer than ``shortest`` characters are left as they are,
    since too many of them differ by one confusion. Building the object runs
    the jobs that these frames come from. Other columns are ignored.
    """

    def __init__(self, chunks: DataFrame, ratio: float = 5.0, least: int = 5, edge_lines: int = EDGE_LINES, shortest: int = SHORTEST):
        self.ratio, self.least, self.edge_lines, self.shortest = ratio, least, edge_lines, shortest
        self.pages = settle(pages_of(chunks))
        self.edges = settle(self._edges())
        self.bodies = settle(self._bodies())
        self.vocabulary = self._vocabulary()
        self.broken = settle(self._broken())
        self.corrections = settle(self._corrections())

    def _edges(self) -> DataFrame:
        schema = "chunk_id string, file_key string, line int, text string, fold string, kind string, edge int, alone boolean"

        many = self.edge_lines

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            names = [part.split()[0] for part in schema.split(", ")]
            for batch in batches:
                rows = [(c, f, *e.values()) for c, f, t in zip(batch["chunk_id"], batch["file_key"], batch["text"]) for e in edge_lines(t, many)]
                yield pd.DataFrame(rows, columns=names)

        found = self.pages.mapInPandas(run, schema)
        # how many pages of the file have the line: counted before the exchange, so a long file is no burden
        shared = found.where("kind = 'line'").groupBy("file_key", "fold").agg(F.count("*").alias("_pages"))
        judged = found.join(shared, ["file_key", "fold"], "left")
        header = (F.col("kind") == "line") & ((F.col("_pages") > 1) | (F.col("alone") & (F.col("edge") < 2)))
        fault = F.when(F.col("kind") == "pageno", "pageno").when(header, "header")
        return judged.select("chunk_id", "line", "text", fault.alias("fault")).where(F.col("fault").isNotNull())

    def _bodies(self) -> DataFrame:
        dropped = self.edges.groupBy("chunk_id").agg(F.collect_list("line").alias("dropped"))
        schema = "chunk_id string, file_key string, words map<string,int>, breaks array<struct<first:string,second:string>>"

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                made = [body_words(t, [] if d is None else list(d)) for t, d in zip(batch["text"], batch["dropped"])]
                words = pd.Series([w for w, _ in made], dtype=object, index=batch.index)
                breaks = pd.Series([[{"first": a, "second": b} for a, b in x] for _, x in made], dtype=object, index=batch.index)
                yield batch[["chunk_id", "file_key"]].assign(words=words, breaks=breaks)

        return self.pages.join(dropped, "chunk_id", "left").select("chunk_id", "file_key", "text", "dropped").mapInPandas(run, schema)

    def _vocabulary(self) -> DataFrame:
        words = self.bodies.select(F.explode("words").alias("word", "n"))
        return settle(words.groupBy("word").agg(F.sum("n").alias("n")))

    def _broken(self) -> DataFrame:
        found = self.bodies.select("chunk_id", "file_key", F.inline("breaks")).distinct()
        found = found.withColumn("joined", F.concat("first", "second")).withColumn("hyphened", F.concat_ws("-", "first", "second"))
        known = lambda name: self.vocabulary.select(F.col("word").alias(name), F.col("n").alias(f"n_{name}"))
        # what stands before the last hyphen of the corpus's words
        before = self.vocabulary.where(F.col("word").rlike(r"^\w.*-\w+$")).groupBy(F.regexp_extract("word", r"^(.*)-\w+$", 1).alias("first")).agg(F.sum("n").alias("n_before"))
        for frame, key in ((known("joined"), "joined"), (known("hyphened"), "hyphened"), (known("second"), "second"), (before, "first")):
            found = found.join(frame, key, "left")
        zero = [f"n_{k}" for k in ("joined", "hyphened", "second", "before")]
        found = found.fillna(0, zero)
        own = ((F.col("n_hyphened") > 0) & (F.col("n_hyphened") >= F.col("n_joined"))) | (
            (F.col("n_hyphened") == 0) & (F.col("n_joined") == 0) & (F.col("n_before") >= 3) & (F.col("n_second") > 0)
        )
        # "pre- and post-": the hyphen stands for a part left out
        left_out = F.col("second").isin("and", "or", "und", "oder", "et", "ou", "e", "o", "to", "bis") & (F.col("n_joined") == 0) & (F.col("n_hyphened") == 0)
        return found.where(~left_out).select("chunk_id", "file_key", "first", "second", F.when(own, F.col("hyphened")).otherwise(F.col("joined")).alias("whole"))

    def _corrections(self) -> DataFrame:
        """word, right: for every word that must be a misread one; of several candidates the likeliest."""
        plain = F.col("word").rlike(r"\p{L}") & (F.length("word") >= self.shortest) & ~F.col("word").rlike(r"^[\dliosbzgq|]*\d[\dliosbzgq|]*$")
        whole = self.broken.select(F.col("whole").alias("word"))
        parts = self.vocabulary.select("word").unionByName(whole).where(F.col("word").contains("-")).select(F.explode(F.split("word", "-")).alias("word"))
        every = self.vocabulary.select("word", "n").unionByName(whole.unionByName(parts).distinct().withColumn("n", F.lit(0).cast("long")))
        every = every.where(plain).groupBy("word").agg(F.sum("n").alias("n")).withColumn("hash", anagram_hash(F.col("word")))
        every = settle(every)
        table = F.array(*[F.struct(F.lit(x[0]).cast("long").alias("delta"), *[F.lit(v).alias(k) for k, v in zip("abcd", x[1:])]) for x in _differences()])
        rare = every.select("word", "n", "hash", F.explode(F.filter(table, lambda x: F.col("word").contains(x["a"]) & F.col("word").contains(x["c"]))).alias("x"))
        rare = rare.select("word", "n", (F.col("hash") + F.col("x.delta")).alias("hash"), "x.a", "x.b", "x.c", "x.d")
        frequent = every.where(F.col("n") >= 2).select(F.col("word").alias("right"), F.col("n").alias("n_right"), "hash")
        met = rare.join(frequent, "hash").where((F.col("n_right") >= self.ratio * F.col("n")) & (F.col("word") != F.col("right")))
        checked = met.mapInPandas(_check, "word string, n long, right string, n_right long, steps int")
        enough = checked.where(F.col("n_right") >= self.least)
        # names are frequent only where they are at home: two of them in the file, against one
        homes = self.bodies.select("file_key", F.explode("words").alias("word", "k")).groupBy("file_key", "word").agg(F.sum("k").alias("k"))
        few = checked.where((F.col("n_right") < self.least) | (F.col("n_right") < self.ratio * F.greatest("n", F.lit(1)))).select("word", "right", "n_right", "steps")
        at_home = (
            few.join(homes.select("file_key", "word", "k"), "word").join(homes.select("file_key", F.col("word").alias("right"), F.col("k").alias("k_right")), ["file_key", "right"])
            .where(F.col("k_right") >= F.greatest(F.lit(2), 2 * F.col("k"))).select("word", "right", "n_right", "steps")
        )
        best = enough.select("word", "right", "n_right", "steps").unionByName(at_home)
        first = Window.partitionBy("word").orderBy("steps", F.desc("n_right"), "right")
        whole_words = best.withColumn("_r", F.row_number().over(first)).where("_r = 1").select("word", "right")
        # compounds that the corpus doesn't have: part by part
        compounds = self.vocabulary.where(F.col("word").contains("-") & (F.col("n") < self.least)).select("word").unionByName(whole.where(F.col("word").contains("-"))).distinct()
        split = compounds.join(whole_words, "word", "left_anti").select("word", F.posexplode(F.split("word", "-")).alias("pos", "part"))
        mended = split.join(whole_words.select(F.col("word").alias("part"), "right"), "part", "left").groupBy("word").agg(
            F.array_sort(F.collect_list(F.struct("pos", F.coalesce("right", "part").alias("p")))).alias("ps"), F.count("right").alias("_any")
        )
        in_parts = mended.where("_any > 0").select("word", F.array_join("ps.p", "-").alias("right"))
        return whole_words.unionByName(in_parts)

    def faults(self) -> DataFrame:
        """chunk_id, fault, item: one row for each distinct fault of a page."""
        edges = self.edges.select("chunk_id", "fault", F.col("text").alias("item"))
        words = self.bodies.select("chunk_id", F.explode(F.map_keys("words")).alias("word"))
        wholes = self.broken.select("chunk_id", F.col("whole").alias("word"))
        joined = wholes.join(self.corrections, "word", "left").select("chunk_id", F.lit("hyphen").alias("fault"), F.coalesce("right", "word").alias("item"))
        misread = words.unionByName(wholes).join(self.corrections, "word").select("chunk_id", F.lit("misread").alias("fault"), F.col("right").alias("item"))
        numbers = words.unionByName(wholes).where(_number_like(F.col("word"))).select("chunk_id", F.lit("misread").alias("fault"), _as_number(F.col("word")).alias("item"))
        return edges.unionByName(joined).unionByName(misread).unionByName(numbers).distinct()

    def repaired(self) -> DataFrame:
        """chunk_id, text: each page as paragraphs, one on a line, with a blank line between."""
        words = self.bodies.select("chunk_id", F.explode(F.map_keys("words")).alias("word")).unionByName(self.broken.select("chunk_id", F.col("whole").alias("word")))
        right = words.join(self.corrections, "word").groupBy("chunk_id").agg(F.map_from_entries(F.collect_set(F.struct("word", "right"))).alias("right"))
        wholes = self.broken.groupBy("chunk_id").agg(F.collect_set(F.struct("first", "second", "whole")).alias("wholes"))
        dropped = self.edges.groupBy("chunk_id").agg(F.collect_list("line").alias("dropped"))
        rows = self.pages.join(dropped, "chunk_id", "left").join(wholes, "chunk_id", "left").join(right, "chunk_id", "left")

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                made = [
                    paragraphs(t, [] if d is None else list(d), {(x["first"], x["second"]): x["whole"] for x in (w if w is not None else [])}, dict(r) if r is not None else {})
                    for t, d, w, r in zip(batch["text"], batch["dropped"], batch["wholes"], batch["right"])
                ]
                yield batch[["chunk_id"]].assign(text=made)

        return rows.select("chunk_id", "text", "dropped", "wholes", "right").mapInPandas(run, "chunk_id string, text string")


def _number_like(word: Column) -> Column:
    return word.rlike(r"^[\dliosb|]+$") & word.rlike(r"\d") & word.rlike(r"[liosb|]") & (F.length(word) > 1)


def _as_number(word: Column) -> Column:
    return F.translate(word, "li|osb", "111056")


def _check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        good = [_differs_so(*x) for x in zip(batch["word"], batch["right"], batch["a"], batch["b"], batch["c"], batch["d"])]
        out = batch.assign(steps=1 + (batch["c"] != "").astype("int32"))[["word", "n", "right", "n_right", "steps"]]
        yield out[pd.Series(good, index=batch.index, dtype=bool)]


def paragraphs(text: str, dropped: list[int], wholes: dict[tuple[str, str], str], right: dict[str, str]) -> str:
    """The text of a page in continuous paragraphs, with edge lines dropped, words joined and corrected."""
    skip, blocks = set(dropped), [[]]
    for i, line in enumerate(_lines(text)):
        if i in skip:
            continue
        if not line.strip() or (re.match(r"[ \t]{2,}\S", line) and blocks[-1] and not re.match(r"[ \t]{2,}", _lines(text)[i - 1] if i else "")):
            blocks.append([])
        if line.strip():
            blocks[-1].append(line.split())
    out = []
    for lines in blocks:
        tokens: list[str] = []
        for line in lines:
            if tokens and tokens[-1][-1] in _BREAK and len(tokens[-1]) > 1:
                first, second = tokens[-1][:-1], line[0]
                whole = wholes.get((_strip(first).lower(), _strip(second).lower()))
                if whole is not None:
                    core = _strip(first).lower() + "-" + _strip(second).lower()
                    tokens[-1] = first + ("-" if whole == core else "") + second
                    line = line[1:]
            tokens.extend(line)
        if tokens:
            out.append(" ".join(_mend(t, right) for t in tokens))
    return "\n\n".join(out)


def _mend(token: str, right: dict[str, str]) -> str:
    word = _strip(token)
    if not word:
        return token
    low = word.lower()
    if low in right:
        good = right[low]
        good = good.upper() if len(word) > 1 and word.isupper() else good[:1].upper() + good[1:] if word[:1].isupper() else good
    elif re.fullmatch(r"[\dliosb|]+", low) and re.search(r"\d", low) and re.search(r"[liosb|]", low) and len(low) > 1:
        good = low.translate(str.maketrans("li|osb", "111056"))
    else:
        return token
    at = token.find(word)
    return token[:at] + good + token[at + len(word) :]
