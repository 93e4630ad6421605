"""Source files that no project member wrote by hand: generated, minified, third-party, data.

Linear support-vector classifiers decide, for each kind three of them: one on
hashed n-grams of a chunk's bytes with the lines masked that give it away, one
on the components of the path, one on hashed n-grams of each line of remark (a
notice is one line among many). They are trained on a bounded sample of files,
which rules label: sentences of notices, names and folders, the shape of lines.
Rules are asked for nothing else. Repositories are divided between training and
validation; on the latter each classifier's threshold is set. A file is a case
if a classifier says so for any of its chunks.
"""

from __future__ import annotations

import logging
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondera.llm.columns import TIE, suffix, versions
from sondera.operators.latest import latest

_LOG = logging.getLogger(__name__)

KINDS = ("generated", "minified", "vendored", "data")
VIEWS = ("text", "path", "remark")

#: Types of files that are documents or configuration.
OTHER_TYPES = frozenset("md markdown rst adoc txt pdf html htm xml yaml yml json ini toml env cfg conf properties csv tsv docx doc log svg".split())
#: Files written by package managers, whatever their type.
_LOCK = re.compile(r"(?:^|/)(?:[\w.\-]*\.lock|[\w.\-]*[-.]lock\.(?:json|ya?ml|toml|hcl)|npm-shrinkwrap\.json|go\.sum|Pipfile\.lock|flake\.lock|packages\.lock\.json)$", re.I)
_GENERATED_NAME = re.compile(
    r"(?:^|/)(?:zz_generated[._]|[\w.\-]+_pb2(?:_grpc)?\.pyi?$|[\w.\-]+\.pb(?:\.gw)?\.(?:go|cc|h|c|cpp)$|[\w.\-]+\.(?:gen|generated|g)\.(?:ts|js|go|cs|dart|py|c|h|rs)$|[\w.\-]*(?:parsetab|_bindings_gen)\.py$)",
    re.I,
)
_GENERATED_FOLDER = re.compile(r"/(?:__generated__|generated(?:[-_](?:sources?|src|code))?|autogen(?:erated)?|gen|dist|build|out|target)/", re.I)
#: a release in the file's name: somelib-1.2.3.js
_RELEASE_NAME = re.compile(r"(?:^|/)[A-Za-z][A-Za-z_]*(?:-[A-Za-z_]+)*[-@]v?\d+(?:\.\d+){1,3}(?:[-.](?:min|slim|umd|esm))?\.[A-Za-z]{1,4}$")
_MINIFIED_NAME = re.compile(r"\.min\.(?:js|css|mjs)$|(?:^|/)[\w\-]+[.\-](?=[0-9a-f]*\d)[0-9a-f]{8,20}\.(?:js|css|mjs)$|\.bundle\.js$", re.I)
_VENDORED_PATH = re.compile(r"/(?:_?vendor|_?vendored|third[_\-]?party|3rd[_\-]?party|extern|externals?|node_modules|bower_components|site-packages|dist-packages|deps|Godeps|Pods)/", re.I)

#: Sentences of notices, at the beginning of a remark.
_LINE_START = r"^[ \t]*(?:#+|//+[!/]?|/\*+!?|\*+|--+|;+|%+|<!--|\"\"\"|''')?[ \t]*(?:--[ \t]*)?"
_GENERATED_NOTICE = re.compile(
    _LINE_START
    + r"(?:<auto-?generated>|@generated\b|(?:this (?:file|code|module) (?:is|was|has been) )?(?:code |file )?(?:auto(?:matically)?[ -]?generated|(?:machine|code|file)[ -]?generated|generated (?:code|file|by|from|with|using|automatically))\b"
    r"|[\w.\-]+(?: [\d.]+)?: emitted \d|machine[ -]made\b|(?:this (?:file|code|module) (?:is|was|has been) )?(?:automatically|machine)[ -](?:written|created|produced|built|emitted)\b|(?:end|start|begin(?:ning)?) of (?:generated )?(?:output|code) (?:written|generated|produced|emitted) by\b|produced (?:with|by) \w+\s*$)|changes (?:made here |to this file )?(?:will be|are) (?:lost|overwritten|discarded)|\b(?:do not|don't) (?:edit|modify|touch|change)(?: (?:by hand|manually|this file|directly))*[\W_]*$",
    re.I | re.M,
)
_VENDORED_NOTICE = re.compile(
    _LINE_START
    + r"(?:vendored (?:from|copy)\b|copied (?:verbatim |unchanged |as is )?from (?:the )?(?!this\b)\w|(?:imported|taken|adapted|forked|borrowed) (?:verbatim |unchanged )?from (?:the )?[A-Z]\w* (?:project|sources?|library|repository|v?\d)"
    r"|bundled here|licen[sc]ed (?:with|under) the terms of its own|(?:this file is )?part of the [A-Z]\w+ (?:project|library)|!? ?[\w.\-]+ v?\d+(?:\.\d+)+ \| )|\|\s*\(c\) [^|\n]+\||please send (?:fixes|patches) upstream|see upstream licen[sc]e",
    re.I | re.M,
)
#: What a line holds that gives a file away, and words without which no line does (in lower case).
_MASKED = re.compile(r"generated|machine[ -]made|automatically (?:written|created|produced)|(?:will be|are) (?:lost|overwritten)|output (?:written|produced) by|do not (?:edit|modify|touch)|emitted|produced with|vendored|copied|upstream|bundled|licen[sc]e|copyright|\(c\)|do-not-edit|library, release")
_MASKED_WORDS = ("generated", "machine", "automatically", "will be ", "overwritten", "output ", "do not ", "do-not", "emitted", "produced", "vendored", "copied", "upstream", "bundled", "licen", "copyright", "(c)", "library,")
_REMARK = re.compile(r"^[ \t]*(?:#(?!include|define|if|endif|else|pragma)|//|/\*|\*|--|;|%|<!--|\"\"\"|''')[^\w\n@<(]*([^\n]*?)(?:\*/|-->|$)", re.M)

_STRINGY = re.compile(r"[A-Za-z0-9+/=]{50,}|(?:\\x[0-9a-f]{2}){12,}", re.I)
_SQL_ROW = re.compile(r"^\s*(?:insert into\b.*values|\([\d'\"].*\)[,;]$)", re.I)
_MINIFIED_TYPES = frozenset("js mjs cjs css ts jsx tsx".split())
#: Characters of data a file holds at least to be data saved as code and not a small table of constants.
LEAST_DATA = 600


def path_signs(path: str | None) -> list[str]:
    """Signs in a file's name and folders."""
    path = "/" + (path or "")
    return [
        f"{kind}:{what}"
        for kind, what, pattern in (
            ("generated", "lock", _LOCK), ("generated", "name", _GENERATED_NAME), ("generated", "folder", _GENERATED_FOLDER),
            ("minified", "name", _MINIFIED_NAME), ("vendored", "path", _VENDORED_PATH), ("vendored", "release", _RELEASE_NAME),
        )
        if pattern.search(path)
    ]


def remark_sign(line: str) -> str | None:
    """The kind that a line of remark is a notice of."""
    return "generated" if _GENERATED_NOTICE.search(line) else "vendored" if _VENDORED_NOTICE.search(line) else None


def text_signs(text: str, kind: str) -> tuple[list[str], int]:
    """Signs in a chunk, and how many of its characters are data."""
    signs = sorted({f"{k}:notice" for k in map(remark_sign, remarks(text, whole=True)) if k})
    data = 0
    for line in text.split("\n"):
        size = len(line)
        if size < 12:
            continue
        digits = size - len(line.encode("utf-8", "replace").translate(None, b"0123456789"))
        if digits * 10 >= 3 * size or (size > 50 and _STRINGY.search(line)) or (size > 20 and _SQL_ROW.match(line)):
            data += len(line.strip())
        if size > 500 and kind in _MINIFIED_TYPES and "minified:lines" not in signs:
            blanks = line.count(" ")
            if blanks * 14 < size and digits * 10 < 3 * size and not _STRINGY.search(line):
                signs.append("minified:lines")
    return signs, data


def masked(text: str) -> str:
    """The text without the lines that give it away."""
    low = text.lower()
    if not any(w in low for w in _MASKED_WORDS):
        return text
    return "\n".join(line for line in text.split("\n") if not _MASKED.search(line.lower()))


def remarks(text: str, whole: bool = False) -> list[str]:
    """What the lines of remark of a text say, without (or with) their marks."""
    return [(m[0] if whole else m[1]) for m in _REMARK.finditer(text) if len(m[1]) > 5]


#: Bins of hashed n-grams of a text, of a size and longest line after them, of path components, of n-grams of a remark.
GRAM_BINS, SHAPE_BINS, PATH_BINS, REMARK_BINS, GRAM = 1 << 15, 64, 1 << 17, 1 << 15, 4
BINS = {"text": GRAM_BINS + SHAPE_BINS, "path": PATH_BINS, "remark": REMARK_BINS}
_DIGITS = bytes.maketrans(b"123456789", b"000000000")
_BLANKS = re.compile(r"[ \t\r]{2,}|[\t\r]")


def _gram_codes(raw: np.ndarray, width: int, bits: int) -> np.ndarray:
    """The bin of each n-gram of bytes, in order."""
    n = max(0, len(raw) - width + 1)
    code = np.zeros(n, np.uint32)
    with np.errstate(over="ignore"):
        for i in range(width):
            code = code * np.uint32(0x01000193) + raw[i : n + i]
        code = (code ^ (code >> np.uint32(15))) * np.uint32(2246822519)
    return code >> np.uint32(32 - bits)


def text_bins(text: str) -> np.ndarray:
    """The distinct bins of a text's n-grams of bytes, digits as one and giveaway lines masked, and of its size and longest line."""
    text = _BLANKS.sub(" ", masked(text))
    data = text.encode("utf-8", "replace")
    seen = np.zeros(BINS["text"], bool)
    seen[_gram_codes(np.frombuffer(data.translate(_DIGITS), np.uint8).astype(np.uint32), GRAM, 15)] = True
    longest = max(map(len, text.split("\n")))
    seen[[GRAM_BINS + min(31, len(data).bit_length()), GRAM_BINS + 32 + min(31, longest.bit_length())]] = True
    return np.flatnonzero(seen)


def path_bins(path: str | None) -> np.ndarray:
    """The bins of the components of a path: folders below the repository, parts of the name, types."""
    parts = re.sub(r"\d+", "0", (path or "").lower()).split("/")
    pieces = [f"d:{p}" for p in parts[1:-1]] + [f"n:{p}" for p in re.split(r"[._\-]", parts[-1])] + [f"e:{'.'.join(parts[-1].split('.')[1:])}"]
    if re.search(r"[.\-](?=[0-9a-f]*\d)[0-9a-f]{8,20}\.", (path or "").lower()):
        pieces.append("h:digest")
    return np.unique(np.array([zlib.crc32(p.encode()) % PATH_BINS for p in pieces], np.int64))


def _remark_grams(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bins of n-grams of 4 and of 7 bytes of all lines, one after the other, and the line that each is of."""
    data = ("\n" + "\n".join("^" + line.strip() + "$" for line in lines) + "\n").lower().encode("utf-8", "replace").translate(_DIGITS)
    raw = np.frombuffer(data, np.uint8).astype(np.uint32)
    ends = raw == 10
    at = np.cumsum(ends) - 1
    bins, owners = [], []
    for width in (4, 7):
        codes = _gram_codes(raw, width, 15)
        n = len(codes)
        # no end of a line within
        inside = np.ones(n, bool)
        for i in range(width):
            inside &= ~ends[i : n + i]
        bins.append(codes[inside])
        owners.append(at[:n][inside])
    return np.concatenate(bins).astype(np.int64), np.concatenate(owners)


def remark_bins(line: str) -> np.ndarray:
    """The distinct bins of a line of remark."""
    return np.unique(_remark_grams([line])[0])


def train(rows: list[np.ndarray], wanted: np.ndarray, bins: int, rounds: int = 5, strength: float = 2e-5, seed: int = 1) -> tuple[np.ndarray, float]:
    """A linear support-vector classifier (hinge loss, averaged stochastic subgradient steps) of rows of bins, each of length 1: weights and bias."""
    w, total, bias, bias_total, step = np.zeros(bins), np.zeros(bins), 0.0, 0.0, 0
    y = np.where(wanted, 1.0, -1.0)
    many = max(1, int(wanted.sum()))
    weight = np.where(wanted, min(8.0, max(1.0, (len(y) - many) / many)), 1.0)
    values = [1 / np.sqrt(max(1, len(r))) for r in rows]
    rng, scale, steps = np.random.default_rng(seed), 1.0, 0
    for round_ in range(rounds):
        for i in rng.permutation(len(rows)):
            step += 1
            rate = 0.5 / (1 + step * 2e-3)
            scale *= 1 - rate * strength
            at = rows[i]
            if y[i] * (scale * w[at].sum() * values[i] + bias) < 1:
                w[at] += rate * weight[i] * y[i] * values[i] / scale
                bias += 0.1 * rate * weight[i] * y[i]
        if round_ >= rounds // 2:
            total += scale * w
            bias_total += bias
            steps += 1
    return total / max(1, steps), bias_total / max(1, steps)


def best_cut(scores: np.ndarray, wanted: np.ndarray, precision: float) -> tuple[float, float, float]:
    """The threshold with the best recall at a precision or above: it, its precision and recall; infinite if there is none."""
    order = np.argsort(-scores, kind="stable")
    s, y = scores[order], wanted[order]
    right = np.cumsum(y)
    share = right / np.arange(1, len(s) + 1)
    # a cut lies between two different scores
    ends = np.r_[s[:-1] > s[1:], True] if len(s) else np.zeros(0, bool)
    good = np.flatnonzero(ends & (share >= precision) & (right > 0))
    if not len(good):
        return np.inf, 0.0, 0.0
    # of cuts with the same hits the strictest: what follows are misses
    best = good[right[good] == right[good[-1]]][0]
    below = s[best + 1] if best + 1 < len(s) else s[best] - 1.0
    return float((s[best] + below) / 2), float(share[best]), float(right[best] / max(1, wanted.sum()))


class Classifiers:
    """A classifier of each kind and view with its threshold; where there are too few examples there is none."""

    def __init__(self, sample: pd.DataFrame, least_examples: int = 12, precision: float = 0.97):
        """``sample``: source_path, repository, signs of the file (a list), bins (of the text), remarks (a list), one row for each chunk.

        ``report`` says how each classifier was judged on held-out repositories:
        threshold, precision, recall of the chunks, paths or lines of its kind,
        and examples. Classifiers of texts never see what notices and names say.
        """
        self.weights = {v: np.zeros((BINS[v], len(KINDS)), np.float32) for v in VIEWS}
        self.bias, self.threshold = {v: np.zeros(len(KINDS), np.float32) for v in VIEWS}, {v: np.full(len(KINDS), np.inf) for v in VIEWS}
        self.report: dict[tuple[str, str], dict[str, float]] = {}
        self.least, self.precision = least_examples, precision
        signs = [set(s) for s in sample["signs"]]
        held = np.array([zlib.crc32(str(r).encode()) % 4 == 0 for r in sample["repository"]], bool)
        clean = np.array([not s for s in signs], bool)
        shaped = np.array([[any(s.startswith(k) and s.split(":")[1] != "folder" for s in file) for k in KINDS] for file in signs], bool).reshape(-1, len(KINDS))
        # what stands in a folder isn't written otherwise for that: folders don't teach n-grams, nor does their absence
        self._teach("text", [np.asarray(b, np.int64) for b in sample["bins"]], shaped, clean, held)
        # of a file known by its notice or shape the path says nothing
        once = sample.assign(_held=held, _clean=clean).drop_duplicates("source_path")
        named = np.array([[any(s.startswith(k) for s in path_signs(p)) for k in KINDS] for p in once["source_path"]], bool).reshape(-1, len(KINDS))
        self._teach("path", [path_bins(p) for p in once["source_path"]], named, once["_clean"].to_numpy(bool), once["_held"].to_numpy(bool), rounds=30, strength=1e-6)
        lines: dict[str, tuple[str | None, bool]] = {}
        for file, off in zip(sample["remarks"], held):
            for line in file:
                # a line that stands in repositories of both parts counts as one for training
                kind, before = lines.get(line, (remark_sign("# " + line), True))
                lines[line] = kind, before and bool(off)
        labels = np.array([[kind == k for k in KINDS] for kind, _ in lines.values()], bool).reshape(-1, len(KINDS))
        self._teach("remark", [remark_bins(line) for line in lines], labels, ~labels.any(axis=1), np.array([off for _, off in lines.values()], bool))

    def _teach(self, view: str, rows: list[np.ndarray], labels: np.ndarray, clean: np.ndarray, held: np.ndarray, **how: float) -> None:
        for k, kind in enumerate(KINDS):
            has = labels[:, k] if len(labels) else np.zeros(0, bool)
            use = has | clean
            self.report[kind, view] = {"threshold": np.inf, "examples": int(has.sum())}
            if (has & ~held).sum() < self.least:
                _LOG.warning("no classifier of %s files by %s: %d examples, %d needed", kind, view, (has & ~held).sum(), self.least)
                continue
            w, b = train([rows[i] for i in np.flatnonzero(use & ~held)], has[use & ~held], BINS[view], **how)
            at = np.flatnonzero(use & held)
            scores = np.array([w[rows[i]].sum() / np.sqrt(max(1, len(rows[i]))) + b for i in at])
            # without an example to validate on, half of the margin
            cut, precision, recall = best_cut(scores, has[at], self.precision) if has[at].any() else (0.5, float("nan"), float("nan"))
            if np.isinf(cut):
                _LOG.warning("no classifier of %s files by %s: none is right often enough in held-out repositories", kind, view)
                continue
            self.weights[view][:, k], self.bias[view][k], self.threshold[view][k] = w, b, cut
            self.report[kind, view] |= {"threshold": cut, "precision": precision, "recall": recall}

    def judge(self, texts: list[str], paths: list[str | None]) -> np.ndarray:
        """For each chunk, kind and view whether the classifier says so."""
        out = np.zeros((len(texts), len(KINDS), len(VIEWS)), bool)
        known: dict[str | None, np.ndarray] = {}
        lines, owner = [], []
        for i, (text, path) in enumerate(zip(texts, paths)):
            bins = text_bins(text)
            out[i, :, 0] = self.weights["text"][bins].sum(axis=0) / np.sqrt(len(bins)) + self.bias["text"] > self.threshold["text"]
            if path not in known:
                bins = path_bins(path)
                known[path] = self.weights["path"][bins].sum(axis=0) / np.sqrt(max(1, len(bins))) + self.bias["path"] > self.threshold["path"]
            out[i, :, 1] = known[path]
            found = remarks(text)
            lines += found
            owner += [i] * len(found)
        if lines:
            which, kinds = self.notices(lines)
            np.logical_or.at(out[:, :, 2], np.asarray(owner)[which], kinds[which])
        return out

    def notices(self, lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The lines that some classifier of remarks takes for a notice, and for each line and kind whether it is one."""
        distinct: dict[str, int] = {}
        index = np.array([distinct.setdefault(line, len(distinct)) for line in lines])
        bins, of = _remark_grams(list(distinct))
        # each bin of a line once
        pairs = np.unique(of.astype(np.int64) * REMARK_BINS + bins)
        of, bins = pairs // REMARK_BINS, pairs % REMARK_BINS
        many = np.bincount(of, minlength=len(distinct))
        scores = np.stack([np.bincount(of, weights=self.weights["remark"][bins, k], minlength=len(distinct)) for k in range(len(KINDS))], axis=1)
        kinds = (scores / np.sqrt(np.maximum(1, many))[:, None] + self.bias["remark"] > self.threshold["remark"])[index]
        return np.flatnonzero(kinds.any(axis=1)), kinds


#: What a file's signs may be, but for its share of data.
_SIGNS = ("generated:notice", "generated:lock", "generated:name", "generated:folder", "minified:name", "minified:lines", "vendored:notice", "vendored:path", "vendored:release")


def foreign_files(chunks: DataFrame, sample_files: int = 8000, sample_lines: int = 30, classifiers: Classifiers | None = None) -> DataFrame:
    """Every code file with what classifiers say of it: file_key, signs (an array; empty for hand-written files).

    A sign is ``kind:view``: of kinds generated, minified, vendored and data, and
    of views text, path and remark. Of each chunk the latest version counts,
    and what is said of any chunk counts for the file. Documents and
    configuration files are left out by their type (but lock files are not);
    files without a key or a text too. A missing path, repository or language
    is no sign. The classifiers are trained on at most about ``sample_files``
    files, chosen by a hash of their key, with two chunks of each and
    ``sample_lines`` remarks of a chunk beside its notices; every file is
    judged. Other columns are ignored.
    """
    path = F.coalesce(F.col("source_path"), F.col("file_key"))
    kind = suffix(path)
    name_is_lock = path.rlike(r"(?i)(^|/)([\w.\-]*\.lock|[\w.\-]*[-.]lock\.(json|ya?ml|toml|hcl)|npm-shrinkwrap\.json|go\.sum)$")
    code = chunks.where(F.col("file_key").isNotNull() & F.col("text").isNotNull() & (name_is_lock | ~kind.isin(*sorted(OTHER_TYPES))))
    rows = versions(code, "file_key", "source_path", "repository_name", "text").withColumn("source_path", F.coalesce("source_path", "file_key"))
    if classifiers is None:
        classifiers = Classifiers(_sample(rows, sample_files, sample_lines))
    shared = chunks.sparkSession.sparkContext.broadcast(classifiers)  # of fixed size, 3 MB

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = 1 << np.arange(len(KINDS) * len(VIEWS))
        for batch in batches:
            said = shared.value.judge(batch["text"].tolist(), batch["source_path"].tolist())
            yield batch[["chunk_id", "indexed_at", TIE, "file_key"]].assign(said=(said.reshape(len(batch), -1) * bits).sum(axis=1).astype(np.int32))

    judged = rows.select("chunk_id", "indexed_at", TIE, "file_key", "source_path", "text").mapInPandas(judge, f"chunk_id string, indexed_at timestamp, {TIE} long, file_key string, said int")
    files = latest(judged, "chunk_id", "indexed_at", ["file_key", "said"], TIE).groupBy("file_key").agg(F.bit_or("said").alias("said"))
    names = [f"{k}:{v}" for k in KINDS for v in VIEWS]
    return files.select("file_key", F.array_compact(F.array(*[F.when(F.col("said").bitwiseAND(1 << i) != 0, F.lit(n)) for i, n in enumerate(names)])).alias("signs"))


def _sample(rows: DataFrame, sample_files: int, sample_lines: int) -> pd.DataFrame:
    """Labelled chunks of a bounded number of files: source_path, repository, signs (of the file), bins, remarks."""
    many = rows.agg(F.approx_count_distinct("file_key", 0.02)).first()[0] or 0
    spread_over = 1 << 30
    part = rows.where(F.pmod(F.xxhash64(F.lit("sample"), F.col("file_key")), F.lit(spread_over)) < int(spread_over * min(1.0, sample_files / max(1, many)))) if many > sample_files else rows
    part = part.select("chunk_id", "indexed_at", TIE, "file_key", "source_path", "text", suffix(F.col("source_path")).alias("_kind"), F.coalesce(F.col("repository_name"), F.split("source_path", "/")[0]).alias("repository"))

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [text_signs(t, k) for t, k in zip(batch["text"], batch["_kind"])]
            lines = []
            for text, (signs, _) in zip(batch["text"], made):
                found = list(dict.fromkeys(remarks(text)))
                told = [x for x in found if remark_sign("# " + x)] if any(s.endswith(":notice") for s in signs) else []
                rest = sorted(set(found) - set(told), key=lambda x: zlib.crc32(x.encode("utf-8", "replace")))
                lines.append(told[:sample_lines] + rest[:sample_lines])
            of = lambda values: pd.Series(values, dtype=object, index=batch.index)  # noqa: E731, B023
            yield batch[["chunk_id", "indexed_at", TIE, "file_key", "source_path", "repository"]].assign(
                signs=of([s + path_signs(p) for (s, _), p in zip(made, batch["source_path"])]), told=[len(s) for s, _ in made], data=[d for _, d in made], size=[len(t) for t in batch["text"]],
                bins=of([text_bins(t).astype(np.uint16).tobytes() for t in batch["text"]]), remarks=of(lines),
            )

    kept = "file_key string, source_path string, repository string, signs array<string>, told int, data long, size long, bins binary, remarks array<string>"
    seen = latest(part.mapInPandas(look, f"chunk_id string, indexed_at timestamp, {TIE} long, {kept}"), "chunk_id", "indexed_at", [c.split()[0] for c in kept.split(", ")], TIE)
    one = F.struct("chunk_id", "source_path", "repository", "bins", "remarks")
    flags = [F.max(F.array_contains("signs", s)).alias(f"_{i}") for i, s in enumerate(_SIGNS)]
    files = seen.groupBy("file_key").agg(
        F.max_by(one, F.struct("told", "data", F.xxhash64("chunk_id"))).alias("_one"), F.min_by(one, F.xxhash64("chunk_id")).alias("_two"), F.sum("data").alias("data"), F.sum("size").alias("size"), *flags
    )
    mostly = (F.col("data") >= LEAST_DATA) & (F.col("data") * 2 >= F.col("size"))
    signs = F.array_compact(F.array(*[F.when(F.col(f"_{i}"), F.lit(s)) for i, s in enumerate(_SIGNS)], F.when(mostly, F.lit("data:share"))))
    sample = files.select("file_key", signs.alias("signs"), F.inline(F.array_distinct(F.array("_one", "_two")))).toPandas().sort_values(["file_key", "chunk_id"], ignore_index=True)
    return sample.assign(bins=[np.frombuffer(b, np.uint16).astype(np.int64) for b in sample["bins"]])
