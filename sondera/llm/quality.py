"""Statistics of a document's text, and from them whether it is prose, a list, a table or junk.

All statistics are SQL expressions over the whole text. Thresholds on them are
labelling functions that are often wrong: each votes for one or several forms
or abstains. How often each is right is learned from how they agree, by
expectation-maximization over the patterns of votes; every document gets the
posterior of each form.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sondera.llm.columns import spread
from sondera.session import settle

FORMS = ("prose", "list", "table", "junk")

#: Frequent function words of the languages of Latin script the corpus may hold.
COMMON_WORDS = tuple(sorted(set(
    "the of and to in a is it that for as was with be by on not or an are this at from but have has were which so if can may must there their its "
    "all each every nothing what we our you they one when will would should der die das und ist nicht ein eine für den von mit es wird nach dem im zu "
    "auf aber muss wir haben keine le la les de des et est un une pour dans que qui il elle ne pas lo gli di e non per con che una del della è "
    "si deve ma alla el los las y en no se su con por para es o os do da em uma het een van niet op te".split()
)))

_WORD = r"[\p{L}\p{N}_]+"


def text_statistics(documents: DataFrame) -> DataFrame:
    """One row of statistics for each document.

    Columns: doc_id, n_chars, n_words, n_lines (not blank), mean_word_length,
    symbol_ratio, digit_ratio, line_end_punctuation, common_word_share,
    prose_share (of the characters in lines with the word mix of sentences),
    words_per_line, sentence_rate (sentence ends a word), cell_share and
    bullet_share (of lines), distinct_share (of words), odd_word_share.

    A missing or empty text has counts and shares of 0. Repeated rows are kept;
    other columns are ignored.
    """
    text = F.lower(F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), r"\r\n?", "\n"))
    line = lambda raw: F.struct(
        raw.alias("l"), F.regexp_extract_all(raw, F.lit(_WORD), F.lit(0)).alias("w")
    )
    counted = lambda x: F.struct(
        F.length(F.trim(x["l"])).alias("c"), F.size(x["w"]).alias("n"), F.size(F.filter(x["w"], lambda w: w.isin(*COMMON_WORDS))).alias("s"),
        x["l"].rlike(r"[.!?…][\"'”»)\]]*\s*$").cast("int").alias("p"), x["l"].rlike(r"^\s*(?:[-*+•–]\s|\d{1,3}[.)]\s|\[)").cast("int").alias("b"),
        (F.regexp_count(x["l"], F.lit(r"[;|\t]|,\S|\S {2,}")) >= 2).cast("int").alias("t"),
    )
    base = spread(documents.select("doc_id", "text"), "doc_id").select("doc_id", text.alias("_t")).select("doc_id", "_t", F.transform(F.split("_t", "\n"), line).alias("_w"))
    base = base.select("doc_id", "_t", F.filter(F.transform("_w", counted), lambda x: x["c"] > 0).alias("_l"), F.flatten(F.transform("_w", lambda x: x["w"])).alias("_words"))

    def total(of) -> Column:
        return F.aggregate("_l", F.lit(0), lambda acc, x: acc + of(x))

    like_sentences = lambda x: (x["n"] >= 3) & (x["s"] * 6 >= x["n"])
    sums = base.select(
        "doc_id", F.length("_t").alias("n_chars"), F.size("_words").alias("n_words"), F.size("_l").alias("n_lines"),
        total(lambda x: x["c"]).alias("_c"), total(lambda x: x["s"]).alias("_s"), total(lambda x: x["p"]).alias("_p"), total(lambda x: x["b"]).alias("_b"),
        total(lambda x: x["t"]).alias("_cells"), total(lambda x: F.when(like_sentences(x), x["c"]).otherwise(0)).alias("_prose"),
        F.aggregate("_words", F.lit(0), lambda acc, w: acc + F.length(w)).alias("_wc"), F.size(F.array_distinct("_words")).alias("_distinct"),
        F.regexp_count("_t", F.lit(r"[^\p{L}\p{N}\s]")).alias("_symbols"), F.regexp_count("_t", F.lit(r"\p{N}")).alias("_digits"),
        F.regexp_count("_t", F.lit(r"[.!?…][\"'”»)\]]*(?:\s|$)")).alias("_ends"),
        F.size(F.filter("_words", lambda w: w.rlike(r"[bcdfghjklmnpqrstvwxz]{5}|^\p{L}{22}|\p{L}\d\p{L}|^[a-f\d]{12}"))).alias("_odd"),
    )
    share = lambda part, whole: F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(F.lit(0.0))
    return sums.select(
        "doc_id", F.col("n_chars").cast("long"), F.col("n_words").cast("long"), F.col("n_lines").cast("long"),
        share("_wc", "n_words").alias("mean_word_length"), share("_symbols", "n_chars").alias("symbol_ratio"), share("_digits", "n_chars").alias("digit_ratio"),
        share("_p", "n_lines").alias("line_end_punctuation"), share("_s", "n_words").alias("common_word_share"), share("_prose", "_c").alias("prose_share"),
        share("n_words", "n_lines").alias("words_per_line"), share("_ends", "n_words").alias("sentence_rate"), share("_cells", "n_lines").alias("cell_share"),
        share("_b", "n_lines").alias("bullet_share"), share("_distinct", "n_words").alias("distinct_share"), share("_odd", "n_words").alias("odd_word_share"),
    )


#: Labelling functions: statistic, then (from, to, forms voted for); in no range it abstains.
LABELLERS: tuple[tuple[str, tuple[tuple[float, float, tuple[str, ...]], ...]], ...] = (
    ("prose_share", ((0.55, 9e9, ("prose",)), (-1, 0.45, ("list", "table", "junk")))),
    ("common_word_share", ((0.2, 9e9, ("prose",)), (-1, 0.08, ("list", "table", "junk")))),
    ("sentence_rate", ((0.03, 0.2, ("prose",)), (-1, 0.012, ("list", "table", "junk")))),
    ("line_end_punctuation", ((0.5, 9e9, ("prose",)), (-1, 0.01, ("list", "table", "junk")))),
    ("words_per_line", ((9, 9e9, ("prose", "junk")), (-1, 6, ("list", "table")))),
    ("cell_share", ((0.6, 9e9, ("table",)),)),
    ("bullet_share", ((0.5, 9e9, ("list",)),)),
    ("digit_ratio", ((0.2, 9e9, ("table", "junk")), (-1, 0.05, ("prose", "list", "junk")))),
    ("symbol_ratio", ((0.1, 9e9, ("table", "list", "junk")), (-1, 0.045, ("prose", "junk")))),
    ("distinct_share", ((-1, 0.12, ("junk", "table")),)),
    ("odd_word_share", ((0.15, 9e9, ("junk",)),)),
)


def votes(statistics: DataFrame) -> DataFrame:
    """Adds the array ``votes``: for each labelling function 0 (abstains) or the number of its range from 1."""
    out = []
    for name, ranges in LABELLERS:
        vote = F.lit(0)
        for i, (low, high, _) in enumerate(ranges, 1):
            vote = F.when((F.col(name) >= low) & (F.col(name) < high), i).otherwise(vote)
        out.append(vote)
    return statistics.withColumn("votes", F.array(*out))


def learn(patterns: list[tuple[list[int], int]], rounds: int = 80) -> tuple[np.ndarray, dict[tuple[int, int], tuple[float, float]]]:
    """Shares of the forms, and for each (function, range) how often it votes where it is right and where it is wrong.

    Learned from patterns of votes with their counts, without labels. It begins
    with functions that are mostly right, and a function is never taken to be
    more often wrong than right, so that forms keep their meaning.
    """
    supports = _supports()
    prior, rates = np.full(len(FORMS), 1 / len(FORMS)), {k: (0.6, 0.1) for k in supports}
    counts = np.array([n for _, n in patterns], dtype=float)
    if not len(counts):
        return prior, rates
    cast = {k: np.array([v[k[0]] == k[1] for v, _ in patterns]) for k in supports}
    for _ in range(rounds):
        post = posterior([v for v, _ in patterns], prior, rates) * counts[:, None]
        # added counts (of half a document for each form, of two votes in ten) keep all off 0 and 1
        prior = (post.sum(axis=0) + 0.5) / (counts.sum() + 0.5 * len(FORMS))
        for k, yes in supports.items():
            right = (post[cast[k]][:, yes].sum() + 2) / (post[:, yes].sum() + 4)
            wrong = (post[cast[k]][:, ~yes].sum() + 0.1) / (post[:, ~yes].sum() + 4)
            rates[k] = (float(right), float(min(wrong, right)))
    return prior, rates


def _supports() -> dict[tuple[int, int], np.ndarray]:
    return {(j, i): np.array([f in forms for f in FORMS]) for j, (_, ranges) in enumerate(LABELLERS) for i, (_, _, forms) in enumerate(ranges, 1)}


def posterior(votes_cast: list[list[int]], prior: np.ndarray, rates: dict[tuple[int, int], tuple[float, float]]) -> np.ndarray:
    """The probability of each form, a row for each pattern of votes."""
    log = np.tile(np.log(prior), (len(votes_cast), 1))
    for (j, i), yes in _supports().items():
        rate = np.where(yes, *rates[j, i])
        cast = np.array([v[j] == i for v in votes_cast])
        log += np.where(cast[:, None], np.log(rate), np.log1p(-rate))
    post = np.exp(log - log.max(axis=1, keepdims=True))
    return post / post.sum(axis=1, keepdims=True)


def text_forms(documents: DataFrame) -> DataFrame:
    """Statistics, votes, a posterior for each form (p_prose, p_list, ...) and the likeliest form.

    Patterns of votes are counted over all documents; the driver gets one row
    for each pattern, whose number is bounded by the product of the functions'
    ranges and not by the documents. A document without a word is junk.
    """
    voted = settle(votes(text_statistics(documents)))
    patterns = [(list(r["votes"]), r["count"]) for r in voted.where("n_words > 0").groupBy("votes").count().collect()]
    prior, rates = learn(patterns)
    posts = posterior([v for v, _ in patterns], prior, rates) if patterns else np.empty((0, len(FORMS)))
    rows = [(v, *map(float, p), FORMS[int(p.argmax())]) for (v, _), p in zip(patterns, posts)]
    schema = "votes array<int>, " + ", ".join(f"p_{f} double" for f in FORMS) + ", form string"
    judged = voted.join(voted.sparkSession.createDataFrame(rows, schema), "votes", "left")
    worded = F.col("n_words") > 0
    named = [F.when(worded, F.col(f"p_{f}")).otherwise(F.lit(float(f == "junk"))).alias(f"p_{f}") for f in FORMS]
    return judged.select(*voted.columns, *named, F.when(worded, F.col("form")).otherwise(F.lit("junk")).alias("form"))
