"""Spelling variants of words, found by pivotal grams.

A word's bigrams are ordered from rare to common. Its prefix holds the first three (and what
ties with the third). Of two words one edit apart, take the one whose prefix ends earlier in
that order: of any two disjoint bigrams of its prefix, its pivots, one survives the edit and
lies in the prefix of the other word. So pivots are looked up among prefixes only. The two
pivots are the disjoint bigrams of the prefix with the smallest sum of frequencies, chosen by
dynamic programming over their places.

A surviving pivot lies before or after the edit: its place moves by nothing or by the change
of length, and the part of the word on its unedited side is the same in both words, as is one
half of the other part. Place, length and those parts are all in the join key, so the words
around a frequent bigram do not meet each other. Candidates are verified by edit distance in
the join itself.

Words are runs of the letters A-Z, a-z and U+00C0 to U+00FF, of any length: a run over a
whole text is one word. Null and empty texts have no words. Repeated rows count each, ties
between forms go to the smaller word in code-point order, and an empty table gives an empty
table. Other columns than the id and the text are not read; a null id counts as empty text
where it is part of a key.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T
from .tables import cut_lineage

LETTERS = r"[A-Za-zÀ-ÿ]"
#: Code points of the shortest words, and occurrences that make a word.
LEAST_LENGTH, LEAST_COUNT = 7, 2
#: One edit, bigrams: the prefix holds GRAM * EDITS + 1 grams, of which EDITS + 1 are pivots.
GRAM, EDITS = 2, 1
PREFIX = GRAM * EDITS + 1
#: A form is at least so many times as frequent as its variants.
TIMES = 10
#: A part with the edit is cut in halves if it is longer than this.
WHOLE = 3
#: (change of length, move of the place, whether the equal part lies before the gram).
MOVES = [(0, 0, True), (0, 0, False), (1, 0, True), (1, 1, False), (-1, 0, True), (-1, -1, False)]


def runs(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, run): maximal runs of at least LEAST_LENGTH letters, A-Z in lower case."""
    found = F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(f"({LETTERS}{{{LEAST_LENGTH},}})"), F.lit(1))
    run = F.col("run")
    plain = F.octet_length(run) == F.length(run)
    return documents.select(F.col(id_col).cast("string").alias("id"), F.explode(found).alias("run")).select(
        F.coalesce("id", F.lit("")).alias("id"), F.when(plain, F.lower(run)).otherwise(T.lower_ascii(run)).alias("run"))


def misspelt(found: DataFrame, every: int) -> DataFrame:
    """The runs as words, one in ``every`` (by a hash of id and run) with one letter left out."""
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (h % F.length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    return found.select(F.when(h % every == 0, cut).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame) -> DataFrame:
    """(word, n): distinct words that are long and frequent enough."""
    return words.where(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count("*").alias("n")).where(
        F.col("n") >= LEAST_COUNT)


def gram_order(vocab: DataFrame) -> dict[str, int]:
    """Words that hold each bigram. With 90 letters there are 8,100 bigrams at most."""
    grams = F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring(F.col("word"), i, F.lit(GRAM))))
    return {r["gram"]: r["n"] for r in vocab.select(F.explode(grams).alias("gram")).groupBy("gram").agg(
        F.count("*").alias("n")).collect()}


def prefix_and_pivots(word: str, order: dict[str, tuple[int, str]]) -> tuple[list[int], list[int], tuple[int, str]]:
    """Places of the prefix and of the pivots, and the last gram of the prefix with its frequency."""
    keys = [order[word[i:i + GRAM]] for i in range(len(word) - GRAM + 1)]
    last = sorted(set(keys))[-1] if len(keys) < PREFIX else sorted(keys)[PREFIX - 1]
    prefix = [i for i, k in enumerate(keys) if k <= last]
    # best[k]: the cheapest k disjoint grams so far; closed[k]: those that end before the gram at hand.
    best: list[tuple[int, tuple[int, ...]]] = [(0, ())]
    history: list[tuple[int, list]] = []
    for i in prefix:
        closed = next((b for at, b in reversed(history) if at <= i - GRAM), [(0, ())])
        grown = [(cost + keys[i][0], (*places, i)) for cost, places in closed[:EDITS + 1]]
        best = [(0, ())] + [min([*best[k:k + 1], *grown[k - 1:k]]) for k in range(1, min(EDITS + 1, max(len(best) - 1, len(grown))) + 1)]
        history = [*history[-GRAM:], (i, best)]
    return prefix, list(best[-1][1]), last


def grams(vocab: DataFrame) -> DataFrame:
    """(word, len, pos, last, pivot): the grams of each word's prefix, and which of them are pivots.

    ``last`` is the rank of the prefix's last gram in the order from rare to common.
    """
    counts = gram_order(vocab)
    order = {gram: (n, gram) for gram, n in counts.items()}
    rank = {key: k for k, key in enumerate(sorted(order.values()))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[int, int, int, bool]] = []
            for k, word in enumerate(batch.column("word").to_pylist()):
                prefix, pivots, last = prefix_and_pivots(word, order)
                rows += [(k, i, rank[last], i in pivots) for i in prefix]
            at, pos, last, pivot = (np.array(c) for c in zip(*rows, strict=True)) if rows else [np.zeros(0, int)] * 4
            yield pa.RecordBatch.from_arrays([
                batch.column("word").take(pa.array(at, pa.int64())), pa.array(pos, pa.int32()),
                pa.array(last, pa.int32()), pa.array(pivot.astype(bool))], names=["word", "pos", "last", "pivot"])

    return vocab.select("word").mapInArrow(run, "word string, pos int, last int, pivot boolean")


def _keys(df: DataFrame, pos: Column, length: Column, before: Column, *rest: str) -> DataFrame:
    """Join keys of words with a gram at ``pos``, for partners with theirs at the given place and length.

    ``before`` tells that the edit comes after the gram, and so what comes before it is equal.
    Of the part with the edit, where it is long, one half is equal, too: the one next to the
    gram (half 0) or the one at the word's end (half 1). All that is equal is in the key.
    """
    own, word = F.col("pos"), F.col("word")
    placed = df.select(*rest, "word", own, pos.alias("p"), length.alias("len"), before.alias("before"))
    edited = F.when(F.col("before"), F.col("len") - F.col("p") - GRAM).otherwise(F.col("p"))
    split = edited > WHOLE
    halved = placed.withColumn("h", F.when(split, F.floor(edited / 2).cast("int")).otherwise(0)).withColumn(
        "half", F.explode(F.when(split, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    near = F.when(F.col("half") == 0, F.col("h")).otherwise(0)
    far = F.col("h") - near
    equal = F.when(F.col("before"), F.substring(word, F.lit(1), own + GRAM + near)).otherwise(
        F.substring(word, own + 1 - near, F.length(word)))
    end = F.when(F.col("before"), F.right(word, far)).otherwise(F.left(word, far))
    return halved.select(*rest, "word", F.xxhash64("p", "len", "before", "half", equal, end).alias("key"))


def near_words(vocab: DataFrame) -> DataFrame:
    """(word, near), both ways: the pairs of words of ``vocab`` that are exactly one edit apart."""
    found = cut_lineage(grams(vocab))
    side = F.explode(F.array(F.lit(True), F.lit(False))).alias("side")
    listed = _keys(found.select("word", "pos", "last", side), F.col("pos"), F.length("word"), F.col("side"), "last").select(
        F.col("word").alias("near"), F.col("last").alias("last2"), "key")
    moves = F.explode(F.array(*[F.struct(F.lit(d).alias("d"), F.lit(m).alias("m"), F.lit(b).alias("b")) for d, m, b in MOVES])).alias("x")
    asked = _keys(found.where("pivot").select("word", "pos", "last", moves),
                  F.col("pos") + F.col("x.m"), F.length("word") + F.col("x.d"), F.col("x.b"), "last")
    one_edit = F.levenshtein("word", "near", EDITS) == EDITS
    pairs = asked.join(listed, "key").where((F.col("last") <= F.col("last2")) & one_edit)
    pairs = cut_lineage(pairs.select(F.least("word", "near").alias("a"), F.greatest("word", "near").alias("b")).distinct())
    return pairs.select(F.col("a").alias("word"), F.col("b").alias("near")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("near")))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the end of each chain of forms, by doubling.

    A form is ten times as frequent, so chains are short and have no circles.
    """
    ends = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        on = ends.join(ends.select(F.col("word").alias("mid"), F.col("root").alias("end")), F.col("root") == F.col("mid"), "left")
        step = cut_lineage(on.select("word", F.coalesce("end", "root").alias("root"), F.col("end").isNotNull().alias("moved")))
        if step.where("moved").isEmpty():
            return ends
        ends = step.select("word", "root")


def variants(vocab: DataFrame) -> DataFrame:
    """(word, n, form, root, n_near, form_n) of every word of ``vocab`` (word, n)."""
    vocab = cut_lineage(vocab.select("word", "n"))
    pairs = near_words(vocab).join(vocab.select(F.col("word").alias("near"), F.col("n").alias("m")), "near")
    # The smallest of (-n, word) is the most frequent near word, the first of equals.
    best = pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "near")).alias("best"))
    frequent = -F.col("best.m") >= TIMES * F.col("n")
    judged = cut_lineage(vocab.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(frequent, F.col("best.near")).alias("form"), F.when(frequent, -F.col("best.m")).alias("form_n")))
    ends = roots(judged.where(F.col("form").isNotNull()))
    return judged.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def document_variants(documents: DataFrame, every: int = 31) -> DataFrame:
    """Variants among the words of whole texts, with a letter left out of one run in ``every``."""
    return variants(vocabulary(misspelt(runs(documents), every)))
