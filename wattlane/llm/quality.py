"""Quality rules with adaptive thresholds.

Base counts come from each whole text. The thresholds are not fixed: for each language and
source, mergeable quantile sketches of four shares give their quartiles, and a document
fails where it lies beyond ``FENCE`` interquartile ranges plus a margin from them. Sketches
merge partial results, so a hot source is summed up before it is shuffled; the small table
of thresholds is repeated over ``SALTS`` so that its join splits a hot group too.

Null texts have no words and fail, as all texts of under 20 words do. Null languages and
sources form groups of their own. Repeated rows get equal results.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T
from .tables import cut_lineage

FENCE, SALTS, ACCURACY = 3.0, 16, 1_000
SPAN = 8
SYMBOLS = r"[#*$%&|<>]+"
#: Per share: margins below and above the quartiles; None where low values are fine.
SHARES = {
    "symbol_share": (None, 0.05),
    "dup_line_share": (None, 0.2),
    "repeat_share": (None, 0.25),
    "word_length": (2.0, 2.0),
}


def _covered(spans: Column) -> Column:
    """Words inside the 8-word windows that occur more than once, from the windows' hashes."""
    paired = F.sort_array(F.transform(spans, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    repeated = T.let(paired, lambda p: F.filter(p, lambda s, i: F.coalesce(
        (F.get(p, i - 1)["x"] == s["x"]), F.lit(False)) | F.coalesce(F.get(p, i + 1)["x"] == s["x"], F.lit(False))))
    starts = F.sort_array(F.transform(repeated, lambda s: s["i"]))
    steps = T.let(starts, lambda a: F.zip_with(
        a, F.slice(a, 2, F.greatest(F.size(a), F.lit(1))), lambda x, y: F.coalesce(F.least(y - x, F.lit(SPAN)), F.lit(SPAN))))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda s, x: s + x)


def features(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words in struct ``f``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    spans = T.hashes(F.col("_w"))
    for step in (1, 2, 4):
        spans = T.joined_pairs(spans, step)
    return documents.withColumn("_w", T.words(text, T.BLANKS)).withColumns({
        "_g": spans, "_l": lines}).withColumn("f", F.struct(
            F.size("_w").cast("long").alias("n_words"),
            F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            F.size("_l").cast("long").alias("n_lines"),
            (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
            F.when(F.size(F.array_distinct("_g")) == F.size("_g"), F.lit(0).cast("long")).otherwise(
                _covered(F.col("_g"))).alias("n_repeat_words"),
        )).drop("_w", "_g", "_l")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def shares() -> dict[str, Column]:
    words = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "symbol_share": F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1)),
        "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeat_share": F.col("n_repeat_words") / words,
        "word_length": F.col("word_chars") / words,
    }


def thresholds(measured: DataFrame) -> DataFrame:
    """(lang, source, low_*, high_*) from the quantile sketches of each group."""
    quartiles = measured.where(F.col("n_words") > 0).groupBy("lang", "source").agg(*[
        F.percentile_approx(name, [0.25, 0.75], ACCURACY).alias(name) for name in SHARES])
    bounds = []
    for name, (below, above) in SHARES.items():
        q1, q3 = F.col(name)[0], F.col(name)[1]
        bounds.append((q3 + FENCE * (q3 - q1) + above).alias(f"high_{name}"))
        if below is not None:
            bounds.append((q1 - FENCE * (q3 - q1) - below).alias(f"low_{name}"))
    return quartiles.select("lang", "source", *bounds)


def judge(documents: DataFrame) -> DataFrame:
    """Per row: doc_id, the counts, base_failed and kept."""
    rows = features(documents.select("doc_id", "lang", "source", "text"))
    measured = cut_lineage(rows.select("doc_id", "lang", "source", "f.*").withColumns(shares()).withColumn(
        "salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")))
    bounds = thresholds(measured).select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")).alias("b")
    joined = measured.alias("m").join(bounds, (
        F.col("m.salt") == F.col("b.salt")) & F.col("m.lang").eqNullSafe(F.col("b.lang")) & F.col("m.source").eqNullSafe(F.col("b.source")), "left")
    inside = F.lit(True)
    for name, (below, _) in SHARES.items():
        inside = inside & F.coalesce(F.col(name) <= F.col(f"high_{name}"), F.lit(True))
        if below is not None:
            inside = inside & F.coalesce(F.col(name) >= F.col(f"low_{name}"), F.lit(True))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return joined.select("m.doc_id", *counts, base_failed().alias("base_failed"), (~base_failed() & inside).alias("kept"))
