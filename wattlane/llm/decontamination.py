"""Benchmark decontamination by winnowing.

A window is 13 consecutive words of a benchmark item, or the whole of a shorter one.
Of each run of k-grams that fills a window, the one of the smallest hash is kept (the
leftmost of equal ones). Items and documents keep the same k-gram of equal windows, so a
join of kept hashes misses no shared window; each hit is then extended to its whole window
and compared word by word.

Shorter items get windows of their own length, so the same holds for them.

Null, empty and word-free texts have no words and no hits; items without words are
ignored. Repeated rows each get a result of their own; null ids are kept and an item with
a null id counts as an item, but adds no id to the list. Other columns are not read.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T
from .tables import cut_lineage, row_key, small_enough

WINDOW = 13
#: Most words of a k-gram, a power of two; a window of 13 words holds six.
GRAM = 8
#: Benchmark fingerprints and hit documents up to these row counts are broadcast
#: (some 50 bytes a row); beyond them the same joins shuffle.
BROADCAST_FINGERPRINTS = 200_000
#: Up to so many bytes, the hits of documents, with the texts of their windows, are broadcast.
BROADCAST_BYTES = 32 << 20


def _gram(length: int) -> int:
    """Words of the k-grams of windows of ``length`` words: the largest power of two that fits."""
    k = 1
    while 2 * k <= min(GRAM, length):
        k *= 2
    return k


def _grams(word_hashes: Column, k: int) -> Column:
    step, h = 1, word_hashes
    while step < k:
        h, step = T.joined_pairs(h, step), 2 * step
    return h


def _kept(grams: Column, start: Column, count: int) -> Column:
    """Smallest of ``count`` k-gram hashes from ``start`` on, its offset in the low four bits."""
    own = [F.get(grams, start + j).bitwiseAND(F.lit(-16)).bitwiseOR(F.lit(j)) for j in range(count)]
    return F.least(*own) if count > 1 else own[0]


def benchmark_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text",
                      window: int = WINDOW) -> DataFrame:
    """(item, length, win): the distinct windows of each item, words joined by blanks."""
    words = benchmark.select(
        F.col(id_col).cast("string").alias("item"),
        T.words(T.lower_ascii(F.col(text_col)), T.NOT_ALNUM).alias("w"),
    ).where(F.size("w") > 0).withColumn("length", F.least(F.size("w"), F.lit(window)))
    starts = words.select("item", "w", "length", F.explode(T.upto(F.size("w") - F.col("length") + 1)).alias("s"))
    return starts.select(
        "item", "length", F.array_join(F.slice("w", F.col("s") + 1, F.col("length")), " ").alias("win")).distinct()


def window_fingerprints(windows: DataFrame, lengths: list[int]) -> DataFrame:
    """(length, fp, offset, win): one fingerprint for each distinct window text."""
    folded = windows.select("length", "win").distinct().withColumn(
        "h", T.hashes(F.split(T.fold(F.col("win")), " ")))

    def value(n: int) -> Column:
        return T.let(_grams(F.col("h"), _gram(n)), lambda g: _kept(g, F.lit(0), n - _gram(n) + 1))

    kept = F.coalesce(*[F.when(F.col("length") == n, value(n)) for n in lengths])
    return folded.select("length", kept.alias("v"), "win").select(
        "length", F.col("v").bitwiseAND(F.lit(-16)).alias("fp"),
        F.col("v").bitwiseAND(F.lit(15)).cast("int").alias("offset"), "win")


def document_fingerprints(hashed: DataFrame, length: int) -> DataFrame:
    """(_k1, _k2, at, fp): the kept k-grams of the documents, and a row without fp per document.

    ``hashed`` has the word hashes ``h`` and their number ``n``. A k-gram kept by several
    windows in a row is told once.
    """
    count = length - _gram(length) + 1
    grams = hashed.select("doc", "_k1", "_k2", "n", _grams(F.col("h"), _gram(length)).alias("g"))
    row = grams.select("*", F.posexplode(F.array_append("g", F.lit(0).cast("long"))).alias("s", "_"))
    full = F.col("s") <= F.size("g") - count
    kept = row.select("doc", "_k1", "_k2", "n", (F.col("s") == F.size("g")).alias("last"), "s",
                      F.when(full, _kept(F.col("g"), F.col("s"), count)).alias("v"),
                      F.when(full, _kept(F.col("g"), F.col("s") - 1, count)).alias("b"))
    at, was = F.col("s") + F.col("v").bitwiseAND(F.lit(15)), F.col("s") - 1 + F.col("b").bitwiseAND(F.lit(15))
    new = F.col("v").isNotNull() & ((F.col("s") == 0) | (at != was))
    return kept.where(F.col("last") | new).select(
        "doc", "_k1", "_k2", "n", "last", at.cast("int").alias("at"), F.col("v").bitwiseAND(F.lit(-16)).alias("fp"))


def contamination(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per document: its id, n_words, n_hit, n_items, items (sorted ids), items_sha256."""
    docs = documents.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    windows = cut_lineage(benchmark_windows(benchmark, item_col, item_text, window))
    found = {r.length for r in windows.select("length").distinct().collect()}  # at most `window` values
    lengths = sorted(found | {window})
    prints = cut_lineage(window_fingerprints(windows, lengths))
    few_prints = small_enough(prints, BROADCAST_FINGERPRINTS)

    keys = row_key(F.col("doc"), F.col("text"))
    hashed = docs.select("doc", *keys, T.hashes(T.words(T.fold(F.col("text")), T.NOT_ALNUM)).alias("h")).withColumn(
        "n", F.size("h").cast("long"))
    parts = []
    for length in lengths:
        own = prints.where(F.col("length") == length).select(F.col("fp").alias("p"), "offset", "win")
        own = F.broadcast(own) if few_prints else own
        rows = document_fingerprints(hashed, length)
        rows = rows if length == window else rows.where(~F.col("last"))
        joined = rows.join(own, (F.col("fp") == F.col("p")) & ~F.col("last"), "left")
        parts.append(joined.where(F.col("last") | F.col("win").isNotNull()).select(
            "doc", "_k1", "_k2", "n", "last", (F.col("at") - F.col("offset")).alias("start"), "win"))
    found_rows = parts[0]
    for part in parts[1:]:
        found_rows = found_rows.unionByName(part)
    found_rows = cut_lineage(found_rows)

    hits = found_rows.where(~F.col("last") & (F.col("start") >= 0)).groupBy("_k1", "_k2").agg(
        F.collect_set(F.struct("start", "win")).alias("hits"))
    texts = docs.select("text", *keys)
    size = found_rows.where(F.col("win").isNotNull()).agg(F.sum(F.octet_length("win") + 24)).first()[0] or 0
    hit_docs = F.broadcast(hits) if size <= BROADCAST_BYTES else hits
    joined = texts.join(hit_docs, ["_k1", "_k2"]).select(
        "_k1", "_k2", "hits", T.words(T.lower_ascii(F.col("text")), T.NOT_ALNUM).alias("w"))
    same = T.let(F.col("w"), lambda w: F.filter("hits", lambda x: F.array_join(
        F.slice(w, x["start"] + 1, F.size(F.split(x["win"], " "))), " ") == x["win"]))
    exact = cut_lineage(joined.select("_k1", "_k2", same.alias("spans")).where(F.size("spans") > 0).groupBy("_k1", "_k2").agg(
        F.first("spans").alias("spans")))

    n_hit = F.size(F.array_distinct(F.flatten(F.transform("spans", lambda x: F.sequence(
        x["start"], x["start"] + F.size(F.split(x["win"], " ")) - 1)))))
    items = exact.select("_k1", "_k2", F.explode(F.array_distinct(F.transform("spans", lambda x: x["win"]))).alias("win")).join(
        windows.select("win", "item"), "win").groupBy("_k1", "_k2").agg(
        F.countDistinct(F.coalesce("item", F.lit("\x00"))).alias("n_items"), F.sort_array(F.collect_set("item")).alias("items"))
    per_doc = exact.select("_k1", "_k2", n_hit.cast("long").alias("n_hit")).join(items, ["_k1", "_k2"], "left")
    out = found_rows.where("last").select("doc", "_k1", "_k2", "n").join(per_doc, ["_k1", "_k2"], "left")
    ids = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        "_k1", "_k2", F.col("doc").alias(id_col), F.col("n").alias("n_words"),
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), ids.alias("items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"))


def contaminated() -> Column:
    """At least one word in twenty lies in a benchmark window."""
    return (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))


def decontaminate(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, with all their columns, that are not contaminated."""
    dirty = contamination(documents, benchmark).where(contaminated()).select("_k1", "_k2").distinct()
    k1, k2 = row_key(F.col("doc_id"), F.col("text"))
    kept = documents.withColumns({"__k1": k1, "__k2": k2}).join(
        dirty.toDF("__d1", "__d2"), (F.col("__k1") == F.col("__d1")) & (F.col("__k2") == F.col("__d2")), "left_anti")
    return kept.drop("__k1", "__k2")
