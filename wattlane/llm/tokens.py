"""Token counts without token ids.

Texts are cut into pre-tokens by the tokenizer's own pattern. The pieces of each distinct
pre-token are counted once in a batch, and a document's tokens are the sum over its pre-token
frequencies. Pre-tokens of a bounded head (at most ``HEAD`` of the commonest in a sample of
about ``HEAD_TEXTS`` texts, some 30 bytes each) are joined by broadcast, so that only the rare
rest is shuffled. The head is a cache: any head gives the same counts.

Special strings inside a text are one token each, as the library counts them by default.
Texts with characters that Java's Unicode tables don't know yet are counted by the library
as a whole, since its pattern may class them otherwise.

Null texts count as empty: no bytes, no tokens. Repeated rows get equal results.
"""
from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import bound_batches, cut_lineage, row_key

#: Fixed value: the pre-token pattern of byte-level BPE vocabularies.
PRE_TOKEN = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
HEAD, HEAD_TEXTS = 250_000, 16_000
UNKNOWN_CHARACTER = r"\p{Cn}"


def special_strings(path: str) -> list[str]:
    with open(path) as f:
        return [t["content"] for t in json.load(f)["added_tokens"]]


def _special_pattern(path: str) -> str:
    quoted = [f"\\Q{s}\\E" for s in sorted(special_strings(path), key=len, reverse=True)]
    return "|".join(quoted) or "(?!)"


def pre_tokens(text: Column, special: str) -> Column:
    return F.flatten(F.transform(F.split(text, special), lambda s: F.regexp_extract_all(s, F.lit(PRE_TOKEN), F.lit(0))))


def counted(texts: DataFrame, path: str, col: str) -> DataFrame:
    """The rows with ``n``: the library's token count of column ``col``."""
    bound_batches(texts.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        for frame in frames:
            values, n = frame[col].tolist(), []
            for i in range(0, len(values), 1_000):
                n += [len(e.ids) for e in tokenizer.encode_batch(values[i:i + 1_000], add_special_tokens=False)]
            yield frame.assign(n=n)

    fields = ", ".join(f"`{c}` {t}" for c, t in texts.dtypes)
    return texts.mapInPandas(run, f"{fields}, n bigint")


def weighted(words: DataFrame, path: str) -> DataFrame:
    """(_k1, _k2, n, copies) of rows (_k1, _k2, rare, n, copies): ``n`` times the tokens of the word, if there is one.

    Rows come sorted, so a word's rows follow each other and a batch counts it once. Nothing but
    work depends on that: a word with many rows is split over tasks, and so are rows without one.
    """
    bound_batches(words.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        for frame in frames:
            codes, own = pd.factorize(frame["rare"])
            each = []
            for i in range(0, len(own), 1_000):
                each += [len(e.ids) for e in tokenizer.encode_batch(own[i:i + 1_000].tolist(), add_special_tokens=False)]
            # A null word has the code -1, so it takes the last weight.
            yield frame.assign(n=frame["n"].to_numpy() * np.asarray([*each, 1], "int64")[codes]).drop(columns="rare")

    near = words.hint("rebalance", F.col("rare")).sortWithinPartitions("rare")
    return near.select("_k1", "_k2", "rare", "n", "copies").mapInPandas(run, "_k1 bigint, _k2 bigint, n bigint, copies bigint")


def token_counts(documents: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens) of every row."""
    special = _special_pattern(path)
    docs = documents.select(F.col(id_col).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    docs = docs.select("doc", "text", *row_key(F.col("doc"), F.col("text")))
    odd = F.col("text").rlike(UNKNOWN_CHARACTER)

    share = min(1.0, HEAD_TEXTS / max(1, docs.count()))
    sample = docs.where(F.pmod("_k1", F.lit(1_000_000)) < int(share * 1_000_000))
    head = sample.select(F.explode(pre_tokens(F.col("text"), special)).alias("piece")).groupBy("piece").count().orderBy(
        F.desc("count"), "piece").limit(HEAD).select("piece")
    head = cut_lineage(counted(head, path, "piece").select(F.col("piece").alias("known"), "n"))

    pieces = F.array_append(F.when(odd, F.array().cast("array<string>")).otherwise(pre_tokens(F.col("text"), special)), F.lit(None).cast("string"))
    rows = docs.select("_k1", "_k2", F.explode(pieces).alias("piece"))
    by_row = rows.join(F.broadcast(head), F.col("piece") == F.col("known"), "left").groupBy(
        "_k1", "_k2", F.when(F.col("known").isNull(), F.col("piece")).alias("rare")).agg(
        # Tokens of known pieces, and times of a rare one; the null piece only counts the row.
        F.sum(F.when(F.col("piece").isNull(), 0).otherwise(F.coalesce("n", F.lit(1)))).alias("n"),
        F.count(F.when(F.col("piece").isNull(), True)).alias("copies"))
    whole = counted(docs.where(odd).select("_k1", "_k2", "text"), path, "text").select(
        "_k1", "_k2", "n", F.lit(0).cast("long").alias("copies"))
    # Copies of a row share its key: the sum over all of them is shared out again.
    total = weighted(by_row, path).unionByName(whole).groupBy("_k1", "_k2").agg((F.sum("n") / F.sum("copies")).cast("long").alias("pieces"))
    size = docs.select("doc", "_k1", "_k2", F.octet_length("text").cast("long").alias("n_bytes"),
                       F.when(odd, F.lit(0)).otherwise(F.size(F.split("text", special)) - 1).alias("specials"))
    return size.join(total, ["_k1", "_k2"]).select(
        F.col("doc").alias(id_col), "n_bytes", (F.col("pieces") + F.col("specials")).alias("n_tokens"))
