"""Fuzzy line deduplication by MinHash.

A line's shingles are the 8-character strings at all its places (lower case, blanks
included); a shorter line is one shingle. The minima of the shingle hashes in 72 equal
parts of the hash range make 18 bands of four; lines that share a band are candidates, and
pairs with a Jaccard similarity of at least 75 in 100 of the full shingle sets are linked.
Of each component of links the line of the smallest (document, place) stays; all others go,
exact copies included.

Hashes, minima and exact comparisons are made in numpy, batch by batch: array functions took
1,300 CPU seconds a GB for the signatures alone, of 400 allowed. All else is DataFrame code.

Two lines at the threshold share a band with a chance of 99.9 %. Exact copies are told by
128 bits of hash and need no signature; the link graph names lines by 64 bits.

Lines without a character other than white space are kept as they are. Null texts have no
lines. Rows with a null id are not compared and keep all their lines; rows that share id
and text count as one document, rows that share the id alone are ordered by a hash of the text. Empty tables give empty tables.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import characters as C
from . import text as T
from .components import components, in_blocks, linked
from .tables import bound_batches, cut_lineage, perhaps_in, row_key, small_enough

SHARE = 75
#: Up to so many line keys, lines are found by broadcast (some 90 bytes a key).
BROADCAST_LINES = 100_000
#: Up to so many bytes, the texts of candidate lines are broadcast to their pairs.
BROADCAST_BYTES = 8 << 20
#: Up to so many groups, their best lines are broadcast (some 100 bytes each).
BROADCAST_GROUPS = 100_000
#: Lines of a block; two blocks are compared in one row.
BLOCK = 100


def split_lines(documents: DataFrame) -> DataFrame:
    """(doc, pos, line) of (doc, text): the lower-cased lines that are not blank."""
    return documents.select("doc", F.posexplode(F.split(F.lower("text"), "\n")).alias("pos", "line")).where(
        F.col("line").rlike(r"\S"))


def line_key() -> list[Column]:
    return [F.xxhash64("line").alias("k1"), F.xxhash64(F.lit(7), F.col("line")).alias("k2")]


def band_rows(lines: DataFrame) -> DataFrame:
    """(band, id): a row for each band of each line (k1, line); a task names a line once."""
    bound_batches(lines.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # lines of one task
        for batch in batches:
            new = []
            for i, k in enumerate(batch.column("k1").to_pylist()):
                if k not in seen:
                    seen.add(k)
                    new.append(i)
            if new:
                own = batch.take(pa.array(new))
                line, band = C.band_keys(own.column("line").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(band), pa.array(own.column("k1").to_numpy(zero_copy_only=False)[line])], names=["band", "id"])

    return lines.select("k1", "line").mapInArrow(run, "band bigint, id bigint")


def line_texts(keys: DataFrame, lines: DataFrame) -> DataFrame:
    """(k1, line): the wanted lines."""
    n = keys.count()
    if n > BROADCAST_LINES:
        lines = perhaps_in(lines, "k1", keys, n)  # so that few of the others are exchanged
    wanted = F.broadcast(keys) if n <= BROADCAST_LINES else keys
    return cut_lineage(lines.join(wanted, "k1", "left_semi").groupBy("k1").agg(F.first("line").alias("line")))


def verified(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """The pairs (a, b) of line keys whose full shingle sets are similar enough."""
    wanted = cut_lineage(pairs.select(F.col("a").alias("k1")).unionByName(pairs.select(F.col("b").alias("k1"))).distinct())
    texts = line_texts(wanted, lines)
    size = texts.agg(F.sum(F.octet_length("line"))).first()[0] or 0
    texts = F.broadcast(texts) if size <= BROADCAST_BYTES else texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (batch.column(c).to_pylist() for c in ("x", "y"))
                own = list(dict.fromkeys(x + y))
                sets = dict(zip(own, C.shingle_sets(own), strict=True))
                keep = [C.similar(sets[p], sets[q], SHARE) for p, q in zip(x, y, strict=True)]
                yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(texts.select(F.col("k1").alias("a"), F.col("line").alias("x")), "a").join(
        texts.select(F.col("k1").alias("b"), F.col("line").alias("y")), "b")
    return joined.select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def compared(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """(a, b): the similar pairs of different components among the lines of each band."""
    texts = line_texts(cut_lineage(rows.select(F.col("id").alias("k1")).distinct()), lines)
    blocks = cut_lineage(in_blocks(rows, BLOCK).join(texts, F.col("id") == F.col("k1")).groupBy("band", "blk", "blks").agg(
        F.collect_list(F.struct("id", "comp", "line")).alias("own")))
    # Nearly all bands have one block, which needs no partner.
    alone = blocks.where(F.col("blks") == 1).select("own", F.lit(None).cast(blocks.schema["own"].dataType).alias("other"))
    several = blocks.where(F.col("blks") > 1)
    both = several.join(several.select("band", F.col("blk").alias("blk2"), F.col("own").alias("other")), "band").where(
        F.col("blk") <= F.col("blk2"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for own, other in zip(batch.column("own"), batch.column("other"), strict=True):
                ids, sets, comps = [], [], []
                for block in (own.values, other.values):
                    if block is not None:
                        ids.append(block.field("id").to_numpy(zero_copy_only=False))
                        comps.append(block.field("comp").to_numpy(zero_copy_only=False))
                        sets.append(C.shingle_sets(block.field("line").to_pylist()))
                links = C.similar_pairs(sets[0], sets[1] if len(sets) > 1 else None, SHARE)
                i, j = np.nonzero(links & (comps[0][:, None] != comps[-1][None, :]))
                a.append(ids[0][i])
                b.append(ids[-1][j])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    found = both.select("own", "other").unionByName(alone).mapInArrow(run, "a bigint, b bigint")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def document(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """What names a document: its id, then a hash of id and text."""
    return F.struct(F.col(id_col).alias("id"), *row_key(F.col(id_col), F.col(text_col)))


def dropped_lines(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, dropped): the places of the lines that go, of each document that loses some."""
    docs = documents.where(F.col(id_col).isNotNull()).select(document(id_col, text_col).alias("doc"), F.col(text_col).alias("text"))
    lines = split_lines(docs).select("doc", "pos", "line", *line_key())
    texts = lines.select("k1", "line")
    none = docs.sparkSession.createDataFrame([], "a bigint, b bigint")
    links = linked(band_rows(texts), none, lambda pairs: verified(pairs, texts), lambda rows: compared(rows, texts), rounds=1)
    labels = cut_lineage(components(links).withColumnRenamed("node", "k1"))
    # A line is in the group of its component, or else in that of its exact copies.
    few = small_enough(labels, BROADCAST_LINES)
    labels = F.broadcast(labels) if few else labels
    places = lines.select("doc", "pos", "k1", "k2").join(labels, "k1", "left").select(
        "doc", "pos", F.coalesce("root", "k1").alias("g1"), F.when(F.col("root").isNull(), F.col("k2")).otherwise(0).alias("g2"))
    groups = places.groupBy("g1", "g2").agg(F.min(F.struct("doc", "pos")).alias("best"), F.count("*").alias("n")).where(
        F.col("n") > 1).select("g1", "g2", "best")
    if few:  # else both sides of the next join read one exchange of the lines
        groups = cut_lineage(groups)
        groups = F.broadcast(groups) if small_enough(groups, BROADCAST_GROUPS) else groups
    gone = places.join(groups, ["g1", "g2"]).where((F.col("doc") != F.col("best.doc")) | (F.col("pos") != F.col("best.pos")))
    return gone.groupBy("doc").agg(F.sort_array(F.collect_set("pos")).alias("dropped"))


def report(documents: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_kept, dropped): lines that are not blank, and the places of those that go."""
    gone = cut_lineage(dropped_lines(documents))
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x.rlike(r"\S"))
    return documents.select("doc_id", document().alias("doc"), F.size(lines).cast("long").alias("n_lines")).join(
        gone, "doc", "left").select(
        "doc_id", "n_lines", (F.col("n_lines") - F.coalesce(F.size("dropped"), F.lit(0))).cast("long").alias("n_kept"),
        F.coalesce(F.array_join("dropped", ","), F.lit("")).alias("dropped"))


def without_repeats(documents: DataFrame) -> DataFrame:
    """The documents, with their columns, without the lines that go.

    A document all of whose lines go is left out; ``n_chars`` follows the new text.
    """
    gone = dropped_lines(documents).toDF("__doc", "__gone")
    joined = documents.join(gone, document() == F.col("__doc"), "left")
    kept = T.let(F.split("text", "\n"), lambda l: F.transform(
        F.array_except(T.upto(F.size(l)), "__gone"), lambda i: F.get(l, i)))
    some = T.let(kept, lambda k: F.when(F.exists(k, lambda x: x.rlike(r"\S")), F.array_join(k, "\n")))
    out = joined.withColumn("__text", F.when(F.col("__gone").isNull(), F.col("text")).otherwise(some)).where(
        F.col("__gone").isNull() | F.col("__text").isNotNull())
    new = {"text": F.col("__text")}
    if "n_chars" in documents.columns:
        new["n_chars"] = F.when(F.col("__gone").isNull(), F.col("n_chars")).otherwise(F.length("__text").cast(documents.schema["n_chars"].dataType))
    return out.withColumns(new).select([F.col(f"`{c}`") for c in documents.columns])
