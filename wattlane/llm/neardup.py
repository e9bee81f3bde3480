"""Near-duplicate documents by SetSketch registers.

Each document's five-word shingles fill 180 registers with exponentially spaced, truncated
minima; registers of parts merge by maximum, and equal registers are as likely as the sets
are similar. Documents of one shingle set form a class and go on as one. Classes that share
a band of five registers are candidates; their similarity is first estimated jointly by
likelihood, then confirmed on the full sets.

Within a band a leader is compared with the others; candidates that are then still in
different components are compared block by block inside the tasks, each pair in the first
band that it shares. No link between components is left out, and no join gives all pairs.

Texts without words, null and empty ones are linked with nothing. Rows with a null id are
not linked: their component is null and they are kept. Rows that share an id count as one
document, linked, and each of its texts is compared. Other columns are not read. Empty tables give empty tables.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingles as S
from .components import components, in_blocks, linked
from .tables import bound_batches, cut_lineage, small_enough

#: Links have a similarity of at least 75 / 100.
SHARE = 75
#: Estimates below this (four standard errors under the threshold) are not verified.
LEAST_ESTIMATE = 0.62
#: Classes of a block; two blocks are compared at once.
BLOCK = 200
#: Shingle sets or registers of up to so many bytes are broadcast to the pairs.
BROADCAST_BYTES = 16 << 20
#: Up to so many ids, the texts to verify are found by broadcast (16 bytes each).
BROADCAST_IDS = 100_000


def _texts(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def sketches(documents: DataFrame) -> DataFrame:
    """(id, n, d1, d2, regs) of (id, text): set size, digest and registers."""
    bound_batches(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = S.shingle_sets(_texts(batch.column("text")))
            digests = [S.digest(x) for x in sets]
            yield pa.RecordBatch.from_arrays([
                batch.column("id"), pa.array([len(x) for x in sets], pa.int64()),
                pa.array([d[0] for d in digests], pa.int64()), pa.array([d[1] for d in digests], pa.int64()),
                pa.array([S.registers(x).tobytes() if len(x) else None for x in sets], pa.binary())],
                names=["id", "n", "d1", "d2", "regs"])

    return documents.select("id", "text").mapInArrow(run, "id bigint, n bigint, d1 bigint, d2 bigint, regs binary")


def shingle_sets(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, items, regs) of the wanted ids among (id, text): sorted shingle hashes and registers as bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = S.shingle_sets(_texts(batch.column("text")))
            yield pa.RecordBatch.from_arrays([
                batch.column("id"), pa.array([x.tobytes() for x in sets], pa.binary()),
                pa.array([S.registers(x).tobytes() for x in sets], pa.binary())], names=["id", "items", "regs"])

    wanted = F.broadcast(ids) if small_enough(ids, BROADCAST_IDS) else ids
    return cut_lineage(documents.select("id", "text").join(wanted, "id", "left_semi").mapInArrow(
        run, "id bigint, items binary, regs binary"))


def _near(df: DataFrame, column: str) -> DataFrame:
    """A broadcast hint where all values of a column together are small."""
    size = df.agg(F.sum(F.octet_length(column))).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def band_rows(classes: DataFrame) -> DataFrame:
    """(band, id): a row for each band of each class."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            regs = np.frombuffer(b"".join(batch.column("regs").to_pylist()), np.uint16).reshape(-1, S.REGISTERS)
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [pa.array(S.bands(regs).ravel()), pa.array(np.repeat(ids, S.BANDS))], names=["band", "id"])

    return classes.select("id", "regs").mapInArrow(run, "band bigint, id bigint")


def _ends(pairs: DataFrame) -> DataFrame:
    return cut_lineage(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct())


def _likely(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose estimated similarity is high enough to verify."""
    ids = _ends(pairs)
    own = cut_lineage(classes.join(F.broadcast(ids) if small_enough(ids, BROADCAST_IDS) else ids, "id", "left_semi").select("id", "n", "regs"))
    one = _near(own.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("regs").alias("ra")), "ra")
    two = _near(own.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("regs").alias("rb")), "rb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            regs = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, S.REGISTERS) for c in ("ra", "rb")]
            sizes = [batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("na", "nb")]
            yield batch.select(["a", "b"]).filter(pa.array(S.likely_similarity(*regs, *sizes) >= LEAST_ESTIMATE))

    near = 100 * F.least("na", "nb") >= SHARE * F.greatest("na", "nb")
    joined = pairs.join(one, "a").join(two, "b").where(near)
    return joined.select("a", "b", "na", "nb", "ra", "rb").mapInArrow(run, "a bigint, b bigint")


def verified(pairs: DataFrame, documents: DataFrame, share: int = SHARE) -> DataFrame:
    """The pairs (a, b) of documents (id, text) whose full shingle sets are similar enough."""
    pairs = cut_lineage(pairs)
    sets = shingle_sets(documents, _ends(pairs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * common >= share * (len(p) + len(q) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(_near(sets.select(F.col("id").alias("a"), F.col("items").alias("x")), "x"), "a").join(
        _near(sets.select(F.col("id").alias("b"), F.col("items").alias("y")), "y"), "b")
    return joined.select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def compared(rows: DataFrame, documents: DataFrame, share: int = SHARE) -> DataFrame:
    """(a, b): the similar pairs of different components among the classes of each band."""
    sets = shingle_sets(documents, cut_lineage(rows.select("id").distinct()))
    dealt = in_blocks(rows, BLOCK).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blks") - 1)))
    dealt = dealt.select("band", "id", "comp", "blk", F.least("blk", "other").alias("x"), F.greatest("blk", "other").alias("y"))
    full = dealt.join(_near(sets, "items"), "id")

    def run(key: tuple, table: pa.Table) -> pa.Table:
        band, x, y = (k.as_py() for k in key)
        ids, comp, blk = (table.column(c).to_numpy() for c in ("id", "comp", "blk"))
        comp = comp.copy()
        items = [np.frombuffer(v, np.uint64) for v in table.column("items").to_pylist()]
        n = np.array([len(v) for v in items], float)
        regs = np.frombuffer(b"".join(table.column("regs").to_pylist()), np.uint16).reshape(-1, S.REGISTERS)
        keys = S.bands(regs)
        order, links = np.arange(len(ids)), []
        for i in order[blk == x]:
            sizes = 100 * np.minimum(n[i], n) >= share * np.maximum(n[i], n)
            own = (blk == y) & (comp != comp[i]) & sizes & ((order > i) | (x != y))
            j = order[own]
            same = keys[j] == keys[i]
            j = j[keys[i][same.argmax(axis=1)] == band]  # the first band that the pair shares
            if len(j):
                j = j[S.likely_similarity(np.repeat(regs[i:i + 1], len(j), 0), regs[j], np.full(len(j), n[i]), n[j]) >= LEAST_ESTIMATE]
            for k in j:
                if comp[k] == comp[i]:
                    continue
                common = len(np.intersect1d(items[i], items[k], assume_unique=True))
                if 100 * common >= share * (n[i] + n[k] - common):
                    links.append((ids[i], ids[k]))
                    comp[comp == comp[k]] = comp[i]
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return full.groupBy("band", "x", "y").applyInArrow(run, "a bigint, b bigint")


def near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row."""
    docs = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    texts = docs.where(F.col("id").isNotNull())
    several = cut_lineage(texts.groupBy("id").agg(
        F.min(F.xxhash64("text")).alias("x"), F.max(F.xxhash64("text")).alias("y")).where("x <> y").select("id"))
    if several.isEmpty():
        sketched, labels = _labelled(docs)
        labels = labels.withColumnRenamed("root", "component")
    else:
        # Each text of such an id is compared under a key of its own; the id then links them.
        marked = docs.join(several.withColumn("_s", F.lit(True)), "id", "left")
        keyed = cut_lineage(marked.select("id", F.when(F.col("_s"), F.xxhash64("id", "text")).otherwise(F.col("id")).alias("key"), "text"))
        own = keyed.where(F.col("id").isNotNull()).select("id", "key").distinct()
        same = own.join(own.groupBy("id").agg(F.min("key").alias("a")), "id").where(F.col("key") != F.col("a"))
        sketched, labels = _labelled(keyed.select(F.col("key").alias("id"), "text"), same.select("a", F.col("key").alias("b")))
        ids = own.join(labels.withColumnRenamed("id", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
        least = ids.groupBy("root").agg(F.min("id").alias("component"))
        labels = cut_lineage(ids.join(least, "root").select("key", "id", "component"))
        # A key tells the rows of one id and text, so the sketch of its key is the row's.
        sizes = sketched.where(F.col("id").isNotNull()).select(F.col("id").alias("key"), "n").distinct()
        sketched = keyed.select("id", "key").join(sizes, "key").select("id", "n").unionByName(
            sketched.where(F.col("id").isNull()).select("id", "n"))
        labels = labels.select("id", "component").distinct()
    return sketched.join(labels, "id", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"),
        F.coalesce(F.coalesce("component", "id") == F.col("id"), F.lit(True)).alias("kept"))


def _labelled(docs: DataFrame, links: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Sketches of (id, text), an id for each text, and (id, root) of what links connect."""
    sketched = cut_lineage(sketches(docs))
    useful = sketched.where((F.col("n") > 0) & F.col("id").isNotNull())
    classes = cut_lineage(useful.groupBy("d1", "d2", "n").agg(F.min("id").alias("id"), F.first("regs").alias("regs")))
    members = useful.join(classes.select("d1", "d2", "n", F.col("id").alias("a")), ["d1", "d2", "n"]).select(
        "a", F.col("id").alias("b")).where(F.col("a") != F.col("b"))
    members = members if links is None else members.unionByName(links)
    texts = docs.where(F.col("id").isNotNull())
    found = linked(band_rows(classes), members, lambda pairs: verified(_likely(pairs, classes), texts),
                   lambda rows: compared(rows, texts))
    return sketched, components(found).select(F.col("node").alias("id"), "root")


def keep_one(documents: DataFrame) -> DataFrame:
    """The documents, with all their columns, that have the smallest id of their group."""
    gone = near_duplicates(documents).where(~F.col("kept")).select(F.col("doc_id").alias("__gone")).distinct()
    return documents.join(gone, F.col("doc_id") == F.col("__gone"), "left_anti")
