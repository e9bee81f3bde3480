"""Near-duplicate documents by SimHash fingerprints, compared exactly in tiles.

A document's fingerprint has a bit for each of the 64 bits of its shingles' hashes: 1 where
over half of them have it. Fingerprints that differ in at most ``radius`` bits are linked.

Equal fingerprints are one item. Items are dealt into tiles by their population counts, taken
for each of several equal parts of the 64 bits: the differences of these counts add up to a
bound under the number of differing bits, so only tiles whose counts lie within the radius
meet. A full tile is cut into blocks; each pair of blocks is compared whole, by exclusive-or
and bit counts in numpy, and sends back the links of a spanning forest, at most one for each
item. No pair within the radius is left out, and more parts for larger tables (``parts_for``)
only skip more pairs that are beyond it.

Texts without words, null and empty ones have the fingerprint zero and are linked like any
other. Documents are told apart by content: rows that share an id but not the text are not
linked by that. A row with a null id gets the component of its fingerprint, which is null where no
row of the group has an id. Repeated rows are returned each. Other columns are not read, and
an empty table gives an empty table. A word may be as long as memory for one text allows;
shingles are hashed in bounded pieces.
"""
from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .tables import bound_batches, cut_lineage, small_enough

SHINGLE, SEED, BITS = 3, 42, 64
RADIUS = 2
#: Items of a block; a task compares two blocks at once.
BLOCK = 4_096
#: Copies of items that meet in one task, over all its pairs of blocks.
TASK_ROWS = 1 << 16
#: Bytes of a text hashed at once, and cells of a table of differences.
PIECE, CELLS = 1 << 20, 1 << 20
#: Pairs of tiles are broadcast up to this number (some 30 bytes each).
BROADCAST_PAIRS = 200_000
BLANK = re.compile(rb"[\x20\x09-\x0D]")


def _pieces(text: bytes) -> Iterator[bytes]:
    """The text in parts of about PIECE bytes, cut before white space."""
    start = 0
    while start < len(text):
        cut = BLANK.search(text, start + PIECE)
        stop = cut.start() if cut else len(text)
        yield text[start:stop]
        start = stop


def shingle_hashes(text: bytes) -> Iterator[np.ndarray]:
    """The hashes of all shingles, repeats included, in bounded arrays."""
    last: list[bytes] = []
    whole = True
    for piece in _pieces(text):
        words = last + piece.lower().split()
        n = len(words) - SHINGLE + 1
        if n > 0:
            grams = zip(*(itertools.islice(words, k, None) for k in range(SHINGLE)), strict=False)
            yield np.fromiter((xxhash.xxh64_intdigest(b" ".join(g), SEED) for g in grams), np.uint64, n)
            whole = False
        last = words[1 - SHINGLE:]
    if whole and last:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(last), SEED)], np.uint64)


def fingerprint(text: bytes | None) -> int:
    """The fingerprint as a signed 64-bit number."""
    ones, n = np.zeros(BITS, np.int64), 0
    for h in shingle_hashes(text or b""):
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def fingerprints(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) of every row."""
    bound_batches(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = (fingerprint(x.as_py()) for x in batch.column("text").cast(pa.large_binary()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(prints, pa.int64())], names=["id", "fp"])

    docs = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, fp bigint")


def parts_for(items: int) -> int:
    """Parts whose population counts name a tile; a tile of evenly spread items stays below some 25,000."""
    return 4 if items <= 1 << 24 else 8 if items <= 1 << 30 else 16


def _base(parts: int, radius: int) -> int:
    """The base in which counts are digits of a tile; counts moved by the radius stay apart from all others."""
    return 1 << (BITS // parts + radius).bit_length()


def tile_of(fp: Column, parts: int, radius: int = RADIUS) -> Column:
    width, base = BITS // parts, _base(parts, radius)
    mask = (1 << width) - 1 if parts > 1 else -1
    digits = [F.bit_count(F.shiftrightunsigned(fp, width * k).bitwiseAND(F.lit(mask))).cast("long") for k in range(parts)]
    return sum((d * base**k for k, d in enumerate(digits[1:], 1)), digits[0])


def steps(parts: int, radius: int = RADIUS) -> list[int]:
    """From a tile to those whose counts differ by at most the radius, in one direction."""
    base, found = _base(parts, radius), {(): 0}
    for _ in range(parts):
        found = {(*key, d): used + abs(d) for key, used in found.items() for d in range(used - radius, radius - used + 1)}
    return sorted(x for x in (sum(d * base**k for k, d in enumerate(key)) for key in found) if x >= 0)


def tile_pairs(items: DataFrame, parts: int, radius: int = RADIUS) -> DataFrame:
    """(tile, blk, pair, side): the pairs of blocks in which the items of a block take part.

    ``side`` is 0 or 1, and 2 in the pair of a block with itself. Should two pairs share a
    hash, their items are compared together, so nothing is lost.
    """
    sizes = cut_lineage(items.groupBy("tile").agg(F.ceil(F.count("*") / BLOCK).alias("blks")))
    left = sizes.select("tile", "blks", F.explode(F.array(*map(F.lit, steps(parts, radius)))).alias("step"))
    met = left.withColumn("tile2", F.col("tile") + F.col("step")).join(
        sizes.select(F.col("tile").alias("tile2"), F.col("blks").alias("blks2")), "tile2")
    met = met.withColumn("blk", F.explode(F.sequence(F.lit(0), F.col("blks") - 1)))
    first = F.when(F.col("step") == 0, F.col("blk")).otherwise(0)
    met = met.withColumn("blk2", F.explode(F.sequence(first, F.col("blks2") - 1)))
    pair = F.xxhash64("tile", "blk", "tile2", "blk2").alias("pair")
    met = cut_lineage(met.select("tile", "blk", "tile2", "blk2", pair))
    other = (F.col("tile") != F.col("tile2")) | (F.col("blk") != F.col("blk2"))
    return met.select("tile", "blk", "pair", F.when(other, 0).otherwise(2).alias("side")).unionByName(
        met.where(other).select(F.col("tile2").alias("tile"), F.col("blk2").alias("blk"), "pair", F.lit(1).alias("side")))


def forest(one: np.ndarray, two: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links (i, j) between places of two blocks (the second may be the first) that connect whatever lies within the radius."""
    same = two is one
    comp = np.arange(len(one) + (0 if same else len(two)))
    offset, links = 0 if same else len(one), []
    rows = max(1, CELLS // max(1, len(two)))
    for start in range(0, len(one), rows):
        near = np.bitwise_count(one[start:start + rows, None] ^ two) <= radius
        for k in np.flatnonzero(near.sum(axis=1) > same):
            i, met = start + k, np.flatnonzero(near[k])
            groups, at = np.unique(comp[met + offset], return_index=True)
            at = at[groups != comp[i]]
            if len(at):
                links += [(i, int(j)) for j in met[at]]
                comp[np.isin(comp, groups)] = comp[i]
    return links


def near_links(prints: DataFrame, radius: int = RADIUS, parts: int | None = None) -> DataFrame:
    """(a, b): links between distinct fingerprints ``fp`` that connect all pairs within the radius."""
    n = prints.count()
    parts = parts or parts_for(n)
    items = prints.select("fp", tile_of(F.col("fp"), parts, radius).alias("tile"))
    pairs = tile_pairs(items, parts, radius)
    sizes = pairs.where("side = 2").groupBy("tile").agg((F.max("blk") + 1).alias("blks"))
    dealt = items.join(sizes, "tile").withColumn("blk", F.pmod(F.xxhash64("fp"), F.col("blks")))
    pairs = F.broadcast(pairs) if small_enough(pairs, BROADCAST_PAIRS) else pairs
    tasks = 1 + n * len(steps(parts, radius)) * 2 // TASK_ROWS
    full = dealt.join(pairs, ["tile", "blk"]).select(F.pmod("pair", F.lit(tasks)).alias("task"), "pair", "side", "fp")

    def run(table: pa.Table) -> pa.Table:
        pair, side, fp = (table.column(c).to_numpy() for c in ("pair", "side", "fp"))
        order = np.lexsort((side, pair))
        pair, side, fp = pair[order], side[order], fp[order].view(np.uint64)
        cuts = np.flatnonzero((np.diff(pair) != 0) | (np.diff(side == 2) != 0)) + 1
        out = []
        for own, sides in zip(np.split(fp, cuts), np.split(side, cuts), strict=True):
            half = int(np.searchsorted(sides, 1))
            one, two = (own, own) if half == 0 else (own[:half], own[half:])
            out += [(one[i], two[j]) for i, j in forest(one, two, radius)]
        ends = np.array(out, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.table({"a": ends[:, 0], "b": ends[:, 1]})

    return full.groupBy("task").applyInArrow(run, "a bigint, b bigint")


def simhash_groups(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   radius: int = RADIUS, parts: int | None = None) -> DataFrame:
    """(id, fingerprint, component_id) of every row."""
    docs = cut_lineage(fingerprints(documents, id_col, text_col))
    prints = cut_lineage(docs.groupBy("fp").agg(F.min("id").alias("least")))
    labels = components(near_links(prints.select("fp"), radius, parts))
    groups = cut_lineage(prints.join(labels.select(F.col("node").alias("fp"), "root"), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")))
    best = groups.groupBy("root").agg(F.min("least").alias("component_id"))
    named = groups.join(best, "root").select("fp", "component_id")
    return docs.join(named, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
