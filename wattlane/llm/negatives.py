"""Hard negatives by an inverted multi-index.

Vectors are cut into two halves, and each half is assigned to a word of a codebook; a pair of
words is a cell. For an anchor, a half's score within a word is at most the inner product with
the word plus the anchor's length times the word's radius, so the sum of two half bounds holds
for all rows of a cell. A heap visits the cells from the highest bound down (the
multi-sequence walk over two sorted lists), scores their rows exactly in integers, and stops
as soon as what it looks for is certified: no unvisited cell can hold anything better.

Two walks are made: the first finds an anchor's positives, the best rows of its own label; the
second, for each positive, the best rows of other labels whose score lies in a window below
the positive's score. Rows are dealt into shards by a hash, each an index of its own with the
shared codebooks; anchors meet the shards in blocks, and the best of all shards are merged by
rank. So any group of equal vectors is spread evenly, and every task is bounded.

The codebooks are fitted by k-means on at most ``SAMPLE_ROWS`` distinct vectors; they decide
how much is skipped, never the result.

Rows with a null id, label or vector, or a null or non-finite component, take no part. A
component x becomes floor(256 * x), at most ``largest`` in size where that is given; shorter
vectors count as filled up with zeros. Scores are exact whatever their size; one that 64 bits
cannot hold is returned as the nearest number that they can. Rows that agree in id, label and vector are one or, with ``copies``, rows of their own, as
positives, as negatives and as anchors; rows that share an anchor's id are
never its positives or negatives; ties go to the smaller id. Other columns are not read. An
empty table, or one without anchors, gives an empty table.
"""
from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import bound_batches, cut_lineage

SCALE, LARGEST = 256, 1 << 22
#: Rows of a shard, anchors of a block.
SHARD_ROWS, ANCHOR_ROWS = 8_192, 8_192
#: Words of a half's codebook, rows that it is fitted on, and rounds of fitting.
CODEWORDS, SAMPLE_ROWS, ROUNDS = 16, 20_000, 12
#: Rows gathered from cells before they are scored together.
AT_ONCE = 256
#: Sums of products below this are exact in floating point, and below that in 64 bits.
EXACT, WHOLE = 1 << 53, 1 << 63

RESULT = "anchor_id bigint, akey bigint, {}id bigint, score bigint"


def usable(table: DataFrame, id_col: str, vec_col: str, label: Column, largest: int | None = LARGEST) -> DataFrame:
    """(id, label, v): the rows that take part, with integer components (as doubles, which hold each of them)."""
    fits = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    v = F.col("raw")
    cut = (lambda x: x) if largest is None else (lambda x: F.greatest(F.least(x, F.lit(float(largest))), F.lit(float(-largest))))
    # A double from 2^52 on is whole, and may be more than the long that floor gives.
    floor = lambda x: F.when(F.abs(x) < float(1 << 52), F.floor(x).cast("double")).otherwise(x)
    whole = F.transform(v, lambda x: floor(cut(x * SCALE)))
    return table.select(F.col(id_col).cast("long").alias("id"), label.cast("string").alias("label"),
                        F.col(vec_col).cast("array<double>").alias("raw")).where(
        F.col("id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & F.forall(v, fits)).select(
        "id", "label", whole.alias("v"))


def _matrix(vectors: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Rows of integers, filled up with zeros to the width; Python's integers where 64 bits are too few."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    flat = flat.astype(np.int64) if np.abs(flat).max(initial=0) < WHOLE else np.array([int(x) for x in flat], object)
    sizes = np.diff(vectors.offsets.to_numpy())
    out = np.zeros((len(vectors), width), flat.dtype)
    row = np.repeat(np.arange(len(vectors)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def k_means(rows: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centres of the rows, at most k; a centre without rows stays where it is."""
    rows = np.unique(rows.astype(float), axis=0)
    rng = np.random.default_rng(0)
    centres = rows[np.sort(rng.permutation(len(rows))[:k])]
    for _ in range(rounds):
        word = nearest(rows, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, word, rows)
        n = np.bincount(word, minlength=len(centres))[:, None]
        centres = np.where(n > 0, sums / np.maximum(n, 1), centres)
    return centres


def nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(axis=1) - 2 * rows @ centres.T).argmin(axis=1)


def codebooks(rows: DataFrame, n: int, width: int) -> list[np.ndarray]:
    """The words of both halves, from distinct vectors drawn by hash."""
    drawn = F.pmod(F.xxhash64(F.lit(3), "v"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, SAMPLE_ROWS / max(n, 1)))
    sample = rows.where(drawn).select("v", F.xxhash64("v").alias("h")).dropDuplicates(["h"]).orderBy("h").limit(SAMPLE_ROWS)
    sample = sample.select("v").toArrow().column("v")
    if not len(sample):  # the draw may miss a small table of few distinct vectors
        sample = rows.select("v").limit(1).toArrow().column("v")
    matrix = _matrix(sample, width)
    half = width // 2
    return [k_means(matrix[:, :half], CODEWORDS), k_means(matrix[:, half:], CODEWORDS)]


class Shard:
    """A multi-index over the rows of one shard."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray, books: list[np.ndarray]) -> None:
        order = np.lexsort((ids,))
        self.ids, self.labels, self.rows = ids[order], labels[order], rows[order]
        self.books, self.half = books, books[0].shape[1]
        self.radii, words = [], []
        for book, part in zip(books, self._halves(self.rows), strict=True):
            word = nearest(part, book)
            radius = np.zeros(len(book))
            np.maximum.at(radius, word, np.sqrt(((part - book[word]) ** 2).sum(axis=1)))
            self.radii.append(radius)
            words.append(word)
        self.cells: dict[tuple[int, int], np.ndarray] = {}
        code = words[0] * len(books[1]) + words[1]
        by_cell = np.argsort(code, kind="stable")
        for part in np.split(by_cell, np.flatnonzero(np.diff(code[by_cell])) + 1):
            if len(part):
                self.cells[divmod(int(code[part[0]]), len(books[1]))] = part
        self.largest = int(np.abs(self.rows).max(initial=0))
        self.quick = self.rows.astype(float)

    def _halves(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return rows[..., :self.half].astype(float), rows[..., self.half:].astype(float)

    def scores(self, at: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        most = len(anchor) * self.largest * int(np.abs(anchor).max(initial=0))
        if most < EXACT:
            return (self.quick[at] @ anchor.astype(float)).astype(np.int64)
        if most < WHOLE:
            return self.rows[at] @ anchor
        return self.rows[at].astype(object) @ anchor.astype(object)

    def walk(self, anchor: np.ndarray) -> Iterator[tuple[float, float, np.ndarray]]:
        """(bound, least, rows) of the cells that have rows, from the highest bound down.

        No row of this cell or a later one scores over ``bound``, none of this cell under ``least``.
        """
        mids, slack = [], []
        for part, book, radius in zip(self._halves(anchor), self.books, self.radii, strict=True):
            size = np.sqrt((part**2).sum())
            mid = book @ part
            mids.append(mid)
            # A little more than the radius, for rounding.
            slack.append(size * radius + 1e-9 * size * (np.sqrt((book**2).sum(axis=1)) + radius) + 1e-6)
        high = [m + s for m, s in zip(mids, slack, strict=True)]
        order = [np.argsort(-h, kind="stable") for h in high]
        heap, seen = [(-(high[0][order[0][0]] + high[1][order[1][0]]), 0, 0)], {(0, 0)}
        while heap:
            bound, i, j = heapq.heappop(heap)
            a, b = int(order[0][i]), int(order[1][j])
            if (a, b) in self.cells:
                yield -bound, mids[0][a] - slack[0][a] + mids[1][b] - slack[1][b], self.cells[a, b]
            for x, y in ((i + 1, j), (i, j + 1)):
                if x < len(order[0]) and y < len(order[1]) and (x, y) not in seen:
                    seen.add((x, y))
                    heapq.heappush(heap, (-(high[0][order[0][x]] + high[1][order[1][y]]), x, y))

    def batches(self, anchor: np.ndarray, most: float | int = np.inf) -> Iterator[tuple[float, np.ndarray]]:
        """(bound, rows): some cells at a time; what comes later scores at most ``bound``.

        Cells of which all rows score over ``most`` are left out.
        """
        held: list[np.ndarray] = []
        for bound, least, rows in self.walk(anchor):
            if held and sum(map(len, held)) >= AT_ONCE:
                yield bound, np.concatenate(held)
                held = []
            if least <= most:
                held.append(rows)
        yield -np.inf, np.concatenate(held) if held else np.zeros(0, np.int64)

    def positives(self, anchor_id: int, label: str, anchor: np.ndarray, k: int) -> list[tuple[int, int]]:
        """(score, id) of the best rows of the label, best first."""
        best: list[tuple[int, int]] = []
        for bound, rows in self.batches(anchor):
            rows = rows[(self.labels[rows] == label) & (self.ids[rows] != anchor_id)]
            best = _first(best, self.scores(rows, anchor), self.ids[rows], k)
            if len(best) == k and best[-1][0] > bound:
                break
        return best

    def negatives(self, anchor_id: int, label: str, anchor: np.ndarray, windows: list[tuple[int, int]],
                  k: int) -> list[list[tuple[int, int]]]:
        """For each window (least, most) of hundredths of a score, the first (score, id) of other labels."""
        found: list[list[tuple[int, int]]] = [[] for _ in windows]
        live = [w for w, (least, most) in enumerate(windows) if least <= most]
        top = max((windows[w][1] for w in live), default=0)
        for bound, rows in self.batches(anchor, top // 100) if live else ():
            rows = rows[(self.labels[rows] != label) & (self.ids[rows] != anchor_id)]
            scores = self.scores(rows, anchor)
            for w in live:
                least, most = windows[w]
                # Of the window's ends, as 100 times a score may be more than 64 bits hold.
                own = (scores >= -(-least // 100)) & (scores <= most // 100)
                found[w] = _first(found[w], scores[own], self.ids[rows[own]], k)
            live = [w for w in live if 100 * bound >= windows[w][0] and not (len(found[w]) == k and found[w][-1][0] > bound)]
            if not live:
                break
        return found


def _first(best: list[tuple[int, int]], scores: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[int, int]]:
    """The first k of all, higher scores first, smaller ids first among equals."""
    if not len(scores):
        return best
    if scores.dtype == object:
        first = sorted(range(len(scores)), key=lambda i: (-scores[i], ids[i]))[:k]
    else:
        first = np.lexsort((ids, -scores))[:k]
    joined = best + [(int(scores[i]), int(ids[i])) for i in first]
    return sorted(joined, key=lambda x: (-x[0], x[1]))[:k]


def _meet(rows: DataFrame, anchors: DataFrame, blocks: int, shards: int):
    """Rows and anchors grouped so that each shard meets each block of anchors."""
    each = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    left = rows.select(F.pmod(F.xxhash64("id", "v"), F.lit(shards)).alias("shard"), each(blocks, "block"), "id", "label", "v", "n").select(
        "shard", "block", "id", "label", "v", F.explode(F.sequence(F.lit(1), "n")).alias("copy"))
    right = anchors.withColumn("shard2", each(shards, "shard2")).withColumn("block2", F.pmod("akey", F.lit(blocks)))
    return left.groupBy("shard", "block").cogroup(right.groupBy("shard2", "block2"))


def _best(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(table: DataFrame, is_anchor: Column, id_col: str = "vec_id", vec_col: str = "embedding",
                   label: Column | None = None, positives: int = 5, negatives: int = 10,
                   window: tuple[int, int] = (30, 90), largest: int | None = LARGEST,
                   copies: bool = False) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``is_anchor`` is a condition on the column ``id``; ``window`` gives hundredths of the
    positive's score between which a negative's score lies; ``largest`` bounds the components
    in size, None leaves them as they are.
    """
    bound_batches(table.sparkSession)
    same = usable(table, id_col, vec_col, F.col("label") if label is None else label, largest).groupBy("id", "label", "v")
    rows = cut_lineage(same.agg((F.count("*") if copies else F.lit(1).cast("long")).alias("n")))
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    n, width = size["n"], max(2, size["width"] or 0)
    key = F.xxhash64("id", "label", "v").alias("akey")
    anchors = cut_lineage(rows.where(is_anchor).select(F.col("id").alias("anchor_id"), key, F.col("label").alias("own"), F.col("v").alias("vec"),
                                                             F.col("n").alias("times")))
    # Of the copies of a row, no more can be among the first.
    rows = rows.withColumn("n", F.least("n", F.lit(max(positives, negatives))))
    shards, blocks = 1 + n // SHARD_ROWS, 1 + anchors.count() // ANCHOR_ROWS
    books = codebooks(rows, n, width) if n else [np.zeros((1, width // 2)), np.zeros((1, width - width // 2))]

    def shard_of(left: pa.Table) -> Shard:
        return Shard(left.column("id").to_numpy(), np.array(left.column("label").to_pylist(), object),
                     _matrix(left.column("v"), width), books)

    def find_positives(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            shard = shard_of(left)
            vectors = _matrix(right.column("vec"), width)
            for a, ak, lab, v in zip(*(right.column(c).to_pylist() for c in ("anchor_id", "akey", "own")), vectors, strict=True):
                out += [(a, ak, i, s) for s, i in shard.positives(a, lab, v, positives)]
        return _table(out, ["anchor_id", "akey", "id", "score"])

    def find_negatives(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            shard = shard_of(left)
            vectors = _matrix(right.column("vec"), width)
            for a, ak, lab, scores, v in zip(*(right.column(c).to_pylist() for c in ("anchor_id", "akey", "own", "scores")), vectors, strict=True):
                windows = [(window[0] * s, window[1] * s) for s in scores]
                for place, found in enumerate(shard.negatives(a, lab, v, windows, negatives), 1):
                    out += [(a, ak, place, i, s) for s, i in found]
        return _table(out, ["anchor_id", "akey", "place", "id", "score"])

    found = _meet(rows, anchors, blocks, shards).applyInArrow(find_positives, RESULT.format(""))
    chosen = cut_lineage(_best(found, ["anchor_id", "akey"], positives))
    scores = chosen.groupBy("anchor_id", "akey").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "score"))), lambda x: x["score"]).alias("scores"))
    asking = anchors.join(scores, ["anchor_id", "akey"])
    wrong = _meet(rows, asking, blocks, shards).applyInArrow(find_negatives, RESULT.format("place int, "))
    ranked = _best(wrong, ["anchor_id", "akey", "place"], negatives)
    named = chosen.join(anchors.select("anchor_id", "akey", "times"), ["anchor_id", "akey"]).select(
        F.explode(F.sequence(F.lit(1), "times")).alias("copy"), "anchor_id", "akey", F.col("rank").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return ranked.join(named, ["anchor_id", "akey", "place"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"))


def _table(rows: list[tuple], names: list[str]) -> pa.Table:
    rows = [(*r[:-1], min(max(r[-1], -WHOLE), WHOLE - 1)) for r in rows]
    columns = zip(*rows, strict=True) if rows else [[]] * len(names)
    return pa.table({c: pa.array(x, pa.int32() if c == "place" else pa.int64()) for c, x in zip(names, columns, strict=True)})
