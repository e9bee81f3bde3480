"""Hashes of the character shingles of many lines at once, their minima and band keys, in numpy.

A shingle is a string of LENGTH characters, one at each place of the line; a shorter line is
one shingle. Lines are worked on in chunks of a bounded size, however long they are.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .shingles import mix

#: Characters of a shingle. Unrelated lines of a language share many shorter strings: at 5
#: they met in the bands some thousand times as often as at 8.
LENGTH = 8
#: A band holds the minima of ROWS parts of the hash range.
BANDS, ROWS = 18, 4
PARTS = BANDS * ROWS
#: Characters hashed at once.
CHUNK = 1 << 19
#: Different shingles of two blocks that are counted at once.
COLUMNS = 1 << 15
#: Stands behind the last character of lines shorter than a shingle; no character has this number.
FILL = np.uint32(0xFFFFFFFF)
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def _pieces(lines: list[str]) -> Iterator[tuple[list[int], list[str]]]:
    """Numbers and texts of lines, up to CHUNK characters together; a longer line comes in pieces
    that hold each of its shingles once."""
    numbers, texts, size = [], [], 0
    for i, line in enumerate(lines):
        for at in range(0, max(1, len(line) - LENGTH + 1), CHUNK):
            piece = line if len(line) <= CHUNK else line[at:at + CHUNK + LENGTH - 1]
            if size + len(piece) > CHUNK and numbers:
                yield numbers, texts
                numbers, texts, size = [], [], 0
            numbers.append(i)
            texts.append(piece)
            size += len(piece)
    if numbers:
        yield numbers, texts


def hashed(lines: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The number of the line and the hash of each shingle, line by line, in chunks."""
    for numbers, texts in _pieces(lines):
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        filled = np.maximum(lengths, LENGTH)
        ends = np.cumsum(filled)
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        if len(codes) < ends[-1]:
            real = np.ones(ends[-1], bool)
            for k in np.flatnonzero(lengths < LENGTH):
                real[ends[k] - LENGTH + lengths[k]:ends[k]] = False
            flat = np.full(ends[-1], FILL)
            flat[real] = codes
            codes = flat
        h = mix(codes.astype(np.uint64) + np.uint64(1))
        for step in (1, 2, 4):
            h = mix(h[:-step] * np.uint64(0x9FB21C651E98DF25) + h[step:])
        starts = np.ones(ends[-1], bool)
        for back in range(1, LENGTH):
            starts[ends - back] = False
        yield np.repeat(np.array(numbers), filled - LENGTH + 1), h[starts[:len(h)]]


def shingle_sets(lines: list[str]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each line."""
    parts: list[list[np.ndarray]] = [[] for _ in lines]
    for line, h in hashed(lines):
        cuts = np.flatnonzero(line[1:] != line[:-1]) + 1
        for own, first in zip(np.split(h, cuts), line[np.concatenate(([0], cuts))], strict=True):
            parts[first].append(own)
    return [np.unique(p[0] if len(p) == 1 else np.concatenate(p)) for p in parts]


def minima(lines: list[str]) -> np.ndarray:
    """lines x PARTS: the smallest hash in each part of the hash range; EMPTY where there is none."""
    out = np.full((len(lines), PARTS), EMPTY)
    flat = out.ravel()
    for line, h in hashed(lines):
        part = ((h >> np.uint64(32)) * np.uint64(PARTS)) >> np.uint64(32)
        np.minimum.at(flat, line * PARTS + part.astype(np.int64), h)
    return out


def band_keys(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(line, key): the keys of the bands that hold a minimum, and the number of their line."""
    own = minima(lines).reshape(-1, BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), own.shape[:2])
    for j in range(ROWS):
        key = mix(key * np.uint64(0xC2B2AE3D27D4EB4F) + own[:, :, j])
    line, band = np.nonzero((own != EMPTY).any(axis=2))
    return line, key[line, band].view(np.int64)


def similar(x: np.ndarray, y: np.ndarray, share: int) -> bool:
    """Whether 100 times the common shingles is at least ``share`` times all of both."""
    n, m = len(x), len(y)
    if 100 * min(n, m) < share * max(n, m):
        return False
    return (100 + share) * len(np.intersect1d(x, y, assume_unique=True)) >= share * (n + m)


def similar_pairs(xs: list[np.ndarray], ys: list[np.ndarray] | None, share: int) -> np.ndarray:
    """len(xs) x len(ys): which pairs are similar; without ``ys`` the pairs of ``xs`` itself, of which
    that of a line and itself is left out.

    Common shingles are counted by products of 0/1 tables; shingles of a single set have no column.
    """
    sets = [*xs, *(ys or [])]
    n = np.array([len(s) for s in sets])
    row = np.repeat(np.arange(len(sets)), n)
    _, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.cumsum(count > 1) - 1
    order = np.argsort(place, kind="stable")
    order = order[count[place[order]] > 1]
    place, row = column[place[order]], row[order]
    width = int(column[-1]) + 1
    first = slice(0, len(xs))
    second = first if ys is None else slice(len(xs), len(sets))
    common = np.zeros((len(xs), len(xs) if ys is None else len(ys)))
    for at in range(0, width, COLUMNS):
        lo, hi = np.searchsorted(place, [at, at + COLUMNS])
        table = np.zeros((len(sets), min(COLUMNS, width - at)), np.float32)
        table[row[lo:hi], place[lo:hi] - at] = 1
        common += table[first] @ table[second].T
    out = (100 + share) * common >= share * (n[first][:, None] + n[second][None, :])
    if ys is None:
        np.fill_diagonal(out, False)
    return out
