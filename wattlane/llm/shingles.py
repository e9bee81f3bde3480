"""Hashes of word shingles and set sketches of many texts at once, in numpy.

Words are maximal runs of bytes other than ASCII white space, A-Z lower-cased. A shingle is
five words in a row; a shorter, not empty text is one shingle. All arithmetic is modulo 2^64.
"""
from __future__ import annotations

import numpy as np

SHINGLE = 5
#: A band holds ROWS registers; two sets of similarity 0.75 share one of them with a chance of 1 - 6e-5.
BANDS, ROWS = 36, 5
REGISTERS = BANDS * ROWS
#: Parameters of the sketch: base, rate, largest value.
BASE, RATE, LARGEST = 1.001, 20.0, 65_534
#: Bytes hashed at once, and shingles of a text sketched at once.
CHUNK, ROWS_AT_ONCE = 1 << 21, 1 << 14


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Random value of each byte, A-Z like a-z, and whether it separates words."""
    values = mix(np.arange(1, 257, dtype=np.uint64))
    values[65:91] = values[97:123]
    blank = np.zeros(256, bool)
    blank[[32, *range(9, 14)]] = True
    return values, blank


def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    n, p = 1 << bits, 0x5851F42D4C957F2D
    out = []
    for base in (p, pow(p, -1, 1 << 64)):
        x = np.full(n, base, np.uint64)
        x[0] = 1
        out.append(np.multiply.accumulate(x))
    return out[0], out[1]


def _multipliers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    place = mix(np.arange(1001, 1001 + SHINGLE, dtype=np.uint64)) | np.uint64(1)
    a = mix(np.arange(2001, 2001 + REGISTERS, dtype=np.uint64)) | np.uint64(1)
    b = mix(np.arange(5001, 5001 + REGISTERS, dtype=np.uint64))
    return place, a, b


def _hashed(texts: list[bytes]) -> list[np.ndarray]:
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(lengths + 1)
    flat = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    values, blank = _letters()
    power, inverse = _powers(max(4, int(len(flat) - 1).bit_length()))
    sep = blank[flat]
    before = np.concatenate(([True], sep[:-1]))
    start = np.flatnonzero(~sep & before)
    stop = np.flatnonzero(sep & ~before)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values[flat] * power[:len(flat)], dtype=np.uint64)))
    word = mix((total[stop] - total[start]) * inverse[start] + (stop - start).astype(np.uint64))
    last = np.searchsorted(start, ends)  # words up to the end of each text
    first = np.concatenate(([0], last[:-1]))
    count = last - first
    n = np.where(count > 0, np.maximum(count - SHINGLE + 1, 1), 0)
    owner = np.repeat(np.arange(len(texts)), n)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + first[owner]
    place, _, _ = _multipliers()
    out = np.minimum(count, SHINGLE).astype(np.uint64)[owner]
    for j in range(SHINGLE):
        inside = at + j < last[owner]
        out += np.where(inside, word[np.minimum(at + j, len(word) - 1)] * place[j], np.uint64(0)) if len(word) else np.uint64(0)
    out = mix(out)
    cuts = np.cumsum(n)[:-1]
    return [np.unique(x) for x in np.split(out, cuts)]


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    out, part, size = [], [], 0
    for text in texts:
        part.append(text)
        size += len(text)
        if size > CHUNK:
            out += _hashed(part)
            part, size = [], 0
    return out + (_hashed(part) if part else [])


def registers(items: np.ndarray) -> np.ndarray:
    """Truncated exponents of the smallest of exponentially distributed hashes, for each register."""
    _, a, b = _multipliers()
    top = np.zeros(REGISTERS, np.uint64)
    for i in range(0, len(items), ROWS_AT_ONCE):
        top = np.maximum(top, (items[i:i + ROWS_AT_ONCE, None] * a + b).max(axis=0))
    smallest = -np.log1p(-((~top).astype(np.float64) + 0.5) / 2.0**64) / RATE
    return np.clip(np.floor(1 - np.log(smallest) / np.log(BASE)), 0, LARGEST + 1).astype(np.uint16)


def digest(items: np.ndarray) -> tuple[int, int]:
    """128 bits that tell sets apart."""
    with np.errstate(over="ignore"):
        return tuple(int(np.sum(mix(items ^ np.uint64(s)), dtype=np.uint64).astype(np.int64)) for s in (0x1234567, 0x7654321))


def bands(regs: np.ndarray) -> np.ndarray:
    """(texts, BANDS) hashes of the bands of register rows."""
    place = mix(np.arange(9001, 9001 + ROWS, dtype=np.uint64)) | np.uint64(1)
    parts = regs.reshape(-1, BANDS, ROWS).astype(np.uint64)
    return mix((mix(parts + np.uint64(1)) * place).sum(axis=2, dtype=np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)).astype(np.int64)


def likely_similarity(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, steps: int = 101) -> np.ndarray:
    """Jaccard similarity of greatest likelihood, from which registers are larger, smaller and equal."""
    more, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = a.shape[1] - more - less
    u = na / (na + nb)
    v = 1 - u
    j = np.minimum(u / v, v / u)[:, None] * np.linspace(0, 1, steps)

    def chance(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-x.clip(0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    above, below = chance(u[:, None] - v[:, None] * j), chance(v[:, None] - u[:, None] * j)
    equal = 1 - above - below
    score = sum(n[:, None] * np.log(p.clip(1e-12)) for n, p in ((more, above), (less, below), (same, equal)))
    return j[np.arange(len(j)), score.argmax(axis=1)]
