"""Column expressions on texts, words and windows that the operators share."""
from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What separates words made of digits, letters and anything beyond ASCII.
NOT_ALNUM = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: ASCII white space.
BLANKS = r"[\x20\x09-\x0D]+"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, also where ``use`` reads it in a loop.

    A projected array that a lambda reads would be inlined into the lambda by the
    optimizer, and so be computed again for each element.
    """
    return F.transform(F.array(value), use)[0]


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all else as it is; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def words(text: Column, separators: str) -> Column:
    """Words of a text in order; empty for null, empty and word-free texts."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), separators), "")


def fold(text: Column) -> Column:
    """Lower case, letter by letter: texts that agree but for A-Z agree after it too.

    Much cheaper than ``lower_ascii``; it merges more words, so use it to find
    candidates. The sigma would otherwise depend on its neighbours.
    """
    return F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("\u03a3"), F.lit("\u03c3")))


def hashes(items: Column) -> Column:
    return F.transform(items, lambda x: F.xxhash64(x))


def upto(n: Column) -> Column:
    """0 .. n-1, empty for n < 1."""
    return F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>"))


def joined_pairs(h: Column, step: int) -> Column:
    """Hashes of each item and the one ``step`` places on; three times over steps 1, 2, 4 gives 8-item windows."""
    return let(h, lambda a: F.zip_with(
        F.slice(a, 1, F.greatest(F.size(a) - step, F.lit(0))),
        F.slice(a, step + 1, F.greatest(F.size(a) - step, F.lit(0))), lambda x, y: F.xxhash64(x, y)))
