"""Spelling variants against plain Python."""
from __future__ import annotations

import random

import brute
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wattlane.llm import spelling

SCHEMA = "doc_id long, text string, word string, n int, gram string"


def _docs():
    rng = random.Random(2)
    common = ["zeitgeist", "Information", "éclairage", "ÉCLAIRAGE", "naïvement", "aaaaaaaa", "abababab", "zzyzzyzzy"]
    out = []
    for i in range(120):
        words = []
        for _ in range(40):
            w = rng.choice(common + [rng.choice(common)[:6], "kurz", "ABC1def"])
            if rng.random() < 0.25:
                k = rng.randrange(len(w))
                w = w[:k] + rng.choice(["", rng.choice("abzÿ") + w[k], rng.choice("abzé")]) + w[k + 1:]
            words.append(w)
        out.append((i, rng.choice([" ", ", ", "\n"]).join(words)))
    return out + [(500, None), (501, ""), (502, "1234 !!"), (503, "x" * 3_000), (504, "x" * 2_999 + "y"), (505, "x" * 3_000), (506, "x" * 2_999 + "y"),
                  (507, "a×÷bcdefg a×÷bcdefg")]


def test_variants(spark):
    docs = _docs()
    want = sorted(brute.spelling(docs), key=repr)
    rows = [(i, t, "w", 1, "g") for i, t in docs]
    got = spelling.document_variants(spark.createDataFrame(rows, SCHEMA).repartition(5)).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert sorted(map(tuple, got), key=repr) == want
    assert sum(r.form is not None for r in got) > 20


def test_repeated_rows_and_null_ids(spark):
    rows = [(7, "Wortform wortform", "", 1, ""), (7, "Wortform wortform", "", 1, ""), (None, "wortforms", "", 1, ""), (None, "wortforms", "", 1, "")]
    got = {r.word: (r.n, r.n_near, r.form) for r in spelling.document_variants(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {"wortform": (4, 1, None), "wortforms": (2, 1, None)}


def test_empty(spark):
    assert spelling.document_variants(spark.createDataFrame([], SCHEMA)).count() == 0
    assert spelling.document_variants(spark.createDataFrame([(1, None, "", 1, "")], SCHEMA)).count() == 0


def test_chains_end_at_the_last_form(spark):
    vocab = [("abcdefg", 2), ("abcdefgh", 20), ("abcdefghi", 200), ("abcdefghij", 2_000), ("xbcdefghij", 2_000), ("qrstuvw", 5)]
    got = {r.word: (r.form, r.root, r.n_near) for r in spelling.variants(spark.createDataFrame(vocab, "word string, n long")).collect()}
    assert got["abcdefg"] == ("abcdefgh", "abcdefghij", 1) and got["abcdefghi"] == ("abcdefghij", "abcdefghij", 2)
    assert got["abcdefghij"] == (None, "abcdefghij", 2) and got["qrstuvw"] == (None, "qrstuvw", 0)


@settings(max_examples=300, deadline=None)
@given(st.text("abcé", min_size=7, max_size=14), st.lists(st.integers(1, 50), min_size=16, max_size=16))
def test_pivots_are_the_cheapest_disjoint_pair(word, counts):
    grams = [a + b for a in "abcé" for b in "abcé"]
    order = {g: (n, g) for g, n in zip(grams, counts, strict=True)}
    prefix, pivots, last = spelling.prefix_and_pivots(word, order)
    keys = [order[word[i:i + 2]] for i in range(len(word) - 1)]
    assert last == sorted(keys)[2] and prefix == [i for i, k in enumerate(keys) if k <= last]
    assert len(pivots) == 2 and pivots[1] - pivots[0] >= 2
    assert keys[pivots[0]][0] + keys[pivots[1]][0] == min(keys[i][0] + keys[j][0] for i in prefix for j in prefix if j - i >= 2)


@pytest.mark.parametrize("seed", [1, 2])
def test_no_near_pair_is_missed(spark, seed):
    """A small alphabet makes long lists of equal bigrams and words with many near words."""
    rng = random.Random(seed)
    words = {"".join(rng.choice("aab") for _ in range(rng.randrange(7, 12))) for _ in range(400)}
    pairs = spelling.near_words(spark.createDataFrame([(w, 2) for w in words], "word string, n long"))
    got = {(r.word, r.near) for r in pairs.collect()}
    assert got == {(a, b) for a in words for b in words if brute.one_edit(a, b)}
