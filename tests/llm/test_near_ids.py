"""An id with several texts keeps the links of each of them."""
from __future__ import annotations

import random

from wattlane.llm import neardup


def test_links_of_every_text_of_an_id(spark):
    rng = random.Random(1)
    text = lambda: [f"w{rng.randrange(10**6)}" for _ in range(120)]
    a, b, c = text(), text(), text()
    near = lambda words: [*words[:60], "other", *words[61:]]
    rows = [(1, a), (1, b), (2, near(a)), (3, near(b)), (4, c), (5, near(c)), (5, near(c)), (None, a), (6, text()), (7, [])]
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string").repartition(3)
    got = sorted(((r.doc_id or 0), r.component_id, r.kept) for r in neardup.near_duplicates(table).collect())
    assert got == [(0, None, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (4, 4, True), (5, 4, False), (5, 4, False), (6, 6, True), (7, 7, True)]
    assert sorted((r.doc_id or 0) for r in neardup.keep_one(table).collect()) == [0, 1, 1, 4, 6, 7]
