"""The training sample of language ID is even over labels, however many copies a text has."""
from __future__ import annotations

from collections import Counter

from wattlane.llm import langid


def test_copies_crowd_out_no_label(spark, monkeypatch):
    rows = [("one text that is copied over and over again", "aa")] * 5000
    rows += [(f"text {k} of the label {label}, unlike all others", label) for label in ("bb", "cc") for k in range(1000)]
    seen = []
    monkeypatch.setattr(langid, "fit", lambda texts, labels: seen.extend(zip(texts, labels, strict=True)))
    langid.train(spark.createDataFrame(rows, "text string, lang string").repartition(4), sample_rows=300)
    got = Counter(label for _, label in seen)
    assert got["aa"] == 3
    assert 240 <= got["bb"] <= 300 and 240 <= got["cc"] <= 300
