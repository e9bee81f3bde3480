"""Words outside the head: one exchange of them, exact counts, also for a word of many rows."""
from __future__ import annotations

import pytest

from wattlane.llm import tokens


@pytest.fixture(scope="module")
def path():
    tokenizers = pytest.importorskip("public_tokenizers")
    return str(tokenizers.path("byte_bpe_50k.json"))


def _texts():
    hot = "antidisestablishmentarianism"
    own = [f"{hot} row {i} qz{i * 7919}x {hot}" for i in range(300)]
    return [(i, t) for i, t in enumerate(own)] + [(900, own[0]), (900, own[0]), (901, None), (902, ""), (None, hot)]


def test_counts_without_a_head_equal_the_library(spark, path, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokens, "HEAD", 1)
    library = Tokenizer.from_file(path)
    docs = spark.createDataFrame(_texts(), "doc_id long, text string").repartition(3)
    found = [tuple(r) for r in tokens.token_counts(docs, path).select("doc_id", "n_tokens").collect()]
    want = [(d, len(library.encode(t or "", add_special_tokens=False).ids)) for d, t in _texts()]
    assert sorted(found, key=str) == sorted(want, key=str)


def test_only_the_head_is_written(spark, path, monkeypatch):
    """Rare words go through one exchange to their counts, not into a table that is read several times."""
    written, cut = [], tokens.cut_lineage
    monkeypatch.setattr(tokens, "cut_lineage", lambda df: written.append(df.columns) or cut(df))
    docs = spark.createDataFrame(_texts(), "doc_id long, text string")
    plan = tokens.token_counts(docs, path)._jdf.queryExecution().optimizedPlan().toString()
    assert written == [["known", "n"]]
    assert plan.count("RebalancePartitions") == 1
