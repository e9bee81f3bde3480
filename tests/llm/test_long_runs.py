"""Unbroken runs of a megabyte are scanned in linear time, and matches may touch."""
from __future__ import annotations

import time

import brute
import pytest

from wattlane.llm import personal


@pytest.mark.parametrize("text", ["x" * 1_000_000 + " @", "a@" + "y" * 1_000_000, "7" * 1_000_000 + " 1.2", "1." * 400_000, "a.b" * 300_000 + " c@d.ee"])
def test_runs_of_a_megabyte(spark, text):
    rows = spark.createDataFrame([(1, text)], "doc_id long, text string")
    personal.personal_data(spark.createDataFrame([(1, "warm up 1.2.3.4 a@b.cc")], "doc_id long, text string")).collect()
    found = personal.matches(rows.selectExpr("1L AS _k1", "2L AS _k2", "text"))
    began = time.monotonic()
    got = {(r.kind, r.start, r.end) for r in found.where("kind <> 'token'").collect()}
    assert time.monotonic() - began < 20
    assert {x for x in got if x[0] == "email"} == {x for x in ({("email", len(text) - 6, len(text))} if "c@d.ee" in text else set())}


def test_matches_that_touch(spark):
    texts = ["a@b.cc_x@d.ee", "a@b.cc+x@d.ee.ff%y@g.hh", "1.2.3.4.5.6.7.8", "1.2.3.4 5.6.7.8x9.9.9.9", "a@b a@b.c..d@e.f", ".a@b.c-", "1.2.3.4.5.6.7.8.9"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in personal.personal_data(rows).collect():
        want = [f"{k}:{a}:{b}" for k, a, b in brute.personal(texts[r.doc_id])]
        assert set(want) <= set(r.spans.split(",")) | {""}
        assert (r.n_email, r.n_ip) == tuple(sum(w.startswith(k) for w in want) for k in ("email", "ip"))
