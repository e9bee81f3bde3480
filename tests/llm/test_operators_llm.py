"""Corpus operators against plain Python on a small table with the awkward rows."""
from __future__ import annotations

import hashlib
import random
from collections import Counter

import brute
import pytest
from pyspark.sql import functions as F

from wattlane.llm import (
    components, decontamination, langid, licenses, lines, mixing, neardup, personal, quality, tokens, urls,
)

SCHEMA = "doc_id long, text string, lang string, source string, _k1 string, n int, band string"


def _texts() -> list[str | None]:
    rng = random.Random(5)
    word = lambda: rng.choice("alpha beta gamma delta eins zwei drei vier naïve été ñandú".split()) + rng.choice(["", "s", "x1", "7"])
    base = [word() for _ in range(90)]
    out: list[str | None] = [None, "", " \n\t ", "one", "ONE", "a b c d", "A b C d", "!!! ***", "7 7 7 7 7 7 7 7 7 7 7 7 7 7 7 7 7 7 7 7 7 7"]
    for edits in (0, 0, 1, 2, 4, 8, 20):
        copy = list(base)
        for _ in range(edits):
            copy[rng.randrange(len(copy))] = f"q{rng.randrange(999)}"
        out.append(" ".join(copy[:40]) + "\n" + " ".join(copy[40:]))
    out += ["\n".join(["same line of several plain words here"] * 5), "x" * 5_000, "ab " * 4_000,
            " ".join(word() for _ in range(6_000)), "tail <|endoftext|>  head<|endoftext|>", "can't  we'll \u3000 wide 🎉 \U0001fae8 end  "]
    return out


@pytest.fixture(scope="module")
def rows():
    texts = _texts()
    data = [(i, t, "xx" if i % 3 else None, None if i % 5 == 0 else f"s{i % 2}", "k", 1, "b") for i, t in enumerate(texts)]
    return [*data, data[10], data[10]]  # a row three times


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([*rows, (None, "a row without an id of its own", "xx", "s1", "k", 1, "b")], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def text_of(rows):
    return {r[0]: r[1] for r in rows}


def test_contamination(spark, docs, rows, empty):
    words = rows[9][1].split()
    items = [(1, " ".join(words[3:20])), (2, " ".join(words[50:52]).upper()), (3, None), (4, " .. "), (5, "alpha"), (6, " ".join(words[3:20])), (None, "one")]
    bench = spark.createDataFrame(items, "item_id int, text string")
    got = decontamination.contamination(docs, bench).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256").collect()
    want = brute.contamination([*[(r[0], r[1]) for r in rows], (None, "a row without an id of its own")], items)
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert decontamination.contamination(empty, bench).count() == 0
    assert {r.n_hit for r in decontamination.contamination(docs, bench.limit(0)).collect()} == {0}
    kept = decontamination.decontaminate(docs, bench)
    assert kept.columns == docs.columns
    bad = {i for i, n, hit, *_ in want if hit and 20 * hit >= n}
    assert Counter(r.doc_id for r in kept.collect()) == Counter(i for i, *_ in want if i not in bad)


def test_shuffled_contamination(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(decontamination, "BROADCAST_FINGERPRINTS", 0)
    monkeypatch.setattr(decontamination, "BROADCAST_BYTES", 0)
    items = [(1, " ".join(rows[9][1].split()[3:30]))]
    got = decontamination.contamination(docs.where("doc_id is not null"), spark.createDataFrame(items, "item_id int, text string"))
    want = brute.contamination([(r[0], r[1]) for r in rows], items)
    assert sorted(map(tuple, got.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256").collect())) == sorted(want)


def test_language(spark, small, docs, empty):
    table = spark.read.parquet(f"{small}/documents.parquet").where("lang is not null")
    model = langid.train(table.where(~langid.held_out()))
    got = langid.predict(table.withColumn("score", F.lit("x")), model).where(langid.held_out()).select("lang", "lang_pred", "score").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got)
    assert all(0 <= r.score <= 1 for r in got)
    odd = {r.doc_id: r.lang_pred for r in langid.predict(docs, model).collect()}
    assert all(odd[i] == langid.UNKNOWN for i in (0, 1, 2, 7, 8)) and odd[17] in model.labels
    assert langid.train(empty) is None and langid.predict(empty, model).count() == 0
    assert {r.lang_pred for r in langid.predict(docs, None).collect()} == {langid.UNKNOWN}
    assert langid.keep_known(table).columns == table.columns


@pytest.mark.parametrize("url", [None, "", "no scheme", "http://", "http://A.org?x#y", "HTTP://u@Example.ORG/en/1?a=1&b", "x://sub.example.org/es/",
                                 "https://a.com/fr/1#f", "https://a.com/de/", "https://notorg/", "ftp://org", "http://com/fr/://org/", "http://a.net/\n/b"])
def test_url_rules(spark, url):
    got = urls.parts(spark.createDataFrame([(1, url, "h")], "page_id long, url string, host string")).withColumn(
        "found", urls.rule_for(urls.RULES)).select("host", "path", "found.rule", "found.verdict").first()
    assert tuple(got) == brute.url_parts(url)


def test_url_verdicts(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet").withColumn("label", F.upper("url"))
    pages = pages.unionByName(pages.limit(2)).unionByName(spark.createDataFrame([(None, None, None, None)], pages.schema))
    got = urls.judge(pages).collect()
    assert Counter(r.page_id for r in got) == Counter(r.page_id for r in pages.collect())
    want = {r.page_id: brute.url_parts(r.url) for r in pages.collect()}
    assert all((r.host, r.path, r.rule) == want[r.page_id][:3] for r in got)
    assert all(r.verdict == want[r.page_id][3] for r in got if r.rule)
    assert {r.verdict for r in got} <= {"allow", "block"} and all(0 <= r.score <= 1 for r in got)
    assert urls.judge(pages.limit(0)).count() == 0


LICENSED = [(1, "Released UNDER the MIT-License. under the mit license"), (2, "Licensed under the Apache License, Version 2.0."),
            (3, "CC BY-NC 4.0, cc by nc cc by nc"), (4, "SPDX-License-Identifier: LGPL-3.0-only"), (5, None), (6, "mit freundlichen Grüßen"),
            (7, "under the " * 3_000 + "mit license")]


def test_licenses(spark, docs, rows):
    got = {r.doc_id: r for r in licenses.license_scan(spark.createDataFrame(LICENSED, "doc_id long, text string")).collect()}
    for i, text in LICENSED:
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute.licenses(text)
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    assert got[4].labels == "lgpl-3" and got[6].labels == "" and len(licenses.rules()) > 200
    assert licenses.resolve([(1, 0, 10, 0.9, "a"), (2, 2, 8, 0.5, "b"), (2, 8, 12, 0.5, "c")]) == [(1, 0, 10, 0.9, "a"), (2, 8, 12, 0.5, "c")]
    scanned = licenses.license_scan(docs.where("doc_id is not null")).collect()
    assert sorted((r.doc_id, r.n_words) for r in scanned) == sorted((r[0], brute.licenses(r[1])[0]) for r in rows)


def test_tokens(spark, docs, rows, empty, monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    want = sorted((r[0], len((r[1] or "").encode()), len(library.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows)
    named = docs.where("doc_id is not null")
    assert sorted(map(tuple, tokens.token_counts(named, path).collect())) == want
    monkeypatch.setattr(tokens, "HEAD", 3)
    assert sorted(map(tuple, tokens.token_counts(named, path).collect())) == want
    assert tokens.token_counts(empty, path).count() == 0


def test_quality(docs, rows, empty):
    got = quality.judge(docs.where("doc_id is not null")).collect()
    want = sorted((r[0], *brute.quality(r[1])) for r in rows)
    assert sorted(tuple(r)[:7] for r in got) == want
    assert all(not r.kept for r in got if r.base_failed)
    assert quality.judge(empty).count() == 0


PII = [(1, "mail a.b+c@x-y.example.org, ip 10.0.0.255 and 1.2.3.4.5 or 300.1.1.1 call +1 (555) 010-9999 now"), (2, None), (3, ""),
       (4, "card 4111 1111 1111 1111 and 4111-1111-1111-1112, 12--34 éé 4111111111111111"), (5, "a@b a@b.c..d@e.f @x.y 0001.2.3.4"),
       (6, "1" * 6_000 + "." + "a." * 4_000 + "b@c" + ".d" * 4_000), (7, "+1-2-3 +1234567890123456 ++49 30 1234567"), (7, "+1-2-3 +1234567890123456 ++49 30 1234567")]


def test_personal_data(spark, docs, empty):
    got = personal.personal_data(spark.createDataFrame(PII, "doc_id long, text string").withColumn("seed", F.lit(1))).collect()
    assert len(got) == len(PII)
    texts = dict(PII)
    for r in got:
        spans = brute.personal(texts[r.doc_id])
        joined = [f"{k}:{a}:{b}" for k, a, b in spans]
        count = Counter(k for k, _, _ in spans)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(count[k] for k in personal.KINDS)
        assert r.base_sha256 == hashlib.sha256(",".join(joined).encode()).hexdigest()
        assert set(joined) <= set(r.spans.split(",")) | {""}
    assert personal.personal_data(empty).count() == 0


def test_contexts_find_unseen_identifiers(spark):
    seeds = [(i, f"please contact me at user{i}@mail{i}.example.com for more") for i in range(12)]
    rows = [*seeds, (50, "please contact me at bob99@localhost for more"), (51, "room 99b is closed for more")]
    got = {r.doc_id: r.spans for r in personal.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[50] == "email:21:36" and got[51] == ""


def test_mixing(spark, docs, rows, empty):
    assert mixing.mix(empty).count() == 0
    data = [(i, "w " * (1 + i % 7), f"s{i % 13 // 6}" if i % 11 else None) for i in range(3_000)]
    table = spark.createDataFrame(data, "doc_id long, text string, source string").repartition(4)
    for evenness, repeats, budget in ((0.0, 4.0, None), (0.7, 2.0, None), (1.0, 3.0, 30_000)):
        weights = {r["key"]: r for r in mixing.source_weights(mixing.measured(table), evenness, repeats, budget).collect()}
        total = sum(r["tokens"] for r in weights.values())
        assert abs(sum(r["weight"] for r in weights.values()) - 1) < 1e-9
        assert all(r["weight"] * (budget or total) / r["tokens"] <= repeats + 1e-3 for r in weights.values()) or budget
        got = mixing.mix(table, evenness, repeats, budget).collect()
        assert len({(r.doc_id, r.epoch) for r in got}) == len(got)
        for key, w in weights.items():
            own = [r for r in got if ("=" + r.source if r.source is not None else "") == key]
            ids = {i for i, _, s in data if ("=" + s if s is not None else "") == key}
            for epoch in range(w["whole"]):
                assert {r.doc_id for r in own if r.epoch == epoch} == ids
            last = [r for r in own if r.epoch == w["whole"]]
            assert len(last) + w["whole"] * len(ids) == len(own)
            assert w["rest"] - 7 < sum(r.n_tokens for r in last) <= w["rest"]
    counts = Counter(r.doc_id for r in mixing.mix(docs, 0.0).collect())
    assert set(counts) == {r[0] for r in rows if (r[1] or "").split()} | {None}


def test_near_duplicates(spark, docs, rows, empty, monkeypatch):
    rng = random.Random(3)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    made = []
    for i in range(120):
        copy = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4, 6, 8])):
            copy[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        made.append((1_000 + i, " ".join(copy[:60]) + "\n" + " ".join(copy[60:])))
    table = docs.select("doc_id", "text", "n").unionByName(spark.createDataFrame([(*r, 1) for r in made], "doc_id long, text string, n int"))
    want = {i: (n, c) for i, n, c in brute.near_duplicates([*text_of(rows).items(), *made])}
    for block in (neardup.BLOCK, 10):
        monkeypatch.setattr(neardup, "BLOCK", block)
        got = neardup.near_duplicates(table).collect()
        assert len(got) == len(rows) + 1 + len(made)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
        assert all(r.kept == (r.doc_id in (r.component_id, None)) for r in got)
    assert neardup.near_duplicates(empty).count() == 0
    kept = neardup.keep_one(table)
    assert kept.columns == table.columns and {r.doc_id for r in kept.collect()} == {i for i, (_, c) in want.items() if i == c} | {None}


def test_line_dedup(spark, docs, rows, empty, monkeypatch):
    named = docs.where("doc_id is not null")
    want = brute.dropped_lines(list(text_of(rows).items()))
    for block in (lines.BLOCK, 2):
        monkeypatch.setattr(lines, "BLOCK", block)
        got = {r.doc_id: [int(x) for x in r.dropped.split(",") if x] for r in lines.report(named).collect()}
        assert got == want
    assert lines.report(empty).count() == 0
    out = lines.without_repeats(docs)
    assert out.columns == docs.columns
    left = {r.doc_id: r.text for r in out.collect()}
    for i, text in text_of(rows).items():
        parts = [x for k, x in enumerate((text or "").split("\n")) if k not in want[i]]
        if want[i] and not any(x.strip() for x in parts):
            assert i not in left
        else:
            assert left[i] == (text if not want[i] else "\n".join(parts))


def test_components(spark):
    chain = [(i, i + 1) for i in range(300)] + [(1_000 + i, 1_000) for i in range(50)] + [(5, 5), (2_000, 2_001), (2_001, 2_000)]
    edges = spark.createDataFrame(chain, "a long, b long")
    got = {r.node: r.root for r in components.components(edges).collect()}
    assert got == {i: 0 for i in range(301)} | {1_000 + i: 1_000 for i in range(50)} | {2_000: 2_000, 2_001: 2_000}
    assert components.components(edges.limit(0)).count() == 0
