"""Every license rule fires through the scan on a text that holds its own phrase alone."""
from __future__ import annotations

import itertools
import re
from re import _parser

from wattlane.llm import licenses

SCHEMA = "doc_id long, text string"


def phrases(parsed):
    """Texts of a regex made of letters, sets, branches and options: each branch, options left out and taken."""
    out = [""]
    for op, value in parsed:
        if op is _parser.LITERAL:
            own = [chr(value)]
        elif op is _parser.IN:
            kind, of = value[0]
            own = [chr(of if kind is _parser.LITERAL else of[0])]
        elif op is _parser.BRANCH:
            own = [x for part in value[1] for x in phrases(part)]
        elif op is _parser.SUBPATTERN:
            own = phrases(value[-1])
        else:
            assert op is _parser.MAX_REPEAT and value[:2] == (0, 1)
            own = ["", *phrases(value[2])]
        out = [x + y for x, y in itertools.product(out, own)]
    return out


def own_phrases():
    """(label, text): each rule with each of its names, the options of the form left out."""
    for _, _, form in licenses.FORMS:
        for label, _, names, identifiers in licenses.FAMILIES:
            head, tail = re.split(r"\(\?:[NI]\)", form)
            first, last = min(phrases(_parser.parse(head)), key=len), min(phrases(_parser.parse(tail)), key=len)
            first = first if not first or first.endswith(" ") else first + " "
            for own in phrases(_parser.parse(identifiers if "(?:I)" in form else names)):
                yield label, first + own + last


def test_each_rule_fires(spark):
    rules = list(own_phrases())
    assert len({x for x in rules}) > len(licenses.rules()) == 318
    table = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rules)], SCHEMA).repartition(4)
    found = {r.doc_id: r.labels.split(",") for r in licenses.license_scan(table).collect()}
    assert [(label, text, found[i]) for i, (label, text) in enumerate(rules) if label not in found[i]] == []


def test_notices_without_the_word(spark):
    notices = [("apache-2", "Released under Apache 2.0"), ("bsd-3", "Distributed under the 3-clause BSD"), ("mit", "Available under the MIT"),
               ("eupl", "Published under the EUPL"), ("ofl-1.1", "released under the OFL"), ("sspl-1", "governed by SSPL"),
               ("bsd-3", "see BSD-3-Clause"), ("isc", "distributed under ISC"), ("mit", "X11 license"), ("psf-2", "SPDX-License-Identifier: PSF-2.0"),
               ("bsl-1.1", "SPDX-License-Identifier: BUSL-1.1"), ("wtfpl", "under the 'Do What The Fuck\nYou Want To' Public License")]
    table = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(notices)], SCHEMA)
    found = {r.doc_id: r.labels for r in licenses.license_scan(table).collect()}
    assert [found[i] for i in range(len(notices))] == [label for label, _ in notices]
