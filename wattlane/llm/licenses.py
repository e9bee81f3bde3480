"""License scans by ordered signature rules.

Rules work on the words of a text in lower case, joined by blanks, so they are free of
punctuation. Hundreds of regexes come from the families below: each family's hand-written
names and identifiers are put into the notice forms. A rule runs only on texts that hold
its family's keyword. Detections are resolved by priority, then length: one that lies
inside a kept detection is suppressed. Base phrases always count.

Null texts count as empty. Texts without any license keyword are never handed to Python;
whole texts are scanned, whatever their length. Repeated rows get equal results.
"""
from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .tables import bound_batches

#: The base phrases, as words, and their labels.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: label, keyword that a text must hold, names (regexes on words), identifiers as words.
FAMILIES = [
    ("mit", "mit|expat|x11", r"mit|expat|mit x11|x11", r"mit"),
    ("mit-0", "mit", r"mit no attribution|mit 0", r"mit 0"),
    ("apache-2", "apache", r"apache(?: software)? license(?: version| v)? 2(?: 0)?|apache 2(?: 0)?", r"apache 2 0"),
    ("apache-1.1", "apache", r"apache(?: software)? license(?: version| v)? 1 1", r"apache 1 1"),
    ("bsd-2", "bsd", r"(?:2|two) clause bsd|simplified bsd|freebsd|bsd 2(?: clause)?", r"bsd 2 clause"),
    ("bsd-3", "bsd", r"(?:3|three) clause bsd|new bsd|modified bsd|revised bsd|bsd 3(?: clause)?", r"bsd 3 clause"),
    ("bsd-4", "bsd", r"(?:4|four) clause bsd|original bsd|bsd 4(?: clause)?", r"bsd 4 clause"),
    ("0bsd", "bsd", r"zero clause bsd|bsd zero clause|0bsd", r"0bsd"),
    ("isc", "isc", r"isc", r"isc"),
    ("gpl-2", "gp|public license", r"(?:gnu )?(?:general public license|gpl)(?: version| v)? ?2(?: 0)?", r"gpl 2 0(?: only| or later)?"),
    ("gpl-3", "gp|public license", r"(?:gnu )?(?:general public license|gpl)(?: version| v)? ?3(?: 0)?", r"gpl 3 0(?: only| or later)?"),
    ("gpl", "gp|public license", r"(?:gnu )?general public license|gnu gpl|gpl", r"gpl"),
    ("lgpl-2.1", "l", r"(?:gnu )?(?:(?:lesser|library) general public license|lgpl)(?: version| v)? ?2(?: 1)?", r"lgpl 2 1(?: only| or later)?"),
    ("lgpl-3", "l", r"(?:gnu )?(?:lesser general public license|lgpl)(?: version| v)? ?3(?: 0)?", r"lgpl 3 0(?: only| or later)?"),
    ("lgpl", "l", r"(?:gnu )?(?:lesser|library) general public license|lgpl", r"lgpl"),
    ("agpl-3", "a", r"(?:gnu )?(?:affero general public license|agpl)(?: version| v)? ?3(?: 0)?", r"agpl 3 0(?: only| or later)?"),
    ("agpl", "a", r"(?:gnu )?affero general public license|agpl", r"agpl"),
    ("gfdl", "documentation|fdl", r"(?:gnu )?free documentation license|gfdl|fdl", r"gfdl(?: 1 [123])?"),
    ("mpl-1.1", "m", r"(?:mozilla public license|mpl)(?: version| v)? ?1 1", r"mpl 1 1"),
    ("mpl-2", "m", r"(?:mozilla public license|mpl)(?: version| v)? ?2(?: 0)?", r"mpl 2 0"),
    ("epl-1", "ep|eclipse", r"(?:eclipse public license|epl)(?: version| v)? ?1(?: 0)?", r"epl 1 0"),
    ("epl-2", "ep|eclipse", r"(?:eclipse public license|epl)(?: version| v)? ?2(?: 0)?", r"epl 2 0"),
    ("cddl-1", "cddl|common", r"common development and distribution license(?: version)?(?: 1(?: 0)?)?|cddl", r"cddl 1 [01]"),
    ("cpl-1", "common|cpl", r"common public license(?: version)?(?: 1(?: 0)?)?", r"cpl 1 0"),
    ("eupl", "eupl|european", r"european union public licen[cs]e|eupl", r"eupl 1 [012]"),
    ("ms-pl", "microsoft|ms", r"microsoft public license|ms pl", r"ms pl"),
    ("ms-rl", "microsoft|ms", r"microsoft reciprocal license|ms rl", r"ms rl"),
    ("artistic-1", "artistic", r"artistic license 1(?: 0)?", r"artistic 1 0"),
    ("artistic-2", "artistic", r"artistic license 2(?: 0)?|artistic 2(?: 0)?", r"artistic 2 0"),
    ("boost-1", "boost|bsl", r"boost software license(?: version)?(?: 1(?: 0)?)?", r"bsl 1 0"),
    ("zlib", "zlib", r"zlib(?: libpng)?", r"zlib"),
    ("unlicense", "unlicense", r"unlicense", r"unlicense"),
    ("wtfpl", "wtfpl|what the", r"wtfpl|do what the fuck you want to public license", r"wtfpl"),
    ("psf-2", "python|psf", r"python software foundation license(?: version)?(?: 2)?|psf license", r"psf 2 0"),
    ("php-3", "php", r"php license(?: version)?(?: 3(?: 0[01])?)?", r"php 3 0(?:1)?"),
    ("ruby", "ruby", r"ruby license|ruby s license", r"ruby"),
    ("ofl-1.1", "ofl|open font", r"(?:sil )?open font license(?: version)?(?: 1 1)?|ofl", r"ofl 1 1"),
    ("openssl", "openssl", r"openssl license", r"openssl"),
    ("postgresql", "postgresql", r"postgresql license", r"postgresql"),
    ("elastic-2", "elastic", r"elastic license(?: version)?(?: 2(?: 0)?)?", r"elastic 2 0"),
    ("bsl-1.1", "business|busl", r"business source license(?: version)?(?: 1 1)?", r"busl 1 1"),
    ("sspl-1", "sspl|server side", r"server side public license|sspl", r"sspl 1 0"),
    ("odbl", "odbl|open database", r"open database license|odbl", r"odbl 1 0"),
    ("odc-by", "odc|open data", r"open data commons attribution license|odc by", r"odc by 1 0"),
    ("cc0", "cc0|creative", r"cc0(?: 1 0)?|creative commons zero", r"cc0 1 0"),
    ("cc-by", "cc|creative", r"(?:cc|creative commons) (?:by|attribution)(?: [1-4] [05])?", r"cc by [1-4] [05]"),
    ("cc-by-sa", "cc|creative", r"(?:cc|creative commons) (?:by|attribution) (?:sa|share ?alike)(?: [1-4] [05])?", r"cc by sa [1-4] [05]"),
    ("cc-by-nd", "cc|creative", r"(?:cc|creative commons) (?:by|attribution) (?:nd|no derivatives)(?: [1-4] [05])?", r"cc by nd [1-4] [05]"),
    ("cc-by-nc", "cc|creative", r"(?:cc|creative commons) (?:by|attribution) (?:nc|non ?commercial)(?: [1-4] [05])?", r"cc by nc [1-4] [05]"),
    ("cc-by-nc-sa", "cc|creative", r"(?:cc|creative commons) (?:by|attribution) (?:nc|non ?commercial) (?:sa|share ?alike)(?: [1-4] [05])?", r"cc by nc sa [1-4] [05]"),
    ("cc-by-nc-nd", "cc|creative", r"(?:cc|creative commons) (?:by|attribution) (?:nc|non ?commercial) (?:nd|no derivatives)(?: [1-4] [05])?", r"cc by nc nd [1-4] [05]"),
    ("public-domain", "public domain", r"public domain", r"public domain"),
    ("proprietary", "rights reserved|proprietary", r"proprietary(?: and confidential)?|all rights reserved", r"proprietary"),
]

#: priority (lower wins), confidence, form; N is a name, I an identifier.
FORMS = [
    (0, 0.99, r"spdx license identifier (?:I)"),
    (1, 0.95, r"(?:licensed|released|distributed|available|published|provided|covered|governed|shared|redistributed)(?: to you)? (?:under|by|in accordance with)(?: the)?(?: terms of(?: the)?)?(?: conditions of(?: the)?)? ?(?:N)(?: licen[cs]e)?"),
    (2, 0.9, r"(?:opensource org licen[cs]es|gnu org licen[cs]es|spdx org licen[cs]es|creativecommons org licen[cs]es) (?:I)"),
    (3, 0.8, r"(?:under|see|subject to)(?: the)?(?: terms of(?: the)?)? (?:N)(?: licen[cs]e)?"),
    (4, 0.6, r"(?:licen[cs]e) (?:is )?(?:the )?(?:N)(?: licen[cs]e)?"),
    (5, 0.5, r"(?:N) licen[cs]e"),
]


def _gate() -> str:
    """A regex on folded texts that finds something in each text with a base phrase or a detection.

    Forms 0, 2, 4 and 5 hold the word 'licence', which a form cannot leave out; in forms 1 and 3 a
    name follows one of a few words. Blanks in phrases stand for what separates words.
    """
    names = "|".join(f"(?:{names})" for _, _, names, _ in FAMILIES)
    after = rf"(?:under|by|with|the|of|see|to) ?(?:{names})"
    return "|".join(["licen[cs]", *BASE, after]).replace(" ", f"(?:{T.NOT_ALNUM})")


#: Texts without a match hold no base phrase, and no detection is looked for.
GATE = _gate()


def rules() -> list[tuple[int, float, str, re.Pattern, re.Pattern]]:
    """(priority, confidence, label, keyword, regex) in order: each form of each family."""
    out = []
    for priority, confidence, form in FORMS:
        for label, keyword, names, identifiers in FAMILIES:
            body = form.replace("(?:I)", f"(?:{identifiers})").replace("(?:N)", f"(?:{names})")
            out.append((priority, confidence, label, re.compile(keyword), re.compile(rf"(?<![^ ])(?:{body})(?![^ ])")))
    return out


def resolve(found: list[tuple[int, int, int, float, str]]) -> list[tuple[int, int, int, float, str]]:
    """Detections (priority, start, end, confidence, label) without those inside a better one."""
    width = max((d[2] - d[1] for d in found), default=1)
    near: dict[int, list[tuple[int, int, int, float, str]]] = {}  # by start, so that few are looked at
    for d in sorted(found, key=lambda d: (d[0], d[1] - d[2], d[1], d[4])):
        at = d[1] // width
        if not any(k[1] <= d[1] and d[2] <= k[2] for i in (at - 1, at) for k in near.get(i, ())):
            near.setdefault(at, []).append(d)
    return [k for part in near.values() for k in part]


def scan(words: list[str], compiled) -> tuple[int, int | None, int | None, str, str, float]:
    """n_base, first_word, last_word, base_labels, labels, score."""
    line = " ".join(words)
    padded, places, base = f" {line} ", [], set()
    for phrase, label in BASE.items():
        at = padded.find(f" {phrase} ")
        while at >= 0:
            places.append(padded.count(" ", 0, at))
            base.add(label)
            at = padded.find(f" {phrase} ", at + 1)
    keys: dict[str, bool] = {}
    found = []
    for priority, confidence, label, keyword, pattern in compiled:
        if keyword.pattern not in keys:
            keys[keyword.pattern] = keyword.search(line) is not None
        if keys[keyword.pattern]:
            found += [(priority, m.start(), m.end(), confidence, label) for m in pattern.finditer(line)]
    kept = resolve(found)
    labels = base | {d[4] for d in kept}
    score = max([1.0] * bool(base) + [d[3] for d in kept], default=0.0)
    return (len(places), min(places, default=None), max(places, default=None),
            ",".join(sorted(base)), ",".join(sorted(labels)), score)


def license_scan(documents: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row."""
    bound_batches(documents.sparkSession)
    low = T.fold(F.col("text"))
    rows = documents.select("doc_id", F.size(T.words(low, T.NOT_ALNUM)).cast("long").alias("n_words"),
                            F.when(low.rlike(GATE), F.col("text")).alias("text"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        compiled = rules()
        word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
        lower = {c: c + 32 for c in range(65, 91)}
        for frame in frames:
            scanned = [scan(word.findall(x.translate(lower)), compiled) if isinstance(x, str) else (0, None, None, "", "", 0.0)
                       for x in frame["text"]]
            out = pd.DataFrame(scanned, columns=["n_base", "first_word", "last_word", "base_labels", "labels", "score"])
            out["first_word"], out["last_word"] = out["first_word"].astype("Int64"), out["last_word"].astype("Int64")
            yield pd.concat([frame[["doc_id", "n_words"]].reset_index(drop=True), out], axis=1)

    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInPandas(run, f"doc_id {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, "
                                 "base_labels string, labels string, score double")
