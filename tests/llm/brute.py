"""Plain Python versions of what the operators return."""
from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import xxhash

ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
BLANK = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def contamination(docs, items, window=13):
    """docs: (id, text); items: (id, text). Rows (id, n_words, n_hit, ids of items)."""
    wins = defaultdict(set)
    for item, text in items:
        w = ALNUM.findall((text or "").translate(LOWER))
        n = min(window, len(w))
        for s in range(len(w) - n + 1 if w else 0):
            wins[tuple(w[s:s + n])].add(item)
    sizes = {len(k) for k in wins}
    out = []
    for doc, text in docs:
        w = ALNUM.findall((text or "").translate(LOWER))
        hit, found = set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                if (got := wins.get(tuple(w[s:s + n]))) is not None:
                    hit |= set(range(s, s + n))
                    found |= got
        ids = sorted(str(x) for x in found if x is not None)
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(ids).encode()).hexdigest()))
    return out


def quality(text):
    words = BLANK.findall(text or "")
    spans = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    repeated = {p for i in range(len(words) - 7) if spans[tuple(words[i:i + 8])] > 1 for p in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if BLANK.search(x)]
    failed = len(words) < 20 or 100 * len(repeated) > 30 * len(words)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""),
            len(lines) - len(set(lines)), len(repeated), failed)


def shingle_set(text):
    w = BLANK.findall((text or "").translate(LOWER))
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def find(parent, x):
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def near_duplicates(docs, share=75):
    """docs: (id, text), distinct ids. Rows (id, size, component)."""
    sets = {i: shingle_set(t) for i, t in docs}
    by_item = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            by_item[x].append(i)
    common = Counter()
    for ids in by_item.values():
        for k, a in enumerate(ids):
            for b in ids[k + 1:]:
                common[min(a, b), max(a, b)] += 1
    parent = {i: i for i in sets}
    for (a, b), n in common.items():
        if 100 * n >= share * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((find(parent, a), find(parent, b)))
            parent[y] = x
    return [(i, len(s), find(parent, i)) for i, s in sets.items()]


def line_shingles(line, length=8):
    low = line.lower()
    return {low[i:i + length] for i in range(max(1, len(low) - length + 1))}


def dropped_lines(docs, share=75):
    """docs: (id, text), distinct ids. Per id: the sorted places of the lines that go."""
    homes = {}
    for i, text in docs:
        for k, line in enumerate((text or "").split("\n")):
            if re.search(r"\S", line, re.ASCII):
                homes.setdefault(line.lower(), []).append((i, k))
    texts = list(homes)
    sets = [line_shingles(x) for x in texts]
    by_item = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            by_item[x].append(i)
    common = Counter()
    for ids in by_item.values():
        for k, a in enumerate(ids):
            for b in ids[k + 1:]:
                common[a, b] += 1
    parent = {i: i for i in range(len(texts))}
    for (a, b), n in common.items():
        if 100 * n >= share * (len(sets[a]) + len(sets[b]) - n):
            parent[find(parent, a)] = find(parent, b)
    groups = defaultdict(list)
    for i, x in enumerate(texts):
        groups[find(parent, i)] += homes[x]
    out = {i: [] for i, _ in docs}
    for places in groups.values():
        best = min(places)
        for i, k in places:
            if (i, k) != best:
                out[i].append(k)
    return {i: sorted(v) for i, v in out.items()}


PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def licenses(text):
    w = ALNUM.findall((text or "").translate(LOWER))
    places, labels = [], set()
    for phrase, label in PHRASES.items():
        p = phrase.split()
        hits = [i for i in range(len(w)) if w[i:i + len(p)] == p]
        places += hits
        labels |= {label} if hits else set()
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def url_parts(url):
    """host, path, rule, verdict of the rule or None."""
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    path = re.split("[?#]", rest[len(host):], maxsplit=1)[0]
    host = host.translate(LOWER)
    best = None
    for verdict, rule in URL_RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    return host, path, best and best[1], best and best[0]


PII = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def personal(text):
    """Spans (kind, start, end) of the base kinds, in order."""
    out = []
    for kind, pattern in PII.items():
        for m in pattern.finditer(text or ""):
            digits = [int(c) for c in m.group() if c in "0123456789"]
            if kind == "ip":
                ok = all(int(p) <= 255 for p in m.group().split("."))
            elif kind == "card":
                twice = [sum(divmod(2 * d, 10)) if i % 2 else d for i, d in enumerate(digits[::-1])]
                ok = 13 <= len(digits) <= 19 and sum(twice) % 10 == 0
            else:
                ok = kind == "email" or 9 <= len(digits) <= 15
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def fingerprint(text):
    words = BLANK.findall((text or "").translate(LOWER))
    n = max(1, len(words) - 2) if words else 0
    grams = [" ".join(words[i:i + 3]) for i in range(n)]
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash(docs):
    """docs: (id, text), distinct ids. Rows (id, fingerprint, component)."""
    prints = {i: fingerprint(t) for i, t in docs}
    parent = {i: i for i in prints}
    for a, x in prints.items():
        for b, y in prints.items():
            if a < b and bin(x ^ y).count("1") <= 2:
                p, q = sorted((find(parent, a), find(parent, b)))
                parent[q] = p
    return [(i, f, find(parent, i)) for i, f in prints.items()]


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    return a[k + (len(a) >= len(b)):] == b[k + (len(b) >= len(a)):]


def spelling(docs):
    """docs: (id, text). Rows (word, form, root, n, n_near, form_n)."""
    seen = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            seen[run[:h % len(run)] + run[h % len(run) + 1:] if h % 31 == 0 else run] += 1
    n = {w: k for w, k in seen.items() if len(w) >= 7 and k >= 2}
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def hard_negatives(rows, positives=5, negatives=10, low=30, high=90):
    """rows: (id, vector, label). Sorted rows (anchor, positive, rank, negative, positive score, negative score)."""
    use = []
    for i, v, label in rows:
        if i is not None and v is not None and label is not None and all(x is not None and math.isfinite(x) for x in v):
            use.append((i, [math.floor(max(-2.0**22, min(2.0**22, 256 * x))) for x in v], label))
    out = []
    for a, v, label in use:
        if a % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=False)), i, lab) for i, w, lab in use if i != a)
        for s, p, _ in [x for x in scored if x[2] == label][:positives]:
            wrong = [(t, i) for t, i, lab in scored if lab != label and low * -s <= 100 * -t <= high * -s]
            out += [(a, p, k, i, -s, -t) for k, (t, i) in enumerate(wrong[:negatives], 1)]
    return sorted(out)
