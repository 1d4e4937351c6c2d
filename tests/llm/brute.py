"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import collections
import hashlib
import math
import re

SMALL = "/root/testdata/sf0.001"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def alnum(text):
    return ALNUM.findall((text or "").translate(LOW))


def spaced(text):
    return SPACED.findall((text or "").translate(LOW))


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def distance(a, b) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


class Forest:
    def __init__(self, items):
        self.up = {x: x for x in items}

    def root(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


def shingles(text, k=5):
    w = spaced(text)
    if len(w) < k:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def near_groups(docs: dict, similar: int = 85):
    """doc_id -> (set size, component)."""
    sets = {i: shingles(t) for i, t in docs.items()}
    f = Forest(docs)
    ids = sorted(docs)
    for i in ids:
        for j in ids:
            if i < j and sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= similar * (len(sets[i]) + len(sets[j]) - both):
                    f.join(i, j)
    return {i: (len(sets[i]), f.root(i)) for i in ids}


def contamination(docs: dict, items: list):
    """doc_id -> (n_words, n_hit, n_items, digest of the item ids)."""
    wanted = {}
    for item, text in items:
        w = alnum(text)
        m = min(10, len(w))
        for i in range(len(w) - m + 1 if m else 0):
            wanted.setdefault(tuple(w[i : i + m]), set()).add(str(item))
    out = {}
    for doc, text in docs.items():
        w, hit, found = alnum(text), set(), set()
        for m in {len(k) for k in wanted}:
            for i in range(len(w) - m + 1):
                if (key := tuple(w[i : i + m])) in wanted:
                    hit |= set(range(i, i + m))
                    found |= wanted[key]
        out[doc] = (len(w), len(hit), len(found), sha(",".join(sorted(found))))
    return out


BASE = {("cc", "by"): "cc-by", ("general", "public", "license"): "gpl", ("all", "rights", "reserved"): "reserved"}


def licenses(text):
    w = alnum(text)
    at = [(j, x) for p, x in BASE.items() for j in range(len(w) - len(p) + 1) if tuple(w[j : j + len(p)]) == p]
    return len(w), len(at), min((j for j, _ in at), default=None), max((j for j, _ in at), default=None), ",".join(sorted({x for _, x in at}))


KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "phone":
        return 9 <= len(digits) <= 15
    if kind == "card":
        total = 0
        for i, c in enumerate(reversed(digits)):
            c = int(c) * (1 + i % 2)
            total += c - 9 * (c > 9)
        return 12 <= len(digits) <= 19 and total % 10 == 0
    return True


def personal(text):
    """(spans joined, counts by kind) of the base."""
    order = list(KINDS)
    spans = sorted((m.start(), order.index(k), k, m.end()) for k in order for m in re.finditer(KINDS[k], text or "") if _valid(k, m.group()))
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in spans), tuple(sum(x[2] == k for x in spans) for k in order)


def disclosed(texts, z=1.0, generalise=0.75, remove=0.5):
    """text -> set of (kind, start, end) of terms that give a found value away, from counts over the different texts."""
    texts = {t for t in texts if t}
    spans = {t: [(k, m) for k in KINDS for m in re.finditer(KINDS[k], t) if _valid(k, m.group())] for t in texts}
    words = {t: [(m.group().lower(), m) for m in re.finditer(r"[^\W_]+", t)] for t in texts}
    total = collections.Counter(w for t in texts for w, _ in words[t])
    held = collections.defaultdict(set)
    for t in texts:
        for k, m in spans[t]:
            held[k, m.group()].add(t)
    told = {t: {} for t in texts}
    for where in held.values():
        x = collections.Counter(w for t in where for w, _ in words[t])
        for w, c in x.items():
            n = total[w]
            low = (c + z * z / 2 - z * math.sqrt(c * (n - c) / n + z * z / 4)) / (n + z * z)
            if len(w) >= 3 and any(ch.isalpha() for ch in w) and n > 1 and -math.log2(max(low, 1e-12)) <= generalise:
                for t in where:
                    told[t][w] = min(told[t].get(w, 9.0), -math.log2(low))
    out = {}
    for t in texts:
        base = [m.span() for _, m in spans[t]]
        marks = [("remove" if told[t][w] <= remove else "generalise", *m.span()) for w, m in words[t] if w in told[t]]
        out[t] = {(k, a, b) for k, a, b in marks if all(b <= c or a >= d for c, d in base)}
    return out


def rules(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    text = text or ""
    w = SPACED.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if SPACED.search(line):
            dup += line in seen
            seen.add(line)
    places = {}
    for i in range(len(w) - 7):
        places.setdefault(tuple(w[i : i + 8]), []).append(i)
    hit = {j for p in places.values() if len(p) > 1 for i in p for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


def line_classes(lines, least=20, most=2):
    """line -> class, and the lines that have a near but different line."""
    lines = sorted(set(lines))
    f, near = Forest(lines), set()
    for i, a in enumerate(lines):
        for b in lines[i + 1 :]:
            if len(a) >= least and len(b) >= least and abs(len(a) - len(b)) <= most and distance(a, b) <= most:
                f.join(a, b)
                near |= {a, b}
    return {x: f.root(x) for x in lines}, near


def _discounts(counts):
    c = [sum(n == k for n in counts.values()) for k in range(5)]
    if min(c[1:]) == 0:
        return [0.0, 0.5, 0.75, 0.9]
    y = c[1] / (c[1] + 2 * c[2])
    return [0.0] + [min(max(k - (k + 1) * y * c[k + 1] / c[k], 0.1), k - 0.01) for k in (1, 2, 3)]


def kneser_ney(texts, order):
    """A function p(n-gram) of an interpolated modified Kneser-Ney model of bytes; zero bytes stand before a text."""
    levels = {order: collections.Counter(g for t in texts for g in byte_grams(t, order))}
    for k in range(order - 1, 0, -1):
        levels[k] = collections.Counter(g[1:] for g in levels[k + 1])
    followers = {}
    for k, counts in levels.items():
        for g, n in counts.items():
            followers.setdefault((k, g[:-1]), []).append(n)
    cuts = {k: _discounts(c) for k, c in levels.items()}

    def p(g):
        if not g:
            return 1 / 256
        k, rest = len(g), followers.get((len(g), g[:-1]))
        if not rest:
            return p(g[1:])
        n, d = levels[k][g], cuts[k]
        return (n - d[min(n, 3)] + sum(d[min(m, 3)] for m in rest) * p(g[1:])) / sum(rest)

    return p


def byte_grams(text, order):
    padded = bytes(order - 1) + text
    return [padded[i : i + order] for i in range(len(text))]
