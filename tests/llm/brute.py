"""Plain versions of the operators, for small tables held in memory."""

from __future__ import annotations

import hashlib
import re

import xxhash

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

#: Rows that every operator must survive: null and empty texts, white space, a long text, copies, repeated rows, odd characters.
ODD = [
    (1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, "one"), (5, "Ünï çödé ½ 日本語 😀 \x00"), (6, "x " * 30_000), (7, "y" * 40_000),
    (8, "same text here and\nthere"), (9, "same  text here\tand\nthere"), (9, "same  text here\tand\nthere"), (None, "same text here and\nthere"),
    (None, None), (10, "a@b.c+x@d.e and 1.2.3.4.5.6.7.8"), (11, "+1 (366) 555-9807 4532015112830366 "), (12, "\n\n\n"), (13, "<|endoftext|> <s> ▁"),
]


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def exact_dedup(rows):
    norm = [re.sub(SPACE + "+", " ", t or "") for _, t in rows]
    out = []
    for k, (i, _) in enumerate(rows):
        same = [(rows[j][0] is None, rows[j][0] or 0, j) for j in range(len(rows)) if norm[j] == norm[k]]
        best = min(same)
        out.append((i, rows[best[2]][0], len(same), sha(norm[k])))
    return out


def simhash(text, k=4):
    words = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[a:a + k]) for a in range(len(words) - k + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(n, linked):
    """Smallest member of each of ``0 .. n-1`` under ``linked(a, b)``."""
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in range(n):
        for b in range(a):
            if linked(a, b):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return [find(x) for x in range(n)]


PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
       "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum((v // 10 + v % 10) for v in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits)))) % 10 == 0


def pii(text):
    def good(kind, match):
        digits = re.sub("[^0-9]", "", match)
        return {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in match.split(".")),
                "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
    return [(k, m.start(), m.end()) for k, p in PII.items() for m in re.finditer(p, text or "") if good(k, m[0])]


def line_dedup(rows, least):
    def key(line):
        return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))
    count = {}
    for _, t in rows:
        for x in {key(line) for line in (t or "").split("\n")} - {""}:
            count[x] = count.get(x, 0) + 1
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if count.get(key(x), 0) < least]
        out.append((i, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return out


def substring_dedup(rows, window):
    tokens = [(i, re.findall(WORD, t or "")) for i, t in rows]
    first = {}
    for i, x in tokens:
        for k in range(len(x) - window + 1 if i is not None else 0):
            w = tuple(x[k:k + window])
            first[w] = min(first.get(w, i), i)
    out = []
    for i, x in tokens:
        gone = [False] * len(x)
        for k in range(len(x) - window + 1 if i is not None else 0):
            if first[tuple(x[k:k + window])] < i:
                gone[k:k + window] = [True] * window
        out.append((i, len(x), sum(gone), sha(" ".join(a for a, b in zip(x, gone) if not b))))
    return out
