"""Spelling variants against a plain version that compares all pairs of words."""

import re
import zlib
from collections import Counter

import pytest

from faultlens.llm import spelling
from tests.llm.brute import ODD
from tests.llm.conftest import ordered


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(a == b[:k] + b[k + 1:] for k in range(len(b)))


def plain(rows):
    seen = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            crc = 1 if i is None else zlib.crc32(f"{i}:{run}".encode())
            seen[run if crc % 31 else run[:crc % len(run)] + run[crc % len(run) + 1:]] += 1
    n = {w: k for w, k in seen.items() if len(w) >= 7 and k >= 2}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w
    return [(w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n]


#: Chains of forms, ties, repeated letters at the cut, letters of two bytes, an upper-case letter that stays.
MADE = (["abcdefgh"] * 2 + ["abcdefghi"] * 80 + ["abcdefghij"] * 2500 + ["abcdefgx"] * 80 + ["aaaaaaa"] * 3 + ["aaaaaaaa"] * 40
        + ["\u00fcbergang"] * 2 + ["\u00dcbergang"] * 30 + ["ubergang"] * 30 + ["Straight"] * 2 + ["strajght"] * 2 + ["sixsix"] * 9 + ["abcdfegh"] * 2)


@pytest.mark.parametrize("spare", [0, 1])
def test_variants_equal_plain(spark, odd, docs, spare):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()] + [(1000 + k, w) for k, w in enumerate(MADE)]
    rows += [(r.doc_id + 5000, r.text) for r in docs.where("doc_id < 40").select("doc_id", "text").collect()]
    frame = spark.createDataFrame([(i, t, "x", 1, "r") for i, t in rows], "doc_id long, text string, word string, n int, root string")
    got = spelling.variants(frame.repartition(3), spare=spare)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = plain(rows)
    assert ordered(got.collect()) == ordered(want)
    assert any(r[1] and r[2] != r[1] for r in want)  # a chain of two forms is among them
    assert len(ODD) and spelling.variants(frame.limit(0)).count() == 0
