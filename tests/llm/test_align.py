"""Cross-tokenizer alignment against a plain version, and its minimal perfect hash."""

import hashlib
import json
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from faultlens.llm import packing, token_align
from faultlens.llm.mphf import Mphf, mix
from tests.llm.brute import ODD
from tests.llm.conftest import ordered

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def plain(texts):
    """All columns but the id, from the two libraries and whole texts."""
    a = Tokenizer.from_file(BPE)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    with open(BPE, encoding="utf-8") as f:
        a_bytes = packing.octets(json.load(f))
    found = []
    for text in texts:
        groups, text = [], text or ""
        x = [] if not text else a.encode(" " + text, add_special_tokens=False).ids
        y = [] if not text else b.encode(text)
        pieces = [b.id_to_piece(i) for i in y]
        y_bytes = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) and b.is_byte(i) else p.replace("▁", " ").encode()
                   for i, p in zip(y, pieces)]
        whole = (" " + text).encode()
        if b"".join(a_bytes[i] for i in x) != whole or b"".join(y_bytes) != whole:
            x, y = [], []
        i = j = end_a = end_b = 0
        begin = (0, 0)
        while i < len(x):
            if end_a <= end_b:
                end_a += len(a_bytes[x[i]])
                i += 1
            while end_b < end_a:
                end_b += len(y_bytes[j])
                j += 1
            if end_a == end_b:
                groups.append((x[begin[0]:i], y[begin[1]:j]))
                begin = (i, j)
        found.append((len(x), len(y), groups))
    count = Counter((g[0][-1], g[1][-1]) for _, _, groups in found for g in groups)
    best = Counter()
    for (_, piece), n in count.items():
        best[piece] = max(best[piece], n)
    out = []
    for n_a, n_b, groups in found:
        links = [(g[0][-1], g[1][-1]) for g in groups]
        shown = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
        out.append((n_a, n_b, len(groups), len(links), sum(count[p] == best[p[1]] for p in links), sum(count[p] for p in links),
                    hashlib.sha256(shown.encode()).hexdigest() if n_a else ""))
    return out


HARD = ["foo\n \nbar  baz\t\tqux \n", " lead", "\nlead", "tail ", "tail\n\n", "a\u00a0 \u00a0b", "wide\u3000 space", "x\x1c y!\x1c", "it's 'll we'd",
        "<s> </s> <0x41> <|endoftext|>", "x▁ y", "▁", "é\u0301 日本語 😀😀 ñandú", "1234 56.78 -9", "a" * 3000, "  ", "\u2028 z", "\r\nwin\r\n", "\x00 nul"]


@pytest.mark.parametrize("table_keys", [2_000_000, 40])
def test_alignment_equals_plain(spark, odd, docs, table_keys):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()] + [(1000 + k, t) for k, t in enumerate(HARD)]
    rows += [(r.doc_id + 5000, r.text) for r in docs.where("doc_id < 60").select("doc_id", "text").collect()]
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, pair string, n int").repartition(3)
    got = token_align.align(frame, BPE, PIECES, table_keys=table_keys)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert ordered(got.collect()) == ordered((i, *p) for (i, _), p in zip(rows, plain([t for _, t in rows])))


def test_alignment_does_not_depend_on_slices(spark, docs, monkeypatch):
    some = docs.where("doc_id < 40")
    whole = ordered(token_align.align(some, BPE, PIECES).collect())
    for name, value in (("_AT_ONCE", 2000), ("_UNITS", 50), ("SHARD_KEYS", 300), ("LEAF_ROWS", 200), ("FAN_IN", 2)):
        monkeypatch.setattr(token_align, name, value)
    assert ordered(token_align.align(some.repartition(7), BPE, PIECES).collect()) == whole


def test_alignment_of_nothing(empty):
    assert token_align.align(empty, BPE, PIECES).count() == 0


def test_minimal_perfect_hash():
    draw = np.random.default_rng(1)
    for size in (0, 1, 2, 63, 1000, 50_000):
        keys = np.unique(draw.integers(0, 1 << 62, size))
        made = Mphf.unpack(Mphf.build(keys).pack())
        assert made.size == len(keys) and sorted(made.numbers(keys).tolist()) == list(range(len(keys)))
    assert (made.numbers(keys[:5] + 1) < len(keys)).all()
    with pytest.raises(ValueError):
        Mphf.build(np.array([7, 7]))
    assert len(np.unique(mix(np.arange(1000), 3))) == 1000
