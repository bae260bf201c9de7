"""Language-model scoring: the base columns against a plain version, the model against its definition and held-out texts."""

import math
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from faultlens.llm import lm_score
from faultlens.llm.attention import Attention
from tests.llm.brute import WORD

BPE = public_tokenizers.path("byte_bpe_50k.json")


def plain_base(rows):
    """``(id, held_out, n_tokens, n_known, train_tokens, base_score)`` of each row."""
    low = [re.sub("[A-Z]", lambda m: m[0].lower(), t or "") for _, t in rows]
    tokens = [[*re.findall(WORD, t), "\n"] for t in low]
    aside = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows]
    count = Counter(w for t, a in zip(tokens, aside) if not a for w in t)
    total, distinct = sum(count.values()), len(count)
    return [(i, a, len(t), sum(w in count for w in t), total, sum(math.log10((count[w] + 1) / (total + distinct + 1)) for w in t))
            for (i, _), t, a in zip(rows, tokens, aside)]


def by_row(rows, digits=6):
    return sorted(((str(r[0]), *r[1:5], round(r[5], digits)) for r in rows))


@pytest.mark.parametrize("table_words", [250_000, 50])
def test_base_columns_equal_plain(spark, odd, docs, table_words):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    rows += [(r.doc_id + 100, r.text) for r in docs.where("doc_id < 80").select("doc_id", "text").collect()]
    rows += [(7000, "a b C\x1cD İ word " + "w" * 500), (7001, "A\x0bb\x0cc")]
    frame = spark.createDataFrame([(i, t, "x", 1.0) for i, t in rows], "doc_id long, text string, word string, n double").repartition(3)
    got = lm_score.score(frame, BPE, table_words=table_words).collect()
    assert by_row(got) == by_row(plain_base(rows))
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    # equal texts have equal scores
    assert len({round(r.score, 3) for r in got if r.doc_id == 9}) == 1


def test_nothing_to_learn_from(spark, empty):
    assert lm_score.score(empty, BPE).count() == 0
    aside = [i for i in range(40) if zlib.crc32(str(i).encode()) % 7 == 2]
    got = lm_score.score(spark.createDataFrame([(i, "some words") for i in aside], "doc_id long, text string"), BPE).collect()
    assert len(got) == len(aside)
    assert all(r.held_out and r.n_known == r.train_tokens == 0 and r.base_score == 0 and math.isfinite(r.score) for r in got)


def test_every_token_is_a_training_target_once(spark):
    """The windows of all training texts hold each token, and each end, behind what stands before it."""
    texts = ["", None, "a", " ".join(f"w{k}" for k in range(40)), *["one two three four five six seven eight " * 12 + str(k) for k in range(30)]]
    with open(BPE, encoding="utf-8") as f:
        data = f.read()
    words = lm_score.Words(data)
    known = lm_score.Slots(np.zeros(words.ids, np.int64), words.end, 0, 1024)
    known.slot = (np.arange(words.ids) % 30_000).astype(np.int16)
    end = words.end % 30_000
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    share = spark.sparkContext.broadcast
    got = lm_score.training_windows(frame, share(data), share(known), 8).collect()
    pairs = Counter()
    for r in got:
        *line, valid = np.frombuffer(r.data, "<i2").tolist()
        assert len(line) == 9 and 1 <= valid <= 8
        pairs.update(zip(line[:valid], line[1:valid + 1]))
    want = Counter()
    for t in texts:
        found = words.encode([w.encode() for w in (t or "").split()])
        line = [end, *[int(i) % 30_000 for w in (t or "").split() for i in found[w.encode()]], end]
        want.update(zip(line, line[1:]))
    assert pairs == want


def test_windows_score_each_token_once():
    """Batched overlapping windows give what one window after the other gives, token by token."""
    draw = np.random.default_rng(4)
    model = Attention(64, 8, 8, 16).start(draw.random(64) + 0.1, seed=3)
    model.flat += draw.normal(0, 0.3, len(model.flat)).astype(np.float32)
    model.prepare()
    sizes = [0, 1, 14, 15, 16, 17, 31, 32, 200, 3]
    slots = draw.integers(0, 64, sum(sizes))
    edges = np.concatenate(([0], np.cumsum(sizes)))
    got = lm_score.score_texts(model, slots, edges, 5, 12)
    for k, value in enumerate(got):
        own = slots[edges[k]:edges[k + 1]]
        stream = np.concatenate(([5], own, [5]))
        total = 0.0
        for t in range(1, len(stream)):
            # the window that scores token t: the first one, or the one whose last 12 inputs hold t - 1
            start = 0 if t - 1 < 16 else 12 * (1 + (t - 1 - 16) // 12)
            total += token_log_prob(model, stream[start:t], stream[t])
        assert value == pytest.approx(total, rel=1e-4)


def token_log_prob(model, before, target):
    """The model by its definition, in double precision, for the last position of a window."""
    p = {n: a.astype(np.float64) for n, a in model.at.items()}
    x = p["embed"][before] + p["place"][:len(before)]
    score = (x[-1] @ p["query"]) @ (x @ p["key"]).T / np.sqrt(model.width)
    weight = np.exp(score - score.max())
    seen = weight / weight.sum() @ (x @ p["value"])
    state = np.tanh(x[-1] @ p["carry"] + seen @ p["out"] + p["bias"])
    kind, slot = divmod(int(target), model.per_class)
    out = 0.0
    for logits, at in ((state @ p["class_w"] + p["class_b"], kind), (state @ p["slot_w"][kind] + p["slot_b"][kind], slot)):
        out += logits[at] - logits.max() - np.log(np.exp(logits - logits.max()).sum())
    return out


def test_probabilities_sum_to_one():
    model = Attention(64, 8, 8, 16).start(np.arange(64.0))
    model.prepare()
    state = model.states(np.arange(16)[None, :])[0, -1:]
    assert np.exp(model.log_prob(np.repeat(state, 64, axis=0), np.arange(64))).sum() == pytest.approx(1, abs=1e-4)
    with open(BPE, encoding="utf-8") as f:
        words = lm_score.Words(f.read())
    counts = np.zeros(words.ids, np.int64)
    counts[:3000] = np.arange(3000)
    slots = lm_score.Slots(counts, words.end, 7, 64)
    rest = slots.slot == 63
    assert np.exp(slots.extra[rest]).sum() == pytest.approx(1) and rest.sum() == words.ids - 63 and slots.slot[words.end] == 63


def test_gradient():
    draw = np.random.default_rng(0)
    model = Attention(32, 8, 4, 8).start(np.ones(32))
    ids, target, valid = draw.integers(0, 32, (3, 8)), draw.integers(0, 32, (3, 8)), draw.random((3, 8)) < 0.8
    _, grad = model.gradient(ids, target, valid)
    lo = 0
    for shape in model.shapes.values():
        hi = lo + int(np.prod(shape))
        k = lo + int(np.argmax(np.abs(grad[lo:hi])))
        lo, old = hi, model.flat[k]
        around = []
        for step in (0.01, -0.01):
            model.flat[k] = old + step
            around.append(model.gradient(ids, target, valid)[0])
        model.flat[k] = old
        assert (around[0] - around[1]) / 0.02 == pytest.approx(grad[k], rel=0.02, abs=1e-4)


def step_by_step(model, ids, target, valid):
    """The gradient with each of the layer's projections taken by itself, as the definition has them."""
    p, grad = model.at, np.zeros_like(model.flat)
    g = model._views(grad)
    (n, w), d, scale = ids.shape, model.width, np.float32(1 / np.sqrt(model.width))
    x = p["embed"][ids] + p["place"][:w]
    parts = ("query", "key", "value", "carry")
    into = np.concatenate([p[name] for name in parts], axis=1)
    q, k, v, carry = (np.ascontiguousarray(a) for a in np.split((x.reshape(-1, d) @ into).reshape(n, w, 4 * d), 4, axis=2))
    s = np.matmul(q, k.transpose(0, 2, 1)) * scale
    a = np.exp(s - s.max(axis=2, keepdims=True)) * np.tril(np.ones((w, w), np.float32))
    a /= a.sum(axis=2, keepdims=True)
    o = np.matmul(a, v)
    h = np.tanh(carry + (o.reshape(-1, d) @ p["out"]).reshape(o.shape) + p["bias"])
    state, goal = h[valid], target[valid]
    each, m, loss = np.arange(len(goal)), len(goal), 0.0
    prob = state @ p["class_w"] + p["class_b"]
    prob = np.exp(prob - prob.max(axis=1, keepdims=True))
    prob /= prob.sum(axis=1, keepdims=True)
    kind, place = np.divmod(goal, model.per_class)
    loss -= np.log(prob[each, kind]).sum(dtype=np.float64)
    prob[each, kind] -= 1
    prob /= m
    g["class_w"][...], g["class_b"][...] = state.T @ prob, prob.sum(axis=0)
    d_state = prob @ p["class_w"].T
    order = np.argsort(kind, kind="stable")
    edges = np.searchsorted(kind[order], np.arange(model.slots // model.per_class + 1))
    own, place, back = state[order], place[order], np.empty_like(state)
    prob = np.repeat(p["slot_b"], np.diff(edges), axis=0)
    for c in np.flatnonzero(np.diff(edges)):
        prob[edges[c]:edges[c + 1]] += own[edges[c]:edges[c + 1]] @ p["slot_w"][c]
    prob = np.exp(prob - prob.max(axis=1, keepdims=True))
    prob /= prob.sum(axis=1, keepdims=True)
    loss -= np.log(prob[each, place]).sum(dtype=np.float64)
    prob[each, place] -= 1
    prob /= m
    for c in np.flatnonzero(np.diff(edges)):
        rows = slice(edges[c], edges[c + 1])
        g["slot_w"][c], g["slot_b"][c] = own[rows].T @ prob[rows], prob[rows].sum(axis=0)
        back[rows] = prob[rows] @ p["slot_w"][c].T
    d_state[order] += back
    d_pre = np.zeros_like(h)
    d_pre[valid] = d_state * (1 - state * state)
    flat = d_pre.reshape(-1, d)
    g["bias"][...], g["out"][...] = flat.sum(axis=0), o.reshape(-1, d).T @ flat
    d_o = (flat @ p["out"].T).reshape(o.shape)
    d_a = np.matmul(d_o, v.transpose(0, 2, 1))
    d_s = a * (d_a - (d_o * o).sum(axis=2, keepdims=True)) * scale
    behind = np.concatenate((np.matmul(d_s, k), np.matmul(d_s.transpose(0, 2, 1), q), np.matmul(a.transpose(0, 2, 1), d_o), d_pre), axis=2)
    behind = behind.reshape(-1, 4 * d)
    for name, part in zip(parts, np.split(x.reshape(-1, d).T @ behind, 4, axis=1)):
        g[name][...] = part
    d_x = (behind @ into.T).reshape(x.shape)
    g["place"][:w] = d_x.sum(axis=0)
    np.add.at(g["embed"], ids.ravel(), d_x.reshape(-1, d))
    return loss / m, grad


def training_batches(model, many=4):
    draw = np.random.default_rng(6)
    share = 1 / (np.arange(model.slots) + 5)
    lines = draw.choice(model.slots, size=(many, 32, model.window + 1), p=share / share.sum())
    return [(a[:, :-1], a[:, 1:], draw.random((32, 1)) * 2 * model.window > np.arange(model.window)[None, :]) for a in lines]


def test_gradient_equals_the_layer_step_by_step():
    """Batches of several sizes, one after the other on the same model: nothing of one is left in the next."""
    model = Attention(1024).start(1 / (np.arange(1024.0) + 5), seed=1)
    model.flat += np.random.default_rng(5).normal(0, 0.2, len(model.flat)).astype(np.float32)
    for ids, target, valid in training_batches(model):
        for size in (32, 1, 17):
            loss, grad = model.gradient(ids[:size], target[:size], valid[:size])
            want, each = step_by_step(model, ids[:size], target[:size], valid[:size])
            assert loss == pytest.approx(want, rel=1e-5)
            assert np.abs(grad - each).max() < 1e-5 * max(1, np.abs(each).max())


def test_training_costs_less_than_the_layer_step_by_step():
    model = Attention(1024).start(1 / (np.arange(1024.0) + 5), seed=1)
    batches, cost = training_batches(model), {}
    for _ in range(15):
        for name, run in (("now", model.gradient), ("plain", lambda *batch: step_by_step(model, *batch))):
            began = time.process_time()
            for batch in batches:
                run(*batch)
            cost[name] = min(cost.get(name, 1e9), time.process_time() - began)
    assert cost["now"] < 0.85 * cost["plain"]


def test_words_alone_and_in_a_line():
    with open(BPE, encoding="utf-8") as f:
        data = f.read()
    words = lm_score.Words(data)
    from tokenizers import Tokenizer
    library = Tokenizer.from_str(data)
    library.encode_special_tokens = True
    texts = ["the", "don't", "é日本", "12.5", "<|endoftext|>", "a ", " b", "　", "x\x1c", "\x85", "�", "--"]
    assert words.end == 50256 == library.token_to_id("<|endoftext|>")
    got = words.encode([t.encode() for t in texts])
    assert [got[t.encode()].tolist() for t in texts] == [library.encode(" " + t, add_special_tokens=False).ids for t in texts]


def test_training_lowers_the_loss_of_held_out_texts(docs):
    """On texts that the model has not learned from, its score beats the same model without training."""
    some = docs.where("length(text) < 4000")
    learned = lm_score.score(some, BPE).where("held_out").groupBy().sum("score").first()[0]
    start = lm_score.score(some, BPE, rounds=0).where("held_out").groupBy().sum("score").first()[0]
    assert learned > 0.98 * start


@pytest.mark.parametrize("limit", [3, 1 << 20])
def test_words_of_a_batch_are_those_of_bytes(limit):
    texts = ["", None, "  a B", "x \x0b\x0cy\x1c z\x85 q\xa0r\t", "\u0130 \u00c4 \u00c9  e\u3000f", "\n", "a" * 5000, " ", "b a"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
    got = []
    for part, listed, at, edges in lm_score._split([batch], 0, limit):
        assert part.num_rows == len(edges) - 1 and b"" not in listed.to_pylist()
        words = [listed[k].as_py() for k in at.tolist()]
        got += [words[lo:hi] for lo, hi in zip(edges, edges[1:])]
    assert got == [(t or "").encode().lower().split() for t in texts]
