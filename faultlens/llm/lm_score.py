"""Language-model scoring: a causal self-attention model over subword ids, learned from the corpus itself.

* Every word of every training text is counted (the counts of the base score). Subword counts follow from the word counts;
  they choose the model's slots, its starting biases and the shares of the ids that have no slot of their own.
* Every training text is cut into windows for the training of the attention weights, and each of its tokens, and its end, is the
  target of one of them. Tasks train on parts of bounded size from common weights, which are then averaged up a tree; rounds use
  different windows, all together every one.
* Scoring reads whole texts in windows that overlap: the first scores all its tokens, each later one only those behind the
  overlap, so each token counts once and (but for the first) has at least ``window - stride`` others before it.

A text is its words, lower-cased (A-Z) and each after a space, then one end. The base score looks frequent words up in a
broadcast table of bounded size; the others, which are rare by that choice, are joined.
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from faultlens.llm.attention import Attention
from faultlens.llm.common import pick, settle, worker_state
from faultlens.llm.mphf import mix
from faultlens.llm.packing import octets, ranked

#: White space by which words could not be told apart safely in a line of them.
_RARE = re.compile("[\x1c-\x1f\x85\xa0  -     　]")
#: Tokens scored at once.
_TOKENS = 1 << 13
#: Windows of a training task, weights averaged by a node of the tree, and distinct words counted before a task hands them on.
TASK_WINDOWS, FAN_IN, _WORDS = 1 << 14, 16, 400_000
#: Longer words are never in the broadcast table.
_LONGEST = 64


class Words:
    """The tokenizer, and the subword ids of the words that a task remembers."""

    def __init__(self, data: str):
        whole = json.loads(data)
        specials = {t["content"]: t["id"] for t in whole.get("added_tokens", [])}
        self.ranked = ranked(whole, set(specials))
        if self.ranked is None or not specials:
            raise ValueError("only byte-level BPE files with merges in id order and an end token are supported")
        #: the end of a text, also what stands before its first word
        self.end = min(specials.values())
        self.size_of = np.array(list(map(len, octets(whole))), np.int64)
        self.ids = max(len(self.size_of), 1 + max(specials.values()))

    def flat(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Another order of the words, their ids behind a space one after the other in it, and how many ids each has.

        Words of odd white space are encoded alone, the others in lines of some thousand.
        """
        order, ids, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for lo in range(0, len(words), 20_000):
            part = words[lo:lo + 20_000]
            many, alone, line, sizes = range(len(part)), [], b" " + b" ".join(part), [1 + len(w) for w in part]
            try:
                line = line.decode()
            except UnicodeDecodeError:
                line = None
            if line is None or _RARE.search(line):
                text = [" " + w.decode("utf-8", "replace") for w in part]
                alone = [k for k, t in enumerate(text) if _RARE.search(t)]
                odd = set(alone)
                many = [k for k in many if k not in odd]
                line, sizes = "".join(text[k] for k in many), [len(text[k].encode()) for k in many]
            order += [lo + np.array(many, np.int64), lo + np.array(alone, np.int64)]
            ids.append(self.ranked.encode_to_numpy(line, disallowed_special=()).astype(np.int64))
            counts.append(np.diff(np.searchsorted(np.cumsum(self.size_of[ids[-1]]), np.cumsum(sizes), side="right"), prepend=0))
            for k in alone:
                ids.append(self.ranked.encode_to_numpy(text[k], disallowed_special=()).astype(np.int64))
                counts.append(np.array([len(ids[-1])]))
        return np.concatenate(order), np.concatenate(ids), np.concatenate(counts)

    def encode(self, words: list[bytes]) -> dict[bytes, np.ndarray]:
        """Ids of each word behind a space."""
        order, ids, counts = self.flat(words)
        return dict(zip((words[k] for k in order), np.split(ids, np.cumsum(counts)[:-1])))


def _of_worker(data: str) -> Words:
    held = worker_state().setdefault("lm_words", {})
    key = hashlib.sha256(data.encode()).digest()
    if key not in held:
        held.clear()
        held[key] = Words(data)
    return held[key]


def _split(batches, text_at: int, limit: int = 1 << 22):
    """``(batch slice, its different words, place of each word in them, edges of the texts)`` for about ``limit`` bytes of text.

    Arrow's functions for ASCII know the letters A-Z and the white space of the contract alone, as those of bytes do.
    """
    for whole in batches:
        texts = whole.column(text_at).cast(pa.string()).fill_null("")
        sizes = pc.binary_length(texts).to_numpy()
        lo = 0
        while lo < len(texts):
            hi = max(lo + 1, lo + int(np.searchsorted(np.cumsum(sizes[lo:lo + limit]), limit, side="right")))
            split = pc.ascii_split_whitespace(pc.ascii_lower(texts.slice(lo, hi - lo)))
            coded = split.flatten().dictionary_encode()
            listed, at, edges = coded.dictionary.cast(pa.binary()), coded.indices.to_numpy().astype(np.int64), split.offsets.to_numpy()
            # white space at an end of a text leaves an empty word there
            none = pc.index(listed, pa.scalar(b"", pa.binary())).as_py()
            if none >= 0:
                some = at != none
                edges = np.concatenate(([0], np.cumsum(some)))[edges]
                at = at[some]
                at -= at > none
                listed = listed.filter(pc.not_equal(listed, pa.scalar(b"", pa.binary())))
            yield whole.slice(lo, hi - lo), listed, at, edges.astype(np.int64)
            lo = hi


def _ids_of(words: Words, listed: pa.Array, at: np.ndarray):
    """Ids of the words ``listed[at]`` one after the other, where each word's begin, and ``(ids of the listed words, edges, their places)``.

    Each different word is encoded once.
    """
    order, ids, counts = words.flat(listed.to_pylist())
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    at = place[at]
    start = np.concatenate(([0], np.cumsum(counts)))
    length = counts[at]
    before = np.concatenate(([0], np.cumsum(length)))
    return ids[np.arange(before[-1]) + np.repeat(start[at] - before[:-1], length)], before, (ids, start, place)


def word_counts(training: DataFrame) -> DataFrame:
    """``(word, n)`` over all words of ``training(text)``; words are bytes."""

    def run(batches):
        held, fresh = [], 0
        empty = pa.table({"word": pa.array([], pa.binary()), "n": pa.array([], pa.int64())})

        def summed():
            found = pa.concat_tables([empty, *held]).group_by("word", use_threads=False).aggregate([("n", "sum")])
            return found.select(["word", "n_sum"]).rename_columns(["word", "n"])

        for _, listed, at, _ in _split(batches, 0):
            held.append(pa.table({"word": listed, "n": np.bincount(at, minlength=len(listed))}))
            fresh += len(listed)
            if fresh > _WORDS:
                held, fresh = [summed()], 0
                if len(held[0]) > _WORDS:
                    yield from held[0].to_batches(1 << 16)
                    held = []
        yield from summed().to_batches(1 << 16)

    return training.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def subword_counts(counts: DataFrame, shared) -> np.ndarray:
    """How often each subword id occurs in the words counted (a number for each id of the tokenizer)."""

    def run(batches):
        words = _of_worker(shared.value)
        total = np.zeros(words.ids, np.int64)
        for batch in batches:
            order, ids, counts = words.flat(batch.column("word").to_pylist())
            weights = np.repeat(batch.column("n").to_numpy()[order].astype(np.float64), counts)
            # whole numbers below 2^53 are exact as doubles
            total += np.bincount(ids, weights, words.ids).astype(np.int64)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["id", "n"])

    found = counts.mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(_of_worker(shared.value).ids, np.int64)
    for r in found:
        out[r["id"]] = r["n"]
    return out


class Slots:
    """Which slot each subword id has, and what an id adds to its slot's log probability."""

    def __init__(self, counts: np.ndarray, end: int, texts: int, slots: int):
        counts = counts.copy()
        counts[end] = texts
        order = np.argsort(-counts, kind="stable")
        own = np.sort(order[:slots - 1])
        own = own[np.argsort(-counts[own], kind="stable")]
        #: ids without a slot share the last one, by their counts plus one
        self.slot = np.full(len(counts), slots - 1, np.int16)
        self.slot[own] = np.arange(len(own))
        rest = self.slot == slots - 1
        self.extra = np.zeros(len(counts), np.float64)
        self.extra[rest] = np.log((counts[rest] + 1) / (counts[rest].sum() + rest.sum()))
        self.counts = np.append(counts[own], counts[rest].sum()).astype(np.float64)


def _windows(slots: np.ndarray, edges: np.ndarray, end: int, window: int) -> np.ndarray:
    """Rows of ``window + 1`` slots and how many of the last ``window`` are targets, for texts ``slots[edges[i]:edges[i + 1]]``.

    A text's stream is the end slot, its slots, the end slot. Windows share one slot with the next, so that all but the first are
    a target once; behind the last slot come end slots that are none.
    """
    size = np.diff(edges) + 1
    many = -(-size // window)
    begin = np.concatenate(([0], np.cumsum(many)))
    out = np.full((begin[-1], window + 2), end, np.int16)
    number = np.arange(len(slots)) - np.repeat(edges[:-1], np.diff(edges))
    first = np.repeat(begin[:-1], np.diff(edges))
    out[first + number // window, number % window + 1] = slots
    # the last slot of a window begins the next one
    next_up = np.flatnonzero((number + 1) % window == 0)
    out[first[next_up] + (number[next_up] + 1) // window, 0] = slots[next_up]
    out[:, -1] = window
    out[begin[1:] - 1, -1] = size - (many - 1) * window
    return out


def training_windows(training: DataFrame, shared, slots, window: int) -> DataFrame:
    """``(turn, data)``: all windows of the training texts, as ``window + 1`` slots (16 bits) and the number of targets.

    ``turn`` deals windows at random by their place, not by their content: copies go to different tasks.
    """

    def run(batches):
        words, known = _of_worker(shared.value), slots.value
        task, done = TaskContext.get().partitionId(), 0
        end = int(known.slot[words.end])
        for _, listed, at, edges in _split(batches, 0):
            ids, before, _ = _ids_of(words, listed, at)
            rows = _windows(known.slot[ids], before[edges], end, window)
            turns = mix((np.arange(done, done + len(rows)) << 24) + task, 0) >> np.uint64(16)
            done += len(rows)
            data = pa.FixedSizeBinaryArray.from_buffers(pa.binary(rows.shape[1] * 2), len(rows), [None, pa.py_buffer(rows.astype("<i2"))])
            yield pa.RecordBatch.from_arrays([pa.array(turns.astype(np.int64)), data.cast(pa.binary())], ["turn", "data"])

    return training.select("text").mapInArrow(run, "turn long, data binary")


def train(windows: DataFrame, model: Attention, rounds: int = 2, rate: float = 0.01) -> Attention:
    """The model after ``rounds`` of local training and averaging, each round over windows of its own."""
    spark = windows.sparkSession
    total = windows.count()
    if not total or not rounds:
        return model
    parts, size = max(1, -(-total // (TASK_WINDOWS * rounds))), model.window

    def learner(now, rate):
        def learn(frame: pd.DataFrame) -> pd.DataFrame:
            *shape, flat = now.value
            own = Attention(*shape, flat=flat)
            frame = frame.sort_values(["turn", "data"])
            data = np.frombuffer(b"".join(frame["data"]), "<i2").reshape(-1, size + 2).astype(np.int64)
            valid = np.arange(size)[None, :] < data[:, size + 1:]
            own.learn(data[:, :size], data[:, 1:size + 1], valid, rate)
            return pd.DataFrame({"part": frame["part"].iloc[:1].to_numpy(), "weight": [float(len(data))],
                                 "flat": [(own.flat.astype(np.float64) * len(data)).tobytes()]})
        return learn

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": frame["part"].iloc[:1].to_numpy(), "weight": [frame["weight"].sum()],
                             "flat": [sum(np.frombuffer(x, np.float64) for x in frame["flat"]).tobytes()]})

    for turn in range(rounds):
        now = spark.sparkContext.broadcast((model.slots, model.per_class, model.width, model.window, model.flat))
        schema = "part int, weight double, flat binary"
        learned = (windows.where(F.pmod("turn", F.lit(rounds)) == turn)
                   .withColumn("part", F.expr(f"cast(pmod(turn div {rounds}, {parts}) as int)")).groupBy("part")
                   .applyInPandas(learner(now, rate / (1 + turn)), schema))
        left = parts
        while left > 1:
            learned = settle(learned).withColumn("part", F.expr(f"cast(part div {FAN_IN} as int)")).groupBy("part").applyInPandas(add, schema)
            left = -(-left // FAN_IN)
        got = learned.first()
        if got is not None:
            model = Attention(model.slots, model.per_class, model.width, model.window, np.frombuffer(got["flat"], np.float64) / got["weight"])
    return model


def score_texts(model: Attention, slots: np.ndarray, edges: np.ndarray, end: int, stride: int) -> np.ndarray:
    """Natural log probability of each text, of its slots and its end; text ``i`` is ``slots[edges[i]:edges[i + 1]]``.

    Window ``k`` of a text begins ``k * stride`` tokens in; every token, and the end, is scored once.
    """
    window = model.window
    size = np.diff(edges) + 1
    # the stream of a text: the end slot, its slots (inputs); its slots, the end slot (targets)
    begin = np.concatenate(([0], np.cumsum(size)))
    inputs = np.full(begin[-1] + window, end, np.int64)
    targets = np.full(begin[-1] + window, end, np.int64)
    at = np.arange(len(slots)) + np.repeat(np.arange(len(size)), np.diff(edges))
    inputs[at + 1], targets[at] = slots, slots
    inputs[begin[:-1]] = end
    more = np.maximum(-(-(size - window) // stride), 0)
    out = np.zeros(begin[-1])
    later = np.repeat(begin[:-1], more) + stride * (1 + np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more))
    stop = np.repeat(begin[1:], more)
    for starts, stops, first in ((begin[:-1], begin[1:], 0), (later, stop, window - stride)):
        many = max(1, _TOKENS // window)
        for lo in range(0, len(starts), many):
            place = starts[lo:lo + many, None] + np.arange(window)
            scored = place[:, first:].ravel()
            ok = np.flatnonzero(scored < np.repeat(stops[lo:lo + many], window - first))
            state = model.states(np.take(inputs, place), first).reshape(len(scored), -1)
            if len(ok) < len(scored):
                state, scored = np.take(state, ok, axis=0), scored[ok]
            out[scored] = model.log_prob(state, targets[scored])
    return np.add.reduceat(out, begin[:-1]) if len(size) else np.zeros(0)


def _frequent(counts: DataFrame, limit: int) -> int:
    """The least count that at most ``limit`` words reach, in steps of a quarter power of two (one row for each step)."""
    sizes = counts.groupBy(F.floor(F.log2("n") * 4).cast("int").alias("step")).agg(F.count("*").alias("k"), F.min("n").alias("n")).collect()
    total, least = 0, 1 << 62
    for r in sorted(sizes, key=lambda r: -r["step"]):
        total += r["k"]
        if total > limit:
            break
        least = r["n"]
    return least


def score(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", table_words: int = 250_000,
          slots: int = 1024, width: int = 16, window: int = 32, stride: int = 24, rounds: int = 2) -> DataFrame:
    """One row per row of ``docs``: ``id_col, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    ``score`` is the model's log10 probability of the whole text and its end. Null and empty texts are an end alone. A null id
    counts as the empty text in the choice of training rows, so it is learned from. Repeated rows count and are scored each.
    An empty table gives no rows; without training rows the model is uniform over its slots and no word is known. Extra columns
    are ignored.
    """
    spark = docs.sparkSession
    crc = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    source = pick(docs, id_col, text_col).select(
        F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), (crc % 7 == 2).alias("held_out"))
    kind = source.schema["id"].dataType.simpleString()
    with open(tokenizer_path, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())
    training = source.where("NOT held_out")
    counts = settle(word_counts(training))
    texts = training.count()
    all_words = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    tokens, distinct = all_words["n"] + texts, all_words["v"] + (texts > 0)

    subwords = Slots(subword_counts(counts, shared), _of_worker(shared.value).end, texts, slots)
    windows = settle(training_windows(training, shared, spark.sparkContext.broadcast(subwords), window))
    model = train(windows, Attention(slots, width=width, window=window).start(subwords.counts), rounds)
    least = 0 if distinct <= table_words else _frequent(counts, table_words)
    frequent = counts.where((F.col("n") >= least) & (F.length("word") <= _LONGEST))
    # words of at most _LONGEST bytes, at most table_words of them
    table = {bytes(r["word"]): r["n"] for r in frequent.collect()}
    held = spark.sparkContext.broadcast((table, model.flat, subwords))
    bottom = tokens + distinct + 1

    def run(batches):
        words = _of_worker(shared.value)
        table, flat, subwords = held.value
        own = Attention(slots, width=width, window=window, flat=flat)
        own.prepare()
        last = int(subwords.slot[words.end])
        end_log = np.log10((texts + 1) / bottom)
        for batch, listed, at, edges in _split(batches, 1):
            ids, before, (of_word, start, place) = _ids_of(words, listed, at)
            of_text = lambda x, edges=edges: np.diff(np.concatenate(([0], np.cumsum(x)))[edges])
            extra = np.diff(np.concatenate(([0], np.cumsum(subwords.extra[of_word])))[start])[place]
            slot = subwords.slot[ids].astype(np.int64)
            logs = score_texts(own, slot, before[edges], last, stride) + of_text(extra[at]) + subwords.extra[words.end]
            n = np.array([table.get(w, -1) for w in listed.to_pylist()], np.int64)
            base = np.where(n > 0, np.log10(np.maximum(n + 1, 1) / bottom), 0.0)
            # words that the table lacks, with how often each text holds them
            where = np.flatnonzero(n[at] < 0)
            key, times = np.unique((np.searchsorted(edges, where, side="right") - 1) << 32 | at[where], return_counts=True)
            rare = pa.StructArray.from_arrays([listed.take(pa.array(key & 0xFFFFFFFF)), pa.array(times, pa.int64())], ["word", "times"])
            rare_edges = np.searchsorted(key >> 32, np.arange(len(edges))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(np.diff(edges) + 1), pa.array(of_text((n > 0)[at]).astype(np.int64) + (texts > 0)),
                 pa.array(of_text(base[at]) + end_log), pa.array(logs / np.log(10)), pa.ListArray.from_arrays(pa.array(rare_edges), rare)],
                ["id", "held_out", "n_tokens", "n_known", "base_score", "score", "rare"])

    rows = settle(source.select("id", "text", "held_out").mapInArrow(
        run, f"id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double, "
             "rare array<struct<word:binary,times:long>>").withColumn("row", F.monotonically_increasing_id()))
    # a word that is not in the table occurs less than ``least`` times or is long, so no key of this join is hot
    asked = rows.select("row", F.inline("rare"))
    told = asked.join(counts.where((F.col("n") < least) | (F.length("word") > _LONGEST)), "word", "left").groupBy("row").agg(
        F.sum(F.when(F.col("n").isNotNull(), F.col("times"))).alias("known"),
        F.sum(F.col("times") * F.log10((F.coalesce("n", F.lit(0)) + 1) / F.lit(float(bottom)))).alias("more"))
    return rows.join(told, "row", "left").select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(int(tokens)).alias("train_tokens").cast("long"), (F.col("base_score") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "score")
