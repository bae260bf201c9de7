"""Best-fit packing of token pieces into sequences, by vector best-fit on a length histogram.

Every piece loads a sequence with a vector (tokens, documents, attention cost), and
no capacity may be passed.  Attention cost is the sum of squared lengths, so the vector of
a piece follows from its length, and pieces of one length are exchangeable: packing needs
the histogram of lengths alone, which has at most ``capacity`` entries at any input size.

* Tasks tokenise whole texts and cut long ones; each numbers its pieces by length.
* The histogram (the only thing the driver sees) is packed in descending
  length.  Sequences with the same content are one *bin group* with a multiplicity; a length
  goes to the feasible group whose residual is best by weighted dot-product or norm.
* Groups become slots, intervals of (length, number within the length); prefix sums of the
  tasks' counts turn local numbers into global ones, and each piece finds its slot.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from faultlens.llm.common import pick, settle

#: The byte-level pre-tokenisation of the tokenizers library (a fixed value).
_BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A text with a longer run of visible characters, or as much white space beyond one between words, goes to the tokenizers library directly.
_LONG_RUN = 5_000


class Encoder:
    """Ids of whole texts as the tokenizers library gives them, without special tokens around.

    A byte-level BPE whose merges are in id order is also run as ranked merges (tiktoken, built from the same file), about
    four times faster; ``check`` texts of each batch are encoded by both, and a difference raises. Texts with a special
    token's string or a very long run, and any other kind of tokenizer, go to the tokenizers library alone.
    """

    def __init__(self, data: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(data)
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.ranked = ranked(json.loads(data), set(self.specials))

    def encode(self, texts: list[str], check: int = 2) -> Iterator[np.ndarray]:
        def plain(text):
            if self.ranked is None or any(s in text for s in self.specials):
                return False
            sizes = list(map(len, text.split()))
            return max(sizes, default=0) <= _LONG_RUN and len(text) - sum(sizes) - len(sizes) <= _LONG_RUN

        fast = [plain(t) for t in texts]
        slow = [k for k, f in enumerate(fast) if not f]
        tested = [k for k, f in enumerate(fast) if f][:check]
        exact = {k: np.array(e.ids, np.uint32) for k, e in zip(
            slow + tested, self.tokenizer.encode_batch_fast([texts[k] for k in slow + tested], add_special_tokens=False))}
        for k, text in enumerate(texts):
            ids = self.ranked.encode_to_numpy(text, disallowed_special=()) if fast[k] else exact[k]
            if k in exact and not np.array_equal(ids, exact[k]):
                raise ValueError("ranked merges and the tokenizers library disagree")
            yield ids


def octets(whole: dict) -> list[bytes]:
    """The bytes of each id of a byte-level tokenizer file."""
    # a byte is shown as a visible character: itself, or the next unused one from 256 on
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in shown]
    octet = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}
    vocab = whole["model"]["vocab"]
    out = [b""] * (max(vocab.values(), default=-1) + 1)
    for token, i in vocab.items():
        out[i] = bytes(octet[c] for c in token) if all(c in octet for c in token) else token.encode()
    return out


def ranked(whole: dict, specials: set[str]):
    """The tokenizer file as ranked byte merges, or None if it is of another kind."""
    import tiktoken

    model, before = whole["model"], whole.get("pre_tokenizer") or {}
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model.get("merges", [])]
    vocab = model.get("vocab", {})
    if (model.get("type", "BPE") != "BPE" or not merges or before.get("type") != "ByteLevel" or whole.get("normalizer")
            or before.get("add_prefix_space") or not before.get("use_regex", True) or model.get("dropout")):
        return None
    made = [vocab[a + b] for a, b in merges]
    if any(x >= y for x, y in zip(made, made[1:])):
        return None
    shown = octets(whole)
    return tiktoken.Encoding("ranked", pat_str=_BYTE_LEVEL, mergeable_ranks={shown[i]: i for t, i in vocab.items() if t not in specials},
                             special_tokens={})


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """``(start, length)`` of the pieces: all of ``capacity`` tokens but the first, which holds the remainder."""
    first = length % capacity or min(length, capacity)
    return [(0, first), *[(s, capacity) for s in range(first, length, capacity)]]


def pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048,
           end_id: int = 0, chunk: int = 256) -> DataFrame:
    """``(id, piece, start, length, ids_crc32, part, turn)``; ``turn`` counts a task's pieces of one length from 0."""
    source = pick(docs, id_col, text_col).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    with open(tokenizer_path, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        encoder = Encoder(shared.value)
        part, turns = TaskContext.get().partitionId(), {}
        for whole in batches:
            for lo in range(0, whole.num_rows, chunk):
                batch = whole.slice(lo, chunk)
                row, piece, start, size, crc, turn = [], [], [], [], [], []
                for k, ids in enumerate(encoder.encode([t or "" for t in batch.column(1).to_pylist()])):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    for p, (s, n) in enumerate(cut(len(ids), capacity)):
                        row.append(k)
                        piece.append(p)
                        start.append(s)
                        size.append(n)
                        crc.append(zlib.crc32(ids[s:s + n]))
                        turn.append(turns.get(n, 0))
                        turns[n] = turn[-1] + 1
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                     pa.array(size, pa.int32()), pa.array(crc, pa.int64()), pa.array([part] * len(row), pa.int32()),
                     pa.array(turn, pa.int64())], ["id", "piece", "start", "length", "ids_crc32", "part", "turn"])

    return source.mapInArrow(run, f"id {kind}, piece int, start long, length int, ids_crc32 long, part int, turn long")


@dataclass
class Capacity:
    """Limits of one sequence and how its bin is chosen.

    ``attention`` None means capacity squared, which the token limit implies; ``documents`` None means no limit of its own.
    ``choose`` is ``"residual"`` (smallest weighted norm of what is left) or ``"dot"`` (largest weighted dot-product
    of load and residual). Weights go to (tokens, documents, attention cost), each as a share of its limit.
    """

    tokens: int = 2048
    documents: int | None = None
    attention: int | None = None
    weights: tuple[float, float, float] = (1.0, 0.01, 0.1)
    choose: str = "residual"

    def limits(self) -> np.ndarray:
        return np.array([self.tokens, self.documents or self.tokens, self.attention or self.tokens ** 2], np.float64)


def pack_histogram(counts: dict[int, int], capacity: Capacity) -> list[tuple[int, list[tuple[int, int]]]]:
    """Bin groups ``(multiplicity, [(length, copies), ...])`` that hold every piece of the histogram.

    Vector best-fit decreasing. A group splits at most once for each length, so there are at most three new groups for
    each length, whatever the counts. A piece that alone passes the attention or document limit raises ValueError.
    """
    limits = capacity.limits()
    weights = np.array(capacity.weights)
    room = np.zeros((64, 3))
    times: list[int] = []
    content: list[list[tuple[int, int]]] = []

    def add(residual, m, held):
        nonlocal room
        if len(times) == len(room):
            room = np.vstack([room, np.zeros_like(room)])
        room[len(times)] = residual
        times.append(m)
        content.append(held)

    for length in sorted(counts, reverse=True):
        left, load = counts[length], np.array([length, 1.0, float(length) ** 2])
        if (load > limits).any():
            raise ValueError(f"a piece of {length} tokens passes the limits {limits.tolist()}")
        # a group takes as many copies as fit at once; the best group first
        while left:
            free = room[:len(times)]
            fits = np.flatnonzero((free >= load).all(axis=1)) if len(times) else np.zeros(0, int)
            if not len(fits):
                break
            if capacity.choose == "dot":
                value = -((free[fits] / limits) * (load / limits) * weights).sum(axis=1)
            else:
                value = (weights * ((free[fits] - load) / limits) ** 2).sum(axis=1)
            g = int(fits[np.argmin(value)])
            copies = int(min((room[g] // load).min(), left))
            full = min(times[g], left // copies)
            if full < times[g]:
                add(room[g].copy(), times[g] - full, list(content[g]))
                times[g] = full
            room[g] -= copies * load
            content[g].append((length, copies))
            left -= full * copies
        if left:
            copies = int(min((limits // load).min(), left))
            add(limits - copies * load, left // copies, [(length, copies)])
            if left % copies:
                add(limits - (left % copies) * load, 1, [(length, left % copies)])
    return list(zip(times, content))


def slot_table(groups: list[tuple[int, list[tuple[int, int]]]]) -> dict[str, np.ndarray]:
    """Slots sorted by (length, first): pieces ``first ...`` of a length fill ``copies`` places in each sequence from ``base``."""
    base, first, rows = 0, {}, []
    for times, held in groups:
        offset = 0
        for length, copies in held:
            rows.append((length, first.get(length, 0), base, copies, offset))
            first[length] = first.get(length, 0) + times * copies
            offset += length * copies
        base += times
    rows.sort()
    names = ("length", "first", "base", "copies", "offset")
    return {n: np.array([r[k] for r in rows], np.int64) for k, n in enumerate(names)}


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: Capacity | None = None,
         end_id: int = 0) -> DataFrame:
    """One row per piece: ``id_col, piece, start, length, ids_crc32, sequence_id, offset``.

    Null and empty texts are one piece of the end id alone. Repeated rows are packed each; a null id stays null; an
    empty table gives no rows. Only documents of more than ``capacity.tokens`` ids are cut; sequences have no gaps.
    """
    capacity = capacity or Capacity()
    cuts = settle(pieces(docs, tokenizer_path, id_col, text_col, capacity.tokens, end_id))
    counts = settle(cuts.groupBy("length", "part").agg(F.count("*").alias("n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = slot_table(pack_histogram(histogram, capacity))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    numbered = cuts.join(starts, ["length", "part"]).select(
        "id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("turn")).alias("number"))
    kind = numbered.schema["id"].dataType.simpleString()
    # at most three groups for each length, each with at most sqrt(2 x capacity) different lengths
    shared = docs.sparkSession.sparkContext.broadcast(slots)

    def run(batches):
        own = shared.value
        ends = np.searchsorted(own["length"], np.arange(capacity.tokens + 2))
        for batch in batches:
            length = batch.column("length").to_numpy()
            number = batch.column("number").to_numpy()
            at = np.empty(len(length), np.int64)
            for n in np.unique(length):
                mine = length == n
                lo, hi = ends[n], ends[n + 1]
                at[mine] = lo + np.searchsorted(own["first"][lo:hi], number[mine], side="right") - 1
            nth = number - own["first"][at]
            copies = own["copies"][at]
            sequence = own["base"][at] + nth // copies
            offset = own["offset"][at] + (nth % copies) * length
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("piece"), batch.column("start"), pa.array(length.astype(np.int64)),
                 batch.column("ids_crc32"), pa.array(sequence), pa.array(offset)],
                ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return numbered.mapInArrow(
        run, f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long") \
        .withColumnRenamed("id", id_col)
