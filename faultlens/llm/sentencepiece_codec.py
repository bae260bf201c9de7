"""SentencePiece encoding and decoding on the tokenizers library.

The model file is a protobuf; the few fields needed are read by a small wire-format reader.  From them a tokenizer is
rebuilt: the precompiled character map and white-space rules of the normaliser, the metaspace marker, the piece
scores (a unigram model, or a merge list ranked by score for a BPE model), byte fallback and user-defined pieces.  Batches
are encoded by the library's threads.  Every row is held against the sentencepiece library itself, so parity is
verified on whole texts and returned.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from faultlens.llm.common import pick, worker_state

SPACE = "\u2581"
#: Piece and model types of the file format (fixed values).
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = range(1, 7)
UNIGRAM, BPE = 1, 2


def _fields(data: bytes) -> Iterator[tuple[int, int, object]]:
    """``(field number, wire type, value)`` of a protobuf message."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        number, wire = tag >> 3, tag & 7
        if wire == 0:
            yield number, wire, varint()
        elif wire == 1:
            yield number, wire, data[at:at + 8]
            at += 8
        elif wire == 2:
            size = varint()
            yield number, wire, data[at:at + size]
            at += size
        elif wire == 5:
            yield number, wire, data[at:at + 4]
            at += 4
        else:
            raise ValueError(f"wire type {wire} in a model file")


@dataclass
class Model:
    """What a SentencePiece model file says."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    model_type: int = UNIGRAM
    byte_fallback: bool = False
    suffix_marker: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True

    def of_type(self, kind: int) -> list[str]:
        return [p for p, _, t in self.pieces if t == kind]


def parse_model(data: bytes) -> Model:
    model = Model()
    for number, _, value in _fields(data):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for n, _, v in _fields(value):
                if n == 1:
                    piece = v.decode()
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            model.pieces.append((piece, score, kind))
        elif number == 2:
            got = {n: v for n, _, v in _fields(value)}
            model.model_type = got.get(3, UNIGRAM)
            model.suffix_marker = bool(got.get(24, 0))
            model.byte_fallback = bool(got.get(35, 0))
        elif number == 3:
            got = {n: v for n, _, v in _fields(value)}
            model.charsmap = got.get(2, b"")
            model.dummy_prefix, model.squeeze, model.escape = (bool(got.get(n, 1)) for n in (3, 4, 5))
    return model


def merges_of(model: Model) -> list[tuple[str, str]]:
    """The pairs that make each piece, best score first; pairs of one piece by the scores of their parts."""
    score = {p: s for p, s, t in model.pieces if t in (NORMAL, USER_DEFINED, UNUSED)}
    ranked = []
    for order, (piece, s, kind) in enumerate(model.pieces):
        if kind not in (NORMAL, UNUSED):
            continue
        for cut in range(1, len(piece)):
            left, right = piece[:cut], piece[cut:]
            if left in score and right in score:
                ranked.append((-s, order, -score[left] - score[right], left, right))
    return [(left, right) for *_, left, right in sorted(ranked)]


def build(model: Model):
    """The tokenizer, or ValueError for a kind of model that the library can't express."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    if model.model_type not in (UNIGRAM, BPE) or model.suffix_marker or not model.escape:
        raise ValueError("only unigram and BPE models with a leading space marker are supported")
    unknown = next((k for k, (_, _, t) in enumerate(model.pieces) if t == UNKNOWN), None)
    if model.model_type == UNIGRAM:
        own = models.Unigram([(p, s) for p, s, _ in model.pieces], unk_id=unknown, byte_fallback=model.byte_fallback)
    else:
        own = models.BPE(vocab={p: k for k, (p, _, _) in enumerate(model.pieces)}, merges=merges_of(model),
                         unk_token=None if unknown is None else model.pieces[unknown][0], fuse_unk=True,
                         byte_fallback=model.byte_fallback)
    tokenizer = Tokenizer(own)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.squeeze:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(SPACE))
    tokenizer.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", SPACE)])
    inner = any(SPACE in p.lstrip(SPACE) for p, _, t in model.pieces if t in (NORMAL, USER_DEFINED))
    if not inner:  # no piece goes on past a marker: runs of markers with the word behind them are independent
        tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex(f"{SPACE}*[^{SPACE}]+|{SPACE}+"), "isolated")
    tokenizer.decoder = decoders.Sequence([decoders.Replace(SPACE, " "), decoders.ByteFallback(), decoders.Fuse()]
                                          + ([decoders.Strip(" ", 1, 0)] if model.dummy_prefix else []))
    special = [AddedToken(p, normalized=False) for p in model.of_type(USER_DEFINED)]
    if special:
        tokenizer.add_tokens(special)
    return tokenizer


#: Bytes that the words and ids known to a task may take, by estimate; half of them for each of two generations.
KEPT_BYTES = 64 << 20
#: What a known word costs beside its characters and ids (two objects and their place in a dict).
_PER_WORD = 210
#: Characters of text encoded at once, and new words given to the tokenizer at once.
_AT_ONCE, _NEW_AT_ONCE = 1 << 20, 10_000


class Codec:
    """Encodes and decodes texts with the rebuilt tokenizer and says where the sentencepiece library agrees.

    If the normaliser only marks spaces, with a marker before the text, and no piece goes on past a marker, the ids of a text
    are those of its words, so they are worked out once for each distinct word. Texts that hold the marker itself or
    other spaces than one between words, and other models, are encoded whole. Every text is given to the sentencepiece
    library whole; one whose words together give other ids is encoded whole, and these ids count.
    """

    def __init__(self, model: bytes):
        import sentencepiece

        self.model = parse_model(model)
        self.tokenizer = build(self.model)
        self.reference = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.by_word = not self.model.charsmap and not self.model.squeeze and self.model.dummy_prefix \
            and self.tokenizer.pre_tokenizer is not None and not self.model.of_type(USER_DEFINED)
        self.marked = np.array([p.startswith(SPACE) for p, _, _ in self.model.pieces])
        #: the bytes that each piece stands for, a byte piece for its byte
        self.shown = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-Fa-f]{2}>", p) else p.replace(SPACE, " ").encode()
                      for p, _, _ in self.model.pieces]
        #: ids of known words, as bytes: those met lately, and those of the generation before
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.size = 0

    def forget(self) -> None:
        """Drop the known words: a worker keeps nothing of a task's texts when the task is over."""
        self.known, self.before, self.size = {}, {}, 0

    def _make_room(self) -> None:
        """A full generation becomes the one before; a word of that one is kept only if it is met again."""
        if self.size > KEPT_BYTES // 2:
            self.known, self.before, self.size = {}, self.known, 0

    def _keep(self, found: list[tuple[str, bytes]]) -> None:
        self.known.update(found)
        self.size += sum(_PER_WORD + 2 * len(w) + len(i) for w, i in found)

    def _ready(self, words: set[str]) -> None:
        """See to it that all the words are known."""
        self._make_room()
        new = words.difference(self.known)
        again = new.intersection(self.before)
        self._keep([(w, self.before[w]) for w in again])
        new = list(new.difference(again))
        for lo in range(0, len(new), _NEW_AT_ONCE):
            self._learn(new[lo:lo + _NEW_AT_ONCE])

    def _learn(self, words: list[str], many: int = 500) -> None:
        """Work out new words, many to a line; if a line doesn't show where its words begin, they are encoded singly."""
        groups = [words[lo:lo + many] for lo in range(0, len(words), many)]
        lines = [" ".join(g) for g in groups]
        for group, line in zip(groups, self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)):
            # a word's first piece begins with the marker, and without a marker in the line no other does
            data = np.array(line.ids, "<u4")
            begins = np.flatnonzero(self.marked[data])
            if len(begins) != len(group):
                alone = self.tokenizer.encode_batch_fast(group, add_special_tokens=False)
                self._keep([(word, np.array(e.ids, "<u4").tobytes()) for word, e in zip(group, alone)])
                continue
            data = data.tobytes()
            edges = [*(4 * begins).tolist(), len(data)]
            self._keep(list(zip(group, map(data.__getitem__, map(slice, edges, edges[1:])))))

    def _gives_back(self, ids: list[int], text: str) -> bool:
        """Whether the ids decode to the text. Equal bytes say so: the pieces between byte pieces are whole characters, so each
        run of byte pieces is, too. If the bytes differ, the decoder says it."""
        start = " " if self.model.dummy_prefix else ""
        return b"".join(map(self.shown.__getitem__, ids)) == (start + text).encode() \
            or self.tokenizer.decode(ids, skip_special_tokens=False) == text

    def encode(self, texts: list[str]) -> list[tuple[bytes, bool, bool]]:
        """``(little-endian 32-bit ids, parity, round trip)`` of each text; about ``_AT_ONCE`` characters are worked on at once."""
        lo, out = 0, []
        while lo < len(texts):
            hi, size = lo, 0
            while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= _AT_ONCE):
                size += len(texts[hi])
                hi += 1
            out += self._encode(texts[lo:hi])
            lo = hi
        return out

    def _encode(self, texts: list[str]) -> list[tuple[bytes, bool, bool]]:
        split = [t.split(" ") if self.by_word and SPACE not in t else [""] for t in texts]
        split = [None if "" in w else w for w in split]
        self._ready(set(chain.from_iterable(w for w in split if w)))
        out = []
        for text, words in zip(texts, split):
            same = self.reference.encode(text)
            wanted = np.array(same, "<u4").tobytes()
            if words is not None and b"".join(map(self.known.__getitem__, words)) == wanted:
                out.append((wanted, True, self._gives_back(same, text)))
                continue
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            out.append((np.array(ids, "<u4").tobytes(), ids == same, self._gives_back(ids, text)))
        return out

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.tokenizer.decode_batch(ids, skip_special_tokens=False)


def _of_worker(model: bytes) -> Codec:
    """The worker's codec: building it takes longer than a small task, so a worker builds one for a model and keeps it."""
    held = worker_state().setdefault("sentencepiece", {})
    key = hashlib.sha256(model).digest()
    if key not in held:
        held.clear()
        held[key] = Codec(model)
    return held[key]


def _ship(spark, model_path: str):
    """The model's bytes, read once by the driver: executors need no file of that path. A model file is a few MB at most."""
    with open(model_path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def _encoded(docs: DataFrame, model_path: str, id_col: str, text_col: str, chunk: int, schema: str, columns) -> DataFrame:
    """Rows of ``columns(ids, results)`` for every row, where results are those of :meth:`Codec.encode`."""
    source = pick(docs, id_col, text_col).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    shared = _ship(docs.sparkSession, model_path)

    def run(batches):
        codec = _of_worker(shared.value)
        try:
            for whole in batches:
                for lo in range(0, whole.num_rows, chunk):
                    batch = whole.slice(lo, chunk)
                    yield columns(batch.column(0), codec.encode([t or "" for t in batch.column(1).to_pylist()]))
        finally:
            codec.forget()

    return source.mapInArrow(run, f"id {kind}, {schema}").withColumnRenamed("id", id_col)


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = 256) -> DataFrame:
    """``id_col, ids, parity, round_trip`` of every row; null and empty texts have no ids.

    ``parity``: the sentencepiece library gives the same ids; ``round_trip``: decoding the ids gives the text back. Repeated
    rows and null ids give a row each; an empty table gives none; extra columns are ignored.
    """
    def columns(row_ids, got):
        ids = np.frombuffer(b"".join(g[0] for g in got), "<u4").astype(np.int32)
        ends = np.cumsum([0, *[len(g[0]) // 4 for g in got]])
        return pa.RecordBatch.from_arrays(
            [row_ids, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids)),
             pa.array([g[1] for g in got], pa.bool_()), pa.array([g[2] for g in got], pa.bool_())],
            ["id", "ids", "parity", "round_trip"])

    return _encoded(docs, model_path, id_col, text_col, chunk, "ids array<int>, parity boolean, round_trip boolean", columns)


def decode(rows: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col, text`` for rows of ids; null ids decode to null, an empty list to the empty text.

    Repeated rows and null row ids give a row each; an empty table gives none; extra columns are ignored. A null or an
    unknown id within a list raises.
    """
    source = pick(rows, id_col, ids_col).select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    kind = source.schema["id"].dataType.simpleString()

    shared = _ship(rows.sparkSession, model_path)

    def run(batches):
        codec = _of_worker(shared.value)
        for batch in batches:
            lists = batch.column(1).to_pylist()
            texts = iter(codec.decode([x for x in lists if x is not None]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([None if x is None else next(texts) for x in lists], pa.string())], ["id", "text"])

    return source.mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)


def digest(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = 256) -> DataFrame:
    """``id_col, n_ids, ids_crc32, parity, round_trip`` of every row, as :func:`encode` with the ids as their count and CRC-32."""
    def columns(row_ids, got):
        return pa.RecordBatch.from_arrays(
            [row_ids, pa.array([len(g[0]) // 4 for g in got], pa.int64()), pa.array([zlib.crc32(g[0]) for g in got], pa.int64()),
             pa.array([g[1] for g in got], pa.bool_()), pa.array([g[2] for g in got], pa.bool_())],
            ["id", "n_ids", "ids_crc32", "parity", "round_trip"])

    return _encoded(docs, model_path, id_col, text_col, chunk,
                    "n_ids long, ids_crc32 long, parity boolean, round_trip boolean", columns)
