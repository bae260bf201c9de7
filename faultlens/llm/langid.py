"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Training reads only rows that are labelled and not held out:

1. document frequencies of hashed character 1- to 3-grams over *all* of them;
2. a bounded sample of at most about ``per_label`` documents of each label, whose
   sparse count vectors come to the driver (their size is bounded by ``BUCKETS``);
3. follow-the-regularised-leader (proximal, per-coordinate rates) with L1 and L2
   penalties on softmax gradients; the L1 part leaves most weights zero;
4. one temperature, fitted on a part of the sample kept from step 3.

A prediction reads the text alone.  In training and prediction alike, TF is a gram's count divided by the
Euclidean length of the text's counts, which are taken over the whole text, piece by piece.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

from faultlens.llm.common import pick

BUCKETS = 1 << 16
ORDERS = 3
UNDETERMINED = "und"
_MULTIPLIERS = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))
#: Code points handled at once, with an overlap of ORDERS - 1: bounds the memory of a very long text.
_PIECE = 1 << 20


def gram_buckets(text: str) -> Iterator[np.ndarray]:
    """Hash buckets of every 1- to 3-gram of the lower-cased text, in pieces."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    for lo in range(0, len(points), _PIECE):
        part = points[lo:lo + _PIECE + ORDERS - 1]
        own = min(_PIECE, len(points) - lo)
        mixed = np.zeros(len(part), np.uint32)
        for order in range(ORDERS):
            n = len(part) - order
            if n <= 0:
                break
            mixed = mixed[:n] * _MULTIPLIERS[1] + part[order:]
            code = (mixed + np.uint32(order)) * _MULTIPLIERS[0]
            code ^= code >> np.uint32(15)
            yield ((code * _MULTIPLIERS[2]) >> np.uint32(16))[:own].astype(np.int64)


def unit_tf(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of the text's grams, and their counts scaled to Euclidean length one."""
    whole = np.zeros(BUCKETS, np.int64)
    for buckets in gram_buckets(text):
        whole += np.bincount(buckets, minlength=BUCKETS)
    at = np.flatnonzero(whole)
    tf = whole[at].astype(np.float64)
    return at, (tf / np.sqrt(tf @ tf)).astype(np.float32)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass(frozen=True)
class LanguageModel:
    """``weights[bucket, label]`` with the IDF folded in, ``bias``, and the calibrated temperature."""

    labels: tuple[str, ...]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        """Label and calibrated probability; ``und`` with score 0 if the text is null or has no letter."""
        if not self.labels or not has_letter(text):
            return UNDETERMINED, 0.0
        at, tf = unit_tf(text)
        share = softmax((tf @ self.weights[at] + self.bias) / self.temperature)
        best = int(np.argmax(share))
        return self.labels[best], float(share[best])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def held_out(id_col: str = "doc_id", folds: int = 4, fold: int = 2) -> Column:
    """Whether crc32 of the id as text falls in the held-out fold (a null id does not)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))


def document_frequencies(texts: DataFrame) -> tuple[int, np.ndarray]:
    """Number of texts and, for each bucket, how many hold one of its grams; counted where the texts lie."""
    def run(batches):
        rows, df, seen = 0, np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, bool)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen[:] = False
                for buckets in gram_buckets(text):
                    seen[buckets] = True
                df += seen
                rows += 1
        if rows:
            at = np.flatnonzero(df)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(df[at], rows))], ["bucket", "n"])

    got = texts.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    rows = got.collect()  # one row for each of the fixed number of buckets, at most
    df = np.zeros(BUCKETS, np.int64)
    for r in rows:
        if r["bucket"] >= 0:
            df[r["bucket"]] = r["n"]
    return sum(r["n"] for r in rows if r["bucket"] < 0), df


def sample_vectors(labelled: DataFrame, per_label: int) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """``(label, buckets, TF)`` of about ``per_label`` documents of each label, chosen by a hash of id and text."""
    counts = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}
    if not counts:
        return []
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, per_label / n))])
    chance = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30)) / float(1 << 30)
    chosen = labelled.where(chance < F.element_at(share, F.col("label")))

    def run(batches):
        for batch in batches:
            for label, text in zip(batch.column("label").to_pylist(), batch.column("text").to_pylist()):
                if text:
                    at, tf = unit_tf(text)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([label]), pa.array([at.astype("<i4").tobytes()]), pa.array([tf.tobytes()])],
                        ["label", "at", "tf"])

    rows = chosen.select("label", "text").mapInArrow(run, "label string, at binary, tf binary").collect()
    rows.sort(key=lambda r: (r["label"], bytes(r["at"]), bytes(r["tf"])))  # the order of tasks must not matter
    return [(r["label"], np.frombuffer(r["at"], "<i4").astype(np.int64), np.frombuffer(r["tf"], np.float32)) for r in rows]


def ftrl(vectors: list, classes: np.ndarray, n_classes: int, epochs: int = 4, alpha: float = 0.3, beta: float = 1.0,
         l1: float = 2e-3, l2: float = 1e-4, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Proximal FTRL for softmax regression on sparse ``(buckets, values)``; returns weights and bias.

    The last coordinate is the bias, without penalty.
    """
    z = np.zeros((BUCKETS + 1, n_classes))
    n = np.zeros((BUCKETS + 1, n_classes))
    order = np.random.default_rng(seed)

    def solve(zz, nn, free=False):
        a, b = (0.0, 0.0) if free else (l1, l2)
        return np.where(np.abs(zz) <= a, 0.0, -(zz - np.sign(zz) * a) / ((beta + np.sqrt(nn)) / alpha + b))

    for _ in range(epochs):
        for k in order.permutation(len(vectors)):
            at, x = vectors[k]
            at, x = np.append(at, BUCKETS), np.append(x, 1.0)
            zz, nn = z[at], n[at]
            w = solve(zz, nn)
            w[-1] = solve(zz[-1], nn[-1], free=True)
            p = softmax(x @ w)
            p[classes[k]] -= 1.0
            g = x[:, None] * p[None, :]
            step = (np.sqrt(nn + g * g) - np.sqrt(nn)) / alpha
            z[at] += g - step * w
            n[at] += g * g
    w = solve(z, n)
    return w[:-1], solve(z[-1], n[-1], free=True)


def fit_temperature(logits: np.ndarray, classes: np.ndarray) -> float:
    """The temperature with the smallest log loss (a convex search over its logarithm).

    The true label's target is (n + 1) / (n + 2), as in Platt scaling: a sample without errors doesn't mean certainty.
    """
    n, k = logits.shape
    if not n or k < 2:
        return 1.0
    target = np.full((n, k), 1 / (n + 2) / (k - 1))
    target[np.arange(n), classes] = (n + 1) / (n + 2)

    def loss(t):
        return -(target * np.log(np.maximum(softmax(logits / np.exp(t)), 1e-12))).sum(axis=1).mean()

    lo, hi = np.log(0.05), np.log(20.0)
    for _ in range(60):
        a, b = lo + (hi - lo) * 0.382, lo + (hi - lo) * 0.618
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          per_label: int = 400, calibration_part: float = 0.25) -> LanguageModel:
    """Fit a model on the labelled rows that aren't held out.

    ``per_label`` bounds the expected sample of each label.  Without labelled
    text the model has no labels and predicts ``und`` for everything.
    """
    own = pick(docs, id_col, text_col, lang_col).where(~held_out(id_col)).select(
        F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("label"))
    own = own.where("text is not null and label is not null")
    rows, df = document_frequencies(own)
    sample = sample_vectors(own, per_label)
    labels = tuple(sorted({s[0] for s in sample}))
    if not labels:
        return LanguageModel((), np.zeros((BUCKETS, 0)), np.zeros(0), 1.0)
    idf = np.log((1.0 + rows) / (1.0 + df)) + 1.0
    classes = np.array([labels.index(s[0]) for s in sample])
    vectors = [(at, tf * idf[at]) for _, at, tf in sample]
    aside = np.arange(len(sample)) % max(2, round(1 / calibration_part)) == 1
    learn = np.flatnonzero(~aside)
    w, bias = ftrl([vectors[k] for k in learn], classes[learn], len(labels))
    weights = w * idf[:, None]
    held = np.flatnonzero(aside)
    logits = np.array([sample[k][2] @ weights[sample[k][1]] + bias for k in held]).reshape(len(held), len(labels))
    return LanguageModel(labels, weights.astype(np.float32), bias, fit_temperature(logits, classes[held]))


def _broadcast(docs: DataFrame, model: LanguageModel):
    """The model's parts, of a fixed size (buckets x labels)."""
    return docs.sparkSession.sparkContext.broadcast((model.labels, model.weights, model.bias, model.temperature))


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, held_out, lang_pred, score`` of every row, repeated rows included; an empty table gives no rows.

    Null, empty and letter-less texts are ``und`` with score 0.  Extra columns are ignored.
    """
    kind = docs.schema[id_col].dataType
    source = pick(docs, id_col, text_col).select(F.col(id_col).alias("id"), F.col(text_col).cast(StringType()).alias("text"),
                                                held_out(id_col).alias("held_out"))
    shared = _broadcast(docs, model)

    def run(batches):
        own = LanguageModel(*shared.value)
        for batch in batches:
            got = [own.predict(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([g[0] for g in got], pa.string()),
                 pa.array([g[1] for g in got], pa.float64())], ["id", "held_out", "lang_pred", "score"])

    return source.mapInArrow(run, f"id {kind.simpleString()}, held_out boolean, lang_pred string, score double") \
        .withColumnRenamed("id", id_col)


def accepted(docs: DataFrame, model: LanguageModel, min_score: float = 0.5, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all columns, whose text has a language predicted with at least ``min_score``."""
    names = docs.columns
    shared = _broadcast(docs, model)
    at = names.index(text_col)

    def run(batches):
        own = LanguageModel(*shared.value)
        for batch in batches:
            got = [own.predict(t.as_py()) for t in batch.column(at)]
            yield batch.filter(pa.array([lang != UNDETERMINED and score >= min_score for lang, score in got], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             per_label: int = 400) -> DataFrame:
    """Train on ``docs`` as :func:`train` does, then predict every row."""
    return predict(docs, train(docs, id_col, text_col, lang_col, per_label), id_col, text_col)
