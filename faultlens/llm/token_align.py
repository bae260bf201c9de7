"""Cross-tokenizer alignment: groups of tokens with common ends, and how often token pairs are linked over a whole corpus.

Both tokenizers cut the same bytes. Where tokens of both end, a group ends, and the last token of each is a link.

* First pass: tasks count the units of their documents, align each, and give their distinct (A id, B id) pairs with counts.
* The distinct pairs are dealt to shards by a hash; each shard gets a minimal perfect hash and the list of its keys in the
  order of their numbers. Leaves (some tasks' pairs of one shard) become dense count vectors indexed by that number, with
  the key at each number compared; vectors are summed up a tree, eight to a node.
* Second pass: tasks align their documents again and look the counts up by the hash, comparing keys.

Pairs beyond ``table_keys`` are not broadcast: the more frequent ones are, and the rest, which are rare by
that choice, are joined, so no key of that join is hot.

White space cuts a text into units (a run of it with the visible characters behind). No token of A or B goes on into the
next unit, so equal units of many texts are aligned once; texts with rarer white space are aligned as a whole.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from faultlens.llm.common import pick, settle, worker_state
from faultlens.llm.mphf import Mphf, mix
from faultlens.llm.packing import octets, ranked
from faultlens.llm.sentencepiece_codec import BYTE, USER_DEFINED, parse_model

MARK = "▁"
_UNIT = re.compile(r"[ \t\n]+[^ \t\n]*")
#: White space by which units could not be told apart safely: rare kinds, and the carriage return, which pieces end in.
_RARE = re.compile("[\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Characters whose units are aligned together, and distinct units that a task counts before it aligns them.
_AT_ONCE, _UNITS = 1 << 23, 500_000
#: Keys of a shard, rows of a leaf, and vectors summed by a node.
SHARD_KEYS, LEAF_ROWS, FAN_IN = 1 << 18, 1 << 19, 8
_BUCKETS = 1 << 16


def buckets(pairs: np.ndarray) -> np.ndarray:
    """A hash of each pair, from 0 to 65535, that deals pairs to shards."""
    return (mix(pairs, 1000) >> np.uint64(48)).astype(np.int32)


@dataclass
class Aligned:
    """Units in the order of ``place``: token and group numbers, and the links of all their groups one after the other."""

    place: dict[str, int]
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    #: ``A id << 32 | B id`` of each group's last tokens
    pairs: np.ndarray
    #: whether the tokens don't give the unit's bytes back (it has no tokens then)
    bad: np.ndarray
    shown: list[str]


class Aligner:
    """Both tokenizers and the alignment of units of text."""

    def __init__(self, bpe: str, pieces: bytes):
        import sentencepiece

        whole = json.loads(bpe)
        self.a = ranked(whole, {t["content"] for t in whole.get("added_tokens", [])})
        if self.a is None:
            raise ValueError("only byte-level BPE files with merges in id order are supported as A")
        self.b = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        shown = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(shown)]
        self.a_size, self.b_size = (np.array(list(map(len, x)), np.int64) for x in (octets(whole), self.b_bytes))
        model = parse_model(pieces)
        # units are independent if the normaliser only marks spaces, every byte has a piece, and no piece goes on from a
        # visible character to white space
        self.by_unit = (not model.charsmap and not model.squeeze and model.dummy_prefix and not model.of_type(USER_DEFINED)
                        and len(set(model.of_type(BYTE))) == 256
                        and not any(re.search(rf"[^ \t\n{MARK}][ \t\n{MARK}]", p) for p in shown))

    def units(self, text: str) -> list[str]:
        """The units of a text; none if it has no tokens by rule (empty, or the marker in it would change its bytes)."""
        if not text or MARK in text:
            return []
        text = " " + text
        return _UNIT.findall(text) if self.by_unit and not _RARE.search(text) else [text]

    def _encode(self, text: str) -> tuple | None:
        """``(A ids, B ids, A ends, B ends)`` of a text that begins with a space; None if bytes differ."""
        a = self.a.encode_to_numpy(text, disallowed_special=()).astype(np.int64)
        b = np.array(self.b.encode(text[1:]), np.int64)
        data = text.encode()
        a_end, b_end = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        # A merges the text's own bytes, so its length says all; B marks spaces and may change bytes
        if not len(b) or a_end[-1] != len(data) or b"".join(map(self.b_bytes.__getitem__, b.tolist())) != data:
            return None
        return a, b, a_end, b_end

    def align(self, units: list[str], strings: bool = False) -> Aligned:
        """Distinct units, each as it is cut in any text that holds it."""
        # a unit that is white space alone, or a whole text, is aligned alone; the others in a line of them
        together = [u for u in units if u[-1] not in " \t\n" and not _RARE.search(u)] if self.by_unit else []
        known = set(together)
        alone = [u for u in units if u not in known]
        parts = []
        for line in _lines(together):
            got = self._encode(" x" + "".join(line))
            if got is None:
                raise ValueError("a unit's tokens don't give its bytes back")
            parts.append(self._cut(line, 2, *got, strings))
        for unit in alone:
            skip = 2 if self.by_unit and not _RARE.search(unit) else 0
            got = self._encode(" x"[:skip] + unit)
            none = np.zeros(1, np.int64)
            parts.append((none, none, none, none[:0], np.ones(1, bool), [""]) if got is None else self._cut([unit], skip, *got, strings))
        place = dict(zip(together + alone, range(len(units))))
        if not parts:
            none = np.zeros(0, np.int64)
            return Aligned(place, none, none, none, none, none.astype(bool), [])
        *arrays, shown = zip(*parts)
        return Aligned(place, *map(np.concatenate, arrays), list(chain.from_iterable(shown)))

    def _cut(self, units, skip, a, b, a_end, b_end, strings) -> tuple:
        """The fields of :class:`Aligned` for units that stand one after the other behind ``skip`` bytes."""
        ends = np.concatenate(([skip], skip + np.cumsum(list(map(len, map(str.encode, units))))))
        at = np.minimum(np.searchsorted(b_end, a_end), len(b_end) - 1)
        last_a = np.flatnonzero(b_end[at] == a_end)
        last_b = at[last_a]
        common = np.concatenate(([0], a_end[last_a]))
        group = np.searchsorted(common, ends)
        if group[-1] >= len(common) or not np.array_equal(common[group], ends):
            raise ValueError("a unit doesn't end with tokens of both")
        first_a, first_b = np.concatenate(([0], last_a + 1)), np.concatenate(([0], last_b + 1))
        shown = [""] * len(units)
        if strings:
            sa, sb = list(map(str, a.tolist())), list(map(str, b.tolist()))
            fa, fb, g = first_a.tolist(), first_b.tolist(), group.tolist()
            groups = [",".join(sa[i:j]) + "|" + ",".join(sb[k:m]) for i, j, k, m in zip(fa, fa[1:], fb, fb[1:])]
            shown = [";".join(groups[lo:hi]) for lo, hi in zip(g, g[1:])]
        pairs = (a[last_a] << 32 | b[last_b])[group[0]:]
        return (np.diff(first_a[group]), np.diff(first_b[group]), np.diff(group), pairs, np.zeros(len(units), bool), shown)


def _lines(units: list[str]):
    """The units in lists of about a million characters."""
    lo = size = 0
    for hi, unit in enumerate(units):
        size += len(unit)
        if size > 1 << 20:
            yield units[lo:hi + 1]
            lo, size = hi + 1, 0
    if lo < len(units):
        yield units[lo:]


def _of_worker(bpe: str, pieces: bytes) -> Aligner:
    held = worker_state().setdefault("token_align", {})
    key = hashlib.sha256(bpe.encode() + pieces).digest()
    if key not in held:
        held.clear()
        held[key] = Aligner(bpe, pieces)
    return held[key]


def _slices(batches, limit: int):
    """``(ids, texts)`` of at most about ``limit`` characters (or one text)."""
    for whole in batches:
        texts = [t or "" for t in whole.column(1).to_pylist()]
        lo = 0
        while lo < len(texts):
            hi, size = lo, 0
            while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= limit):
                size += len(texts[hi])
                hi += 1
            yield whole.column(0).slice(lo, hi - lo), texts[lo:hi]
            lo = hi


def pair_counts(source: DataFrame, shared) -> DataFrame:
    """``(bucket, pair, n, leaf)``: the counts of each task's distinct pairs; ``pair`` is ``A id << 32 | B id``."""

    def run(batches):
        aligner, leaf = _of_worker(*shared.value), TaskContext.get().partitionId()
        kept, weights, size, times = [], [], 0, Counter()

        def add(units: list[str], n: list[int]):
            nonlocal size
            got = aligner.align(units)
            order = np.fromiter(map(got.place.__getitem__, units), np.int64, len(units))
            each = np.empty(len(units), np.int64)
            each[order] = n
            kept.append(got.pairs)
            weights.append(np.repeat(each, got.n_groups))
            size += len(got.pairs)

        def merged():
            pairs, at = np.unique(np.concatenate(kept), return_inverse=True)
            # counts are whole numbers below 2^53, so summing them as doubles is exact
            return pairs, np.bincount(at, np.concatenate(weights).astype(np.float64), len(pairs)).astype(np.int64)

        def rows(pairs, n):
            for lo in range(0, len(pairs), 1 << 16):
                p = pairs[lo:lo + (1 << 16)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(buckets(p)), pa.array(p), pa.array(n[lo:lo + (1 << 16)]), pa.array(np.full(len(p), leaf, np.int32))],
                    ["bucket", "pair", "n", "leaf"])

        for _, texts in _slices(batches, 1 << 20):
            for text in texts:
                units = aligner.units(text)
                if len(units) > 1:
                    times.update(units)
                elif units:
                    add(units, [1])
            if len(times) > _UNITS:
                add(list(times), list(times.values()))
                times.clear()
            if size > 1 << 21:
                pairs, n = merged()
                kept, weights, size = [pairs], [n], len(pairs)
                if size > 1 << 20:
                    yield from rows(pairs, n)
                    kept, weights, size = [], [], 0
        add(list(times), list(times.values()))
        yield from rows(*merged())

    return source.mapInArrow(run, "bucket int, pair long, n long, leaf int")


def count_tables(partial: DataFrame) -> tuple[DataFrame, int]:
    """``(shard, hash, keys, counts)`` for every shard, and the number of distinct pairs."""
    distinct = settle(partial.select("bucket", "pair").distinct())
    size = distinct.count()
    shards = min(max(1, -(-size // SHARD_KEYS)), _BUCKETS)
    shard = F.expr(f"cast(bucket * {shards}L div {_BUCKETS} as int)")

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        keys = frame["pair"].to_numpy(np.int64)
        function = Mphf.build(keys)
        ordered = np.empty_like(keys)
        ordered[function.numbers(keys)] = keys
        return pd.DataFrame({"shard": [int(frame["shard"].iloc[0])], "hash": [function.pack()], "keys": [ordered.tobytes()]})

    tables = settle(distinct.select(shard.alias("shard"), "pair").groupBy("shard")
                    .applyInPandas(build, "shard int, hash binary, keys binary"))
    rows = partial.count()
    runs = max(1, -(-rows // (shards * LEAF_ROWS)))

    def vector(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        function, keys = Mphf.unpack(right["hash"].iloc[0]), np.frombuffer(right["keys"].iloc[0], np.int64)
        pairs = left["pair"].to_numpy(np.int64)
        at = function.numbers(pairs)
        if len(at) and (at.min() < 0 or not np.array_equal(keys[at], pairs)):
            raise ValueError("a pair is not where its hash says")
        counts = np.zeros(len(keys), np.int64)
        np.add.at(counts, at, left["n"].to_numpy(np.int64))
        return pd.DataFrame({"shard": right["shard"], "run": right["run"], "counts": [counts.tobytes()]})

    each = tables.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))))
    vectors = (partial.select(shard.alias("shard"), F.expr(f"cast(pmod(leaf, {runs}) as int)").alias("run"), "pair", "n")
               .groupBy("shard", "run").cogroup(each.groupBy("shard", "run"))
               .applyInPandas(vector, "shard int, run int, counts binary"))

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(c, np.int64) for c in frame["counts"])
        return pd.DataFrame({"shard": frame["shard"].iloc[:1], "run": frame["run"].iloc[:1], "counts": [total.tobytes()]})

    while runs > 1:
        vectors = (settle(vectors).withColumn("run", F.expr(f"cast(run div {FAN_IN} as int)")).groupBy("shard", "run")
                   .applyInPandas(add, "shard int, run int, counts binary"))
        runs = -(-runs // FAN_IN)
    return settle(tables.join(vectors.drop("run"), "shard")), size


def _opened(tables: DataFrame, top: dict[int, int] | None = None) -> DataFrame:
    """``(bucket, pair, n, top)`` of the tables; ``top``: the count is the highest of its B id."""

    def run(batches):
        highest = _highest(top) if top is not None else None
        for batch in batches:
            for keys, counts in zip(batch.column("keys"), batch.column("counts")):
                keys, counts = (np.frombuffer(x.as_py(), np.int64) for x in (keys, counts))
                best = counts == highest[keys & 0xFFFFFFFF] if highest is not None else np.zeros(len(keys), bool)
                for lo in range(0, len(keys), 1 << 16):
                    p = keys[lo:lo + (1 << 16)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(buckets(p)), pa.array(p), pa.array(counts[lo:lo + (1 << 16)]), pa.array(best[lo:lo + (1 << 16)])],
                        ["bucket", "pair", "n", "top"])

    return tables.select("keys", "counts").mapInArrow(run, "bucket int, pair long, n long, top boolean")


def _highest(top: dict[int, int]) -> np.ndarray:
    out = np.zeros(max(top, default=0) + 1, np.int64)
    out[list(top)] = list(top.values())
    return out


class Lookup:
    """Counts of the broadcast pairs: ``tables`` holds ``(hash, keys, counts)`` of each shard in order of the shards."""

    def __init__(self, tables: list[tuple[bytes, bytes, bytes]], top: dict[int, int]):
        self.tables = [(Mphf.unpack(h), np.frombuffer(k, np.int64), np.frombuffer(c, np.int64)) for h, k, c in tables]
        self.highest = _highest(top)

    def __call__(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        count, known = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), bool)
        shard = buckets(pairs).astype(np.int64) * len(self.tables) // _BUCKETS if self.tables else np.zeros(0, np.int64)
        for k, (function, keys, counts) in enumerate(self.tables):
            mine = np.flatnonzero(shard == k)
            if not len(mine) or not len(keys):
                continue
            at = function.numbers(pairs[mine])
            same = (at >= 0) & (keys[at] == pairs[mine])
            known[mine] = same
            count[mine[same]] = counts[at[same]]
        return count, count == self.highest[np.minimum(pairs & 0xFFFFFFFF, len(self.highest) - 1)], known


def _frequent(counted: DataFrame, limit: int) -> int:
    """The smallest power of two so that at most ``limit`` pairs occur that often (one row for each power)."""
    sizes = counted.groupBy(F.floor(F.log2("n")).cast("int").alias("power")).agg(F.count("*").alias("k")).collect()
    total, least = 0, 63
    for power, k in sorted(((r["power"], r["k"]) for r in sizes), reverse=True):
        total += k
        if total > limit:
            break
        least = power
    return 1 << least


def align(docs: DataFrame, bpe_path: str, pieces_path: str, id_col: str = "doc_id", text_col: str = "text",
          table_keys: int = 2_000_000) -> DataFrame:
    """One row per row of ``docs``: ``id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.

    Null and empty texts, and texts whose tokens don't give their bytes back (a U+2581 in it becomes a space), have zeros and
    the empty string. Repeated rows and null ids give a row each, and their links count; an empty table gives no rows;
    extra columns are ignored. At most ``table_keys`` pairs (17 bytes each) are broadcast.
    """
    source = pick(docs, id_col, text_col).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    with open(bpe_path, encoding="utf-8") as f, open(pieces_path, "rb") as g:
        shared = docs.sparkSession.sparkContext.broadcast((f.read(), g.read()))
    tables, size = count_tables(settle(pair_counts(source, shared)))
    # at most one row for each piece of the second tokenizer
    top = {r["b"]: r["n"] for r in _opened(tables).groupBy(F.expr("pair & 4294967295").alias("b")).agg(F.max("n").alias("n")).collect()}
    rare = None
    if size > table_keys:
        counted = settle(_opened(tables, top))
        least = _frequent(counted, table_keys)
        rare = counted.where(F.col("n") < least).select("pair", "n", "top")
        tables, _ = count_tables(counted.where(F.col("n") >= least).select("bucket", "pair", "n", F.lit(0).alias("leaf")))
    held = [(bytes(r["hash"]), bytes(r["keys"]), bytes(r["counts"]))
            for r in tables.orderBy("shard").select("hash", "keys", "counts").collect()]
    table = docs.sparkSession.sparkContext.broadcast((held, top))
    partial_table = rare is not None

    def run(batches):
        aligner, looked_up = _of_worker(*shared.value), Lookup(*table.value)
        for ids, texts in _slices(batches, _AT_ONCE):
            cut = list(map(aligner.units, texts))
            got = aligner.align(list(set(chain.from_iterable(cut))), True)
            count, top, known = looked_up(got.pairs)
            edges = np.concatenate(([0], np.cumsum(got.n_groups)))
            best, total = (np.diff(np.concatenate(([0], np.cumsum(x * known)))[edges]) for x in (top, count))
            fields = np.column_stack((got.n_a, got.n_b, got.n_groups, best, total, got.bad))
            place = np.fromiter(map(got.place.__getitem__, chain.from_iterable(cut)), np.int64)
            ends = np.cumsum([0, *map(len, cut)])
            sums = np.concatenate((np.zeros((1, 6), np.int64), np.cumsum(fields[place], axis=0)))
            sums = sums[ends[1:]] - sums[ends[:-1]]
            fine = (sums[:, 5] == 0) & (np.diff(ends) > 0)
            sums[~fine] = 0
            at, sha, cold = place.tolist(), [], []
            for ok, lo, hi in zip(fine.tolist(), ends.tolist(), ends[1:].tolist()):
                sha.append(hashlib.sha256(";".join(map(got.shown.__getitem__, at[lo:hi])).encode()).hexdigest() if ok else "")
                unknown = {}
                if partial_table and ok:
                    own = np.concatenate([got.pairs[edges[k]:edges[k + 1]][~known[edges[k]:edges[k + 1]]] for k in at[lo:hi]])
                    unknown = dict(zip(*(x.tolist() for x in np.unique(own, return_counts=True))))
                cold.append([{"pair": x, "times": n} for x, n in unknown.items()])
            n_a, n_b, n_groups, n_best, count_sum = (pa.array(sums[:, k]) for k in range(5))
            yield pa.RecordBatch.from_arrays(
                [ids, n_a, n_b, n_groups, n_groups, n_best, count_sum, pa.array(sha, pa.string()),
                 pa.array(cold, pa.list_(pa.struct([("pair", pa.int64()), ("times", pa.int64())])))],
                ["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "cold"])

    columns = "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    rows = source.mapInArrow(run, f"id {kind}, {columns}, cold array<struct<pair:long,times:long>>")
    if partial_table:
        rows = settle(rows.withColumn("row", F.monotonically_increasing_id()))
        asked = rows.select("row", F.inline("cold"))
        told = asked.join(rare, "pair").groupBy("row").agg(
            F.sum(F.col("times") * F.col("n")).alias("more"), F.sum(F.when(F.col("top"), F.col("times"))).alias("tops"))
        rows = rows.join(told, "row", "left").withColumns({
            "count_sum": F.col("count_sum") + F.coalesce("more", F.lit(0)), "n_best": F.col("n_best") + F.coalesce("tops", F.lit(0))})
    return rows.select("id", *[c.split()[0] for c in columns.split(", ")]).withColumnRenamed("id", id_col)
