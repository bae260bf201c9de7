"""Substring dedup with suffix automata of reference shards.

A window is ``window`` consecutive words of a document.  A word goes if a window over it also
starts in a document with a smaller id.

1. *Anchors.* The smallest hash of a window's ``GRAM``-word grams (leftmost of equals) is its anchor; the
   choice depends on the window's words alone, so equal windows have equal anchors. Consecutive windows with one
   anchor are a *region*, and only regions whose anchor occurs in several documents go on.
2. *Reference shards.* Distinct region texts, each with the smallest id that holds it, go to shards by anchor.
   Equal windows meet in one shard, so a document streams through one shard per region and not through all.
   An anchor with many different region texts (the edge of a very common passage) is first reduced
   to its windows that several documents share.
3. *Suffix automata.* A task gets a shard's references, builds their generalised suffix automaton with the smallest id of
   each state, and streams region texts for matching statistics: where the matched length reaches ``window``, the state
   of that suffix tells the smallest document of the window. A shard's automaton is sent once to each slice of its texts.
4. *Spans.* Windows with a smaller document give maximal spans, which are removed from the text.

All tables are keyed and shuffled by Spark; a task holds one shard of about ``SHARD_WORDS`` words and one slice.
Words are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from faultlens.llm.common import land, pick, settle

GRAM = 8
#: A region's first word is its place divided by this, its number of windows the remainder.
PLACE = 1 << 16
#: Reference words of a shard, and words that one slice streams.
SHARD_WORDS = 60_000
#: An anchor with more distinct region texts is reduced to its shared windows.
MANY = 64
#: Windows handled at once (bounds the position bits of an anchor in a very long text).
_STRIDE = 1 << 22
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD6E8FEB86659FD93)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))


def words_of(text: str | None) -> list[bytes]:
    """Words of the text as UTF-8 (bytes split at exactly the contract's white space)."""
    return (text or "").encode().split()


def codes_of(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _ODD
    return x ^ (x >> np.uint64(29))


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def span_hashes(codes: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """64-bit hashes of ``codes[start:stop]`` that don't depend on the place."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * _powers(len(codes), _BASE), dtype=np.uint64)])
    return _mix((sums[stops] - sums[starts]) * _powers(len(codes) + 1, _BACK)[starts] + (stops - starts).astype(np.uint64))


def regions(codes: np.ndarray, window: int, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """``(anchor, region, start, windows)`` of a document's regions; documents shorter than a window have none."""
    found = []
    for lo in range(0, len(codes) - window + 1, _STRIDE):
        part = codes[lo:lo + _STRIDE + window - 1]
        n = len(part) - gram + 1
        grams = np.zeros(n, np.uint64)
        for k in range(gram):
            grams = grams * _BASE + part[k:k + n]
        grams = _mix(grams)
        least = (grams & ~np.uint64((1 << 24) - 1)) | np.arange(n, dtype=np.uint64)
        size, want = 1, window - gram + 1
        while size * 2 <= want:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if size < want:
            least = np.minimum(least[:size - want], least[want - size:])
        at = (least & np.uint64((1 << 24) - 1)).astype(np.int64)
        starts = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
        counts = np.diff(np.append(starts, len(at)))
        found.append((grams[at[starts]], span_hashes(part, starts, starts + counts + window - 1), starts + lo, counts))
    if not found:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64))
    return tuple(np.concatenate(c) for c in zip(*found))


class Automaton:
    """Generalised suffix automaton of word sequences; every state knows the smallest id of a sequence that holds it."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.least = [-1], [0], [None]

    def _state(self, length: int, link: int, edges: dict) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        self.least.append(None)
        return len(self.next) - 1

    def _split(self, p: int, c: int) -> int:
        """The state reached from ``p`` by ``c`` with length ``length[p] + 1``, cloned if it isn't there."""
        nxt, link, length = self.next, self.link, self.length
        q = nxt[p][c]
        if length[q] == length[p] + 1:
            return q
        clone = self._state(length[p] + 1, link[q], nxt[q].copy())
        link[q] = clone
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = clone
            p = link[p]
        return clone

    def add(self, codes: list[int], ident: int) -> None:
        nxt, link, length, least = self.next, self.link, self.length, self.least
        last = 0
        for c in codes:
            if c in nxt[last]:
                last = self._split(last, c)
            else:
                new = self._state(length[last] + 1, 0, {})
                p = last
                while p >= 0 and c not in nxt[p]:
                    nxt[p][c] = new
                    p = link[p]
                if p >= 0:
                    link[new] = self._split(p, c)
                last = new
            if least[last] is None or ident < least[last]:
                least[last] = ident

    def finish(self) -> None:
        """Carry the smallest ids from longer states to their suffixes."""
        least, link = self.least, self.link
        for v in sorted(range(1, len(link)), key=self.length.__getitem__, reverse=True):
            up = link[v]
            if least[v] is not None and (least[up] is None or least[v] < least[up]):
                least[up] = least[v]

    def smallest(self, codes: list[int], window: int) -> list[int | None]:
        """For each window of the sequence, the smallest id whose sequence holds it (None: no sequence does)."""
        nxt, link, length, least = self.next, self.link, self.length, self.least
        v = size = 0
        out = []
        for i, c in enumerate(codes):
            while v and c not in nxt[v]:
                v = link[v]
                size = length[v]
            if c in nxt[v]:
                v = nxt[v][c]
                size += 1
            if size >= window:
                while length[link[v]] >= window:
                    v = link[v]
                size = window
                out.append(least[v])
            elif i >= window - 1:
                out.append(None)
        return out


def _scan(docs: DataFrame, window: int) -> DataFrame:
    """A row for each region, and one with a null anchor for each document: its digest, and its word count as ``place``.

    A region's ``place`` holds its first word and its number of windows in one long (fewer bytes to shuffle).
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            row, cols, digests, counts = [], [], [], []
            for k in range(batch.num_rows):
                words = words_of(batch.column(2)[k].as_py())
                counts.append(len(words))
                digests.append(hashlib.sha256(b" ".join(words)).digest())
                if ids[k] is not None and len(words) >= window:
                    anchor, region, start, windows = regions(codes_of(words), window)
                    cols.append((anchor.view(np.int64), region.view(np.int64), start * PLACE + windows))
                    row.append(np.full(len(anchor), k))
            everyone = len(counts)
            at = pa.array(np.concatenate([np.arange(everyone), *row]).astype(np.int64))
            flat = [np.concatenate([c[j] for c in cols] or [np.zeros(0, np.int64)]) for j in range(3)]
            none = pa.nulls(everyone, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.concat_arrays([none, pa.array(flat[0])]),
                 pa.concat_arrays([none, pa.array(flat[1])]), pa.concat_arrays([pa.array(counts, pa.int64()), pa.array(flat[2])]),
                 pa.concat_arrays([pa.array(digests, pa.binary()), pa.nulls(len(at) - everyone, pa.binary())])],
                ["id", "key", "anchor", "region", "place", "digest"])

    return docs.mapInArrow(run, "id long, key long, anchor long, region long, place long, digest binary")


def _contents(docs: DataFrame, listed: DataFrame, window: int) -> DataFrame:
    """The texts of the documents in ``listed(id, key, own)``, and the word codes of each one's own regions.

    A row has either a text or a region's ``anchor, region, low, high, many, words``.
    """
    def run(batches):
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), *[pa.nulls(n, pa.int64())] * 4, pa.nulls(n, pa.bool_()),
                 pa.nulls(n, pa.binary())], heading)
            for k in range(n):
                if not batch.column(3)[k].is_valid:
                    continue
                own = batch.column(3)[k].values
                codes = codes_of(words_of(batch.column(2)[k].as_py()))
                starts, windows = np.divmod(own.field("place").to_numpy(), PLACE)
                stops = starts + windows + window - 1
                data = [codes[a:b].tobytes() for a, b in zip(starts.tolist(), stops.tolist())]
                m = len(data)
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.string()), own.field("anchor"), own.field("region"),
                     own.field("low"), own.field("high"), own.field("many"), pa.array(data, pa.binary())], heading)

    names = ("id long", "key long", "text string", "anchor long", "region long", "low long", "high long", "many boolean", "words binary")
    heading = [x.split()[0] for x in names]
    return docs.join(listed, ["id", "key"]).select("id", "key", "text", "own").mapInArrow(run, ", ".join(names))


def _shared_windows(contents: DataFrame, window: int) -> DataFrame:
    """Of anchors with many region texts: the windows that several documents hold, as contents of one window each."""
    def run(batches):
        for batch in batches:
            for anchor, region, low, high, words in zip(*[batch.column(k).to_pylist() for k in range(5)]):
                codes = np.frombuffer(words, np.uint64)
                starts = np.arange(len(codes) - window + 1)
                hashes = span_hashes(codes, starts, starts + window)
                n = len(starts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, v)) for v in (anchor, region, low, high)]
                    + [pa.array(hashes.view(np.int64)), pa.array(starts.astype(np.int32))],
                    ["anchor", "region", "low", "high", "hash", "first"])

    rows = contents.select("anchor", "region", "low", "high", "words").mapInArrow(
        run, "anchor long, region long, low long, high long, hash long, first int")
    shared = rows.groupBy("anchor", "hash").agg(F.min("low").alias("low"), F.max("high").alias("high"),
                                                F.min(F.struct("region", "first")).alias("one")).where("low < high")
    texts = contents.select("anchor", "region", "words")
    return (shared.select("anchor", F.col("one.region").alias("region"), F.col("one.first").alias("first"), "low")
            .join(texts, ["anchor", "region"])
            .select("anchor", "region", "low", F.expr(f"substring(words, first * 8 + 1, {8 * window})").alias("words")))


#: What a row is to a shard's automaton: a reference, a reference whose own windows are asked for too, or only asked.
_TOLD, _BOTH, _ASKED = range(3)


def _smallest(contents: DataFrame, window: int) -> DataFrame:
    """``(anchor, region, firsts)``: for each window of each region, the smallest id that holds it."""
    spark = contents.sparkSession
    extra = settle(_shared_windows(contents.where("many"), window))
    total = contents.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    shards = max(1, total // (8 * SHARD_WORDS))
    shard = F.pmod(F.xxhash64("anchor"), F.lit(shards)).alias("shard")
    slices = settle(contents.groupBy(shard).agg(
        F.ceil(F.sum(F.octet_length("words")) / (8 * 4 * SHARD_WORDS)).cast("int").alias("slices")))
    rows = contents.select(shard, "anchor", "region", "low", "words", F.when(F.col("many"), _ASKED).otherwise(_BOTH).alias("role"))
    rows = rows.unionByName(extra.select(shard, "anchor", "region", "low", "words", F.lit(_TOLD).alias("role"))).join(slices, "shard")
    # each slice needs all references of its shard and its own part of the rows that are asked for
    rows = rows.withColumn("own", F.pmod(F.xxhash64("region"), F.col("slices")).cast("int"))
    rows = rows.withColumn("slice", F.explode(F.when(F.col("role") == _ASKED, F.array("own")).otherwise(F.expr("sequence(0, slices - 1)"))))
    rows = rows.withColumn("role", F.when((F.col("role") == _BOTH) & (F.col("slice") != F.col("own")), _TOLD).otherwise(F.col("role")))

    def run(batches):
        now, automaton, waiting, ready = None, None, [], False

        def answers():
            nonlocal waiting, ready
            if waiting or not ready:
                if not ready:
                    automaton.finish()
                    ready = True
                done = [(a, r, automaton.smallest(c, window)) for a, r, c in waiting]
                waiting = []
                return done
            return []

        def table(out):
            return pa.RecordBatch.from_arrays(
                [pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()),
                 pa.array([o[2] for o in out], pa.list_(pa.int64()))], ["anchor", "region", "firsts"])

        for batch in batches:
            out = []
            for shard, piece, role, anchor, region, low, words in zip(*[batch.column(k).to_pylist() for k in range(7)]):
                if (shard, piece) != now:
                    if automaton is not None:
                        out += answers()
                    now, automaton, waiting, ready = (shard, piece), Automaton(), [], False
                codes = np.frombuffer(words, np.uint64).tolist()
                if role != _ASKED:
                    automaton.add(codes, low)
                if role != _TOLD:
                    waiting.append((anchor, region, codes))
                if role == _ASKED:
                    out += answers()
            yield table(out)
        if automaton is not None:
            yield table(answers())

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return (rows.select("shard", "slice", "role", "anchor", "region", "low", "words").repartition(parts, "shard", "slice")
            .sortWithinPartitions("shard", "slice", "role").mapInArrow(run, "anchor long, region long, firsts array<long>"))


def _removed(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """``(id, key, gone, rest)`` of documents that lose words; ``spans(id, key, span)`` has half-open word spans."""
    def run(batches):
        for batch in batches:
            counts, digests = [], []
            for text, spans_of in zip(batch.column(2), batch.column(3)):
                words = words_of(text.as_py())
                edge = np.zeros(len(words) + 1, np.int64)
                own = spans_of.values
                np.add.at(edge, own.field("start").to_numpy(), 1)
                np.add.at(edge, own.field("stop").to_numpy(), -1)
                keep = np.cumsum(edge[:-1]) == 0
                counts.append(int((~keep).sum()))
                digests.append(hashlib.sha256(b" ".join([words[k] for k in np.flatnonzero(keep).tolist()])).digest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(digests, pa.binary())],
                ["id", "key", "gone", "rest"])

    listed = spans.groupBy("id", "key").agg(F.collect_list("span").alias("spans"))
    return texts.join(listed, ["id", "key"]).select("id", "key", "text", "spans").mapInArrow(
        run, "id long, key long, gone long, rest binary")


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50) -> DataFrame:
    """One row per input row: ``id_col, n_words, n_removed, kept_sha256``.

    Words are runs of characters other than space and tab to carriage return. Null, empty and short texts lose nothing.
    Ids must be integers; a row without id neither loses words nor takes them from others, and rows that repeat
    an id don't take words from each other. An empty table gives no rows; extra columns are ignored.
    """
    if not GRAM <= window < PLACE:
        raise ValueError(f"a window has {GRAM} to {PLACE - 1} words")
    own = pick(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    own = own.select("id", F.xxhash64("id", "text").alias("key"), "text")
    scan = land(_scan(own, window), "substring-scan")
    anchors = scan.where("anchor is not null").drop("digest")
    shared = anchors.groupBy("anchor").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b").select("anchor")
    # settled, so that the join has a plain exchange on both sides and Spark can split a very common anchor
    found = land(anchors.join(settle(shared), "anchor"), "substring-shared")

    distinct = found.groupBy("anchor", "region").agg(F.min(F.struct("id", "key", "place")).alias("one"), F.max("id").alias("high"))
    distinct = settle(distinct.select("anchor", "region", "one.*", "high"))
    busy = distinct.groupBy("anchor").agg(F.count("*").alias("n")).where(f"n > {MANY}").select("anchor", F.lit(True).alias("many"))
    chosen = distinct.join(settle(busy), "anchor", "left").groupBy("id", "key").agg(F.collect_list(F.struct(
        "anchor", "region", "place", F.col("id").alias("low"), "high", F.coalesce("many", F.lit(False)).alias("many"))).alias("own"))
    listed = found.select("id", "key").distinct().join(chosen, ["id", "key"], "left")
    both = land(_contents(own, listed, window), "substring-texts")
    firsts = settle(_smallest(both.where("anchor is not null").drop("id", "key", "text"), window))

    # the runs of windows that have a smaller document, as word spans
    flags = found.join(firsts, ["anchor", "region"]).where("array_min(firsts) < id").select(
        "id", "key", F.expr(f"place div {PLACE}").alias("start"), F.expr("transform(firsts, f -> coalesce(f < id, false))").alias("flags"))
    heads = flags.select(
        "id", "key", "start", "flags",
        F.expr("filter(sequence(0, size(flags) - 1), i -> flags[i] and (i = 0 or not flags[i - 1]))").alias("heads"))
    hits = heads.select("id", "key", F.expr(
        "transform(heads, i -> struct(start + i as start, start + i + "
        "coalesce(nullif(array_position(slice(flags, i + 1, size(flags)), false), 0) - 1, size(flags) - i) "
        f"+ {window - 1} as stop))").alias("spans"))
    spans = hits.select("id", "key", F.explode("spans").alias("span"))
    changed = _removed(both.where("text is not null").select("id", "key", "text"), spans).dropDuplicates(["id", "key"])
    every = scan.where("anchor is null").select("id", "key", F.col("place").alias("n_words"), "digest")
    joined = every.join(changed, ["id", "key"], "left")
    return joined.select(
        F.col("id").alias(id_col), "n_words", F.coalesce("gone", F.lit(0)).cast("long").alias("n_removed"),
        F.lower(F.hex(F.coalesce("rest", "digest"))).alias("kept_sha256"))
