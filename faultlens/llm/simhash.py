"""SimHash near-dedup: fingerprints, bit-sliced distance search and components.

Fingerprints within ``radius`` bits agree exactly on at least ``blocks - radius`` of
``blocks`` bit blocks, so every such pair meets under one key made of
``blocks - radius`` blocks.  Under a key the fingerprints' bit planes are stored
vertically, 64 lanes to a word; distances of many lanes grow together in
carry-save counters, plane by plane, and a block of lanes is abandoned once
all its counters have passed the radius.

Only distinct fingerprints are compared, and a task returns the links of each
fingerprint to the smallest one of its local group, never all pairs.  A key
with more than ``slice_rows`` fingerprints is cut into slices; each two
slices meet in their own task, so a task holds at most two slices.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from faultlens.llm.common import pick, settle, unused
from faultlens.llm.components import connected_components

ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Planes between two looks at whether every lane is out of reach.
LOOK = 8
#: Runs up to this many lanes are compared together, by shifts of the shared planes.
SHORT = 64
#: One side of a block in a long run's comparison, in lanes.
TILE = 512
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """Unsigned SimHash of one text; without words it is 0."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    size = min(shingle, len(words))
    stops = ends[size - 1:].tolist()
    starts = [0, *(ends[:len(words) - size] + 1).tolist()]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, map(joined.__getitem__, map(slice, starts, stops)), repeat(seed)),
                         np.uint64, len(stops))
    octets = hashes.view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(octets[:, k], minlength=256) @ _BITS for k in range(8)])
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """``(id, fp)`` of every row; ``fp`` is the fingerprint as a signed long."""
    source = pick(docs, id_col, text_col).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [fingerprint(t.as_py(), shingle) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.array(got, np.uint64).view(np.int64))], ["id", "fp"])

    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, fp long")


def _masks(blocks: int, radius: int) -> list[int]:
    """One signed 64-bit mask for each choice of blocks that must agree."""
    edges = np.linspace(0, 64, blocks + 1).astype(int)
    parts = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(edges, edges[1:])]
    masks = [sum(c) for c in combinations(parts, blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _planes(fps: np.ndarray) -> np.ndarray:
    """64 bit planes of the fingerprints, 64 lanes to a word, with a spare word at the end."""
    bits = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    lanes = np.zeros((64, (len(fps) // 64 + 2) * 64), np.uint8)
    lanes[:, :len(fps)] = bits.T
    return np.packbits(lanes, axis=1, bitorder="little").view(np.uint64)


def _within(differ, shape: tuple, out: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose planes differ in at most ``radius`` places; ``out`` marks lanes that don't count.

    ``differ(j)`` gives the words of plane ``j`` that differ.  Counters are vertical:
    word ``k`` holds bit ``k`` of the distance of each lane, and a lane whose
    counter would pass ``radius`` is set in ``out`` for good.
    """
    width = radius.bit_length()
    counts = [np.zeros(shape, np.uint64) for _ in range(width)]
    for j in range(64):
        carry = differ(j)
        for k in range(width):
            counts[k], carry = counts[k] ^ carry, counts[k] & carry
        out |= carry
        if j % LOOK == LOOK - 1:
            if radius != (1 << width) - 1:
                above, same = np.zeros(shape, np.uint64), np.full(shape, ALL)
                for k in reversed(range(width)):
                    if radius >> k & 1:
                        same &= counts[k]
                    else:
                        above |= same & counts[k]
                        same &= ~counts[k]
                out |= above
            if (out == ALL).all():
                break
    return ~out


def _lanes(words: np.ndarray) -> np.ndarray:
    return np.unpackbits(words.view(np.uint8), bitorder="little")


def _short_links(fps: np.ndarray, run: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside runs of at most SHORT lanes; all runs share one set of planes, compared at shifts 1, 2, ..."""
    left, right = [], []
    rows = np.arange(len(fps))
    sizes = np.bincount(run)[run]
    for shift in range(1, SHORT):
        wide = sizes > shift
        if not wide.all():
            rows, fps, run, sizes = rows[wide], fps[wide], run[wide], sizes[wide]
        if not len(rows):
            break
        planes = _planes(fps)
        words = planes.shape[1] - 1
        same = np.zeros(words * 64, np.uint8)
        same[:len(run) - shift] = run[shift:] == run[:-shift]
        up = np.uint64(shift)

        def differ(j, planes=planes, up=up):
            return planes[j, :-1] ^ ((planes[j, :-1] >> up) | (planes[j, 1:] << (np.uint64(64) - up)))

        out = ~np.packbits(same, bitorder="little").view(np.uint64)
        at = np.flatnonzero(_lanes(_within(differ, (words,), out, radius)))
        left.append(rows[at])
        right.append(rows[at + shift])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _merged(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Roots (smallest positions) after the links ``i - j`` join their groups."""
    while True:
        a, b = root[i], root[j]
        apart = a != b
        if not apart.any():
            return root
        i, j, low = i[apart], j[apart], np.minimum(a, b)[apart]
        root = root.copy()
        np.minimum.at(root, a[apart], low)
        np.minimum.at(root, b[apart], low)
        while (root != root[root]).any():
            root = root[root]


def _long_roots(fps: np.ndarray, radius: int) -> np.ndarray:
    """For one long run, the first position of each lane's group; tiles of lanes are held against all later lanes."""
    planes = _planes(fps)
    n, words = len(fps), planes.shape[1]
    root = np.arange(n)
    spare = np.zeros(words * 64, np.uint8)
    spare[n:] = 1
    spare = np.packbits(spare, bitorder="little").view(np.uint64)
    bits = ((fps[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)) * ALL
    for lo in range(0, n, TILE):
        tile, first = bits[lo:lo + TILE], lo // 64
        out = np.repeat(spare[None, first:], len(tile), 0)
        near = _within(lambda j, tile=tile, first=first: planes[j][None, first:] ^ tile[:, j][:, None],
                       out.shape, out, radius)
        i, j = np.nonzero(np.unpackbits(near.view(np.uint8), axis=1, bitorder="little"))
        root = _merged(root, i + lo, j + first * 64)
    return root


def star_links(fps: np.ndarray, run: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For ascending ``run`` numbers: (position, first position of its group) of every lane that isn't first."""
    sizes = np.bincount(run)
    at, to = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def add(rows, root):
        moved = np.flatnonzero(root != np.arange(len(root)))
        at.append(rows[moved])
        to.append(rows[root[moved]])

    short = np.flatnonzero((sizes <= SHORT)[run] & (sizes > 1)[run])
    if len(short):
        i, j = _short_links(fps[short], run[short], radius)
        add(short, _merged(np.arange(len(short)), i, j))
    for r in np.flatnonzero(sizes > SHORT):
        mine = np.arange(*np.searchsorted(run, [r, r + 1]))
        add(mine, _long_roots(fps[mine], radius))
    return np.concatenate(at), np.concatenate(to)


def near_links(prints: DataFrame, radius: int = 4, blocks: int = 6, slice_rows: int = 2048) -> DataFrame:
    """Links ``(a, b)`` between distinct fingerprints ``prints(fp)`` that span every group of near ones."""
    spark = prints.sparkSession
    keys = [F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(m).cast("long"))) for k, m in enumerate(_masks(blocks, radius))]
    keyed = settle(prints.select("fp", F.explode(F.array(*keys)).alias("key")))
    counts = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    counts = settle(counts.select("key", F.ceil(F.col("n") / slice_rows).cast("int").alias("slices")))
    met = keyed.join(counts, "key")
    # a cut key: its slice meets each other slice in a group of its own
    mine = F.pmod(F.xxhash64("fp"), F.col("slices")).cast("int")
    met = met.withColumn("mine", mine).withColumn("other", F.explode(F.expr(
        "case when slices = 1 then array(0) else filter(sequence(0, slices - 1), x -> x <> mine) end")))
    met = met.select("fp", F.when(F.col("slices") == 1, F.col("key")).otherwise(
        F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other"))).alias("key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held_fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def links(key, fp):
            turn = np.flatnonzero(np.diff(key)) + 1
            number = np.zeros(len(key), np.int64)
            number[turn] = 1
            i, j = star_links(fp, np.cumsum(number), radius)
            return pa.RecordBatch.from_arrays([pa.array(fp[i].view(np.int64)), pa.array(fp[j].view(np.int64))], ["a", "b"])

        for batch in batches:
            key = np.concatenate([held_key, batch.column(0).to_numpy(zero_copy_only=False)])
            fp = np.concatenate([held_fp, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
            if not len(key):
                continue
            cut = int(np.searchsorted(key, key[-1]))  # the last key may go on in the next batch
            if cut:
                yield links(key[:cut], fp[:cut])
            held_key, held_fp = key[cut:], fp[cut:]
        if len(held_key):
            yield links(held_key, held_fp)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return (met.select("key", "fp").repartition(parts, "key").sortWithinPartitions("key", "fp")
            .mapInArrow(run, "a long, b long"))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4,
                blocks: int = 6, slice_rows: int = 2048) -> DataFrame:
    """One row per input row: ``id_col, fingerprint, component_id``.

    ``fingerprint`` is 16 lower-case hex digits, ``component_id`` the smallest id that
    links reach.  Null, empty and word-less texts have fingerprint zero and link
    like any other.  Null ids are never a component's id unless it has no other
    (then it is null).  Repeated rows stay repeated; an empty table gives no rows.
    """
    prints = settle(fingerprints(docs, id_col, text_col, shingle))
    distinct = settle(prints.groupBy("fp").agg(F.min("id").alias("low")))
    parts = connected_components(near_links(distinct.select("fp"), radius, blocks, slice_rows))
    rooted = settle(distinct.join(parts.withColumnRenamed("vertex", "fp"), "fp", "left").select(
        "fp", "low", F.coalesce("root", "fp").alias("root")))
    # settled, so that both sides of the next join are plain exchanges and a very large component can be split
    lowest = settle(rooted.groupBy("root").agg(F.min("low").alias("component_id")))
    named = rooted.join(lowest, "root").select("fp", "component_id")
    return prints.join(named, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of ``docs`` for each group, with all its columns: the one with the smallest id.

    A null id loses to any other; rows that share an id are told apart by a hash of their text, and of rows that repeat
    id and text one stays.
    """
    mark = unused(docs, "near_key")
    key = F.struct(F.col(id_col).isNull().alias("absent"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash"))
    groups = near_groups(docs.select(key.alias("key"), F.col(text_col).alias("text")), "key", "text", **options)

    def flat(part):
        return F.concat_ws(":", part("hash").cast("string"), part("id").cast("string"))

    kept = groups.where(F.col("key") == F.col("component_id")).select(flat(lambda n: F.col(f"key.{n}")).alias(mark)).distinct()
    own = flat({"id": F.col(id_col), "hash": F.xxhash64(text_col)}.__getitem__)
    # both steps need the rows of a key together: one exchange serves them
    return docs.withColumn(mark, own).join(kept, mark, "left_semi").dropDuplicates([mark]).drop(mark)
