"""Spelling variants: words one edit apart, found by PartEnum signatures of their letter multisets.

A word's letter multiset is a binary vector with a dimension for each (letter, how often so far).  Replacing a letter
changes at most two dimensions, inserting or deleting one changes one, so words one edit apart have vectors at Hamming
distance at most two.  Letters are dealt to ``d + spare + 1`` partitions, for distance ``d``; at least ``spare + 1`` of them
agree, so for each choice of ``spare + 1`` partitions the vector restricted to them is a signature, and near words share one.
Words of one length are held against each other with ``d = 2``, words of neighbouring lengths with ``d = 1``.

A signature alone is shared by very many words of a language. One edit also leaves the first or the second half of a word
as it is, so that half completes the key of the equi-join; every candidate is then verified by its edit distance. Each pair
meets under some key, and no list of the words of a key is ever built.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from faultlens.llm.common import pick, settle

#: The letters of a word (a fixed value of the contract).
LETTERS = "A-Za-z\u00C0-\u00FF"
#: Distinct words that a task counts before it hands them on.
_HELD = 400_000


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 7, every: int = 31) -> DataFrame:
    """``(word, n)``: the words of ``least`` code points or more that occur at least twice, over all rows and whole texts.

    A run of letters with A-Z lower-cased loses one code point if ``every`` divides the CRC-32 of ``<id>:<run>`` (the number
    at ``crc32 % length``); a run of a row without an id is kept as it is. Runs that are too short for a word are not looked
    at; null texts have no runs; repeated rows count each. Tasks count their words before they are shuffled.
    """
    source = pick(docs, id_col, text_col).select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    run_of = re.compile(f"[{LETTERS}]{{{least},}}")

    def count(batches):
        seen: Counter = Counter()

        def rows():
            items = list(seen.items())
            for lo in range(0, len(items), 1 << 16):
                part = items[lo:lo + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in part], pa.string()), pa.array([n for _, n in part], pa.int64())],
                                                 ["word", "n"])
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                # bytes.lower knows A-Z alone
                runs = run_of.findall((text or b"").lower().decode())
                seen.update(runs)
                if key is None:
                    continue
                begin = zlib.crc32(f"{key}:".encode())
                for run in runs:
                    crc = zlib.crc32(run.encode(), begin)
                    if crc % every == 0:
                        at = crc % len(run)
                        seen[run] -= 1
                        seen[run[:at] + run[at + 1:]] += 1
            if len(seen) > _HELD:
                yield from rows()
                seen.clear()
        yield from rows()

    return (source.mapInArrow(count, "word string, n long").where(F.length("word") >= least)
            .groupBy("word").agg(F.sum("n").alias("n")).where("n >= 2"))


def _dealt(letters: str, parts: int) -> list[str]:
    """Letters of each partition: one after the other in the order of ``letters`` (frequent ones are spread)."""
    return [letters[k::parts] for k in range(parts)]


#: Letters from frequent to rare in the languages of the tables, then all others of the range: how they are dealt, not which count.
_ORDER = "etaonrishlducmpgvbfqzyxkjwéüäöèçêàñóíáúß"
_ORDER += "".join(chr(c) for c in [*range(97, 123), *range(0xC0, 0x100)] if chr(c) not in _ORDER)


def restricted(vector: Column, distance: int, spare: int) -> list[Column]:
    """The letters of each of the ``distance + spare + 1`` partitions, in order, each as often as the word holds it."""
    parts = _dealt(_ORDER, distance + spare + 1)
    # translate() takes letters without a counterpart away
    return [F.translate(vector, "".join(p for j, p in enumerate(parts) if j != k), "") for k in range(len(parts))]


def _entries(length: Column, distance: int, spare: int) -> Column:
    """Keys of a word among words whose shorter one has ``length`` letters: one for each choice of partitions and half."""
    front = F.floor(length / 2).cast("int")
    keys = []
    for side, half in (("<", F.substring("word", F.lit(1), front)), (">", F.right("word", (length - front).cast("int")))):
        for chosen in combinations(range(distance + spare + 1), spare + 1):
            name = f"{distance}{side}{','.join(map(str, chosen))}"
            keys.append(F.xxhash64(F.lit(name), length, half, *[F.col(f"part{distance}_{k}") for k in chosen]))
    return F.explode(F.array(*keys)).alias("key")


def near_pairs(found: DataFrame, spare: int = 0) -> DataFrame:
    """``(word, n, other, other_n)``, both ways, for all words one edit apart; each once."""
    vector = F.array_join(F.array_sort(F.split("word", "")), "")
    cut = found.withColumn("vector", vector).select("word", "n", *[
        c.alias(f"part{d}_{k}") for d in (2, 1) for k, c in enumerate(restricted(F.col("vector"), d, spare))])
    size = F.length("word")
    same = cut.select("word", "n", _entries(size, 2, spare))
    # the half is that of the shorter word: a longer word counts as one letter shorter
    shorter, longer = cut.select("word", "n", _entries(size, 1, spare)), cut.select("word", "n", _entries(size - 1, 1, spare))

    def met(left, right, condition):
        a, b = left.alias("a"), right.alias("b")
        pairs = a.join(b, F.col("a.key") == F.col("b.key")).where(condition)
        return pairs.where(F.levenshtein("a.word", "b.word", 1) == 1).select(
            F.col("a.word").alias("word"), F.col("a.n").alias("n"), F.col("b.word").alias("other"), F.col("b.n").alias("other_n"))

    near = met(same, same, F.expr("a.word < b.word")).union(met(shorter, longer, F.lit(True))).distinct()
    return near.union(near.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"),
                                  F.col("n").alias("other_n")))


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 7, every: int = 31,
             ratio: int = 10, spare: int = 0) -> DataFrame:
    """One row per word: ``word, form, root, n, n_near, form_n``.

    ``form`` is the near word of largest ``n`` (ties: the smallest in code-point order) if it occurs at least ``ratio``
    times as often, else null; ``root`` is the end of the chain of forms. Null and empty texts and empty tables have no
    words; extra columns are ignored.
    """
    found = settle(words(docs, id_col, text_col, least, every))
    near = settle(near_pairs(found, spare))
    # UTF-8 text sorts in code-point order
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    best = best.select(F.col("word").alias("at"), "n_near", F.col("best.other").alias("other"), (-F.col("best.less")).alias("other_n"))
    enough = F.col("other_n") >= ratio * F.col("n")
    formed = settle(found.join(best, found["word"] == best["at"], "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(enough, F.col("other")).alias("form"), F.when(enough, F.col("other_n")).alias("form_n")))
    # a form is ratio times as frequent as its word, so chains are short; each round doubles the steps that a word has gone
    ends = formed.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        ends = settle(ends)
        on = ends.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = ends.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), "next")
        further = settle(further)
        ends = further.select("word", "root")
        if further.where("next IS NOT NULL").isEmpty():
            break
    return formed.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
