"""Exact, near, line and substring dedup against plain versions."""

import random

import numpy as np

from faultlens.llm import components, exact_dedup, line_dedup, simhash, substring_dedup
from tests.llm import brute
from tests.llm.conftest import ordered


def test_exact_matches_brute_force(docs, texts):
    got = exact_dedup.exact_dedup(docs).collect()
    assert ordered((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == ordered(brute.exact_dedup(texts))
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)


def test_exact_odd_rows(odd, empty):
    got = exact_dedup.exact_dedup(odd.repartition(5), fan_in=2).collect()
    assert ordered((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == ordered(brute.exact_dedup(brute.ODD))
    kept = [r for r in got if r.kept]
    assert len(kept) == len({r.text_sha256 for r in got})  # one row of each text, also among repeated rows
    assert exact_dedup.exact_dedup(empty).count() == 0
    left = exact_dedup.survivors(odd)
    assert left.columns == odd.columns and left.count() == len(kept)


def test_exact_tree_shrinks_a_hot_text(spark):
    rows = spark.range(0, 4000, numPartitions=37).selectExpr("id as doc_id", "if(id % 3 = 0, 'hot', cast(id as string)) as text")
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(rows, fan_in=4).collect()}
    assert got[3999].keep_id == 0 and got[3999].group_size == 1334 and got[1].group_size == 1


def test_merges_read_their_runs_in_order(spark):
    rows = spark.range(0, 2000, numPartitions=8).selectExpr("id as doc_id", "cast(id % 300 as string) as text")
    level = exact_dedup.digests(rows).selectExpr("run", "digest", "n_bytes", "sha", "struct(id is null as absent, id, row) as best",
                                                 "1L as group_size")
    plan = exact_dedup.merged(level)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == plan.count("rangepartitioning(") == 1
    # one sort by the ranges' keys, which the aggregates go on with
    assert plan.count("Sort [") == 1
    whole = exact_dedup.merged(exact_dedup.merged(level).withColumn("run", level.run * 0)).collect()
    assert len(whole) == 300 and sum(r.group_size for r in whole) == 2000
    assert sorted(r.best.id for r in whole) == list(range(300))


def test_survivors_keep_columns_of_any_name(spark):
    rows = [(5, "one  two three four", 1, "x", 2), (2, "one two three four", 2, "y", 3), (None, "one two three four", 3, "z", 4),
            (2, "one two three four", 4, "w", 5), (7, None, 5, "", 6), (8, "", 6, None, 7)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, kept_key long, Near_Key string, __sha long")
    for stage in (exact_dedup.survivors, simhash.survivors):
        left = stage(frame)
        # whole rows are dealt once: one exchange by the key on each side of the join
        plan = left._jdf.queryExecution().executedPlan().toString()
        assert plan.count("hashpartitioning(_kept_key") + plan.count("hashpartitioning(_near_key") == 2
        assert left.columns == frame.columns and left.schema == frame.schema
        assert sorted(r.doc_id for r in left.collect()) == [2, 7]
        assert all(tuple(r) in rows for r in left.collect())


def near_brute(rows):
    prints = [brute.simhash(t) for _, t in rows]
    root = components_of(prints)
    low = {}
    for r, (i, _) in zip(root, rows):
        if i is not None:
            low[r] = min(low.get(r, i), i)
    return [(i, f"{p:016x}", low.get(r)) for (i, _), p, r in zip(rows, prints, root)]


def components_of(prints, radius=4):
    different = sorted(set(prints))
    root = brute.components(len(different), lambda a, b: (different[a] ^ different[b]).bit_count() <= radius)
    at = {p: root[k] for k, p in enumerate(different)}
    return [at[p] for p in prints]


def test_near_matches_brute_force(docs, texts):
    assert ordered(simhash.near_groups(docs).collect()) == ordered(near_brute(texts))


def test_near_odd_rows(odd, empty):
    assert ordered(simhash.near_groups(odd).collect()) == ordered(near_brute(brute.ODD))
    assert simhash.near_groups(empty).count() == 0
    left = simhash.survivors(odd)
    assert left.columns == odd.columns
    assert left.count() == len(set(components_of([brute.simhash(t) for _, t in brute.ODD])))
    assert {r.doc_id for r in left.collect()} >= {1, 4, 5} and None not in {r.doc_id for r in left.collect()}


def test_survivors_tell_rows_of_one_id_apart(spark):
    a, b = "one two three four five six", "seven eight nine ten eleven twelve"
    rows = [(3, b), (5, a), (5, b), (5, a), (None, a), (None, "thirteen fourteen fifteen sixteen")]
    left = simhash.survivors(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.text) for r in left), key=str) == sorted([(3, b), (5, a), rows[5]], key=str)


def test_near_hot_bucket_is_cut_into_slices(spark):
    draw = random.Random(4)
    base = draw.getrandbits(64)
    prints = {base ^ sum(1 << b for b in draw.sample(range(64), draw.randint(0, 5))) for _ in range(900)}
    prints |= {draw.getrandbits(64) for _ in range(300)}
    prints = sorted(prints)
    rows = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    for slice_rows in (50, 2048):
        links = components.connected_components(simhash.near_links(rows, slice_rows=slice_rows)).collect()
        found = {r.vertex % (1 << 64): r.root % (1 << 64) for r in links}
        want = components_of(prints)
        mine = [prints.index(found.get(p, p)) for p in prints]
        assert len(set(zip(want, mine))) == len(set(want)) == len(set(mine))


def test_bit_sliced_links_in_short_and_long_runs():
    draw = np.random.default_rng(1)
    prints = []
    for b in draw.integers(0, 2 ** 64, 30, dtype=np.uint64):
        for _ in range(draw.integers(1, 120)):
            x = int(b)
            for bit in draw.integers(0, 64, draw.integers(0, 5)):
                x ^= 1 << int(bit)
            prints.append(x)
    prints = np.unique(np.array(prints, np.uint64))
    draw.shuffle(prints)
    for runs in (1, 40):
        run = np.sort(draw.integers(0, runs, len(prints)))
        i, j = simhash.star_links(prints, run, 4)
        root = np.arange(len(prints))
        root[i] = j
        want = brute.components(len(prints), lambda a, b: run[a] == run[b] and int(prints[a] ^ prints[b]).bit_count() <= 4)
        assert root.tolist() == want


def test_radius_other_than_four():
    prints = np.array([0, 1, 3, 7, 15, 3 << 40], np.uint64)
    for radius, groups in ((0, 6), (1, 2), (3, 1)):
        i, _ = simhash.star_links(prints, np.zeros(6, np.int64), radius)
        assert len(prints) - len(i) == groups


def test_components_of_a_long_chain(spark):
    chain = spark.range(300).selectExpr("id as a", "id + 1 as b")
    got = components.connected_components(chain).collect()
    assert len(got) == 300 and {r.root for r in got} == {0}
    assert components.connected_components(chain.limit(0)).count() == 0


def test_lines_match_brute_force(docs, texts):
    assert ordered(line_dedup.line_dedup(docs, batches=3, fan_in=2).collect()) == ordered(brute.line_dedup(texts, 10))


def test_lines_odd_rows(odd, empty):
    for least in (1, 2, 3):
        got = line_dedup.line_dedup(odd, min_docs=least, batches=2).collect()
        assert ordered(got) == ordered(brute.line_dedup(brute.ODD, least))
    assert line_dedup.line_dedup(empty).count() == 0


def test_runs_compact_and_skip_known_keys(spark):
    runs = line_dedup.LineRuns(spark, enough=2, fan_in=2)
    keys = spark.createDataFrame([(1, 1), (1, 1), (2, 2)], "h1 long, h2 long")
    for _ in range(4):
        runs.add(keys)
    assert [len(level) for level in runs.levels] == [0, 0, 1]
    counts = {r.h1: r.n for r in runs._merged(runs.levels[2]).collect()}
    assert counts == {1: 2, 2: 2}  # a key that is known in enough documents isn't counted on
    assert {r.h1 for r in runs.frequent().collect()} == {1, 2}


def made_passages(seed=5):
    draw = random.Random(seed)
    words = [f"w{k}" for k in range(200)]
    passages = [[draw.choice(words) for _ in range(draw.randint(10, 60))] for _ in range(10)]
    rows = []
    for i in range(150):
        x = []
        for _ in range(draw.randint(0, 5)):
            x += draw.choice(passages) if draw.random() < 0.6 else [draw.choice(words) for _ in range(draw.randint(1, 40))]
        rows.append((draw.choice([i, i, i // 2, None]), " ".join(x)))
    return rows + [(900, "a " * 2000), (901, "a " * 30), (902, "b a" * 100), (903, "a " * 2000)] + rows[:3]


def test_substrings_match_brute_force(spark, monkeypatch):
    rows = made_passages()
    monkeypatch.setattr(substring_dedup, "SHARD_WORDS", 500)  # many shards and slices
    monkeypatch.setattr(substring_dedup, "MANY", 3)  # most anchors go through their shared windows
    got = substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), window=20).collect()
    want = brute.substring_dedup(rows, 20)
    assert ordered(got) == ordered(want) and sum(w[2] > 0 for w in want) > 50


def test_substrings_of_the_documents(docs, texts):
    assert ordered(substring_dedup.substring_dedup(docs).collect()) == ordered(brute.substring_dedup(texts, 50))


def test_substrings_odd_rows(odd, empty):
    assert ordered(substring_dedup.substring_dedup(odd).collect()) == ordered(brute.substring_dedup(brute.ODD, 50))
    assert substring_dedup.substring_dedup(empty).count() == 0


def test_automaton_knows_the_smallest_document():
    draw = random.Random(2)
    texts = [[draw.randrange(3) for _ in range(draw.randint(1, 25))] for _ in range(40)]
    automaton = substring_dedup.Automaton()
    for i, x in enumerate(texts):
        automaton.add(x, 100 - i)
    automaton.finish()
    query = [draw.randrange(3) for _ in range(300)]

    def holds(x, w):
        return any(x[k:k + 5] == w for k in range(len(x) - 4))
    want = [min((100 - i for i, x in enumerate(texts) if holds(x, query[k:k + 5])), default=None) for k in range(296)]
    assert automaton.smallest(query, 5) == want
